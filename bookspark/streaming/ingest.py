"""Streams of archives and of reader warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bookspark.sources import archive


def archive_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of every archive that arrives in a folder."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.epub").load(folder)
    return archive.entries(files.select(F.regexp_extract("path", r"([^/]+)\.epub$", 1).alias("book_id"), "content"))


def warning_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def counts_by_window(warnings: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Warnings per book and window of the time they describe; repeated ids within the watermark count once, later rows are dropped."""
    once = warnings.withColumn("read_at", F.col("read_at").cast("timestamp")).withWatermark("read_at", late).dropDuplicatesWithinWatermark(["warning_id"])
    return once.groupBy(F.window("read_at", width), "book_id").agg(F.count("*").alias("n"))
