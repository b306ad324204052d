import io
import zipfile

from pyspark.sql import functions as F

from bookspark.streaming import ingest


def test_archive_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("a.xhtml", "x")
    (src / "one.epub").write_bytes(b.getvalue())
    q = ingest.archive_stream(spark, str(src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.book_id, r.path) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("one", "mimetype"), ("one", "a.xhtml")}


def test_window_counts(spark, data, tmp_path):
    w = spark.read.parquet(f"{data}/warnings.parquet")
    w.write.parquet(str(tmp_path / "w"))
    s = ingest.warning_stream(spark, str(tmp_path / "w"), w.schema)
    q = ingest.counts_by_window(s, late="400 days", width="1 day").writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("counts").groupBy("window", "book_id").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    assert got == w.where("read_at is not null").select("warning_id").distinct().count()
