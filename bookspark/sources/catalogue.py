"""Answers of a book catalogue in JSON as candidate records, and metadata documents with one value or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.functions import catalogue as cat

SEARCH = "docs array<struct<key:string,title:string,author_name:array<string>,publisher:array<string>,first_publish_year:int,subject:array<string>,isbn:array<string>,cover_i:bigint>>"


def search(answers: DataFrame, body: str = "body", want_title: str | None = None, want_author: str | None = None) -> DataFrame:
    """Candidates of each answer, best first; records without a key are dropped, broken JSON gives none."""
    d = answers.select(F.posexplode(F.from_json(body, SEARCH)["docs"]).alias("ord", "d")).where("d.key is not null")
    score = cat.match_score(F.col("d.title"), F.col("d.author_name"), F.lit(want_title), F.lit(want_author))
    return d.select("ord", F.col("d.key").alias("ref"), F.col("d.title").alias("title"), F.col("d.author_name").alias("authors"), F.try_element_at("d.publisher", F.lit(1)).alias("publisher"), F.col("d.first_publish_year").cast("string").alias("date"), F.slice("d.subject", 1, 12).alias("subjects"), F.try_element_at("d.isbn", F.lit(1)).alias("isbn"), score.cast("float").alias("score")).orderBy(F.desc("score"), "ord")


def work(body: Column) -> tuple[Column, Column, Column]:
    """(description, subjects, cover) of a work: the description as text or object, twelve subjects, the first positive cover."""
    as_text = F.get_json_object(body, "$.description.value")
    plain = F.get_json_object(body, "$.description")
    covers = F.from_json(F.get_json_object(body, "$.covers"), "array<bigint>")
    return F.coalesce(as_text, plain), F.slice(F.from_json(F.get_json_object(body, "$.subjects"), "array<string>"), 1, 12), F.try_element_at(F.filter(covers, lambda c: c > 0), F.lit(1))


def one_or_many(value: Column) -> Column:
    """A JSON string or array of strings as an array; null stays null."""
    many = F.from_json(value, "array<string>")
    return F.when(value.isNull(), F.lit(None)).when(F.ltrim(value).startswith("["), many).otherwise(F.array(F.coalesce(F.try_element_at(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(1)), value)))
