"""Names that must not repeat: slugs, manifest ids, parts, output files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Anchors of one page from which those that nothing refers to are dropped.
ID_CAP = 1024


def suffixed(base: Column, n: Column) -> Column:
    """The first of a name as it is, the second with -2, and so on."""
    return F.when(n > 1, F.concat(base, F.lit("-"), n.cast("string"))).otherwise(base)


def dedupe(df: DataFrame, group: list[str], base: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the base, numbered where it repeats within its group."""
    n = F.row_number().over(Window.partitionBy(*group, base).orderBy(*order))
    return df.withColumn(name, suffixed(F.col(base), n))


def keep_first(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with a flag for the first row of each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1)


def island_numbers(df: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """Numbers of list items in order: one more than the item before, or the value that an item sets; the first is 1 without one."""
    w = Window.partitionBy(group).orderBy(order)
    island = df.withColumn("_value", value).withColumn("_island", F.count("_value").over(w))
    v = Window.partitionBy(group, "_island").orderBy(order)
    return island.withColumn(name, (F.coalesce(F.first("_value").over(v), F.lit(1)) + F.row_number().over(v) - 1).cast("int")).drop("_value", "_island")


def cap_ids(ids: DataFrame, referenced: DataFrame, group: list[str], cap: int = ID_CAP) -> DataFrame:
    """The ids (group, id) that are dropped: of groups with more than ``cap`` all that nothing refers to, not only the excess.

    ``referenced`` (book_id, fragment) holds bare fragments of a whole book.
    """
    many = ids.withColumn("_n", F.count("*").over(Window.partitionBy(*group))).where(F.col("_n") > cap).drop("_n")
    return many.join(referenced.select("book_id", F.col("fragment").alias("id")).distinct(), ["book_id", "id"], "left_anti")


def manifest_base(path: Column) -> Column:
    """The id that a path suggests: letters and digits, hyphens for the rest, a letter first."""
    flat = F.regexp_replace(path, "[^A-Za-z0-9]", "-")
    return F.when(flat.rlike("^[A-Za-z]"), flat).otherwise(F.concat(F.lit("id-"), flat))


def first_free(wanted: str, taken: set[str], start: int = 2, form: str = "{0}-{1}") -> str:
    """The name, or with the first number from ``start`` that is free; it is taken then."""
    name, n = wanted, start
    while name in taken:
        name = form.format(wanted, n)
        n += 1
    taken.add(name)
    return name


def reserve(df: DataFrame, group: str, wanted: str, order: str, name: str, start: int = 2, form: str = "{0}-{1}") -> DataFrame:
    """``df`` with names that no earlier row of the group has, given in order; a suffixed name may meet another's own, so this is one pass over each group.

    Rows stream through a task in order, which holds the names of one group.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {name} string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, taken = None, set()
        for pdf in batches:
            out = []
            for g, w in zip(pdf[group], pdf[wanted], strict=True):
                if g != at:
                    at, taken = g, set()
                out.append(None if w is None else first_free(w, taken, start, form))
            yield pdf.assign(**{name: pd.Series(out, index=pdf.index, dtype=object)})

    return df.repartition(group).sortWithinPartitions(group, order).mapInPandas(run, schema)


def manifest_ids(resources: DataFrame) -> DataFrame:
    """(book_id, ord, path, id): a unique id for every resource of a book, in order."""
    based = resources.select("book_id", "ord", "path", manifest_base(F.col("path")).alias("_base"))
    return reserve(based, "book_id", "_base", "ord", "id").drop("_base")


def output_names(books: DataFrame, template: Column | None, appendix: str, in_place: bool = False) -> DataFrame:
    """``books`` (book_id, folder, file_name) with ``output``: the template or the stem with the new extension; where that is the input itself the appendix goes between. A name that an earlier row has is marked ``clash``."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    plain = F.concat(F.coalesce(template, stem) if template is not None else stem, F.lit(".epub"))
    own = F.lower(plain) == F.lower("file_name")
    name = F.col("file_name") if in_place else F.when(own, F.concat(F.regexp_replace(plain, r"(?i)\.epub$", ""), F.lit(f".{appendix}.epub"))).otherwise(plain)
    out = books.withColumn("output", name)
    return out.withColumn("clash", F.row_number().over(Window.partitionBy("folder", F.lower("output")).orderBy("book_id")) > 1)
