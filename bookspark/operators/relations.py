"""Small relational operators over the tables of books and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookspark.functions import color
from bookspark.session import checkpointed

#: Suffix of outputs when a profile names none.
DEFAULT_SUFFIX = "fitted"
#: Rows of a table above which it is never a picture, a fixed value.
TALLEST = 24


def by_kind(df: DataFrame, kind: str, order: str) -> DataFrame:
    """(kind, n, first_seen): how often each kind was reported, and where first."""
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))


def run_stats(runs: DataFrame, group: str) -> DataFrame:
    """Figures of runs per group; repeated rows count once."""
    sums = [F.sum(a).alias(b) for a, b in (("bytes_in", "bytes_in"), ("bytes_out", "bytes_out"), ("images_processed", "images"), ("chapters_split", "chapters_split"), ("warnings", "warnings"))]
    return runs.distinct().groupBy(group).agg(F.count("*").alias("runs"), F.countDistinct("book_id").alias("books"), *sums)


def batch_summary(outcomes: DataFrame, group: str, statuses: tuple[str, ...]) -> DataFrame:
    """Counts per status, one column each."""
    return outcomes.groupBy(group).pivot("status", list(statuses)).agg(F.count(F.lit(1))).na.fill(0, list(statuses))


def compose_renames(first: DataFrame, then: DataFrame) -> DataFrame:
    """(book_id, a, final) of renamings (book_id, a, b) followed by others (book_id, b, c): the later name where there is one."""
    return first.join(then, ["book_id", "b"], "left").select("book_id", "a", F.coalesce("c", "b").alias("final"))


def referenced_fragments(html: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, fragment): bare fragments that links of pages (book_id, html) or the contents (book_id, fragment) name."""
    links = html.select("book_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="[^"#]*#([^"]+)"'), F.lit(1))).alias("fragment"))
    return links.union(toc.select("book_id", "fragment")).distinct()


def follow(edges: DataFrame) -> DataFrame:
    """copy, source, depth for edges (b, a) with a < b: each chain to its end, by pointer doubling over checkpoints."""
    state = checkpointed(edges.select("b", F.col("a").alias("root"), F.lit(1).alias("depth")))
    while True:
        on = state.select(F.col("b").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        if state.join(on, "root", "left_semi").isEmpty():
            return state.select(F.col("b").alias("copy"), F.col("root").alias("source"), "depth")
        state = checkpointed(state.join(on, "root", "left").select("b", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def output_suffixes(appendixes: DataFrame) -> DataFrame:
    """(suffix) of all outputs: of every profile's appendix and of the default, in small letters."""
    a = appendixes.where("appendix is not null").select(F.lower("appendix").alias("suffix"))
    default = appendixes.sparkSession.range(1).select(F.lit(DEFAULT_SUFFIX).alias("suffix"))
    return a.union(default).distinct().select(F.concat(F.lit("."), "suffix", F.lit(".epub")).alias("suffix"))


def prior_outputs(files: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Files whose name ends in a suffix of outputs. Names are cut at their dots, so this is an equi join."""
    parts = F.expr("transform(filter(sequence(1, size(split(lower(name), '[.]'))), k -> k > 1), k -> concat('.', array_join(slice(split(lower(name), '[.]'), k, 99), '.')))")
    return files.withColumn("suffix", F.explode(parts)).join(suffixes.select("suffix").distinct(), "suffix", "left_semi").drop("suffix").distinct()


def rank_candidates(candidates: DataFrame, group: str, limit: int) -> DataFrame:
    """The best ``limit`` (1 to 50) records of each group by score, ties by reference, with twelve subjects at most."""
    n = min(50, max(1, limit))
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last("score"), "ref")
    c = candidates.select(group, "ref", "score", F.slice("subject", 1, 12).alias("subjects")).distinct()
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def smallest_attempt(attempts: DataFrame, group: str, size: str, order: str) -> DataFrame:
    """The smallest attempt of each group, the first of equals."""
    return attempts.where(F.col(size).isNotNull()).groupBy(group).agg(F.min(F.struct(size, order)).alias("m")).select(group, f"m.{size}", f"m.{order}")


def tone_histogram(pixels: DataFrame, group: str, tone: str = "tone") -> DataFrame:
    """(group, tone, n)."""
    return pixels.groupBy(group, tone).agg(F.count("*").alias("n"))


def tone_kind(histogram: DataFrame, group: str) -> DataFrame:
    """Per group: tones, share of the two commonest, bounds at one per cent from either end, and whether it is line art (at most sixteen tones, or two that make 85 %)."""
    w = Window.partitionBy(group)
    run = lambda o: w.orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    up = histogram.withColumn("total", F.sum("n").over(w)).withColumn("below", F.sum("n").over(run("tone"))).withColumn("above", F.sum("n").over(run(F.desc("tone")))).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "tone")))
    share = F.round(F.sum(F.when(F.col("rank") <= 2, F.col("n")).otherwise(0)) / F.max("total"), 4)
    g = up.groupBy(group).agg(F.count("*").alias("tones"), share.alias("top_two"), F.min(F.when(F.col("below") * 100 > F.col("total"), F.col("tone"))).alias("low"), F.max(F.when(F.col("above") * 100 > F.col("total"), F.col("tone"))).alias("high"))
    return g.withColumn("line_art", (F.col("tones") <= 16) | (F.col("top_two") >= 0.85))


def nearest_level(tone: Column, levels: int) -> Column:
    """The gray of the panel nearest to a tone, the darker of two equals."""
    every = F.array(*[F.lit(v) for v in color.panel_levels(levels)])
    return F.array_min(F.transform(every, lambda v: F.struct(F.abs(v - tone).alias("gap"), v.alias("v")))).getField("v")


def tables_of(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table_id, html) of every table without a table in it; repeated pages count once."""
    found = pages.select(key, F.regexp_extract_all(html, F.lit(r"(?is)<table\b(?:(?!<table\b).)*?</table>"), F.lit(0)).alias("tables"))
    return found.where("size(tables) > 0").dropDuplicates([key]).select(key, F.posexplode("tables").alias("table_id", "html"))


def table_facts(tables: DataFrame) -> DataFrame:
    """``tables`` with n_rows, n_body (without the header row), n_columns, holds_ids, holds_links, holds_images, numeric share of the body's cells."""
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    t = tables.withColumn("_rows", rows)
    all_heads = F.regexp_count(F.try_element_at("_rows", F.lit(1)), F.lit(r"(?i)<td\b")) == 0
    headed = F.coalesce(F.col("html").rlike(r"(?i)<thead\b") | (all_heads & (F.regexp_count(F.try_element_at("_rows", F.lit(1)), F.lit(r"(?i)<th\b")) > 0)), F.lit(False))
    cells = F.filter(F.transform(F.regexp_extract_all(F.array_join(F.when(headed, F.slice("_rows", 2, 2**30)).otherwise(F.col("_rows")), "\n"), F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))), lambda c: c != "")
    numeric = F.filter("_cells", lambda c: F.regexp_replace(c, r"[$€£%,()+\-.\s]", "").rlike("^[0-9]+$"))
    t = t.withColumn("_cells", cells).withColumn("n_rows", F.size("_rows")).withColumn("n_body", F.size("_rows") - headed.cast("int"))
    t = t.withColumn("n_columns", F.array_max(F.transform("_rows", lambda r: F.regexp_count(r, F.lit(r"(?i)<t[dh]\b")))))
    t = t.withColumn("numeric", F.when(F.size("_cells") > 0, F.size(numeric) / F.size("_cells")).otherwise(0.0))
    return t.withColumn("holds_ids", F.col("html").rlike(r"(?i)\sid\s*=\s*[\"']\s*\S")).withColumn("holds_links", F.col("html").rlike(r"(?i)<a\b[^>]*\shref\s*=")).withColumn("holds_images", F.col("html").rlike(r"(?i)<(?:img|svg|image)\b")).drop("_rows", "_cells")


def table_fate(mode: str = "image") -> Column:
    """What becomes of a table by its facts: targets, links, pictures or too many body rows keep it text whatever the mode."""
    text = F.col("holds_ids") | F.col("holds_links") | F.col("holds_images") | (F.col("n_body") > TALLEST) | F.lit(mode == "text")
    picture = F.lit(mode == "image-all") | (F.col("n_columns") >= 3) | (F.col("numeric") > 0.5)
    return F.when(text, "text").when(picture, "image").otherwise("text")
