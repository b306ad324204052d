"""Content rules and predicates over texts, metadata and resources."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.functions import text as tx


@dataclass(frozen=True)
class Rule:
    """Remove a literal, or replace it, in the named targets (text, href, file)."""

    action: str
    match: str
    with_: str = ""
    targets: frozenset[str] = field(default=frozenset({"text"}))

    def applies_to(self, target: str) -> bool:
        return target in self.targets


def apply_to_text(text: Column, rules: list[Rule], target: str = "text") -> Column:
    """Rules in order, each seeing what the last one left; one expression, so one pass."""
    use = [r for r in rules if r.applies_to(target)]
    return reduce(lambda c, r: F.replace(c, F.lit(r.match), F.lit(r.with_ if r.action == "replace" else "")), use, text)


def rule_hits(df: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """``df`` with the new text and, per rule, how often it applied. Null texts stay null and count nothing."""
    cur: Column = F.col(text)
    hits = []
    for i, r in enumerate(rules):
        hits.append(F.coalesce(tx.count_of(cur, r.match), F.lit(0)).alias(f"hits_{i}"))
        cur = F.replace(cur, F.lit(r.match), F.lit(r.with_ if r.action == "replace" else ""))
    return df.select("*", *hits, cur.alias("new_text"))


def metadata_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rules on title, description, publisher, subjects and, where they are there, authors: a title never becomes blank, blank values vanish. Contributors, rights and series stay."""

    def one(c: Column) -> Column:
        return apply_to_text(c, rules)

    title = one(F.col("title"))
    if "authors" in df.columns:
        df = df.withColumn("authors", F.filter(F.transform("authors", lambda a: a.withField("name", one(a["name"]))), lambda a: F.trim(a["name"]) != ""))
    return df.withColumns(
        {
            "title": F.when(F.trim(title) == "", F.col("title")).otherwise(title),
            "description": tx.blank_to_null(one(F.col("description"))),
            "publisher": tx.blank_to_null(one(F.col("publisher"))),
            "subjects": F.filter(F.transform("subjects", one), lambda x: F.trim(x) != ""),
        }
    )


def toc_rules(toc: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rules on the labels of the contents; one that would become blank stays as it was."""
    new = apply_to_text(F.col("title"), rules)
    return toc.withColumn("title", F.when(F.trim(new) == "", F.col("title")).otherwise(new))


def drop_resources(resources: DataFrame, protected: DataFrame, rules: list[Rule], path: str = "path") -> DataFrame:
    """Resources that a file rule names, without the protected ones (an anti join, no list on the driver)."""
    hit = reduce(lambda c, r: c | F.col(path).contains(r.match), [r for r in rules if r.action == "remove" and r.applies_to("file")], F.lit(False))
    return resources.where(hit).join(protected, ["book_id", path], "left_anti")


# fixed values of the style subset
PROPERTIES = frozenset("text-align text-indent font-weight font-style font-size text-decoration margin margin-top margin-right margin-bottom margin-left padding padding-top padding-right padding-bottom padding-left line-height vertical-align".split())
MODERN = r"(?i)(calc|var|clamp|min|max|env)\("


def selector_supported(selector: Column) -> Column:
    """A tag, a class or both."""
    return (F.length(selector) > 0) & selector.rlike(r"^([A-Za-z0-9_-]+)?(\.[A-Za-z0-9_-]+)?$")


def uses_modern_function(value: Column) -> Column:
    return value.rlike(MODERN)


def property_supported(name: Column, value: Column) -> Column:
    n = F.lower(name)
    ok = n.isin(*sorted(PROPERTIES - {"vertical-align"})) | ((n == "display") & (F.lower(F.trim(value)) == "none")) | ((n == "vertical-align") & F.lower(F.trim(value)).isin("super", "sub"))
    return ok & ~uses_modern_function(value)
