"""Style sheets as rule tables, and what a small reader keeps of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.operators import filters

RULES = "sheet string, rule_ord int, at_rule string, selector string, decl_ord int, prop string, value string, important boolean"
_COMMENT = re.compile(r"/\*.*?\*/", re.S)


def _blocks(css: str) -> Iterator[tuple[str, str]]:
    """(prelude, body) of the top level; statements without a block have the body None."""
    depth, start, brace = 0, 0, 0
    quote = ""
    for i, c in enumerate(css):
        if quote:
            quote = "" if c == quote and css[i - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c == "{":
            if depth == 0:
                brace = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                yield css[start:brace].strip(), css[brace + 1:i]
                start = i + 1
        elif c == ";" and depth == 0:
            yield css[start:i].strip(), ""
            start = i + 1


def parse(css: str, at: str | None = None, counter: list[int] | None = None) -> list[tuple]:
    """(rule, at rule, selector, declaration, property, value, important) in order; broken rules are left out."""
    out: list[tuple] = []
    counter = counter if counter is not None else [0]
    for prelude, body in _blocks(_COMMENT.sub("", css)):
        if prelude.startswith("@"):
            name = prelude.split()[0].lower()
            if name in ("@media", "@supports") and body:
                out += parse(body, prelude, counter)
            else:
                out.append((counter[0], prelude, None, 0, None, body.strip() or None, False))
                counter[0] += 1
            continue
        for selector in filter(None, (s.strip() for s in prelude.split(","))):
            n = 0
            for d in re.split(r";(?![^(]*\))", body):
                prop, sep, value = d.partition(":")
                if sep and prop.strip() and value.strip():
                    bare = re.sub(r"\s*!\s*important\s*$", "", value.strip(), flags=re.I)
                    out.append((counter[0], at, selector, n, prop.strip().lower(), bare, bare != value.strip()))
                    n += 1
        counter[0] += 1
    return out


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(sheet, *r) for sheet, css in zip(pdf["sheet"], pdf["css"], strict=True) if css for r in parse(css)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RULES.split(", ")])


def rules(df: DataFrame, sheet: Column, css: Column) -> DataFrame:
    return df.select(sheet.cast("string").alias("sheet"), css.alias("css")).mapInPandas(_rules, RULES)


def plain_media(at_rule: Column) -> Column:
    """Whether a media rule has a member that is all or screen, without negation and condition."""
    members = F.split(F.regexp_extract(F.lower(at_rule), r"^@media\s+(.*)$", 1), ",")
    return F.exists(members, lambda m: m.rlike(r"^\s*(?:only\s+)?(?:all|screen)\s*$"))


def subset(r: DataFrame) -> DataFrame:
    """Declarations that a small reader supports: plain selectors, plain properties. Rules for all or screen media come out of their block, marks of importance go."""
    kept = r.where(F.col("selector").isNotNull() & (F.col("at_rule").isNull() | plain_media(F.col("at_rule"))) & filters.selector_supported(F.col("selector")) & filters.property_supported(F.col("prop"), F.col("value")))
    return kept.withColumn("at_rule", F.lit(None).cast("string")).withColumn("important", F.lit(False))


def sanitized(r: DataFrame) -> DataFrame:
    """Without custom properties, modern functions, feature queries and range media; the rest stays."""
    return r.where(~F.coalesce(F.col("prop").startswith("--"), F.lit(False)) & ~F.coalesce(filters.uses_modern_function(F.col("value")), F.lit(False)) & ~F.coalesce(F.lower("at_rule").startswith("@supports") | F.col("at_rule").rlike("[<>]"), F.lit(False)))


def emit(r: DataFrame) -> DataFrame:
    """(sheet, css): the rules of each sheet as compact text, in order; conditions around a rule, statements and marks of importance are kept."""
    one = F.concat("prop", F.lit(":"), "value", F.when(F.col("important"), "!important").otherwise(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("decl_ord", one.alias("d")))), lambda x: x["d"]), ";")
    rules_ = r.where("selector is not null").groupBy("sheet", "rule_ord", "at_rule", "selector").agg(body.alias("body"))
    plain = F.concat("selector", F.lit("{"), "body", F.lit("}"))
    styled = rules_.select("sheet", "rule_ord", "selector", F.when(F.col("at_rule").isNull(), plain).otherwise(F.concat("at_rule", F.lit("{"), plain, F.lit("}"))).alias("text"))
    at = r.where("selector is null").select("sheet", "rule_ord", F.lit("").alias("selector"), F.when(F.col("value").isNull(), F.concat("at_rule", F.lit(";"))).otherwise(F.concat("at_rule", F.lit("{"), "value", F.lit("}"))).alias("text"))
    every = styled.unionByName(at).groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "selector", "text"))).alias("all"))
    return every.select("sheet", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("css"))


def part_path(path: Column, part: Column) -> Column:
    """The name of a part of a sheet: the first keeps it, later ones get -2, -3 before the extension."""
    dot = path.rlike(r"\.[^./]*$")
    numbered = F.when(dot, F.concat(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit("-"), part.cast("string"), F.regexp_extract(path, r"(\.[^.]*)$", 1))).otherwise(F.concat(path, F.lit("-"), part.cast("string")))
    return F.when(part > 1, numbered).otherwise(path)


def rule_total(sheets: DataFrame, css: Column, cap: int | None = None) -> DataFrame:
    """(book_id, n_rules, over_cap): closing braces of all sheets of a book."""
    n = sheets.groupBy("book_id").agg(F.coalesce(F.sum(F.regexp_count(css, F.lit(r"\}"))), F.lit(0)).alias("n_rules"))
    return n.withColumn("over_cap", F.col("n_rules") > cap if cap is not None else F.lit(False))


def scoped(r: DataFrame, n: DataFrame) -> DataFrame:
    """Rules whose selector some element of the same document matches: by tag, then by class (an equi join with a residual)."""
    els = n.where("kind = 'element'").select(F.col("doc").alias("sheet"), F.col("name").alias("tag"), F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+").alias("classes")).distinct()
    parts = r.withColumn("tag", F.regexp_extract("selector", r"^([^.]*)", 1)).withColumn("cls", F.regexp_extract("selector", r"\.(.*)$", 1))
    by_tag = parts.where("tag <> ''").join(els, ["sheet", "tag"]).where("cls = '' or array_contains(classes, cls)")
    by_class = parts.where("tag = ''").join(els.select("sheet", F.explode("classes").alias("cls")).distinct(), ["sheet", "cls"])
    cols = [c for c in r.columns]
    return by_tag.select(*cols).unionByName(by_class.select(*cols)).distinct()


def split_by_bytes(css: Column, limit: int) -> Column:
    """Sheets of at most ``limit`` bytes: rules in order, statements and blocks with rules inside each as a whole, a longer one alone."""
    found = F.regexp_extract_all(css, F.lit(r"@[^;{}]*;\s*|[^{}]+\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}\s*"), F.lit(0))
    fold = F.aggregate(found, F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.octet_length(F.element_at(acc, -1)) + F.octet_length(x) <= limit), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), x)))).otherwise(F.concat(acc, F.array(x))))
    return F.when(F.octet_length(css) <= limit, F.array(css)).otherwise(fold)
