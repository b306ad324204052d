"""Queries of the training-data operators, by the names the driver calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bookspark.llm import contamination, encodings, lookalikes, markup, matching, names, packing, splitting, truncation
from bookspark.session import table as t

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: matching.found(t(s, d, "metadata"), t(s, d, "candidates")),
        "p1_matches": lambda s, d: matching.match(t(s, d, "metadata"), t(s, d, "candidates")),
        "p1_reliability": lambda s, d: matching.reliability(t(s, d, "metadata"), t(s, d, "candidates")),
        "p2_found": lambda s, d: lookalikes.found(t(s, d, "metadata"), t(s, d, "creators"), t(s, d, "chapters"), t(s, d, "warnings")),
        "p2_canonical": lambda s, d: lookalikes.canonical_values(t(s, d, "metadata"), t(s, d, "creators"), t(s, d, "chapters")),
        "p3_found": lambda s, d: encodings.found(t(s, d, "metadata"), t(s, d, "warnings")),
        "p3_restored": lambda s, d: encodings.restore(t(s, d, "metadata"), t(s, d, "warnings")),
        "p4_found": lambda s, d: markup.found(t(s, d, "metadata"), t(s, d, "works"), t(s, d, "chapters")),
        "p4_clean": lambda s, d: markup.convert(t(s, d, "metadata"), t(s, d, "works"), t(s, d, "chapters")),
        "p4_values": lambda s, d: markup.coverage(t(s, d, "metadata"), t(s, d, "works"), t(s, d, "chapters")),
        "p4_templates": lambda s, d: markup.templates(markup.values(t(s, d, "metadata"), t(s, d, "works"), t(s, d, "chapters"))),
        "p5_found": lambda s, d: splitting.found(t(s, d, "chapters"), t(s, d, "profiles")),
        "p5_pieces": lambda s, d: splitting.split_oversized(t(s, d, "chapters"), t(s, d, "profiles")),
        "p5_tiles": lambda s, d: splitting.tiles(t(s, d, "chapters"), t(s, d, "profiles")),
        "p6_found": lambda s, d: names.found(t(s, d, "creators"), t(s, d, "candidates")),
        "p6_people": lambda s, d: names.link(t(s, d, "creators"), t(s, d, "candidates")),
        "p6_spellings": lambda s, d: names.coverage(t(s, d, "creators"), t(s, d, "candidates")),
        "p7_bins": lambda s, d: packing.fill(t(s, d, "documents"), t(s, d, "containers")),
        "p7_report": lambda s, d: packing.fill_report(t(s, d, "documents"), t(s, d, "containers")),
        "p7_placed": lambda s, d: packing.coverage(t(s, d, "documents"), t(s, d, "containers")),
        "p8_found": lambda s, d: contamination.found(t(s, d, "documents"), t(s, d, "benchmark")),
        "p8_items": lambda s, d: contamination.items_leaked(t(s, d, "documents"), t(s, d, "benchmark")),
        "p9_found": lambda s, d: truncation.found(t(s, d, "documents")),
        "p9_sources": lambda s, d: truncation.source_report(t(s, d, "documents")),
        "p9_judged": lambda s, d: truncation.coverage(t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can tell what must come out: cases that are defined by sizes, and that no value is lost on the way."""
    return {
        "p4_values": "SELECT 'metadata' AS tbl, count(description) AS n_values FROM metadata UNION ALL SELECT 'works', count(description) FROM works UNION ALL SELECT 'chapters', count(body_html) FROM chapters",
        "p5_found": "SELECT DISTINCT c.chapter_id FROM chapters c JOIN profiles p ON c.profile = p.name WHERE strlen(c.body_html) > 1024 * p.max_chapter_kb",
        "p5_tiles": "SELECT DISTINCT c.chapter_id, strlen(c.body_html)::BIGINT AS n_bytes, 0::BIGINT AS first, 0::BIGINT AS too_long, 0::BIGINT AS gaps FROM chapters c JOIN profiles p ON c.profile = p.name WHERE strlen(c.body_html) > 1024 * p.max_chapter_kb",
        "p6_spellings": "WITH typed AS (SELECT name AS n FROM creators UNION SELECT unnest(author_name) FROM candidates), filed AS (SELECT DISTINCT file_as AS n FROM creators WHERE file_as NOT IN (SELECT n FROM typed WHERE n IS NOT NULL)) SELECT 'typed' AS origin, count(*) AS n_spellings, count(*) AS n_linked FROM typed WHERE trim(n) <> '' UNION ALL SELECT 'filed', count(*), count(*) FROM filed WHERE trim(n) <> ''",
        "p7_placed": "SELECT container, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS n_docs, 0::BIGINT AS gaps, 0::BIGINT AS overfull FROM containers WHERE capacity_tokens > 0",
        "p9_judged": r"SELECT source, count(DISTINCT doc_id) AS n_docs FROM documents WHERE text IS NOT NULL AND trim(text, ' ' || chr(10) || chr(13) || chr(9)) <> '' GROUP BY source",
    }
