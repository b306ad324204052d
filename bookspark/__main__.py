"""Commands: check, fit, show and profiles over a folder of books."""

from __future__ import annotations

import argparse
import json
import sys

from bookspark import engine
from bookspark.session import build_session
from bookspark.sources import profiles


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bookspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "show", "fit"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("--recursive", action="store_true")
        if name != "show":
            c.add_argument("--profile", action="append", default=[])
        if name == "fit":
            c.add_argument("--out", required=True)
            c.add_argument("--quality", type=int)
            c.add_argument("--chapter-kb", type=int)
    sub.add_parser("profiles")
    return p


def main(argv: list[str] | None = None) -> int:
    """Exit 2 where a book can't be read, 1 where one has errors, else 0."""
    a = parser().parse_args(argv)
    spark = build_session("bookspark")
    if a.command == "profiles":
        for r in profiles.catalogue(spark).orderBy("ord").toLocalIterator():
            print(r.name, r.width or "-", r.height or "-", r.panel, r.chapter_kb)
        return 0
    b = engine.read_books(spark, a.folder, a.recursive)
    if a.command == "show":
        for r in engine.show_metadata(b).orderBy("book_id").toLocalIterator():
            print(json.dumps({"schema": 1, "book": r.book_id, "metadata": json.loads(r.document), "missing": r.missing, "cover": r.cover, "fitted": r.fitted}, ensure_ascii=False))
        return 0
    o = profiles.compose(a.profile, quality=getattr(a, "quality", None), chapter_kb=getattr(a, "chapter_kb", None))
    if a.command == "check":
        from bookspark.operators import lint

        found = engine.check(b, o.caps if a.profile else None).cache()
        for r in lint.report(found).toLocalIterator():
            print(r.book_id, r.severity, r.code, r.message, r.path or "")
        codes = lint.exit_codes(found, b.metadata, b.errors)
        return max((r[0] for r in codes.groupBy("exit_code").count().select("exit_code").toLocalIterator()), default=0)
    out = engine.fit_tables(b, o, stamp=f"{o.appendix} 1")
    out.archives.write.mode("overwrite").parquet(a.out)
    failed = out.failures.select("book_id", "code", "message").unionByName(b.errors)
    n = 0
    for r in engine.failures_json(failed).toLocalIterator():
        print(r.report, file=sys.stderr)
        n += 1
    return 1 if n else 0


if __name__ == "__main__":
    sys.exit(main())
