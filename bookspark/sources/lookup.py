"""Answers of a book catalogue as a Spark data source: replayed from files, or asked over the network where that is allowed.

One reader asks one request after another with a gap between them, so a query
makes a single partition whatever the size of the cluster; books are matched
against the answers in Spark.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: least gap between requests in seconds, limits of a search, largest cover in bytes, time limits in seconds
GAP, LEAST, MOST, USUAL, COVER_BYTES, TIMEOUT = 1.1, 1, 50, 5, 16 * 1024 * 1024, 20.0
AGENT = "bookspark (catalogue lookup)"


@dataclass
class Limiter:
    """Waits until the gap since the last request is over."""

    gap: float = GAP
    clock: object = time.monotonic
    sleep: object = time.sleep
    last: float | None = field(default=None)

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.gap:
            self.sleep(self.gap - (now - self.last))
        self.last = self.clock()


def search_path(title: str | None = None, author: str | None = None, isbn: str | None = None, limit: int = USUAL) -> str:
    """The path of a search: by ISBN alone if there is one, else by what is known; the limit is kept within bounds."""
    pairs = [("isbn", isbn)] if isbn else [(k, v) for k, v in (("title", title), ("author", author)) if v]
    if not pairs:
        raise ValueError("nothing to search for")
    return "search.json?" + "&".join(f"{k}={quote_plus(v)}" for k, v in [*pairs, ("limit", str(min(MOST, max(LEAST, limit))))])


def fetch(url: str, limiter: Limiter, most: int = COVER_BYTES) -> bytes:
    """The body of an answer; one more try where the server asks for patience; a longer body is an error."""
    for attempt in (0, 1):
        limiter.wait()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=TIMEOUT) as r:
                body = r.read(most + 1)
                if len(body) > most:
                    raise ValueError(f"more than {most} bytes")
                return body
        except urllib.error.HTTPError as e:
            if e.code != 429 or attempt:
                raise
    raise AssertionError


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options.get("paths", "[]"))
        self.replay = options.get("replay")
        self.base = options.get("base")
        if not self.replay and not (self.base and options.get("allow_network", "false") == "true"):
            raise ValueError("give a folder to replay, or a base address and allow_network")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        limiter = Limiter()
        for p in self.paths:
            try:
                if self.replay:
                    f = Path(self.replay) / (quote_plus(p) + ".json")
                    body = f.read_text(encoding="utf-8") if f.exists() else None
                    yield p, body, None if body is not None else "no such answer"
                else:
                    yield p, fetch(self.base.rstrip("/") + "/" + p, limiter).decode("utf-8", "replace"), None
            except (OSError, ValueError) as e:
                yield p, None, str(e)


class Catalogue(DataSource):
    """Rows (path, body, error) of the answers to ``paths``, a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "book_catalogue"

    def schema(self) -> str:
        return "path string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def answers(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    spark.dataSource.register(Catalogue)
    return spark.read.format("book_catalogue").options(paths=json.dumps(paths), **options).load()
