"""Problem 7: texts of varying length in containers of fixed capacity.

Items go in falling order of size into the tightest compatible bin: open bins
are ordered by residual, and each carries bitmaps of the sources and clusters
of copies that it can take no more of. The search goes on past bins in
conflict, however well they fit, until it finds the tightest that is not. A
bin takes as many texts of a source or cluster as an even spread over the
least number of bins asks for, mostly one copy; only where keeping to that
would open bins beyond this number does the share of the group rise. A text is
divided only if it alone exceeds the capacity.

Shards are packed apart from each other. Their number follows from the row
count, so that each is one bounded group; every shard leaves at most a few
bins that are not full.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.session import ship_file, shipped, tokenizer_path

#: The split of the public byte-level tokenizer of 50,256 ranks, a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Rows that are packed as one group.
SHARD_ROWS = 20_000
PLACED = "container string, capacity int, doc_id bigint, piece int, bin string, start_token int, end_token int, n_tokens int, room_left int"
SIZED = "doc_id bigint, source string, n_tokens int, copy bigint"


@lru_cache(None)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(shipped(name))
        for pdf in batches:
            pdf["n_tokens"] = [len(enc.encode_ordinary(t)) for t in pdf["text"]]
            yield pdf[["doc_id", "source", "n_tokens", "copy"]]

    return run


def sizes(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Tokens of every document by the public tokenizer, and a hash that copies share.

    Null texts give no row, empty ones none either as they need no room.
    """
    name = ship_file(documents.sparkSession, vocabulary or tokenizer_path(VOCABULARY))
    docs = documents.where("text <> ''").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text", F.xxhash64("text").alias("copy"))
    return docs.mapInPandas(_count(name), SIZED)


class Bins:
    """Open bins ordered by residual, each with a bitmap of the groups (sources, clusters of copies) it can take no more of.

    A group may stand in a bin up to its quota. A bitmap of the residuals in
    use finds the next larger one in one step; groups that hold much of the
    items have such an order of their own, of the bins that can take them, so
    that a search never walks past a crowd of bins that are all in conflict.
    """

    def __init__(self, capacity: int, bound: int, members: dict[int, int]) -> None:
        self.capacity, self.bound = capacity, bound
        #: The least even share: with it every group fits into as many bins as all items need.
        self.quota = {g: -(-n // max(1, bound)) for g, n in members.items()}
        total = sum(members.values())
        self.hot = {g: n for g, n in members.items() if n * HOT_PART >= total and n > 1}
        self.room: list[int] = []
        self.held: list[dict[int, int]] = []
        self.full: list[int] = []
        self.by_room: dict[int | None, list[dict[int, None]]] = {g: [{} for _ in range(capacity + 1)] for g in (None, *self.hot)}
        self.used: dict[int | None, int] = dict.fromkeys(self.by_room, 0)

    def _enter(self, key: int | None, b: int) -> None:
        self.by_room[key][self.room[b]][b] = None
        self.used[key] |= 1 << self.room[b]

    def _leave(self, key: int | None, b: int) -> None:
        here = self.by_room[key][self.room[b]]
        here.pop(b, None)
        if not here:
            self.used[key] &= ~(1 << self.room[b])

    def _tightest(self, size: int, groups: tuple[int, ...]) -> int | None:
        """The open bin with the least room for the item that none of its groups has filled."""
        mask = sum(1 << g for g in groups)
        key = max((g for g in groups if g in self.hot), key=lambda g: (self.hot[g], g), default=None)
        rooms, used, at = self.by_room[key], self.used[key], size
        while above := used >> at:
            at += (above & -above).bit_length() - 1
            for b in rooms[at]:
                if not self.full[b] & mask:
                    return b
            at += 1
        return None

    def place(self, size: int, groups: tuple[int, ...] = ()) -> int:
        """The bin that takes the item: the tightest compatible one, else a new one.

        Where the bins are already as many as all items need, and one has room,
        the conflict can't be kept without waste: the quota of the group in the
        way rises by one.
        """
        while True:
            b = self._tightest(size, groups)
            if b is not None:
                return self._put(b, size, groups)
            if len(self.room) < self.bound or not self.used[None] >> size:
                break
            self._raise(size, groups)
        self.room.append(self.capacity)
        self.held.append({})
        self.full.append(0)
        return self._put(len(self.room) - 1, size, groups)

    def _raise(self, size: int, groups: tuple[int, ...]) -> None:
        stuck = [g for g in groups if self._tightest(size, tuple(x for x in groups if x != g)) is not None] or list(groups)
        for g in stuck[:1] if len(stuck) < len(groups) else stuck:
            self.quota[g] += 1
            for b, held in enumerate(self.held):
                if self.full[b] >> g & 1 and held[g] < self.quota[g]:
                    self.full[b] &= ~(1 << g)
                    if g in self.hot and self.room[b]:
                        self._enter(g, b)

    def _put(self, b: int, size: int, groups: tuple[int, ...]) -> int:
        open_to = [g for g in self.hot if not self.full[b] >> g & 1]
        if self.room[b] < self.capacity:
            for key in (None, *open_to):
                self._leave(key, b)
        self.room[b] -= size
        for g in groups:
            self.held[b][g] = self.held[b].get(g, 0) + 1
            if self.held[b][g] >= self.quota[g]:
                self.full[b] |= 1 << g
        if self.room[b] > 0:
            for key in (None, *open_to):
                if key is None or not self.full[b] >> key & 1:
                    self._enter(key, b)
        return b


#: A group of one part in so many of the items has an order of bins of its own.
HOT_PART = 32


def pack(items: list[tuple[int, int, str, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(item, piece, bin, start, end, room left) for items (id, tokens, source, copy).

    Pieces of a divided text fill bins of their own but for the last, which is
    an item like any other. Ties go by id, so the result does not depend on
    the order of the rows.
    """
    out, rest, whole_bins = [], [], 0
    for doc, n, source, copy in sorted(items):
        whole = n // capacity
        for k in range(whole):
            out.append((doc, k, whole_bins, k * capacity, (k + 1) * capacity))
            whole_bins += 1
        if n % capacity:
            rest.append((n % capacity, doc, whole, ("s", source), ("c", copy)))
    counts = Counter(g for r in rest for g in r[3:])
    number = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n > 1))}
    bins = Bins(capacity, -(-sum(r[0] for r in rest) // capacity), {i: counts[g] for g, i in number.items()})
    for size, doc, piece, source, copy in sorted(rest, key=lambda r: (-r[0], r[1], r[2])):
        b = bins.place(size, tuple(number[g] for g in (source, copy) if g in number))
        out.append((doc, piece, whole_bins + b, piece * capacity, piece * capacity + size))
    return [(doc, piece, b, a, z, bins.room[b - whole_bins] if b >= whole_bins else 0) for doc, piece, b, a, z in out]


def _pack_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    container, capacity, shard = key
    items = list(zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist(), pdf["source"].tolist(), pdf["copy"].tolist(), strict=True))
    rows = [(container, capacity, doc, piece, f"{container}-{shard}-{b}", a, z, z - a, left) for doc, piece, b, a, z, left in pack(items, int(capacity))]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PLACED.split(", ")])


def fill(documents: DataFrame, containers: DataFrame, vocabulary: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every document, for each container kind, with its bin; one row per piece.

    ``containers`` is a fixed, tiny table (3 rows). Repeated rows of a document
    are packed as often as they occur; containers without a positive capacity
    take nothing. Copies of a text share a shard only by chance, which spreads
    a cluster of any size.
    """
    kinds = [(r[0], int(r[1])) for r in containers.where("capacity_tokens > 0").select("container", "capacity_tokens").distinct().orderBy("container").toLocalIterator()]
    shards = max(1, -(-documents.select(F.count("doc_id")).first()[0] // shard_rows))
    sized = sizes(documents, vocabulary).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    kind = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).alias("capacity")) for c, n in kinds]) if kinds else F.expr("cast(array() as array<struct<container:string,capacity:int>>)")
    return sized.select("doc_id", "n_tokens", "source", "copy", "shard", F.inline(kind)).groupBy("container", "capacity", "shard").applyInPandas(_pack_group, PLACED)


def fill_report(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container kind: bins, the least number that the tokens need, the share of room that stays unused, and the most texts of one source in a bin."""
    placed = fill(documents, containers)
    source = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source")).dropDuplicates(["doc_id"])
    most = placed.join(source, "doc_id").groupBy("container", "bin", "source").agg(F.count("*").alias("n")).groupBy("container").agg(F.max("n").alias("most_of_a_source"))
    out = placed.groupBy("container", "capacity").agg(F.count_distinct("bin").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"))
    out = out.withColumn("least_bins", F.ceil(F.col("n_tokens") / F.col("capacity"))).withColumn("unused", F.round(1 - F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")), 6))
    return out.join(most, "container")


def coverage(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, n_docs, overfull, gaps): texts that are placed, bins above their capacity, and texts whose pieces don't follow each other from their start."""
    placed = fill(documents, containers)
    bins = placed.groupBy("container", "bin").agg(F.sum("n_tokens").alias("n"), F.first("capacity").alias("capacity")).groupBy("container").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))
    docs = placed.groupBy("container", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max("end_token").alias("last"), F.min("start_token").alias("first"))
    return docs.groupBy("container").agg(F.count("*").alias("n_docs"), F.count_if((F.col("n") != F.col("last")) | (F.col("first") != 0)).alias("gaps")).join(bins, "container")
