"""Problem 5: items above a size limit come out as ordered pieces below it.

Prefix sums of the block sizes give a sorted array of boundaries; a binary
search finds the last boundary under the limit, the next piece steps back by
the overlap, and a block that alone is too large is cut inside: after a
sentence, else after a word, else between two characters. These places are
sorted arrays too, so a block is read once and each piece is a few searches.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECES = "chapter_id bigint, piece int, n_pieces int, start_byte bigint, end_byte bigint, n_bytes int, inside_block boolean, overlap string, body_html string"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TOKEN = re.compile(rb"</?[A-Za-z][^<>]*>|&(?:#\w{1,8}|\w{1,31});|[^<&]+|.", re.S)
_BLANKS = re.compile(rb"[ \n]+")
_NAME = re.compile(rb"</?([A-Za-z][\w:-]*)")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_SENTENCE = re.compile(rb"[.!?][\"')\]]*(?:\xe2\x80[\x99\x9d])*\s")
_ID = re.compile(rb"\s+id\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def reading_text(fragment: str) -> str:
    """The text a reader sees, without tags and with references resolved."""
    return html.unescape(_TAG.sub("", fragment))


def _tail(text: str, n_bytes: int) -> str:
    """The longest end of text within n_bytes of UTF-8."""
    if n_bytes <= 0:
        return ""
    raw = text.encode()
    cut = max(0, len(raw) - n_bytes)
    while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
        cut += 1
    return raw[cut:].decode()


class _Open:
    """A start tag with those around it; the stack of open tags is a chain of these."""

    __slots__ = ("closing", "name", "outer", "tag")

    def __init__(self, tag: bytes, name: bytes, outer: _Open | None) -> None:
        self.tag, self.name, self.outer = tag, name, outer
        #: Bytes that end tags for this and all around it take.
        self.closing = len(name) + 3 + (outer.closing if outer else 0)

    def chain(self) -> list[_Open]:
        out, o = [], self
        while o is not None:
            out.append(o)
            o = o.outer
        return out


class _Block:
    """Where one block may be cut, read once: sentence ends, word ends, and what must not be divided, each as a sorted array."""

    def __init__(self, raw: bytes, lo: int, hi: int) -> None:
        self.raw = raw
        self.sentences: list[int] = []
        self.words: list[int] = []
        #: Spans of tags and references, and the open tags from each place on.
        self.solid_from: list[int] = []
        self.solid_to: list[int] = []
        self.open_from: list[int] = [lo]
        self.open_tags: list[_Open | None] = [None]
        top: _Open | None = None
        names: dict[bytes, int] = {}
        at, comments = lo, True
        while at < hi:
            end = -1
            if comments and raw.startswith(b"<!--", at):
                end = raw.find(b"-->", at, hi) + 3
                comments = end > 2
            m = None if end > 2 else _TOKEN.match(raw, at, hi)
            end = end if m is None else m.end()
            solid = m is None or (raw[at] in b"<&" and end - at > 1)
            if not solid:
                self.sentences += [x.end() for x in _SENTENCE.finditer(raw, at, end)]
                self.words += [x.end() for x in _BLANKS.finditer(raw, at, end)]
            else:
                self.solid_from.append(at)
                self.solid_to.append(end)
                if m is not None and raw[at] == 60 and (n := _NAME.match(raw, at, end)):
                    top = self._next(top, raw[at:end], n[1].lower(), n[1], names)
                    self.open_from.append(end)
                    self.open_tags.append(top)
            at = end

    @staticmethod
    def _next(top: _Open | None, tag: bytes, key: bytes, name: bytes, names: dict[bytes, int]) -> _Open | None:
        if tag[1:2] == b"/":
            while names.get(key) and top is not None:
                names[top.name.lower()] -= 1
                done, top = top.name.lower() == key, top.outer
                if done:
                    break
        elif key.decode("latin-1") not in VOID and not tag.endswith(b"/>"):
            names[key] = names.get(key, 0) + 1
            top = _Open(tag, name, top)
        return top

    def open_at(self, at: int) -> _Open | None:
        return self.open_tags[bisect_right(self.open_from, at) - 1]

    def _last(self, places: list[int], room_end: int) -> int:
        """The last of the places from which the open tags can still be closed before room_end."""
        limit = room_end
        while (k := bisect_right(places, limit) - 1) >= 0:
            o = self.open_at(places[k])
            if places[k] + (o.closing if o else 0) <= room_end:
                return places[k]
            limit = min(places[k] - 1, room_end - o.closing)
        return -1

    def _between_characters(self, start: int, room_end: int) -> int:
        """The last place of any kind; a tag or reference is not divided, nor is a character."""
        at = room_end
        while at > start:
            k = bisect_right(self.solid_from, at) - 1
            if k >= 0 and self.solid_from[k] < at < self.solid_to[k]:
                at = self.solid_from[k]
                continue
            while at > start and at < len(self.raw) and self.raw[at] & 0xC0 == 0x80:
                at -= 1
            o = self.open_at(at)
            closing = o.closing if o else 0
            if at + closing <= room_end:
                break
            at = min(at - 1, room_end - closing)
        return at

    def cut(self, start: int, room_end: int) -> int:
        """Where to cut: sentence ends are preferred, then white space, in the second half of the room; then any character; a tag or reference is divided only if it alone exceeds the room."""
        half = start + (room_end - start) // 2
        for places in (self.sentences, self.words):
            if (at := self._last(places, room_end)) > half:
                return at
        if (at := self._between_characters(start, room_end)) > start:
            return at
        at = room_end
        while at > start + 1 and self.raw[at] & 0xC0 == 0x80:
            at -= 1
        return at


def plan_pieces(body: str, sizes: list[int] | None, limit: int, overlap: int) -> list[dict]:
    """Pieces of one body: byte spans that tile it, and the HTML of each with its overlap and repaired tags.

    Each block is read once, however many pieces it gives. The overlap is the
    longest end of what came before within ``overlap`` bytes; where its escaped
    form with the tags to open again would leave less than a sixteenth of the
    limit for new text, the tags are left out, then the overlap is shortened to
    what fits. An overlap that is not below the limit is an error.
    """
    if overlap >= limit:
        raise ValueError(f"overlap of {overlap} bytes in pieces of {limit}")
    raw = body.encode()
    n = len(raw)
    bounds = list(accumulate(int(x or 0) for x in sizes)) if sizes is not None and len(sizes) else []
    if not bounds or bounds[-1] != n or any(x >= n or raw[x] & 0xC0 == 0x80 for x in bounds[:-1]):
        bounds = [n]
    least = max(4, limit // 16)
    pieces: list[dict] = []
    start, said, reopened, inside = 0, "", b"", False
    block: _Block | None = None
    block_at = -1
    while start < n:
        again = _tail(said, overlap) if start else ""
        head = _headed(again)
        if len(head) + len(reopened) > limit - least:
            reopened = b""
        while len(head) > limit - least:
            again = _tail(again, len(again.encode()) - max(1, len(head) - (limit - least)))
            head = _headed(again)
        head += reopened
        room = start + limit - len(head)
        tail, stack = b"", None
        if n <= room:
            end, cut_inside = n, False
        else:
            k = bisect_right(bounds, room) - 1
            if k >= 0 and bounds[k] > start:
                end, cut_inside = bounds[k], False
            else:
                j = bisect_right(bounds, start)
                first = bounds[j - 1] if j else 0
                if block is None or block_at != first:
                    block, block_at = _Block(raw, first, bounds[j]), first
                end, cut_inside = block.cut(start, room), True
                stack = block.open_at(end)
                if stack is not None and end - start + len(head) + stack.closing > limit:
                    stack = None
                tail = b"".join(b"</" + o.name + b">" for o in stack.chain()) if stack else b""
        core = raw[start:end]
        pieces.append({"start_byte": start, "end_byte": end, "n_bytes": len(head) + len(core) + len(tail), "inside_block": inside or cut_inside, "overlap": again, "body_html": (head + core + tail).decode()})
        said = said[-4 * max(overlap, 1):] + reading_text(core.decode())
        reopened = b"".join(_ID.sub(b"", o.tag) for o in reversed(stack.chain())) if stack else b""
        start, inside = end, cut_inside
    return pieces


def _headed(again: str) -> bytes:
    return f'<p class="overlap">{html.escape(again, quote=False)}</p>\n'.encode() if again.strip() else b""


def oversized(chapters: DataFrame, profiles: DataFrame) -> DataFrame:
    """Distinct chapters above the limit of their profile, with limit and overlap.

    ``profiles`` is a fixed, tiny table (7 rows), hence the broadcast; null
    profiles, unknown profiles, limits that are null and null bodies never
    match. The size test runs on the JVM before any Python.
    """
    p = profiles.select("name", (F.col("max_chapter_kb").cast("long") * 1024).alias("limit_bytes"), F.coalesce("overlap_bytes", F.lit(0)).alias("overlap_bytes")).where("limit_bytes > 0").groupBy("name").agg(F.min("limit_bytes").alias("limit_bytes"), F.max("overlap_bytes").alias("overlap_bytes"))
    p = p.withColumn("limit_bytes", F.when(F.col("overlap_bytes") >= F.col("limit_bytes"), F.raise_error(F.concat(F.lit("the overlap is not below the limit of profile "), "name"))).otherwise(F.col("limit_bytes")))
    return (
        chapters.select("chapter_id", "profile", "body_html", "nodes")
        .join(F.broadcast(p), F.col("profile") == F.col("name"))
        .where(F.octet_length("body_html") > F.col("limit_bytes"))
        .select("chapter_id", "limit_bytes", "overlap_bytes", "body_html", F.expr("transform(nodes, x -> x.n_bytes)").alias("sizes"))
    )


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for cid, limit, overlap, body, sizes in pdf.itertuples(index=False):
            parts = plan_pieces(body, sizes, int(limit), int(overlap))
            rows += [{"chapter_id": cid, "piece": i, "n_pieces": len(parts), **p} for i, p in enumerate(parts)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])


def split_oversized(chapters: DataFrame, profiles: DataFrame, unique: bool = True) -> DataFrame:
    """One row per piece of every oversized chapter.

    Defined results: null body, profile or limit gives no row; a repeated row
    gives its pieces once (``unique=False`` leaves that to the caller, and is
    then a map without a shuffle); ``nodes`` that are null or do not add up
    leave one block; the spans of the pieces tile the body exactly; no piece
    is above the limit. A profile whose overlap is not below its limit ends
    the query with an error.
    """
    big = oversized(chapters, profiles)
    return (big.dropDuplicates(["chapter_id"]) if unique else big).mapInPandas(_split, PIECES)


def found(chapters: DataFrame, profiles: DataFrame) -> DataFrame:
    """Chapters that the operator had to cut, each once."""
    return split_oversized(chapters, profiles, unique=False).where("n_pieces > 1").select("chapter_id").distinct()


def tiles(chapters: DataFrame, profiles: DataFrame) -> DataFrame:
    """(chapter_id, n_bytes, first, too_long, gaps): what the pieces of each oversized chapter add up to; they begin at 0, none is above its limit, none begins elsewhere than where the one before ends."""
    p = split_oversized(chapters, profiles)
    limit = oversized(chapters, profiles).select("chapter_id", "limit_bytes").distinct()
    before = F.lag("end_byte").over(Window.partitionBy("chapter_id").orderBy("piece"))
    j = p.select("chapter_id", "piece", "start_byte", "end_byte", "n_bytes").withColumn("gap", (F.coalesce(before, F.lit(0)) != F.col("start_byte")).cast("int")).join(limit, "chapter_id")
    return j.groupBy("chapter_id").agg(F.sum(F.col("end_byte") - F.col("start_byte")).alias("n_bytes"), F.min("start_byte").alias("first"), F.count_if(F.col("n_bytes") > F.col("limit_bytes")).alias("too_long"), F.sum("gap").alias("gaps"))
