"""Problem 8: evaluation texts that leak into the corpus.

One Aho-Corasick automaton holds every run of five normalised words of the
test items. Each document is scanned once; hits name places in items, hits of
one item are chained along the word alignment, and a chain counts if it covers
the whole item or at least 20 of its consecutive words with at most twelve
in a hundred altered. Offsets are mapped back to the text as stored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

LEAKS = "doc_id bigint, item_id bigint, start bigint, end bigint, item_words int, matched_words int, similarity double"
SEED, RUN, SIMILAR, GAP = 5, 20, 0.88, 2
#: A run of five words that more items share than this is a stock phrase and proves nothing alone, unless the item has hardly any other.
SHARED = 2
#: Items in one automaton; larger test sets are scanned in blocks of this many.
BLOCK = 20_000

_WORD = re.compile(r"[^\W_]+")
_UNSEEN = re.compile("[­​-‍⁠﻿]")


def words_of(text: str) -> list[str]:
    """Lower-case words without accents, marks and invisible characters."""
    if text.isascii():
        return _WORD.findall(text.lower())
    text = unicodedata.normalize("NFKD", _UNSEEN.sub("", text))
    return _WORD.findall("".join(c for c in text if not unicodedata.combining(c)).casefold() if not text.isascii() else text.lower())


def word_spans(text: str) -> list[tuple[int, int]]:
    """For each word of words_of(text) its place in the text as stored."""
    chars, at = [], []
    for i, c in enumerate(text):
        for d in unicodedata.normalize("NFKD", _UNSEEN.sub("", c)):
            if not unicodedata.combining(d):
                for e in d.casefold():
                    chars.append(e)
                    at.append(i)
    return [(at[m.start()], at[m.end() - 1] + 1) for m in _WORD.finditer("".join(chars))]


class Index:
    """The automaton of a block of items. Built once in each Python worker."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.words = {i: words_of(t) for i, t in items if t}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.words.items():
            n = min(SEED, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                places[f" {' '.join(w[k:k + n])} "].append((i, k))
        telling: dict[int, set[int]] = defaultdict(set)
        for where in places.values():
            for i, k in where if len(where) <= SHARED else ():
                telling[i].update(range(k, k + SEED))
        #: Items that consist of shared runs: all of their runs count.
        self.stock = {i for i, w in self.words.items() if len(telling[i]) < min(RUN, len(w))}
        self.auto = ahocorasick.Automaton()
        for key, where in places.items():
            self.auto.add_word(key, (len(key), tuple(where)))
        if places:
            self.auto.make_automaton()
        self.empty = not places

    def leaks(self, text: str) -> list[tuple]:
        """(item, first word, last word + 1, item words covered, words equal, similarity) of each leaked item."""
        if self.empty or not text:
            return []
        words = words_of(text)
        joined = f" {' '.join(words)} "
        hits: dict[int, list[tuple[int, int, bool]]] = defaultdict(list)
        begins: list[int] | None = None
        for end, (size, where) in self.auto.iter(joined):
            if begins is None:
                begins, at = [], 1
                for w in words:
                    begins.append(at)
                    at += len(w) + 1
            k = bisect_left(begins, end - size + 2)
            for item, j in where:
                hits[item].append((k, j, len(where) <= SHARED or item in self.stock))
        out = []
        for item, places in hits.items():
            target = self.words[item]
            need = min(RUN, len(target))
            best = None
            for lo, hi in self._windows(places, len(target), len(words), need):
                got = self._align(target, words[lo:hi], need)
                if got and (best is None or got[:2] > best[1][:2]):
                    best = (lo, got)
            if best:
                lo, (span, equal, d0, d1, sim) = best
                out.append((item, lo + d0, lo + d1, span, equal, sim))
        return out

    @staticmethod
    def _windows(places: list[tuple[int, int, bool]], n_item: int, n_doc: int, need: int) -> list[tuple[int, int]]:
        """Stretches of the document where hits of the item lie on neighbouring diagonals and can cover the need."""
        groups: list[list[tuple[int, int, bool]]] = []
        for k, j, own in sorted(places, key=lambda p: (p[0] - p[1], p[0])):
            if groups and k - j - (groups[-1][-1][0] - groups[-1][-1][1]) <= 3:
                groups[-1].append((k, j, own))
            else:
                groups.append([(k, j, own)])
        out = []
        for g in groups:
            covered = {j + s for _, j, own in g if own for s in range(SEED)}
            if len(covered) < max(1, min(n_item, need // 2)):
                continue
            lo = max(0, min(k - j for k, j, _ in g) - 3)
            hi = min(n_doc, max(k - j for k, j, _ in g) + n_item + 3)
            if hi - lo <= 3 * n_item + 12:
                out.append((lo, hi))
            else:  # the item is quoted more than once on drifting diagonals: a window for each
                out += [(max(0, d - 3), min(n_doc, d + n_item + 3)) for d in sorted({k - j for k, j, _ in g})]
        return out

    @staticmethod
    def _align(item: list[str], part: list[str], need: int) -> tuple | None:
        """The longest run of item words that the part holds apart from altered single words."""
        blocks = [b for b in SequenceMatcher(None, item, part, autojunk=False).get_matching_blocks() if b.size]
        best = None
        for first in range(len(blocks)):
            a0, d0, equal = blocks[first].a, blocks[first].b, 0
            prev_a = prev_d = None
            for b in blocks[first:]:
                if prev_a is not None and max(b.a - prev_a, b.b - prev_d) > GAP:
                    break
                prev_a, prev_d, equal = b.a + b.size, b.b + b.size, equal + b.size
                span, length = prev_a - a0, max(prev_a - a0, prev_d - d0)
                # an altered first or last word of the item still belongs to it
                whole = min(a0, 1) + min(len(item) - prev_a, 1) if span + 2 >= len(item) else 0
                if span + whole >= need and equal >= SIMILAR * length and (best is None or (span, equal) > best[:2]):
                    best = (span, equal, d0, prev_d, equal / length)
        return best


_BUILT: dict[int, Index] = {}


def _scan(items: list[tuple[int, str]]):
    key = hash(tuple(items))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _BUILT:
            _BUILT.clear()  # one block at a time
            _BUILT[key] = Index(items)
        index = _BUILT[key]
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                got = index.leaks(text) if isinstance(text, str) else []
                spans = word_spans(text) if got else []
                rows += [(doc, i, spans[a][0], spans[b - 1][1], n, same, sim) for i, a, b, n, same, sim in got]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEAKS.split(", ")])

    return run


def find_leaks(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every document with the items it leaks, each pair once, with offsets in the text as stored.

    The test set is a stated query set of bounded size (240 rows here); it is
    read on the driver in blocks of at most ``block`` items, and all documents
    are scanned once for each block, without a shuffle. Null or empty texts on
    either side match nothing; repeated items with one id count once.
    """
    rows = benchmark.select("item_id", "text").where("text is not null and item_id is not null").dropDuplicates().orderBy("item_id", "text").toLocalIterator()
    docs = documents.select("doc_id", "text").where("text is not null")
    out, part = None, []
    seen: set[int] = set()

    def add(out: DataFrame | None, part: list[tuple[int, str]]) -> DataFrame:
        one = docs.mapInPandas(_scan(part), LEAKS)
        return one if out is None else out.unionByName(one)

    for item, text in rows:
        if item in seen:
            continue
        seen.add(item)
        part.append((item, text))
        if len(part) == block:
            out, part = add(out, part), []
    return add(out, part) if part or out is None else out


def found(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(documents, benchmark).select("doc_id", "item_id").distinct()


def items_leaked(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per leaked test item: in how many documents, and the longest run."""
    from pyspark.sql import functions as F

    return find_leaks(documents, benchmark).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("item_words").alias("longest_run"))
