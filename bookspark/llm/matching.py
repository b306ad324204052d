"""Problem 1: books and catalogue records that describe one work, without a common key.

The q-grams of a title are encoded as a vector of 512 bits. Multi-index
Hamming hashing finds every pair of vectors within a radius: of eleven blocks
at least three are equal then, and of any three blocks two lie in the same
half, so that pairs of blocks within a half serve as exact keys. The digits of
an ISBN are a vector too, one bit a digit, whose index finds every pair with at
most one digit changed.

Pairs that are close by either are compared field by field: Dice scores of
title and authors, agreement of volume, ISBN, year and publisher, each in a few
levels. How often a level occurs among pairs of one work and among others is
estimated from the counts of all patterns by expectation maximisation, so the
weight of a level is its log likelihood ratio, their sum is the log odds, and
its logistic is the confidence. Pairs that only a changed digit of an ISBN
brought together are counted and estimated by themselves, as all of them have
that level.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.llm import encodings, names
from bookspark.session import checkpointed

BITS, BLOCKS, RADIUS = 512, 11, 8
#: Blocks whose pairs are keys: within each half any two.
_HALVES = (range(0, 5), range(5, BLOCKS))
KEY_BLOCKS = tuple(p for half in _HALVES for p in combinations(half, 2))
#: Share of all titles from which a word is part of a pattern and no help, and least count of titles for that.
COMMON_SHARE, COMMON_LEAST = 0.015, 40
#: Pairs of one key that one task compares at a time.
PART_PAIRS = 2_000_000
#: Pairs of rows of two titles that one part compares.
HOT_PAIRS = 100_000

# fixed values: articles, generic subtitles, marks of volumes
_ARTICLES = frozenset("the a an der die das ein eine el la los las un una le les l une il lo gli o os as".split())
_SUBTITLE = re.compile(r"\s*(?:[:/;]|\s[-–—])\s*(?:an? )?(?:novel|memoir|handbook|romance|history|story|tale|guide|biography|reader|anthology|stories|poems|essays|roman|erzahlung|novela|recit|letters(?:,? \d{2,4})?|notes from [^\d:/]+|\d{1,2}(?:st|nd|rd|th) edition|revised edition|illustrated)\s*\.?\s*$", re.I)
_VOLUME = re.compile(r"[\s,.:;(\[/–—-]*(?:(?:\b(?:volume|vol|book|bk|band|bd|tome|tomo|teil|part|pt|том|книга)\b\.?\s*|#\s*|\bno\.?\s*|№\s*)(\d{1,3}|[ivxlc]{1,6})|(?<=[\s,.:])(?:-\s+)(\d{1,2})|(?<=\s)([IVX]{1,5}))\s*[)\]]?\s*\.?\s*$", re.I)
_ROMAN_END = re.compile(r"\s([IVX]{1,5})\s*\.?\s*$")
#: A lost character counts as a letter.
_TOKEN = re.compile(r"(?:[^\W_]|�)+")
_DIGRAPH = re.compile("([aou])e")
_ISBN = re.compile(r"[0-9][0-9Xx\s‐-―-]{8,16}[0-9Xx]")
_YEAR = re.compile(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)")

SIDE = "id string, tokens array<string>, volume int, people array<string>, isbns array<string>, doubtful array<string>, year int, publisher string"
SCORED = "book_id string, ref string, title_score double, author_score double, isbn_score double, year_score double, publisher_score double, levels array<int>, direct boolean"
PAIR = ("title_score", "author_score", "isbn_score", "year_score", "publisher_score", "score", "score_without_isbn", "confidence")


def roman(text: str) -> int:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = 0
    for a, b in zip(text, [*text[1:], ""], strict=True):
        total += -values[a] if b and values[b] > values[a] else values[a]
    return total


def title_parts(title: str | None) -> tuple[list[str], int | None]:
    """(words of the title proper, number of the volume): without generic subtitle, volume mark and article."""
    if not title:
        return [], None
    text = re.sub(r"\s+", " ", names.fold(title)).strip()
    raw = re.sub(r"\s+", " ", encodings_free(title)).strip()
    volume = None
    for _ in range(3):
        before = text
        if volume is None and (m := _VOLUME.search(text)) and m.start() > 0 and (m[1] or m[2] or _ROMAN_END.search(raw)):
            found = m[1] or m[2] or m[3]
            if not m[3] or _ROMAN_END.search(raw):
                volume = int(found) if found.isdigit() else roman(found.lower())
                text, raw = text[: m.start()], raw[: max(0, len(raw) - len(before) + m.start())]
        if m := _SUBTITLE.search(text):
            text, raw = text[: m.start()], raw[: max(0, len(raw) - len(text) + m.start())]
        if text == before:
            break
    words = [w for w in _TOKEN.findall(text.replace("&", " and ")) if w.strip("�")]
    while len(words) > 1 and words[0] in _ARTICLES:
        words = words[1:]
    if len(words) > 1 and words[-1] in _ARTICLES and re.search(r",\s*\w+\.?\s*$", text):
        words = words[:-1]
    return words, volume


def encodings_free(title: str) -> str:
    """The title in its consistent script, with its capitals."""
    return names.lookalikes.canonical(title)


def isbn_core(text: str) -> str | None:
    """Nine digits that ISBN-10 and ISBN-13 of one book share, without prefix and check digit."""
    m = _ISBN.search(text or "")
    digits = re.sub(r"[^0-9Xx]", "", m[0]) if m else ""
    if len(digits) == 13 and digits[:3] in ("978", "979"):
        return digits[3:12]
    return digits[:9] if len(digits) == 10 else None


def isbn_holds(text: str) -> bool:
    """Whether the check digit is right."""
    digits = re.sub(r"[^0-9Xx]", "", (_ISBN.search(text or "") or [""])[0]).upper()
    if len(digits) == 10:
        return sum((10 - k) * (10 if c == "X" else int(c)) for k, c in enumerate(digits) if c != "X" or k == 9) % 11 == 0
    return digits.isdigit() and sum(int(c) * (3 if k % 2 else 1) for k, c in enumerate(digits)) % 10 == 0


def publisher_key(text: str | None) -> str | None:
    """The first telling word of a publisher's name."""
    words = [w for w in _TOKEN.findall(names.fold(text or "")) if w not in names.AFFIXES]
    return words[0] if words else None


def _fits(damaged: str, word: str) -> bool:
    """Whether the word is the damaged one with up to two letters for each lost character."""
    return re.fullmatch(re.escape(damaged).replace("�", ".{0,2}"), word) is not None


def vector(tokens: list[str], common: frozenset[str]) -> list[int]:
    """Places of the bits that the bigrams of the telling words set; a number sets several of its own."""
    kept = [t for t in tokens if t not in common and not ("�" in t and any(_fits(t, c) for c in common))] or tokens
    bits = set()
    for t in kept:
        if t.isdigit():
            grams = [f"#{k}{t}" for k in range(5)]
        else:
            p = f"_{t}_"
            grams = [g for i in range(len(p) - 1) if "�" not in (g := p[i:i + 2])]
        bits.update(zlib.crc32(g.encode()) % BITS for g in grams)
    return sorted(bits)


_OF_BLOCK = [i * BLOCKS // BITS for i in range(BITS)]


def keys_of(bits: list[int]) -> list[int]:
    """A hash for each pair of blocks: equal if both blocks are. An empty pair of blocks gives a key as well."""
    blocks: list[list[int]] = [[] for _ in range(BLOCKS)]
    for b in bits:
        blocks[_OF_BLOCK[b]].append(b)
    return [zlib.crc32(repr((i, j, blocks[i], blocks[j])).encode()) | (k << 32) for k, (i, j) in enumerate(KEY_BLOCKS)]


def _sides(dictionaries: list[bytes]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = encodings.model(dictionaries)
        for pdf in batches:
            rows = []
            for key, title, people, ids, date, publisher, index in pdf.itertuples(index=False):
                if title and not title.isascii() and (got := m.repair(title)):
                    title = got[0]
                tokens, volume = title_parts(title)
                if volume is None and index and (x := re.fullmatch(r"\s*(\d{1,3})(?:\.0*)?\s*", index)):
                    volume = int(x[1])
                elif volume is None and index and re.fullmatch(r"(?i)\s*[ivx]{1,5}\s*", index):
                    volume = roman(index.strip().lower())
                year = _YEAR.search(date or "")
                isbns = sorted({c for i in (ids if ids is not None else []) if i and (c := isbn_core(i))})
                doubtful = sorted({c for i in (ids if ids is not None else []) if i and (c := isbn_core(i)) and not isbn_holds(i)})
                rows.append((key, tokens, volume, [p for p in (people if people is not None else []) if p and p.strip()], isbns, doubtful, int(year[1]) if year else None, publisher_key(publisher)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SIDE.split(", ")])
            yield out.astype({"volume": "Int32", "year": "Int32"})

    return run


def books(metadata: DataFrame, dictionaries: list[bytes]) -> DataFrame:
    """The comparable attributes of each book, each combination once."""
    rows = metadata.select("book_id", "title", F.expr("transform(authors, a -> a.name)").alias("people"), F.expr("transform(identifiers, i -> i.value)").alias("ids"), "date", "publisher", F.col("series.index").alias("ix")).where("book_id is not null").distinct()
    return rows.mapInPandas(_sides(dictionaries), SIDE)


def records(candidates: DataFrame, dictionaries: list[bytes]) -> DataFrame:
    """The comparable attributes of each catalogue record, each combination once."""
    rows = candidates.select("ref", "title", F.col("author_name").alias("people"), F.col("isbn").alias("ids"), F.col("first_publish_year").cast("string").alias("date"), F.expr("try_element_at(publisher, 1)").alias("publisher"), F.lit(None).cast("string").alias("ix")).where("ref is not null").distinct()
    return rows.mapInPandas(_sides(dictionaries), SIDE)


def common_words(left: DataFrame, right: DataFrame) -> frozenset[str]:
    """Words of title patterns. A word in a share s of titles is one of at most (words of a title) / s, so the list is short."""
    titles = left.select("tokens").unionByName(right.select("tokens")).where("size(tokens) > 0").distinct()
    n = titles.count()
    words = titles.select(F.explode(F.array_distinct("tokens")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= max(COMMON_LEAST, COMMON_SHARE * n))
    return frozenset(r[0] for r in words.toLocalIterator())


def _codes(common: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for (tokens,) in pdf[["tokens"]].itertuples(index=False):
                bits = vector(list(tokens), common)
                words = [0] * (BITS // 64)
                for b in bits:
                    words[b // 64] |= 1 << b % 64
                rows.append((tokens, [w - (1 << 64) if w >> 63 else w for w in words], keys_of(bits)))
            yield pd.DataFrame(rows, columns=["tokens", "vector", "keys"])

    return run


def close_titles(left: DataFrame, right: DataFrame, common: frozenset[str]) -> DataFrame:
    """(tokens of a book title, tokens of a record title) of every pair of distinct titles whose vectors are within the radius.

    Only a number and the vector of each title travel with its keys. Short
    titles have a smaller radius: half the bits that each sets.
    """
    code = "tokens array<string>, vector array<bigint>, keys array<bigint>"
    distance = " + ".join(f"bit_count(l_vector[{i}] ^ r_vector[{i}])" for i in range(BITS // 64))

    def coded(df: DataFrame) -> DataFrame:
        return df.select("tokens").where("size(tokens) > 0").distinct().mapInPandas(_codes(common), code)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode("keys").alias("key"), F.xxhash64("tokens").alias(f"{name}_code"), F.col("vector").alias(f"{name}_vector"))

    a, b = keyed(checkpointed(coded(left)), "l"), keyed(checkpointed(coded(right)), "r")
    # a key with many titles on both sides is cut into parts: each left title in one, the right ones in all
    size = a.groupBy("key").agg(F.count("*").alias("nl")).join(b.groupBy("key").agg(F.count("*").alias("nr")), "key")
    hot = size.where(F.col("nl") * F.col("nr") > PART_PAIRS).select("key", F.ceil(F.col("nl") * F.col("nr") / PART_PAIRS).cast("int").alias("parts"))
    a = a.join(hot, "key", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("l_code", F.col("parts")).cast("int"))).drop("parts")
    b = b.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    weight = {n: " + ".join(f"bit_count({n}_vector[{i}])" for i in range(BITS // 64)) for n in "lr"}
    radius = f"least({RADIUS}, greatest(6, ({weight['l']} + {weight['r']}) div 4))"
    near_codes = a.join(b, ["key", "part"]).where(F.expr(f"{distance} <= {RADIUS}")).where(F.expr(f"{distance} <= {radius}")).select("l_code", "r_code").distinct()
    named = near_codes.join(left.select(F.col("tokens").alias("l_tokens")).distinct().withColumn("l_code", F.xxhash64("l_tokens")), "l_code")
    return named.join(right.select(F.col("tokens").alias("r_tokens")).distinct().withColumn("r_code", F.xxhash64("r_tokens")), "r_code").select("l_tokens", "r_tokens")


#: Digits of the core of an ISBN in four blocks; the index leaves out one at a time, so one changed digit leaves a key.
_ISBN_BLOCKS = ((1, 2), (3, 2), (5, 2), (7, 3))


def close_isbns(left: DataFrame, right: DataFrame) -> DataFrame:
    """(book_id, ref, equal) of every pair with ISBNs within Hamming distance two: equal, or with one digit changed if a check digit is wrong, as two valid numbers are two books."""

    def keyed(df: DataFrame, name: str, isbns: str) -> DataFrame:
        isbn = df.select(F.explode(isbns).alias(name)).distinct()
        keys = [F.concat(F.lit(f"{k}:"), *[F.substring(name, *b) for j, b in enumerate(_ISBN_BLOCKS) if j != k]) for k in range(len(_ISBN_BLOCKS))]
        return isbn.select(name, F.explode(F.array(*keys)).alias("key"))

    differ = " + ".join(f"cast(substring(a, {k}, 1) <> substring(b, {k}, 1) as int)" for k in range(1, 10))
    equal = left.select(F.explode("isbns").alias("a")).intersect(right.select(F.explode("isbns").alias("a"))).select("a", F.col("a").alias("b"))
    slips = keyed(left, "a", "doubtful").join(keyed(right, "b", "isbns"), "key").unionByName(keyed(left, "a", "isbns").join(keyed(right, "b", "doubtful"), "key"))
    close = equal.unionByName(slips.where(F.expr(f"{differ} <= 1")).select("a", "b")).distinct()
    of_book = left.select(F.explode("isbns").alias("a"), F.col("id").alias("book_id"))
    of_record = right.select(F.explode("isbns").alias("b"), F.col("id").alias("ref"))
    return close.join(of_book, "a").join(of_record, "b").select("book_id", "ref", (F.col("a") == F.col("b")).alias("equal"))


def word_match(x: str, y: str) -> float:
    """1 for the same word, nine tenths for one slip or two in a longer word, else 0."""
    if x == y or _DIGRAPH.sub(r"\1", x) == _DIGRAPH.sub(r"\1", y):
        return 1.0
    if min(len(x), len(y)) > 2 and names.slip(x, y):
        return 0.9
    for a, b in ((x, y), (y, x)):
        if "�" in a and _fits(a, b):
            return 0.9
    return 0.9 if min(len(x), len(y)) >= 6 and near(x, y) else 0.0


def title_score(a: list[str], b: list[str]) -> float:
    """Dice score of the words by length, slips of the keyboard allowed; other numbers are another title."""
    if not a or not b:
        return 0.0
    if {x for x in a if x.isdigit()} != {x for x in b if x.isdigit()}:
        return 0.0
    rest, total = list(b), 0.0
    for x in sorted(a, key=len, reverse=True):
        score, best = max(((word_match(x, y), y) for y in rest), default=(0.0, ""))
        if score:
            total += score * (len(x) + len(best))
            rest.remove(best)
    return total / (sum(map(len, a)) + sum(map(len, b)))


def near(a: str, b: str) -> bool:
    """At most two letters added, lost or changed, or pairs of neighbours swapped."""
    if abs(len(a) - len(b)) > 2:
        return False
    before: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > 2 and min(prev) > 2:
            return False
        before, prev = prev, row
    return prev[-1] <= 2


def person_score(a: tuple, b: tuple) -> float:
    """Agreement of two parsed names: the words of the one aligned with those of the other, whichever is the surname."""
    (org_a, _, x), (org_b, _, y) = a, b
    if bool(org_a) != bool(org_b) or not x or not y:
        return 0.0
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    rest, total, strong = list(long), 0.0, False
    for t in sorted(short, key=len, reverse=True):
        best, score = None, 0.0
        for u in rest:
            s = 1.0 if t == u else 0.9 if min(len(t), len(u)) >= 5 and (names.slip(t, u) or min(len(t), len(u)) >= 8 and near(t, u)) else names.given_match(t, u) or 0.7 * (min(len(t), len(u)) == 3 and names.slip(t, u))
            if s > score:
                best, score = u, s
        if best is None:
            return 0.0
        strong |= len(t) >= 4 and len(best) >= 4 and score >= 0.9
        total += score
        rest.remove(best)
    return total / len(short) if strong else 0.0


def author_score(a: list[tuple], b: list[tuple]) -> float | None:
    """Dice score of two lists of people, None if one is empty."""
    if not a or not b:
        return None
    rest, hits = list(b), 0
    for x in a:
        best = max(rest, key=lambda y: person_score(x, y), default=None)
        if best is not None and person_score(x, best) > 0:
            hits += 1
            rest.remove(best)
    return 2 * hits / (len(a) + len(b))


#: Fields with the chance of each level among pairs of one work and among others, from which the estimate starts. Level 0 of all but title is "not given".
#: title: Dice of 0.999, 0.9, 0.8, 0.6, less. authors: Dice of 0.8, 0.5, more than 0, 0. volume: equal, one given, two that differ.
#: ISBN: equal, a digit changed, others. year: within 1, 2, 3, 6, more. publisher: equal, another.
FIELDS = {
    "title": ((0.80, 0.15, 0.03, 0.015, 0.005), (0.3, 0.1, 0.05, 0.2, 0.35)),
    "author": ((0.08, 0.85, 0.05, 0.015, 0.005), (0.05, 0.2, 0.02, 0.03, 0.7)),
    "volume": ((0.85, 0.13, 0.02, 0.0001), (0.5, 0.05, 0.1, 0.35)),
    "isbn": ((0.80, 0.15, 0.045, 0.005), (0.8, 0.02, 0.02, 0.16)),
    "year": ((0.35, 0.55, 0.05, 0.03, 0.01, 0.01), (0.35, 0.1, 0.1, 0.05, 0.05, 0.35)),
    "publisher": ((0.55, 0.43, 0.02), (0.5, 0.05, 0.45)),
}
#: Pairs that the start is worth, steps of the estimate, and the volume level that by definition is another work.
PRIOR, STEPS, OTHER_VOLUME = 50.0, 60, 3


def levels_of(t: float, volumes: tuple, a: float | None, isbn: float | None, years: tuple, publishers: tuple) -> tuple[list[int], float, float]:
    """(level of each field, year score, publisher score)."""
    (va, vb), (ya, yb), (pa, pb) = volumes, years, publishers
    gap = None if ya is None or yb is None else abs(ya - yb)
    year = 0 if gap is None else 1 if gap <= 1 else 2 if gap == 2 else 3 if gap == 3 else 4 if gap <= 6 else 5
    publisher = 0 if not pa or not pb else 1 if pa == pb or len(pa) > 4 and names.slip(pa, pb) else 2
    return [
        0 if t >= 0.999 else 1 if t >= 0.9 else 2 if t >= 0.8 else 3 if t >= 0.6 else 4,
        0 if a is None else 1 if a >= 0.8 else 2 if a >= 0.5 else 3 if a > 0 else 4,
        0 if va is None and vb is None else 1 if va == vb else 2 if va is None or vb is None else OTHER_VOLUME,
        0 if isbn is None else 1 if isbn == 1 else 2 if isbn > 0 else 3,
        year, publisher,
    ], (0.0, 1.0, 0.5, 0.2, 0.0, 0.0)[year], float(publisher == 1)


def estimate(patterns: list[tuple[list[int], int]]) -> tuple[float, list[list[float]]]:
    """(log odds of all pairs, weight of each level of each field) from the count of every pattern of levels.

    Expectation maximisation of a mixture in which the fields agree
    independently of each other; pairs of different volumes belong to the
    others from the start. The start counts as ``PRIOR`` pairs, which keeps
    small tables sensible and matters nothing in large ones.
    """
    x = np.array([p for p, _ in patterns], dtype=int).reshape(len(patterns), len(FIELDS))
    n = np.array([c for _, c in patterns], dtype=float)
    m0, u0 = ([np.array(f[i]) / sum(f[i]) for f in FIELDS.values()] for i in (0, 1))
    m, u, share = m0, u0, 0.5
    never = x[:, 2] == OTHER_VOLUME
    for _ in range(STEPS if len(patterns) else 0):
        s = log(share / (1 - share)) + sum(np.log(m[k] / u[k])[x[:, k]] for k in range(len(FIELDS)))
        g = np.where(never, 0.0, 1 / (1 + np.exp(-np.clip(s, -50, 50)))) * n
        share = (g.sum() + PRIOR / 2) / (n.sum() + PRIOR)
        m = [(np.bincount(x[:, k], g, len(m0[k])) + PRIOR * m0[k]) / (g.sum() + PRIOR) for k in range(len(FIELDS))]
        u = [(np.bincount(x[:, k], n - g, len(u0[k])) + PRIOR * u0[k]) / ((n - g).sum() + PRIOR) for k in range(len(FIELDS))]
    weights = [np.log(m[k] / u[k]).tolist() for k in range(len(FIELDS))]
    weights[2][OTHER_VOLUME] = -30.0
    return log(share / (1 - share)), weights


def isbn_score(a: list[str], b: list[str]) -> float | None:
    """1 if they share an ISBN, a third if two are one slip apart, 0 if all differ, None if one is empty."""
    if not len(a) or not len(b):
        return None
    if set(a) & set(b):
        return 1.0
    return 1 / 3 if any(sum(x != y for x, y in zip(p, q, strict=True)) == 1 for p in a for q in b) else 0.0


def _score(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    cache: dict[str, tuple] = {}

    def parsed(xs: list[str]) -> list[tuple]:
        for x in xs:
            if x not in cache:
                cache[x] = names.parse(x)
        return [cache[x] for x in xs]

    none = lambda v: None if v is None or v != v else int(v)
    for r in pdf.itertuples(index=False):
        t = title_score(list(r.l_tokens), list(r.r_tokens))
        a = author_score(parsed(list(r.l_people)), parsed(list(r.r_people)))
        i = isbn_score(list(r.l_isbns), list(r.r_isbns))
        levels, y, p = levels_of(t, (none(r.l_volume), none(r.r_volume)), a, i, (none(r.l_year), none(r.r_year)), (r.l_publisher, r.r_publisher))
        rows.append((r.book_id, r.ref, t, a, i, y, p, levels, r.direct))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCORED.split(", ")])


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield _score(pdf)


def pairs(left: DataFrame, right: DataFrame, common: frozenset[str]) -> DataFrame:
    """(book_id, ref, direct) whose titles or ISBNs are close; direct but where only a changed digit brought them together.

    Titles that very many rows share are cut into parts: each book is in one,
    the records in all, so that every row is compared, however many there are.
    """
    close = checkpointed(close_titles(left, right, common))
    nl = left.groupBy(F.col("tokens").alias("l_tokens")).agg(F.count("*").alias("nl"))
    nr = right.groupBy(F.col("tokens").alias("r_tokens")).agg(F.count("*").alias("nr"))
    parts = F.ceil(F.col("nl") * F.col("nr") / HOT_PAIRS).cast("int")
    sized = close.join(nl, "l_tokens").join(nr, "r_tokens").select("l_tokens", "r_tokens", F.least(parts, F.col("nl").cast("int")).alias("parts"))
    split = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(right.select(F.col("tokens").alias("r_tokens"), F.col("id").alias("ref")), "r_tokens")
    books_of = sized.join(left.select(F.col("tokens").alias("l_tokens"), F.col("id").alias("book_id")), "l_tokens").withColumn("part", F.pmod(F.xxhash64("book_id"), F.col("parts")).cast("int"))
    near = books_of.join(split.drop("parts"), ["l_tokens", "r_tokens", "part"]).select("book_id", "ref")
    every = near.withColumn("equal", F.lit(True)).unionByName(close_isbns(left, right))
    return every.groupBy("book_id", "ref").agg(F.max("equal").alias("direct"))


def match(metadata: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every compared pair with the scores of its fields and the confidence that it is one work.

    Defined results: rows without title and ISBN match nothing; a missing
    field neither speaks for nor against; repeated rows count once; where a
    key has several versions, the best pair of versions counts.
    """
    dictionaries = encodings.fit(metadata, records=candidates)
    left, right = checkpointed(books(metadata, dictionaries)), checkpointed(records(candidates, dictionaries))
    common = common_words(left, right)
    p = pairs(left, right, common)
    cols = ("tokens", "volume", "people", "isbns", "year", "publisher")
    sides = [left.select(F.col("id").alias("book_id"), *[F.col(c).alias(f"l_{c}") for c in cols]), right.select(F.col("id").alias("ref"), *[F.col(c).alias(f"r_{c}") for c in cols])]
    scored = checkpointed(p.join(sides[0], "book_id").join(sides[1], "ref").mapInPandas(_scored, SCORED))
    # at most as many patterns as the levels allow, whatever the number of pairs
    patterns: dict[bool, list] = {True: [], False: []}
    for direct, levels, n in scored.groupBy("direct", "levels").agg(F.count("*").alias("n")).toLocalIterator():
        patterns[direct].append((list(levels), n))

    def scores(odds: float, weights: list[list[float]]) -> list:
        parts = [F.element_at(F.array(*[F.lit(w) for w in ws]), F.col("levels")[k] + 1) for k, ws in enumerate(weights)]
        return [sum(parts[1:], F.lit(odds) + parts[0]), parts[list(FIELDS).index("isbn")]]

    total, isbn = (F.when(F.col("direct"), a).otherwise(b) for a, b in zip(*(scores(*estimate(patterns[direct])) for direct in (True, False)), strict=True))
    out = scored.withColumn("score", total).withColumn("score_without_isbn", total - isbn).withColumn("confidence", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total)))))
    return out.groupBy("book_id", "ref").agg(F.max_by(F.struct(*PAIR), "score").alias("s")).select("book_id", "ref", "s.*")


#: Confidence from which a pair counts as one work.
SAME = 0.5


def found(metadata: DataFrame, candidates: DataFrame) -> DataFrame:
    return match(metadata, candidates).where(F.col("confidence") >= SAME).select("book_id", "ref")


def reliability(metadata: DataFrame, candidates: DataFrame) -> DataFrame:
    """How confidence agrees with a label: pairs of which both have an ISBN, by confidence without it, and the share that have one in common.

    ISBNs are mistyped or foreign at times, so the share stays below 1 for the
    surest pairs as well; it should rise with the confidence.
    """
    m = match(metadata, candidates).where("isbn_score is not null")
    plain = F.col("score_without_isbn")
    bins = F.floor(10 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), plain))))) / 10
    return m.groupBy(bins.alias("confidence_from")).agg(F.count("*").alias("n_pairs"), F.round(F.avg((F.col("isbn_score") == 1).cast("double")), 4).alias("same_isbn"))
