"""Problem 3: text that was decoded with the wrong encoding.

Every chain of a wrong and a right encoding that fits is undone word by word;
each resulting text is compressed with one zstandard dictionary per language,
and the chain with the least description length, its own cost included, wins.
Where no chain beats the text as it stands, the text is left alone. A text with
replacement characters has no description as a proper text: it comes from a
lossy decoding that nothing can undo.

Which characters, neighbours and words are usual is counted over all sentences of
each language in the data, so that only texts with something unusual are compressed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import inf, log

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.session import checkpointed

REPAIRS = "tbl string, row_key string, field string, text string, restored string, chain string, saved_bytes int, complete boolean"
#: Sentences below which a language is learned together with the others that have so few.
LEAST = 40
#: Of the levels this one tells short texts apart best; the higher ones parse them worse.
LEVEL = 3
#: Share of a language's sentences below which a character is rare.
RARE = 0.003
#: Shares of a language's sentences from which a pair of neighbours is usual, and from which a word is in the dictionary.
USUAL, WORD = 1 / 800, 1 / 5000
#: Counts that a task holds before it hands them on.
HELD = 200_000
#: Bytes that a step of a chain costs in the description. UTF-8 rarely fits by chance, a one-byte encoding always does.
STEP_COST = {"utf-8": 1}
OTHER_COST = 3

# fixed values: (encoding that was used, encoding that was right)
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    (("cp1252", "utf-8"),), (("cp1250", "utf-8"),), (("cp1251", "utf-8"),), (("cp437", "utf-8"),), (("cp850", "utf-8"),), (("mac_roman", "utf-8"),), (("koi8_r", "utf-8"),), (("cp866", "utf-8"),), (("iso8859_2", "utf-8"),), (("cp1254", "utf-8"),), (("iso8859_15", "utf-8"),),
    (("cp1252", "utf-8"), ("cp1252", "utf-8")), (("cp1251", "utf-8"), ("cp1251", "utf-8")), (("cp1252", "utf-8"), ("cp1251", "utf-8")), (("cp1252", "utf-8"), ("cp1252", "utf-8"), ("cp1252", "utf-8")),
    (("cp437", "cp1252"),), (("cp850", "cp1252"),), (("mac_roman", "cp1252"),), (("cp1251", "cp1252"),), (("cp1250", "cp1252"),), (("cp1252", "cp437"),), (("cp1252", "mac_roman"),), (("cp1252", "cp850"),),
    (("cp1252", "cp1251"),), (("koi8_r", "cp1251"),), (("cp866", "cp1251"),), (("mac_roman", "cp1251"),), (("cp1251", "koi8_r"),), (("cp1252", "koi8_r"),), (("cp1251", "cp866"),), (("cp1252", "cp866"),),
)


@lru_cache(None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte; bytes that the encoding leaves undefined stand for the control characters of the same number."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


@lru_cache(None)
def _chars_of(encoding: str) -> list[str]:
    out = [""] * 256
    for c, b in _bytes_of(encoding).items():
        if not out[b] or ord(c) > 0x9F:
            out[b] = c
    return out


def _undo(token: str, wrong: str, right: str) -> str | None:
    """The token decoded again, or None if it cannot have come about this way."""
    table = _bytes_of(wrong)
    try:
        raw = bytes(table[c] for c in token)
    except KeyError:
        return None
    if right == "utf-8":
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return None
    chars = _chars_of(right)
    return "".join(chars[b] for b in raw)


_TOKEN = re.compile(r"[^ ]*[^\x00-\x7F][^ ]*")
#: A stretch of foreign characters with nothing else in it; tried where a token as a whole does not fit.
_PART = re.compile(r"[^\x00-\x7F]+")


@lru_cache(1 << 17)
def _redecoded(token: str, wrong: str, right: str) -> str:
    """The token decoded again as a whole, or else its foreign stretches that can be."""
    whole = _undo(token, wrong, right)
    if whole is not None:
        return whole
    return _PART.sub(lambda p: p[0] if (x := _undo(p[0], wrong, right)) is None else x, token)


#: A word with its neighbours, as the compressors know it.
_PHRASE = re.compile(r"(?:[^ ]+ )?[^ ]*[^\x00-\x7F][^ ]*(?: [^ ]+)?")


def apply_chain(text: str, chain: tuple[tuple[str, str], ...], odd: Callable[[str], bool] | None = None) -> str:
    """The text with every word that the chain fits decoded again, or every odd one."""
    for wrong, right in chain:
        def one(m: re.Match, wrong: str = wrong, right: str = right) -> str:
            if odd is not None and not odd(m[0]):
                return m[0]
            return _redecoded(m[0], wrong, right)

        text = _TOKEN.sub(one, text)
    return text


#: Letters of two scripts in one word.
_MIXED = re.compile("[A-Za-zÀ-ɏ][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-zÀ-ɏ]|[Ͱ-Ͽ][Ѐ-ӿ]|[Ѐ-ӿ][Ͱ-Ͽ]")
LOST = "�"


def neighbours(text: str) -> set[str]:
    """Pairs of neighbours of which one is no ASCII character. ASCII letters and digits stand for their kind, capitals for small letters but behind one."""
    t = f" {text} ".translate(_KINDS)
    return {_folded(t[i:i + 2]) for m in _PART.finditer(t) for i in range(m.start() - 1, m.end())}


@lru_cache(1 << 16)
def _folded(pair: str) -> str:
    return pair if pair[0].islower() and pair[1].isupper() else pair.lower()


_KINDS = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}, "\n": " ", "\t": " "})


class Model:
    """One compressor per language, with the characters and neighbours that are usual in any. Description length is the least over the languages."""

    def __init__(self, dictionaries: list[bytes]) -> None:
        self.coders = []
        self.usual: set[str] = set()
        self.neighbours: set[str] = set()
        for d in dictionaries:
            z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(d), source_size=200, write_content_size=False, write_checksum=False, write_dict_id=False)
            z.precompute_compress(compression_params=p)
            self.coders.append(zstandard.ZstdCompressor(dict_data=z, compression_params=p))
            texts = d.decode().split("\n")
            self.usual |= {c for t in texts for c in t if ord(c) > 127}
            self.neighbours.update(n for t in texts for n in neighbours(t))
        self.judged = bool(self.neighbours)
        if not self.coders:
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))

    def length(self, text: str) -> int:
        """Bytes that describe the text: the least of the compressors, of capitals also as small letters with a byte to say so, and one for each pair of neighbours that is not usual."""
        forms = (text, text.lower(), text.capitalize()) if text.isupper() else (text,)
        return self.unusual(text) + min(len(c.compress(f.encode("utf-8", "surrogatepass"))) + (k > 0) for k, f in enumerate(forms) for c in self.coders)

    def unusual(self, text: str) -> int:
        """Pairs of neighbours that are not usual in any language."""
        return len(neighbours(text) - self.neighbours) if self.judged else 0

    def odd(self, text: str) -> bool:
        return self.unusual(text) > 0

    def candidates(self, text: str, strict: bool = True) -> dict[str, tuple]:
        """What each chain makes of the text. UTF-8 rarely fits by chance, so its results need only be printable; a one-byte encoding always fits, so its results hold usual characters, words of one script and, of neighbours, at least three usual for one unusual."""
        tried: dict[str, tuple] = {}
        own, mixed = neighbours(text), len(_MIXED.findall(text))
        before = len(own - self.neighbours)
        for chain in CHAINS:
            utf8 = chain[0][1] == "utf-8"
            for odd in (None,) if utf8 or not strict else (None, self.odd):
                new = apply_chain(text, chain, odd)
                if new == text or new in tried and len(tried[new]) <= len(chain):
                    continue
                fresh = set(new) - set(text)
                if utf8 or not self.judged:
                    fits = all(c.isprintable() or c == "\u00a0" for c in fresh) and len(_MIXED.findall(new)) <= mixed
                else:
                    fits = all(c.lower() in self.usual or c.upper() in self.usual for c in fresh if ord(c) > 127) and not _MIXED.search(new)
                    if fits and strict:
                        now = neighbours(new)
                        fits = len(now - self.neighbours) < before and 3 * len(now - own - self.neighbours) <= len(own - now - self.neighbours)
                if fits:
                    tried[new] = chain
        return tried

    def repair(self, text: str) -> tuple[str, str, int] | None:
        """(restored, chain, bytes saved) of the best chain, or None if the text is best as it stands.

        No proper text holds a replacement character, so one with it has no
        finite description as it stands; where no chain undoes a part, the
        lossy one is named and the text stays.
        """
        if text.isascii() or self.judged and not self.odd(text):
            return None
        tried = self.candidates(text)
        lost = LOST in text
        if not tried and not lost:
            return None
        base = self.length(text)
        if tried:
            # the reading of look-alike characters as plain ones needs no wrong encoding
            from bookspark.llm import lookalikes

            plain = lookalikes.canonical(text)
            base = base if plain == text else min(base, self.length(plain) + 1)
        cost, new, chain = min(((self.length(n) + sum(STEP_COST.get(right, OTHER_COST) for _, right in c), n, c) for n, c in tried.items()), default=(base, text, ()))
        if cost < base:
            return new, " > ".join(f"{w}:{r}" for w, r in chain), base - cost
        return (text, "replacement characters", base - self.length(text.replace(LOST, ""))) if lost else None


_MODELS: dict[tuple, Model] = {}


def model(dictionaries: list[bytes]) -> Model:
    key = tuple(map(hash, dictionaries))
    if key not in _MODELS:
        _MODELS[key] = Model(dictionaries)
    return _MODELS[key]


def dictionaries_from(samples: dict[str, list[str]]) -> list[bytes]:
    """A dictionary per language: its distinct sentences but those with a character that is rare in the language."""
    out = []
    for _, texts in sorted(samples.items()):
        texts = [" ".join(t.split()) for t in texts if t]
        seen = Counter(c for t in texts for c in set(t) if ord(c) > 127)
        rare = {c for c, n in seen.items() if n < RARE * len(texts)}
        joined = "\n".join(dict.fromkeys(t for t in texts if t and not rare & set(t))).encode("utf-8", "ignore")
        if joined:
            out.append(joined)
    return out


def fit(metadata: DataFrame, warnings: DataFrame | None = None, records: DataFrame | None = None) -> list[bytes]:
    """Dictionaries of the languages, messages and catalogue records, from every title, sentence of a description and message.

    Two passes count in tasks and shuffle only sums: the first how many
    sentences of a language have each character and pair of neighbours, the
    second the same without damage and rare characters, and the words, those of
    plain ASCII sentences included. A dictionary holds every word of some share
    of the sentences and for each usual pair the commonest word with it, so its
    size depends on the alphabet and the shares and not on the rows.
    """
    texts = sentences(metadata, warnings, records)
    foreign = texts.where(F.col("text").rlike(FOREIGN))
    size = texts.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.lit("n").alias("kind"), F.lit("").alias("item"), "n")
    of = _sums(foreign.mapInPandas(_tally(None), TALLY).unionByName(size).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    total = {k: n[""] for k, n in of["n"].items()}
    few = {k for k, n in total.items() if n < LEAST}
    count = Counter()
    for sums in of["pair"].values():
        count.update(sums)
    rare = {k: {c for c, n in sums.items() if n < RARE * total[k]} for k, sums in of["char"].items()}
    usual = {c for k, sums in of["char"].items() for c in sums if c not in rare[k]}
    lang = F.when(F.col("lang").isin(sorted(few)), "").otherwise(F.col("lang")) if few else F.col("lang")
    plain = texts.where(~F.col("text").rlike(FOREIGN)).select("lang", F.lit("word").alias("kind"), F.explode(F.array_distinct(F.split("text", r"[\s\x1C-\x1F]+"))).alias("item"), F.lit(1).cast("bigint").alias("n")).where("item <> ''")
    second = checkpointed(foreign.mapInPandas(_tally((rare, usual, count)), TALLY).unionByName(plain).groupBy(lang.alias("lang"), "kind", "item").agg(F.sum("n").alias("n")))
    of = _sums(second.where("kind <> 'word'"))
    kept: Counter = Counter()
    for k, n in total.items():
        kept["" if k in few else k] += n
    kept.subtract({k: n[""] for k, n in of["lost"].items()})
    odd = {k: {c for c, n in of["char"].get(k, {}).items() if n < RARE * kept[k]} for k in kept}
    pairs = {k: {p for p, n in of["pair"].get(k, {}).items() if n >= USUAL * kept[k]} for k in kept}
    words = second.where("kind = 'word'").mapInPandas(_usual(pairs, odd, {k: WORD * n for k, n in kept.items()}), "lang string, item string, n bigint, pair string")
    top = words.groupBy("lang", "pair").agg(F.max(F.struct("n", F.col("item"))).alias("w")).select("lang", "w.n", "w.item")
    often = words.where("pair = ''").select("lang", "n", "item")
    chosen: dict[str, list[tuple[int, str]]] = {}
    for k, n, word in top.unionByName(often).distinct().toLocalIterator():
        chosen.setdefault(k, []).append((n, word))
    return [" ".join(w for _, w in sorted(chosen[k])).encode("utf-8", "ignore") for k in sorted(chosen)]


FOREIGN = r"[^\x00-\x7F]"
TALLY = "lang string, kind string, item string, n bigint"


#: A letter that is not Latin.
OTHER_SCRIPT = r"[\p{L}&&[^\p{IsLatin}]]"


def sentences(metadata: DataFrame, warnings: DataFrame | None, records: DataFrame | None = None) -> DataFrame:
    """(lang, text) of every title, every sentence of a description, and every message that is not plain ASCII. Records name no language: their titles count by script, lest one be rare beside another.

    Markup and brackets stay, as the values are judged with them. A text with a
    lost or a control character is sure damage and teaches nothing.
    """
    short = F.coalesce(F.substring(F.lower(F.trim("language")), 1, 2), F.lit(""))
    parts = F.concat(F.array("title"), F.coalesce(F.split("description", r"(?<=[.!?])\s+"), F.array().cast("array<string>")))
    texts = metadata.select(short.alias("lang"), F.explode(parts).alias("text"))
    if warnings is not None:
        texts = texts.unionByName(warnings.where(F.col("message").rlike(FOREIGN)).select(F.lit("messages").alias("lang"), F.col("message").alias("text")))
    if records is not None:
        texts = texts.unionByName(records.select(F.when(F.col("title").rlike(OTHER_SCRIPT), "records, other scripts").otherwise("records").alias("lang"), F.col("title").alias("text")))
    return texts.where("text is not null").where(~F.col("text").rlike(r"[\x{FFFD}\x80-\x9F]"))


def _sums(counts: DataFrame) -> dict[str, dict[str, dict[str, int]]]:
    """kind, language, item: count; as many items as the alphabets allow."""
    out: dict[str, dict[str, dict[str, int]]] = {"n": {}, "char": {}, "pair": {}, "lost": {}}
    for lang, kind, item, n in counts.toLocalIterator():
        out[kind].setdefault(lang, {})[item] = n
    return out


def _tally(known: tuple | None):
    """Sentences of each language with each character and pair; where it is known what is rare and usual, of sound sentences alone, and with their words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rare, usual, count = known or ({}, set(), Counter())
        damaged = damage(usual, count)
        held: Counter = Counter()

        def frame() -> pd.DataFrame:
            return pd.DataFrame([(*k, n) for k, n in held.items()], columns=["lang", "kind", "item", "n"])

        for pdf in batches:
            for lang, text in pdf.itertuples(index=False):
                text = " ".join(text.split())
                joined = " ".join(_TOKEN.findall(text))
                chars = {c for c in joined if ord(c) > 127}
                if known and (not chars.isdisjoint(rare.get(lang, ())) or damaged(joined)):
                    held[lang, "lost", ""] += 1
                    continue
                held.update((lang, "char", c) for c in chars)
                held.update((lang, "pair", p) for p in neighbours(joined))
                if known:
                    held.update((lang, "word", w) for w in {*_PHRASE.findall(text), *filter(str.isascii, text.split())})
            if len(held) > HELD:
                yield frame()
                held.clear()
        yield frame()

    return run


def _usual(pairs: dict[str, set[str]], odd: dict[str, set[str]], least: dict[str, float]):
    """Words of usual characters and neighbours, once by themselves if there are so many and once for each of their pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for lang, word, n in pdf[["lang", "item", "n"]].itertuples(index=False):
                if (own := neighbours(word)) <= pairs[lang] and odd[lang].isdisjoint(word):
                    rows += [(lang, word, n, p) for p in (*own, *[""] * (n >= least[lang]))]
            yield pd.DataFrame(rows, columns=["lang", "item", "n", "pair"])

    return run


def damage(usual: set[str], count: Counter) -> Callable[[str], bool]:
    """Whether a text is likely damage: a chain turns its neighbours into ones that are commoner by the counts, with a bonus for UTF-8, which rarely fits by chance."""
    m = Model([])
    m.usual, m.judged = usual, True

    def common(pairs: set[str]) -> float:
        return sum(log(1 + count[p]) for p in pairs) / len(pairs) if pairs else inf

    @lru_cache(1 << 16)
    def damaged(text: str) -> bool:
        own = neighbours(text)
        return any((n := neighbours(c)) != own and common(n - own) + (chain[0][1] == "utf-8") > common(own - n) for c, chain in m.candidates(text, strict=False).items())

    return damaged


def weeded(samples: dict[str, list[str]]) -> dict[str, list[str]]:
    """The samples without what is likely damage."""
    damaged = damage(Model(dictionaries_from(samples)).usual, Counter(n for texts in samples.values() for t in texts for n in neighbours(t)))
    return {k: [t for t in texts if t.isascii() or not damaged(t)] for k, texts in samples.items()}


def _look(dictionaries: list[bytes]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(dictionaries)
        for pdf in batches:
            rows = []
            for tbl, key, field, text in pdf.itertuples(index=False):
                if got := m.repair(text):
                    rows.append((tbl, key, field, text, *got, LOST not in got[0]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPAIRS.split(", ")])

    return run


def values(metadata: DataFrame, warnings: DataFrame) -> DataFrame:
    """The fields in question in long form, without nulls and plain ASCII."""
    parts = [
        metadata.select(F.lit("metadata").alias("tbl"), F.col("book_id").alias("row_key"), F.lit("title").alias("field"), F.col("title").alias("text")),
        metadata.select(F.lit("metadata").alias("tbl"), F.col("book_id").alias("row_key"), F.lit("description").alias("field"), F.col("description").alias("text")),
        warnings.select(F.lit("warnings").alias("tbl"), F.col("warning_id").cast("string").alias("row_key"), F.lit("message").alias("field"), F.col("message").alias("text")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.where(F.col("text").rlike(FOREIGN))


def restore(metadata: DataFrame, warnings: DataFrame, dictionaries: list[bytes] | None = None) -> DataFrame:
    """Every wrongly decoded value with its restored form, the chain and the bytes saved.

    A map without a shuffle. ``complete`` is false where replacement characters
    remain. Defined results: nulls, empty and ASCII texts give no row; repeated
    rows give repeated rows; texts that no chain improves are left out.
    """
    models = fit(metadata, warnings) if dictionaries is None else dictionaries
    return values(metadata, warnings).mapInPandas(_look(models), REPAIRS)


def found(metadata: DataFrame, warnings: DataFrame) -> DataFrame:
    return restore(metadata, warnings).select("tbl", "row_key", "field").distinct()
