"""Problem 2: text that looks the same but differs in its characters.

Each letter has a resolved script set: its own script and those in which it
has a twin. The sets of a token are intersected; a token of several scripts,
or one that is wholly made of twins among words of another script, is spelt
in the consistent script. Full-width forms, ligatures, odd spaces, invisible
characters and decomposed accents are brought to their plain form.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.llm import encodings

FINDINGS = "tbl string, row_key string, field string, kinds array<string>"
FORMS = "tbl string, row_key string, field string, canonical string"

# fixed values: letters of a script and, one below the other, the Latin ones they look like
_CYRILLIC = ("аАВсСеЕһНіІјЈкКМоОрРѕЅТԛԝхХуУԁгЗьҮёЁѵѴӏӀԌԚԜ", "aABcCeEhHiIjJkKMoOpPsSTqwxXyYdr3bYëËvVlIGQW")
_GREEK = ("ΑαΒΕΖΗΙιΚκΜΝνΟοΡρΤΥυΧγϹϲϳ", "AaBEZHIiKkMNvOoPpTYuXyCcj")
_ARMENIAN = ("օհսոցզՍՏՕԼ", "ohungqUSOL")
_CHEROKEE = ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᎡᎥᏌ", "ABCDEHJKLMPRSTVWZRiU")
#: Letters of phonetic alphabets that look like plain ones.
_PHONETIC = ("ɑɡɩʏ", "agiY")
#: Twins that only look alike in some faces; they prove nothing alone.
_WEAK = frozenset("гЗьγαυιкёЁհսոցզՍՏԼӏӀᎥ")
#: Letters that a Latin one is never respelt as: they are rare in living languages.
_RARE = frozenset("ԛԝԁһѵѴӏӀԌԚԜϹϲϳ")

LATIN_OF = {"Cyrillic": dict(zip(*_CYRILLIC, strict=True)), "Greek": dict(zip(*_GREEK, strict=True)), "Armenian": dict(zip(*_ARMENIAN, strict=True)), "Cherokee": dict(zip(*_CHEROKEE, strict=True))}
PHONETIC_TO_LATIN = dict(zip(*_PHONETIC, strict=True))
#: from one script to another, letter by letter
TWINS: dict[tuple[str, str], dict[str, str]] = {(s, "Latin"): t for s, t in LATIN_OF.items()}
for _s, _t in LATIN_OF.items():
    TWINS["Latin", _s] = {b: a for a, b in _t.items() if a not in _WEAK and a not in _RARE}
for _a in LATIN_OF:
    for _b in LATIN_OF:
        if _a != _b:
            TWINS[_a, _b] = {x: TWINS["Latin", _b][y] for x, y in LATIN_OF[_a].items() if y in TWINS["Latin", _b]}

INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁦-⁯ㅤ︀-️﻿ﾠ￹-￻\x00-\x08\x0b\x0c\x0e-\x1f\x7f\U000e0000-\U000e01ef"
SPACES = "   -     　"
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_SPACE = re.compile(f"[{SPACES}]")
#: Letters, digits and signs with a width, a typeface or a ligature of their own, number letters and the long s.
_FORM = re.compile("[！-～￠-￦﹐-﹫ﬀ-ﬆ\U0001d400-\U0001d7ffⒶ-ⓩⅠ-ⅿſ]+")
_MARK = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿]")
#: Beside these a full-width form is the usual one.
_WIDE = re.compile("[、-ヿ㐀-鿿가-힯]")
#: Letters that joiners belong between, signs that selectors and joiners belong behind, and tags of a flag.
_CURSIVE = re.compile("[؀-ࣿऀ-෿]")
_PICTURE = re.compile("[\U0001f000-\U0001faff←-⇿⌀-➿⤀-⥿⬀-⯿〰〽㊗㊙©®‼⁉™ℹ#*0-9]")
_FLAG = re.compile("[\U0001f3f4\U000e0020-\U000e007f]")

_CHARS = {"Latin": "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ", "Cyrillic": "Ѐ-ԯ", "Greek": "Ͱ-Ͽἀ-῿", "Armenian": "Ա-֏", "Cherokee": "Ꭰ-᏿ꭰ-ꮿ"}
_SCRIPTS = tuple((name, re.compile(f"[{chars}]")) for name, chars in _CHARS.items())
_FOREIGN = "".join(c for name, c in _CHARS.items() if name != "Latin") + _PHONETIC[0]
_HAS_FOREIGN = re.compile(f"[{_FOREIGN}]")
_LETTER = f"{_CHARS['Latin']}{_FOREIGN}̀-ͯ{INVISIBLE}"
#: A word with a letter that is not Latin.
_ODD = re.compile(f"[{_LETTER}]*[{_FOREIGN}][{_LETTER}]*")
_HIDDEN_REFERENCE = re.compile(r"&(?:#[0-9]{2,7}|#[xX][0-9A-Fa-f]{2,6}|nbsp|ensp|emsp|emsp13|emsp14|numsp|puncsp|thinsp|hairsp|zwnj|zwj|lrm|rlm|shy|NoBreak|ZeroWidthSpace|NonBreakingSpace|fflig|ffllig|filig|fjlig|fllig|ffilig|[A-Z]?[a-z]+cy|[Aa]lpha|[Oo]micron|Beta|Epsilon|Zeta|Eta|Iota|Kappa|Mu|Nu|Rho|Tau|Upsilon|Chi);?")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_CYR = _CHARS["Cyrillic"]
#: Small Latin letters between Cyrillic words, all of them twins of Russian letters. Words with a capital are taken as names that are properly written.
_LATIN_AMONG_CYRILLIC = re.compile(f"(?<=[{_CYR}] )([a-z]|[aceopxy]{{2,}})(?= [{_CYR}])")
_ROMAN = re.compile(r"[IVXLCDM]+")
_CONTEXT = 40

#: For the JVM: every text that could hold a case matches. Plain ASCII and the usual Latin text without references do not.
JVM_FILTER = (
    r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\xA0\xAD\x{17F}\x{250}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{20D0}-\x{20FF}\x{2160}-\x{217F}\x{24B6}-\x{24E9}\x{2C00}-\x{FFFF}]|[\x{10000}-\x{1FFFF}]|[\x{E0000}-\x{E01EF}]"
    r"|&(?:#|nbsp|e[mn]sp|emsp1|numsp|puncsp|thinsp|hairsp|zwn?j|lrm|rlm|shy|No|Zero|f[fijl]+lig|[A-Z]?[a-z]+cy;|[Aa]lpha|[Oo]micron|Beta|Epsilon|Zeta|Eta|Iota|Kappa|Mu;|Nu;|Rho|Tau|Upsilon|Chi)"
)


def resolve_references(text: str) -> str:
    """Character references of odd characters as the characters themselves; the others stay."""

    def one(m: re.Match) -> str:
        c = html.unescape(m[0] if m[0].endswith(";") else m[0] + ";")
        return c if len(c) <= 2 and c not in ("<", ">", "&", '"', "'") and not c.startswith("&") else m[0]

    return _HIDDEN_REFERENCE.sub(one, text)


def _belongs(text: str, at: int) -> bool:
    """Whether the invisible character does its proper work at its place: a joiner between cursive letters or pictures, a selector behind a picture, a tag of a flag."""
    c = text[at]
    k = at - 1
    if c in "‌‍":
        while k >= 0 and text[k] in "︎️":
            k -= 1
        before, after = text[k:k + 1] if k >= 0 else "", text[at + 1:at + 2]
        return bool(_CURSIVE.match(before) and _CURSIVE.match(after) or c == "‍" and _PICTURE.match(before) and _PICTURE.match(after) and not before.isascii())
    if c in "︎️":
        return k >= 0 and bool(_PICTURE.match(text[k])) and (not text[k].isascii() or text[at + 1:at + 2] == "⃣")
    return k >= 0 and "\U000e0020" <= c <= "\U000e007f" and bool(_FLAG.match(text[k]))


def _usual_form(text: str, a: int, b: int) -> bool:
    """Whether full-width signs stand right beside ideographs, where they are at home."""
    return "！" <= text[a] <= "￦" and bool(_WIDE.match(text[max(0, a - 1):a]) or _WIDE.match(text[b:b + 1]))


@lru_cache(4096)
def resolved(c: str) -> frozenset[str]:
    """The resolved script set of a letter: its own script and those in which it has a twin; empty for other characters."""
    own = next((name for name, rx in _SCRIPTS if rx.match(c)), None)
    return frozenset() if own is None else frozenset([own, *(b for (a, b), t in TWINS.items() if a == own and c in t)])


@lru_cache(4096)
def script_of(c: str) -> str | None:
    return next((name for name, rx in _SCRIPTS if rx.match(c)), None)


def _scripts(token: str) -> Counter:
    return Counter(s for c in token if (s := script_of(c)))


def _around(text: str, a: int, b: int) -> Counter:
    """Scripts of the letters near a token that have no twin: what the passage is written in."""
    return Counter(script_of(c) for c in text[max(0, a - _CONTEXT):a] + " " + text[b:b + _CONTEXT] if len(resolved(c)) == 1)


def consistent(token: str, context: Counter) -> str | None:
    """The spelling of the token in one script, or None if it is well as it stands."""
    letters = unicodedata.normalize("NFC", _INVISIBLE.sub("", token))
    own = _scripts(letters)
    if not own:
        return None
    if len(own) > 1:
        # mixed: among the scripts in the intersection of the letters' sets, the passage's or else the commonest
        fit = frozenset.intersection(*[r for c in letters if (r := resolved(c))]) & set(own)
        best = max(sorted(fit or own), key=lambda s: (context.get(s, 0) > 0, own[s], context.get(s, 0)))
        if best != "Latin" and context.get("Latin", 0) > context.get(best, 0) and "Latin" in fit:
            best = "Latin"
        changed = "".join(TWINS.get((s, best), {}).get(c, c) if (s := script_of(c)) and s != best else c for c in letters)
        return changed if changed != letters else None
    (script,) = own
    if not context:
        return None
    target = context.most_common(1)[0][0]
    if target == script or (script, target) not in TWINS or context[script] * 3 > context[target]:
        return None
    table = TWINS[script, target]
    if not all(c in table for c in letters) or all(c in _WEAK for c in letters):
        return None
    if script == "Latin" and (_ROMAN.fullmatch(letters) or letters.isupper() and len(letters) > 1):
        return None
    return "".join(table[c] for c in letters)


def _is_sign(text: str, a: int, b: int) -> bool:
    """A lone letter of another script that is tied to a word by a hyphen, as in a name of a ray or a process."""
    return b - a == 1 and (text[b:b + 1] == "-" or text[max(0, a - 1):a] == "-")


def _phonetic(text: str, a: int, b: int) -> str | None:
    """The plain spelling of a word with phonetic letters, unless it is a transcription."""
    tok = text[a:b]
    plain = "".join(PHONETIC_TO_LATIN.get(c, c) for c in tok)
    return plain if plain.isascii() and plain.isalpha() and b - a > 1 and text[max(0, a - 1):a] not in ("[", "/", "ˈ", "ˌ") and text[b:b + 1] not in ("]", "/", "ː") else None


def _odd_tokens(text: str):
    """(start, end, spelling) of the tokens whose letters are of the wrong script."""
    for m in _ODD.finditer(text):
        a, b = m.span()
        tok = m[0]
        if any(c in PHONETIC_TO_LATIN for c in tok):
            new = _phonetic(text, a, b)
            if new is not None:
                yield a, b, new
            continue
        scripts = _scripts(tok)
        if len(scripts) == 1:
            # most tokens of a properly written passage have letters without a twin
            if any(len(resolved(c)) == 1 for c in tok) or _is_sign(text, a, b):
                continue
        new = consistent(tok, _around(text, a, b))
        if new is not None:
            yield a, b, new
    for m in _LATIN_AMONG_CYRILLIC.finditer(text):
        table = TWINS["Latin", "Cyrillic"]
        if all(c in table for c in m[1]):
            yield m.start(1), m.end(1), "".join(table[c] for c in m[1])


def kinds_of(text: str) -> list[str]:
    """What kinds of odd characters the text holds, in fixed order; empty for a plain text. Each character is judged at its own place."""
    if text is None or text.isascii() and not _HIDDEN_REFERENCE.search(text) and not _INVISIBLE.search(text):
        return []
    out = []
    shown = resolve_references(text)
    if any(not _belongs(shown, m.start()) for m in _INVISIBLE.finditer(shown)):
        out.append("invisible")
    if _SPACE.search(shown):
        out.append("space")
    if any(not _usual_form(shown, *m.span()) for m in _FORM.finditer(shown)):
        out.append("form")
    if _MARK.search(shown) and unicodedata.normalize("NFC", shown) != shown:
        out.append("decomposed")
    if _HAS_FOREIGN.search(shown):
        plain = _TAG.sub(lambda t: " " * len(t[0]), shown) if "<" in shown else shown
        if next(_odd_tokens(plain), None):
            out.append("script")
    return out


def canonical(text: str | None) -> str | None:
    """The one consistent form: equal for a text and its plain twin, and a fixed point.

    Each character is judged at its own place, so a picture or an ideograph
    somewhere in the text changes nothing elsewhere. Superscripts are seen as
    such and stay.
    """
    if text is None:
        return None
    if text.isascii() and not _HIDDEN_REFERENCE.search(text) and not _INVISIBLE.search(text):
        return text
    text = resolve_references(text)
    text = _FORM.sub(lambda m: m[0] if _usual_form(m.string, *m.span()) else unicodedata.normalize("NFKC", m[0]), text)
    text = _SPACE.sub(" ", text)
    text = _INVISIBLE.sub(lambda m: m[0] if _belongs(m.string, m.start()) else "", text)
    text = unicodedata.normalize("NFC", text)
    for _ in range(len(_CHARS)):  # a word that is respelt may change what the next one stands among
        if not _HAS_FOREIGN.search(text):
            break
        plain = _TAG.sub(lambda t: " " * len(t[0]), text) if "<" in text else text
        odd = list(_odd_tokens(plain))
        if not odd:
            break
        parts, at = [], 0
        for a, b, new in sorted(odd):
            parts += [text[at:a], new]
            at = b
        text = unicodedata.normalize("NFC", "".join(parts) + text[at:])
    return text


def values(metadata: DataFrame, creators: DataFrame, chapters: DataFrame) -> DataFrame:
    """The fields in question in long form; nulls are left out."""

    def part(df: DataFrame, tbl: str, key: str, field: str) -> DataFrame:
        return df.select(F.lit(tbl).alias("tbl"), F.col(key).cast("string").alias("row_key"), F.lit(field).alias("field"), F.col(field).alias("text"))

    out = part(metadata, "metadata", "book_id", "title").unionByName(part(creators, "creators", "creator_id", "name")).unionByName(part(chapters, "chapters", "chapter_id", "body_html"))
    return out.where("text is not null")


def _find(dictionaries: list[bytes]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = encodings.model(dictionaries)
        for pdf in batches:
            rows = []
            for tbl, key, field, text in pdf.itertuples(index=False):
                kinds = kinds_of(text)
                # a title whose odd characters come from a wrong encoding is a case of that problem
                if kinds and field == "title" and m.repair(text):
                    continue
                if kinds:
                    rows.append((tbl, key, field, kinds))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINDINGS.split(", ")])

    return run


def find_lookalikes(metadata: DataFrame, creators: DataFrame, chapters: DataFrame, warnings: DataFrame) -> DataFrame:
    """Every value with an odd character and the kinds it has; a map without a shuffle.

    A regular expression on the JVM lets through only texts that could hold a
    case. Defined results: nulls and empty texts give no row, repeated rows
    repeated rows, whole texts are read however long they are.
    """
    dictionaries = encodings.fit(metadata, warnings)
    return values(metadata, creators, chapters).where(F.col("text").rlike(JVM_FILTER)).mapInPandas(_find(dictionaries), FINDINGS)


def found(metadata: DataFrame, creators: DataFrame, chapters: DataFrame, warnings: DataFrame) -> DataFrame:
    return find_lookalikes(metadata, creators, chapters, warnings).select("tbl", "row_key", "field").distinct()


def _canonical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(text=pdf["text"].map(canonical)).rename(columns={"text": "canonical"})


def canonical_values(metadata: DataFrame, creators: DataFrame, chapters: DataFrame) -> DataFrame:
    """Every value in its consistent form, each row of the tables once; plain texts pass by without Python."""
    v = values(metadata, creators, chapters)
    odd = F.col("text").rlike(JVM_FILTER)
    plain = v.where(~odd).select("tbl", "row_key", "field", F.col("text").alias("canonical"))
    return plain.unionByName(v.where(odd).mapInPandas(_canonical, FORMS))
