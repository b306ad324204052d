"""Problem 4: markup residue in text.

Templates are deduced per host: markup tokens with the same occurrence vector
over the host's pages form an equivalence class, classes whose tokens keep one
order on every page are valid, and the class that covers a page whole is its
template. What stands in the slots is then read: HTML is rendered, references are
resolved (escaped HTML in a second round), and what a reader would still see
of Markdown, wiki or LaTeX becomes plain text with its headings, lists, code
and formulas kept as blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLEAN = "tbl string, row_key string, text string, blocks array<struct<kind:string,level:int,text:string>>, residue array<string>, slots int"

# fixed values: elements of HTML, and the few a wiki adds
_ELEMENTS = "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr ref nowiki gallery references"
_NAMES = "|".join(sorted(_ELEMENTS.split(), key=len, reverse=True))
_BLOCK = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul caption".split())

TAG = re.compile(rf"<!--.*?-->|<!DOCTYPE[^>]*>|<\?[^>]*\?>|</?(?:{_NAMES})(?:\s[^<>]*|/)?>", re.I | re.S)
_TAG_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_PRE = re.compile(r"<pre\b[^>]*>(.*?)</pre\s*>", re.I | re.S)
_AUTO = re.compile(r"<(https?://[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.]+)>")

# name, pattern and what stays of it; tried in this order
RULES: tuple[tuple[str, re.Pattern, object], ...] = (
    ("md fence", re.compile(r"^(`{3,}|~{3,})[^\n`]*\n(.*?)(?:\n\1[ \t]*$|\Z)", re.M | re.S), "code"),
    ("latex list", re.compile(r"\\begin\{(itemize|enumerate|description)\*?\}(.*?)\\end\{\1\*?\}", re.S), "items"),
    ("latex block", re.compile(r"\\begin\{([a-zA-Z]+)\*?\}(?:\[[^\]\n]*\])?(.*?)\\end\{\1\*?\}", re.S), "environment"),
    ("latex formula", re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)|\$\$(.+?)\$\$|(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[\\^_=+<>][^$\n]*?|[A-Za-z])(?<=[^\s$\\])\$(?![\d$])", re.S), "formula"),
    ("wiki reference", re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", re.S | re.I), ""),
    ("wiki template", re.compile(r"\{\{[^{}]*\}\}"), ""),
    ("wiki table", re.compile(r"^\{\|.*?^\|\}", re.M | re.S), "cells"),
    ("wiki heading", re.compile(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", re.M), "heading"),
    ("wiki file", re.compile(r"\[\[(?:File|Image|Category):[^\[\]\n]*\]\]", re.I), ""),
    ("wiki link", re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]"), r"\1"),
    ("wiki url", re.compile(r"(?<!\])\[(?:https?:|ftp:|//)[^\s\]]+(?:[ \t]+([^\]\n]*))?\](?!\()"), r"\1"),
    ("wiki emphasis", re.compile(r"('{2,5})(?=[^'\n])([^\n]*?[^'\n])\1"), r"\2"),
    ("md image", re.compile(r"!\[([^\]\n]*)\]\([^()\s]*(?:\([^()]*\))?[^()\s]*(?:[ \t]+[\"'][^\"'\n]*[\"'])?\)"), r"\1"),
    ("md definition", re.compile(r"^[ \t]{0,3}\[(?!\^)[^\]\n]+\]:[ \t]*\S+.*$", re.M), ""),
    ("md source note", re.compile(r"\(\[source\](?:\[[^\]\n]*\]|\([^)\n]*\))\)"), ""),
    ("md note", re.compile(r"^[ \t]{0,3}\[\^[^\]\s]+\]:[ \t]*(.*)$", re.M), r"\1"),
    ("md note mark", re.compile(r"\[\^[^\]\s]+\]:?"), ""),
    ("md link", re.compile(r"(?<!\!)\[([^\]\n]*)\]\([^()\s]*(?:\([^()]*\))?[^()\s]*(?:[ \t]+[\"'][^\"'\n]*[\"'])?\)"), r"\1"),
    ("md reference", re.compile(r"\[([^\]\n]+)\]\[[^\]\n]*\]"), r"\1"),
    ("md table", re.compile(r"^\|?[^\n|]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$(?:\n[^\n]*\|[^\n]*)*", re.M), "cells"),
    ("md heading", re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M), "heading"),
    ("md underlined", re.compile(r"^(?=\S)([^\n]*\S)[ \t]*\n(={3,}|-{3,})[ \t]*$", re.M), "underlined"),
    ("md quote", re.compile(r"^[ \t]{0,3}>[ \t]+(?=\S)", re.M), ""),
    ("md code", re.compile(r"(`+)(?=[^`\s])([^`\n]*?[^`\s])\1(?!`)"), r"\2"),
    ("md strong", re.compile(r"(\*{2,3})(?=[^\s*])([^*\n]*?[^\s*])\1"), r"\2"),
    ("md emphasis", re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])"), r"\1"),
    ("md underscore", re.compile(r"(?<![\w\\])(_{1,3})(?=[^\s_])([^_\n]*?[^\s_])\1(?!\w)"), r"\2"),
    ("md strike", re.compile(r"~~(?=[^\s~])([^~\n]*?[^\s~])~~"), r"\1"),
    ("md bullets", re.compile(r"^(?=[ \t]*([-+*])[ \t]+\S)(?:[ \t]*\1[ \t]+[^\n*][^\n]*(?:\n+|\Z)){2,}", re.M), "bullets"),
    ("wiki bullets", re.compile(r"^(?:[*#:;]+[ \t]*[^\s*#:;][^\n]*(?:\n+|\Z)){2,}", re.M), "bullets"),
    ("md numbers", re.compile(r"^(?:[ \t]*\d{1,3}[.)][ \t]+\S[^\n]*(?:\n+|\Z)){3,}", re.M), "keep"),
    ("latex heading", re.compile(r"\\(?:part|chapter|((?:sub)*)section|paragraph)\*?\{([^{}]*)\}"), "latex heading"),
    ("latex citation", re.compile(r"~?\\(?:cite[a-z]*|ref|eqref|pageref|label|footnotemark|index)\*?(?:\[[^\]\n]*\])*\{[^{}]*\}"), ""),
    ("latex command", re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}(?:\{[^{}]*\})?"), r"\1"),
    ("latex sign", re.compile(r"(?<![\w\\:])\\(S|P|dag|ddag|ldots|dots|LaTeX|TeX|copyright|textbackslash|ss|o|O|ae|oe|aa|l|L|item|par|noindent|newline|newpage|bigskip|medskip|smallskip|centering|maketitle|tableofcontents|hline|quad|qquad|times|pm|leq|geq|neq|cdot|infty|alpha|beta|gamma|delta|pi|sigma|omega|to|rightarrow)(?![A-Za-z])[ \t]?"), "sign"),
    ("latex accent", re.compile(r"\\([\"'`^~=.])\{?([A-Za-z])\}?"), "accent"),
    ("latex quotes", re.compile(r"``([^`'\n]+)''"), "“\\1”"),
    ("latex escape", re.compile(r"\\([%&$#_{}])"), r"\1"),
    ("latex break", re.compile(r"\\\\(?:\[[^\]]*\])?[ \t]*(?=\n|$)", re.M), "\n"),
)
_ANY = re.compile(r"[\\*_`~$|]|\[\[|\]\(|\]\[|\[\^|\]:|\{\{|\{\||''|==|\[(?:https?:|//)|^[ \t]{0,3}(?:#|>[ \t])|^[ \t]*[-+*#:;] ?\S|^-{3,}|^[ \t]*\d{1,3}[.)] ", re.M)

_SIGNS = {"S": "§", "P": "¶", "dag": "†", "ddag": "‡", "ldots": "…", "dots": "…", "copyright": "©", "ss": "ß", "o": "ø", "O": "Ø", "ae": "æ", "oe": "œ", "aa": "å", "l": "ł", "L": "Ł", "textbackslash": "\\", "item": "• ", "times": "×", "pm": "±", "leq": "≤", "geq": "≥", "neq": "≠", "cdot": "·", "infty": "∞", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "pi": "π", "sigma": "σ", "omega": "ω", "to": "→", "rightarrow": "→", "LaTeX": "LaTeX", "TeX": "TeX", "par": "\n\n", "newline": "\n"}
_ACCENTS = {'"': "̈", "'": "́", "`": "̀", "^": "̂", "~": "̃", "=": "̄", ".": "̇"}
#: Marks of blocks within the plain text; none of them is a sign of a markup language.
HEADING, ITEM, CODE, FORMULA = "\x01", "\x02", "\x03", "\x04"


def linear_formula(tex: str) -> str:
    """A formula in one line of ordinary signs, as far as that is possible."""
    out = tex.strip()
    for _ in range(4):
        out = re.sub(r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", out)
        out = re.sub(r"\\sqrt\{([^{}]*)\}", r"√(\1)", out)
        out = re.sub(r"\\(?:text|mathrm|mathbf|mathit|operatorname)\{([^{}]*)\}", r"\1", out)
    out = re.sub(r"\\([A-Za-z]+)", lambda m: _SIGNS.get(m[1], m[1]), out)
    out = re.sub(r"\^\{?([0-9])\}?", lambda m: "⁰¹²³⁴⁵⁶⁷⁸⁹"[int(m[1])], out)
    out = re.sub(r"_\{?([0-9])\}?", lambda m: "₀₁₂₃₄₅₆₇₈₉"[int(m[1])], out)
    out = re.sub(r"[{}]", "", out)
    return re.sub(r"\(([A-Za-z0-9])\)", r"\1", out)


def _kept(kind: object, m: re.Match) -> str:
    if kind == "code":
        return "\n\n" + "\n".join(CODE + line for line in m[2].split("\n")) + "\n\n"
    if kind == "items":
        items = [" ".join(x.split()) for x in re.split(r"\\item(?:\[[^\]\n]*\])?(?![A-Za-z])", m[2])[1:]]
        return "\n\n" + "\n".join(f"{ITEM}{i + 1}. {x}" if m[1] == "enumerate" else f"{ITEM}• {x}" for i, x in enumerate(items)) + "\n\n"
    if kind == "environment":
        if m[1] in ("equation", "align", "gather", "displaymath", "math", "eqnarray"):
            return "\n\n" + FORMULA + linear_formula(m[2]) + "\n\n"
        if m[1] in ("verbatim", "lstlisting", "minted"):
            return "\n\n" + "\n".join(CODE + line for line in m[2].strip("\n").split("\n")) + "\n\n"
        return "\n\n" + m[2].strip() + "\n\n"
    if kind == "formula":
        block = m[1] is not None or m[3] is not None
        body = linear_formula(next(g for g in m.groups() if g is not None))
        return f"\n\n{FORMULA}{body}\n\n" if block else body
    if kind == "heading":
        return f"\n\n{HEADING}{len(m[1])}{m[2]}\n\n"
    if kind == "underlined":
        return f"\n\n{HEADING}{1 if m[2][0] == '=' else 2}{m[1]}\n\n"
    if kind == "latex heading":
        return f"\n\n{HEADING}{1 + len(m[1] or '') // 3}{m[2]}\n\n"
    if kind == "bullets":
        lines = [x.strip() for x in m[0].split("\n") if x.strip()]
        return "\n\n" + "\n".join(ITEM + "• " + re.sub(r"^[-+*#:;]+[ \t]*", "", x) for x in lines) + "\n\n"
    if kind == "keep":
        return "\n\n" + "\n".join(ITEM + x.strip() for x in m[0].split("\n") if x.strip()) + "\n\n"
    if kind == "cells":
        rows = [[c.strip() for c in re.split(r"\|\||!!|[|!]", x.strip().strip("|!")) if c.strip()] for x in m[0].split("\n") if not re.fullmatch(r"\s*(?:\{\||\|\}|\|-+|[|:\s-]+).*" if x.lstrip().startswith(("{|", "|}", "|-")) else r"[|:\s-]+", x)]
        return "\n\n" + "\n".join(" — ".join(r) for r in rows if r) + "\n\n"
    if kind == "sign":
        return _SIGNS.get(m[1], "")
    if kind == "accent":
        import unicodedata

        return unicodedata.normalize("NFC", m[2] + _ACCENTS[m[1]])
    return m.expand(kind)


def _false_alarm(name: str, m: re.Match) -> bool:
    """Bare signs without markup meaning: prices, ornaments, products."""
    if name in ("md strong", "md emphasis", "md underscore", "md strike", "md code"):
        inner = m[0].strip("*_~`")
        return not re.search(r"\w", inner)
    if name == "md bullets":
        return not re.search(r"\w", m[0])
    return name == "latex formula" and m[4] is not None and len(m[4]) == 1 and m[4].isdigit()


def _plain(text: str, seen: list[str]) -> str:
    """Text without Markdown, wiki and LaTeX; the names of what was found are added to seen."""
    if not _ANY.search(text):
        return text
    for name, rx, kind in RULES:
        def one(m: re.Match, name: str = name, kind: object = kind) -> str:
            if _false_alarm(name, m):
                return m[0]
            if name != "md numbers":
                seen.append(name)
            return _kept(kind, m)

        if name in _NESTING:
            for _ in range(3):
                new = rx.sub(one, text)
                if new == text:
                    break
                text = new
        else:
            text = rx.sub(one, text)
    return text


_NESTING = frozenset(("wiki template", "latex command", "md strong", "md link"))


def _render(text: str, seen: list[str], count: bool) -> str:
    """One round of HTML: tags become line structure, references their characters."""
    out, at, stack, number = [], 0, [], []
    for m in TAG.finditer(text):
        out.append(_refs(text[at:m.start()], seen, count))
        at = m.end()
        if count:
            seen.append("html tag")
        n = _TAG_NAME.match(m[0])
        name = n[1].lower() if n else ""
        closing = m[0][1:2] == "/"
        if name in ("ol", "ul"):
            number.append(0 if name == "ol" else None) if not closing else (number.pop() if number else None)
            out.append("\n\n" if len(number) <= 1 else "\n")
        elif name == "li" and not closing:
            if number and number[-1] is not None:
                number[-1] += 1
            out.append(f"\n{ITEM}{str(number[-1]) + '.' if number and number[-1] is not None else '•'} ")
        elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
            out.append(f"\n\n{HEADING}{name[1]}" if not closing else "\n\n")
        elif name in ("td", "th"):
            out.append(" — " if closing else "")
        elif name == "tr":
            out.append("\n")
        elif name == "br":
            out.append("\n")
        elif name in _BLOCK:
            out.append("\n\n")
        elif name in ("script", "style"):
            stack.append(name)
    out.append(_refs(text[at:], seen, count))
    return "".join(out)


def _refs(text: str, seen: list[str], count: bool) -> str:
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[0][1] != "#" and m[0][1:] not in html5:
            return m[0]
        if count:
            seen.append("html reference")
        return html.unescape(m[0])

    return REFERENCE.sub(one, text)


def _code_blocks(text: str) -> tuple[str, list[str]]:
    """The text with its code samples set aside."""
    kept: list[str] = []

    def one(m: re.Match) -> str:
        if "<code" not in m[1].lower() and "<samp" not in m[1].lower():
            return m[0]
        kept.append(html.unescape(TAG.sub("", m[1])))
        return f"\n\n\x05{len(kept) - 1}\x06\n\n"

    return _PRE.sub(one, text), kept


def clean(text: str | None, is_html: bool) -> tuple[str, list[tuple[str, int, str]], list[str]]:
    """(plain text, blocks, residue found). ``is_html``: the text is a page, so its own tags are no residue.

    Null gives empty results. A page is rendered once, any other text twice at
    most, which resolves escaped HTML; what is left is read as Markdown, wiki
    and LaTeX.
    """
    if not text:
        return "", [], []
    seen: list[str] = []
    body, samples = _code_blocks(text.replace("\r\n", "\n").replace("\r", "\n"))
    if is_html:
        body = _render(body, seen, False)
    for _ in range(2):
        body = _plain_refs(body, seen)
        if TAG.search(body) or REFERENCE.search(body) or _AUTO.search(body):
            body = _render(_AUTO.sub(lambda m: seen.append("md link") or m[1], body), seen, True)
        else:
            break
    body = _plain(body, seen)
    blocks: list[tuple[str, int, str]] = []
    for para in re.split(r"\n[ \t]*\n", body):
        for line in para.split("\n") if any(c in para for c in "\x01\x02\x03\x04\x05") else [para]:
            line = line.strip(" \t\n")
            if not line:
                continue
            if line[0] == HEADING:
                blocks.append(("heading", int(line[1]) if line[1:2].isdigit() else 1, line[2:].strip()))
            elif line[0] == ITEM:
                blocks.append(("item", 1, line[1:].strip()))
            elif line[0] == CODE:
                if blocks and blocks[-1][0] == "code" and blocks[-1][1] == -1:
                    blocks[-1] = ("code", -1, blocks[-1][2] + "\n" + line[1:])
                else:
                    blocks.append(("code", -1, line[1:]))
            elif line[0] == FORMULA:
                blocks.append(("formula", 0, line[1:].strip()))
            elif line[0] == "\x05":
                blocks.append(("code", 0, samples[int(line[1:line.index("\x06")])]))
            else:
                blocks.append(("paragraph", 0, re.sub(r"\s+", " ", re.sub(r"(?: — )+$", "", line))))
    blocks = [(k, max(0, n), re.sub("[\x01-\x06]", "", t)) for k, n, t in blocks]
    return "\n\n".join(t if k != "code" else "\n".join("    " + x for x in t.split("\n")) for k, _, t in blocks), blocks, list(dict.fromkeys(seen))


def _plain_refs(body: str, seen: list[str]) -> str:
    """Wiki footnotes go before tags are read, as their content is no text of the page."""
    name, rx, kind = next(r for r in RULES if r[0] == "wiki reference")
    return rx.sub(lambda m: seen.append(name) or "", body) if "<ref" in body else body


#: What a text must hold for a rule to find anything: one of some rare signs, or a pattern for the JVM, where LINE is the start of a line and TAGS what may stand between two signs. Rules that count nothing have none.
NEEDS = {
    "md fence": "`~", "latex list": "\\", "latex block": "\\", "latex formula": "\\$", "wiki reference": "(?i:<ref)", "wiki template": "{", "wiki table": "{", "wiki heading": "=TAGS=", "wiki file": "[", "wiki link": "[", "wiki url": "[", "wiki emphasis": "'TAGS'",
    "md image": "]", "md definition": "]", "md source note": "]", "md note": "[", "md note mark": "[", "md link": "]", "md reference": "]", "md table": "|", "md heading": "LINE#", "md underlined": "=TAGS=|-TAGS-TAGS-", "md quote": "LINE>", "md code": "`", "md strong": "*", "md emphasis": "*",
    "md underscore": r"_(?<![\w\\]_)", "md strike": "~", "md bullets": r"LINE[-+*][ \t]", "wiki bullets": "LINE[*#:;]",
    "latex heading": "\\", "latex citation": "\\", "latex command": "\\", "latex sign": "\\", "latex accent": "\\", "latex quotes": "`", "latex escape": "\\", "latex break": "\\",
}
_RARE_SIGNS = frozenset("\\`~${}|[]*")
#: References of signs that rules need, by name. With them any page can show what its source does not hold.
_SIGN_NAMES = "|".join(sorted({k[:-1] for k, v in html5.items() if k.endswith(";") and set(v) & (_RARE_SIGNS | set("<>='!^#_+-:;/(&"))}))


def jvm_filter(page: bool) -> str:
    """A pattern that every text with residue matches, put together from what the rules need.

    A page's own tags and references are no residue, but a line may begin
    behind any tag, tags may stand between two signs, and signs may be written
    as references.
    """
    signs = "".join(sorted({re.escape(c) for need in NEEDS.values() if set(need) <= _RARE_SIGNS for c in need}))
    rest = dict.fromkeys(part for need in NEEDS.values() if not set(need) <= _RARE_SIGNS for part in re.split(r"\|(?![^(]*\))", need))
    line = "|".join(p[4:] for p in rest if p.startswith("LINE"))
    other = "|".join(p.replace("TAGS", "(?:<[^<>]*>)*") for p in rest if not p.startswith("LINE"))
    before = r"(?:^|[\n\r>])[ \t]*" if page else r"(?:^|[\n\r>;])[ \t]*"
    html_signs = rf"&(?:#|(?:{_SIGN_NAMES});)" if page else r"<[!/?A-Za-z]|<[\w.+-]+@|&(?:#|[A-Za-z])"
    return rf"[{signs}]|{other}|{html_signs}|{before}(?:{line})"


PAGE_FILTER, DESCRIPTION_FILTER = jvm_filter(True), jvm_filter(False)


def could_hold(page: Column, text: Column) -> Column:
    """Whether a text could have residue; wider than the rules."""
    return F.when(page, text.rlike(PAGE_FILTER)).otherwise(text.rlike(DESCRIPTION_FILTER))


def values(metadata: DataFrame, works: DataFrame, chapters: DataFrame) -> DataFrame:
    """(tbl, row_key, host, page, text): descriptions and pages in long form, without nulls."""
    m = metadata.select(F.lit("metadata").alias("tbl"), F.col("book_id").alias("row_key"), F.lit("metadata").alias("host"), F.lit(False).alias("page"), F.col("description").alias("text"))
    w = works.select(F.lit("works").alias("tbl"), F.col("ref").alias("row_key"), F.concat(F.lit("works:"), F.substring_index("ref", ":", 1)).alias("host"), F.lit(False).alias("page"), F.col("description").alias("text"))
    c = chapters.select(F.lit("chapters").alias("tbl"), F.col("chapter_id").cast("string").alias("row_key"), F.col("book_id").alias("host"), F.lit(True).alias("page"), F.col("body_html").alias("text"))
    return m.unionByName(w).unionByName(c).where("text is not null")


#: A class of tokens makes a template if it stands on so many pages of the host and on this share of them.
SUPPORT, SHARE = 3, 0.01
_TAG_SQL = r"(?s)</?[A-Za-z][^<>]*>|<!--.*?-->"
_SPLIT = re.compile(f"({_TAG_SQL[4:]})", re.S)


def _cut_into(spans: list[tuple[int, int, int]]) -> set[int]:
    """Classes of (first, last, class) that cut into another on this page, without lying within a slot of it."""
    bad: set[int] = set()
    stack: list[tuple[int, int, int]] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        while stack and stack[-1][1] < s[0]:
            stack.pop()
        if stack and s[1] > stack[-1][1]:
            bad.add(s[2])
        else:
            stack.append(s)
    return bad


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each host and class the least and greatest order of its tokens on a page, its pages, and whether it cuts into another; summed for each batch."""
    for pdf in batches:
        out: dict[tuple, list] = {}
        for host, tags, classes in pdf.itertuples(index=False):
            of = dict(classes)
            first: dict[str, int] = {}
            last: dict[str, int] = {}
            for k, t in enumerate(tags):
                if t in of:
                    first.setdefault(t, k)
                    last[t] = k
            members: dict[int, list[str]] = {}
            for t in first:  # in order of the first place
                members.setdefault(of[t], []).append(t)
            bad = _cut_into([(first[m[0]], max(last[t] for t in m), c) for c, m in members.items()])
            for c, m in members.items():
                seen = out.setdefault((host, c), [m, m, 0, False])
                seen[0], seen[1] = min(seen[0], m), max(seen[1], m)
                seen[2] += 1
                seen[3] |= c in bad
        yield pd.DataFrame([(*k, *v) for k, v in out.items()], columns=["host", "class_id", "least", "most", "n_pages", "cuts"])


def templates(pages: DataFrame) -> DataFrame:
    """The valid equivalence classes of every host of ``pages`` (host, row_key, text).

    An occurrence vector is kept as a sum of hashes of page and count, so a
    host of any size is summed map-side. The classes of a host, a bounded map,
    then meet its pages in a join by host, and what they show is summed for
    each batch. Valid are classes of at least two tokens that keep one order on
    all their pages and never cut into another class. Repeated rows count as
    often as they occur; null texts and hosts have no tokens.
    """
    tags = pages.where("text is not null and host is not null").select("host", "row_key", F.regexp_extract_all("text", F.lit(_TAG_SQL), F.lit(0)).alias("tags"))
    counted = tags.select("host", "row_key", F.explode(F.expr("transform(array_distinct(tags), t -> struct(t as token, size(filter(tags, x -> x = t)) as n))")).alias("x"))
    vectors = counted.groupBy("host", F.col("x.token").alias("token")).agg(F.sum(F.xxhash64("row_key", "x.n").cast("decimal(20,0)")).alias("vector"), F.count("*").alias("n_pages"))
    size = pages.where("text is not null").groupBy("host").agg(F.count("*").alias("n_host"))
    wide = vectors.join(size, "host").where((F.col("n_pages") >= SUPPORT) & (F.col("n_pages") >= SHARE * F.col("n_host"))).withColumn("class_id", F.xxhash64("vector", "n_pages"))
    classes = wide.withColumn("k", F.count("*").over(Window.partitionBy("host", "class_id"))).where("k > 1").groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("token", "class_id"))).alias("classes"))
    placed = tags.join(classes, "host").select("host", "tags", "classes").mapInPandas(_placed, "host string, class_id bigint, least array<string>, most array<string>, n_pages bigint, cuts boolean")
    summed = placed.groupBy("host", "class_id").agg(F.min("least").alias("tokens"), F.max("most").alias("other"), F.sum("n_pages").alias("n_pages"), F.bool_or("cuts").alias("cuts"))
    return summed.where("not cuts and tokens = other and size(tokens) > 1").select("host", "class_id", "tokens", "n_pages")


#: Tags that may frame a description; others are structure that its text needs.
_FRAME = r"(?i)^</?(?:div|span|p|section|article|body|html|main|font|center)\b"


def frames(v: DataFrame) -> DataFrame:
    """(host, frame): the tokens of the template of each host, one row each. Of descriptions only classes of framing tags.

    Bounded for each host: a token must stand on a hundredth of its pages, so
    there are at most a hundred times as many as a page has on average.
    """
    t = templates(v)
    framing = F.col("host").isin("metadata") | F.col("host").startswith("works:")
    t = t.where(~framing | F.forall("tokens", lambda x: x.rlike(_FRAME)))
    return t.select("host", F.explode("tokens").alias("token")).groupBy("host").agg(F.array_sort(F.collect_set("token")).alias("frame"))


def _convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for tbl, key, page, text, tokens in pdf.itertuples(index=False):
            frame = frozenset(tokens) if tokens is not None else frozenset()
            body, slots = text, 1
            if frame:
                parts = _SPLIT.split(text)  # text and tags in turn
                kept = [x if k % 2 == 0 or x not in frame else "\0" for k, x in enumerate(parts)]
                body = "".join(kept)
                slots = sum(1 for x in body.split("\0") if x and not x.isspace())
                body = body.replace("\0", "\n\n")
            framed = body != text
            # the tags of a page's template are its structure, those of a description's are taken off
            out, blocks, residue = clean(text if page else body, page)
            rows.append((tbl, key, out, [{"kind": k, "level": n, "text": t} for k, n, t in blocks], ["template"] * (framed and not page) + residue, slots))
        yield pd.DataFrame(rows, columns=["tbl", "row_key", "text", "blocks", "residue", "slots"])


def convert(metadata: DataFrame, works: DataFrame, chapters: DataFrame, only_marked: bool = False) -> DataFrame:
    """Clean text, blocks, residue and number of template slots of every value; with ``only_marked`` of those that could have residue.

    The template of each host meets its values in a join by host, so nothing
    of it passes through the driver. Defined results: null texts give no row,
    empty ones an empty text without blocks, repeated rows repeated rows; a
    host without a template leaves one slot. Whole texts are read.
    """
    v = values(metadata, works, chapters)
    frame = frames(v)
    if only_marked:
        v = v.where(could_hold(F.col("page"), F.col("text")))
    return v.join(frame, "host", "left").select("tbl", "row_key", "page", "text", "frame").mapInPandas(_convert, CLEAN)


def found(metadata: DataFrame, works: DataFrame, chapters: DataFrame) -> DataFrame:
    return convert(metadata, works, chapters, only_marked=True).where("size(residue) > 0").select("tbl", "row_key").distinct()


def coverage(metadata: DataFrame, works: DataFrame, chapters: DataFrame) -> DataFrame:
    """(tbl, n_values): how many values come out as clean text; none is lost."""
    c = convert(metadata, works, chapters)
    return c.groupBy("tbl").agg(F.count("text").alias("n_values"))
