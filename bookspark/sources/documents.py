"""Metadata documents: JSON, or the plain part of YAML that people write by hand; also the front matter of Markdown."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame

PERSON = "struct<name:string,file_as:string,role:string>"
DOC = f"title string, language string, identifier string, isbn string, description string, publisher string, date string, rights string, series string, series_index string, cover string, authors array<{PERSON}>, contributors array<{PERSON}>, subjects array<string>, identifiers array<struct<value:string,scheme:string>>"
SCHEMA = f"doc_id string, {DOC}, error string"
_SCALARS = ("title", "language", "identifier", "isbn", "description", "publisher", "date", "rights", "series", "series_index", "cover")
#: Names that stand for others, fixed values.
_ALIASES = {"author": "authors", "creator": "authors", "creators": "authors", "contributor": "contributors", "subject": "subjects", "tags": "subjects", "lang": "language", "series-index": "series_index"}


class DocumentError(ValueError):
    """A document that can't be read, with its line."""


def _scalar(text: str, line: int):
    text = text.strip()
    if text[:1] in "\"'":
        if len(text) < 2 or text[-1] != text[0]:
            raise DocumentError(f"line {line}: a quotation has no end")
        body = text[1:-1]
        return body.replace("''", "'") if text[0] == "'" else json.loads(text) if "\\" in body else body
    text = re.sub(r"\s+#.*$", "", text)
    if text[:1] == "[":
        if text[-1:] != "]":
            raise DocumentError(f"line {line}: a list has no end")
        return [_scalar(x, line) for x in re.findall(r"\s*(?:\"[^\"]*\"|'[^']*'|[^,]+)", text[1:-1]) if x.strip()]
    return None if text in ("", "~", "null") else text


def read_yaml(text: str) -> dict:
    """Mappings, lists of scalars or mappings, quoted and block scalars, flow lists; anything else is an error with its line."""
    lines = [(k, len(x) - len(x.lstrip(" ")), x.strip()) for k, x in enumerate(text.split("\n"), 1)]
    at = 0

    def skip() -> None:
        nonlocal at
        while at < len(lines) and (not lines[at][2] or lines[at][2][0] == "#" or lines[at][2] in ("---", "...")):
            at += 1

    def block(indent: int, folded: bool) -> str:
        nonlocal at
        out: list[str] = []
        while at < len(lines) and (lines[at][1] > indent or not lines[at][2]):
            out.append(lines[at][2])
            at += 1
        while out and not out[-1]:
            out.pop()
        return (" " if folded else "\n").join(out)

    def value(rest: str, indent: int, line: int):
        if rest[:1] in "|>" and re.fullmatch(r"[|>][+-]?", rest):
            return block(indent, rest[0] == ">")
        if rest:
            return _scalar(rest, line)
        skip()
        if at < len(lines) and (lines[at][1] > indent or lines[at][1] == indent and lines[at][2].startswith("- ")):
            return sequence(lines[at][1]) if lines[at][2].startswith("-") else mapping(lines[at][1])
        return None

    def sequence(indent: int) -> list:
        nonlocal at
        out: list = []
        while True:
            skip()
            if at >= len(lines) or lines[at][1] != indent or not re.match(r"-(?:\s|$)", lines[at][2]):
                return out
            line, _, body = lines[at]
            inner = body[1:].lstrip()
            if re.match(r"[\w-]+:(?:\s|$)", inner) and inner[:1] not in "\"'":
                lines[at] = (line, indent + len(body) - len(inner), inner)
                out.append(mapping(lines[at][1]))
            else:
                at += 1
                out.append(value(inner, indent, line))

    def mapping(indent: int) -> dict:
        nonlocal at
        out: dict = {}
        while True:
            skip()
            if at >= len(lines) or lines[at][1] < indent:
                return out
            line, here, body = lines[at]
            m = re.match(r"([\w-]+|\"[^\"]*\"|'[^']*'):(?:\s+(.*)|\s*)$", body)
            if here > indent or not m:
                raise DocumentError(f"line {line}: no entry of a mapping")
            at += 1
            out[m[1].strip("\"'")] = value((m[2] or "").strip(), indent, line)

    skip()
    if at >= len(lines):
        return {}
    out = mapping(lines[at][1])
    skip()
    if at < len(lines):
        raise DocumentError(f"line {lines[at][0]}: no entry of a mapping")
    return out


def read(text: str) -> dict:
    """A document by its content; blank is empty."""
    if text.lstrip()[:1] == "{":
        try:
            return json.loads(text)
        except json.JSONDecodeError as e:
            raise DocumentError(f"line {e.lineno}: {e.msg}") from e
    return read_yaml(text)


def _many(x) -> list | None:
    return None if x is None else list(x) if isinstance(x, list) else [x]


def _person(x) -> dict | None:
    if isinstance(x, dict):
        return {"name": x.get("name"), "file_as": x.get("file_as") or x.get("file-as"), "role": x.get("role")} if x.get("name") else None
    return {"name": str(x), "file_as": None, "role": None} if x is not None and str(x).strip() else None


def normal(doc: dict) -> dict:
    """One or many become lists, names become people, other names of a field count as it; unknown keys are ignored."""
    d = {_ALIASES.get(k.lower(), k.lower()): v for k, v in doc.items()}
    out = {k: None if d.get(k) is None else str(d[k]) for k in _SCALARS}
    if isinstance(d.get("series"), dict):
        out["series"], out["series_index"] = d["series"].get("name"), None if d["series"].get("index") is None else str(d["series"]["index"])
    for k in ("authors", "contributors"):
        many = _many(d.get(k))
        out[k] = None if many is None else [p for x in many if (p := _person(x))]
    many = _many(d.get("subjects"))
    out["subjects"] = None if many is None else [str(x) for x in many if x is not None]
    many = _many(d.get("identifiers"))
    out["identifiers"] = None if many is None else [{"value": str(x.get("value")), "scheme": x.get("scheme")} if isinstance(x, dict) else {"value": str(x), "scheme": None} for x in many if x]
    return out


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = re.findall(r"(?:^|, )(\w+) ", SCHEMA)
    for pdf in batches:
        rows = []
        for i, text in pdf.itertuples(index=False):
            try:
                rows.append({"doc_id": i, **normal(read(text or "")), "error": None})
            except (DocumentError, AttributeError) as e:
                rows.append({**dict.fromkeys(names), "doc_id": i, "error": str(e)})
        yield pd.DataFrame(rows, columns=names)


def documents(df: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """Every document as a row; one that can't be read is a row with its error."""
    return df.select(doc_id.cast("string").alias("doc_id"), text.alias("text")).mapInPandas(_documents, SCHEMA)
