"""Built-in device profiles as a small table, in listing order."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession

from bookspark.operators.filters import Rule

# fixed values: name, screen width and height, panel, chapter limit in KiB (0: none of its own)
BUILTIN = """
epub 0 0 none 0
x4 480 800 gray4 200
x3 528 792 gray4 200
nomad 1404 1872 gray16 0
kindle 1072 1448 gray16 20480
kindle-paperwhite 1264 1680 gray16 20480
kindle-colorsoft 1264 1680 color 20480
kindle-scribe 1980 2640 gray16 20480
kindle-scribe-colorsoft 1980 2640 color 20480
kobo-clara-bw 1072 1448 gray16 0
kobo-clara-colour 1072 1448 color 0
kobo-libra-colour 1264 1680 color 0
kobo-elipsa-2e 1404 1872 gray16 0
pocketbook-verse 758 1024 gray16 0
pocketbook-verse-pro 1072 1448 gray16 0
pocketbook-era 1264 1680 gray16 0
pocketbook-era-color 1264 1680 color 0
pocketbook-inkpad-4 1404 1872 gray16 0
pocketbook-inkpad-color-3 1404 1872 color 0
boox-page 1264 1680 gray16 0
boox-go-7 1264 1680 gray16 0
boox-go-color-7 1264 1680 color 0
boox-palma-2-pro 824 1648 color 0
tolino-shine 1072 1448 gray16 500
tolino-shine-color 1072 1448 color 500
tolino-vision-color 1264 1680 color 500
tolino-epos-3 1440 1920 gray16 500
"""
#: Levels of gray that a panel shows, and the limit of a chapter without one of its own.
LEVELS = {"gray4": 4, "gray16": 16, "color": 16}
DEFAULT_CHAPTER_KB = 200


def builtin(spark: SparkSession) -> DataFrame:
    rows = []
    for i, line in enumerate(BUILTIN.split("\n")[1:-1]):
        name, w, h, panel, kb = line.split()
        rows.append((i, name, int(w) or None, int(h) or None, panel, LEVELS.get(panel), int(kb) or None))
    return spark.createDataFrame(rows, "ord int, name string, width int, height int, panel string, levels int, chapter_kb int")


@dataclass(frozen=True)
class Caps:
    """What a device can show; None means no limit."""

    width: int | None = None
    height: int | None = None
    panel: str = "none"
    max_width: int | None = None
    max_height: int | None = None
    image_bytes: int | None = None
    cover_bytes: int | None = None
    css_bytes: int | None = None
    css_rules: int | None = None
    svg: bool = True
    progressive: bool = True
    formats: tuple[str, ...] = ("jpeg", "png", "gif", "webp", "tiff", "bmp")

    @property
    def levels(self) -> int | None:
        return LEVELS.get(self.panel)

    @property
    def is_color(self) -> bool:
        return self.panel == "color"


# fixed values: the switches, and the presets of a plain repair, of a modern reader and of a small device
FEATURES = ("dedupe_ids", "styles", "boxes", "tables", "lists", "code", "links", "anchors", "text", "fonts", "css", "sanitize_css", "remap_colors", "images", "svg", "split")
REPAIR = frozenset(("dedupe_ids", "links", "text"))
MODERN = REPAIR | frozenset(("images", "svg"))
SMALL = frozenset(FEATURES) - {"sanitize_css", "remap_colors"}
_SMALL_CAPS = Caps(480, 800, "gray4", 480, 730, 100 * 1024, 127 * 1024, 128 * 1024, 1500, svg=False, progressive=False, formats=("jpeg", "png", "gif", "bmp"))
ALIASES = {"none": "epub", "repair": "epub"}


@dataclass(frozen=True)
class Options:
    """Everything a run needs."""

    profile: str = "epub"
    caps: Caps = field(default_factory=Caps)
    features: frozenset[str] = REPAIR
    quality: int = 82
    table_mode: str = "text"
    chapter_kb: int = DEFAULT_CHAPTER_KB
    appendix: str = "fitted"
    rules: tuple[Rule, ...] = ()

    def on(self, feature: str) -> bool:
        return feature in self.features

    @property
    def remaps(self) -> bool:
        """Colours are remapped only for panels that show none."""
        return self.on("remap_colors") and not self.caps.is_color


def _layer(name: str) -> dict:
    rows = {line.split()[0]: line.split() for line in BUILTIN.split("\n")[1:-1]}
    key = ALIASES.get(name.lower(), name.lower())
    if key not in rows:
        raise KeyError(f"no such profile: {name}")
    _, w, h, panel, kb = rows[key]
    small = panel == "gray4"
    caps = replace(_SMALL_CAPS, width=int(w), height=int(h), max_width=int(w), max_height=int(h) - 70) if small else Caps(int(w) or None, int(h) or None, panel, int(w) or None, int(h) or None)
    return {"profile": key, "caps": asdict(caps), "features": {f: True for f in (SMALL if small else REPAIR if key == "epub" else MODERN)}, "quality": 82 if small or key == "epub" else 85, "chapter_kb": int(kb) or DEFAULT_CHAPTER_KB}


def load_layer(spec: str) -> dict:
    """A layer: a built-in profile by name or alias, in any case, or a JSON document by path. Unknown keys are refused at every level."""
    if not spec.endswith(".json"):
        return _layer(spec)
    with open(spec, encoding="utf-8") as f:
        doc = json.load(f)
    known = {f.name for f in fields(Options)} | {"base"}
    for where, keys, allowed in (("profile", doc, known), ("caps", doc.get("caps") or {}, {f.name for f in fields(Caps)}), ("features", doc.get("features") or {}, set(FEATURES)), *((f"rule {k}", r, {"action", "match", "with", "in"}) for k, r in enumerate(doc.get("rules") or ()))):
        if stray := set(keys) - allowed:
            raise ValueError(f"unknown key in {where}: {', '.join(sorted(stray))}")
    return doc


def compose(specs: list[str | dict], **flags) -> Options:
    """Options from layers in order: the last word wins for every leaf and switch, rules are joined; a flag that is given wins over all."""
    out: dict = {"caps": asdict(Caps()), "features": {f: f in REPAIR for f in FEATURES}, "rules": []}
    for spec in specs:
        layer = load_layer(spec) if isinstance(spec, str) else spec
        if base := layer.get("base"):
            layer = {**layer}
            del layer["base"]
            base_layer = load_layer(base)
            specs_below = [base_layer]
        else:
            specs_below = []
        for x in (*specs_below, layer):
            for k, v in x.items():
                if k in ("caps", "features"):
                    out[k] = {**out[k], **{a: b for a, b in v.items() if b is not None}}
                elif k == "rules":
                    out[k] = out[k] + [Rule(r["action"], r["match"], r.get("with") or "", frozenset(r.get("in") or ("text",))) for r in v]
                elif v is not None:
                    out[k] = v
    out.update({k: v for k, v in flags.items() if v is not None})
    caps = out.pop("caps")
    features = out.pop("features")
    on = features if isinstance(features, frozenset) else frozenset(f for f, v in features.items() if v)
    return Options(caps=caps if isinstance(caps, Caps) else Caps(**{**caps, "formats": tuple(caps["formats"])}), features=on, rules=tuple(out.pop("rules")), **out)


def catalogue(spark: SparkSession) -> DataFrame:
    """Built-in profiles in listing order with their switches."""
    rows = [(i, o.profile, o.caps.width, o.caps.height, o.caps.panel, o.caps.levels, o.caps.is_color, o.chapter_kb, o.quality, sorted(o.features)) for i, o in enumerate(compose([line.split()[0]]) for line in BUILTIN.split("\n")[1:-1])]
    return spark.createDataFrame(rows, "ord int, name string, width int, height int, panel string, levels int, is_color boolean, chapter_kb int, quality int, features array<string>")
