"""Raster pictures in plain numpy: decode PNG, BMP and GIF, encode PNG and baseline JPEG, resize, fit a budget of bytes.

No imaging library is at hand, so pictures in other formats are left as they
are and said to be; Spark's own image source reads them as files.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from bookspark.sources import images
from bookspark.sources.profiles import Caps

# fixed values: quality from which and down to which a JPEG is tried, its step, least quality of covers, the size steps
FLOOR, STEP, COVER_FLOOR, SIZES = 40, 6, 85, (90, 80, 70, 60, 50)
#: Quantisation of the standard at quality 50, in rows.
_QUANT = np.array(
    [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
).reshape(8, 8)
_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class Undecodable(ValueError):
    pass


def _png(data: bytes) -> np.ndarray:
    at, idat, plte, trns, head = 8, [], b"", b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at:at + 8])
        body = data[at + 8:at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            plte = body
        elif kind == b"tRNS":
            trns = body
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[2] != 8 or head[6]:
        raise Undecodable("depth or interlace")
    w, h, _, kind, *_ = head
    bpp = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if bpp is None:
        raise Undecodable("colour type")
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8)
    if raw.size < h * (w * bpp + 1):
        raise Undecodable("short data")
    raw = raw[: h * (w * bpp + 1)].reshape(h, w * bpp + 1)
    out = np.zeros((h, w * bpp), np.uint8)
    above = np.zeros(w * bpp, np.uint8)
    for y in range(h):
        f, line = raw[y, 0], raw[y, 1:].copy()
        if f == 1:
            line = np.add.accumulate(line.reshape(w, bpp), axis=0, dtype=np.uint8).ravel()
        elif f == 2:
            line = line + above
        elif f in (3, 4):
            px, up = line.reshape(w, bpp).astype(int), above.reshape(w, bpp).astype(int)
            left, corner = np.zeros(bpp, int), np.zeros(bpp, int)
            for x in range(w):
                if f == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    pa, pb, pc = abs(p - left), abs(p - up[x]), abs(p - corner)
                    guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up[x], corner))
                left = px[x] = (px[x] + guess) & 255
                corner = up[x]
            line = px.astype(np.uint8).ravel()
        out[y] = above = line
    px = out.reshape(h, w, bpp)
    if kind == 3:
        table = np.frombuffer(plte, np.uint8).reshape(-1, 3)
        alpha = np.full(len(table), 255, np.uint8)
        alpha[: len(trns)] = np.frombuffer(trns, np.uint8)[: len(table)]
        px = np.concatenate([table, alpha[:, None]], axis=1)[px[..., 0]]
    elif kind == 4:
        px = np.concatenate([px[..., :1]] * 3 + [px[..., 1:]], axis=2)
    elif kind == 0:
        return px[..., 0]
    return images.flatten_alpha(px) if px.shape[2] == 4 else px


def _bmp(data: bytes) -> np.ndarray:
    start, = struct.unpack("<I", data[10:14])
    w, h = struct.unpack("<ii", data[18:26])
    bits, packed = struct.unpack("<HI", data[28:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise Undecodable("bits or packing")
    n = bits // 8
    row = (w * n + 3) // 4 * 4
    px = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * n].reshape(abs(h), w, n)[..., 2::-1]
    return px[::-1] if h > 0 else px


def _gif(data: bytes) -> np.ndarray:
    w, h, flags = struct.unpack("<HHB", data[6:11])
    at = 13
    table = np.frombuffer(data, np.uint8, 3 << ((flags & 7) + 1), at).reshape(-1, 3) if flags & 0x80 else None
    at += (3 << ((flags & 7) + 1)) if flags & 0x80 else 0
    while data[at] != 0x2C:
        if data[at] != 0x21:
            raise Undecodable("no frame")
        at += 2
        while data[at]:
            at += data[at] + 1
        at += 1
    x0, y0, fw, fh, flags = struct.unpack("<HHHHB", data[at + 1:at + 10])
    at += 10
    if flags & 0x80:
        table = np.frombuffer(data, np.uint8, 3 << ((flags & 7) + 1), at).reshape(-1, 3)
        at += 3 << ((flags & 7) + 1)
    if flags & 0x40 or table is None:
        raise Undecodable("interlace or no colours")
    size, at, packed = data[at], at + 1, bytearray()
    while data[at]:
        packed += data[at + 1:at + 1 + data[at]]
        at += data[at] + 1
    clear, out, bits, n, width = 1 << size, bytearray(), 0, 0, size + 1
    codes: list[bytes] = []
    last = b""
    for byte in packed:
        bits |= byte << n
        n += 8
        while n >= width:
            c = bits & ((1 << width) - 1)
            bits >>= width
            n -= width
            if c == clear:
                codes, last, width = [bytes([i]) for i in range(clear)] + [b"", b""], b"", size + 1
                continue
            if c == clear + 1 or not codes:
                n = 0
                break
            entry = codes[c] if c < len(codes) else last + last[:1]
            out += entry
            if last and len(codes) < 4096:
                codes.append(last + entry[:1])
                if len(codes) == 1 << width and width < 12:
                    width += 1
            last = entry
    if len(out) < fw * fh:
        raise Undecodable("short data")
    px = np.full((h, w, 3), 255, np.uint8)
    px[y0:y0 + fh, x0:x0 + fw] = table[np.frombuffer(bytes(out[: fw * fh]), np.uint8)].reshape(fh, fw, 3)[: h - y0, : w - x0]
    return px


_DECODE = {b"\x89PNG": _png, b"BM": _bmp, b"GIF8": _gif}


def decode(data: bytes) -> np.ndarray:
    """Gray or RGB pixels on white; of a moving picture the first frame."""
    for magic, one in _DECODE.items():
        if data.startswith(magic):
            try:
                return one(data)
            except (struct.error, zlib.error, IndexError, ValueError) as e:
                raise Undecodable(str(e)) from e
    raise Undecodable("format")


def luma(px: np.ndarray) -> np.ndarray:
    return px if px.ndim == 2 else ((px.astype(np.int64) @ np.array([2126, 7152, 722]) + 5000) // 10000).astype(np.uint8)


def encode_png(px: np.ndarray) -> bytes:
    """Lines by the filter with the least sum of differences, packed as tightly as zlib can."""
    h, w = px.shape[:2]
    flat = px.reshape(h, -1).astype(np.int16)
    bpp = flat.shape[1] // w
    left = np.pad(flat, ((0, 0), (bpp, 0)))[:, :-bpp]
    up = np.pad(flat, ((1, 0), (0, 0)))[:-1]
    tries = np.stack([flat, flat - left, flat - up]).astype(np.uint8)
    cost = np.abs(tries.astype(np.int8).astype(np.int32)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.concatenate([best[:, None].astype(np.uint8), tries[best, np.arange(h)]], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if px.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + chunk(b"IEND", b"")


def _code_lengths(count: Counter) -> dict[int, int]:
    """Lengths of a prefix code of at most sixteen bits, of which the code of ones stays free."""
    import heapq

    heap = [(n, s, (s,)) for s, n in count.items()] + [(0, 256, (256,))]
    heapq.heapify(heap)
    length = dict.fromkeys([*count, 256], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a[2], *b[2]):
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    bits = [0] * (max(length.values()) + 2)
    for v in length.values():
        bits[v] += 1
    for i in range(len(bits) - 1, 16, -1):  # the usual shortening: pairs of the longest hang below a shorter one
        while bits[i] > 0:
            j = i - 2
            while bits[j] == 0:
                j -= 1
            bits[i] -= 2
            bits[i - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    last = max(i for i, n in enumerate(bits) if n)
    bits[last] -= 1  # the free code
    order = sorted(count, key=lambda s: (length[s], s))
    out, at = {}, 0
    for i in range(1, min(17, len(bits))):
        for s in order[at:at + bits[i]]:
            out[s] = i
        at += bits[i]
    return out


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    code, prev, out = 0, 0, {}
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - prev
        out[s], prev = (code, n), n
        code += 1
    return out


def encode_jpeg(px: np.ndarray, quality: int) -> bytes:
    """A baseline JPEG, gray or colour without subsampling; its codes are made for the picture."""
    h, w = px.shape[:2]
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    quant = np.clip((_QUANT * scale + 50) // 100, 1, 255)
    planes = [px.astype(float)] if px.ndim == 2 else list(np.moveaxis(px.astype(float) @ np.array([[0.299, -0.168736, 0.5], [0.587, -0.331264, -0.418688], [0.114, 0.5, -0.081312]]) + [0, 128, 128], 2, 0))
    blocks = []
    for p in planes:
        q = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
        b = q.reshape(q.shape[0] // 8, 8, q.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        blocks.append(np.rint(_DCT @ b @ _DCT.T / quant).astype(int).reshape(-1, 64)[:, _ZIGZAG])
    symbols: list[tuple[int, int, int, int]] = []  # table, symbol, bits, number of bits
    before = [0] * len(planes)
    for k in range(len(blocks[0])):
        for c, bl in enumerate(blocks):
            z = bl[k]
            diff, before[c] = int(z[0]) - before[c], int(z[0])
            n = abs(diff).bit_length()
            symbols.append((0, n, diff if diff >= 0 else diff + (1 << n) - 1, n))
            at = 0
            for i in np.flatnonzero(z[1:]) + 1:
                run = int(i) - at - 1
                while run > 15:
                    symbols.append((1, 0xF0, 0, 0))
                    run -= 16
                v = int(z[i])
                n = abs(v).bit_length()
                symbols.append((1, run << 4 | n, v if v >= 0 else v + (1 << n) - 1, n))
                at = int(i)
            if at < 63:
                symbols.append((1, 0, 0, 0))
    tables = [_code_lengths(Counter(s for t, s, *_ in symbols if t == k) or Counter([0])) for k in (0, 1)]
    codes = [_codes(t) for t in tables]
    bits = "".join(format(codes[t][s][0], f"0{codes[t][s][1]}b") + (format(v, f"0{n}b") if n else "") for t, s, v, n in symbols)
    bits += "1" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00") if bits else b""

    def segment(marker: int, content: bytes) -> bytes:
        return bytes([0xFF, marker]) + struct.pack(">H", len(content) + 2) + content

    n = len(planes)
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, b"\0" + quant.ravel()[_ZIGZAG].astype(np.uint8).tobytes())
    out += segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(n)))
    for k, t in enumerate(tables):
        order = sorted(t, key=lambda s: (t[s], s))  # noqa: B023
        out += segment(0xC4, bytes([k << 4]) + bytes(sum(1 for s in t.values() if s == i) for i in range(1, 17)) + bytes(order))
    return out + segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + b"\0\x3f\0") + body + b"\xff\xd9"


def _weights(n_in: int, n_out: int, lobes: int = 3) -> np.ndarray:
    """Weights of a windowed sinc, wider where the picture shrinks."""
    scale = n_in / n_out
    wide = max(1.0, scale)
    at = (np.arange(n_out)[:, None] + 0.5) * scale - 0.5 - np.arange(n_in)[None, :]
    x = at / wide
    k = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return k / k.sum(axis=1, keepdims=True)


def resize(px: np.ndarray, w: int, h: int) -> np.ndarray:
    """The picture in another size, its colour space kept."""
    if px.shape[:2] == (h, w):
        return px
    p = px.astype(float) if px.ndim == 3 else px.astype(float)[..., None]
    p = np.einsum("yi,ijc->yjc", _weights(px.shape[0], h), p)
    p = np.einsum("xj,yjc->yxc", _weights(px.shape[1], w), p)
    out = np.clip(np.rint(p), 0, 255).astype(np.uint8)
    return out if px.ndim == 3 else out[..., 0]


def fit_budget(px: np.ndarray, quality: int, budget: int | None, floor: int = FLOOR) -> tuple[bytes, int, int, int, bool]:
    """(JPEG, width, height, quality, too large): quality falls by steps to its floor, then the size to a half; where nothing fits, the smallest, the first of equals."""
    h, w = px.shape[:2]
    tries: list[tuple[int, int, tuple]] = []

    def attempt(p: np.ndarray, q: int) -> tuple | None:
        data = encode_jpeg(p, q)
        got = (data, p.shape[1], p.shape[0], q)
        tries.append((len(data), len(tries), got))
        return got if budget is None or len(data) <= budget else None

    q = max(quality, floor)
    while True:
        if got := attempt(px, q):
            return (*got, False)
        if q <= floor:
            break
        q = max(q - STEP, floor)
    for percent in SIZES:
        if got := attempt(resize(px, max(w * percent // 100, w // 2, 1), max(h * percent // 100, h // 2, 1)), floor):
            return (*got, False)
    return (*min(tries)[2], True)


def tile_rows(height: int, screen: int, overlap: float = 0.1) -> list[tuple[int, int]]:
    """Rows of each tile of a picture more than two screens high; none otherwise."""
    if height <= 2 * screen:
        return []
    step = max(1, int(screen * (1 - overlap)))
    starts = list(range(0, max(1, height - (screen - step)), step))
    return [(a, min(height, a + screen)) for a in starts]


def process(data: bytes, caps: Caps, quality: int, cover: bool = False, tiles: bool = False) -> list[tuple]:
    """[(data, extension, width, height, note)] of one picture, several if it is cut into tiles; the data None where it stays as it is."""
    try:
        px = decode(data)
    except Undecodable as e:
        return [(None, None, None, None, f"left as it is: {e}")]
    gray = not caps.is_color and caps.panel != "none" or px.ndim == 2
    px = luma(px) if gray else px
    art = images.line_art(luma(px))
    if gray and not art:
        px = images.autocontrast(px)
    h, w = px.shape[:2]
    box_w, box_h = caps.max_width or w, caps.max_height or h
    budget = caps.cover_bytes if cover else caps.image_bytes
    cut: list[np.ndarray] = []
    if tiles and not cover and caps.height:
        wide = resize(px, *images.fit_box(w, h, box_w, 2**31))
        cut = [wide[a:z] for a, z in tile_rows(wide.shape[0], caps.height)]
    out = []
    for p in cut or [resize(px, *images.fit_box(w, h, box_w, box_h))]:
        if art and (png := encode_png(p)) and (budget is None or len(png) <= budget):
            out.append((png, "png", p.shape[1], p.shape[0], "line art"))
            continue
        q = min(95, quality + 6) if art else quality
        jpeg, pw, ph, q, over = fit_budget(p, q, budget, COVER_FLOOR if cover else FLOOR)
        out.append((jpeg, "jpg", pw, ph, f"quality {q}" + (", above the budget" if over else "")))
    return out


PROCESSED = "book_id string, path string, tile int, new_path string, data binary, width int, height int, note string"


def process_images(entries: DataFrame, caps: Caps, quality: int = 82, tiles: bool = False) -> DataFrame:
    """Pictures (book_id, path, data, cover) made fit for a device; one row for each, or for each tile; data is null where a picture stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for book, path, data, cover in pdf.itertuples(index=False):
                got = process(bytes(data), caps, quality, bool(cover), tiles)
                stem = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
                rows += [(book, path, k, f"{stem}{'' if len(got) == 1 else f'-{k + 1}'}.{ext}" if new is not None else path, new, w, h, note) for k, (new, ext, w, h, note) in enumerate(got)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROCESSED.split(", ")]).astype({"width": "Int32", "height": "Int32"})

    return entries.where("data is not null").select("book_id", "path", "data", "cover").mapInPandas(run, PROCESSED)
