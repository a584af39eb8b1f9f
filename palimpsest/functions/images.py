"""Images as columns of bytes: pixels, colour histograms and perceptual hashes.

Pixels come from PNG (8 bits, not interlaced) and binary PPM/PGM files, which
need no library; anything else gives nulls. All of it is per row, in Arrow UDFs.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 32
#: Pixels of an image that is decoded, at most.
MOST = 1 << 26
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _png(data: bytes) -> np.ndarray:
    at, head, palette, packed = 8, None, None, []
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
    if head is None or head[2] != 8 or head[6] or head[3] not in _CHANNELS or not 0 < head[0] * head[1] <= MOST:
        raise ValueError("not an 8-bit PNG in one pass")
    wide, high, depth = head[0], head[1], _CHANNELS[head[3]]
    raw = zlib.decompressobj().decompress(b"".join(packed), high * (wide * depth + 1))
    lines = np.frombuffer(raw, np.uint8).reshape(high, wide * depth + 1)
    out = np.zeros((high, wide * depth), np.uint8)
    above = np.zeros(wide * depth, np.uint8)
    for y in range(high):
        kind, line = lines[y, 0], lines[y, 1:].copy()
        if kind == 1:
            line = np.cumsum(line.reshape(wide, depth), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            for x in range(len(line)):
                a, b = (int(line[x - depth]) if x >= depth else 0), int(above[x])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = int(above[x - depth]) if x >= depth else 0
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (int(line[x]) + guess) & 255
        out[y] = above = line
    pixels = out.reshape(high, wide, depth)
    if head[3] == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if depth < 3 else pixels[..., :3]


def _pnm(data: bytes) -> np.ndarray:
    words, at = [], 0
    while len(words) < 4:
        while data[at : at + 1].isspace():
            at += 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
        else:
            words.append(data[at:end])
            at = end
    depth = {b"P5": 1, b"P6": 3}[words[0]]
    wide, high = int(words[1]), int(words[2])
    if int(words[3]) != 255 or not 0 < wide * high <= MOST:
        raise ValueError("not an 8-bit PPM or PGM")
    pixels = np.frombuffer(data, np.uint8, wide * high * depth, at + 1).reshape(high, wide, depth)
    return np.repeat(pixels, 3, axis=2) if depth == 1 else pixels


def pixels(data: bytes | None) -> np.ndarray | None:
    """(rows, columns, RGB), or None for what cannot be read."""
    try:
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        return _pnm(data) if data and data[:2] in (b"P5", b"P6") else None
    except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error):
        return None


def histogram(image: np.ndarray) -> list[float]:
    """BINS bins per colour, scaled to length 1."""
    h = np.concatenate([np.histogram(image[..., c], bins=BINS, range=(0, 255))[0] for c in range(3)]).astype(float)
    return (h / (np.linalg.norm(h) or 1.0)).tolist()


def shrunk(image: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Grey means of a grid of patches."""
    grey = image.astype(float) @ np.array([0.299, 0.587, 0.114])
    rows, cols = (np.linspace(0, n, k + 1) for n, k in ((grey.shape[0], high), (grey.shape[1], wide)))
    part = lambda edges, n, i: slice(min(int(edges[i]), n - 1), max(int(edges[i]) + 1, int(np.ceil(edges[i + 1]))))
    return np.array([[grey[part(rows, grey.shape[0], i), part(cols, grey.shape[1], j)].mean() for j in range(wide)] for i in range(high)])


def difference_hash(image: np.ndarray) -> str:
    """64 bits: each of 8 patches in 8 rows is darker than the next, or not."""
    small = shrunk(image, 8, 9)
    return "".join("1" if b > a else "0" for r in small for a, b in zip(r, r[1:], strict=False))


def cosine_hash(image: np.ndarray) -> str:
    """64 bits: the low frequencies of a 32 x 32 cosine transform over their median."""
    small, n = shrunk(image, 32, 32), np.arange(32)
    basis = np.cos(np.pi * (2 * n[None] + 1) * n[:, None] / 64)
    low = (basis @ small @ basis.T)[:8, :8].ravel()
    return "".join("1" if x > np.median(low) else "0" for x in low)


def edge_density(image: np.ndarray) -> float:
    """Share of pixels whose brightness steps by over 32 to the right or down."""
    grey = image.astype(float) @ np.array([0.299, 0.587, 0.114])
    steps = np.zeros(grey.shape, bool)
    steps[:, :-1] |= np.abs(np.diff(grey, axis=1)) > 32
    steps[:-1] |= np.abs(np.diff(grey, axis=0)) > 32
    return float(steps.mean())


def main_colours(image: np.ndarray, k: int = 4, sample: int = 10_000, rounds: int = 10) -> list[str]:
    """k-means of the colours from evenly spread starts, the most frequent first, as hexadecimal."""
    flat = image.reshape(-1, 3)
    flat = flat[:: max(1, len(flat) // sample)].astype(float)
    known = np.unique(flat, axis=0)
    centre = known[np.linspace(0, len(known) - 1, min(k, len(known))).astype(int)]
    for _ in range(rounds):
        part = ((flat[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        centre = np.stack([flat[part == i].mean(axis=0) if (part == i).any() else c for i, c in enumerate(centre)])
    order = np.argsort(-np.bincount(part, minlength=len(centre)), kind="stable")
    return ["#" + "".join(f"{round(x):02x}" for x in centre[i]) for i in order]


FEATURES = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("histogram", T.ArrayType(T.DoubleType())), T.StructField("phash", T.StringType()), T.StructField("dhash", T.StringType()), T.StructField("edges", T.DoubleType()), T.StructField("colours", T.ArrayType(T.StringType()))])


@F.arrow_udf(FEATURES)
def features(files: pa.Array) -> pa.Array:
    """Of each image's bytes: size, histogram, hashes, edge density and main
    colours; null for a null file or one that cannot be read."""

    def one(data: bytes | None) -> dict | None:
        image = pixels(data)
        if image is None:
            return None
        return {"width": image.shape[1], "height": image.shape[0], "histogram": histogram(image), "phash": cosine_hash(image), "dhash": difference_hash(image), "edges": edge_density(image), "colours": main_colours(image)}

    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.float64())), ("phash", pa.string()), ("dhash", pa.string()), ("edges", pa.float64()), ("colours", pa.list_(pa.string()))])
    return pa.array([one(f.as_py()) for f in files], kind)


def hash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two hashes; 64 where one is missing or of another length."""
    bits = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.coalesce(F.when((F.length(a) > 0) & (F.length(a) == F.length(b)), F.aggregate(bits, F.lit(0), lambda s, x: s + x)), F.lit(64))


def hash_similarity(a: Column, b: Column) -> Column:
    """1 - distance / 64; 0 without both."""
    both = (F.length(F.coalesce(a, F.lit(""))) > 0) & (F.length(F.coalesce(b, F.lit(""))) > 0)
    return F.when(both, 1 - hash_distance(a, b) / 64.0).otherwise(0.0)
