"""TIFF columns: write payloads as TIFF files, walk image directories, decode
PackBits, LZW or deflate strips and tiles, undo predictors, one row per page.

Written from the TIFF 6.0 specification. Files are per row, pages of a file in
the order of its directories; nothing is shuffled and no file leaves its row.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import sliced, text_or_empty

UNIT = 192
#: Rows of samples on a page that the writer makes, at most (so a page holds 96 KiB).
PAGE_ROWS = 512
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
#: Fixed values of the format: tag numbers, and bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}

#: Bytes of a page that is read, at most, and bytes that a stored byte of each compression can stand for.
MAX_PAGE = 1 << 28
MOST_PER_BYTE = {NONE: 1, PACKBITS: 64, LZW: 2_800, DEFLATE: 1_040, OLD_DEFLATE: 1_040}
#: Samples that a batch of pages holds about.
BATCH_BYTES = 1 << 22

_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


class TiffError(ValueError):
    pass


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(upto: int) -> None:
        for i in range(at, upto, 128):
            part = data[i : min(upto, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        literal(m.start())
        at = m.end()
        out.append(257 - (at - m.start()))
        out.append(data[at - 1])
    literal(len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out[:size])


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears, 257 ends."""
    acc, bits, out = 0, 0, bytearray()
    width, table, size, word = 9, {bytes((i,)): i for i in range(256)}, 258, b""

    def put(code: int) -> None:
        nonlocal acc, bits
        acc = acc << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits)
            acc &= (1 << bits) - 1

    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        word = data[i : i + 1]
        if size == 4095:
            put(256)
            width, table, size = 9, {bytes((i,)): i for i in range(256)}, 258
        elif size >= 1 << width:
            width += 1
    if word:
        put(table[word])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out: list[bytes] = []
    made, acc, bits, width = 0, 0, 0, 9
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, last = first[:], b""
    for byte in data:
        acc = acc << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257 or made >= size:
            break
        if code == 256:
            table, width, last = first[:], 9, b""
            continue
        if not last:
            word = table[code] if code < 256 else b""
            if not word:
                raise TiffError("an LZW strip starts with no literal")
        else:
            if code < len(table):
                word = table[code]
            elif code == len(table):
                word = last + last[:1]
            else:
                raise TiffError("an LZW code is out of turn")
            table.append(last + word[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(word)
        made += len(word)
        last = word
    return b"".join(out)[:size]


_PACK = {NONE: lambda b: b, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 6)}


def _inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise TiffError(str(e)) from e


_UNPACK = {NONE: lambda b, n: b[:n], PACKBITS: unpackbits, LZW: unlzw, DEFLATE: _inflate, OLD_DEFLATE: _inflate}


def write_page(samples: np.ndarray, compression: int, predictor: int, tile: tuple[int, int] | None, strip_rows: int) -> tuple[list[tuple[int, int, list[int]]], list[bytes]]:
    """The fields (tag, type, values) of one page without offsets, and its
    compressed strips or tiles. ``samples``: (rows, columns, samples) uint8."""
    rows, cols, depth = samples.shape
    chunks = []
    if tile:
        high, wide = tile
        for y in range(0, rows, high):
            for x in range(0, cols, wide):
                part = np.zeros((high, wide, depth), np.uint8)
                got = samples[y : y + high, x : x + wide]
                part[: got.shape[0], : got.shape[1]] = got
                chunks.append(part)
    else:
        chunks = [samples[y : y + strip_rows] for y in range(0, rows, strip_rows)]
    packed = []
    for part in chunks:
        if predictor == 2:
            coded = part.copy()
            coded[:, 1:] -= part[:, :-1]
            part = coded
        packed.append(_PACK[compression](part.tobytes()))
    fields = [(WIDTH, 4, [cols]), (HEIGHT, 4, [rows]), (BITS, 3, [8] * depth), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if depth == 3 else 1]), (SAMPLES, 3, [depth]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
    sizes = [len(x) for x in packed]
    if tile:
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_BYTES, 4, sizes)]
    else:
        fields += [(ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_BYTES, 4, sizes)]
    return fields, packed


def write_tiff(pages: list[tuple[list[tuple[int, int, list[int]]], list[bytes]]]) -> bytes:
    """A little-endian file of the given pages, each followed by its directory."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for fields, chunks in pages:
        offsets = []
        for c in chunks:
            offsets.append(len(out))
            out += c + b"\0" * (len(c) % 2)
        tag = TILE_OFFSETS if any(f[0] == TILE_BYTES for f in fields) else STRIP_OFFSETS
        entries = bytearray()
        for t, kind, values in sorted([*fields, (tag, 4, offsets)]):
            raw = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
            if len(raw) > 4:
                entries += struct.pack("<HHII", t, kind, len(values), len(out))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                entries += struct.pack("<HHI", t, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries) // 12) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_tiff(data: bytes) -> Iterator[dict]:
    """The pages of a file: page, width, height, channels, compression,
    predictor, layout ('strips' or 'tiles'), samples (bytes in row order).
    8-bit samples, chunky; either byte order; directories may lie anywhere but
    are not followed twice. Whatever is wrong with a file is a TiffError."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            tags = {}
            n = struct.unpack_from(order + "H", data, at)[0]
            for i in range(n):
                t, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind in FIELD:
                    if count > len(data):
                        raise TiffError(f"field {t} has {count} values in a file of {len(data)} bytes")
                    form = f"{order}{count}{FIELD[kind]}"
                    where = at + 10 + 12 * i
                    if struct.calcsize(form) > 4:
                        where = struct.unpack_from(order + "I", data, where)[0]
                    tags[t] = struct.unpack_from(form, data, where)
            following = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
            page = _page(data, tags, len(seen) - 1)
        except TiffError:
            raise
        except (struct.error, LookupError, ValueError, ArithmeticError, MemoryError) as e:
            raise TiffError(f"a directory is broken: {e!r}") from e
        yield page
        at = following


def _page(data: bytes, tags: dict[int, tuple], number: int) -> dict:
    cols, rows = tags[WIDTH][0], tags[HEIGHT][0]
    depth, how, predictor = tags.get(SAMPLES, (1,))[0], tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
    if how not in _UNPACK or predictor not in (1, 2) or set(tags.get(BITS, (1,))) != {8} or (depth > 1 and tags.get(PLANAR, (1,))[0] != 1):
        raise TiffError("only 8-bit chunky samples without or with PackBits, LZW or deflate are read")
    tiled = TILE_OFFSETS in tags
    if tiled:
        wide, high, offsets, sizes = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        wide, high, offsets, sizes = cols, min(rows, tags.get(ROWS_PER_STRIP, (rows,))[0]), tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    if min(cols, rows, depth, wide, high) < 1:
        raise TiffError(f"a page of {cols} x {rows} x {depth} in parts of {wide} x {high}")
    across, down = -(-cols // wide), -(-rows // high)
    if not len(offsets) == len(sizes) == across * down:
        raise TiffError(f"{len(offsets)} offsets and {len(sizes)} sizes for {across * down} strips or tiles")
    if any(o < 0 or n < 0 or o + n > len(data) for o, n in zip(offsets, sizes, strict=True)):
        raise TiffError("a strip or tile lies outside the file")
    # what the parts can hold, before anything of the page's size is made
    whole = (across * wide if tiled else cols) * (down * high if tiled else rows) * depth
    if whole > MAX_PAGE or whole > MOST_PER_BYTE[how] * (sum(sizes) + 1):
        raise TiffError(f"{sum(sizes)} stored bytes are no page of {whole}")
    image = np.zeros((rows, cols, depth), np.uint8)
    for i, (o, n) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = i // across * high, i % across * wide
        part_rows = high if tiled else min(high, rows - y)
        size = part_rows * wide * depth
        raw = _UNPACK[how](data[o : o + n], size)
        if len(raw) != size:
            raise TiffError(f"a strip or tile has {len(raw)} of {size} bytes")
        part = np.frombuffer(raw, np.uint8).reshape(part_rows, wide, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        got = image[y : y + high, x : x + wide]
        got[...] = part[: got.shape[0], : got.shape[1]]
    return {"page": number, "width": cols, "height": rows, "channels": depth, "compression": NAMES[how], "predictor": predictor, "layout": "tiles" if tiled else "strips", "samples": image.tobytes()}


def store_payload(payload: bytes) -> bytes:
    """A payload of a positive multiple of 192 bytes as a TIFF file: rows of 192
    grey or 64 RGB samples, PAGE_ROWS rows a page. How a page is stored
    (deflate, PackBits or LZW; strips or tiles; predictor or not) follows from
    the page's own crc32, so equal payloads give equal files."""
    pages = []
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    for y in range(0, len(rows), PAGE_ROWS):
        part = rows[y : y + PAGE_ROWS]
        pick = zlib.crc32(part.tobytes())
        how = (DEFLATE, DEFLATE, PACKBITS, LZW, DEFLATE, DEFLATE, PACKBITS, DEFLATE)[pick % 8]
        depth = 3 if pick >> 3 & 1 else 1
        pages.append(write_page(part.reshape(len(part), UNIT // depth, depth), how, 1 + (pick >> 4 & 1), (32, 64) if pick >> 5 & 1 else None, 64))
    return write_tiff(pages)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, media = [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            sizes.append(len(text))
            media.append(store_payload(text + b" " * (-len(text) % UNIT or (0 if text else UNIT))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [*batch.schema.names[:-1], "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every whole text (null: empty) as a TIFF file."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("t"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *T._parse_datatype_string("n_bytes long, media binary").fields])
    return rows.mapInArrow(sliced(_store), schema)


PAGE = "page int, width int, height int, channels int, compression string, predictor int, layout string, samples binary, error string"
_NO_PAGE = dict.fromkeys(("page", "width", "height", "channels", "compression", "predictor", "layout", "samples"))


def _read_all(data: bytes | None) -> Iterator[dict]:
    if data is None:
        return
    number = 0
    try:
        for p in read_tiff(data):
            number += 1
            yield {**p, "error": None}
    except TiffError as e:
        yield {**_NO_PAGE, "page": number, "error": str(e)}


def tiff_pages(files: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page, with the columns of ``files`` (but ``media_col``) and
    PAGE; input columns named like one of these give way. Pages of a file follow
    each other in its order.

    A null file has no rows. A broken file gives the pages before the fault and
    one row whose ``error`` says what it is, and never stops the others; a page
    of more than MAX_PAGE bytes, or of more than its stored bytes can hold, is a
    fault found before it is unpacked. Repeated files are read each.
    """
    fields = T._parse_datatype_string(PAGE).fields
    own = {f.name for f in fields}
    keep = [c for c in files.columns if c != media_col and c not in own]
    rows = files.select(*keep, F.col(media_col).cast("binary").alias("__p_media"))
    kinds = pa.schema([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("layout", pa.string()), ("samples", pa.binary()), ("error", pa.string())])

    def made(few: pa.RecordBatch, at: list[int], pages: list[dict]) -> pa.RecordBatch:
        kept = few.select(few.schema.names[:-1]).take(pa.array(at, pa.int64()))
        new = pa.RecordBatch.from_pylist(pages, schema=kinds)
        return pa.RecordBatch.from_arrays([*kept.columns, *new.columns], [*kept.schema.names, *kinds.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in batches:
            at, pages, held = [], [], 0
            for i in range(few.num_rows):
                for p in _read_all(few.column(few.num_columns - 1)[i].as_py()):
                    at.append(i)
                    pages.append(p)
                    held += len(p["samples"] or b"")
                    if held > BATCH_BYTES:
                        yield made(few, at, pages)
                        at, pages, held = [], [], 0
            yield made(few, at, pages)

    return rows.mapInArrow(sliced(run), T.StructType([*[files.schema[c] for c in keep], *fields]))


DIGEST = "doc_id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"


class _Payload:
    """What is known of a file's samples after some of its pages."""

    def __init__(self, first: tuple):
        self.first, self.digest, self.size, self.tail, self.hist, self.ways, self.pages = first, hashlib.sha256(), 0, b"", np.zeros(256, np.int64), set(), 0

    def add(self, samples: bytes, way: str) -> None:
        self.digest.update(samples)
        self.size += len(samples)
        self.tail = (self.tail + samples)[-16:]
        self.hist += np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
        self.ways.add(way)
        self.pages += 1

    def row(self) -> tuple:
        v = np.arange(256)
        mean = int((self.hist * v).sum()) / self.size
        dev = max(0.0, int((self.hist * v * v).sum()) / self.size - mean * mean) ** 0.5
        share = self.hist[self.hist > 0] / self.size
        feature = f"mean={mean:.6f};std={dev:.6f};entropy={-(share * np.log2(share)).sum():.6f};distinct={len(share)};pages={self.pages};stored={'+'.join(sorted(self.ways))}"
        i, n, media_bytes, media_sha256 = self.first
        return i, n, self.size, self.digest.hexdigest(), zlib.crc32(self.tail), media_bytes, media_sha256, feature, self.pages


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pages, those of a file one after the other, to a row per file."""
    kinds: list = []
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages"]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    last, open_ = None, None
    for batch in batches:
        kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        out = []
        for i, n, size, sha, file, page, how, predictor, layout, samples, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if error:
                raise TiffError(f"page {page} of {i!r} does not read back: {error}")
            if file != last:
                if open_:
                    out.append(open_.row())
                last, open_ = file, _Payload((i, n, size, sha))
            open_.add(samples, f"{how}/{layout}/{predictor}")
        if out:
            yield made(out)
    if open_:
        yield made([open_.row()])


def digest_media(stored: DataFrame) -> DataFrame:
    """The digest of each stored file (doc_id, n_bytes, media), from its rows of
    ``tiff_pages``: the payload's size and hashes, and the statistics of its
    samples. The pages of a file follow each other within its partition, so
    they are put together without a shuffle. A file that doesn't read back
    stops the job."""
    named = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.monotonically_increasing_id().alias("file"), "media")
    pages = tiff_pages(named).select("doc_id", "n_bytes", "media_bytes", "media_sha256", "file", "page", "compression", "predictor", "layout", "samples", "error")
    return pages.mapInArrow(_digest, DIGEST.format(id=stored.schema["doc_id"].dataType.simpleString()))
