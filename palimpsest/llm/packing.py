"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A document is cut into full sequences and a rest. Class k holds the pieces of
a length in (capacity / (k + 1), capacity / k]; a bin of class k takes exactly
k pieces, so bins are filled by counting, without looking at lengths. A rest
that would waste more than ``SLACK`` of its own length in its class gives a
piece of the next class's exact length first, and goes on with what is left.

Bins are numbered by the piece's rank in its class: an offset of its cell plus
its rank there (``running``), so workers fill bins independently. The pieces
over after the last whole bin of each class are under the sum of k over the
classes, some 15,000 at most for 2,048 whatever the corpus holds; they share
bins by first fit, largest first, in one task.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, running, sliced, text_or_empty

CAPACITY = 2_048
END_ID = 1
#: A rest stays whole if it wastes at most this share of its length, or is shorter than SHORT.
SLACK, SHORT = 0.03, 64
#: Words whose ids a worker remembers, and the most bytes of one of them.
MEMORY, MEMORY_WORD = 600_000, 64
#: Fixed value: the pre-tokenizer pattern of the word-level byte-pair vocabularies that ``WordIds`` knows.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n ids, in order."""
    out = [(capacity, 1)] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if n < SHORT or capacity / k - n <= SLACK * n:
            out.append((n, k))
            break
        piece = capacity // (k + 1)
        out.append((piece, k + 1))
        n -= piece
    return out


class WordIds(dict):
    """White-space word (bytes) -> its token ids as little-endian 32-bit bytes.

    Made for vocabularies whose pre-tokenizer drops white space: no token
    crosses a word's border there, so the ids of a text are those of its words
    in turn. ``of`` encodes any other vocabulary text by text. Words that are
    letters with punctuation after them go straight to the merge table; all
    others through the whole tokenizer. Holds MEMORY words and forgets them
    all when full.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, steps = told["model"], (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = model["type"] == "BPE" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True and steps[0].get("pattern") == {"Regex": WORD_PATTERN}
        self.by_word = self.by_word and [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.stems: dict[str, bytes] = {}
        if self.by_word:
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.bpe = BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"])
            # byte -> the printable character that stands for it in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = (b for b in range(256) if b not in plain)
            self.shown = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def run(self, letters: str) -> bytes:
        """Of one pre-token."""
        found = self.stems.get(letters)
        if found is None:
            shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.shown)
            found = self.stems[letters] = array("I", [t.id for t in self.bpe.tokenize(shown)]).tobytes()
        return found

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        low = text.lower() if text.isascii() or "Σ" not in text else ""
        stem = low.rstrip(".,;:!?")
        if stem.isalpha() and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            found = self.run(stem) + self.run(low[len(stem) :]) if len(stem) < len(low) else self.run(stem)
        else:
            found = self.whole(text)
        if len(word) <= MEMORY_WORD:
            if len(self) >= MEMORY or len(self.stems) >= MEMORY:
                self.clear()
                self.stems.clear()
            self[word] = found
        return found

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if self.by_word else self.whole(text.decode())


_loaded: dict[str, WordIds] = {}
assert array("I").itemsize == 4 and sys.byteorder == "little"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ids = _loaded.get(path) or _loaded.setdefault(path, WordIds(path))
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                coded = ids.of(text) + end
                n, at = len(coded) // 4, 0
                mark = xxhash.xxh64(coded, seed=42)
                mark.update(str(i).encode())
                h = mark.intdigest()
                for length, k in cuts(n, capacity):
                    key = (h + at * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
                    out.append((i, at, length, zlib.crc32(coded[4 * at : 4 * (at + length)]), n, k, key - (1 << 64) if key >> 63 else key))
                    at += length
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 4, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "h"])

    return run


def _first_fit(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "h", "doc_id", "start"], ascending=[False, True, True, True], kind="stable")
        room: list[int] = []
        at = []
        for n in pdf["length"]:
            b = next((b for b, r in enumerate(room) if r >= n), len(room))
            if b == len(room):
                room.append(capacity)
            room[b] -= n
            at.append(b)
        return pdf.assign(sequence_id=pdf["sequence_id"] + at, r=range(len(at)))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are documents of
    their own. Sequence ids are gapless from 0; within one, offsets are too.
    An empty table gives no rows. Pieces alike in every value (from repeated
    rows) are interchangeable.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("t"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *T._parse_datatype_string("start long, length long, ids_crc32 long, doc_tokens long, k int, h long").fields])
    pieces = materialize(source.mapInArrow(sliced(_pieces(tokenizer_path, capacity)), schema))
    ranked = running(pieces.withColumn("one", F.lit(1)), ["k"], "h", {"r": "one"}, ["doc_id", "start", "length"]).drop("one")

    # one row per class, of which there are under twice the root of the capacity
    classes = pieces.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("bins", F.expr("n div k")).withColumn("all", F.lit(0))
    before = W.partitionBy("all").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    classes = classes.select("k", "bins", F.coalesce(F.sum("bins").over(before), F.lit(0)).alias("first"), F.sum("bins").over(W.partitionBy("all")).alias("whole"))
    placed = materialize(ranked.join(F.broadcast(classes), "k").withColumn("bin", F.expr("r div k")))

    whole = placed.where("bin < bins").withColumn("sequence_id", F.col("first") + F.col("bin"))
    rest = placed.where("bin >= bins").select(*schema.names, "r", F.col("whole").alias("sequence_id"))
    # `whole` is one value, the first free sequence: a single group of a bounded number of rows
    tail = rest.groupBy("sequence_id").applyInPandas(_first_fit(capacity), rest.schema)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "r"]
    both = whole.select(*cols).unionByName(tail.select(*cols))
    offset = F.coalesce(F.sum("length").over(W.partitionBy("sequence_id").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return both.select(*cols[:-1], offset.cast("long").alias("offset"))
