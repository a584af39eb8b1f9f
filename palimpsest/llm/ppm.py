"""Language-model scoring by prediction by partial matching over bytes.

Training counts every (ORDER + 1)-byte string of every training document on the
cluster; shorter contexts are the same counts summed by suffix. They form the
context trie: a node per context, with the count, the distinct successors and
the link to its suffix. Escapes follow method C (distinct successors over
distinct plus total) with full symbol exclusion: after an escape the symbols
seen in the longer context are taken out of the shorter one's counts.

Because a string that the trie holds has all its suffixes there too, excluded
sets nest, and each escape step depends on the longer context alone. It is
stored with that context, so a document is scored with one table look-up per
byte, and with a walk down the suffixes only where that fails.

Bounds: the table that scoring workers get holds MAX_NODES of the longest
strings at most, with their probabilities by the whole trie (24 bytes a string
and worker at most): those counted by the least power of two, 2 or more, at
which they fit. All other strings of a text, seen or not, are listed and
scored on the cluster, by joins with the counts of all strings and contexts, so
that the model is the whole trie however large the corpus is. The word
statistics of the base score are exact: the most frequent words, HOT_WORDS at
most, are looked up in a table, all others by a join.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import crc_of_id, materialize, release, salted_join, sliced, text_or_empty

FOLDS, HELD_OUT = 7, 2
ORDER = 5
#: Strings of MAX_ORDER + 1 bytes fit a signed 64-bit number and never meet the mark of an empty slot.
MAX_ORDER = 6
MAX_NODES = 1 << 21
HOT_WORDS = 100_000
#: Words longer than this stand in the hot table by their MD5.
HOT_BYTES = 48
#: Byte that UTF-8 never holds: before a text and, as its last symbol, after it.
EDGE = 0xFF
#: The end of a document among words: white space is never part of a word.
END = b" "
PIECE = 1 << 20
#: Distinct words, and strings, that a counting task holds before it passes them on.
FLUSH_WORDS, FLUSH_STRINGS = 200_000, 800_000
_EMPTY = np.uint64(1 << 63)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(texts: list[bytes], order: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Buffers of about PIECE bytes, and of each the stretches (text, from, to)
    of positions to count or score; ``order`` bytes of context precede each.
    Long texts go on in the next buffer."""
    buffer, parts = bytearray(), []
    for i, text in enumerate(texts):
        body = bytes([EDGE]) * order + text + bytes([EDGE])
        at = order
        while at < len(body):
            upto = min(len(body), at + PIECE)
            start = len(buffer) + order
            buffer += body[at - order : upto]
            parts.append((i, start, start + upto - at))
            at = upto
            if len(buffer) >= PIECE:
                yield bytes(buffer), parts
                buffer, parts = bytearray(), []
    if parts:
        yield bytes(buffer), parts


def strings(buffer: bytes, order: int) -> np.ndarray:
    """The (order + 1)-byte string that ends at each position, as a number."""
    a = np.frombuffer(buffer, np.uint8)
    out = np.zeros(len(a), np.uint64)
    for i in range(order + 1):
        out[i:] |= a[: len(a) - i].astype(np.uint64) << np.uint64(8 * i)
    return out


def give_back() -> None:
    """Memory that is free goes back to the system: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def _counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(ws: Counter, keys: np.ndarray, ns: np.ndarray) -> Iterator[pa.RecordBatch]:
            items = iter(ws.items())
            while part := list(islice(items, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.nulls(len(part), pa.int64()), pa.array([n for _, n in part], pa.int64())], ["word", "string", "n"])
            for lo in range(0, len(keys), 50_000):
                k = keys[lo : lo + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.binary()), pa.array(k), pa.array(ns[lo : lo + 50_000])], ["word", "string", "n"])

        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            texts = [t.lower() for t in batch.column(0).to_pylist()]
            for t in texts:
                words.update(t.split())
                words[END] += 1
                if len(words) > FLUSH_WORDS:
                    yield from rows(words, *none)
                    words = Counter()
            for buffer, parts in pieces(texts, order):
                keys = strings(buffer, order)
                held.append(np.unique(np.concatenate([keys[a:b] for _, a, b in parts]), return_counts=True))
                if sum(len(k) for k, _ in held) > 2 * FLUSH_STRINGS:
                    held = [merged()]
                    if len(held[0][0]) > FLUSH_STRINGS:
                        yield from rows(Counter(), *held[0])
                        held = []
        yield from rows(words, *(merged() if held else none))
        words, held = Counter(), []
        give_back()

    return run


class Table:
    """Open addressing over strings: one probe finds most, or finds that one is not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots, self.values = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.float32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[slot[left]] == _EMPTY
            one, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.slots[one], self.values[one] = keys[put], values[put]
            left = left[self.slots[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value (0 if not)."""
        slot = self._slot(keys)
        got = self.slots[slot]
        hit = got == keys
        out = np.where(hit, self.values[slot], np.float32(0))
        left = np.flatnonzero(~hit & (got != _EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            got = self.slots[slot[left]]
            same = got == keys[left]
            hit[left[same]], out[left[same]] = True, self.values[slot[left[same]]]
            left = left[~same & (got != _EMPTY)]
        return hit, out


def _suffix(c: Column, size: int) -> Column:
    """The last ``size`` bytes of a string."""
    return c.bitwiseAND(F.lit((1 << 8 * size) - 1))


def _small(table: DataFrame, level: int) -> DataFrame:
    """Broadcast up to ``level`` 1: a row per string of two bytes at most, and few keys that all rows share."""
    return F.broadcast(table) if level <= 1 else table


class Nodes:
    """The whole trie as tables. ``strings[i]``: the (i + 1)-byte strings,
    their counts and contexts; ``contexts[i]``: of each i-byte context what
    Trie holds of it."""

    def __init__(self, counts: DataFrame, order: int):
        self.order, self.strings, self.contexts = order, [], []
        levels = [materialize(counts)]
        for i in range(order - 1, -1, -1):
            levels.append(materialize(levels[-1].groupBy(_suffix(F.col("string"), i + 1).alias("string")).agg(F.sum("n").alias("n"))))
        for i, level in enumerate(reversed(levels)):
            level = level.withColumn("ctx", F.shiftrightunsigned("string", 8))
            strings = level
            if i:
                short = self.strings[-1].select(F.col("string").alias("end"), F.col("n").alias("short"))
                level = level.withColumn("end", _suffix(F.col("string"), i)).join(_small(short, i - 1), "end")
            taken = F.sum("short") if i else F.lit(0)
            kinds = level.groupBy("ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), taken.alias("taken"))
            whole = F.log10(F.col("total") + F.col("kinds"))
            own = [whole.alias("whole"), (F.log10("kinds") - whole).alias("top")]
            if i:
                up = self.contexts[-1].select(F.col("ctx").alias("end"), F.col("total").alias("t"), F.col("kinds").alias("k"))
                kinds = kinds.withColumn("end", _suffix(F.col("ctx"), i - 1)).join(_small(up, i - 2), "end")
                fresh = F.col("k") - F.col("kinds")
                below = F.log10(F.greatest(F.col("t") - F.col("taken") + fresh, F.lit(1)))
                own += [below.alias("below"), F.when(fresh > 0, F.log10(F.greatest(fresh, F.lit(1))) - below).otherwise(0.0).alias("skip")]
            else:
                own += [F.lit(0.0).alias("below"), F.lit(0.0).alias("skip")]
            self.strings.append(strings)
            self.contexts.append(materialize(kinds.select("ctx", "total", "kinds", *own)))
        first = self.contexts[0].first()
        self.seen = first["kinds"] if first else 0

    def frequent(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The longest strings seen twice or more, by a threshold of their count
        ``most`` at most, sorted, and their log10 probabilities."""
        longest = self.strings[-1]
        sizes = longest.agg(*[F.count_if(F.col("n") >= 2**i).alias(f"c{i}") for i in range(50)]).first()
        least = next(2**i for i in range(1, 50) if sizes[i] <= most or i == 49)
        found = longest.where(F.col("n") >= least).join(self.contexts[-1].select("ctx", "whole"), "ctx")
        table = found.select("string", (F.log10("n") - F.col("whole")).alias("p")).toArrow()  # most rows of 16 bytes at most
        keys, p = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
        by = np.argsort(keys)
        return keys[by], p[by]

    def log10(self, some: DataFrame) -> DataFrame:
        """``string`` and ``p``, log10 P(last byte | the bytes before it), of the distinct ``string``: Trie._walk by joins."""
        none = F.lit(None).cast("double")
        left, done = some.select("string", F.lit(0.0).alias("p"), none.alias("below"), none.alias("skip")), []
        for i in range(self.order, -1, -1):
            left = left.withColumn("ctx", _suffix(F.shiftrightunsigned("string", 8), i)).withColumn("end", _suffix(F.col("string"), i + 1))
            here = self.contexts[i].select("ctx", "whole", "top", F.col("below").alias("b"), F.col("skip").alias("s"))
            hits = self.strings[i].select(F.col("string").alias("end"), "n")
            left = materialize(left.join(_small(here, i - 1), "ctx", "left").join(_small(hits, i), "end", "left"))
            # by an escape from the longer context its symbols are excluded
            done.append(left.where("n IS NOT NULL").select("string", (F.col("p") + F.log10("n") - F.coalesce("below", "whole")).alias("p")))
            miss = F.col("p") + F.when(F.col("whole").isNull(), 0.0).otherwise(F.coalesce("skip", "top"))
            left = left.where("n IS NULL").select("string", miss.alias("p"), F.col("b").alias("below"), F.col("s").alias("skip"))
        done.append(left.select("string", F.col("p") - math.log10(max(1, 256 - self.seen))))
        out = done[0]
        for d in done[1:]:
            out = out.union(d)
        return out


def _score(shared, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot = shared()
        sent: set[bytes] = set()
        for batch in batches:
            texts = [t.lower() for t in batch.column(1).to_pylist()]
            score, missed = np.zeros(len(texts)), [[] for _ in texts]
            for buffer, parts in pieces(texts, order):
                keys = strings(buffer, order)
                hit, p = known.find(keys)
                logs = np.concatenate([[0.0], np.cumsum(p, dtype=np.float64)])
                for i, a, b in parts:
                    score[i] += logs[b] - logs[a]
                    missed[i].append(keys[a:b][~hit[a:b]])
            cols: list[list] = [[] for _ in range(9)]
            for t, lacking in zip(texts, missed, strict=True):
                words = Counter(t.split())
                mark = xxhash.xxh3_128_digest(t)
                n_known, base, rare, times = 1, hot[END], [], []
                for w, n in words.items():
                    v = hot.get(w)
                    if v is None and len(w) > HOT_BYTES:
                        v = hot.get(b"\0" + hashlib.md5(w).digest())
                    if v is None:
                        rare.append(w)
                        times.append(n)
                    else:
                        n_known += n
                        base += n * v
                if mark in sent:
                    rare, times, lacking = [], [], []
                sent.add(mark)
                rest, of = np.unique(np.concatenate(lacking), return_counts=True) if lacking else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                for c, x in zip(cols, (int.from_bytes(mark[:8], "big", signed=True), int.from_bytes(mark[8:], "big", signed=True), words.total() + 1, n_known, base, rare, times, rest.view(np.int64), of), strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], pa.array(score)], ["doc_id", "m1", "m2", "n_tokens", "known", "base", "rare", "times", "strings", "of", "score"])

    return run


class _Shared:
    """Tables for the workers, opened once in each: the slots where the broadcast lies."""

    _open: dict[str, tuple] = {}

    def __init__(self, spark, keys: np.ndarray, logs: np.ndarray, hot: dict[bytes, float]):
        table = Table(keys, logs)
        self.sent = spark.sparkContext.broadcast((table.slots.tobytes(), table.values.tobytes(), int(table.shift), pickle.dumps(hot, protocol=5)))
        self.key = uuid.uuid4().hex

    def __call__(self):
        if self.key not in _Shared._open:
            _Shared._open.clear()
            slots, values, shift, hot = self.sent.value
            table = Table.__new__(Table)
            table.slots, table.values, table.shift = np.frombuffer(slots, np.uint64), np.frombuffer(values, np.float32), np.uint64(shift)
            _Shared._open[self.key] = table, pickle.loads(hot)
        return _Shared._open[self.key]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, max_nodes: int = MAX_NODES, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the trie's log10 probability of the text, A-Z lower-cased, as
    bytes and an end. A null text is empty, a null id counts as empty in the
    fold's crc32. Equal texts score alike; repeated rows each get a row. Without
    training rows every byte costs log10(256) and no word is known.
    """
    if not 0 < order <= MAX_ORDER:
        raise ValueError(f"contexts of 1 to {MAX_ORDER} bytes, not {order}: a string and its context are one 64-bit number")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("t"), (crc_of_id(id_col) % FOLDS == HELD_OUT).alias("held_out"))
    partial = materialize(rows.where("NOT held_out").select("t").mapInArrow(sliced(_counts(order)), "word binary, string long, n long"))
    words = materialize(partial.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0)).alias("ends")).first()
    total, distinct = sums["n"], sums["v"]
    # the least power of two such that at most hot_words words are counted as often
    sizes = words.agg(*[F.count_if(F.col("n") >= 2**i).alias(f"c{i}") for i in range(50)]).first()
    least = next(2**i for i in range(50) if sizes[i] <= hot_words or i == 49)
    top = words.where(F.col("n") >= least)
    key = F.when(F.length("word") <= HOT_BYTES, F.col("word")).otherwise(F.concat(F.lit(b"\0"), F.unhex(F.md5("word"))))
    table = top.select(key.alias("key"), "n").toArrow().to_pydict()  # hot_words rows of HOT_BYTES bytes at most
    hot = {w: math.log10(n + 1) for w, n in zip(table["key"], table["n"], strict=True)}
    hot[END] = math.log10(sums["ends"] + 1)
    nodes = Nodes(partial.where("string IS NOT NULL").groupBy("string").agg(F.sum("n").alias("n")), order)

    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *T._parse_datatype_string("m1 long, m2 long, n_tokens long, known long, base double, rare array<binary>, times array<long>, strings array<long>, of array<long>, score double").fields])
    release(partial)
    scored = materialize(rows.select("doc_id", "t").mapInArrow(sliced(_score(_Shared(spark, *nodes.frequent(max_nodes), hot), order)), schema))
    # copies scored by different tasks list their words each; one listing of a text counts
    rare = scored.select("m1", "m2", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("m1", "m2", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    rare = rare.dropDuplicates(["word", "m1", "m2"]).join(words.where(F.col("n") > 0), "word")
    found = rare.groupBy("m1", "m2").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    copies = scored.groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("copies"))
    lacking = scored.select("m1", "m2", F.explode(F.arrays_zip("strings", "of")).alias("s")).select("m1", "m2", F.col("s.strings").alias("string"), F.col("s.of").alias("of"))
    lacking = materialize(lacking.dropDuplicates(["string", "m1", "m2"]))
    walked = materialize(nodes.log10(lacking.select("string").distinct()))
    walked = lacking.join(walked, "string").groupBy("m1", "m2").agg(F.sum(F.col("of") * F.col("p")).alias("walked"))
    found = materialize(copies.join(found, ["m1", "m2"], "left").join(walked, ["m1", "m2"], "left"))
    out = salted_join(scored.drop("rare", "times", "strings", "of"), found, ["m1", "m2"], "copies", scored.count(), ["doc_id"])
    known_end = 1 if total else 0
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + distinct + 1)
    return out.select("doc_id", (crc_of_id("doc_id") % FOLDS == HELD_OUT).alias("held_out"), "n_tokens", (F.col("known") - (1 - known_end) + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("walked", F.lit(0.0))).alias("score"))
