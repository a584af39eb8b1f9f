"""SimHash near-duplicates with pivot distance tables.

Fingerprints are made per document (64 bits over word shingles) and copies
collapse to distinct fingerprints, on which all the rest works.

Meeting: two fingerprints at most ``RADIUS`` = 2 bits apart agree on three of
five blocks of bits. Each fingerprint is listed under its ten triples of
blocks (38 or more bits each), so chance meetings stay few at any size.
Pivots: for every fingerprint the distances to ``PIVOTS`` reference
fingerprints are tabled. By the triangle inequality no coordinate of a pair
that links differs by more than the radius; met pairs whose largest coordinate
difference is more are discarded, the survivors verified bit by bit.
Crowds: where more than ``CROWD`` fingerprints share a triple, pairs would grow
with the square. There each fingerprint is listed under itself and its 64
one-bit neighbours instead: those that share an entry are 2 apart at most, any
two that are share one, and an entry holds 65 at most. One link per member to
the smallest member of the entry keeps every connection.

Links are then contracted to components; the answer is joined back to the
documents with frequent fingerprints dealt over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, release, salted_join, sampled, sliced, text_or_empty
from .components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
PIVOTS = 16
CROWD = 64
#: Shingles hashed and counted at a time, so that a text of any length takes bounded memory.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned. Bit i is set if set in over half of the shingles' XXH64; a
    text of fewer words is one shingle, one of none has fingerprint 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return hashed(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - shingle + 1], ends[shingle - 1 :]
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(starts), CHUNK):
        some = [hashed(joined[a:b], SEED) for a, b in zip(starts[lo : lo + CHUNK].tolist(), ends[lo : lo + CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(some, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint as a signed 64-bit number) of every row; null text is empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("t"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(sliced(_fingerprints(shingle)), schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _block_masks() -> list[int]:
    sizes, at, blocks = (13, 13, 13, 13, 12), 0, []
    for n in sizes:
        blocks.append(((1 << n) - 1) << at)
        at += n
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def pivot_distances(fp: Column, pivots: int = PIVOTS) -> list[Column]:
    """Distances to the references, eight to a long of one byte each."""
    refs = [_signed(xxhash.xxh64_intdigest(f"reference {i}".encode(), SEED)) for i in range(pivots)]
    one = [F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("long") for r in refs]
    packed = []
    for i in range(0, pivots, 8):
        total = one[i]
        for j, d in enumerate(one[i + 1 : i + 8], 1):
            total = total.bitwiseOR(F.shiftleft(d, 8 * j))
        packed.append(total)
    return packed


def largest_difference(a: list[Column], b: list[Column]) -> Column:
    byte = lambda x, j: F.shiftright(x, 8 * j).bitwiseAND(F.lit(255))
    return F.greatest(*[F.abs(byte(x, j) - byte(y, j)) for x, y in zip(a, b, strict=True) for j in range(8)])


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) of the distinct fingerprints ``fp`` that connect exactly
    those which a chain of steps of 2 bits or fewer connects."""
    tabled = distinct.select("fp", *[p.alias(f"p{i}") for i, p in enumerate(pivot_distances(F.col("fp")))])
    width = (PIVOTS + 7) // 8
    entry = F.array(*[F.struct(F.lit(i).cast("byte").alias("triple"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(_block_masks())])
    listed = materialize(tabled.select("fp", *[f"p{i}" for i in range(width)], F.explode(entry).alias("e")).select("fp", *[f"p{i}" for i in range(width)], "e.triple", "e.bits"))
    shared = listed.groupBy("triple", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(listed.join(shared, ["triple", "bits"]))
    few = met.where(F.col("n") <= crowd)
    a, b = few.alias("x"), few.alias("y")
    apart = largest_difference([F.col(f"x.p{i}") for i in range(width)], [F.col(f"y.p{i}") for i in range(width)])
    pairs = a.join(b, (F.col("x.triple") == F.col("y.triple")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.fp") < F.col("y.fp")) & (apart <= RADIUS))
    pairs = pairs.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    crowds = met.where(F.col("n") > crowd).select("fp").distinct()
    near = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    entries = crowds.select("fp", F.explode(near).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    least = entries.groupBy("at").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "least")
    stars = entries.join(least, "at").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id: the
    smallest doc_id that links of at most 2 differing bits reach.

    Null and empty texts have fingerprint 0 and link like any other. A null
    doc_id gets its row, and is never a component's id unless all are null.
    Repeated rows each get their row. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    found = materialize(components(links(distinct.select("fp"))).withColumnRenamed("node", "fp"))
    names = found.join(distinct.select("fp", "first"), "fp").groupBy("root").agg(F.min("first").alias("lowest"))
    linked = found.join(names, "root").select("fp", "lowest")
    named = materialize(distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("lowest", "first").alias("component_id")))
    out = salted_join(rows, named, ["fp"], "n", rows.count(), ["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies by the similarity of their word shingles: shingle size and least Jaccard similarity.
COPY_SHINGLE, COPY_SIMILARITY = 5, 0.8
#: Documents whose shingles are counted for the order of prefixes, and the most shingles listed as frequent.
ORDER_DOCS, ORDER_LISTED = 5_000, 1 << 17
#: Texts under one shingle with more pairs of different groups than so many a text are a crowd, compared with CROWD_ROUNDS leaders before all pairs are.
COPY_CROWD, CROWD_ROUNDS = 64, 6
#: 64-bit words of a set's signature.
SIGN_WORDS = 8

def shingle_set(text: bytes, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """XXH64 of the distinct shingles, ascending; a text of fewer words is one, one of none has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts, ends = (ends - sizes)[:n], ends[min(shingle, len(words)) - 1 :]
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def prefix(some: np.ndarray, least: float, listed: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a set, the seldom ones first (those not ``listed``,
    then by ``times``, then by hash): two sets alike by ``least`` share one."""
    if not len(some):
        return some
    level = np.zeros(len(some), np.int64)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, some), len(listed) - 1)
        level = np.where(listed[at] == some, times[at], 0)
    return some[np.lexsort((some, level))][: len(some) - math.ceil(least * len(some) - 1e-9) + 1]


def signature(some: np.ndarray) -> np.ndarray:
    """SIGN_WORDS words; bit j is set if an odd number of a set's hashes are j modulo
    their bits. Two sets differ in at least as many members as their signatures do in bits."""
    bits = 64 * SIGN_WORDS
    odd = np.bincount((some % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(shingle: int, least: float, order):
    """mark, size, signature and prefix of the texts, each text once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, times = (np.frombuffer(x, d) for x, d in zip(order.value, (np.uint64, np.int64), strict=True))
        sent: set[int] = set()
        for batch in batches:
            marks, sizes, signs, keys = [], [], [], []
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if mark in sent:
                    continue
                sent.add(mark)
                some = shingle_set(text, shingle)
                marks.append(mark)
                sizes.append(len(some))
                signs.append(signature(some))
                keys.append(prefix(some, least, listed, times).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(signs, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["mark", "size", "sign", "keys"])

    return run


def _sets(shingle: int, rows: bool):
    """mark and its set as bytes, or (``rows``) each shingle of it as a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["key"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], ["mark", "members"])

    return run


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        like = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like, pa.float64())], ["a", "b", "like"])


def _frequent(rows: DataFrame, shingle: int):
    """The shingles that several of ORDER_DOCS documents hold and their number,
    ORDER_LISTED at most: any order of shingles is right, this one keeps the
    texts few that share the first ones."""
    some = sampled(rows, rows.count(), ORDER_DOCS, "doc_id", "order").select("mark", "t").mapInArrow(sliced(_sets(shingle, True), 64), "key long")
    counts = materialize(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    sizes = counts.agg(*[F.count_if(F.col("n") >= 2**i).alias(f"c{i}") for i in range(20)]).first()
    over = next(2**i for i in range(20) if sizes[i] <= ORDER_LISTED or i == 19)
    table = counts.where(F.col("n") >= over).toArrow()  # ORDER_LISTED rows of 16 bytes at most
    keys, n = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy().astype(np.int64)
    by = np.argsort(keys)
    return rows.sparkSession.sparkContext.broadcast((keys[by].tobytes(), n[by].tobytes()))


def _members(raw: DataFrame, marks: DataFrame, shingle: int) -> DataFrame:
    """mark and ``members`` (its shingle set as bytes) of the texts ``marks``."""
    some = raw.select("mark", "t").join(marks.distinct(), "mark", "left_semi").dropDuplicates(["mark"])
    return materialize(some.mapInArrow(sliced(_sets(shingle, False), 64), "mark long, members binary"))


def _possible(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """a and b of the pairs (a, b, floor) that can be alike by ``floor``: sets that
    are differ in (1 - floor) / (1 + floor) of their sizes' sum at most, and
    signatures in no more bits. No pair alike is lost, and the sets of most
    others need not be moved."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(signs.select(F.col("mark").alias(side), F.col("size").alias(f"size_{side}"), F.col("sign").alias(f"sign_{side}")), side)
    apart = sum((F.bit_count(F.col("sign_a")[i].bitwiseXOR(F.col("sign_b")[i])) for i in range(SIGN_WORDS)), F.lit(0))
    apart = F.greatest(apart, F.abs(F.col("size_a") - F.col("size_b")))
    return both.where(apart * (1 + F.col("floor")) <= (1 - F.col("floor")) * (F.col("size_a") + F.col("size_b")) + 1e-6).select("a", "b")


def _compared(pairs: DataFrame, look: DataFrame) -> DataFrame:
    """a, b and ``like``: the Jaccard similarity of each pair (a, b)."""
    both = pairs.join(look.select(F.col("mark").alias("b"), F.col("members").alias("mb")), "b").join(look.select(F.col("mark").alias("a"), F.col("members").alias("ma")), "a")
    return both.select("a", "b", "ma", "mb").mapInArrow(sliced(_likeness), "a long, b long, like double")


def _sizes_allow(x: str, y: str, least: float) -> Column:
    return F.least(x, y) >= least * F.greatest(x, y) - 1e-6


def _may_be(least: float) -> Column:
    """Whether x and y, which share a shingle at ``pos`` of their prefixes, can be
    alike by ``least`` if it is the first one they share: by their sizes, and by
    what is left of them."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    return _sizes_allow("x.size", "y.size", least) & (F.least(x("size") - x("pos"), y("size") - y("pos")) * (1 + least) >= least * (x("size") + y("size")) - 1e-6)


def _grouped(listed: DataFrame, linked: DataFrame) -> DataFrame:
    """``listed`` with the ``group`` (smallest mark) that ``linked`` connects each mark to."""
    groups = components(linked).withColumnRenamed("node", "mark")
    return listed.join(groups, "mark", "left").select(*listed.columns, F.coalesce("root", "mark").alias("group"))


def _open(state: DataFrame, turn: int) -> DataFrame:
    """Of each key whose texts (key, mark, size, group) are in several groups:
    ``members``, ``cross`` (its pairs of different groups) and ``leader``, a text drawn by hash."""
    drawn = F.min(F.struct(F.xxhash64("mark", F.lit(turn)).alias("h"), "mark", "size", "group"))
    one = state.groupBy("key", "group").agg(F.count(F.lit(1)).alias("g"), drawn.alias("drawn"))
    every = one.groupBy("key").agg(F.sum("g").alias("members"), ((F.sum("g") * F.sum("g") - F.sum(F.col("g") * F.col("g"))) / 2).alias("cross"), F.count(F.lit(1)).alias("groups"), F.min("drawn").alias("leader"))
    return every.where("groups > 1").select("key", "members", "cross", "leader")


def _crowds(crowds: DataFrame, linked: DataFrame, look: DataFrame, signs: DataFrame, least: float, crowd: int, rounds: int) -> DataFrame:
    """``linked`` (a, b) and the links that connect what all pairs of texts under
    one ``key`` of ``crowds`` (key, mark, size, pos) that are alike would.

    A crowd whose texts are all in one group already is done. In the others the
    leader, a text drawn by hash, is compared with all members. It leaves: all
    its pairs are decided. By the triangle inequality of 1 - similarity, texts
    within r = 1 - ``least`` of it, now of one group, can only be like those
    within 2 r; if all these are of its group, the former leave too. What is
    left of a crowd is compared in all pairs of different groups that can be
    alike with this key as the first they share (a pair alike meets under that
    one too), once its pairs are ``crowd`` times its members at most, or after
    ``rounds`` leaders.
    """
    reach = 1 - least
    rest = None
    for turn in range(rounds + 1):
        grouped = materialize(_grouped(crowds, linked))
        if rest is not None:
            release(rest)
        open_ = materialize(_open(grouped, turn))
        if open_.isEmpty():
            release(grouped, open_)
            return linked
        state = materialize(grouped.join(open_, "key"))
        release(grouped, open_)
        last = F.col("cross") <= crowd * F.col("members") if turn < rounds else F.lit(True)
        x, y = state.where(last).alias("x"), state.where(last).alias("y")
        every = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.mark") < F.col("y.mark")) & (F.col("x.group") != F.col("y.group")) & _may_be(least)).select(F.col("x.mark").alias("a"), F.col("y.mark").alias("b"))
        rest = state.where(~last)
        ratio = F.least("size", "leader.size") / F.greatest("size", "leader.size")
        stars = rest.where((ratio >= 1 - 2 * reach - 1e-6) & (F.col("mark") != F.col("leader.mark"))).select(F.col("leader.mark").alias("a"), F.col("mark").alias("b"))
        # beyond twice the reach a leader's exact distance doesn't matter
        wanted = every.withColumn("floor", F.lit(least)).unionByName(stars.withColumn("floor", F.lit(1 - 2 * reach - 1e-6)))
        wanted = materialize(_possible(wanted.groupBy("a", "b").agg(F.min("floor").alias("floor")), signs))
        decided = materialize(_compared(wanted, look))
        release(wanted)
        linked, before = materialize(linked.unionByName(decided.where(F.col("like") >= least - 1e-9).select("a", "b"))), linked
        release(before)
        if turn == rounds:
            release(state, decided)
            return linked
        far = decided.select(F.col("a").alias("at"), F.col("b").alias("mark"), (1 - F.col("like")).alias("far"))
        rest = rest.where(F.col("mark") != F.col("leader.mark")).withColumn("at", F.col("leader.mark"))
        rest = materialize(rest.join(far, ["at", "mark"], "left").withColumn("far", F.coalesce("far", F.lit(1.0))))
        release(state, decided)
        # only in crowds without a text of another group at up to twice the reach
        edge = (F.col("far") > reach + 1e-9) & (F.col("far") <= 2 * reach + 1e-6) & (F.col("group") != F.col("leader.group"))
        kept = rest.where(edge).select("key").distinct().withColumn("edged", F.lit(True))
        crowds = rest.join(kept, "key", "left").where((F.col("far") > reach + 1e-9) | F.col("edged")).select("key", "mark", "size", "pos")
    return linked


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, least: float = COPY_SIMILARITY, crowd: int = COPY_CROWD, rounds: int = CROWD_ROUNDS) -> DataFrame:
    """doc_id and group_id (the smallest doc_id of the group) of every row:
    groups connect exactly the texts whose ``shingle``-word shingles have a
    Jaccard similarity of ``least`` or more.

    Prefix filtering: with all shingles in one order, two such texts share one
    of their first n - ceil(least * n) + 1 (n: shingles of a text). Texts meet
    under these and are verified by their whole shingle sets: first every text
    with the leader (smallest mark) of each shingle that it is listed under,
    which connects most groups with one comparison a text. Only under shingles
    whose texts are not all of one group by then all other pairs of different
    groups are compared, without those that cannot be alike by size and
    position; where these would be more than ``crowd`` times the texts, only as
    many as it takes to connect the same groups (``_crowds``). Texts without words are in no group but that
    of their equals. Nulls, repeats and empty tables as in ``near_duplicates``.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("mark"), text_or_empty(text_col).cast("binary").alias("t"))
    made = materialize(raw.select("mark", "t").mapInArrow(sliced(_prefixes(shingle, least, _frequent(raw, shingle))), "mark long, size int, sign array<long>, keys array<long>"))
    once = materialize(made.dropDuplicates(["mark"]))
    signs = materialize(once.select("mark", "size", "sign"))
    release(made)
    listed = once.select("mark", "size", F.posexplode("keys").alias("pos", "key"))
    shared = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(listed.join(shared, "key"))
    release(once)

    leaders = met.groupBy("key").agg(F.min("mark").alias("leader"))
    stars = met.select("key", "mark").join(leaders, "key").where("mark <> leader").select(F.col("leader").alias("a"), F.col("mark").alias("b")).distinct()
    stars = materialize(_possible(stars.withColumn("floor", F.lit(least)), signs))
    look = _members(raw, stars.select(F.explode(F.array("a", "b")).alias("mark")), shingle)
    linked = materialize(_compared(stars, look).where(F.col("like") >= least - 1e-9).select("a", "b"))
    release(stars, look)

    state = materialize(_grouped(met, linked))
    release(met)
    state, closed = materialize(state.join(_open(state, 0).select("key", "members", "cross"), "key")), state
    release(closed)
    few = state.where(F.col("cross") <= crowd * F.col("members"))
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.mark") < F.col("y.mark")) & (F.col("x.group") != F.col("y.group")) & _may_be(least))
    pairs = pairs.select(F.col("x.mark").alias("a"), F.col("y.mark").alias("b")).distinct()
    pairs = materialize(_possible(pairs.withColumn("floor", F.lit(least)), signs))
    crowds = state.where(F.col("cross") > crowd * F.col("members"))
    look = _members(raw, pairs.select(F.explode(F.array("a", "b")).alias("mark")).unionByName(crowds.select("mark")), shingle)
    linked = materialize(linked.unionByName(_compared(pairs, look).where(F.col("like") >= least - 1e-9).select("a", "b")))
    if not crowds.isEmpty():
        linked = _crowds(crowds.select("key", "mark", "size", "pos"), linked, look, signs, least, crowd, rounds)

    texts = materialize(raw.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    found = materialize(components(linked).withColumnRenamed("node", "mark"))
    release(state, pairs, look, linked, signs)
    names = found.join(texts.select("mark", "first"), "mark").groupBy("root").agg(F.min("first").alias("lowest"))
    grouped = found.join(names, "root").select("mark", "lowest")
    named = materialize(texts.join(grouped, "mark", "left").select("mark", "n", F.coalesce("lowest", "first").alias("group_id")))
    release(texts, found)
    return salted_join(raw.select("doc_id", "mark"), named, ["mark"], "n", docs.count(), ["doc_id"]).select("doc_id", "group_id")
