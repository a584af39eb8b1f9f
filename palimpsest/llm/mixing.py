"""Mixing sources to target weights on a low-discrepancy schedule, SQL only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share 1.5 times all words; a target stops at twice its source's words and the
excess is shared again by weight (water filling, in closed form).

Schedule: the budget is cut into M = 2**k blocks of one size B, for all sources
alike. Point j / M of the unit interval belongs to the source whose stretch of
the cumulative targets holds it, and is played at time reverse_bits(j): the van
der Corput sequence mapped through the cumulative weights. Points are exactly
even, so a source wins as many slots as its target has blocks, or one less;
then the point after its last is played for it too. Its slots, ranked by time,
take the blocks of B words into which the line of its shuffled documents is cut
(after its last word the line starts again); the last is cut at the target.
Words of a document taken = overlap of its stretch of that line with the blocks
that have a slot, and the slots' times are the order in which the mix plays.

A source may hold any share of the rows: places on the line come from
``running`` (cells of the hash order), never from one task per source.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, materialize, running, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Up to so many sources their targets (some 80 bytes each) are broadcast, beyond it joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Blocks: about one for so many words, between 2**MIN_BITS and 2**MAX_BITS.
BLOCK_WORDS = 65_536
MIN_BITS, MAX_BITS = 12, 22


def source_targets(sizes: DataFrame) -> DataFrame:
    """From ``source`` and ``source_size``: also ``weight`` and ``target``.
    One row per source, ranked in one task."""
    rows = sizes.withColumn("all", F.lit(0))
    rank = F.row_number().over(W.partitionBy("all").orderBy(F.col("source").asc_nulls_last()))
    rows = rows.withColumn("pos", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("pos") - 1) % len(WEIGHTS) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * MOST).withColumn("fill", F.col("cap") / F.col("weight"))
    order = W.partitionBy("all").orderBy("fill", "pos")
    rows = rows.withColumn("budget", F.sum("source_size").over(W.partitionBy("all")) * F.lit(SHARE))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", level)
    # the level at which the first uncapped source, and all after it, are filled
    rows = rows.withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(W.partitionBy("all")))
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")), F.col("cap").cast("double"))
    return rows.select("source", "pos", "source_size", "weight", target.alias("target"))


def slots_of(targets: DataFrame, bits: int, block: int) -> DataFrame:
    """One row per slot of the schedule: source's pos, rank ``k`` of the slot
    within the source, and ``time``, its place in the whole schedule. Sources
    (pos, target, goal: its whole words) have a slot for each ``block`` words."""
    m = 1 << bits
    w = W.partitionBy("all").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    t = targets.withColumn("all", F.lit(0)).withColumn("upto", F.sum("target").over(w)).withColumn("sum", F.sum("target").over(W.partitionBy("all"))).where("goal > 0")
    t = t.withColumn("lo", F.ceil((F.col("upto") - F.col("target")) / F.col("sum") * m).cast("long")).withColumn("need", F.ceil(F.col("goal") / block).cast("long"))
    points = t.select("pos", F.explode(F.sequence("lo", F.col("lo") + F.col("need") - 1)).alias("j")).withColumn("j", F.pmod("j", F.lit(m)))
    points = points.withColumn("time", F.conv(F.reverse(F.lpad(F.bin("j"), bits, "0")), 2, 10).cast("long"))
    return points.withColumn("k", (F.row_number().over(W.partitionBy("pos").orderBy("time")) - 1).cast("long"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, seed: str = "mix", schedule: Callable[[DataFrame, int, int], DataFrame] = slots_of) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and again_slot (the
    schedule's times at which the document is first played and played again,
    null where it isn't), then ``keep``. Null text has size 0; a null source is
    a source of its own, last. The order within a source is a hash of the id, so
    reruns agree; rows alike in id and size are interchangeable. Sources without
    words get target 0. An empty table gives no rows. ``schedule`` gives the
    slots: ``slots_of``, or another of its form.
    """
    keep = [c for c in keep or [] if c not in ("doc_id", "size", "source_size", "target", "taken", "first_slot", "again_slot")]
    kept = [f"__p_k{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("h"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    rows = materialize(rows)
    targets = materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("goal", F.round("target").cast("long")))
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    bits = min(MAX_BITS, max(MIN_BITS, int(budget / BLOCK_WORDS).bit_length()))
    block = max(1, math.ceil(budget / (1 << bits)))
    slots = materialize(schedule(targets, bits, block))

    targets = targets.withColumnRenamed("source", "__p_src")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("__p_src"))).drop("__p_src").withColumn("one", F.lit(1))
    rows = running(rows, ["pos"], "h", {"a": "size", "nth": "one"}, ["doc_id", "size"])

    laps = rows.withColumn("lap", F.explode(F.when((F.col("size") > 0) & (F.col("a") < F.col("goal")), F.filter(F.array(F.lit(0), F.lit(1)), lambda p: F.col("a") + p * F.col("source_size") < F.col("goal")))))
    laps = laps.withColumn("x", F.col("a") + F.col("lap") * F.col("source_size")).withColumn("y", F.least(F.col("x") + F.col("size"), F.col("goal")))
    pieces = laps.withColumn("k", F.explode(F.sequence(F.expr(f"x div {block}"), F.expr(f"(y - 1) div {block}")))).join(slots.select("pos", "k", "time"), ["pos", "k"])
    pieces = pieces.withColumn("overlap", F.least("y", (F.col("k") + 1) * block) - F.greatest("x", F.col("k") * block))
    slot = lambda lap: F.min(F.when(F.col("lap") == lap, F.col("time")))
    taken = pieces.groupBy("pos", "nth").agg(F.sum("overlap").alias("taken"), F.coalesce(slot(0), slot(1)).alias("first_slot"), F.when(slot(0).isNotNull(), slot(1)).alias("again_slot"))
    out = rows.join(taken, ["pos", "nth"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "again_slot", *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)])
