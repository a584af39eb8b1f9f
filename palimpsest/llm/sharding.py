"""Minimax contiguous sharding with SQL functions only.

Equal texts form one atomic group. Groups are ordered by a hash of their text
and folded, in that order, into 2**bits atoms (a group is never split between
atoms). Atoms larger than an even share of what is left get a shard of their
own; over the ordered sizes of the others the smallest feasible capacity is
found by binary search, each probe a greedy pass, and the greedy cuts at that
capacity are the shards' borders. The search runs inside one SQL expression
over at most 2**bits numbers, whatever the corpus holds.

The slot of a row within its shard is an offset of its cell plus its rank
there. A cell is an atom, or a part of one where an atom holds more than
1 / HEAVY_SHARE of all rows, so no task ranks more than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize, text_or_empty

#: An atom with more than one in so many rows is ranked in several cells; there are HEAVY_SHARE of them at most.
HEAVY_SHARE = 2_048
ROW_OVERHEAD = 16

_SEARCH = """
aggregate(sequence(1, 63), named_struct('lo', lo, 'hi', hi),
  (b, i) -> if(b.lo >= b.hi, b,
    if(aggregate(sizes, named_struct('k', 1, 'load', 0L),
         (a, x) -> if(a.load + x <= (b.lo + b.hi) div 2, named_struct('k', a.k, 'load', a.load + x), named_struct('k', a.k + 1, 'load', x)),
         a -> a.k) <= {k},
       named_struct('lo', b.lo, 'hi', (b.lo + b.hi) div 2),
       named_struct('lo', (b.lo + b.hi) div 2 + 1, 'hi', b.hi))),
  b -> b.lo)
"""

_CUTS = """
aggregate(atoms, named_struct('load', capacity, 'cuts', cast(array() as array<int>)),
  (a, x) -> if(a.load + x.s <= capacity, named_struct('load', a.load + x.s, 'cuts', a.cuts), named_struct('load', x.s, 'cuts', array_append(a.cuts, x.atom))),
  a -> a.cuts)
"""


def minimax_cuts(sizes: DataFrame, shards: int) -> tuple[list[int], list[int], int]:
    """From one row per atom (``atom`` int, ``s`` long): the atoms that fill a
    shard alone, the first atom of every other shard, and the capacity.

    The atoms must be few (here 2**bits at most): they meet in one array.
    """
    top = sizes.orderBy(F.desc("s"), "atom").limit(shards).withColumn("all", F.lit(0))
    total = sizes.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("total"))
    w = W.partitionBy("all").orderBy(F.desc("s"), "atom")
    top = top.join(F.broadcast(total.withColumn("all", F.lit(0))), "all")
    top = top.withColumn("i", F.row_number().over(w) - 1).withColumn("left", F.col("total") - F.coalesce(F.sum("s").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    top = top.withColumn("own", (F.col("s") * (shards - F.col("i")) >= F.col("left")) & (F.col("i") < shards - 1))
    top = top.withColumn("own", F.min(F.col("own").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1)
    giants = [r["atom"] for r in top.where("own").orderBy("i").select("atom").collect()]  # under the number of shards
    k = shards - len(giants)
    rest = sizes.where(~F.col("atom").isin(giants)) if giants else sizes
    one = rest.agg(F.array_sort(F.collect_list(F.struct("atom", "s"))).alias("atoms"))
    one = one.where(F.size("atoms") > 0).withColumn("sizes", F.transform("atoms", lambda x: x["s"]))
    one = one.withColumn("total", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("most", F.array_max("sizes"))
    one = one.withColumn("even", F.expr(f"(total + {k} - 1) div {k}"))
    one = one.withColumn("lo", F.greatest("most", "even")).withColumn("hi", F.col("even") + F.col("most"))
    one = one.withColumn("capacity", F.expr(_SEARCH.format(k=k)))
    found = one.select("capacity", F.expr(_CUTS).alias("cuts")).collect()  # one row, at most `shards` numbers
    return (giants, list(found[0]["cuts"]), found[0]["capacity"]) if found else (giants, [], 0)


def shard_documents(docs: DataFrame, shards: int = 40, bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: every row in one
    of ``shards`` shards of nearly equal bytes; slots are gapless from 0.

    A null text counts as empty (size 16). Equal texts share a shard, so one
    whose copies exceed an even share makes its shard larger than the others.
    Repeated rows each get a slot. Which of two rows alike in id and text has
    which slot is not defined. An empty table gives no rows; more shards than
    groups leaves shards empty.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = materialize(rows.withColumn("atom", F.shiftrightunsigned("h", 64 - bits).cast("int")))
    atoms = materialize(rows.groupBy("atom").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")))
    giants, cuts, _ = minimax_cuts(atoms.select("atom", "s"), shards)

    heavy = max(200, rows.count() // HEAVY_SHARE)
    parts = atoms.where(F.col("n") > heavy).select("atom", F.ceil(F.col("n") / heavy).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(parts), "atom", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts"))).cast("int")).drop("parts")

    border = F.array(*[F.lit(c).cast("int") for c in cuts]) if cuts else F.array(F.lit(0))
    shard = F.size(F.filter(border, lambda c: c <= F.col("atom"))) - 1 + len(giants)
    for i, a in enumerate(giants):
        shard = F.when(F.col("atom") == a, i).otherwise(shard)
    cells = rows.groupBy("atom", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", shard.cast("int"))
    before = W.partitionBy("shard").orderBy("atom", "part").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("atom", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("atom", "part").orderBy("h", "doc_id", "size", "text_crc32")
    out = rows.join(cells, ["atom", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.row_number().over(inside) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
