"""Chains: one row per logical item across all versions of a document.

Edges lead from a block of version k to one of version k + 1. The chain of a
root is a chain of left joins through edges (never through blocks: an edge to a
block of another kind still goes on), and roots are the blocks that no walked
edge reaches. The number of versions is known to the plan, so there is no loop
at run time; all joins are on (document, kind, id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BY = ["document", "kind"]


def best_edges(pairs: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Edges from version k: of accepted ``pairs`` (a, b, score) the best per b,
    then per a; and for each a without one its best ``near`` pair."""
    per_b = W.partitionBy(*BY, "b").orderBy(F.desc("score"), "a")
    per_a = W.partitionBy(*BY, "a").orderBy(F.desc("score"), "b")
    one = pairs.withColumn("n", F.row_number().over(per_b)).where("n = 1").withColumn("n", F.row_number().over(per_a)).where("n = 1").drop("n")
    rest = near.join(one.select(*BY, "a"), [*BY, "a"], "left_anti").withColumn("n", F.row_number().over(per_a)).where("n = 1").drop("n")
    cols = [*BY, F.lit(k).alias("k"), F.col("a").alias("sid"), F.col("b").alias("rid"), "score"]
    return one.select(*cols, F.lit(False).alias("is_near")).unionByName(rest.select(*cols, F.lit(True).alias("is_near")))


def chains(blocks: DataFrame, edges: DataFrame, versions: int) -> DataFrame:
    """document, kind, root_version, v1 .. vN (ids), and score_k_k+1,
    is_near_k_k+1 per step. ``blocks``: document, kind, version, id."""
    ids = lambda k: blocks.where(F.col("version") == k).select(*BY, "id").distinct()
    step = lambda k: edges.where(F.col("k") == k)
    live = ids(1)
    roots = {1: live}
    for k in range(2, versions + 1):
        walked = step(k - 1).join(live.withColumnRenamed("id", "sid"), [*BY, "sid"], "left_semi").select(*BY, F.col("rid").alias("id")).distinct()
        roots[k] = ids(k).join(walked, [*BY, "id"], "left_anti")
        live = ids(k).unionByName(walked).distinct()
    out = []
    for root, start in roots.items():
        row = start.withColumnRenamed("id", f"v{root}")
        for k in range(root, versions):
            hop = step(k).select(*BY, F.col("sid").alias(f"v{k}"), F.col("rid").alias(f"v{k + 1}"), F.col("score").alias(f"score_{k}_{k + 1}"), F.col("is_near").alias(f"is_near_{k}_{k + 1}"))
            row = row.join(hop, [*BY, f"v{k}"], "left")
        kind = dict(blocks.dtypes)["id"]
        for k in range(1, root):
            row = row.withColumn(f"v{k}", F.lit(None).cast(kind)).withColumn(f"score_{k}_{k + 1}", F.lit(None).cast("double")).withColumn(f"is_near_{k}_{k + 1}", F.lit(None).cast("boolean"))
        names = [f"v{k}" for k in range(1, versions + 1)] + [f"{c}_{k}_{k + 1}" for k in range(1, versions) for c in ("score", "is_near")]
        out.append(row.select(*BY, F.lit(root).alias("root_version"), *names))
    return reduce(DataFrame.unionByName, out)


def wide(chain_rows: DataFrame, blocks: DataFrame, versions: int) -> DataFrame:
    """Chains with each version's content (text, img_path, table_body, page,
    order), parent_same per step, ordered numbers per kind (chain_id) and overall
    (row_idx), and pair_index."""
    out = chain_rows
    anchor_page, anchor_ord = F.lit(None).cast("long"), F.lit(None).cast("long")
    for k in range(1, versions + 1):
        own = blocks.where(F.col("version") == k).select(*BY, F.col("id").alias(f"v{k}"), F.col("text").alias(f"v{k}_text"), F.col("img_path").alias(f"v{k}_img_path"), F.col("table_body").alias(f"v{k}_table_body"), F.col("page_idx").alias(f"v{k}_page"), F.col("ord").alias(f"v{k}_order"), F.col("parent").alias(f"v{k}_parent"))
        out = out.join(own, [*BY, f"v{k}"], "left")
        anchor_page = F.when(F.col("root_version") == k, F.col(f"v{k}_page")).otherwise(anchor_page)
        anchor_ord = F.when(F.col("root_version") == k, F.col(f"v{k}_order")).otherwise(anchor_ord)
    for k in range(1, versions):
        out = out.withColumn(f"parent_same_{k}_{k + 1}", (F.col(f"v{k}_parent") == F.col(f"v{k + 1}_parent")).cast("int"))
    out = out.withColumn("p", anchor_page).withColumn("o", anchor_ord)
    place = [F.col("root_version"), F.col("p").asc_nulls_last(), F.col("o").asc_nulls_last()]
    out = out.withColumn("chain_id", F.row_number().over(W.partitionBy(*BY).orderBy(*place, *[f"v{k}" for k in range(1, versions + 1)])) - 1)
    out = out.withColumn("row_idx", F.row_number().over(W.partitionBy("document").orderBy(*place, "kind", "chain_id")) - 1)
    return out.withColumn("pair_index", F.concat(F.lit("v"), F.col("root_version").cast("string"), F.lit(f"-v{versions}"))).drop("p", "o", *[f"v{k}_parent" for k in range(1, versions + 1)])


def adjacent(wide_rows: DataFrame, versions: int, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per wide row and pair of adjacent versions: ``keep``, va, vb,
    and left_/right_ of each column."""
    one = lambda k: F.struct(F.lit(k).alias("va"), F.lit(k + 1).alias("vb"), *[F.col(f"v{k}_{c}").alias(f"left_{c}") for c in columns], *[F.col(f"v{k + 1}_{c}").alias(f"right_{c}") for c in columns])
    return wide_rows.select(*keep, F.explode(F.array(*[one(k) for k in range(1, versions)])).alias("pair")).select(*keep, "pair.*")


def versions_of(columns: list[str]) -> list[int]:
    """The versions that a wide frame's column names tell; two at least."""
    import re

    found = sorted(int(m[1]) for c in columns if (m := re.fullmatch(r"v(\d+)_text", c)))
    if len(found) < 2:
        raise ValueError("a wide frame needs the text of two versions or more")
    return found
