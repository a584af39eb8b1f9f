"""From scored pairs to matches: assignment, guards, near suggestions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import assignment
from ..runtime import materialize

THRESHOLD = {"table": 0.15, "text": 0.35, "image": 0.55}
CROSS_THRESHOLD = 0.62
MARGIN, SURE = 0.05, 0.78
PARENT_PENALTY, PAGE_PENALTY, PAGE_SOFT = 0.05, 0.05, 40
NEAR_SCORE, NEAR_HEADER, NEAR_COLUMN, NEAR_ROWS, NEAR_SEMANTIC, NEAR_EACH = 0.45, 0.25, 0.30, 0.20, 0.40, 3
#: Larger groups fall apart into what their positive scores connect; a part still larger is assigned greedily.
LARGEST = 4_000


def best_two(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Adds, along a and along b, whether the pair is the best (ties: the smaller
    other side), and the best score less the second best (0 if there is none)."""
    out = pairs
    for side, other in (("a", "b"), ("b", "a")):
        w = W.partitionBy(*by, side).orderBy(F.desc("score"), other)
        first = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        out = out.withColumn(f"rank_{side}", F.row_number().over(w)).withColumn(f"best_{side}", F.max("score").over(W.partitionBy(*by, side)))
        out = out.withColumn(f"second_{side}", F.coalesce(F.nth_value("score", 2).over(first), F.lit(0.0)))
    return out.withColumn("mutual", (F.col("rank_a") == 1) & (F.col("rank_b") == 1)).withColumn("margin", F.least(F.col("best_a") - F.col("second_a"), F.col("best_b") - F.col("second_b")))


def threshold(kind: Column, same_parent: Column, page_gap: Column) -> Column:
    base = F.when(kind == "table", THRESHOLD["table"]).when(kind == "image", THRESHOLD["image"]).otherwise(THRESHOLD["text"])
    return base + F.when(same_parent, 0.0).otherwise(PARENT_PENALTY) + F.when(page_gap > PAGE_SOFT, PAGE_PENALTY).otherwise(0.0)


def wide_enough(margin: float = MARGIN) -> Column:
    """The margin over the second best, along both sides; half of it does for sure scores."""
    return F.col("margin") >= F.when(F.col("score") >= SURE, margin / 2).otherwise(margin)


def guard_text(p: DataFrame) -> DataFrame:
    """Adds ``accepted`` to scored, ranked text pairs with same_parent,
    page_gap, tokens_a, tokens_b, heading_a, heading_b and their signals."""
    c = F.col
    few, many = F.least("tokens_a", "tokens_b"), F.greatest("tokens_a", "tokens_b")
    meaning = F.greatest("semantic", "sem_labels")
    floors = (F.greatest("chars", "semantic") >= 0.35) & (F.greatest("contain_tok", "contain_char") >= 0.35)
    short = (few > 4) | (((c("contain_char") >= 0.98) | (c("contain_tok") >= 0.80)) & (c("same_parent") | (c("page_gap") <= 2)))
    weak = (c("contain_char") < 0.95) & (c("shingle_cover") < 0.06) & (meaning < 0.82)
    length_ok = ~((many / F.greatest(few, F.lit(1)) > 2.5) & weak)
    heading_ok = ~((c("heading_a") != c("heading_b")) & weak & (c("contain_tok") < 0.75))
    paraphrase = (((c("sem_labels") >= 0.90) & (c("anchor_jacc") >= 0.50)) | (c("contain_char") >= 0.985)) & (c("same_parent") | (c("page_gap") <= 3))
    anchored = (many < 25) | (F.greatest("anchor_cover", "anchor_jacc", "shingle_cover") >= 0.05)
    free = ((few <= 6) & (c("contain_char") >= 0.975) & (c("same_parent") | (c("page_gap") <= 2))) | (F.greatest("contain_char", "chars") >= 0.98)
    best = free | ((c("mutual") | (c("semantic") >= 0.7)) & wide_enough())
    over = c("score") >= threshold(F.lit("text"), c("same_parent"), c("page_gap"))
    return p.withColumn("accepted", floors & short & length_ok & heading_ok & over & (paraphrase | (anchored & best)))


def guard_table(p: DataFrame) -> DataFrame:
    """The same for table pairs, with teds, rows_a and rows_b."""
    c = F.col
    strong = c("semantic") >= 0.72
    structure = strong | (c("header_jacc") >= 0.1) | (c("rowbag_jacc") >= 0.1)
    prefixes = (c("reg_jacc") >= 0.15) | ((c("row_overlap") >= 0.45) & (c("rowbag_jacc") >= 0.30) & (c("semantic") >= 0.70))
    meaning = strong | (c("semantic") >= 0.4) | (c("col_sem_top2") >= 0.25)
    rows = (c("row_overlap") >= 0.30) | ((c("semantic") >= 0.78) & ((c("col_sem_top2") >= 0.55) | (c("rowbag_jacc") >= 0.30)))
    few, many = F.least("rows_a", "rows_b"), F.greatest("rows_a", "rows_b")
    size = strong | (few <= 0) | (many / F.greatest(few, F.lit(1)) <= 5)
    best = (c("mutual") | (c("semantic") >= 0.7)) & wide_enough()
    over = c("score") >= threshold(F.lit("table"), c("same_parent"), c("page_gap"))
    return p.withColumn("accepted", (c("teds") >= 0.06) & structure & prefixes & meaning & rows & size & best & over)


def assign(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The one-to-one pairs of the largest total score in each group (those not
    in ``pairs`` count nothing). A group must fit one task: it is a document and
    a kind. Past LARGEST blocks a side, each part that pairs of a positive score
    connect is assigned by itself, which gives the same total; only a part that
    is past LARGEST itself is assigned greedily."""

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        return _assigned(f, LARGEST)

    return pairs.groupBy(*by).applyInPandas(solve, pairs.schema)


def _assigned(f: pd.DataFrame, largest: int) -> pd.DataFrame:
    if max(f["a"].nunique(), f["b"].nunique()) <= largest:
        return _optimal(f)
    some = f[f["score"] > 0]
    parts = [g for _, g in some.groupby(_connected(some))]
    fits = (max(g["a"].nunique(), g["b"].nunique()) <= largest for g in parts)
    return pd.concat([f.iloc[:0], *(_optimal(g) if ok else _greedy(g) for g, ok in zip(parts, fits, strict=True))])


def _optimal(f: pd.DataFrame) -> pd.DataFrame:
    a, b = np.unique(f["a"]), np.unique(f["b"])
    table = np.zeros((len(a), len(b)))
    i, j = np.searchsorted(a, f["a"]), np.searchsorted(b, f["b"])
    table[i, j] = f["score"]
    chosen = set(assignment(1 - table))
    return f[[(x, y) in chosen for x, y in zip(i.tolist(), j.tolist(), strict=True)]]


def _connected(f: pd.DataFrame) -> np.ndarray:
    """A number per row, the same for rows that shared a or b connect."""
    i, j = np.unique(f["a"], return_inverse=True)[1], np.unique(f["b"], return_inverse=True)[1]
    up = list(range(len(f) * 2))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        up[top(x)] = top(len(f) + y)
    return np.array([top(x) for x in i.tolist()], dtype=np.int64)


def _greedy(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values(["score", "a", "b"], ascending=[False, True, True])
    used_a, used_b, keep = set(), set(), []
    for a, b in zip(f["a"], f["b"], strict=True):
        keep.append(a not in used_a and b not in used_b)
        if keep[-1]:
            used_a.add(a)
            used_b.add(b)
    return f[keep]


def greedy(pairs: DataFrame, by: list[str], least: float) -> DataFrame:
    """One-to-one by descending score (ties: a, then b), of pairs of ``least`` or more."""
    wanted = pairs.where(F.col("score") >= least)
    return wanted.groupBy(*by).applyInPandas(_greedy, wanted.schema)


def cross_kind(scored: DataFrame, matched: DataFrame, by: list[str], least: float = CROSS_THRESHOLD) -> DataFrame:
    """Pairs across kinds among blocks not matched yet, one-to-one."""
    free = scored.join(matched.select(*by, "a"), [*by, "a"], "left_anti").join(matched.select(*by, "b"), [*by, "b"], "left_anti")
    return greedy(free, by, least)


def near(pairs: DataFrame, accepted: DataFrame, by: list[str], each: int = NEAR_EACH) -> DataFrame:
    """Up to ``each`` suggestions per a among pairs not accepted: by score, or by
    header and columns, or by rows and meaning, where those signals are there."""
    rest = pairs.join(accepted.select(*by, "a", "b"), [*by, "a", "b"], "left_anti")
    good = F.col("score") >= NEAR_SCORE
    if {"header_jacc", "header_bigram_jacc", "col_sem_top2", "rowbag_jacc", "semantic"} <= set(pairs.columns):
        good = good | ((F.greatest("header_jacc", "header_bigram_jacc") >= NEAR_HEADER) & (F.col("col_sem_top2") >= NEAR_COLUMN)) | ((F.col("rowbag_jacc") >= NEAR_ROWS) & (F.col("semantic") >= NEAR_SEMANTIC))
    order = W.partitionBy(*by, "a").orderBy(F.desc("score"), "b")
    return rest.where(good).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)


def unmatched(side: DataFrame, matched: DataFrame, by: list[str], key: str, end: str) -> DataFrame:
    return side.join(matched.select(*by, F.col(end).alias(key)).distinct(), [*by, key], "left_anti")


def summary(older: DataFrame, newer: DataFrame, matched: DataFrame, near_: DataFrame | None = None) -> DataFrame:
    """kind, source, revision, matched, near: counts."""
    parts = [older.select("kind", F.lit("source").alias("what")), newer.select("kind", F.lit("revision").alias("what")), matched.select("kind", F.lit("matched").alias("what"))]
    if near_ is not None:
        parts.append(near_.select("kind", F.lit("near").alias("what")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("kind").agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("source", "revision", "matched", "near")])


#: A block's id among those of two versions, which may use the same ids.
NODE = "__p_node"


def _nodes(artifacts: DataFrame, kind: str, older: int, key: str) -> DataFrame:
    wanted = artifacts.where((F.col("kind") == kind) & F.col("version").between(older, older + 1))
    return wanted.withColumn(NODE, F.concat_ws(":", "version", key))


def _named(pairs: DataFrame, key: str) -> DataFrame:
    """a and b by the ids of the blocks."""
    return pairs.withColumn("a", F.col(f"x.{key}")).withColumn("b", F.col(f"y.{key}")).drop("x", "y")


def match_text(artifacts: DataFrame, key: str = "id", older: int = 1, kind: str = "text") -> DataFrame:
    """The whole text path for one pair of versions in every document:
    features, candidates, scores, assignment, guards. document, kind, a, b,
    score, accepted and the signals. Blocks of another ``kind`` with text, as
    images with what is written on them, go the same way."""
    from . import blocking, features, scoring

    by = blocking.BY
    wanted = _nodes(artifacts, kind, older, key)
    parts = features.with_tokens(wanted, unfold=True)
    parts = features.without_stopwords(parts, features.stopwords(parts, by), by)
    full = materialize(features.with_features(parts, by, NODE).drop("shingles"))
    a, b = blocking.sides(full, older)
    found = materialize(blocking.shortlist(a, b, NODE, found=blocking.candidates(a, b, NODE)))
    scored = materialize(scoring.text_scores(found, full, by, NODE))
    ranked = best_two(scored, by)
    chosen = assign(ranked.select(*by, "a", "b", "score"), by).select(*by, "a", "b")
    # the blocks themselves are joined last, to the pairs chosen
    ends = full.select(*by, NODE, key, "parent", "page_idx", "tokens", "heading")
    ready = scoring.paired(ranked.join(chosen, [*by, "a", "b"]), ends, by, NODE).select("*", (F.col("x.parent") == F.col("y.parent")).alias("same_parent"), F.abs(F.col("x.page_idx") - F.col("y.page_idx")).alias("page_gap"), F.size("x.tokens").alias("tokens_a"), F.size("y.tokens").alias("tokens_b"), F.col("x.heading").alias("heading_a"), F.col("y.heading").alias("heading_b"))
    return _named(guard_text(ready), key)


def match_table(artifacts: DataFrame, key: str = "id", older: int = 1) -> DataFrame:
    """The same for tables: candidates by text and by header, row and number
    probes, structural and numeric scores, table guards."""
    from . import blocking, features, scoring

    by = blocking.BY
    wanted = _nodes(artifacts, "table", older, key)
    full = materialize(scoring.table_features(features.with_tokens(wanted, unfold=True), by, NODE))
    a, b = blocking.sides(full, older)
    probes = [blocking.probe(a, b, F.col("grid.bigrams"), NODE), blocking.probe(a, b, F.col("grid.row_signatures"), NODE), blocking.probe(a, b, F.transform("grid.headers", F.lower), NODE), blocking.probe(a, b, F.col("numbers"), NODE)]
    found = materialize(blocking.shortlist(a, b, NODE, want=64, found=blocking.candidates(a, b, NODE, extra=probes)))
    scored = materialize(scoring.table_scores(found, full, by, NODE))
    ranked = best_two(scored, by)
    chosen = assign(ranked.select(*by, "a", "b", "score"), by).select(*by, "a", "b")
    c = F.col
    ready = ranked.join(chosen, [*by, "a", "b"]).select("*", (c("x.parent") == c("y.parent")).alias("same_parent"), F.abs(c("x.page_idx") - c("y.page_idx")).alias("page_gap"), c("x.grid.n_rows").alias("rows_a"), c("y.grid.n_rows").alias("rows_b"))
    return _named(guard_table(ready), key)
