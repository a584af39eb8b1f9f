"""Grids of tables compared: headers, columns and numbers of two cell matrices.

A table block becomes one GRID struct (``grid``); two of them give all the
structural signals of table scoring at once (``grid_signals``). Both are Arrow
UDFs over nested arrays: alignment, warping and correlations of ragged columns
have no built-in form. Column texts are compared by the cosine of their word
counts, the same for headers, since no encoder's weights are at hand.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .similarity import greedy_mean, warp

_FIELDS = [("headers", "list<string>"), ("bigrams", "list<string>"), ("row_signatures", "list<string>"), ("first_column", "list<string>"), ("row_texts", "list<string>"), ("column_texts", "list<string>"), ("numeric_share", "list<double>"), ("columns", "list<list<double>>"), ("n_rows", "int")]
_NUMBER = re.compile(r"[+-]?[0-9]+(\.[0-9]+)?")
_ZEROS = re.compile(r"\(\s*(0{3,})\s*[a-z]*\s*\)")
ROWS = 50


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("list<"):
        return pa.list_(_arrow(kind[5:-1]))
    return {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[kind]


def _spark(kind: str) -> T.DataType:
    if kind.startswith("list<"):
        return T.ArrayType(_spark(kind[5:-1]))
    return {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}[kind]


GRID = T.StructType([T.StructField(n, _spark(k)) for n, k in _FIELDS])
SIGNALS = ["header_jacc", "header_bigram_jacc", "rowbag_jacc", "row_overlap", "col_count_sim", "row_count_sim", "col_sem_top2", "col_quant_align", "type_align", "trend_sim", "corr_sim", "miss_sim", "row_label", "series", "num_col_quant_align", "numeric_share_a", "numeric_share_b"]


def number(cell: str) -> float | None:
    """A cell as a number: footnote signs, spaces and thousands commas are allowed."""
    t = re.sub(r"[,\s\u00a0]", "", re.sub(r"[*#@]+$", "", cell.strip().lower()))
    return float(t) if _NUMBER.fullmatch(t) else None


def scale_of(header: str) -> float:
    """What a header says that its column's numbers are multiplied by."""
    h = header.lower()
    zeros = _ZEROS.search(h)
    return 1e6 if "million" in h else 1e9 if "billion" in h else 10.0 ** len(zeros[1]) if zeros else 1e3 if "(000" in h or "('000" in h else 1.0


def words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def grid_of(rows: list[list[str]] | None) -> dict:
    """The first row is the header if it holds no number and others follow."""
    rows = [[(c or "").strip() for c in r] for r in rows or []]
    head = rows[0] if len(rows) > 1 and not any(number(c) is not None for c in rows[0]) else []
    body = rows[1:] if head else rows
    wide = max(map(len, body), default=0)
    padded = [r + [""] * (wide - len(r)) for r in body]
    cells = list(zip(*padded, strict=True)) if padded else []
    columns = [[number(c) for c in col] for col in cells]
    factors = [scale_of(h) for h in head] + [1.0] * wide
    hw = [w for h in head for w in words(h)]
    return {
        "headers": head, "bigrams": sorted({f"{a} {b}" for a, b in pairwise(hw)}), "row_signatures": sorted({" ".join(sorted(set(words(" ".join(r))))) for r in body} - {""}),
        "first_column": [r[0] for r in body if r], "row_texts": [" ".join(" ".join(r).lower().split()) for r in body], "column_texts": [" ".join(c) for c in cells],
        "numeric_share": [sum(x is not None for x in col) / max(1, len(col)) for col in columns],
        "columns": [[None if x is None else x * f for x in col] for col, f in zip(columns, factors, strict=False)], "n_rows": len(body),
    }


@F.arrow_udf(GRID)
def grid(rows: pa.Array) -> pa.Array:
    """Of a matrix of cells (array<array<string>>): headers, texts, and its
    columns' numbers, scaled by the units in the headers."""
    return pa.array([grid_of(r) for r in rows.to_pylist()], pa.struct([(n, _arrow(k)) for n, k in _FIELDS]))


def cosine(a: list[float], b: list[float]) -> float:
    x, y = np.array(a, float), np.array(b, float)
    n = min(len(x), len(y))
    size = math.sqrt((x[:n] @ x[:n]) * (y[:n] @ y[:n])) if n else 0.0
    return float(x[:n] @ y[:n] / size) if size else 0.0


def text_cosine(a: str, b: str) -> float:
    x, y = Counter(words(a)), Counter(words(b))
    size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[w] for w, v in x.items()) / size if size else 0.0


def jaccard(a: list, b: list) -> float:
    x, y = set(a), set(b)
    return len(x & y) / max(1, len(x | y))


def filled(column: list[float | None]) -> list[float]:
    return [x for x in column if x is not None]


def quantiles(column: list[float | None]) -> list[float]:
    """Five nearest-rank quantiles, less the median, over the quartile distance."""
    s = sorted(filled(column))
    if not s:
        return [0.0] * 5
    q = [s[round(p * (len(s) - 1))] for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
    spread = max(q[3] - q[1], 1e-9)
    return [(x - q[2]) / spread for x in q]


def size_of(column: list[float | None]) -> float:
    s = filled(column)
    return math.log10(max(1e-9, float(np.median(np.abs(s))))) if s else -9.0


def missing(column: list[float | None]) -> float:
    return sum(x is None for x in column) / max(1, len(column))


def trend(column: list[float | None]) -> float:
    """(rises - falls) / (rises + falls) between neighbours with a number."""
    steps = [(b > a) - (b < a) for a, b in pairwise(column) if a is not None and b is not None]
    moves = sum(map(abs, steps))
    return sum(steps) / moves if moves else 0.0


def index_column(columns: list[list[float | None]]) -> int:
    """The first with three numbers or more, whole and strictly rising; -1 if none."""
    for i, column in enumerate(columns):
        s = filled(column)
        if len(s) >= 3 and all(x == math.floor(x) for x in s) and all(b > a for a, b in pairwise(s)):
            return i
    return -1


def correlations(columns: list[list[float | None]]) -> list[list[float]]:
    """Pearson's, of the columns with four numbers or more, over rows where both
    have one; 0 with fewer than four such rows or without spread. Under two such columns: none."""
    some = [c for c in columns if len(filled(c)) >= 4]
    if len(some) < 2:
        return []
    out = np.eye(len(some))
    for i, x in enumerate(some):
        for j in range(i + 1, len(some)):
            both = np.array([(a, b) for a, b in zip(x, some[j], strict=False) if a is not None and b is not None], float)
            if len(both) >= 4 and both[:, 0].std() > 0 and both[:, 1].std() > 0:
                out[i, j] = out[j, i] = np.corrcoef(both.T)[0, 1]
    return out.tolist()


def matrix_similarity(a: list[list[float]], b: list[list[float]]) -> float:
    """1 / (1 + squared differences) over the common top left block."""
    n = min(len(a), len(b))
    if not n:
        return 0.0
    x, y = np.array(a)[:n, :n], np.array(b)[:n, :n]
    return float(1 / (1 + ((x - y) ** 2).sum()))


def column_alignment(a: dict, b: dict, numeric: bool) -> float:
    """Each numeric column of a with its best free one of b: quantiles, scale,
    missing share and, where both have headers, these."""
    table = []
    for i, x in enumerate(a["columns"]):
        row = []
        for j, y in enumerate(b["columns"]):
            shape, size, gaps = cosine(quantiles(x), quantiles(y)), 1 - min(1.0, abs(size_of(x) - size_of(y)) / 6), 1 - min(1.0, abs(missing(x) - missing(y)))
            if i < len(a["headers"]) and j < len(b["headers"]):
                head = text_cosine(a["headers"][i], b["headers"][j])
                row.append(0.60 * shape + 0.20 * size + 0.15 * gaps + 0.05 * head if numeric else 0.55 * shape + 0.20 * size + 0.15 * gaps + 0.10 * head)
            else:
                row.append(0.70 * shape + 0.30 * size if numeric else 0.65 * shape + 0.25 * size + 0.10 * gaps)
        table.append(row)
    return greedy_mean(table) if table and table[0] else 0.0


def overlapping_rows(a: list[str], b: list[str]) -> float:
    """Share of a's first rows with a row of b alike: words' Jaccard over 0.35, or one inside the other."""
    x, y = a[:ROWS], [(r, set(r.split())) for r in b[:ROWS]]
    alike = lambda r, s: any(r in q or q in r or len(s & t) > 0.35 * len(s | t) for q, t in y)
    return sum(alike(r, set(r.split())) for r in x) / len(x) if x and y else 0.0


def label_similarity(a: list[str], b: list[str]) -> float:
    """Jaccard of first cells without their numbers."""
    key = lambda c: " ".join(re.sub(r"\b\d+\b", " ", c.lower()).split())
    return jaccard([k for c in a if (k := key(c))], [k for c in b if (k := key(c))])


def series_shape(a: list[list[float | None]], b: list[list[float | None]]) -> float:
    """Mean time-warping similarity of the three columns of most variance on
    either side; 0 where a side has no index column."""
    if index_column(a) < 0 or index_column(b) < 0:
        return 0.0
    top = lambda cols: [c for _, _, c in sorted(((float(np.var(filled(c))), i, c) for i, c in enumerate(cols) if len(filled(c)) >= 4), key=lambda r: r[:2], reverse=True)[:3]]
    found = [warp(x, y) for x, y in zip(top(a), top(b), strict=False)]
    return sum(found) / len(found) if found else 0.0


def signals_of(a: dict, b: dict) -> dict[str, float]:
    near = lambda x, y: 1 - abs(x - y) / max(1, x, y)
    wide = lambda g: len(g["headers"]) or len(g["column_texts"])
    x, y = a["columns"], b["columns"]
    meaning = sorted((text_cosine(p, q) for p in a["column_texts"] for q in b["column_texts"]), reverse=True)[:2]
    ia, ib = index_column(x), index_column(y)
    moving = [k for k in range(min(len(x), len(y))) if k not in (ia, ib)] if ia >= 0 and ib >= 0 else []
    ratios = [[1 - abs(p - q) for q in b["numeric_share"]] for p in a["numeric_share"]]
    share = lambda g: sum(g["numeric_share"]) / max(1, len(g["numeric_share"]))
    return {
        "header_jacc": jaccard([h.lower() for h in a["headers"]], [h.lower() for h in b["headers"]]), "header_bigram_jacc": jaccard(a["bigrams"], b["bigrams"]), "rowbag_jacc": jaccard(a["row_signatures"], b["row_signatures"]),
        "row_overlap": overlapping_rows(a["row_texts"], b["row_texts"]), "col_count_sim": near(wide(a), wide(b)), "row_count_sim": near(a["n_rows"], b["n_rows"]),
        "col_sem_top2": sum(meaning) / max(1, len(meaning)), "col_quant_align": column_alignment(a, b, False), "type_align": greedy_mean(ratios) if ratios and ratios[0] else 0.0,
        "trend_sim": cosine([trend(x[k]) for k in moving], [trend(y[k]) for k in moving]), "corr_sim": matrix_similarity(correlations(x), correlations(y)), "miss_sim": cosine([missing(c) for c in x], [missing(c) for c in y]),
        "row_label": label_similarity(a["first_column"], b["first_column"]), "series": series_shape(x, y), "num_col_quant_align": column_alignment(a, b, True), "numeric_share_a": share(a), "numeric_share_b": share(b),
    }


@F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in SIGNALS]))
def grid_signals(a: pa.Array, b: pa.Array) -> pa.Array:
    """All signals of the grids of two tables."""
    return pa.array([signals_of(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.struct([(n, pa.float64()) for n in SIGNALS]))
