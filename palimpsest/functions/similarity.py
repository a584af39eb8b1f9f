"""What built-in functions cannot say about two values: Arrow UDFs over pairs.

They are the slow path, so callers narrow the pairs first (blocking, equality,
cheap signals) and compute each ratio once.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.DoubleType())
def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp, popular characters of long texts left out; 0 for two empty texts."""
    return pa.array([SequenceMatcher(None, x or "", y or "").ratio() if x or y else 0.0 for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def exact_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp over all characters; 1 for two empty texts."""
    return pa.array([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


#: Characters of the runs that ``run_bound`` counts: short ones tell more of few changes, long ones of texts from few words.
RUNS = (5, 8, 11)


def run_bound(a: str, b: str) -> float:
    """No less than the ratio. Matched characters are a common subsequence, so one
    text becomes the other by as many insertions and deletions as characters stay
    unmatched, and each changes the counts of runs of n characters by 2 n - 1 in
    all at most. Runs of equal hash count as equal, which only raises the bound."""
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for x in (a, b)]
    bits = max(12, (len(a) + len(b)).bit_length() + 2)

    def counts(code: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(max(0, len(code) - n + 1), np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[i : i + len(h)]
        return np.bincount((h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)

    apart = (int(np.abs(counts(codes[0], n) - counts(codes[1], n)).sum()) / (2 * n - 1) for n in RUNS)
    return 1 - max(apart) / max(1, len(a) + len(b))


def bounded(a: str, b: str, least: float) -> float:
    """The ratio over all characters if it is ``least`` or more, else some
    bound of it below ``least``: cheap bounds settle most pairs that differ."""
    if a == b:
        return 1.0
    # before the matcher is made, which indexes the second text
    if (r := 2 * min(len(a), len(b)) / (len(a) + len(b))) < least or (r := run_bound(a, b)) < least:
        return r
    m = SequenceMatcher(None, a, b, autojunk=False)
    return r if (r := m.quick_ratio()) < least else m.ratio()


@F.arrow_udf(T.DoubleType())
def near_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """``bounded`` by 0.96, the least ratio that any rule asks for."""
    return pa.array([bounded(x or "", y or "", 0.96) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def ratio_and_share(a: str, b: str) -> tuple[float, float]:
    """``ratio``, and the matching characters as a share of the shorter text (1
    at most), which takes the shorter text first: one comparison does for both
    unless the first is the longer one."""
    if not a and not b:
        return 0.0, 0.0
    r = SequenceMatcher(None, a, b).ratio()
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    s = r if short is a else SequenceMatcher(None, short, long).ratio()
    return r, min(1.0, s * (len(a) + len(b)) / 2 / max(1, len(short)))


@F.arrow_udf(T.StructType([T.StructField("chars", T.DoubleType()), T.StructField("contain_char", T.DoubleType())]))
def character_signals(a: pa.Array, b: pa.Array) -> pa.Array:
    found = [ratio_and_share(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([r for r, _ in found], pa.float64()), pa.array([s for _, s in found], pa.float64())], ["chars", "contain_char"])

class Places:
    """A text's characters by their places, for ``matched``."""

    def __init__(self, text: str):
        self.text, n = text, len(text)
        self.count = {c: text.count(c) for c in set(text)}
        #: characters that the matcher indexes when this is the second text: popular ones of long texts are left out
        self.kept = frozenset(c for c, k in self.count.items() if n < 200 or k <= n // 100 + 1)
        self._at: dict[str, list[int]] = {}
        self._rare = None

    def at(self, x: str) -> list[int]:
        """Where a character or a pair of them is, overlapping ones too."""
        found = self._at.get(x)
        if found is None:
            found, find, i = [], self.text.find, -1
            while (i := find(x, i + 1)) >= 0:
                found.append(i)
            self._at[x] = found
        return found

    @property
    def rare(self) -> list[str]:
        """Pairs of neighbours of ``kept``."""
        if self._rare is None:
            at = sorted(i for c in self.kept for i in self.at(c))
            self._rare = sorted({self.text[i : i + 2] for i, j in pairwise(at) if j == i + 1})
        return self._rare


#: Pairs of neighbours met past which the library's matcher is asked instead; runs past which boxes are cut by NumPy.
MOST_RUNS, FEW_RUNS = 1_000_000, 48


def _runs(met: list[tuple[list[int], list[int]]], n: int, m: int) -> list[tuple[int, int, int]] | np.ndarray:
    """Runs (place in the first text of length n, in the second of length m,
    length) out of the places of each pair of neighbours that both have."""
    i, j = (np.concatenate(x) for x in zip(*((np.repeat(x, len(y)), np.tile(y, len(x))) for x, y in met), strict=True))
    key = np.sort((i - j + m) * (n + 1) + i)
    first = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    i = key[first] % (n + 1)
    return _few(np.stack([i, i - (key[first] // (n + 1) - m), np.diff(first, append=len(key)) + 1]))


def _few(runs: np.ndarray) -> list[tuple[int, int, int]] | np.ndarray:
    return runs if runs.shape[1] > FEW_RUNS else list(zip(*runs.tolist(), strict=True))


def _clipped(runs: list[tuple[int, int, int]] | np.ndarray, alo: int, ahi: int, blo: int, bhi: int) -> tuple[list | np.ndarray, tuple[int, int, int] | None]:
    """What of the runs lies in a box, and the longest and first of them, if any has two characters."""
    if isinstance(runs, np.ndarray):
        i, j, k = runs
        lo = np.maximum(np.maximum(alo - i, blo - j), 0)
        k = np.minimum(np.minimum(k, ahi - i), bhi - j) - lo
        held = np.stack([i + lo, j + lo, k])[:, k > 1]
        if not held.shape[1]:
            return [], None
        best = held[:, held[2] == held[2].max()]
        best = best[:, best[0] == best[0].min()]
        return held, tuple(best[:, best[1].argmin()].tolist())
    held, best = [], None
    for i, j, k in runs:
        lo, hi = max(0, alo - i, blo - j), min(k, ahi - i, bhi - j)
        if (k := hi - lo) > 1:
            held.append(x := (i + lo, j + lo, k))
            if best is None or k > best[2] or k == best[2] and x < best:
                best = x
    return held, best


def matched(first: Places, second: Places) -> int:
    """Characters in the matching blocks that SequenceMatcher(None, first, second) finds.

    It takes the longest run of kept characters, the first one of equals, lengthens
    it by any equal characters and goes on to its left and right. Runs of two kept
    characters or more are few, so they are listed once and clipped to each box.
    In a box without any, the first kept character that both sides have comes next
    and nothing but a common start is left of it, so the box is passed over once.
    """
    a, b = first.text, second.text
    met = [(p, second.at(x)) for x in second.rare if x[0] in first.count and x[1] in first.count and (p := first.at(x))]
    if sum(len(p) * len(q) for p, q in met) > MOST_RUNS:
        return sum(k for _, _, k in SequenceMatcher(None, a, b).get_matching_blocks())
    chars = [(first.at(c), second.at(c)) for c in second.kept if c in first.count]
    total = 0
    boxes = [(0, len(a), 0, len(b), _runs(met, len(a), len(b)) if met else [])]
    while boxes:
        alo, ahi, blo, bhi, held = boxes.pop()
        held, best = _clipped(held, alo, ahi, blo, bhi) if len(held) else (held, None)
        if best:
            i, j, k = best
            i, j, e, f = _widened(a, b, i, j, i + k, j + k, alo, ahi, blo, bhi)
            total += e - i
            left, right = alo < i and blo < j, e < ahi and f < bhi
            if isinstance(held, np.ndarray):
                if left:
                    boxes.append((alo, i, blo, j, _few(held[:, (held[0] < i) & (held[1] < j)])))
                if right:
                    boxes.append((e, ahi, f, bhi, _few(held[:, (held[0] + held[2] > e) & (held[1] + held[2] > f)])))
                continue
            if left:
                boxes.append((alo, i, blo, j, [r for r in held if r[0] < i and r[1] < j]))
            if right:
                boxes.append((e, ahi, f, bhi, [r for r in held if r[0] + r[2] > e and r[1] + r[2] > f]))
            continue
        start = alo == 0 and blo == 0
        live = []
        for p, q in chars:
            m, n = bisect_left(p, alo), bisect_left(q, blo)
            if m < len(p) and n < len(q) and p[m] < ahi and q[n] < bhi:
                live.append((p[m], q[n], p, q))
        while live:
            i, j, _, _ = min(live)
            i, j, e, f = _widened(a, b, i, j, i + 1, j + 1, alo, ahi, blo, bhi)
            total += e - i
            if start:
                total += _common(a, b, i, j)
                start = False
            alo, blo = e, f
            if alo >= ahi or blo >= bhi:
                break
            old, live = live, []
            for x in old:
                i, j, p, q = x
                if i >= alo and j >= blo:
                    live.append(x)
                    continue
                if i < alo:
                    if (m := bisect_left(p, alo)) == len(p) or (i := p[m]) >= ahi:
                        continue
                if j < blo:
                    if (n := bisect_left(q, blo)) == len(q) or (j := q[n]) >= bhi:
                        continue
                live.append((i, j, p, q))
        if start:
            total += _common(a, b, ahi, bhi)
    return total


def _widened(a: str, b: str, i: int, j: int, e: int, f: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int, int]:
    """a[i:e] == b[j:f], made longer at both ends within a box."""
    while i > alo and j > blo and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    while e < ahi and f < bhi and a[e] == b[f]:
        e, f = e + 1, f + 1
        if not e & 31:
            while e + 256 <= ahi and f + 256 <= bhi and a[e : e + 256] == b[f : f + 256]:
                e, f = e + 256, f + 256
    return i, j, e, f


def _common(a: str, b: str, i: int, j: int) -> int:
    """Length of the common start of a[:i] and b[:j]."""
    n, most = 0, min(i, j)
    while n < most and a[n] == b[n]:
        n += 1
    return n


def character_shares(texts: list[str], a: list[int], b: list[int]) -> tuple[list[float], list[float]]:
    """``ratio_and_share`` of pairs of texts, given by their places; each text is indexed once."""
    places: dict[int, Places] = {}
    for i in {*a, *b}:
        places[i] = Places(texts[i])
    ratios, shares = [], []
    for p, q in zip(a, b, strict=True):
        x, y = len(texts[p]), len(texts[q])
        r = 2.0 * matched(places[p], places[q]) / (x + y) if x or y else 0.0
        s = r if x <= y else 2.0 * matched(places[q], places[p]) / (x + y)
        ratios.append(r)
        shares.append(min(1.0, s * (x + y) / 2 / max(1, min(x, y))))
    return ratios, shares


def term_vectors(lists: list[list[str]]) -> list[dict[str, float]]:
    """Words and pairs of words of each block of a group by tf-idf, scaled to
    length 1; terms in over 0.9 of 3 blocks or more are left out."""
    n = len(lists)
    tfs = [Counter([*x, *(f"{p} {q}" for p, q in pairwise(x))]) for x in lists]
    df = Counter(t for tf in tfs for t in tf)
    idf = {t: math.log((n + 1) / (d + 1)) + 1 for t, d in df.items() if d <= 0.9 * n or n < 3}
    out = []
    for tf in tfs:
        w = {t: c * idf[t] for t, c in tf.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()})
    return out


def pair_signals(blocks: dict[str, list], a: list[int], b: list[int]) -> dict[str, list[float | None]]:
    """All text signals of pairs of blocks of one group, given by their places;
    ``blocks`` holds the columns of the whole group. Equal texts: 1 in everything."""
    texts = [x or "" for x in blocks["text_clean"]]
    words, labels = ([x or [] for x in blocks[c]] for c in ("tokens", "labels"))
    sets = {"tok": [set(x) for x in words], "labels": [set(x) for x in labels], "nums": [set(x or []) for x in blocks["numbers"]], "anchors": [set(x or []) for x in blocks["anchors"]]}
    sets["shingles"] = [{" ".join(x[i : i + 4]) for i in range(len(x) - 3)} for x in words]
    semantic, by_labels = term_vectors(words), term_vectors(labels)
    rest = [i for i in range(len(a)) if texts[a[i]] != texts[b[i]]]
    chars = dict(zip(rest, zip(*character_shares(texts, [a[i] for i in rest], [b[i] for i in rest]), strict=True), strict=True))
    parent, page, bits = blocks["parent"], blocks["page_idx"], blocks["simhash"]
    cos = lambda v, w: sum(x * w[t] for t, x in v.items() if t in w)
    names = "semantic sem_labels dice simhash chars nums parent page contain_tok contain_char contain_labels anchor_cover anchor_jacc shingle_cover".split()
    rows = []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        if i not in chars:
            rows.append([1.0] * len(names))
            continue
        both = {n: (len(v[p] & v[q]), len(v[p]), len(v[q])) for n, v in sets.items()}
        jaccard, cover, contain = ((lambda n, f=f: both[n][0] / max(1, f(*both[n]))) for f in (lambda c, x, y: x + y - c, lambda c, x, y: x, lambda c, x, y: min(x, y)))
        rows.append([
            cos(semantic[p], semantic[q]), cos(by_labels[p], by_labels[q]), 2 * both["tok"][0] / max(1, both["tok"][1] + both["tok"][2]),
            1 - ((bits[p] ^ bits[q]) & (1 << 64) - 1).bit_count() / 64, chars[i][0], jaccard("nums"),
            None if parent[p] is None or parent[q] is None else float(parent[p] == parent[q]),
            0.0 if page[p] is None or page[q] is None else 1 - min(abs(page[p] - page[q]) / 50, 1.0),
            contain("tok"), chars[i][1], contain("labels"), cover("anchors"), jaccard("anchors"), cover("shingles"),
        ])
    return {n: [r[k] for r in rows] for k, n in enumerate(names)}


def warp(a: list[float | None] | None, b: list[float | None] | None) -> float:
    """Dynamic time warping of two standardised series as a similarity; 0 under
    three numbers on either side."""
    x, y = (np.array([v for v in s or [] if v is not None], float) for s in (a, b))
    if len(x) < 3 or len(y) < 3:
        return 0.0
    x, y = ((s - s.mean()) / (s.std() or 1e-9) for s in (x, y))
    row = np.full(len(y) + 1, np.inf)
    row[0] = 0.0
    for v in x:
        cost = (v - y) ** 2
        step = np.minimum(row[1:], row[:-1])
        row[0] = np.inf
        left = np.inf
        for j in range(len(y)):
            left = row[j + 1] = cost[j] + min(step[j], left)
    return float(1 / (1 + row[-1] / (len(x) + len(y))))


@F.arrow_udf(T.DoubleType())
def series_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([warp(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


_NUMBER = re.compile(r"\b-?\d+(?:[.,]\d+)?%?\b")


def numbers_alike(a: str | None, b: str | None) -> float:
    """Each number of the first takes the nearest free one of the second; the
    mean of 1 - relative difference. Both without numbers: 1."""
    x, y = ([float(n.rstrip("%").replace(",", ".")) for n in _NUMBER.findall(t or "")] for t in (a, b))
    if not x and not y:
        return 1.0
    free, scores = list(y), []
    for v in x:
        near = [1 - min(1.0, abs(v - w) / max(abs(v), abs(w), 1.0)) for w in free]
        if near and max(near) > 0:
            scores.append(max(near))
            free.pop(near.index(max(near)))
    return sum(scores) / len(scores) if scores else 0.0


@F.arrow_udf(T.DoubleType())
def numeric_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([numbers_alike(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def line_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Lists of lines: the mean, over the shorter one, of the best ratio."""

    def one(x: list[str] | None, y: list[str] | None) -> float:
        few, many = sorted(([s for s in x or [] if s], [s for s in y or [] if s]), key=len)
        return sum(max(SequenceMatcher(None, s, t).ratio() for t in many) for s in few) / len(few) if few else 0.0

    return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


_WORDS = re.compile(r"\w+|[^\w\s]")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("op", "old", "new")])))
def word_diff(a: pa.Array, b: pa.Array) -> pa.Array:
    """The runs of words that are equal, replaced, inserted or deleted."""

    def one(x: str | None, y: str | None) -> list[dict]:
        v, w = _WORDS.findall(x or ""), _WORDS.findall(y or "")
        return [{"op": op, "old": " ".join(v[i:j]), "new": " ".join(w[k:n])} for op, i, j, k, n in SequenceMatcher(None, v, w, autojunk=False).get_opcodes()]

    kind = pa.list_(pa.struct([("op", pa.string()), ("old", pa.string()), ("new", pa.string())]))
    return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)


def greedy_mean(table: list[list[float]]) -> float:
    """Row by row the best free column; the mean of what was taken, within 0 and 1."""
    used: set[int] = set()
    taken = []
    for row in table:
        free = [(v, -j) for j, v in enumerate(row) if j not in used]
        if free:
            v, j = max(free)
            used.add(-j)
            taken.append(min(1.0, max(0.0, v)))
    return sum(taken) / len(taken) if taken else 0.0


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost (shortest augmenting paths)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], col = i, 0
        least, before, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[col] = True
            row = owner[col]
            open_ = ~done[1:]
            reduced = c[row - 1] - u[row] - v[1:]
            better = open_ & (reduced < least[1:])
            least[1:][better] = reduced[better]
            before[1:][better] = col
            following = int(np.argmin(np.where(open_, least[1:], np.inf))) + 1
            step = least[following]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            col = following
            if owner[col] == 0:
                break
        while col:
            owner[col] = owner[before[col]]
            col = before[col]
    out = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in out)
