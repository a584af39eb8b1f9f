"""The text signals of all candidate pairs of a group held in one place: tokens
are numbered once, and what pairs have in common comes from products of matrices."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from . import similarity as s
from . import tokens as k

_VALUE = re.compile(k.VALUE.replace("$", r"\Z"))
_NUMERIC = [re.compile(p, re.I | re.A) for p in k.NUMERIC]

#: Cells of a dense matrix, and products of single entries, that are held at a time.
CELLS, PRODUCTS = 1 << 22, 1 << 21


def products(x: tuple, y: tuple, shape: tuple[int, int]) -> np.ndarray:
    """Sums of products over the terms that rows share. ``x`` and ``y`` are
    entries (row, term, weight), a row and term once; terms of many rows are
    multiplied as matrices, the others entry by entry."""
    out = np.zeros(shape)
    if not len(x[0]) or not len(y[0]):
        return out
    terms = int(max(x[1].max(), y[1].max())) + 1
    cx, cy = (np.bincount(t, minlength=terms) for t in (x[1], y[1]))
    load = cx * cy
    heavy = np.flatnonzero(load > max(16, shape[0] * shape[1] // 64))
    number = np.full(terms, -1)
    number[heavy] = np.arange(len(heavy))
    wide = max(1, CELLS // max(shape))
    parts = [(r[n >= 0], n[n >= 0], w[n >= 0]) for r, t, w in (x, y) for n in (number[t],)]
    for at in range(0, len(heavy), wide):
        dense = []
        for (r, n, w), rows in zip(parts, shape, strict=True):
            m = np.zeros((rows, min(wide, len(heavy) - at)))
            here = (n >= at) & (n < at + wide)
            m[r[here], n[here] - at] = w[here]
            dense.append(m)
        out += dense[0] @ dense[1].T
    light = (load > 0) & (number < 0)
    (rx, tx, wx), (ry, ty, wy) = ((r[o], t[o], w[o]) for r, t, w in (x, y) for o in (np.flatnonzero(light[t]),))
    order = np.argsort(ty, kind="stable")
    ry, wy, start = ry[order], wy[order], np.concatenate([[0], np.cumsum(np.where(light, cy, 0))])
    many, flat = cy[tx], out.ravel()
    ends = np.cumsum(many)
    at = 0
    while at < len(tx):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS, "right")))
        n = many[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + start[tx[i]]
        flat += np.bincount(rx[i] * shape[1] + ry[j], weights=wx[i] * wy[j], minlength=len(flat))
        at = to
    return out


def entries(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and terms, each pair once, with its count; terms are 0 or more."""
    wide = int(term.max()) + 1 if len(term) else 1
    found, n = np.unique(row.astype(np.int64) * wide + term, return_counts=True)
    return found // wide, found % wide, n


def twos(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours within a row: the row, and the two as a number from 0."""
    here = row[:-1] == row[1:]
    code = word[:-1][here] * (int(word.max()) + 1 if len(word) else 1) + word[1:][here]
    return row[:-1][here], np.unique(code, return_inverse=True)[1]


def tfidf(rows: int, row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and pairs of neighbours of each row, by tf-idf and scaled to length
    1; terms in over 0.9 of 3 rows or more are left out."""
    two_row, two = twos(row, word)
    first = int(word.max()) + 1 if len(word) else 0
    r, t, tf = entries(np.concatenate([row, two_row]), np.concatenate([word, two + first]))
    df = np.bincount(t) if len(t) else np.zeros(0, int)
    kept = (df <= 0.9 * rows) | (rows < 3)
    r, t, tf = (x[kept[t]] for x in (r, t, tf)) if len(t) else (r, t, tf)
    w = tf * (np.log((rows + 1) / (df[t] + 1)) + 1) if len(t) else tf.astype(float)
    norm = np.sqrt(np.bincount(r, weights=w * w, minlength=rows))
    return r, t, w / norm[r]


def rarest(row: np.ndarray, word: np.ndarray, names: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``limit`` words of each row that fewest rows have, ties by the word."""
    r, t, _ = entries(row, word)
    df = np.bincount(t, minlength=len(names))
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=lambda x: (df[x], names[x]))] = np.arange(len(names))
    order = np.lexsort((rank[t], r))
    r, t = r[order], t[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    return r[nth < limit], t[nth < limit]


def signs(words: list[str]) -> np.ndarray:
    """The 64 low bits of each word's MD5, a column per bit."""
    low = b"".join(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[8:] for x in words)
    return np.unpackbits(np.frombuffer(low, np.uint8).reshape(-1, 8), axis=1)


def scored(texts: list[str], codes: list[list[str]], kinds: list, sides: np.ndarray, parents: list, pages: list, limit: int):
    """Of a group's blocks, all pairs (a of side 0, b of side 1, of one kind)
    that share a run of four words: their places, and signals by name, None where
    a side's parent is unknown. Anchors are of the whole group, all else of a kind."""
    number: dict[str, int] = {}
    lists = [[number.setdefault(x, len(number)) for x in t.split(" ") if x] for t in texts]
    names = list(number)
    many = np.array([len(x) for x in lists])
    row, word = np.repeat(np.arange(len(texts)), many), np.array([x for y in lists for x in y], np.int64)
    anchors = rarest(row, word, names, limit)
    label = np.array([not _VALUE.search(x.lower()) for x in names], bool)
    bits = signs(names)
    numbers: dict[str, int] = {}
    by_word = [[numbers.setdefault(m, len(numbers)) for p in _NUMERIC for m in p.findall(x)] for x in names]
    numeric = np.array([bool(x) for x in by_word], bool)
    out_a, out_b, out = [], [], []
    for kind in dict.fromkeys(kinds):
        of = np.array([i for i, x in enumerate(kinds) if x == kind])
        side = [of[sides[of] == v] for v in (0, 1)]
        if not len(side[0]) or not len(side[1]):
            continue
        shape = (len(side[0]), len(side[1]))
        place = np.full(len(texts), -1)  # within a side
        at = np.full(len(texts), -1)  # within the kind
        at[of] = np.arange(len(of))
        for x in side:
            place[x] = np.arange(len(x))
        mine = at[row] >= 0
        r, w = row[mine], word[mine]

        def both(rows, terms, weights=None, side=side, place=place, sides=sides, shape=shape):
            weights = np.ones(len(rows)) if weights is None else weights
            return products(*[(place[rows[o]], terms[o], weights[o]) for v in (0, 1) for o in ((sides[rows] == v) & (place[rows] >= 0),)], shape)

        three = np.flatnonzero(r[:-3] == r[3:]) if len(r) > 3 else np.zeros(0, int)
        # runs of four as two numbered runs of two, each place with the next but one
        two = np.unique(w[:-1] * len(names) + w[1:], return_inverse=True)[1] if len(w) > 1 else np.zeros(0, int)
        four = np.unique(two[three] * (int(two.max()) + 1) + two[three + 2], return_inverse=True)[1] if len(three) else three
        sr, st, _ = entries(r[three], four)
        shared = both(sr, st)
        a, b = np.nonzero(shared)
        if not len(a):
            continue
        size = lambda rows: np.bincount(rows, minlength=len(texts))
        p, q = side[0][a], side[1][b]
        ratio = lambda c, n, n2=1.0: n2 * c / np.maximum(1, n)
        found: dict[str, np.ndarray] = {}
        back = of
        for name, o in (("semantic", slice(None)), ("sem_labels", label[w])):
            v = tfidf(len(of), at[r[o]], w[o])
            found[name] = both(back[v[0]], v[1], v[2])[a, b]
        tr, tt, tf = entries(r, w)
        common, n = both(tr, tt)[a, b], size(tr)
        found["dice"] = 2 * common / np.maximum(1, n[p] + n[q])
        found["contain_tok"] = ratio(common, np.minimum(n[p], n[q]))
        lr, lt = tr[label[tt]], tt[label[tt]]
        n = size(lr)
        found["contain_labels"] = ratio(both(lr, lt)[a, b], np.minimum(n[p], n[q]))
        ones, total = np.zeros((len(texts), 64)), np.bincount(r, minlength=len(texts))
        edge = np.searchsorted(tr, np.arange(len(texts) + 1))
        for i in of:
            x = slice(edge[i], edge[i + 1])
            ones[i] = tf[x].astype(np.float32) @ bits[tt[x]].astype(np.float32)
        hashed = np.packbits((2 * ones >= total[:, None]) & (total[:, None] > 0), axis=1).view(np.uint64)[:, 0]
        found["simhash"] = 1 - np.bitwise_count(hashed[p] ^ hashed[q]) / 64
        held = [{m for x in tt[edge[i] : edge[i + 1]][numeric[tt[edge[i] : edge[i + 1]]]] for m in by_word[x]} | {numbers.setdefault(c, len(numbers)) for c in codes[i]} for i in of]
        nr, nt = np.repeat(of, [len(x) for x in held]), np.array([m for x in held for m in x], np.int64)
        common, n = both(nr, nt)[a, b], size(nr)
        found["nums"] = ratio(common, n[p] + n[q] - common)
        o = at[anchors[0]] >= 0
        common, n = both(anchors[0][o], anchors[1][o])[a, b], size(anchors[0])
        found["anchor_cover"], found["anchor_jacc"] = ratio(common, n[p]), ratio(common, n[p] + n[q] - common)
        found["shingle_cover"] = ratio(shared[a, b], size(sr)[p])
        known = {x: i for i, x in enumerate(dict.fromkeys(parents))}
        of_parent = np.array([-1 if x is None else known[x] for x in parents])
        found["parent"] = np.where((of_parent[p] < 0) | (of_parent[q] < 0), np.nan, of_parent[p] == of_parent[q])
        page = np.array([np.nan if x is None else x for x in pages], float)
        found["page"] = np.nan_to_num(1 - np.minimum(np.abs(page[p] - page[q]) / 50, 1.0))
        same = np.array([texts[x] == texts[y] for x, y in zip(p, q, strict=True)])
        rest = np.flatnonzero(~same)
        found["chars"], found["contain_char"] = np.ones(len(p)), np.ones(len(p))
        found["chars"][rest], found["contain_char"][rest] = s.character_shares(texts, p[rest].tolist(), q[rest].tolist())
        out_a.append(p)
        out_b.append(q)
        out.append({n: np.where(same, 1.0, x) for n, x in found.items()})
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(out_a), join(out_b), {n: np.concatenate([x[n] for x in out]) for n in out[0]} if out else {}
