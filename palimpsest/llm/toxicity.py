"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over the
distinct words it holds, a word counting by itself and by how it begins (so that
inflected forms share what is learned); the document's is the noisy-or of its
sentences, 1 - prod(1 - p). Only labels
of documents are known, so the word weights are learned through the noisy-or,
and the sentences that carry the score point at the offending passages.

Training takes at most SAMPLE labelled documents of each class (those of the
smallest hash of the id), weighed back to the classes' shares among all
training labels; they meet on the driver as word numbers per sentence, and only
features that tell the classes apart are kept. Scoring
reads every document once, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import crc_of_id, sampled, sliced, text_or_empty

FOLDS = 5
#: Labelled documents of each class that training takes at most.
SAMPLE = 3_000
#: A feature must be in so many of them, and its share in the two classes differ by so many standard errors, to have a weight.
LEAST_DOCS, LEAST_Z = 3, 2.0
#: Lengths (bytes) of the beginnings of a word that are features.
STEMS = (4, 5, 6)
#: Words whose weight a worker remembers.
MEMORY = 400_000
ROUNDS = 150
DECAY = 1e-6
_SENTENCE = re.compile(rb"[.!?\n]+")
_EDGES = b"\"'()[]{}<>*#%&$@^_~`|/\\,;:+=-"


def sentences(text: bytes) -> Iterator[tuple[int, int, set[bytes]]]:
    """Start, end (bytes) and words of each sentence that holds a word."""
    at = 0
    for m in _SENTENCE.finditer(text):
        words = {w.strip(_EDGES) for w in text[at : m.start()].lower().split()}
        words.discard(b"")
        if words:
            yield at, m.start(), words
        at = m.end()
    words = {w.strip(_EDGES) for w in text[at:].lower().split()}
    words.discard(b"")
    if words:
        yield at, len(text), words


def _softplus(z: float) -> float:
    return math.log1p(math.exp(z)) if z < 30 else z


def features(word: bytes) -> list[bytes]:
    return [word, *[word[:n] + b"*" for n in STEMS if len(word) >= n]]


class _Values(dict):
    """A word's weight: the sum of its features'."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = sum([self.weights.get(f, 0.0) for f in features(word)])
        return value


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float]

    @cached_property
    def value(self) -> Callable[[bytes], float]:
        return _Values(self.weights).__getitem__

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "weights": self.weights}

    def score(self, text: bytes) -> tuple[float, float, int, int]:
        """The document's score, and that of its worst sentence with its place
        (0, 0 in a text without words, which scores like one empty sentence)."""
        value, total, worst = self.value, 0.0, (-math.inf, 0, 0)
        for a, b, words in sentences(text):
            z = self.bias + sum(map(value, sorted(words)))
            total += _softplus(z)
            if z > worst[0]:
                worst = (z, a, b)
        if worst[0] == -math.inf:
            worst, total = (self.bias, 0, 0), _softplus(self.bias)
        return -math.expm1(-total), -math.expm1(-_softplus(worst[0])), worst[1], worst[2]


def fit(bags: list[tuple[list[list[int]], int, float]], n_words: int) -> tuple[float, np.ndarray]:
    """Weights from bags (sentences of word numbers, label, weight of the bag)."""
    feat = np.array([w for b, _, _ in bags for s in b for w in s], np.int64)
    sent = np.repeat(np.arange(sum(len(b) for b, _, _ in bags)), [len(s) for b, _, _ in bags for s in b])
    bag = np.repeat(np.arange(len(bags)), [len(b) for b, _, _ in bags])
    y = np.array([t for _, t, _ in bags], np.float64)
    share = np.array([v for _, _, v in bags], np.float64)
    share /= share.sum()
    n = len(bag)
    w, bias = np.zeros(n_words), -5.0
    m, v, mb, vb = np.zeros(n_words), np.zeros(n_words), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        z = bias + np.bincount(sent, w[feat], n)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(-np.bincount(bag, np.logaddexp(0, z), len(y)))  # no sentence offends
        some = np.maximum(1 - none, 1e-9)
        pull = share * np.where(y > 0, -none / some, 1.0)
        g = p * pull[bag]
        gw, gb = np.bincount(feat, g[sent], n_words) + DECAY * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.15 / (1 - 0.9**step) * (1 - 0.999**step) ** 0.5
        w -= rate * m / (np.sqrt(v) + 1e-10)
        bias -= rate * mb / (np.sqrt(vb) + 1e-10)
    return float(bias), w


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each training document: its words, once each, and its sentences as numbers of them."""
    for batch in batches:
        words, bags = [], []
        for text in batch.column(2).to_pylist():
            number: dict[bytes, int] = {}
            bags.append([[number.setdefault(w, len(number)) for w in sorted(ws)] for _, _, ws in sentences(text)])
            words.append(list(number))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.binary())), pa.array(bags, pa.list_(pa.list_(pa.int32())))], ["toxic", "h", "words", "bag"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", fold: int = 0) -> Model:
    """A model of ``docs`` with a label outside ``fold``. Null labels and ids
    take no part; of several labels of an id the largest counts. Without
    documents of both classes the scores are the classes' share."""
    known = labels.where((crc_of_id() % FOLDS != fold) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [sampled(known.where(F.col("toxic") == y), sizes.get(y, 0), sample, "doc_id", "sample") for y in (0, 1)]
    picked = picked[0].unionByName(picked[1]).withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("t")).join(F.broadcast(picked), "doc_id")
    coded = rows.select("toxic", "h", "t").mapInArrow(sliced(_encode), "toxic int, h long, words array<binary>, bag array<array<int>>").toArrow().to_pylist()
    coded.sort(key=lambda r: (r["h"], r["words"], r["bag"]))
    if len({r["toxic"] for r in coded}) < 2:
        p = min(max(sizes.get(1, 0) / max(1, sum(sizes.values())), 1e-4), 1 - 1e-4)
        return Model(float(np.log(p / (1 - p))), {})
    df: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for r in coded:
        df[r["toxic"]].update({f for w in r["words"] for f in features(w)})
    got = {t: sum(r["toxic"] == t for r in coded) for t in (0, 1)}
    chosen = []
    for f in sorted(df[0].keys() | df[1].keys()):
        a, b = df[0][f], df[1][f]
        share = (a + b) / (got[0] + got[1])
        error = math.sqrt(max(share * (1 - share), 1e-9) * (1 / got[0] + 1 / got[1]))
        if a + b >= LEAST_DOCS and abs(b / got[1] - a / got[0]) >= LEAST_Z * error:
            chosen.append(f)
    vocabulary = {f: i for i, f in enumerate(chosen)}
    bags = []
    for r in coded:
        numbers = [[vocabulary[f] for f in features(w) if f in vocabulary] for w in r["words"]]
        bag = [[n for i in s for n in numbers[i]] for s in r["bag"]] or [[]]
        bags.append((bag, r["toxic"], sizes[r["toxic"]] / got[r["toxic"]]))
    bias, w = fit(bags, max(1, len(vocabulary)))
    return Model(bias, {x: float(w[i]) for x, i in vocabulary.items() if abs(w[i]) > 1e-3})


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            found = [model.score(t) for t in batch.column(n).to_pylist()]
            cols = list(zip(*found, strict=True)) or [()] * 4
            kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [*batch.schema.names[:n], "score", "worst_score", "worst_start", "worst_end"])

    return run


def held_out(fold: int = 0, id_col: str = "doc_id") -> Column:
    return crc_of_id(id_col) % FOLDS == fold


def score_documents(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, then score, predicted, and the worst sentence: its score and
    its first and last byte in the UTF-8 text. Every row is scored, null text as
    empty; columns in ``keep`` named like an output give way."""
    keep = [c for c in keep if c not in ("score", "predicted", "worst_score", "worst_start", "worst_end")]
    rows = docs.select(*keep, text_or_empty(text_col).cast("binary").alias("__p_text"))
    fields = [docs.schema[c] for c in keep] + T._parse_datatype_string("score double, worst_score double, worst_start long, worst_end long").fields
    out = rows.mapInArrow(sliced(_scored(model)), T.StructType(fields))
    return out.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end")
