"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

One pass over whole texts takes statistics of each document (no label, language, source or id among them).
Random Fourier features of the standardised statistics approximate a Gaussian kernel; every partition
sums its share of the normal equations, by fold; the driver adds these fixed-size sums and solves for the ridge weights
of all folds but one and of all folds.  Scores of rows by the model that has not seen their fold are
binned, and pooling of adjacent violators makes the calibration from the bins.

Training uses labelled rows the caller gives, at most ``TRAIN_ROWS`` of them (a sample by hash of the id,
when there are more); everything else covers all rows.  Conflicting labels of one id: their mean.
Null or empty text: statistics of an empty text, scored like any other.  No usable label: score 0.5, and
every document is accepted.  Very long texts are taken whole, one at a time if need be.  Ties of scores share a bin and so a
calibrated score; 0.5 exactly is accepted.  Repeated rows: a row each, with one score.  An empty table: no rows.  Rows without an id
are scored but not learned from.  Other columns are passed on by :func:`accepted`, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_names, slices, stored

TRAIN_ROWS = 200_000
FEATURES = 256
FOLDS = 4
BINS = 400
RIDGE = 1.0
SEED = 11
NAMES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "lines", "distinct_lines", "line_length", "upper", "digits", "punctuation", "symbols", "bars",
    "exclamations", "stops", "commas", "non_ascii", "spaces", "byte_entropy", "longest_word", "doubled_words", "ends_of_lines",
)
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&<>^~=_\\", np.uint8))
_PUNCT = np.isin(np.arange(256), np.frombuffer(b"""!"'(),-./:;?[]{}|@`+""", np.uint8)) | _SYMBOL


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of NAMES."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = hist[hist > 0] / n
    ws = raw.split()
    nw = max(1, len(ws))
    counts = Counter(ws)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    nl = max(1, len(lines))
    letters = max(1, int(hist[_UPPER].sum() + hist[_LOWER].sum()))
    upper = int(hist[_UPPER].sum()) + raw.count(b"\xc3") - sum(raw.count(bytes([0xC3, b])) for b in (0xA0, 0xA4, 0xA7, 0xA8, 0xA9, 0xAA, 0xAD, 0xB1, 0xB3, 0xB6, 0xB9, 0xBA, 0xBC, 0x9F))
    return [
        math.log1p(len(raw)), math.log1p(len(ws)), (n - hist[[9, 10, 11, 12, 13, 32]].sum()) / nw, len(counts) / nw, max(counts.values(), default=0) / nw, math.log1p(nl), len(set(lines)) / nl, math.log1p(n / nl),
        min(1.0, max(0, upper) / letters), hist[_DIGIT].sum() / n, hist[_PUNCT].sum() / n, min(3.0, hist[_SYMBOL].sum() / nw), min(3.0, hist[124] / nw), min(3.0, hist[33] / nw), min(1.0, hist[46] / nw), min(1.0, hist[44] / nw),
        hist[128:].sum() / n, hist[32] / n, float(-(share * np.log2(share)).sum()) if len(raw) else 0.0, math.log1p(max(map(len, ws), default=0)), sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / nw, sum(x[-1:] in b".!?" for x in lines) / nl,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics ``x`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            x = np.array([statistics(t) for t in texts], float)
            at = np.arange(len(texts) + 1, dtype=np.int32) * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(at, x.ravel())], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray  # one column per fold left out, the last of all folds
    at: np.ndarray  # calibration: scores and the shares of label 1 there
    share: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.omega + self.phase
        return np.column_stack([np.cos(z) * math.sqrt(2 / len(self.phase)), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights[:, -1], self.at, self.share)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing fit of the means ``y`` with weights ``n`` by pooling adjacent violators."""
    out: list[list[float]] = []
    for v, w in zip(y, n, strict=True):
        out.append([v, w, 1])
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            b, a = out.pop(), out.pop()
            out.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in out]) if out else np.zeros(0)


def fit(labelled: DataFrame) -> Model | None:
    """``labelled``: doc_id, x, y. The model, or None without two kinds of labels."""
    with Scratch(labelled.sparkSession) as s:
        return _fit(labelled, s)


def _fit(labelled: DataFrame, scratch: Scratch) -> Model | None:
    total = labelled.agg(F.count(F.lit(1)), F.min("y"), F.max("y")).first()
    if not total[0] or total[1] == total[2]:
        return None
    chosen = labelled
    if total[0] > TRAIN_ROWS:
        chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < int((1 << 20) * TRAIN_ROWS / total[0]))
    # Bounded by TRAIN_ROWS, so are the partitions and with them the sums that reach the driver.
    chosen = scratch.kept(chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int")).coalesce(24))
    k = len(NAMES)
    moments = chosen.agg(*[F.avg(F.get("x", i)) for i in range(k)], *[F.stddev_pop(F.get("x", i)) for i in range(k)]).first()
    mean, scale = np.array(moments[:k]), np.array([s if s > 1e-9 else 1.0 for s in moments[k:]])
    rng = np.random.default_rng(SEED)
    omega, phase = rng.normal(size=(k, FEATURES)) / math.sqrt(k / 2), rng.uniform(0, 2 * math.pi, FEATURES)
    blank = Model(mean, scale, omega, phase, np.zeros((FEATURES + 1, 1)), np.zeros(1), np.zeros(1))
    m = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((FOLDS, m, m + 1))
        for b in batches:
            z, y, fold = blank.features(_matrix(b)), b.column("y").to_numpy(), b.column("fold").to_numpy()
            for f in range(FOLDS):
                own = fold == f
                a[f] += z[own].T @ np.column_stack([z[own], y[own]])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in a], pa.binary()), pa.array(range(FOLDS), pa.int32())], ["a", "fold"])

    each = np.zeros((FOLDS, m, m + 1))
    for r in chosen.mapInArrow(sums, "a binary, fold int").toLocalIterator():
        each[r["fold"]] += np.frombuffer(r["a"]).reshape(m, m + 1)
    whole, ridge = each.sum(0), RIDGE * np.eye(m)
    ridge[-1, -1] = 1e-6
    w = np.column_stack([np.linalg.solve(s[:, :-1] + ridge, s[:, -1]) for s in [*(whole - each), whole]])
    model = Model(mean, scale, omega, phase, w, np.zeros(1), np.zeros(1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            fold = b.column("fold").to_numpy()
            z = (model.features(_matrix(b)) @ model.weights)[np.arange(len(fold)), fold]
            at = np.clip(((z + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            n += np.bincount(at, minlength=BINS)
            s += np.bincount(at, b.column("y").to_numpy(), BINS)
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit]), pa.array(s[hit])], ["bin", "n", "s"])

    rows = chosen.mapInArrow(binned, "bin long, n double, s double").groupBy("bin").agg(F.sum("n"), F.sum("s")).orderBy("bin").collect()  # at most BINS rows
    bins, n, s = (np.array(v, float) for v in zip(*rows, strict=True))
    # A pinch of the base rate keeps the ends off 0 and 1.
    base = s.sum() / n.sum()
    share = isotonic((s + 0.5 * base) / (n + 0.5), n)
    return Model(mean, scale, omega, phase, w, (bins + 0.5) / BINS * 2 - 0.5, share)


def _learn(x: DataFrame, labels: DataFrame) -> Model | None:
    y = labels.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("y").cast("double")).alias("y"))
    return fit(x.where("doc_id is not null").join(y, "doc_id"))


def classify(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model | None]:
    """doc_id, score, predicted for every row of ``docs``; ``labels`` (doc_id, y) are the rows to learn from."""
    with Scratch(docs.sparkSession) as scratch:
        x = scratch.kept(measured(docs))
        model = _learn(x, labels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = model.score(_matrix(b)) if model else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

        return stored(x.mapInArrow(run, "doc_id long, score double, predicted int"), "quality-scores"), model


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects (score below 0.5); every column and row else stays."""
    # Statistics are taken a second time for the verdict: that is cheaper than to shuffle texts to their scores.
    with Scratch(docs.sparkSession) as scratch:
        model = _learn(scratch.kept(measured(docs)), labels)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        if not len(text) or not model:
            return pd.Series(np.full(len(text), 0.5))
        return pd.Series(model.score(np.array([statistics(t or "") for t in text], float)))

    name = free_names(docs, "quality")[0]
    good = docs.withColumn(name, score(F.col("text"))).where(F.col(name) >= 0.5)
    return good.select(*docs.columns)
