"""Quality classifier: a regularised quadratic discriminant.

Documents become transformed statistics (shares under square roots, counts under logarithms). Each class has a mean and a
covariance that is shrunk towards the pooled one and towards a multiple of the identity; the score is the logistic of the
difference of the classes' log densities (Mahalanobis distances by cached Cholesky factors) plus the log prior, divided by
a temperature. Shrinkage and temperature are chosen by log loss on a quarter of the training rows (crc32 mod 4 = 3).

Moments are sums over all training rows, so that training is one distributed aggregation of fixed size. They are added as
whole numbers, and scores are rounded to 12 decimals, so that reruns over other partitions agree; labels, lang,
source and doc_id are no features, and rows whose crc32(doc_id as text) mod 4 is 2 are never learnt from.

Defined results
* null or empty text: all statistics 0, scored like any other. Very long texts: all of the text counts.
* null doc_id: `held_out` is null and the row is not learnt from. Repeated rows: each is scored; each of its labels counts once.
* labels other than 0 and 1, or null, are ignored. Without labels of both classes every score is the share of class 1, or 0.5.
* empty table: an empty result. Further columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, mix64, pieces_by_bytes, read_table, text_buffers
from .ngram_join import word_hashes

SHRINKAGE = (0.02, 0.1, 0.3, 0.6)
RIDGE = 0.02
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0)
ACCEPT = 0.7
HELD_OUT, TUNING = 2, 3
_PIECE = 1 << 18
#: Statistics are rounded to so many steps a unit, so that sums of their products are exact, whatever the order of adding (up to 2^53 steps^2 a task).
STEPS = 1 << 12

FEATURES = (
    "log_words", "log_word_length", "adjacent_repeats", "other_words", "repeated_pairs", "upper_share", "symbol_share",
    "exclaim_share", "digit_share", "stop_share", "wide_share", "log_words_a_line", "bar_share", "comma_share",
)


def _count(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets)).astype(float)


def _table(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in chars]] = True
    return found


_UPPER, _DIGITS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_SYMBOLS, _EXCLAIM, _STOP, _BAR, _COMMA = _table("#*$%&<>@^~_=+{}[]\\"), _table("!"), _table(".?"), _table("|"), _table(",;:")


def document_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each of the texts that lie end to end."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    h, cut = word_hashes(data, offsets)
    words = np.diff(cut).astype(float)
    row = np.repeat(np.arange(n), np.diff(cut))

    def distinct(x, r):
        order = np.lexsort((x, r))
        x, r = x[order], r[order]
        first = np.ones(len(x), bool)
        first[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[first], minlength=n)

    inside = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    same = np.bincount(row[1:][inside & (h[1:] == h[:-1])], minlength=n) if len(row) else np.zeros(n)
    pair = mix64(h[:-1] * np.uint64(3) + h[1:])[inside] if len(row) else h
    pair_row = row[1:][inside] if len(row) else row
    kinds, pair_kinds = distinct(h, row), distinct(pair, pair_row)
    pairs = np.maximum(words - 1, 0)
    lines = _count(data == 10, offsets) + 1
    some, some_pairs, some_bytes = np.maximum(words, 1), np.maximum(pairs, 1), np.maximum(size, 1)
    blank = size - _count(data > 32, offsets)
    out = np.stack([
        np.log1p(words),
        np.log1p((size - blank) / some),
        np.sqrt(same / some_pairs),
        np.sqrt(kinds / some),
        np.sqrt((pairs - pair_kinds) / some_pairs),
        np.sqrt(_count(_UPPER[data], offsets) / some_bytes),
        np.sqrt(_count(_SYMBOLS[data], offsets) / some),
        np.sqrt(_count(_EXCLAIM[data], offsets) / some),
        np.sqrt(_count(_DIGITS[data], offsets) / some_bytes),
        np.sqrt(_count(_STOP[data], offsets) / some),
        np.sqrt(_count(data >= 0x80, offsets) / some_bytes),
        np.log1p(words / lines),
        np.sqrt(_count(_BAR[data], offsets) / some),
        np.sqrt(_count(_COMMA[data], offsets) / some),
    ], axis=1)
    out[size == 0] = 0
    return np.rint(out * STEPS) / STEPS


def feature_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, x (array of FEATURES), fold (crc32 of doc_id as text, mod 4)."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first, last in pieces_by_bytes(offsets, _PIECE):
                x = document_statistics(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                cuts = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.reshape(-1)))], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, x array<double>").withColumn("fold", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).cast("int"))


def _x(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def class_moments(labelled: DataFrame) -> dict[tuple[int, bool], np.ndarray]:
    """For each class and part (tuning or not) the sum of outer products of (1, x): counts, sums and products in one."""
    import pyarrow as pa

    m = len(FEATURES) + 1

    def run(batches):
        sums: dict[tuple[int, bool], np.ndarray] = {}
        for batch in batches:
            x = np.hstack([np.ones((batch.num_rows, 1)), _x(batch.column(0))])
            y, tuning = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False) == TUNING
            for c in (0, 1):
                for t in (False, True):
                    part = x[(y == c) & (tuning == t)]
                    sums[c, t] = sums.get((c, t), 0) + part.T @ part
        for (c, t), s in sums.items():
            whole = np.rint(s.reshape(-1) * STEPS**2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m * m, c)), pa.array(np.full(m * m, t)), pa.array(np.arange(m * m)), pa.array(whole)], ["y", "t", "k", "s"])

    parts = labelled.select("x", "y", "fold").mapInArrow(run, "y bigint, t boolean, k bigint, s bigint")
    found = {(c, t): np.zeros(m * m) for c in (0, 1) for t in (False, True)}
    for r in parts.groupBy("y", "t", "k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        found[r["y"], r["t"]][r["k"]] = float(r["s"]) / STEPS**2
    return {k: v.reshape(m, m) for k, v in found.items()}


@dataclass
class Discriminant:
    """Two Gaussian classes: means, inverse Cholesky factors, log determinants and the log prior odds of class 1."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    prior: float

    @classmethod
    def fit(cls, moments: list[np.ndarray], shrink: float) -> "Discriminant":
        counts = [max(s[0, 0], 1.0) for s in moments]
        means = [s[0, 1:] / n for s, n in zip(moments, counts)]
        spread = [s[1:, 1:] / n - np.outer(u, u) for s, n, u in zip(moments, counts, means)]
        pooled = (counts[0] * spread[0] + counts[1] * spread[1]) / sum(counts)
        round_ = np.eye(len(pooled)) * np.trace(pooled) / len(pooled)
        factors, log_dets = [], []
        for s in spread:
            c = (1 - RIDGE) * ((1 - shrink) * s + shrink * pooled) + RIDGE * round_ + 1e-9 * np.eye(len(pooled))
            low = np.linalg.cholesky(c)
            factors.append(np.linalg.inv(low))
            log_dets.append(2 * float(np.log(np.diag(low)).sum()))
        return cls(means, factors, log_dets, float(np.log(counts[1] / counts[0])))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, plus the log prior odds."""
        away = [(((x - u) @ f.T) ** 2).sum(axis=1) + d for u, f, d in zip(self.means, self.factors, self.log_dets)]
        return (away[0] - away[1]) / 2 + self.prior


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(labelled: DataFrame) -> tuple[Discriminant | None, float, float]:
    """(model, temperature, score where there is no model) from rows (x, y, fold)."""
    import pyarrow as pa

    moments = class_moments(labelled)
    whole = [moments[c, False] + moments[c, True] for c in (0, 1)]
    n0, n1 = whole[0][0, 0], whole[1][0, 0]
    if not n0 or not n1:
        return None, 1.0, n1 / (n0 + n1) if n0 + n1 else 0.5
    shrink, temperature = SHRINKAGE[1], TEMPERATURES[2]
    if min(moments[c, t][0, 0] for c in (0, 1) for t in (False, True)):
        tried = [Discriminant.fit([moments[0, False], moments[1, False]], s) for s in SHRINKAGE]

        def run(batches):
            loss = np.zeros((len(SHRINKAGE), len(TEMPERATURES)))
            for batch in batches:
                x, y = _x(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                for i, model in enumerate(tried):
                    z = model.margin(x)
                    for j, t in enumerate(TEMPERATURES):
                        p = np.clip(_logistic(z / t), 1e-9, 1 - 1e-9)
                        loss[i, j] -= np.log(np.where(y == 1, p, 1 - p)).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(loss.size)), pa.array(loss.reshape(-1))], ["k", "loss"])

        parts = labelled.filter(F.col("fold") == TUNING).select("x", "y").mapInArrow(run, "k bigint, loss double")
        rows = parts.groupBy("k").agg(F.sum(F.col("loss").cast("decimal(38,9)")).alias("loss")).collect()
        best = min(rows, key=lambda r: (round(r["loss"], 6), r["k"]))["k"]
        shrink, temperature = SHRINKAGE[best // len(TEMPERATURES)], TEMPERATURES[best % len(TEMPERATURES)]
    return Discriminant.fit(whole, shrink), temperature, 0.5


def score_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    import pyarrow as pa

    features = cut_lineage(feature_table(docs, text_col))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("y")).filter("y in (0, 1)")
    labelled = features.filter(F.col("fold") != HELD_OUT).join(known, "doc_id").select("x", "y", "fold")
    model, temperature, without = train(labelled)

    def run(batches):
        for batch in batches:
            p = _logistic(model.margin(_x(batch.column(1))) / temperature) if model else np.full(batch.num_rows, without)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.round(p, 12))], ["doc_id", "fold", "score"])

    scored = features.select("doc_id", "x", "fold").mapInArrow(run, "doc_id bigint, fold int, score double")
    return scored.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
