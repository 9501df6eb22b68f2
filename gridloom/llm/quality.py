"""Quality scores by a regularised quadratic discriminant over transformed document statistics.

Each text gives a vector of smoothed, variance-stabilised statistics. The two classes' means and covariances come from
sums over all labelled training rows (no sample); covariances are shrunk towards the pooled one and its diagonal. A score
is the difference of Mahalanobis log densities under cached Cholesky factors, calibrated by a logistic fit to a histogram
of training differences.

Defined results: a null or empty text has the statistics of no words; rows with the same doc_id each get their own score;
a null doc_id is never a training row and not held out; with labels of one class only, or none, every score is that class
(or 0.5). Only doc_id and text are read from documents, doc_id and the label from labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens
from gridloom.llm.common import Scratch, distinct_labels, fold, list_array, map_text, only
from gridloom.plans.shipping import ship

_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_STOP = np.isin(np.arange(256), list(b".,;:?"))
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*+/<=>@\\^_`{}~[]()"))
STATISTICS = ("log_words", "log_bytes_a_word", "word_length_deviation", "upper", "digits", "stops", "symbols", "bangs", "bars", "high", "lines", "short_words", "symbol_ends", "bar_words", "capital_words", "repeats", "distinct", "shouted", "digit_words")


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS a text. Shares are smoothed by a few typical units, so that short texts stay near the middle."""
    data, start, end, doc = tokens.word_spans(texts)
    hashes, words = tokens.word_hashes(texts)
    n = len(texts)
    size = np.array([len(t) for t in texts], np.float64)
    owner = np.repeat(np.arange(n), (size + 1).astype(np.int64))
    byte_sum = lambda table: np.bincount(owner, table[data], n)
    word_sum = lambda v: np.bincount(doc, v, n)
    share = lambda k, of, prior, weight: np.arcsin(np.sqrt(np.clip((k + prior * weight) / (of + weight), 0, 1)))
    length = (end - start).astype(np.float64)
    first, last = data[start], data[end - 1]
    same_doc = np.zeros(len(doc), bool)
    same_doc[1:] = doc[1:] == doc[:-1]
    repeat = same_doc.copy()
    repeat[1:] &= hashes[1:] == hashes[:-1]
    order = np.lexsort((hashes, doc))
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], fresh, n)
    w = words.astype(np.float64)
    mean = word_sum(length) / np.maximum(w, 1)
    spread = np.sqrt(np.maximum(word_sum(length**2) / np.maximum(w, 1) - mean**2, 0))
    upper, lower = byte_sum(_UPPER), byte_sum(_LOWER)
    table = lambda c: np.arange(256) == c
    columns = [
        np.log1p(w), np.log1p((mean * w + 5.0 * 5) / (w + 5)), np.log1p((spread * w + 2.5 * 5) / (w + 5)),
        share(upper, upper + lower, 0.03, 40), share(byte_sum(_DIGIT), size, 0.003, 40), share(byte_sum(_STOP), size, 0.02, 40),
        share(byte_sum(_SYMBOL), size, 0.002, 40), share(byte_sum(table(33)), size, 0.001, 40), share(byte_sum(table(124)), size, 0.0005, 40),
        share(byte_sum(_HIGH), size, 0.02, 40), share(byte_sum(table(10)), size, 0.005, 40), share(word_sum(length <= 3), w, 0.3, 8),
        share(word_sum(_SYMBOL[last]), w, 0.002, 8), share(word_sum((length == 1) & (first == 124)), w, 0.001, 8), share(word_sum(_UPPER[first]), w, 0.08, 8),
        share(word_sum(repeat), w, 0.01, 8), (distinct + 4) / np.sqrt(w + 16), share(word_sum(_UPPER[first] & (last == 33)), w, 0.001, 8), share(word_sum(_DIGIT[first]), w, 0.005, 8),
    ]
    return np.column_stack(columns)


def document_statistics(docs: DataFrame) -> DataFrame:
    def run(keys, texts):
        x = statistics(texts)
        return {"doc_id": keys["doc_id"], "x": list_array(x.ravel(), np.full(len(texts), x.shape[1]), pa.float64())}

    return map_text(only(docs, "doc_id", "text"), ["doc_id", "text"], run, "doc_id long, x array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def class_sums(rows: DataFrame, width: int) -> dict[int, np.ndarray]:
    """y -> [n, sums, sums of products], added up in Spark: (1 + width + width**2) numbers a class reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            x, y = _matrix(b.column(1), width), b.column(0).to_numpy()
            for k in np.unique(y):
                part = x[y == k]
                add = np.concatenate(([len(part)], part.sum(0), (part.T @ part).ravel()))
                held[int(k)] = held.get(int(k), 0) + add
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v], pa.list_(pa.float64()))], ["y", "v"])

    ship(rows.sparkSession)
    parts = rows.select("y", "x").mapInArrow(run, "y int, v array<double>")
    total = parts.select("y", F.posexplode("v").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for k, g in total.groupby("y"):
        out[int(k)] = g.sort_values("i")["v"].to_numpy()
    return out


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverse: list[np.ndarray]  # of the covariances' Cholesky factors
    constant: float
    slope: float = 1.0
    shift: float = 0.0
    only_class: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with priors."""
        z = (x - self.centre) / self.scale
        d = [np.square((z - m) @ li.T).sum(1) for m, li in zip(self.means, self.inverse, strict=True)]
        return 0.5 * (d[0] - d[1]) + self.constant

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only_class is not None:
            return np.full(len(x), self.only_class)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(self.difference(x), -40, 40) + self.shift, -40, 40)))


def fit_discriminant(sums: dict[int, np.ndarray], width: int, to_pooled: float = 0.1, to_diagonal: float = 0.05) -> Discriminant:
    """to_pooled and to_diagonal: shrinkage of a class's covariance towards the pooled one, and of that sum towards its diagonal."""
    if set(sums) != {0, 1} or min(v[0] for v in sums.values()) < 2:
        one = max(sums, key=lambda k: sums[k][0]) if sums else 0.5
        unit = np.eye(width)
        return Discriminant(np.zeros(width), np.ones(width), [np.zeros(width)] * 2, [unit] * 2, 0.0, only_class=float(one))
    total = sums[0] + sums[1]
    centre = total[1 : 1 + width] / total[0]
    scale = np.sqrt(np.maximum(np.diag(total[1 + width :].reshape(width, width)) / total[0] - centre**2, 1e-8))
    means, covs, ns = [], [], []
    for k in (0, 1):
        n, m, q = sums[k][0], sums[k][1 : 1 + width], sums[k][1 + width :].reshape(width, width)
        mean = m / n
        covs.append((q / n - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - centre) / scale)
        ns.append(n)
    pooled = (ns[0] * covs[0] + ns[1] * covs[1]) / sum(ns)
    inverse, logdet = [], []
    for c in covs:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(width)
        factor = np.linalg.cholesky(c)
        inverse.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, means, inverse, 0.5 * (logdet[0] - logdet[1]) + np.log(ns[1] / ns[0]))


def _calibrate(model: Discriminant, rows: DataFrame, width: int) -> None:
    """A logistic fit of the label on the clipped difference, from counts in bins of 0.5."""

    def run(batches):
        held = np.zeros((2, 161))
        for b in batches:
            at = np.rint(np.clip(model.difference(_matrix(b.column(1), width)), -40, 40) * 2).astype(int) + 80
            np.add.at(held, (b.column(0).to_numpy(), at), 1)
        k, at = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(held[k, at], pa.float64())], ["y", "b", "n"])

    got = rows.select("y", "x").mapInArrow(run, "y int, b int, n double").groupBy("y", "b").agg(F.sum("n").alias("n")).toPandas()
    d, y, n = (got["b"].to_numpy() - 80) / 2, got["y"].to_numpy(float), got["n"].to_numpy()
    beta = np.array([0.2, 0.0])
    design = np.column_stack((d, np.ones(len(d))))
    prior = np.array([1e-2, 1e-2])  # a little ridge: separable classes stay finite
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        grad = design.T @ (n * (p - y)) + prior * beta
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(prior)
        step = np.linalg.solve(hess, grad)
        beta = beta - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    if beta[0] > 0:
        model.slope, model.shift = float(beta[0]), float(beta[1])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows with crc32(doc_id) mod folds = held are not learned from."""
    width = len(STATISTICS)
    scratch = Scratch(docs.sparkSession)
    stats = scratch.table(document_statistics(docs))
    known = distinct_labels(labels, "quality").where("y in (0, 1)").where(fold(F.col("doc_id"), folds) != held)
    train = scratch.table(stats.join(known, "doc_id").select("y", "x"))
    model = fit_discriminant(class_sums(train, width), width)
    if model.only_class is None:
        _calibrate(model, train, width)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(_matrix(b.column(2), width)))], ["doc_id", "held_out", "score"])

    flagged = stats.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "x")
    out = flagged.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
