"""Operator 10: a regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (``NAMES``); nothing else of
a row is an input. Each class is a Gaussian whose covariance is shrunk towards
the classes' common one and towards its diagonal. A score is the logistic of the
difference of the two log densities, taken from Mahalanobis distances by the
classes' Cholesky factors, which are made once and sent to every task.

A null text counts as empty; empty texts get a vector and a score like others.
Rows without an id are never learned from and not held out. Label rows without a
label, or for unknown documents, are ignored; repeated label rows count each.
Where a class has no labels to learn from, every score is the share of label 1
(0.5 without any labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, table, written

NAMES = ["words", "word_size", "line_size", "distinct", "again", "lines_again", "capitals", "digits", "symbols", "marks", "loud", "spaces", "other", "bare"]
#: Weight of the common covariance, and of its diagonal, in a class's own.
SHRINK, DIAGONAL, FLOOR = 0.1, 0.05, 1e-3

_BYTE = np.zeros(256, np.int64)  # 0 other, then by kind of character
_BYTE[[*range(0x61, 0x7B), *range(0xC0, 0x100)]] = 1
_BYTE[0x41:0x5B] = 2
_BYTE[0x30:0x3A] = 3
_BYTE[[ord(c) for c in "#*$%&|<>{}[]^~=+@\\/_"]] = 4
_BYTE[[ord(c) for c in ".,;:'\"()-"]] = 5
_BYTE[[ord(c) for c in "!?"]] = 6
_BYTE[[0x20, 9, 10, 11, 12, 13]] = 7
_BYTE[0x80:0xC0] = 8  # inside a character of several bytes


def statistics(text: str) -> list[float]:
    """The vector of NAMES: sizes as logarithms, shares scaled and as logarithms."""
    kinds = np.bincount(_BYTE[np.frombuffer(text.encode(), np.uint8)], minlength=9).tolist()
    other, lower, upper, digits, symbols, marks, loud, spaces, _ = kinds
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    one, chars = max(n, 1), max(sum(kinds) - kinds[8], 1)
    windows = max(n - 2, 1)
    shares = [
        len(set(words)) / one,
        1 - len(set(zip(words, words[1:], words[2:]))) / windows if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        upper / max(upper + lower, 1),
        digits / chars,
        symbols / one,
        marks / one,
        loud / one,
        spaces / one,
        other / chars,
        1.0 if n == 0 else 0.0,
    ]
    return [np.log1p(n), np.log1p((chars - spaces) / one), np.log1p(chars / max(len(lines), 1)), *[np.log1p(10 * max(s, 0.0)) for s in shares]]


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, one column for each of NAMES)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t or "") for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x[:, i]) for i in range(len(NAMES))]], ["doc_id", *NAMES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(per_batch(run), "doc_id long, " + ", ".join(f"{n} double" for n in NAMES))


@dataclass(frozen=True)
class Discriminant:
    """priors and means by class; factors: inverse Cholesky factors; logs: half log determinants."""

    share: float
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    logs: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        x = (x - self.centre) / self.scale
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            density.append(-0.5 * (z * z).sum(1) - self.logs[k])
        gap = density[1] - density[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def fitted(labelled: DataFrame, label: str = "label") -> Discriminant:
    """Fit on rows of NAMES and a 0/1 label. Sums only leave Spark: one row a class."""
    zero, unit = np.zeros(len(NAMES)), np.ones(len(NAMES))
    whole = labelled.agg(F.count("*").alias("n"), F.avg(label).alias("share"), *[F.avg(n).alias(f"m_{n}") for n in NAMES], *[F.stddev_pop(n).alias(f"s_{n}") for n in NAMES]).first()
    if not whole["n"]:
        return Discriminant(0.5, zero, unit)
    share = float(whole["share"])
    if share in (0.0, 1.0):
        return Discriminant(share, zero, unit)
    centre = np.array([whole[f"m_{n}"] for n in NAMES])
    scale = np.maximum([whole[f"s_{n}"] for n in NAMES], FLOOR)
    z = {n: (F.col(n) - float(centre[i])) / float(scale[i]) for i, n in enumerate(NAMES)}
    pairs = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]
    sums = labelled.groupBy(label).agg(
        F.count("*").alias("n"),
        *[F.sum(z[n]).alias(f"a{i}") for i, n in enumerate(NAMES)],
        *[F.sum(z[NAMES[i]] * z[NAMES[j]]).alias(f"b{i}_{j}") for i, j in pairs],
    )
    means, spread, counts = np.zeros((2, len(NAMES))), np.zeros((2, len(NAMES), len(NAMES))), np.zeros(2)
    for row in sums.collect():
        k = int(row[label])
        counts[k] = row["n"]
        means[k] = np.array([row[f"a{i}"] for i in range(len(NAMES))]) / row["n"]
        for i, j in pairs:
            spread[k, i, j] = spread[k, j, i] = row[f"b{i}_{j}"] / row["n"] - means[k, i] * means[k, j]
    common = (counts[:, None, None] * spread).sum(0) / counts.sum()
    common = (1 - DIAGONAL) * common + DIAGONAL * np.diag(np.diag(common))
    factors, logs = np.zeros_like(spread), np.zeros(2)
    for k in (0, 1):
        lower = np.linalg.cholesky((1 - SHRINK) * spread[k] + SHRINK * common + FLOOR * np.eye(len(NAMES)))
        factors[k] = np.linalg.inv(lower)
        logs[k] = np.log(np.diag(lower)).sum()
    return Discriminant(share, centre, scale, means, factors, logs)


def _remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for each row, learned from rows that aren't held out."""
    x = written(vectors(docs), "vectors")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & (_remainder(F.col("doc_id")) != 1))
    model = fitted(x.join(known, "doc_id"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.column_stack([batch.column(n).to_numpy() for n in NAMES])
        score = model.scores(values)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = x.mapInArrow(per_batch(run), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(_remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
