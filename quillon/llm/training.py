"""Bounded samples of labelled rows, and the calibration that both quality models share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most. They are those with the smallest hashes of the id.
SAMPLE_ROWS = 3000
#: Longer texts (in bytes) are no sample rows; with the number of rows this bounds what comes to the driver.
SAMPLE_BYTES = 1 << 16


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id's text is a multiple of 5."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[pa.Array, np.ndarray]:
    """Whole texts of at most ``SAMPLE_BYTES``, and 0/1 labels, of at most ``rows`` labelled rows outside the held-out fifth.

    Null ids and labels are left out; of rows that repeat an id the largest label counts, and one text of them.
    The ids are bounded by ``rows``, so they can be broadcast.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = text.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text")).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    return got.column("text").combine_chunks().take(pa.array(order)), got.column("label").to_numpy()[order].astype(np.float64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrate(raw: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Platt's (slope, offset): the probability of label 1 is sigmoid(slope * raw + offset). By Newton steps."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    centre, spread = raw.mean(), raw.std() + 1e-9
    x = np.stack([(raw - centre) / spread, np.ones(len(raw))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ b)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b -= np.clip(np.linalg.solve(h, x.T @ (p - target) + 1e-3 * b), -2, 2)
    return float(b[0] / spread), float(b[1] - b[0] * centre / spread)
