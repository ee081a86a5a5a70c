"""Bounded, repeatable samples of labelled rows, and fitting in one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(key) -> F.Column:
    """Rows whose crc32 of the key's text leaves 0 modulo 5: never trained on."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, limit: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """At most ``limit`` labelled rows outside the held-out fifth, the same ones on every run.

    Ids are drawn by hash order from the label table alone; only their texts
    are then fetched.  Columns: doc_id, label, text.  Rows without a label, key
    or text take no part; an id labelled twice counts with its larger label,
    one with several rows with the text of the least hash.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("double")).alias("_label"))
        .orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(limit)
    )
    return (
        docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("text"))
        .join(ids, "_id")
        .groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("_least"))
        .select(F.col("_id").alias("doc_id"), F.col("_label").alias("label"), F.col("_least.text").alias("text"))
    )


def fitted(sample: DataFrame, fit: Callable[[pa.Table], bytes]) -> bytes:
    """Fit in one task on a bounded sample; only the model comes to the driver (empty without rows)."""
    def run(batches):
        parts = [b for b in batches if b.num_rows]
        model = fit(pa.Table.from_batches(parts)) if parts else b""
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else b""


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def calibration(scores: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve that maps scores to probabilities (Newton, smoothed targets)."""
    positive, negative = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    spread = scores.std() or 1.0
    centre = scores.mean() if len(scores) else 0.0
    x = np.column_stack([(scores - centre) / spread, np.ones(len(scores))])
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = logistic(x @ beta)
        gradient = x.T @ (p - target) + 1e-3 * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1] - beta[0] * centre / spread)
