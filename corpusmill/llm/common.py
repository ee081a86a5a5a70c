"""Helpers of the training-data operators: shared folder, running totals, byte views of Arrow text."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.sources.materialize import materialized, new_folder

__all__ = [
    "binary_rows", "materialized", "new_folder", "others_as_json", "pieces", "ranges", "running_totals", "table", "text_bytes",
]

#: Rows of one Arrow batch handed to Python; with texts of a few kilobytes some megabytes.
#: Longer texts are cut into smaller groups by ``pieces``.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranges(spark: SparkSession) -> int:
    """Partitions for an ordered pass: as many as the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_totals(
    df: DataFrame, order: list[str], values: dict[str, str], group: str | None = None
) -> DataFrame:
    """Add, for each ``{total: value}``, the sum of ``value`` over the rows before this one.

    Rows are ordered by ``group`` and ``order``; with ``group`` each group starts
    at zero.  The rows are range partitioned and written once; each partition
    contributes one total per group, the prefix sums of these few totals are
    joined back, and a window adds the part inside the partition.  No group and
    not the whole table is ever in one task: a window partition is what one
    range of the order holds of a group.  Rows that tie in every order column
    may change places, so ``order`` should end with the columns that are
    returned.
    """
    spark, n = df.sparkSession, ranges(df.sparkSession)
    keys = [group] if group else []
    placed = df.repartitionByRange(n, *[F.col(c).asc_nulls_last() for c in [*keys, *order]]).withColumn(
        "_range", F.spark_partition_id()
    )
    placed = materialized(placed, "ranges")
    sums = placed.groupBy("_range", *keys).agg(*[F.sum(v).alias(f"_{t}") for t, v in values.items()])
    # One row per range and group that it holds: at most ranges + groups rows.
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("_range").alias("_r"), *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_{t}").over(ahead), F.lit(0)).alias(f"_{t}") for t in values],
    )
    match = F.col("_range") == F.col("_r")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = (
        Window.partitionBy("_range", *keys)
        .orderBy(*[F.col(c).asc_nulls_last() for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = placed.select(
        "*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{t}") for t, v in values.items()]
    )
    return local.join(starts, match).select(
        *df.columns, *[(F.col(f"_{t}") + F.col(f"_in_{t}")).alias(t) for t in values]
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow text column and the ``n + 1`` offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows of about ``limit`` text bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        _, offsets = text_bytes(batch.column(at))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column over the bytes of ``values`` cut at ``offsets`` (in bytes)."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())],
    )


def others_as_json(docs: DataFrame, row: str, left_out: tuple[str, ...] = ("text",)) -> Column:
    """The columns of a row struct but ``left_out`` as JSON: an order of rows that are else alike."""
    names = [c for c in docs.columns if c not in left_out]
    return F.to_json(F.struct(*[F.col(row).getField(c).alias(c) for c in names])) if names else F.lit("")


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D (null: 0)."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers find this package where it is installed beside the driver's copy.

    As ``spark.executorEnv.PYTHONPATH`` does, but also for a session that runs
    already.  On a cluster without a common installation submit with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
