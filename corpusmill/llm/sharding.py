"""Contiguous byte-balanced shards from global prefix sums (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import running_totals

LAW = "bytes"


def shard_by_bytes(
    docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", overhead: int = 8
) -> DataFrame:
    """Cut the table, ordered by ``key``, into contiguous shards of nearly equal size.

    A row's size is its UTF-8 bytes plus ``overhead`` (null text: ``overhead``
    alone).  Per-range totals give every row the bytes before it in the whole
    table; the shard is where the row's middle falls on ``n_shards`` equal
    parts of all bytes, so no shard differs from its part by more than one row
    at either end.  ``slot`` numbers the rows of a shard from 0.

    Law ``bytes``: ``grown_shard`` is null.  Equal texts are not kept together.
    Null keys come last; rows equal in key, size and checksum are
    interchangeable.  An empty table gives no rows; empty and null texts have
    checksum 0.  Only ``key`` and ``text`` are read; other columns do not
    matter, whatever their names.
    """
    sized = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit(1).cast("long").alias("one"),
    )
    placed = running_totals(
        sized, ["doc_id", "size", "text_crc32"], {"before": "size", "position": "one"}
    )
    total = sized.agg(F.sum("size").alias("total"))  # one row
    cut = placed.join(total, F.lit(True)).select(
        "doc_id", "size", "text_crc32", "position",
        F.expr(f"cast(((2 * before + size) * {int(n_shards)}) div (2 * total) as int)").alias("shard"),
    )
    first = cut.groupBy("shard").agg(F.min("position").alias("first"))  # n_shards rows
    return cut.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
