"""Group-wise operators that stay distributed when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.materialize import materialized


def salt_of(columns: Sequence[str], salts: int) -> Column:
    """Slice number of a row, the same whenever the row is recomputed."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each group from 1 without gathering a group in one task.

    Rows are dealt into ranges of the order and written once; each range counts
    its rows per group, the counts of the ranges before are added up, and a
    window numbers the rows inside a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = materialized(dealt, "ranked")
    # One row per range and group in it.
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range", *keys).agg(F.count("*").alias("_n")).select(
        F.col("_range").alias("_r"), *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"),
    )
    match = F.col("_range") == F.col("_r")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    inside = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    return dealt.withColumn("_inside", inside).join(offsets, match).select(
        *df.columns, (F.col("_offset") + F.col("_inside")).alias(name)
    )


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int,
    rank: str = "rank",
    salt_on: Sequence[str] = (),
    salts: int = 16,
) -> DataFrame:
    """The first ``limit`` rows of each group, numbered from 1.

    Each slice of a group is cut to ``limit`` rows before the group meets in
    one task, and Spark cuts every map task's part before the shuffle
    (``WindowGroupLimit``), so the task that ranks a group sees at most
    ``salts * limit`` rows of it.
    """
    number = "_row_number"
    if salt_on:
        sliced = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt_of(salt_on, salts))
            .withColumn(number, F.row_number().over(sliced))
            .where(F.col(number) <= limit)
            .drop(number, "_salt")
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(number, F.row_number().over(whole))
        .where(F.col(number) <= limit)
        .withColumn(rank, F.col(number).cast("bigint"))
        .drop(number)
    )


def leading_rows(
    df: DataFrame, keys: Sequence[str], lead: Column, ties: Sequence[Column], salt_on: Sequence[str] = (), sized: bool = False
) -> DataFrame:
    """The row of each group with the greatest ``lead``, the first by ``ties`` among equals.

    ``lead`` has a fixed width, so its maximum per group is a hash aggregate
    that combines before the shuffle and sorts nothing; whole rows are touched
    only where they equal it.  With few groups Spark broadcasts the maxima; with many, combining would
    not have shrunk the rows anyway; before it has run an aggregate seems as large as its input, so ``sized``
    writes the maxima first, which tells few from many.  Rows without a lead count only where their group has no others; null keys
    are a group.
    """
    marked = df.withColumn("_lead", lead)
    tops = marked.groupBy(*keys).agg(F.max("_lead").alias("_top"))
    tops = tops.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_top")
    if sized:
        tops = materialized(tops, "tops")
    match = F.col("_lead").eqNullSafe(F.col("_top"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    hits = marked.join(tops, match).select(*df.columns)
    return first_rows(hits, keys, ties, 1, rank="_rank", salt_on=salt_on).drop("_rank")
