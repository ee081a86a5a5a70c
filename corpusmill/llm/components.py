"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialized


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller end."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node that has an edge.

    A large-star step hangs every larger neighbour below the smallest one it is
    near, a small-star step does so for the smaller ones; both are a minimum per
    node, combined before the shuffle, and an equi-join that Spark may split.
    Rounds grow with the logarithm of the component size and are written to the
    shared folder, which also cuts the lineage.  Self edges and repeated edges do
    not matter.
    """
    now = materialized(_downward(edges.select(F.col(left).alias("a"), F.col(right).alias("b"))), "edges")
    seen = _fingerprint(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select(
            "n", F.least("n", "m").alias("m")
        )
        large = _downward(
            both.join(low, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("n"))
        now = materialized(
            _downward(
                small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                    low.select(F.col("n").alias("a"), F.col("m").alias("b"))
                )
            ),
            "edges",
        )
        after = _fingerprint(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
