"""Steering a sample by shares of lines: quotas per language and kind of file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.skew import first_rows
from corpusmill.params import BudgetParams, CandidateParams
from corpusmill.schemas import LOW_VALUE_LAYERS
from corpusmill.sources.materialize import materialized


def kind_of(layer: Column) -> Column:
    """``test``, ``low`` (layers of low value) or ``main``."""
    return F.when(layer == "test", "test").when(layer.isin(*LOW_VALUE_LAYERS), "low").otherwise("main")


def strata_of(rows: DataFrame) -> DataFrame:
    """Lines on offer per repository, kind and language; ``weight``: the repository's lines in that language."""
    lines = rows.groupBy("repo_url", kind_of(F.col("layer")).alias("kind"), "language").agg(F.sum("loc").alias("lines"))
    # At most three rows per repository and language.
    return lines.withColumn("weight", F.sum("lines").over(Window.partitionBy("repo_url", "language")))


def language_quotas(strata: DataFrame) -> DataFrame:
    """Strata with ``quota``: ``goal`` lines of a repository and kind, shared among its languages by weight.

    No language gets more than it has (``lines``); what it cannot take is
    shared among the others, so the quotas are the level of water poured over
    vessels as wide as the weights.  Whole lines by largest remainder, ties by
    language.  ``goal`` is at most the sum of the lines, weights are positive.
    All numbers are integers; a group has a row per language.
    """
    group = Window.partitionBy("repo_url", "kind")
    by_depth = group.orderBy(F.col("lines") / F.col("weight"), "language")
    ahead = by_depth.rowsBetween(Window.unboundedPreceding, -1)
    onward, everything = (by_depth.rowsBetween(start, Window.unboundedFollowing) for start in (0, Window.unboundedPreceding))
    poured = (
        strata.withColumn("left", F.col("goal") - F.coalesce(F.sum("lines").over(ahead), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(onward))
        .withColumn("full", F.col("lines") * F.col("rest") <= F.col("left") * F.col("weight"))
        # The first language that does not fill up sets the level for all after it.
        .withColumn("level", F.first(F.when(~F.col("full"), F.struct("left", "rest")), ignorenulls=True).over(everything))
        .withColumn("exact", F.col("level.left") * F.col("weight"))
        .withColumn("base", F.when(F.col("full"), F.col("lines")).otherwise(F.expr("exact div level.rest")))
        .withColumn("over", F.when(F.col("full"), F.lit(-1)).otherwise(F.col("exact") % F.col("level.rest")))
    )
    missing = F.col("goal") - F.sum("base").over(group)
    turn = F.row_number().over(group.orderBy(F.desc("over"), "language"))
    extra = (~F.col("full") & (turn <= missing)).cast("bigint")
    return poured.withColumn("quota", F.col("base") + extra).select(*strata.columns, "quota")


def _within(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Rows of each group, in order, as long as the lines before are below ``quota`` and with them at most ``room``.

    ``most`` rows are enough to fill any group, so a hot group is cut to them before it meets.
    """
    near = first_rows(rows.where(F.col("loc") <= F.col("room")), keys, [F.col("seq")], most, "_nth", salt_on=["path"])
    ahead = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("loc").over(ahead), F.lit(0))
    return near.withColumn("_before", before).where(
        (F.col("_before") < F.col("quota")) & (F.col("_before") + F.col("loc") <= F.col("room"))
    ).drop("_nth", "_before", "quota", "room")


def _picked(rows: DataFrame, strata: DataFrame, most: int, room: Column) -> DataFrame:
    """Files by language quotas, then files of any language for the lines that are left.

    Files are whole, so a language rarely meets its quota to the line; ``room``
    says how far the second pass may go beyond what is left.
    """
    of_language, of_kind = ["repo_url", "kind", "language"], ["repo_url", "kind"]
    quotas = language_quotas(strata).select(*of_language, "quota", F.col("quota").alias("room"))
    first = materialized(_within(rows.join(quotas, of_language), of_language, most), "picked")
    taken = first.groupBy(*of_kind).agg(F.sum("loc").alias("taken"))
    left = (
        strata.select(*of_kind, "goal").distinct().join(taken, of_kind, "left").fillna({"taken": 0})
        .select(*of_kind, (F.col("goal") - F.col("taken")).alias("quota"), room.alias("room"))
        .where(F.col("quota") > 0)
    )
    others = rows.join(first.select("repo_url", "seq"), ["repo_url", "seq"], "left_anti")
    second = _within(others.join(left, of_kind), of_kind, most)
    return materialized(first.unionByName(second.select(*first.columns)), "picked")


def steered_requests(
    rows: DataFrame, budget: BudgetParams = BudgetParams(), params: CandidateParams = CandidateParams()
) -> DataFrame:
    """The files of ``rows`` (as of ``candidates.numbered_candidates``) that make a sample with the wanted shares.

    Ordinary code comes first: as many lines as the target leaves beside the
    tests, shared among the languages as the repository's lines are.  Its lines
    settle the rest: tests between ``test_share_min`` and ``test_share_max`` of
    all lines (the middle where there is enough code, more where code is
    short), files of low value only for what is still missing and below
    ``low_value_share_max``.  Upper shares always hold while the repository has
    ordinary code that fits; the lower one where enough test files of fitting sizes
    exist.  Without ordinary code, tests and then the others fill the target.

    Within a stratum files go by ``seq``; a file that would pass the quota ends its stratum,
    and what is then missing is filled from all languages.  Ordinary code may pass its
    quota by a part of a file, never the cap.  Rows shorter than ``min_loc`` are left out.
    """
    least = max(1, params.min_loc)
    most = budget.cap_loc // least + 2
    target, cap = F.lit(budget.target_loc), F.lit(budget.cap_loc)
    low, high, dull = (
        round(1000 * s) for s in (budget.test_share_min, budget.test_share_max, budget.low_value_share_max)
    )
    middle = (low + high) // 2
    rows = rows.where(F.col("loc") >= least).withColumn("kind", kind_of(F.col("layer")))
    strata = materialized(strata_of(rows), "strata")

    def offered(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("lines"))), F.lit(0)).alias(kind)

    offers = strata.groupBy("repo_url").agg(*map(offered, ("main", "test", "low")))
    wish = F.least(F.col("test"), F.lit(budget.target_loc * middle // 1000))
    goals = offers.select("repo_url", F.lit("main").alias("kind"), F.least("main", target - wish).alias("goal"))
    main = _picked(rows, strata.join(goals, ["repo_url", "kind"]), most, cap - F.col("taken"))

    def beside(permille: int) -> Column:
        """Lines that are this share of themselves and the ordinary code."""
        return F.floor(F.col("done") * permille / (1000 - permille))

    def zero_or(lines: Column) -> Column:
        return F.greatest(lines, F.lit(0))

    done = main.groupBy("repo_url").agg(F.sum("loc").alias("done"))
    goals = (
        offers.join(done, "repo_url", "left").fillna({"done": 0})
        .withColumn("gap", target - F.col("done"))
        .withColumn(
            "tests",
            F.when(F.col("done") == 0, F.least("test", target)).otherwise(
                zero_or(F.least("test", F.greatest(F.col("gap"), beside(middle)), beside(high), cap - F.col("done")))
            ),
        )
        .withColumn(
            "dull",
            F.when(F.col("done") == 0, F.least(F.col("low"), target - F.col("tests"))).otherwise(
                zero_or(F.least(F.col("low"), F.col("gap") - F.col("tests"), beside(dull)))
            ),
        )
        .select("repo_url", F.explode(F.create_map(F.lit("test"), "tests", F.lit("low"), "dull")).alias("kind", "goal"))
        .where(F.col("goal") > 0)
    )
    others = _picked(rows, strata.join(goals, ["repo_url", "kind"]), most, F.col("goal") - F.col("taken"))
    return main.unionByName(others).select(
        "repo_url", "seq", "path", "layer", "language", "loc", "start_line", "end_line"
    )
