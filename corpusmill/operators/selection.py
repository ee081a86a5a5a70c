"""Filling a line budget per repository from ordered save requests.

A request is accepted when its file exists, was not accepted before, the line
range is valid, it holds code and it fits under the cap.  A rejected request
uses no budget, so the outcome is an ordered fold and no running sum.

How the fold stays small.  Let C be the cap.  The running total never falls, so
once a request of ``n`` lines did not fit, no later request of ``n`` or more
lines fits.  Hence

* of equal (path, lines) requests only the first can be accepted;
* of one path only requests smaller than all earlier ones of that path can be
  accepted;
* of the remaining requests with ``n`` lines only the first ``C div n`` can be
  accepted: each of them was accepted itself (n lines) or its path had been
  accepted with more than n lines, until the first one that does not fit.

At most the sum of ``C div n`` over all n (about 61,000 for C = 6,500) requests
per repository can matter, whatever the table holds.  Slices of a repository are
cut to that bound first, in parallel; what remains meets in one task and is cut
and folded there.  All other rows are classified by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import languages as lang
from corpusmill.functions.paths import normal_path
from corpusmill.functions.shares import floor_share
from corpusmill.functions.text import decode_text, lines_with_breaks
from corpusmill.operators.skew import salt_of
from corpusmill.params import BudgetParams
from corpusmill.schemas import LOGIC_LAYERS
from corpusmill.sources.materialize import materialized
from corpusmill.sources.places import located, rows_at


def checked_requests(requests: DataFrame, masks: DataFrame) -> DataFrame:
    """Requests with lines of code and every reason that needs no history; a time ``ts`` stays with them."""
    start = F.greatest(F.lit(1), F.col("start_line")) - 1
    total = F.length("mask")
    end = F.least(F.col("end_line"), total)
    ranged = F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    chunk = F.when(ranged, F.substring("mask", start + 1, F.greatest(end - start, F.lit(0)))).otherwise(
        F.col("mask")
    )
    return (
        requests.withColumn("norm_path", normal_path(F.col("path")))
        .join(
            masks.select("repo_url", normal_path(F.col("path")).alias("norm_path"), "mask"),
            ["repo_url", "norm_path"],
            "left",
        )
        .select(
            "repo_url",
            "norm_path",
            "seq",
            "path",
            "layer",
            lang.language_of(F.col("path")).alias("language"),
            F.when(ranged, start).otherwise(F.lit(0)).alias("first_line"),
            F.when(ranged, end).otherwise(total).alias("last_line"),
            F.coalesce(ranged & ((start > 0) | (end < total)), F.lit(False)).alias("is_partial"),
            F.coalesce(lang.ones_in(chunk), F.lit(0)).cast("bigint").alias("loc"),
            F.when(F.col("mask").isNull(), "not_found").alias("missing"),
            F.when(ranged & (start >= end), "bad_range")
            .when(lang.ones_in(chunk) == 0, "zero_loc")
            .alias("flaw"),
            *[c for c in ("ts",) if c in requests.columns],
        )
    )


def _bounded_candidates(checked: DataFrame, params: BudgetParams) -> DataFrame:
    """The requests that can be accepted at all; see the module text."""
    first = (
        checked.where(F.col("missing").isNull() & F.col("flaw").isNull())
        .where(F.col("loc") <= params.cap_loc)
        .groupBy("repo_url", "norm_path", "loc")
        .agg(
            F.min("seq").alias("seq"),
            F.min_by(F.col("layer").isin(*LOGIC_LAYERS), "seq").alias("is_logic"),
        )
    )
    sliced = first.withColumn("slice", salt_of(["norm_path"], params.salts)).repartition(
        "repo_url", "slice"
    )
    # All windows below are inside one (repo_url, slice) partition: no shuffle.
    path_order = Window.partitionBy("repo_url", "slice", "norm_path").orderBy("seq")
    smaller = F.min("loc").over(path_order.rowsBetween(Window.unboundedPreceding, -1))
    same_path = Window.partitionBy("repo_url", "slice", "norm_path")
    slice_order = Window.partitionBy("repo_url", "slice", "loc").orderBy("seq")
    whole_order = Window.partitionBy("repo_url", "loc").orderBy("seq")
    enough = F.floor(F.lit(params.cap_loc) / F.col("loc"))
    return (
        sliced.withColumn("smaller", smaller)
        .withColumn("repeated", F.count("*").over(same_path) > 1)
        .where(F.col("smaller").isNull() | (F.col("loc") < F.col("smaller")))
        .withColumn("nth", F.row_number().over(slice_order))
        .where(F.col("nth") <= enough)
        .select("repo_url", "seq", "loc", "norm_path", "is_logic", "repeated")
        # The slices of a repository meet here, for this cut and for the fold.
        .repartition("repo_url")
        .withColumn("nth", F.row_number().over(whole_order))
        .where(F.col("nth") <= enough)
        .drop("nth")
    )


def _fold(candidates: Column, primary: Column, cap: int) -> Column:
    """Accepted requests in order, with running totals."""
    accepted = (
        "array<struct<seq:bigint,norm_path:string,loc:bigint,rank:bigint,"
        "running_total:bigint,logic_loc:bigint,primary_loc:bigint>>"
    )
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        zero.alias("total"),
        zero.alias("logic"),
        zero.alias("primary"),
        F.array().cast("array<string>").alias("repeated_paths"),
        F.array().cast(accepted).alias("accepted"),
    )

    def step(state: Column, request: Column) -> Column:
        total = state["total"] + request["loc"]
        logic = state["logic"] + F.when(request["is_logic"], request["loc"]).otherwise(zero)
        in_primary = F.coalesce(lang.language_of(request["norm_path"]) == primary, F.lit(False))
        primary_loc = state["primary"] + F.when(in_primary, request["loc"]).otherwise(zero)
        again = request["repeated"] & F.array_contains(state["repeated_paths"], request["norm_path"])
        row = F.struct(
            request["seq"].alias("seq"),
            request["norm_path"].alias("norm_path"),
            request["loc"].alias("loc"),
            (F.size(state["accepted"]) + 1).cast("bigint").alias("rank"),
            total.alias("running_total"),
            logic.alias("logic_loc"),
            primary_loc.alias("primary_loc"),
        )
        taken = F.struct(
            total.alias("total"),
            logic.alias("logic"),
            primary_loc.alias("primary"),
            F.when(
                request["repeated"],
                F.array_append(state["repeated_paths"], request["norm_path"]),
            ).otherwise(state["repeated_paths"]).alias("repeated_paths"),
            F.array_append(state["accepted"], row).alias("accepted"),
        )
        return F.when((total > cap) | again, state).otherwise(taken)

    return F.aggregate(F.array_sort(candidates), start, step, lambda state: state["accepted"])


def _accepted(checked: DataFrame, primaries: DataFrame | None, params: BudgetParams) -> DataFrame:
    grouped = (
        _bounded_candidates(checked, params)
        .groupBy("repo_url")
        .agg(
            F.collect_list(
                F.struct("seq", "loc", "norm_path", "is_logic", "repeated")
            ).alias("candidates")
        )
    )
    if primaries is None:
        grouped = grouped.withColumn("primary", F.lit(None).cast("string"))
    else:
        grouped = grouped.join(primaries.select("repo_url", "primary"), "repo_url", "left")
    folded = _fold(F.col("candidates"), F.col("primary"), params.cap_loc)
    return grouped.select("repo_url", "primary", folded.alias("accepted"))


def budget_select(
    requests: DataFrame,
    masks: DataFrame,
    primaries: DataFrame | None = None,
    params: BudgetParams = BudgetParams(),
) -> DataFrame:
    """Every request with its outcome.

    ``requests``: repo_url, seq (unique per repository), path, layer,
    start_line, end_line.  Writes two narrow tables to the shared folder.  ``masks``: output of ``profile.line_masks``, best
    written once beforehand.  ``primaries``: repo_url, primary.  Reasons, first
    match: not_found, duplicate, bad_range, zero_loc, budget_exhausted (total at
    target or above), too_large.
    """
    # Both are needed by several branches below; each is computed once.
    checked = materialized(checked_requests(requests, masks), "checked")
    per_repo = materialized(_accepted(checked, primaries, params), "accepted")
    accepted = per_repo.select("repo_url", "primary", F.explode("accepted").alias("a")).select(
        "repo_url",
        F.col("a.norm_path").alias("norm_path"),
        F.col("a.seq").alias("accepted_seq"),
        F.col("a.rank").alias("rank"),
        F.col("a.running_total").alias("running_total"),
        F.col("a.logic_loc").alias("logic_loc"),
        F.when(F.col("primary") != "", F.col("a.primary_loc")).alias("primary_loc"),
    )
    filled = F.filter("accepted", lambda a: a["running_total"] >= params.target_loc)
    target_reached = per_repo.select(
        "repo_url", F.try_element_at(filled, F.lit(1))["seq"].alias("target_seq")
    ).where(F.col("target_seq").isNotNull())
    joined = checked.join(accepted, ["repo_url", "norm_path"], "left").join(
        target_reached, "repo_url", "left"
    )
    saved = F.coalesce(F.col("seq") == F.col("accepted_seq"), F.lit(False))
    reason = F.coalesce(
        F.col("missing"),
        F.when(F.col("accepted_seq") < F.col("seq"), "duplicate"),
        F.col("flaw"),
        F.when(F.col("target_seq") < F.col("seq"), "budget_exhausted"),
        F.lit("too_large"),
    )

    def when_saved(value: Column | str) -> Column:
        return F.when(saved, value if isinstance(value, Column) else F.col(value))

    return joined.select(
        "repo_url",
        "seq",
        "path",
        "norm_path",
        "layer",
        "language",
        "first_line",
        "last_line",
        when_saved("loc").alias("loc"),
        when_saved("is_partial").alias("is_partial"),
        saved.alias("saved"),
        F.when(~saved, reason).alias("reason"),
        when_saved("rank").alias("rank"),
        when_saved("running_total").alias("running_total"),
        when_saved("logic_loc").alias("logic_loc"),
        when_saved("primary_loc").alias("primary_loc"),
    )


def running_shares(outcome: DataFrame, params: BudgetParams = BudgetParams()) -> DataFrame:
    """State of the sample after each accepted request."""
    total = F.col("running_total")
    return outcome.where("saved").select(
        "repo_url",
        "rank",
        "path",
        "loc",
        "running_total",
        F.greatest(F.lit(0), F.lit(params.target_loc) - total).cast("bigint").alias("remaining"),
        floor_share(F.col("logic_loc"), total).alias("logic_share"),
        F.when(F.col("primary_loc").isNotNull(), floor_share(F.col("primary_loc"), total)).alias(
            "primary_share"
        ),
    )


def saved_files(outcome: DataFrame) -> DataFrame:
    """Accepted requests as sample rows, without content."""
    return outcome.where("saved").select(
        "repo_url",
        "rank",
        "path",
        "norm_path",
        "layer",
        F.col("loc").alias("loc_taken"),
        "is_partial",
        "language",
        "first_line",
        "last_line",
    )


def _chunked(rows: DataFrame) -> DataFrame:
    """``content`` of saved files as the ``text`` that was taken of it."""
    lines = lines_with_breaks(F.col("text"))
    chunk = F.array_join(
        F.slice(lines, F.col("first_line") + 1, F.col("last_line") - F.col("first_line")), ""
    )
    return (
        rows.withColumn("text", decode_text(F.col("content")))
        .withColumn("text", F.when(F.col("is_partial"), chunk).otherwise(F.col("text")))
        .drop("content", "norm_path", "first_line", "last_line")
    )


#: Slots for the names of saved files: what is broadcast to find their content has at most so many rows.
SLOTS = 1 << 21


def sample_texts(saved: DataFrame, files: DataFrame) -> DataFrame:
    """Verbatim text of each saved file or line range, from files of any origin.

    Files whose name falls on the slot of no saved name are left out where they are read, so the
    join moves the content of saved files, and of the few others on their slots; it decides by name.
    ``stored_sample_texts`` moves no content.
    """
    slot = F.pmod(F.xxhash64("repo_url", "norm_path"), F.lit(SLOTS)).alias("_slot")
    content = files.select("repo_url", normal_path(F.col("path")).alias("norm_path"), "content").select("*", slot)
    taken = F.broadcast(saved.select(slot).distinct())
    near = content.join(taken, "_slot", "left_semi").drop("_slot")
    return _chunked(saved.join(near, ["repo_url", "norm_path"]))


def stored_sample_texts(saved: DataFrame, path: str) -> DataFrame:
    """``sample_texts`` from files that are stored as Parquet (schema ``FILES``) at ``path``.

    Only names and row places meet in the join; the content of the saved rows is then read
    where it lies, by tasks that each take a run of places, and never enters an exchange.
    """
    stored = saved.sparkSession.read.parquet(path)
    places = located(stored).select(
        "repo_url", normal_path(F.col("path")).alias("norm_path"), "row_file", "row_number"
    )
    return _chunked(rows_at(saved.join(places, ["repo_url", "norm_path"]), stored, ["content"]))
