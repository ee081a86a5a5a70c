"""Jobs over run logs: progress flags, run statistics, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.shares import loc_needed
from corpusmill.functions.text import collapse_space
from corpusmill.operators.skew import leading_rows
from corpusmill.params import BudgetParams
from corpusmill.schemas import LOGIC_LAYERS

LANGUAGE_EVERY = 3
LOGIC_EVERY = 4
IDLE_TURNS = 4
LAST_TURNS = 5
FIRST_SAVE_BY = 3


def _turn_sums(saves: DataFrame, goals: DataFrame, params: BudgetParams) -> DataFrame:
    """Per run the goal and, per turn, what its saves added.

    Saves are summed per turn before the shuffle; a run keeps one entry per
    turn with saves.  Runs of ``goals`` without any save are there too.
    """
    by_turn = (
        saves.groupBy("run_id", "turn", "language")
        .agg(
            F.count_if("saved").alias("files"),
            F.coalesce(F.sum(F.when(F.col("saved"), F.col("loc"))), F.lit(0)).alias("loc"),
            F.coalesce(
                F.sum(F.when(F.col("saved") & F.col("layer").isin(*LOGIC_LAYERS), F.col("loc"))),
                F.lit(0),
            ).alias("logic"),
        )
        .join(goals.select("run_id", "primary", "hard"), "run_id", "left")
        .groupBy("run_id", "turn")
        .agg(
            F.sum("files").alias("files"),
            F.sum("loc").alias("loc"),
            F.sum("logic").alias("logic"),
            F.coalesce(
                F.sum(F.when(F.col("language") == F.col("primary"), F.col("loc"))), F.lit(0)
            ).alias("primary_loc"),
        )
    )
    entry = F.struct("files", "loc", "logic", "primary_loc")
    per_run = by_turn.groupBy("run_id").agg(
        F.max("turn").cast("bigint").alias("last_turn"),
        F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("bigint").alias("turn"), entry))).alias("turns"),
    )
    ran = F.col("ran") if "turns" in goals.columns else F.lit(None).cast("bigint")
    wanted = goals.select(
        "run_id", "primary", "hard", *([F.col("turns").cast("bigint").alias("ran")] if "turns" in goals.columns else [])
    )
    last = F.coalesce(F.greatest(ran - 1, F.col("last_turn")), F.lit(params.max_turns - 1).cast("bigint"))
    return wanted.join(per_run, "run_id", "full").select(
        "run_id", last.alias("last_turn"), "primary", F.coalesce("hard", F.lit(False)).alias("hard"),
        F.coalesce("turns", F.create_map().cast(per_run.schema["turns"].dataType)).alias("turns"),
    )


def progress_flags(
    saves: DataFrame, goals: DataFrame, params: BudgetParams = BudgetParams()
) -> DataFrame:
    """Flag of every turn that gets one: run_id, turn, flag.

    ``saves``: run_id, turn (0-based), saved, loc, layer, language; ``goals``:
    run_id, primary, hard and, if known, turns (how many the run took).  The
    state is that before the turn's own saves.  A run is followed up to its
    number of turns, else to its last save, else (no save at all) through
    ``max_turns`` turns, so that idle tails and runs without saves are flagged.
    """
    p, n_turns = params, params.max_turns
    hard = F.col("hard")
    has_primary = F.coalesce("primary", F.lit("")) != ""
    big = F.lit(0).cast("bigint")
    flags_type = "array<struct<turn:bigint,flag:string>>"
    start = F.struct(
        big.alias("files"), big.alias("loc"), big.alias("logic"), big.alias("primary_loc"),
        F.lit(-1).cast("bigint").alias("last_save"),
        F.lit(-10).cast("bigint").alias("last_language"),
        F.lit(-10).cast("bigint").alias("last_logic"),
        F.lit(False).alias("ended"),
        F.array().cast(flags_type).alias("flags"),
    )

    def step(state: Column, turn: Column) -> Column:
        loc, primary_loc = state["loc"], state["primary_loc"]
        idle = turn - (state["last_save"] + 1)
        short_of_primary = has_primary & (primary_loc < F.lit(p.primary_share_min) * loc)
        need = loc_needed(loc, primary_loc, p.primary_share_min)
        out_of_reach = need > F.lit(p.cap_loc) - loc
        half, over = p.target_loc // 2, p.target_loc + p.tolerance_loc
        language_due = (
            short_of_primary
            & (loc >= half)
            & (hard | (loc < over))
            & (turn - state["last_language"] >= LANGUAGE_EVERY)
        )
        case = (
            F.when((state["files"] == 0) & (turn >= FIRST_SAVE_BY), "URGENT")
            .when(language_due & out_of_reach, F.when(hard, "ABORT").otherwise("SILENCED"))
            .when(language_due, "LANGUAGE")
            .when((loc >= over) & ~(hard & short_of_primary), "STOP")
            .when((state["files"] > 0) & (idle >= IDLE_TURNS) & (loc < p.target_loc), "STALLED")
            .when((turn >= n_turns - LAST_TURNS) & (loc < p.target_loc - p.tolerance_loc), "LAST_ITERS")
            .when(
                (loc >= half)
                & (loc < over)
                & (state["logic"] < F.lit(p.logic_share_min) * loc)
                & (turn - state["last_logic"] >= LOGIC_EVERY),
                "LOGIC_LOW",
            )
            .otherwise("")
        )
        added = F.try_element_at("turns", turn)
        ended = case == "ABORT"
        saved_files = F.coalesce(added["files"], big)
        after = F.struct(
            (state["files"] + saved_files).alias("files"),
            (loc + F.coalesce(added["loc"], big)).alias("loc"),
            (state["logic"] + F.coalesce(added["logic"], big)).alias("logic"),
            (primary_loc + F.coalesce(added["primary_loc"], big)).alias("primary_loc"),
            F.when(saved_files > 0, turn).otherwise(state["last_save"]).alias("last_save"),
            F.when(case == "LANGUAGE", turn)
            .when(case == "SILENCED", F.lit(n_turns).cast("bigint"))
            .otherwise(state["last_language"]).alias("last_language"),
            F.when(case == "LOGIC_LOW", turn).otherwise(state["last_logic"]).alias("last_logic"),
            ended.alias("ended"),
            F.when(case.isin("", "SILENCED"), state["flags"])
            .otherwise(
                F.array_append(state["flags"], F.struct(turn.alias("turn"), case.alias("flag")))
            ).alias("flags"),
        )
        return F.when(state["ended"], state).otherwise(after)

    folded = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), F.col("last_turn")), start, step, lambda s: s["flags"]
    )
    return (
        _turn_sums(saves, goals, params)
        .select("run_id", F.explode(folded).alias("f"))
        .select("run_id", "f.turn", "f.flag")
    )


def run_statistics(events: DataFrame) -> DataFrame:
    """Turns, tool calls and saved lines per run; the last prose of runs that
    saved nothing.

    ``events``: run_id, turn, tool, saved, loc, prose.  The counts are one hash
    aggregate; prose is looked up where its turn is the run's last one with any.
    """
    counts = events.groupBy("run_id").agg(
        F.countDistinct("turn").alias("turns"),
        F.count_if(F.col("tool") == "save_sample").alias("save_attempts"),
        F.count_if(F.col("tool") == "bash").alias("shell_calls"),
        F.count_if("saved").alias("files_saved"),
        F.coalesce(F.sum(F.when(F.col("saved"), F.col("loc"))), F.lit(0)).cast("bigint").alias("total_loc"),
    )
    told = events.where(F.col("prose").isNotNull()).select("run_id", "turn", "prose")
    last = leading_rows(told, ["run_id"], F.col("turn"), [F.col("prose").desc()], salt_on=["prose"]).select(
        F.col("run_id").alias("_run"), F.substring("prose", 1, 300).alias("_prose")
    )
    return counts.join(last, F.col("run_id").eqNullSafe(F.col("_run")), "left").withColumn(
        "last_prose", F.when(F.col("total_loc") == 0, F.col("_prose"))
    ).drop("_run", "_prose")


def run_totals(results: DataFrame, errors: DataFrame, first: int = 3) -> DataFrame:
    """One row: processed, failed and collected lines, and the first messages."""
    sums = results.agg(
        F.count_if(F.col("total_loc") > 0).alias("processed"),
        F.count("*").alias("repositories"),
        F.coalesce(F.sum("total_loc"), F.lit(0)).cast("bigint").alias("total_loc"),
    )
    shown = errors.orderBy("ts", "repo_url").limit(first)
    messages = shown.agg(
        F.array_sort(
            F.collect_list(
                F.struct("ts", "repo_url", F.substring(collapse_space(F.col("error")), 1, 200).alias("error"))
            )
        ).alias("shown")
    )
    counted = errors.agg(F.count("*").alias("errors"))
    # Three one-row tables laid over each other.
    rows = sums.unionByName(counted, allowMissingColumns=True).unionByName(
        messages, allowMissingColumns=True
    )
    return rows.agg(
        *[F.max(name).alias(name) for name in ("processed", "repositories", "errors", "total_loc")],
        F.array_join(F.max("shown.error"), " | ").alias("first_errors"),
    )


def redaction_totals(runs: DataFrame) -> DataFrame:
    """Folders redacted, failed, and their cost.  ``runs``: folder, status, cost."""
    return runs.agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") != "ok").alias("errors"),
        F.count("*").alias("folders"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("cost"))), F.lit(0.0)).alias("total_cost"),
    )
