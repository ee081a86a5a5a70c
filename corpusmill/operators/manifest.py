"""Sample manifest: rollup, validation, upsert, flat form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import urls
from corpusmill.functions.languages import is_code_language
from corpusmill.functions.shares import floor_percent, rounded, share
from corpusmill.functions.text import collapse_space, strip
from corpusmill.operators.skew import leading_rows
from corpusmill.params import BudgetParams, RunMeta
from corpusmill.schemas import LOGIC_LAYERS, LOW_VALUE_LAYERS

MAIN_LANGUAGE_MARK = "**Main language:**"


def _loc_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("loc_taken"))), F.lit(0)).cast("bigint")


def _total_by(files: Column, key: str) -> Column:
    """Array of ``struct(loc, key)`` over a bounded file array."""
    names = F.array_distinct(F.transform(files, lambda f: f[key]))
    return F.transform(
        names,
        lambda name: F.struct(
            F.aggregate(
                F.filter(files, lambda f: f[key] == name),
                F.lit(0).cast("bigint"),
                lambda total, f: total + f["loc_taken"],
            ).alias("loc"),
            name.alias("name"),
        ),
    )


def sample_rollup(saved: DataFrame, primaries: DataFrame | None = None) -> DataFrame:
    """One row per sampled repository.

    ``saved`` comes from ``selection.saved_files``: its rows per repository are
    bounded by the line cap, so collecting them is safe.  Unknown languages are
    grouped under ``Unknown``; the main language is the code language with most
    lines, the last name on ties.
    """
    if primaries is None:
        rows = saved.withColumn("primary", F.lit(None).cast("string"))
    else:
        rows = saved.join(primaries.select("repo_url", "primary"), "repo_url", "left")
    file = F.struct("rank", "path", "layer", "loc_taken", "is_partial", "language")
    grouped = rows.groupBy("repo_url").agg(
        F.sum("loc_taken").alias("total_loc"),
        F.count("*").alias("file_count"),
        _loc_where(F.col("layer") == "test").alias("test_loc"),
        _loc_where(F.col("layer").isin(*LOGIC_LAYERS)).alias("logic_loc"),
        _loc_where(F.col("layer").isin(*LOW_VALUE_LAYERS)).alias("low_value_loc"),
        _loc_where(F.col("language") == F.col("primary")).alias("primary_loc"),
        F.max("primary").alias("primary"),
        F.array_sort(F.collect_list(file)).alias("files"),
    )
    by_language = grouped.withColumn("by_language", _total_by(F.col("files"), "language"))
    code = F.filter("by_language", lambda e: is_code_language(e["name"]))
    return by_language.withColumn(
        "sample_lang_loc",
        F.map_from_entries(
            F.transform(
                "by_language",
                lambda e: F.struct(F.when(e["name"] == "", "Unknown").otherwise(e["name"]), e["loc"]),
            )
        ),
    ).withColumn(
        "main_language", F.coalesce(F.array_max(code)["name"], F.lit(""))
    ).drop("by_language")


def sample_shares(rollup: DataFrame) -> DataFrame:
    """Rounded and exact shares of a rollup."""
    total = F.col("total_loc")
    out = rollup
    for name in ("test", "logic", "low_value", "primary"):
        exact = share(F.col(f"{name}_loc"), total)
        out = out.withColumn(f"{name}_share_exact", exact).withColumn(
            f"{name}_share", rounded(exact)
        )
    return out.withColumn(
        "sample_lang_distribution",
        F.transform_values("sample_lang_loc", lambda _, n: rounded(share(n, total))),
    )


def layer_breakdown(files: Column) -> Column:
    """``layer: 40%`` list, largest first; percent rounded half to even."""
    layers = _total_by(files, "layer")
    total = F.aggregate(layers, F.lit(0).cast("bigint"), lambda t, e: t + e["loc"])
    ordered = F.array_sort(
        F.transform(layers, lambda e: F.struct((-e["loc"]).alias("neg"), e["name"].alias("layer")))
    )
    return F.array_join(
        F.transform(
            ordered,
            lambda e: F.concat(
                e["layer"],
                F.lit(": "),
                F.bround(share(-e["neg"], total) * 100).cast("bigint").cast("string"),
                F.lit("%"),
            ),
        ),
        ", ",
    )


# Text of the summary where nobody wrote one.
_SUMMARY_HEAD = (
    "# Sample of a repository\n\n"
    "Nobody described this repository; the figures below come from the sample itself.\n\n"
)


def fallback_summary(rollup: DataFrame) -> DataFrame:
    """Summary text from the rollup alone."""
    listing = F.array_join(
        F.transform(
            "files",
            lambda f: F.concat(
                F.lit("- `"), f["path"], F.lit("` ("), f["layer"], F.lit(", "),
                f["loc_taken"].cast("string"), F.lit(" lines)"),
            ),
        ),
        "\n",
    )
    text = F.concat(
        F.lit(_SUMMARY_HEAD + "Sampled: "),
        F.col("file_count").cast("string"), F.lit(" files with "),
        F.col("total_loc").cast("string"), F.lit(" code lines.\nBy layer: "),
        layer_breakdown(F.col("files")), F.lit("\n\n"), listing, F.lit("\n"),
    )
    return rollup.withColumn("summary", text)


def with_summary(rollup: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Adds ``repo_summary``: the supplied text, else the fallback, with the
    main-language line in front exactly once."""
    out = fallback_summary(rollup)
    if summaries is not None:
        out = out.join(
            summaries.select("repo_url", F.col("summary").alias("supplied")), "repo_url", "left"
        )
        out = out.withColumn(
            "summary", F.when(F.col("supplied") != "", F.col("supplied")).otherwise(F.col("summary"))
        ).drop("supplied")
    marked = strip(F.col("summary")).startswith(MAIN_LANGUAGE_MARK)
    return out.withColumn(
        "repo_summary",
        F.when((F.col("main_language") == "") | marked, F.col("summary")).otherwise(
            F.concat(
                F.lit(MAIN_LANGUAGE_MARK + " "), F.col("main_language"), F.lit("\n\n"),
                F.col("summary"),
            )
        ),
    ).drop("summary")


def manifest_records(
    rollup: DataFrame,
    profile: DataFrame,
    heads: DataFrame | None = None,
    run_stats: DataFrame | None = None,
    meta: RunMeta = RunMeta(),
    forced: Column | None = None,
) -> DataFrame:
    """Manifest record of every sampled repository, in ``schemas.MANIFEST``.

    ``rollup`` needs ``repo_summary`` (``with_summary``); ``profile`` comes from
    ``profile.language_shares``; ``heads``: repo_url, head_commit_sha;
    ``run_stats``: repo_url, turns, shell_calls.
    """
    rows = sample_shares(rollup).join(
        profile.select("repo_url", "shares", "source"), "repo_url", "left"
    )
    if heads is None:
        rows = rows.withColumn("head_commit_sha", F.lit(None).cast("string"))
    else:
        rows = rows.join(heads.select("repo_url", "head_commit_sha"), "repo_url", "left")
    if run_stats is None:
        rows = rows.withColumn("turns", F.lit(0)).withColumn("shell_calls", F.lit(0))
    else:
        rows = rows.join(run_stats.select("repo_url", "turns", "shell_calls"), "repo_url", "left")
    url = F.col("repo_url")
    return rows.select(
        "repo_url",
        urls.display_name(url).alias("repo_name"),
        urls.folder_name(url).alias("folder_name"),
        F.coalesce("primary", F.lit("")).alias("language"),
        "total_loc",
        "file_count",
        "test_share",
        "sample_lang_distribution",
        "files",
        "repo_summary",
        F.struct(
            F.lit(meta.model).alias("model"),
            F.coalesce("turns", F.lit(0)).cast("bigint").alias("agent_iterations"),
            F.coalesce("shell_calls", F.lit(0)).cast("bigint").alias("bash_calls"),
            F.lit(meta.sampled_at).alias("sampled_at"),
            F.coalesce(F.substring("head_commit_sha", 1, 7), F.lit("unknown")).alias("commit_sha"),
            F.coalesce("shares", F.create_map().cast("map<string,double>")).alias(
                "repo_lang_distribution"
            ),
            F.coalesce("source", F.lit("empty")).alias("lang_stats_source"),
            (forced if forced is not None else F.lit(False)).alias("primary_forced"),
        ).alias("meta"),
    )


def validate_results(results: DataFrame, params: BudgetParams = BudgetParams()) -> DataFrame:
    """Adds ``stage`` and ``error``, null for results that pass.

    ``results``: total_loc, primary (language), primary_loc, primary_forced.  A
    low share of the primary language only fails when the language was forced.
    """
    total, part = F.col("total_loc"), F.col("primary_loc")
    low = (
        F.coalesce(F.col("primary_forced"), F.lit(False))
        & (F.coalesce("primary", F.lit("")) != "")
        & (share(part, total) < params.primary_share_min)
    )
    empty = total == 0
    return results.withColumn(
        "stage", F.when(empty, "agent_empty").when(low, "agent_no_primary_lang")
    ).withColumn(
        "error",
        F.when(empty, "agent saved 0 LOC").when(
            low,
            F.concat(
                F.lit("primary language '"), F.col("primary"), F.lit("': "),
                part.cast("string"), F.lit(" LOC ("),
                floor_percent(part, total).cast("string"),
                F.lit(f"%) below the {params.primary_share_min:.0%} minimum"),
            ),
        ),
    )


def upserted(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Manifest after adding ``fresh``: it replaces records of the same URL."""
    kept = current.join(fresh.select("repo_url"), "repo_url", "left_anti")
    return kept.unionByName(fresh)


def latest_versions(versions: DataFrame, order: list[str], key: str = "repo_url") -> DataFrame:
    """Newest record per key of an append-only manifest.

    The first column of ``order`` decides by a hash aggregate, the others, and then the rest of the record, only among
    records that are equal in it.
    """
    rest = [name for name in versions.columns if name not in (key, *order)]
    sortable = [n for n in rest if "map<" not in versions.schema[n].dataType.simpleString()]
    newest = leading_rows(
        versions, [key], F.col(order[0]), [F.col(name).desc_nulls_last() for name in (*order[1:], *sortable)]
    )
    return newest.select(key, *order, *rest)


def without_repositories(manifest: DataFrame, removed: DataFrame) -> DataFrame:
    """Manifest without the records of the given URLs."""
    return manifest.join(removed.select("repo_url").distinct(), "repo_url", "left_anti")


def flat_manifest(manifest: DataFrame) -> DataFrame:
    """Ten plain columns; nested ones as JSON text; missing values defaulted."""
    def text(name: str) -> Column:
        return F.coalesce(name, F.lit("")).alias(name)

    def json(name: str, alias: str, empty: str) -> Column:
        return F.coalesce(F.to_json(name), F.lit(empty)).alias(alias)

    return manifest.select(
        text("repo_url"),
        text("repo_name"),
        text("language"),
        F.coalesce("total_loc", F.lit(0)).cast("bigint").alias("total_loc"),
        F.coalesce("file_count", F.lit(0)).cast("bigint").alias("file_count"),
        F.coalesce("test_share", F.lit(0.0)).alias("test_share"),
        text("repo_summary"),
        json("files", "files_json", "[]"),
        json("meta", "meta_json", "{}"),
        json("sample_lang_distribution", "lang_distribution_json", "{}"),
    )


def display_rows(manifest: DataFrame) -> DataFrame:
    """Saved files of each repository, ordered by rank."""
    return (
        manifest.select("repo_url", F.explode("files").alias("f"))
        .select(
            "repo_url",
            "f.rank",
            "f.path",
            "f.layer",
            F.when(F.col("f.language") == "", "-").otherwise(F.col("f.language")).alias("language"),
            F.col("f.loc_taken").alias("loc"),
            F.when(F.col("f.is_partial"), "yes").otherwise("no").alias("partial"),
        )
        .orderBy("repo_url", "rank")
    )


def error_rows(validated: DataFrame, at: Column) -> DataFrame:
    """Rows for the error log from results that failed validation."""
    return validated.where(F.col("stage").isNotNull()).select(
        "repo_url", "stage", collapse_space(F.col("error")).alias("error"), at.alias("ts")
    )
