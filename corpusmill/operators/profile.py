"""Language profile of every repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import languages as lang
from corpusmill.functions.languages import MIN_FOCUS_SHARE
from corpusmill.functions.paths import below_any
from corpusmill.functions.shares import percent_text, rounded, share
from corpusmill.functions.text import (
    decode_text,
    is_binary,
    line_count,
    physical_lines,
    text_lines,
)
from corpusmill.params import ScanParams


def scannable_files(files: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """Files of a known language outside excluded directories, of sane size.

    Only path and size are looked at, so a Parquet scan can skip row groups by
    ``size`` and no content is decoded for a dropped file.
    """
    return (
        files.where((F.col("size") > 0) & (F.col("size") <= params.max_file_bytes))
        .where(~below_any(F.col("path"), params.excluded_dirs))
        .withColumn("language", lang.language_of(F.col("path")))
        .where(F.col("language") != "")
    )


def file_lines(files: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """Physical lines of every scannable text file."""
    return (
        scannable_files(files, params)
        .where(~is_binary(F.col("content"), params.sniff_bytes))
        .select("repo_url", "path", "language", physical_lines(F.col("content")).alias("lines"))
    )


def file_loc(files: DataFrame) -> DataFrame:
    """All lines and code lines of every file, whatever its language."""
    return files.select(
        "repo_url",
        "path",
        lang.language_of(F.col("path")).alias("language"),
        text_lines(decode_text(F.col("content"))).alias("lines"),
    ).select(
        "repo_url",
        "path",
        "language",
        line_count(F.col("lines")).alias("total_lines"),
        lang.count_code_lines(F.col("lines"), F.col("language")).alias("loc"),
    )


def line_masks(files: DataFrame) -> DataFrame:
    """Per file one character per line, "1" for code.

    A mask is some 30 times smaller than the content.  Write it once
    (``materialized``); choosing files and line ranges then needs no content.
    """
    return files.select(
        "repo_url",
        "path",
        "size",
        lang.language_of(F.col("path")).alias("language"),
        text_lines(decode_text(F.col("content"))).alias("lines"),
    ).select(
        "repo_url",
        "path",
        "size",
        "language",
        lang.code_line_mask(F.col("lines"), F.col("language")).alias("mask"),
    )


def language_counts(files: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """Lines per repository and language; summed before the shuffle."""
    return (
        file_lines(files, params)
        .groupBy("repo_url", "language")
        .agg(F.sum("lines").alias("lines"))
        .where(F.col("lines") > 0)
    )


def ranked_counts(counts: Column) -> Column:
    """Map entries as ``struct(neg, language)``, largest first, ties by name."""
    return F.array_sort(
        F.transform(
            F.map_entries(counts),
            lambda entry: F.struct((-entry["value"]).alias("neg"), entry["key"].alias("language")),
        )
    )


def language_profile(counts: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """One row per repository from ``language_counts``: line map, total, the
    plurality language and the language sampling should focus on.

    A repository has at most one row per dictionary language here, so the
    per-repository collection is bounded.  With ``repos`` every repository gets
    a row, also when nothing could be counted.
    """
    entry = F.struct("language", "lines")
    grouped = counts.groupBy("repo_url").agg(
        F.map_from_entries(F.collect_list(entry)).alias("counts"),
        F.sum("lines").alias("total"),
    )
    if repos is not None:
        grouped = repos.select("repo_url").distinct().join(grouped, "repo_url", "left")
    empty = F.create_map().cast("map<string,bigint>")
    ranked = ranked_counts(F.col("counts"))
    focus = F.filter(
        ranked,
        lambda e: lang.is_trackable(e["language"])
        & lang.is_code_language(e["language"])
        & (-e["neg"] / F.col("total") >= MIN_FOCUS_SHARE),
    )
    return grouped.select(
        "repo_url",
        F.coalesce("counts", empty).alias("counts"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        F.try_element_at(ranked, F.lit(1))["language"].alias("primary"),
        F.try_element_at(focus, F.lit(1))["language"].alias("code_primary"),
        F.when(F.col("total").isNull(), "empty").otherwise("walk").alias("source"),
    )


def language_shares(profile: DataFrame) -> DataFrame:
    """Profile plus the map of rounded language shares."""
    return profile.withColumn(
        "shares",
        F.transform_values("counts", lambda _, n: rounded(share(n, F.col("total")))),
    )


def distribution_text(profile: DataFrame, top: int = 8) -> DataFrame:
    """Readable share list: the ``top`` languages, further ones from 1 %."""
    def keep(entry: Column, index: Column) -> Column:
        return (index < top) | (share(-entry["neg"], F.col("total")) >= 0.01)

    lines = F.transform(
        F.filter(ranked_counts(F.col("counts")), keep),
        lambda e: F.concat(
            F.lit("- "), e["language"], F.lit(": "), percent_text(share(-e["neg"], F.col("total")))
        ),
    )
    return profile.select(
        "repo_url",
        F.when(F.size("counts") == 0, "(language distribution unavailable)")
        .otherwise(F.array_join(lines, "\n"))
        .alias("distribution"),
    )
