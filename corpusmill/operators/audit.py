"""Audit of redaction: what changed, per line, file and folder."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import alignment
from corpusmill.functions import batches as arrow
from corpusmill.functions.text import newline_lines
from corpusmill.operators.skew import ranked

# Changed lines with more than six unchanged lines between them are separate
# hunks: three lines of context on both sides no longer touch.
HUNK_GAP = 6
AUDIT_NAMES_LEFT_OUT = r"(?:^|/)(?:agent_log\.json|anonymization\.[^/]*|\.[^/]*)(?:/|$)"


def paired_texts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both versions of each file; an absent side is an empty file."""
    return (
        before.select("folder", "path", F.col("text").alias("before"))
        .join(after.select("folder", "path", F.col("text").alias("after")), ["folder", "path"], "full_outer")
        .select(
            "folder",
            "path",
            F.coalesce("before", F.lit("")).alias("before"),
            F.coalesce("after", F.lit("")).alias("after"),
        )
    )


def _line_arrays(pairs: DataFrame) -> DataFrame:
    """Changed pairs with the lines of both versions; an absent version (null) is an empty file."""
    return pairs.select(
        "folder", "path", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after")
    ).where(F.col("before") != F.col("after")).select(
        "folder", "path", newline_lines(F.col("before")).alias("old"), newline_lines(F.col("after")).alias("new")
    )


def file_changes(pairs: DataFrame) -> DataFrame:
    """Hunks, additions and deletions of every changed file.

    One alignment for all files: as many lines stay as can (``functions.alignment``).
    Everything happens inside the row: no line is exploded and nothing is
    shuffled.
    """
    counted = _line_arrays(pairs).mapInArrow(
        _change_counts(HUNK_GAP), "folder string, path string, hunks long, additions long, deletions long"
    )
    return counted.select("*", F.col("path").rlike(AUDIT_NAMES_LEFT_OUT).alias("hidden"))


def line_changes(pairs: DataFrame) -> DataFrame:
    """Every changed line: its number and text in either version.

    Lines that took each other's place are one row; an added line has no
    ``line_no`` and ``before``, a removed one no ``new_line_no`` and ``after``.
    """
    return _line_arrays(pairs).mapInArrow(
        _line_pairs(), "folder string, path string, line_no long, new_line_no long, before string, after string"
    )


def _change_counts(gap: int):
    for module in (alignment, arrow):
        cloudpickle.register_pickle_by_value(module)

    def run(batches):
        for batch in itertools.chain.from_iterable(map(arrow.pieces, batches)):
            counts = [
                alignment.change_counts(old, new, gap)
                for old, new in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            columns = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns]],
                ["folder", "path", "hunks", "additions", "deletions"],
            )

    return run


def _line_pairs():
    for module in (alignment, arrow):
        cloudpickle.register_pickle_by_value(module)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        for batch in itertools.chain.from_iterable(map(arrow.pieces, batches)):
            for row, (old, new) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                found = list(alignment.line_pairs(old, new))
                at = pa.array([row] * len(found), pa.int64())
                columns = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    ["folder", "path", "line_no", "new_line_no", "before", "after"],
                )

    return run


def folder_report(changes: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Totals per folder; with ``folders`` unchanged ones get zeros."""
    shown = changes.where(~F.col("hidden"))
    totals = shown.groupBy("folder").agg(
        F.count("*").alias("files_changed"),
        F.sum("hunks").alias("total_hunks"),
        F.sum("additions").alias("total_additions"),
        F.sum("deletions").alias("total_deletions"),
    )
    if folders is None:
        return totals
    counters = ("files_changed", "total_hunks", "total_additions", "total_deletions")
    return (
        folders.select("folder").distinct().join(totals, "folder", "left")
        .select("folder", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counters])
    )


def audit_records(
    changes: DataFrame, folders: DataFrame, model: str, at: str, costs: DataFrame | None = None, per_part: int = 1000
) -> DataFrame:
    """The audit record of every folder: when, by which model, at what cost, totals, and its ``changes``.

    ``costs``: folder, cost_usd.  A record lists at most ``per_part`` files; a folder with more has further
    records with ``part`` 1, 2, ... and the same totals, so no folder is gathered in one row.
    """
    shown = ranked(changes.where(~F.col("hidden")), ["folder"], ["path"], "_rank")
    listed = shown.groupBy("folder", F.expr(f"cast((_rank - 1) div {int(per_part)} as int)").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("path", "hunks", "additions", "deletions"))).alias("changes")
    )
    totals = folder_report(changes, folders)
    none = F.array().cast("array<struct<path:string,hunks:bigint,additions:bigint,deletions:bigint>>")
    rows = totals.join(listed, "folder", "left")
    if costs is None:
        rows = rows.withColumn("cost_usd", F.lit(None).cast("double"))
    else:
        rows = rows.join(costs.groupBy("folder").agg(F.sum("cost_usd").alias("cost_usd")), "folder", "left")
    return rows.select(
        "folder", F.lit(at).alias("anonymized_at"), F.lit(model).alias("model"), "cost_usd", "files_changed",
        "total_additions", "total_deletions", F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("changes", none).alias("changes"),
    )


def pending_folders(summaries: DataFrame, reports: DataFrame, legacy_reports: DataFrame | None = None,
                    skip: tuple[str, ...] = ("archive",), force: bool = False) -> DataFrame:
    """Folders with a summary that were not redacted yet; a report counts at
    either of its two places."""
    folders = summaries.select("folder").where(~F.col("folder").isin(*skip)).distinct()
    if force:
        return folders
    done = reports.select("folder")
    if legacy_reports is not None:
        done = done.unionByName(legacy_reports.select("folder"))
    return folders.join(done, "folder", "left_anti")
