"""Delivery index, its checks, and the split of deliverable and private rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.schemas import INDEX_COLUMNS

SUMMARY_NAME = "repo_summary.md"
DELIVERABLE_ROOTS = ("samples", SUMMARY_NAME)


def folder_is_valid(folder: Column) -> Column:
    """Not empty, not ``.`` or ``..``, no path separator."""
    return (folder != "") & ~folder.isin(".", "..") & ~folder.contains("/")


def _folder_of(manifest: DataFrame) -> Column:
    """``folder_name``, or ``folder`` where that is all a record has."""
    names = [F.nullif(strip(F.col(c)), F.lit("")) for c in ("folder_name", "folder") if c in manifest.columns]
    return F.coalesce(*names, F.lit(""))


def index_problems(
    manifest: DataFrame, samples: DataFrame | None = None, summaries: DataFrame | None = None
) -> DataFrame:
    """Everything that forbids packing: folder and problem, empty when fine."""
    folders = manifest.select(_folder_of(manifest).alias("folder"))
    problems = folders.where(~folder_is_valid(F.col("folder"))).select(
        "folder", F.lit("invalid_folder").alias("problem")
    )
    counted = folders.groupBy("folder").agg(F.count("*").alias("n"))
    problems = problems.unionByName(
        counted.where(F.col("n") > 1).select("folder", F.lit("duplicate_folder").alias("problem"))
    )
    distinct = counted.select("folder")
    for present, problem in ((samples, "no_samples"), (summaries, "no_summary")):
        if present is not None:
            problems = problems.unionByName(
                distinct.join(present.select("folder"), "folder", "left_anti").select(
                    "folder", F.lit(problem).alias("problem")
                )
            )
    return problems


def sample_index(manifest: DataFrame, identity: DataFrame, tool_version: str) -> DataFrame:
    """Twelve-column index: manifest joined with identity on the folder.

    ``identity`` carries ``folder`` and the seven identity columns; a folder
    without identity gets blanks.
    """
    known = identity.select(
        "folder",
        *[
            name
            for name in INDEX_COLUMNS
            if name not in ("folder", "sample_loc", "sample_files", "sampled_at", "sampler_version")
        ],
    )
    rows = manifest.select(
        _folder_of(manifest).alias("folder"),
        F.col("total_loc").alias("sample_loc"),
        F.col("file_count").alias("sample_files"),
        F.coalesce("meta.sampled_at", F.lit("")).alias("sampled_at"),
        F.lit(tool_version).alias("sampler_version"),
    )
    joined = rows.join(known, "folder", "left")
    return joined.select(
        *[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in INDEX_COLUMNS]
    )


def missing_identity(manifest: DataFrame, identity: DataFrame) -> DataFrame:
    """Folders that are packed with blank identity (warning, not error)."""
    return (
        manifest.select(F.col("folder_name").alias("folder"))
        .join(identity.select("folder"), "folder", "left_anti")
        .distinct()
    )


def split_deliverables(artefacts: DataFrame) -> DataFrame:
    """Marks artefact rows (folder, path) that may ship."""
    root = F.substring_index("path", "/", 1)
    return artefacts.withColumn("ships", root.isin(*DELIVERABLE_ROOTS))


def bundle_entries(artefacts: DataFrame) -> DataFrame:
    """Members of the delivery bundle: ``section`` 0 is the summary, 1 the sample files.

    Sorting by (folder, section, entry_path) gives the order of the bundle; the table itself is not sorted.
    """
    shipped = split_deliverables(artefacts).where("ships")
    if "is_symlink" in artefacts.columns:
        shipped = shipped.where(~F.col("is_symlink"))
    return shipped.select(
        "folder",
        F.when(F.col("path") == SUMMARY_NAME, 0).otherwise(1).cast("int").alias("section"),
        F.concat(F.lit("samples/"), F.col("folder"), F.lit("/"), F.col("path")).alias("entry_path"),
        "size",
    )
