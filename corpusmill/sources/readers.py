"""Reading repository lists, working trees, manifests and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.params import ScanParams
from corpusmill.schemas import IDENTITY, MANIFEST
from corpusmill.sources.trees import working_trees

_BROKEN = "_broken"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number per file, from 1.

    A file may be read in many splits at once: each split's lines are counted,
    the counts of the splits before it are added up, and the running row id
    numbers the lines inside a split.  No file passes through one task.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    splits = lines.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_id")
    )
    # One small row per split of the file.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "file", "block", "first_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    return lines.join(offsets, ["file", "block"]).select(
        "file", (F.col("offset") + F.col("row_id") - F.col("first_id") + 1).alias("line_no"), "value"
    )


def read_working_trees(spark: SparkSession, root: str, params: ScanParams | None = None) -> DataFrame:
    """Files below ``root/<folder>/``: folder, path (relative, as on disk), content, size.

    Everything comes: hidden names, empty files, excluded folders, large files.
    With ``params`` only files that a profile would look at come: excluded
    folders are not entered, and files of other sizes are not opened.
    """
    if params is None:
        return working_trees(spark, root)
    return working_trees(spark, root, tuple(params.excluded_dirs), min_bytes=1, max_bytes=params.max_file_bytes)


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (records, broken lines); broken ones never stop the job.

    Truncated lines and values that are no objects count as broken; blank lines
    do not count at all.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    parsed = lines.select(
        "value",
        strip(F.col("value")).startswith("{").alias("is_object"),
        F.from_json("value", f"{schema}, {_BROKEN} string", options).alias("record"),
    )
    usable = F.col("is_object") & F.col(f"record.{_BROKEN}").isNull()
    return (
        parsed.where(usable).select("record.*").drop(_BROKEN),
        parsed.where(~usable).select(F.col("value").alias("line")),
    )


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_records(spark, path, MANIFEST)


def read_identity(spark: SparkSession, path: str) -> DataFrame:
    """Identity records; a broken one is an error, as its repository would be packed without fingerprints."""
    records, broken = read_records(spark, path, IDENTITY)
    first = broken.limit(1).collect()
    if first:
        raise ValueError(f"invalid repository identity in {path}: {first[0]['line'][:200]}")
    return records


def manifest_line_problems(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not JSON, with their number (strict reading).

    JSON values that are no objects are no problem; they are skipped.
    """
    return (
        numbered_lines(spark, path)
        .where(F.trim("value") != "")
        .where(F.try_parse_json("value").isNull())
        .select("file", "line_no")
    )


def require_clean_manifest(spark: SparkSession, path: str) -> None:
    """Raise with the first bad line number; one row reaches the driver."""
    first = manifest_line_problems(spark, path).agg(F.min(F.struct("line_no", "file")).alias("p")).first()
    if first is not None and first["p"] is not None:
        raise ValueError(f"invalid JSON on line {first['p']['line_no']} of {first['p']['file']}")


def sample_folders(summaries: DataFrame, skip: tuple[str, ...] = ("archive",)) -> DataFrame:
    """Folders that look like deliverables: they have a summary."""
    return summaries.select("folder").where(~F.col("folder").isin(*skip)).distinct()
