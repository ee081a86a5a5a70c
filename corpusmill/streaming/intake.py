"""New repositories from a stream of list files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.operators.repos import processed_repositories


def new_repositories(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """URLs of a line stream that are new: not seen before in the stream and
    not processed according to the (static) manifest.

    The state is one key per repository, which exact deduplication needs.
    """
    urls = (
        lines.where(~F.col("value").startswith("#"))
        .select(strip(F.col("value")).alias("repo_url"))
        .where(F.col("repo_url") != "")
        .dropDuplicates(["repo_url"])
    )
    return urls.join(processed_repositories(manifest), "repo_url", "left_anti")


def list_file_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
