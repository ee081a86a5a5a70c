"""Repository list, names, branch choice, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import urls
from corpusmill.functions.paths import extension
from corpusmill.functions.text import strip
from corpusmill.operators.skew import first_rows, leading_rows


def repository_list(lines: DataFrame) -> DataFrame:
    """URLs of a list file: blank lines and ``#`` lines dropped, the first
    occurrence of a URL kept.

    ``lines`` has ``value`` and an order column ``line_no``.  Only a ``#`` in
    the very first column is a comment.
    """
    return (
        lines.select(strip(F.col("value")).alias("repo_url"), "value", "line_no")
        .where((F.col("repo_url") != "") & ~F.col("value").startswith("#"))
        .groupBy("repo_url")
        .agg(F.min("line_no").alias("line_no"))
    )


def repository_names(repos: DataFrame, ssh_port: int | None = None) -> DataFrame:
    """Folder, namespace and names derived from the URL, and its rewritten forms."""
    url = F.col("repo_url")
    return repos.select(
        "repo_url",
        urls.folder_name(url).alias("folder_name"),
        urls.namespace(url).alias("repo_org"),
        urls.leaf_name(url).alias("repo_name"),
        urls.display_name(url).alias("display_name"),
        urls.rewrite_scheme(url, "ssh", ssh_port).alias("ssh_url"),
        urls.rewrite_scheme(url, "https").alias("https_url"),
    )


def latest_branch(refs: DataFrame) -> DataFrame:
    """Branch with the newest tip; equal times go to the first refname.

    The newest time per repository is found first, by a hash aggregate; only
    refs of that time are compared by name.
    """
    micros = F.unix_micros(F.col("committer_ts").cast("timestamp"))
    branches = refs.where(~F.col("refname").endswith("/HEAD")).select("repo_url", "refname", "tip_sha", "committer_ts")
    return leading_rows(branches, ["repo_url"], micros, [F.col("refname"), F.col("tip_sha")], salt_on=["refname"])


def processed_repositories(manifest: DataFrame) -> DataFrame:
    """URLs that are done; records without lines are failed runs."""
    return manifest.where((F.col("repo_url") != "") & (F.col("total_loc") > 0)).select(
        "repo_url"
    ).distinct()


def pending_repositories(repos: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Repositories still to process."""
    if force:
        return repos
    return repos.join(processed_repositories(manifest), "repo_url", "left_anti")


def snapshot_diagnostics(
    files: DataFrame, repos: DataFrame, top_extensions: int = 8, sample_paths: int = 15
) -> DataFrame:
    """What a working tree holds: file count, bytes, leading extensions, first
    paths, and whether it is empty.  Files below ``.git`` do not count."""
    seen = files.where(
        ~F.array_contains(F.split("path", "/"), ".git")
    ).select("repo_url", "path", "size", extension(F.col("path")).alias("extension"))
    by_extension = seen.groupBy("repo_url", "extension").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes")
    )
    totals = by_extension.groupBy("repo_url").agg(
        F.sum("n").alias("file_count"), F.sum("bytes").alias("total_bytes")
    )
    leading = (
        first_rows(
            by_extension, ["repo_url"], [F.col("n").desc(), F.col("extension")], top_extensions
        )
        .groupBy("repo_url")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "extension", "n"))).alias("leading"))
    )
    paths = (
        first_rows(
            seen.select("repo_url", "path"), ["repo_url"], [F.col("path")], sample_paths,
            salt_on=["path"],
        )
        .groupBy("repo_url")
        .agg(F.array_sort(F.collect_list("path")).alias("paths"))
    )
    return (
        repos.select("repo_url").distinct()
        .join(totals, "repo_url", "left")
        .join(leading, "repo_url", "left")
        .join(paths, "repo_url", "left")
        .select(
            "repo_url",
            F.coalesce("file_count", F.lit(0)).cast("bigint").alias("file_count"),
            F.floor(F.coalesce("total_bytes", F.lit(0)) / 1024).alias("total_kb"),
            F.coalesce(
                F.array_join(
                    F.transform(
                        "leading",
                        lambda e: F.concat(e["extension"], F.lit(":"), e["n"].cast("string")),
                    ),
                    ", ",
                ),
                F.lit(""),
            ).alias("extensions"),
            F.coalesce("paths", F.array().cast("array<string>")).alias("sample_paths"),
            F.col("file_count").isNull().alias("is_empty"),
        )
    )


def tree_file_counts(files: DataFrame) -> DataFrame:
    """Files per repository, everything included (dry run)."""
    return files.groupBy("repo_url").agg(F.count("*").alias("file_count"))
