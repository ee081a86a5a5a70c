"""Repository identity from commit histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import minhash
from corpusmill.functions.urls import leaf_name, namespace
from corpusmill.operators.skew import first_rows, leading_rows

EARLY_COMMITS = 10


def commit_minhash(commits: DataFrame) -> DataFrame:
    """Fingerprint per repository: 32 independent minima over all commits; ""
    when no commit id is long enough.

    All minima are hash-aggregated before the shuffle; one row per repository
    and map task crosses the network.
    """
    sha = F.when(F.length("sha") >= minhash.MIN_SHA_LENGTH, F.col("sha"))
    halves = ("high", "low")
    minima = [
        F.min(minhash.permuted_key(*halves, i)).alias(f"m{i}") for i in range(minhash.PERMUTATIONS)
    ]
    # concat_ws skips nulls: without commits every part is null and "" remains.
    signature = F.concat_ws(
        ",", *[minhash.key_text(F.col(f"m{i}")) for i in range(minhash.PERMUTATIONS)]
    )
    return (
        commits.select(
            "repo_url", *[c.alias(name) for c, name in zip(minhash.sha_halves(sha), halves)]
        )
        .groupBy("repo_url")
        .agg(*minima)
        .select("repo_url", signature.alias("commit_minhash"))
    )


def history_ends(commits: DataFrame) -> DataFrame:
    """Tip and root commits of the checked-out history.

    The root list is the result itself: histories have one root, rarely a few.
    """
    walked = commits.where("on_head")
    tip = leading_rows(
        walked.select("repo_url", "pos", "sha"), ["repo_url"], -F.col("pos"), [F.col("sha")], salt_on=["sha"], sized=True
    ).select("repo_url", F.col("sha").alias("head_commit_sha"))
    roots = (
        walked.where(F.size("parents") == 0).groupBy(F.col("repo_url").alias("_repo"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "sha"))).alias("roots"))
    )
    none = F.array().cast("array<string>")
    return tip.join(roots, F.col("repo_url") == F.col("_repo"), "left").select(
        "repo_url", "head_commit_sha", F.coalesce("roots.sha", none).alias("root_commits")
    )


def early_commits(commits: DataFrame, count: int = EARLY_COMMITS) -> DataFrame:
    """The first commits of the checked-out history, oldest first."""
    oldest = first_rows(
        commits.where("on_head").select("repo_url", "sha", "pos"),
        ["repo_url"],
        [F.col("pos").desc()],
        count,
        salt_on=["sha"],
    )
    return (
        oldest.groupBy("repo_url")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "sha"))).alias("early"))
        .select("repo_url", F.col("early.sha").alias("early_commits"))
    )


def repository_identity(commits: DataFrame) -> DataFrame:
    """Identity record of every repository that has commits: seven text columns."""
    none = F.array().cast("array<string>")
    return (
        commit_minhash(commits)
        .join(history_ends(commits), "repo_url", "left")
        .join(early_commits(commits), "repo_url", "left")
        .select(
            F.array_join(F.coalesce("root_commits", none), ",").alias("first_commit_hash"),
            F.array_join(F.coalesce("early_commits", none), ",").alias("early_commit_hashes"),
            "commit_minhash",
            "repo_url",
            namespace(F.col("repo_url")).alias("repo_org"),
            leaf_name(F.col("repo_url")).alias("repo_name"),
            F.coalesce("head_commit_sha", F.lit("")).alias("head_commit_sha"),
        )
    )
