"""Newest rows: no sort over the whole input, ties, nulls and hot groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators.identity import history_ends
from corpusmill.operators.manifest import latest_versions
from corpusmill.operators.repos import latest_branch
from corpusmill.operators.runlog import run_statistics
from corpusmill.operators.skew import leading_rows


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_leading_rows(spark):
    rows = [("a", 1, "x"), ("a", 3, "z"), ("a", 3, "y"), (None, None, "q"), (None, None, "p"), ("b", None, "r"), ("b", 0, "s")]
    df = spark.createDataFrame(rows, "k string, v long, t string")
    got = leading_rows(df, ["k"], F.col("v"), [F.col("t")])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 3, "y"), (None, None, "p"), ("b", 0, "s")], key=repr)
    hot = spark.range(20_000).select(F.lit("k").alias("k"), F.lit(1).alias("v"), F.col("id").alias("t"))
    assert [r.t for r in leading_rows(hot, ["k"], F.col("v"), [F.col("t").desc()], salt_on=["t"]).collect()] == [19_999]
    assert leading_rows(df.limit(0), ["k"], F.col("v"), [F.col("t")]).collect() == []


def test_newest_of_a_group_needs_no_sorted_aggregate(spark):
    refs = spark.range(1000).selectExpr(
        "concat('r', id % 7) AS repo_url", "concat('b', id) AS refname", "timestamp_seconds(id div 50) AS committer_ts", "'s' AS tip_sha"
    )
    versions = spark.range(1000).selectExpr("concat('r', id % 7) AS repo_url", "id % 90 AS version", "id AS event_id", "'x' AS note")
    events = spark.range(1000).selectExpr(
        "id % 9 AS run_id", "id % 50 AS turn", "'bash' AS tool", "false AS saved", "1L AS loc", "if(id % 4 = 0, concat('n', id), null) AS prose"
    )
    commits = spark.range(1000).selectExpr(
        "concat('r', id % 7) AS repo_url", "cast(id as string) AS sha", "id AS pos", "true AS on_head", "if(id > 990, array(), array('p')) AS parents"
    )
    for df in (
        latest_branch(refs), latest_versions(versions, ["version", "event_id"]), run_statistics(events), history_ends(commits)
    ):
        assert "SortAggregate" not in plan_of(df)[1]
    newest = {r.repo_url: r.event_id for r in latest_versions(versions, ["version", "event_id"]).collect()}
    assert newest == {f"r{k}": max((i % 90, i) for i in range(1000) if i % 7 == k)[1] for k in range(7)}
    told = {r.run_id: r.last_prose for r in run_statistics(events).collect()}
    assert told == {k: max((i % 50, f"n{i}") for i in range(1000) if i % 9 == k and i % 4 == 0)[1] for k in range(9)}
    ends = {r.repo_url: (r.head_commit_sha, r.root_commits) for r in history_ends(commits).collect()}
    assert ends["r3"] == ("3", [str(i) for i in range(991, 1000) if i % 7 == 3])
