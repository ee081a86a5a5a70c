"""Files are found before their content moves."""

from __future__ import annotations

from corpusmill.operators import selection
from corpusmill.operators.identity import history_ends
from corpusmill.plans import adapters


def test_content_of_other_files_stays_where_it_is(spark, tmp_path):
    files = spark.range(2000).selectExpr("'r' AS repo_url", "concat('./f', id) AS path", "cast(repeat(sha2(string(id), 256), 40) AS binary) AS content")
    files.write.parquet(str(tmp_path / "files"))
    saved = spark.range(0, 2000, 200).selectExpr(
        "'r' AS repo_url", "id AS rank", "concat('./f', id) AS path", "concat('f', id) AS norm_path", "false AS is_partial",
        "0 AS first_line", "1 AS last_line",
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = selection.sample_texts(saved, spark.read.parquet(str(tmp_path / "files")))
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert len(plan.split("LeftSemi")) == 2 and "SortMergeJoin" in plan
        assert plan.index("SortMergeJoin") < plan.index("LeftSemi")
        assert sorted((r.path, len(r.text)) for r in got.collect()) == sorted((f"./f{i}", 2560) for i in range(0, 2000, 200))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_commits_stay_where_they_are_read(spark, tmp_path):
    commits = spark.range(40000).selectExpr(
        "concat('r', id % 7) AS repo_url", "sha2(string(id), 256) AS sha", "id AS pos", "true AS on_head",
        "if(id > 39990, array(), array('p')) AS parents",
    )
    commits.write.parquet(str(tmp_path / "commits"))
    spark.range(40000).selectExpr("id AS o_orderkey", "id % 900 AS o_custkey", "timestamp'2020-01-01' AS o_orderdate").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        ends = history_ends(spark.read.parquet(str(tmp_path / "commits")))
        read = adapters.commits(spark, str(tmp_path))
        plans = [df._jdf.queryExecution().sparkPlan().toString() for df in (ends, read)]
        assert not any("SortMergeJoin" in line and "_lead" in line for line in plans[0].split("\n"))
        assert "SortMergeJoin" not in plans[1]
        assert len(ends.collect()) == 7 and read.count() == 40000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
