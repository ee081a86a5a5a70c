"""Every registered query against its SQL on the smallest tables, and its plan."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry
import corpusmill.plans.oracle
import corpusmill.plans.queries
from corpusmill import plans
from tests.oracle_check import difference, duckdb_with_views

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries.QUERIES, plans.oracle.SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert difference(df, duckdb_with_views(SF).sql(SQL[name])) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert slow not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_is_needed(spark):
    plan = plan_of(QUERIES["tree_files"](spark, SF))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan)[0] == "source:string"


def test_size_filter_reaches_a_parquet_files_table(spark, tmp_path):
    from corpusmill.operators.profile import language_counts
    from corpusmill.plans.adapters import files

    path = str(tmp_path / "files")
    files(spark, SF).write.parquet(path)
    plan = plan_of(language_counts(spark.read.parquet(path)))
    assert "GreaterThan(size,0)" in plan and "LessThanOrEqual(size,20971520)" in plan
    assert plan.count("Exchange") == 1


def test_ranking_is_limited_before_the_shuffle(spark):
    from corpusmill.operators.identity import early_commits
    from corpusmill.plans.adapters import commits

    assert plan_of(early_commits(commits(spark, SF))).count("WindowGroupLimit") >= 2


def test_fingerprint_combines_before_its_only_shuffle(spark, tmp_path):
    from corpusmill.operators.identity import commit_minhash
    from corpusmill.plans.adapters import commit_ids

    path = str(tmp_path / "commits")
    commit_ids(spark, SF).write.parquet(path)
    plan = plan_of(commit_minhash(spark.read.parquet(path)))
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2


def test_entry(spark):
    assert entry.entry(spark).count() > 0
