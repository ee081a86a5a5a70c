"""Registered queries against SQL, and the pipeline against plain code."""

from __future__ import annotations

import pytest

import corpus_pipeline
from corpusmill.llm.queries import QUERIES
from corpusmill.llm.sql import SQL
from tests.oracle_check import difference, duckdb_with_views

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), duckdb_with_views(SMALL).sql(SQL[name])) is None


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    from tests.llm.test_operators import WORD, grams, plain_contamination

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SMALL)
        if "token" in name:
            break
        assert out.columns == docs.columns
        before, after = ({r.doc_id: r.text for r in d.collect()} for d in (now, out))
        if "classifier" in name:
            scores = {r.doc_id: r.predicted for r in QUERIES["op7_rule_ensemble"](spark, SMALL).collect()}
            assert set(after) == {i for i in before if scores[i]} and len(after) > 0.7 * len(before)
        elif "Jaccard" in name:
            sets = {i: grams(t) for i, t in before.items()}
            twins = {
                i for i in before
                for j in before if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            }
            assert set(after) == set(before) - twins
        elif "benchmark" in name:
            bad = {r[0] for r in plain_contamination(list(before.items()), bench) if r[5]}
            assert set(after) == set(before) - bad
        else:
            size = sum(len(WORD.findall(t)) for t in before.values())
            mixed = sum(len(WORD.findall(r.text)) for r in out.collect())
            assert abs(mixed - 1.5 * size) < 0.02 * size and set(after) <= set(before)
        now = out
    records = out.collect()
    assert sorted(r.slot for r in records) == list(range(len(records))) and {len(r.record) for r in records} == {512}


def test_run_returns_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.count() > 0 and "record" in got.columns
