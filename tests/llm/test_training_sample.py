"""The bounded sample holds one row per id."""

from __future__ import annotations

from corpusmill.llm.training import labelled_sample


def test_repeated_ids_count_once(spark):
    rows = [(i, f"text {i}") for i in range(1, 20)] + [(2, f"again {i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id long, quality int")
    got = [tuple(r) for r in labelled_sample(docs, labels, "quality", 30).collect()]
    assert len(got) == len({r[0] for r in got}) > 10 and 2 in {r[0] for r in got}
    again = labelled_sample(docs.repartition(7), labels, "quality", 30).collect()
    assert sorted(got) == sorted(map(tuple, again))
