"""Slots of the mix are many more than the counts they grow from."""

from __future__ import annotations

from corpusmill.llm.mixing import MixParams, mixed_documents, plan_mix, taken_words


def test_slots_of_the_mix_are_never_broadcast(spark):
    rows = [(i, f"w{i} " * 700, "en", "ab"[i % 2], 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    params = MixParams(slots_per_shard=64)
    for out in (mixed_documents(docs, params), taken_words(plan_mix(docs, params))):
        assert out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        joins = [line for line in plan.split("\n") if "Join" in line and "block#" in line]
        assert "Final Plan" in plan and joins and all("SortMergeJoin" in line for line in joins)
