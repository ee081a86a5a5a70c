"""The benchmark is handed to tasks in written blocks, long items in overlapping pieces."""

from __future__ import annotations

from corpusmill.llm.decontaminate import DecontaminationParams, _block, _blocks, contamination_digest, words


def test_long_items_are_cut_without_losing_a_window(spark):
    text = " ".join(f"w{i}" for i in range(400))
    benchmark = spark.createDataFrame([(1, text), (1, text), (2, "short one")], "item_id long, text string")
    params = DecontaminationParams(block_bytes=700)
    folder, parts = _blocks(benchmark, "item_id", "text", params)
    blocks = [_block(folder, part) for part in parts]
    assert len(blocks) > 1 and max(len(t) for b in blocks for _, t in b) < 1000
    found = {tuple(w[i : i + 10]) for b in blocks for n, t in b if n == 1 for w in [words(t)] for i in range(len(w) - 9)}
    whole = words(text)
    assert found == {tuple(whole[i : i + 10]) for i in range(391)}
    docs = spark.createDataFrame([(7, text), (8, "a short one too")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in contamination_digest(docs, benchmark, params).collect()}
    assert got == {7: (400, 1), 8: (2, 1)}
