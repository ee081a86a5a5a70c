"""Histories cut into many chains take few rounds."""

from __future__ import annotations

from corpusmill.operators import ancestry


def test_a_line_cut_into_many_chains_takes_few_rounds(spark, monkeypatch):
    n, rounds = 64, []
    commits = [("r", f"m{i}", [f"m{i - 1}"] if i else []) for i in range(n)]
    # Branches whose names come first take the commits they start from.
    commits += [("r", f"a{i}", [f"m{i}"]) for i in range(n)] + [("r", "b", ["m9", "a3"])]
    written = ancestry.materialized
    monkeypatch.setattr(ancestry, "materialized", lambda df, name: rounds.append(name) or written(df, name))
    got = ancestry.ancestors_of_heads(
        spark.createDataFrame(commits, "repo_url string, sha string, parents array<string>"),
        spark.createDataFrame([("r", "m60")], "repo_url string, sha string"),
    )
    assert {r.sha for r in got.collect() if r.on_head} == {f"m{i}" for i in range(61)}
    assert rounds.count("moved-marks") <= 8 and rounds.count("chain-exits") <= 8
