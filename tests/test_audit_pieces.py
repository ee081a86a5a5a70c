"""The audit works on pieces of a batch and walks only what moved."""

from __future__ import annotations

import pyarrow as pa

from corpusmill.functions import alignment
from corpusmill.operators import audit
from tests.test_pieces import texts


def test_audit_takes_a_batch_in_pieces():
    old = [t.split("\n") for t in texts(2000)]
    new = [[*lines[:5], "changed", *lines[6:]] for lines in old]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["f"] * 2000), pa.array(map(str, range(2000))), pa.array(old), pa.array(new)], ["folder", "path", "old", "new"]
    )
    for run in (audit._change_counts(6), audit._line_pairs()):
        out = list(run(iter([batch])))
        assert [p for b in out for p in b.column(1).to_pylist()] == [str(i) for i in range(2000)]
        assert max(b.num_rows for b in out) < 1500


def test_lines_replaced_in_place_need_no_walk(monkeypatch):
    old = [f"line {i}" for i in range(900)]
    new = ["REDACTED" if i % 10 == 5 else line for i, line in enumerate(old)]
    walked, walk = [], alignment._walk
    monkeypatch.setattr(alignment, "_walk", lambda a, b: walked.append(len(a) * len(b)) or walk(a, b))
    assert alignment.matched(old, new) == [(i, i) for i in range(900) if i % 10 != 5]
    assert walked == [0]
