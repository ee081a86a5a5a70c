"""Python works on pieces of a batch."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import StructType

from corpusmill.functions import entities
from corpusmill.functions.batches import PIECE, pieces
from corpusmill.operators import redaction

TEXT = "Globex Client wrote this line number {} of the text\n" * 100


def texts(rows: int) -> list[str]:
    return [TEXT.format(*range(i, i + 100)) for i in range(rows)]


class Frame:
    """Stands for a DataFrame and hands out the function that its batches would go through."""

    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))

    def __init__(self, *columns):
        self.columns, self.schema = list(columns), StructType()

    def drop(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_pieces_hold_every_row_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([["x" * (i % 90)] * 3 for i in range(1000)])], ["i", "lines"])
    got = list(pieces(batch, 5000))
    assert len(got) > 10 and all(p.nbytes <= 5000 for p in got)
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in pieces(batch.slice(7, 1), 1)] == [1]
    assert [p.num_rows for p in pieces(batch.slice(0, 0), 0)] == [0]


@pytest.mark.parametrize("step", ["keys", "names"])
def test_redaction_takes_a_batch_in_pieces(step):
    rows = texts(2000)
    assert sum(map(len, rows)) > 2 * PIECE
    if step == "keys":
        key = entities.name_key("Globex Client", None)
        words = np.full(1, (1 << 64) - 1, np.uint64)
        run = redaction.with_name_keys(Frame("path", "text"), "text", words, False)
        batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(2000))), pa.array(rows)], ["path", "text"])
        out = list(run(iter([batch])))
        assert all(key in r["name_keys"] for b in out for r in b.slice(0, 1).to_pylist())
    else:
        run = redaction.with_names_redacted(Frame("path", "text", "names"), "text")
        names = pa.array([[{"name": "globex client", "put": "John Doe"}]] * len(rows))
        batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(2000))), pa.array(rows), names], ["path", "text", "names"])
        out = list(run(iter([batch])))
        assert out[-1].column(1)[-1].as_py() == rows[-1].replace("Globex Client", "John Doe")
    assert [p for b in out for p in b.column(0).to_pylist()] == [str(i) for i in range(2000)]
    assert max(b.num_rows for b in out) < 1500
