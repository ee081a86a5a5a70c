"""Arrow batches in pieces of bounded size, so that what Python holds of one does not depend on how many rows it has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a piece; as Python objects it takes several times as much. A single row may be larger.
PIECE = 4 << 20


def pieces(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, cut in halves until a piece has one row or at most ``most`` bytes; copies nothing."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), most)
    yield from pieces(batch.slice(half), most)
