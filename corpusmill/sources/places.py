"""Rows of Parquet tables by their place: columns that are wide are read last, for the rows that are left."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as parquet
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.sources import trees

#: Rows of one read inside a row group; with contents of some kilobytes a few megabytes.
STEP = 1024
#: Rows whose places go to one task together, about a row group.
RUN = 1 << 20


def located(stored: DataFrame) -> DataFrame:
    """A Parquet table with ``row_file`` and ``row_number``, the place of each row."""
    return stored.select("*", F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_number"))


def rows_at(wanted: DataFrame, stored: DataFrame, columns: list[str], partitions: int | None = None) -> DataFrame:
    """``wanted`` (with ``row_file`` and ``row_number``) with ``columns`` of its rows of ``stored`` in place of the two.

    Places are dealt by runs of rows, so a file of any size is shared out, and a
    task reads each row group that it has places in once, front to back, a few
    columns and rows at a time.  What is read does not enter an exchange.
    The table must not be rewritten meanwhile; a row that has gone is an error.
    """
    for module in (trees, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)
    n = partitions or int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = wanted.repartition(n, "row_file", F.expr(f"row_number div {RUN}")).sortWithinPartitions("row_file", "row_number")
    kept = [f for f in wanted.schema.fields if f.name not in ("row_file", "row_number")]
    schema, names = StructType([*kept, *[stored.schema[c] for c in columns]]), [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            files = batch.column(batch.schema.get_field_index("row_file")).to_pylist()
            numbers = batch.column(batch.schema.get_field_index("row_number")).to_numpy()
            start = 0
            while start < batch.num_rows:
                if reader is None or reader.name != files[start]:
                    reader = _Rows(files[start], columns)
                stop = start
                while stop < min(batch.num_rows, start + STEP) and files[stop] == files[start]:
                    stop += 1
                part = batch.slice(start, stop - start)
                own = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*own, *reader.take(numbers[start:stop])], [*names, *columns])
                start = stop

    return dealt.mapInArrow(run, schema)


class _Rows:
    """Rows of one file in ascending order; the last piece that was read stays for the next call."""

    def __init__(self, name: str, columns: list[str]):
        store, path = trees.store_of(name)
        # Spark writes places as URIs, so a blank in a local path comes as %20.
        path = unquote(path) if name.startswith("file:") else path
        self.name, self.columns = name, columns
        self.file = parquet.ParquetFile(store.open_input_file(path))
        meta = self.file.metadata
        self.ends = np.cumsum([meta.row_group(i).num_rows for i in range(meta.num_row_groups)])
        self.group, self.pieces, self.piece, self.at = -1, iter(()), None, 0

    def take(self, numbers: np.ndarray) -> list[pa.Array]:
        out = []
        done = 0
        while done < len(numbers):
            group = int(np.searchsorted(self.ends, numbers[done], "right"))
            if group != self.group:
                self.group, self.piece = group, None
                self.at = int(self.ends[group - 1]) if group else 0
                self.pieces = self.file.iter_batches(STEP, row_groups=[group], columns=self.columns)
            while self.piece is None or numbers[done] >= self.at + self.piece.num_rows:
                self.at += self.piece.num_rows if self.piece is not None else 0
                self.piece = next(self.pieces)
            stop = int(np.searchsorted(numbers, self.at + self.piece.num_rows, "left"))
            out.append(self.piece.take(pa.array(numbers[done:stop] - self.at)))
            done = stop
        table = pa.Table.from_batches(out)
        return [table.column(c).combine_chunks() for c in self.columns]
