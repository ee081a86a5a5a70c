"""Data source ``working_trees``: every file below ``root/<folder>/``, listed and read by the tasks.

Spark's own listing leaves out names that begin with a dot or an underscore, and
empty files; a source tree is full of both.  The driver lists folders only as deep as it
needs to have enough of them to share out; each task walks the folders it got
and opens a file only when its row has passed the filters on path and size.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "folder string, path string, size long, content binary"
NO_LIMIT = 1 << 62


def store_of(root: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path of a location; a plain path is a local one."""
    parts = urlsplit(root)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), (parts.path or root).rstrip("/")
    return pafs.FileSystem.from_uri(root.rstrip("/").replace("s3a://", "s3://", 1))


@dataclass
class Subtrees(InputPartition):
    """Folders to walk (``deep``) and folders of which only the files are taken, relative to the root."""

    deep: list[str]
    flat: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.partitions_wanted = int(options.get("partitions", 64))
        self.batch_bytes = int(options.get("batchBytes", 8 << 20))
        self.excluded = frozenset(filter(None, options.get("excluded", "").split("\n")))
        self.with_content = options.get("content", "true").lower() == "true"
        self.sizes = int(options.get("minBytes", 0)), int(options.get("maxBytes", NO_LIMIT))
        self.names = re.compile(options["names"]) if options.get("names") else None

    def partitions(self) -> list[InputPartition]:
        """Subtrees in about ``partitions`` parts: folders are opened level by level until there are enough."""
        store, root = store_of(self.root)
        deep, flat = [d for d in self._folders(store, root, "") if not self._left_out(d)], []
        while deep and len(deep) < self.partitions_wanted:
            below = [d for one in deep for d in self._folders(store, root, one)]
            if not below:
                break
            flat, deep = flat + deep, [d for d in below if not self._left_out(d)]
        n = max(1, min(self.partitions_wanted, len(deep) + len(flat)))
        return [Subtrees(deep[k::n], flat[k::n]) for k in range(n)]

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        store, root = store_of(self.root)
        rows, held = [], 0
        for place, info in self._files(store, root, partition):
            folder, _, path = place.partition("/")
            if not self.sizes[0] <= info.size <= self.sizes[1] or self.names and not self.names.search(path):
                continue
            content = None
            if self.with_content:
                with store.open_input_stream(info.path, compression=None) as source:
                    content = source.read()
            rows.append((folder, path, info.size, content))
            held += len(content or b"") + 256
            if held >= self.batch_bytes:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _left_out(self, place: str) -> bool:
        return not self.excluded.isdisjoint(place.split("/")[1:])

    @staticmethod
    def _folders(store: pafs.FileSystem, root: str, place: str) -> list[str]:
        base = f"{root}/{place}" if place else root
        found = store.get_file_info(pafs.FileSelector(base, recursive=False))
        return sorted(f"{place}/{x.base_name}" if place else x.base_name for x in found if x.type == pafs.FileType.Directory)

    def _files(self, store: pafs.FileSystem, root: str, part: Subtrees) -> Iterator[tuple[str, pafs.FileInfo]]:
        """(place below the root, info) of every file, one folder in memory at a time."""
        todo = [(d, True) for d in reversed(part.deep)] + [(d, False) for d in reversed(part.flat)]
        while todo:
            place, deep = todo.pop()
            for info in sorted(
                store.get_file_info(pafs.FileSelector(f"{root}/{place}", recursive=False)), key=lambda x: x.base_name
            ):
                inner = f"{place}/{info.base_name}"
                if info.type == pafs.FileType.File:
                    yield inner, info
                elif info.type == pafs.FileType.Directory and deep and not self._left_out(inner):
                    todo.append((inner, True))

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["folder", "path", "size", "content"])


class WorkingTrees(DataSource):
    """Options: ``path``, ``partitions`` (64), ``excluded`` (folder names, one a line, that are not entered),
    ``content`` (false: null instead of reading files), ``minBytes``, ``maxBytes``, ``names`` (pattern that the
    path must contain), ``batchBytes``.

    The limits are options and not pushed filters: Spark keeps one reader per loaded table, so filters
    that it pushes from one branch of a plan would also cut the others.
    """

    @classmethod
    def name(cls) -> str:
        return "working_trees"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def working_trees(
    spark: SparkSession, root: str, excluded: tuple[str, ...] = (), content: bool = True, partitions: int | None = None,
    min_bytes: int = 0, max_bytes: int = NO_LIMIT, names: str = "",
) -> DataFrame:
    """folder, path, size and content of every file below ``root/<folder>/``, hidden and empty ones too.

    Excluded folders are not entered, and files whose size or path fails are
    never opened.  A link is what the store says it is.
    """
    _shipped()
    spark.dataSource.register(WorkingTrees)
    n = partitions or 4 * spark.sparkContext.defaultParallelism
    return (
        spark.read.format("working_trees")
        .option("partitions", n).option("excluded", "\n".join(excluded)).option("content", str(content).lower())
        .option("minBytes", min_bytes).option("maxBytes", max_bytes).option("names", names)
        .load(root)
    )


def _shipped() -> None:
    """Send this module with what uses it, so that workers need no installation of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_working_trees(files: DataFrame, root: str) -> DataFrame:
    """Write ``files`` (folder, path, content) below ``root/<folder>/`` from the tasks; returns what was written.

    Null content is an empty file.  A repeated attempt writes the same file again.  The
    result (folder, path, size) is computed as it is written, so write or count it.
    """
    _shipped()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for folder, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parent = os.path.dirname(f"{base}/{folder}/{path}")
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(f"{base}/{folder}/{path}", compression=None) as out:
                    out.write(content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["folder", "path", "size"]
            )

    return files.select("folder", "path", "content").mapInArrow(run, "folder string, path string, size long")
