"""Token-ID output in training order: keyed permutation of all sequences into fixed-stride shard files."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import binary_rows, new_folder, pieces, ranges
from corpusmill.llm.feistel import permuted
from corpusmill.llm.files import new_file, opened, opened_at

# Fixed value: pre-tokenizer pattern that belongs to the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class TokenParams:
    """A record is ``length`` ids of two bytes, little endian; ``pad`` is an id that no text yields.

    The starts of up to ``broadcast_tasks`` tasks (16 bytes each) are broadcast, more are joined by shuffle.
    Shard files are written in ``waves``, so that only one wave of records is in the shuffle beside the files.
    """

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    length: int = 256
    pad: int = 50256
    slots_per_shard: int = 65536
    key: int = 20240229
    part_chars: int = 1 << 18
    broadcast_tasks: int = 200_000
    waves: int = 3

    @property
    def stride(self) -> int:
        return 2 * self.length


# Before such a blank the pre-tokenizer always cuts, whatever stands around it.
CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(2)
def encoder(params: TokenParams):
    """Function from a text to the bytes of its ids; equal to encoding the whole text at once.

    A long text is cut into parts of about ``part_chars`` characters where the
    pre-tokenizer cuts anyway, so that only the ids of one part are Python objects at a time.
    """
    with open(params.vocabulary, "rb") as source:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in source)}
    encode = tiktoken.Encoding(
        "vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary

    def ids(text: str) -> bytes:
        if len(text) <= params.part_chars:
            return np.array(encode(text), np.uint16).tobytes()
        out, start = [], 0
        while start < len(text):
            cut = CUT.search(text, start + params.part_chars)
            stop = cut.start() if cut else len(text)
            out.append(np.array(encode(text[start:stop]), np.uint16).tobytes())
            start = stop
        return b"".join(out)

    return ids


def sequences(docs: DataFrame, params: TokenParams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sequence of at most ``length`` ids, numbered inside its task.

    A text without ids (null or empty) is one sequence without tokens, so no
    document is lost.
    """
    names = ["doc_id", "piece", "task", "place", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, place, task = encoder(params), 0, TaskContext.get().partitionId()
        for batch in pieces(batches, "text"):
            encoded = [ids(t or "") for t in batch.column(1).to_pylist()]
            size = np.array([len(e) for e in encoded], np.int64)
            count = np.maximum(-(-size // params.stride), 1)
            n = int(count.sum())
            row = np.repeat(np.arange(len(size)), count)
            piece = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
            length = np.minimum(size[row] - piece * params.stride, params.stride)
            ends = np.concatenate([[0], np.cumsum(length)])
            joined = np.frombuffer(b"".join(encoded), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)),
                    pa.array(np.full(n, task, np.int32)), pa.array(np.arange(place, place + n)),
                    binary_rows(joined, ends),
                ],
                names,
            )
            place += n

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, piece int, task int, place long, tokens binary")


def _slots(docs: DataFrame, params: TokenParams, key: str, text: str) -> tuple[DataFrame, int]:
    """Every sequence with its slot and shard, and the number of shards."""
    spark = docs.sparkSession
    made = f"{new_folder(spark, 'sequences')}"
    sequences(docs, params, key, text).write.option("compression", "zstd").parquet(made)
    rows = spark.read.parquet(made)
    counts = rows.groupBy(F.col("task").alias("_task")).agg(F.count("*").alias("n"))
    # One row per task of the first pass.
    ahead = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    total = sums[0] or 0
    if sums[1] <= params.broadcast_tasks:
        starts = F.broadcast(starts)
    @F.arrow_udf("long")
    def slot(index: pa.Array) -> pa.Array:
        return pa.array(permuted(index.to_numpy(), total, params.key))

    # Only the running number goes to Python here, the tokens stay where they are.  Declared
    # non-deterministic, lest a filter on the shard computes the numbers a second time.
    placed = rows.join(starts, F.col("task") == F.col("_task")).select(
        "doc_id", "piece", slot.asNondeterministic()(F.col("start") + F.col("place")).alias("slot"), "tokens"
    )
    shard = F.floor(F.col("slot") / F.lit(params.slots_per_shard)).cast("int")
    return placed.withColumn("shard", shard), max(1, -(-total // params.slots_per_shard))


RECORDS = (
    "doc_id long, piece int, n_tokens int, slot long, shard int, byte_offset long, record_crc32 long, record binary"
)


def _in_order(placed: DataFrame, first: int, stop: int) -> DataFrame:
    """Whole shards, numbers ``first`` to ``stop - 1``, one partition each, in slot order."""
    return placed.repartitionById(stop - first, F.col("shard") - F.lit(first)).sortWithinPartitions("slot")


def _padded(batches: Iterator[pa.RecordBatch], params: TokenParams) -> Iterator[pa.RecordBatch]:
    """Each sequence padded to a record."""
    pad = np.full(params.length, params.pad, np.uint16).tobytes()
    for batch in batches:
        slots, tokens = batch.column("slot").to_numpy(), batch.column("tokens").to_pylist()
        records = [t + pad[len(t) :] for t in tokens]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("piece"),
                pa.array([len(t) // 2 for t in tokens], pa.int32()),
                batch.column("slot"), batch.column("shard"),
                pa.array(slots % params.slots_per_shard * params.stride),
                pa.array([zlib.crc32(r) for r in records], pa.int64()), pa.array(records, pa.binary()),
            ],
            ["doc_id", "piece", "n_tokens", "slot", "shard", "byte_offset", "record_crc32", "record"],
        )


def _filed(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Append each batch's records to the file of their shard; the batch without records, with ``path``."""
    shard, context, out, uri = None, None, None, None
    for batch in batches:
        shards, records = batch.column("shard").to_numpy(), batch.column("record")
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        paths = []
        for start, stop in zip(edges, edges[1:]):
            if start == stop:
                continue
            if shards[start] != shard:
                if context:
                    context.__exit__(None, None, None)
                shard = shards[start]
                context = new_file(folder, f"shard-{shard:08d}", ".bin")
                out, uri = context.__enter__()
            out.write(b"".join(records[start:stop].to_pylist()))
            paths += [uri] * (stop - start)
        names = [c for c in batch.schema.names if c != "record"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array(paths, pa.string())], [*names, "path"]
        )
    if context:
        context.__exit__(None, None, None)


def training_order(
    docs: DataFrame, params: TokenParams = TokenParams(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All sequences of ``docs`` as fixed-stride records in a random but fixed order.

    Texts become ids once; the sequences are written to the shared folder, and
    the counts of the tasks that made them give each a number 0 .. n-1.  The
    keyed permutation of that number is its global ``slot``.  Sequences are
    partitioned by ``shard`` and sorted by slot, so that whatever writes the
    result writes whole shards front to back.  ``record`` always has ``stride``
    bytes: ids of two bytes, then padding.  Slot ``s`` stands at ``byte_offset``
    ``s % slots_per_shard * stride`` of shard ``s // slots_per_shard``, and a
    reader resumes anywhere.  The order depends on the key and the table as stored, not on timing.

    Null and empty texts fill one slot with padding only; an empty table gives
    no rows.  Repeated rows get slots of their own; only ``key`` and ``text`` are read.
    """
    placed, shards = _slots(docs, params, key, text)
    return _in_order(placed, 0, shards).mapInArrow(lambda batches: _padded(batches, params), RECORDS)


def written_order(
    docs: DataFrame, params: TokenParams = TokenParams(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``training_order`` by way of its shard files: writes them and returns their index with ``record`` read back.

    A wave takes a run of shards; its shuffle files are deleted once its shard files are written.
    """
    spark = docs.sparkSession
    placed, shards = _slots(docs, params, key, text)
    folder, waves = new_folder(spark, "shards"), min(params.waves, shards)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    listed = []
    try:
        spark.conf.set(cleanup, "true")
        for wave in range(waves):
            first, stop = wave * shards // waves, (wave + 1) * shards // waves
            part = placed.where((F.col("shard") >= first) & (F.col("shard") < stop))
            listed.append(_index(_in_order(part, first, stop), RECORDS, folder, lambda batches: _padded(batches, params)))
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    return with_records(reduce(DataFrame.union, listed), params)


def write_shard_files(ordered: DataFrame, folder: str | None = None) -> DataFrame:
    """Write each shard of ``training_order`` as one raw file; returns the index (without records, with ``path``).

    Files are written front to back by the tasks that hold the shards; the
    index is written once and names the files of successful attempts, others are never read.
    """
    folder = folder or new_folder(ordered.sparkSession, "shards")
    return _index(ordered, ", ".join(f"{c} {t}" for c, t in ordered.dtypes), folder, lambda batches: batches)


def _index(ordered: DataFrame, kinds: str, folder: str, to_records) -> DataFrame:
    """The written index of the files that hold ``to_records`` of each partition, whose columns are ``kinds``."""
    listed = new_folder(ordered.sparkSession, "index")
    fields = [kind for kind in kinds.split(", ") if not kind.startswith("record ")]
    ordered.mapInArrow(lambda batches: _filed(to_records(batches), folder), ", ".join([*fields, "path string"])).write.parquet(
        listed
    )
    return ordered.sparkSession.read.parquet(listed)


def read_records(spark: SparkSession, index: DataFrame, params: TokenParams = TokenParams(), from_slot: int = 0) -> DataFrame:
    """``slot`` and ``ids`` (array of int, without padding) from ``from_slot`` on, read from the files in order."""
    files = index.where(F.col("slot") >= from_slot).groupBy("shard", "path").agg(
        F.min("slot").alias("first"), F.count("*").alias("n")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(path) as source:
                    skip = (first - shard * params.slots_per_shard) * params.stride
                    while skip:
                        skip -= len(source.read(min(skip, 1 << 22)))
                    while n:
                        take = min(n, 4096)
                        block = np.frombuffer(source.read(take * params.stride), np.uint16).reshape(take, -1)
                        ids = [r[r != params.pad].astype(np.int32) for r in block]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.arange(first, first + take)), pa.array(ids, pa.list_(pa.int32()))],
                            ["slot", "ids"],
                        )
                        first, n = first + take, n - take

    return files.repartition(ranges(spark), "shard").mapInArrow(run, "slot long, ids array<int>")


def with_records(index: DataFrame, params: TokenParams = TokenParams()) -> DataFrame:
    """The index without ``path`` and with each row's ``record``, read from its file and held against its checksum."""
    names = [c for c in index.columns if c != "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, offsets = batch.column("path").to_pylist(), batch.column("byte_offset").to_numpy()
            records, start, n = [], 0, batch.num_rows
            while start < n:  # runs of records that follow each other in a file
                stop = start + 1
                while stop < n and paths[stop] == paths[start] and offsets[stop] == offsets[stop - 1] + params.stride:
                    stop += 1
                with opened_at(paths[start], int(offsets[start])) as source:
                    block = source.read((stop - start) * params.stride)
                records += [block[i : i + params.stride] for i in range(0, len(block), params.stride)]
                start = stop
            if [zlib.crc32(r) for r in records] != batch.column("record_crc32").to_pylist():
                raise ValueError(f"shard files differ from their index: {sorted(set(paths))[:3]}")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(records, pa.binary())], [*names, "record"])

    kinds = ", ".join(f"{c} {t}" for c, t in index.drop("path").dtypes) + ", record binary"
    return index.mapInArrow(run, kinds)
