"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.llm.common import materialized, new_folder, pieces
from corpusmill.llm.files import filesystem

# Fixed value: what a word may hold after A-Z became a-z; every other byte separates.
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
NORMAL = bytes(
    (b + 32 if 65 <= b <= 90 else b) if (b + 32 if 65 <= b <= 90 else b) in _KEPT else 32 for b in range(256)
)


@dataclass(frozen=True)
class DecontaminationParams:
    """``block_bytes`` bounds the benchmark text of one automaton; more text takes further passes.

    Every word starts a window of some 60 characters, so 1 MB of text is up to about 10 million trie nodes.
    """

    window: int = 10
    block_bytes: int = 1 << 20


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split(b" ") if text else []


def words(text: str | None) -> list[bytes]:
    return [w for w in normalised(text) if w]


def automaton_of(items: list[tuple[int, str]], window: int):
    """Automaton over the windows, and for each window its length in words and its items."""
    known: dict[bytes, set[int]] = {}
    length: dict[bytes, int] = {}
    for item, text in items:
        found = words(text)
        size = min(window, len(found))
        for start in range(len(found) - size + 1 if size else 0):
            gram = b" " + b" ".join(found[start : start + size]) + b" "
            known.setdefault(gram, set()).add(item)
            length[gram] = size
    automaton = ahocorasick.Automaton()
    for number, gram in enumerate(known):
        automaton.add_word(gram.decode("latin-1"), number)
    if known:
        automaton.make_automaton()
    return automaton if known else None, list(length.values()), [sorted(v) for v in known.values()]


_WORD = re.compile(rb"[^ ]+")


def _character_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Hit runs of words as character positions of the original text."""
    raw = text.encode()
    places = [(m.start(), m.end()) for m in _WORD.finditer(raw.translate(NORMAL))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    character = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    out = []
    for start, stop in zip(edges[::2], edges[1::2]):
        first, last = places[start][0], places[stop - 1][1]
        out.append({"start": int(character[first]) - 1, "end": int(character[last - 1])})
    return out


def cut_item(text: str, window: int, room: int) -> Iterator[str]:
    """Runs of the words of ``text`` of about ``room`` bytes that hold every window of it once or more."""
    found, start = words(text), 0
    while start < len(found):
        stop, size = start, 0
        while stop < len(found) and (size < room or stop < start + 2 * window):
            size += len(found[stop]) + 1
            stop += 1
        yield b" ".join(found[start:stop]).decode()
        if stop == len(found):
            return
        start = stop - window + 1


def _block(folder: str, part: int) -> list[tuple[int, str]]:
    """Items of one part, read by a task."""
    store, path = filesystem(f"{folder}/part={part}")
    found = parquet.read_table(path, filesystem=store, partitioning=None)
    return sorted(zip(*(c.to_pylist() for c in found.columns)))


def _blocks(benchmark: DataFrame, item: str, text: str, params: DecontaminationParams) -> tuple[str, list[int]]:
    """Folder with the parts of the benchmark, each of about ``block_bytes``, and their numbers.

    A part is whole rows; texts of more than a block are cut where words end, and each piece repeats the last
    ``window - 1`` words of the one before, so that no window is lost.
    """
    spark, room, window = benchmark.sparkSession, params.block_bytes, params.window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in cut_item(body, window, room):
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([piece], pa.string())], ["i", "t"])

    chosen = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item).cast("long").alias("i"), F.col(text).alias("t")
    ).distinct()
    long = chosen.where(F.octet_length("t") > room).mapInArrow(cut, "i long, t string")
    pieced = materialized(chosen.where(F.octet_length("t") <= room).union(long), "benchmark")
    total = pieced.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // room))
    folder = new_folder(spark, "blocks")
    pieced.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n))).repartition("part").write.partitionBy("part").parquet(folder)
    parts = spark.read.schema("i long, t string, part int").parquet(folder).select("part").distinct().collect() if total else []
    return folder, sorted(r["part"] for r in parts)


def contamination(
    docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams(),
    text: str = "text", carry: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Carried columns, ``n_words``, ``n_hit``, ``item_ids`` and ``spans`` of every row.

    Both sides are normalised to lower-case words.  Each run of ``window``
    consecutive words of an item, or the whole of a shorter item, is a window;
    a word of a document inside any occurrence of one is hit.  ``spans`` are
    the hit runs as character positions of the original text.  The text is
    scanned once per automaton: one, as long as the benchmark holds at most
    ``block_bytes``; beyond that one written pass per group of items.  Nothing
    is shuffled.  Null texts and null items have no words; items that repeat
    count once; an empty benchmark hits nothing.
    """
    fields = docs.select(*carry).schema
    folder, parts = _blocks(benchmark, item, item_text, params)
    state = docs.select(
        *carry, F.col(text).alias("_text"), F.array().cast("array<int>").alias("_runs"),
        F.array().cast("array<long>").alias("_items"),
    )
    for number, part in enumerate(parts or [None]):
        last = number >= len(parts) - 1
        tail = (
            "n_words long, n_hit long, item_ids array<long>, spans array<struct<start:int,end:int>>"
            if last else "_text string, _runs array<int>, _items array<long>"
        )
        schema = StructType([*fields.fields, *StructType.fromDDL(tail).fields])
        state = state.mapInArrow(_scan(folder, part, params.window, last, list(carry)), schema)
        if not last:
            state = materialized(state, "hits")
    return state


def _scan(folder: str, part: int | None, window: int, last: bool, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, lengths, owners = automaton_of([] if part is None else _block(folder, part), window)
        for batch in pieces(batches, "_text"):
            n = batch.num_columns
            texts, runs, items = (batch.column(n - k).to_pylist() for k in (3, 2, 1))
            words_out, hits_out, spans_out = [], [], []
            for row, text in enumerate(texts):
                found = words(text)
                own, seen = runs[row], set(items[row])
                if automaton is not None and found:
                    hay = (b" " + b" ".join(found) + b" ").decode("latin-1")
                    stops = None
                    for end, gram in automaton.iter(hay):
                        if stops is None:
                            stops = np.cumsum([len(w) + 1 for w in found])
                        stop = int(np.searchsorted(stops, end))
                        own += [stop - lengths[gram] + 1, stop + 1]
                        seen.update(owners[gram])
                runs[row], items[row] = own, sorted(seen)
                if last:
                    hit = np.zeros(len(found) + 1, np.int64)
                    np.add.at(hit, own[::2], 1)
                    np.add.at(hit, own[1::2], -1)
                    mask = hit.cumsum()[:-1] > 0
                    words_out.append(len(found))
                    hits_out.append(int(mask.sum()))
                    spans_out.append(_character_spans(text, mask) if own else [])
            kept = [batch.column(k) for k in range(len(carry))]
            if last:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *kept, pa.array(words_out, pa.int64()), pa.array(hits_out, pa.int64()),
                        pa.array(items, pa.list_(pa.int64())), pa.array(spans_out, kind),
                    ],
                    [*carry, "n_words", "n_hit", "item_ids", "spans"],
                )
            else:
                yield pa.RecordBatch.from_arrays(
                    [*kept, batch.column(n - 3), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))],
                    [*carry, "_text", "_runs", "_items"],
                )

    return run


def contamination_digest(docs: DataFrame, benchmark: DataFrame, params=DecontaminationParams()) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return contamination(docs, benchmark, params).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, params=DecontaminationParams(), text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark window."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_body"))
    return contamination(rows, benchmark, params, "_body", ("_row",)).where("n_hit = 0").select("_row.*")
