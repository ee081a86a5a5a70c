"""Removal of repeated substrings: anchors bring repeats together, external induced sorting decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import materialized, pieces, ranges, text_bytes
from corpusmill.llm.induced import Workspace, suffixes
from corpusmill.llm.text_stats import BASE, BYTE_CODES, INVERSE, mix, powers, span_hashes

#: Place of an anchor region in its document: start * REGION + number of windows.
REGION = 256


@dataclass(frozen=True)
class SuffixParams:
    """``shard_bytes`` of regions are sorted together; ``memory_items`` suffix tuples stay in memory, others
    wait on disk.  An anchor with more than ``hot_regions`` different regions is decided window by window."""

    length: int = 100
    anchor: int = 32
    shard_bytes: int = 512 << 10
    memory_items: int = 8 << 20
    hot_regions: int = 5_000


def anchor_regions(data: np.ndarray, offsets: np.ndarray, params: SuffixParams):
    """Row, start, number of windows, anchor hash and content hash of every anchor region.

    The anchor of a window of ``length`` bytes is its least-hashed substring of
    ``anchor`` bytes (the leftmost of equals), so equal windows have equal
    anchors at equal places.  A region is a maximal run of windows of a row that share an anchor.
    """
    n, k, width = len(data), params.anchor, params.length - params.anchor + 1
    empty = np.zeros(0, np.int64)
    if n < params.length:
        return empty, empty, empty, empty, empty
    up, down = powers(BASE, n), powers(INVERSE, n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[:n], out=prefix[1:])
    grams = mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1])
    shift = np.uint64(32)  # hash above, position below: the choice depends on the window alone
    low = ((grams >> shift) << shift) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: -(width - step)], low[width - step :])
    place = (low & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.arange(len(place))
    inside = rows[: len(place)] == rows[params.length - 1 :]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (rows[1 : len(place)] != rows[: len(place) - 1])
    first = starts[begin]
    number = np.cumsum(begin)[inside] - 1
    count = np.bincount(number, minlength=len(first))
    content = span_hashes(data, first, first + count + params.length - 1)
    row = rows[first]
    return row, first - offsets[row], count, grams[place[first]].view(np.int64), content.view(np.int64)


def _anchors(params: SuffixParams):
    names = ["anchor", "content", "doc_id", "copy", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            row, start, count, anchor, content = anchor_regions(*text_bytes(batch.column(2)), params)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor), pa.array(content), batch.column(0).take(take), batch.column(1).take(take),
                    pa.array(start * REGION + count),
                ],
                names,
            )

    return run


def _sorted_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one range of the order (anchor, content, doc_id, copy, place): what repeats.

    ``kind`` 0: the region's content was seen before, in this range.  1: the
    first of its content, beside other contents of the anchor.  2: the first or last
    content of the range, whose neighbours may be in the next ranges.  First
    contents with no other content beside them are dropped.
    """
    # The last first-of-its-content: anchor, row values, whether it opened the range, whether it has company.
    held, opened = None, False

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
        anchor, content = columns
        n = batch.num_rows
        same_anchor, same_content = np.zeros(n, bool), np.zeros(n, bool)
        same_anchor[1:] = anchor[1:] == anchor[:-1]
        same_content[1:] = same_anchor[1:] & (content[1:] == content[:-1])
        if held is not None:
            same_anchor[0] = held[0][0] == anchor[0]
            same_content[0] = same_anchor[0] and held[0][1] == content[0]
        fresh = np.flatnonzero(~same_content)
        kind = np.full(n, -1, np.int8)
        kind[same_content] = 0
        rows = []
        if len(fresh):
            # A first content has company if the first content before or after it has the same anchor.
            joined = same_anchor[fresh]
            after = np.append(joined[1:], False)
            company = joined | after
            if held is not None:
                if not held[1]:
                    rows.append([*held[0], 2])
                elif held[2] or joined[0]:
                    rows.append([*held[0], 1])
            for at in fresh[:-1][company[:-1]].tolist():
                kind[at] = 1
            if not opened:
                opened = True
                if len(fresh) > 1:
                    kind[fresh[0]] = 2
            last = int(fresh[-1])
            values = [c[last].as_py() for c in batch.columns]
            first_ever = held is None and len(fresh) == 1
            held = (values, not first_ever, bool(joined[-1]))
        keep = np.flatnonzero(kind >= 0)
        made = batch.take(pa.array(keep))
        settled = kind[keep] == 0  # these need their place only
        hashes = [pa.array(c[keep], pa.int64(), mask=settled) for c in columns]
        yield pa.RecordBatch.from_arrays([*hashes, *made.columns[2:], pa.array(kind[keep].astype(np.int32))], _PASSED)
        if rows:
            yield _rows(rows)
    if held is not None:
        yield _rows([[*held[0], 2]])


_PASSED = ["anchor", "content", "doc_id", "copy", "place", "kind"]


def _rows(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _PASSED)


def _cut_regions(params: SuffixParams):
    """Bytes of the wanted regions of each document."""
    names = ["anchor", "doc_id", "copy", "start", "region"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3).to_pylist()
            for part_start in range(0, batch.num_rows, 256):
                anchors, rows, starts, regions = [], [], [], []
                for row in range(part_start, min(part_start + 256, batch.num_rows)):
                    data = (batch.column(2)[row].as_py() or "").encode()
                    for one in wanted[row]:
                        start, count = divmod(one["place"], REGION)
                        anchors.append(one["anchor"])
                        rows.append(row)
                        starts.append(start)
                        regions.append(data[start : start + count + params.length - 1])
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchors, pa.int64()), batch.column(0).take(take), batch.column(1).take(take),
                        pa.array(starts, pa.int64()), pa.array(regions, pa.binary()),
                    ],
                    names,
                )

    return run


def shard_repeats(regions, keys: np.ndarray, starts: np.ndarray, params: SuffixParams, memory: int | None = None):
    """Windows of a shard that equal an earlier one of it, as (region number, first, stop) runs of windows.

    ``regions`` is a list of byte strings; ``keys`` orders their documents and
    ``starts`` are their places in them.  Their concatenation is sorted by
    induced sorting; a common prefix of ``length`` or more joins neighbours
    of the suffix array to a group, whose earliest window stays.
    """
    n = params.length
    work = Workspace(memory or params.memory_items)
    try:
        sizes = np.array([len(r) for r in regions], np.int64)
        joined = np.frombuffer(b"\xff".join(regions) + b"\xff\xff", np.uint8)
        # Bytes are moved up by one so that 0 can end the text; 0xFF does not occur in UTF-8 and separates.
        text = work.array(len(joined), np.int16)
        np.minimum(joined.astype(np.int16) + 1, 255, out=text)
        text[-1] = 0
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        repeated = work.array(len(text), bool)
        owner = work.array(len(text), np.int32)
        owner[:-1] = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        owner[-1] = len(sizes) - 1
        for positions, prefix in suffixes(text, work, n):
            row = owner[positions]
            whole = positions - begins[row] + n <= sizes[row]
            group = np.cumsum(prefix < n)
            group, positions, row = group[whole], positions[whole], row[whole]
            order = np.lexsort((positions - begins[row] + starts[row], keys[row], group))
            group, positions = group[order], positions[order]
            again = np.zeros(len(group), bool)
            again[1:] = group[1:] == group[:-1]
            repeated[positions[again]] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(repeated, np.int8), [0]])))
        first, stop = edges[::2], edges[1::2]
        row = owner[first]
        return row, first - begins[row], stop - begins[row]
    finally:
        work.close()


def _sort_shards(params: SuffixParams):
    """Rows come sorted by shard; one shard after the other is gathered and sorted."""
    names = ["doc_id", "copy", "start", "stop"]

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).sort_by([("doc_id", "ascending"), ("copy", "ascending"), ("start", "ascending")])
        ids, copies = (table.column(c).to_numpy() for c in ("doc_id", "copy"))
        starts = table.column("start").to_numpy()
        keys = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]) | (copies[1:] != copies[:-1]))])
        row, first, stop = shard_repeats(table.column("region").to_pylist(), keys, starts, params)
        own = table.select(["doc_id", "copy"]).take(pa.array(row)).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(starts[row] + first), pa.array(starts[row] + stop - 1 + params.length)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(numbers[1:] != numbers[:-1]) + 1, [len(numbers)]])
            for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if parts and numbers[at] != shard:
                    yield one(parts)
                    parts = []
                shard = numbers[at]
                parts.append(batch.slice(at, to - at))
        if parts:
            yield one(parts)

    return run


def _hot_windows(regions: DataFrame, params: SuffixParams) -> DataFrame:
    """Repeats among the regions of very common anchors: the first of equal windows is a minimum per content."""
    n = params.length
    windows = regions.select(
        "doc_id", "copy", F.posexplode(F.expr(f"sequence(1, octet_length(region) - {n - 1})")).alias("p", "q"), "start",
        "region",
    ).select(
        "doc_id", "copy", (F.col("start") + F.col("p")).alias("start"), F.expr(f"substring(region, q, {n})").alias("w")
    )
    first = windows.groupBy("w").agg(
        F.min(F.struct("doc_id", "copy", "start")).alias("least"), F.count("*").alias("n")
    ).where("n > 1").select(F.col("w").alias("_w"), "least")
    later = windows.join(first, F.col("w") == F.col("_w")).where(F.struct("doc_id", "copy", "start") > F.col("least"))
    return later.select("doc_id", "copy", "start", (F.col("start") + n).alias("stop"))


def repeated_spans(docs: DataFrame, params: SuffixParams) -> DataFrame:
    """Byte spans to remove, not merged: doc_id, copy, start, stop.  ``docs`` has doc_id, copy and text."""
    spark = docs.sparkSession
    anchors = docs.mapInArrow(_anchors(params), "anchor long, content long, doc_id long, copy int, place long")
    order = ["anchor", "content", "doc_id", "copy", "place"]
    passed = materialized(
        anchors.repartitionByRange(ranges(spark), *order).sortWithinPartitions(*order).mapInArrow(
            _sorted_pass, "anchor long, content long, doc_id long, copy int, place long, kind int"
        ),
        "regions",
    )
    # At the edges of ranges, a few rows per range: the first of a content may stand in an earlier range.
    row = F.struct("doc_id", "copy", "place")
    edge = passed.where("kind = 2")
    per_content = edge.groupBy("anchor", "content").agg(F.min(row).alias("least"))
    company = (
        per_content.select("anchor", "content")
        .unionByName(passed.where("kind = 1").select("anchor", "content"))
        .join(edge.select(F.col("anchor").alias("_a")).distinct(), F.col("anchor") == F.col("_a"))
        .groupBy("anchor").agg(F.min("content").alias("_low"), F.max("content").alias("_high"))
    )
    settled = (
        edge.join(per_content.withColumnsRenamed({"anchor": "_a", "content": "_c"}),
                  (F.col("anchor") == F.col("_a")) & (F.col("content") == F.col("_c")))
        .join(company.withColumnRenamed("anchor", "_b"), F.col("anchor") == F.col("_b"))
        .select(
            *order, F.when(row > F.col("least"), 0).when(F.col("_low") < F.col("_high"), 1).otherwise(-1).alias("kind")
        )
    )
    known = passed.where("kind < 2").unionByName(settled.where("kind >= 0"))
    place, windows = F.expr(f"place div {REGION}"), F.expr(f"place % {REGION}")
    whole = known.where("kind = 0").select(
        "doc_id", "copy", place.alias("start"), (place + windows + params.length - 1).alias("stop")
    )
    wanted = known.where("kind = 1").groupBy("doc_id", "copy").agg(
        F.collect_list(F.struct("anchor", "place")).alias("wanted")
    )
    regions = materialized(
        docs.join(wanted.withColumnsRenamed({"doc_id": "_d", "copy": "_k"}),
                  F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("copy") == F.col("_k")))
        .select("doc_id", "copy", "text", "wanted")
        .mapInArrow(_cut_regions(params), "anchor long, doc_id long, copy int, start long, region binary"),
        "texts",
    )
    hot = regions.groupBy(F.col("anchor").alias("_h")).agg(F.count("*").alias("n")).where(F.col("n") > params.hot_regions)
    size = regions.agg(F.sum(F.octet_length("region"))).first()[0] or 0
    shards = max(1, -(-size // params.shard_bytes))
    sorted_ = (
        regions.join(hot, F.col("anchor") == F.col("_h"), "left_anti")
        .withColumn("shard", F.pmod(F.xxhash64("anchor", F.lit(9)), F.lit(shards)))
        .select("shard", "doc_id", "copy", "start", "region")
        .repartition(min(shards, max(ranges(spark), shards // 64)), "shard").sortWithinPartitions("shard")
        .mapInArrow(_sort_shards(params), "doc_id long, copy int, start long, stop long")
    )
    common = _hot_windows(regions.join(hot, F.col("anchor") == F.col("_h"), "left_semi"), params)
    return whole.unionByName(sorted_).unionByName(common)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, copy, text; ``copy`` tells rows apart that share an id but not a text, else it is 0."""
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = chosen.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if ids.isEmpty():
        return chosen.select("doc_id", F.lit(0).alias("copy"), "text")
    several = chosen.join(ids.select(F.col("doc_id").alias("_d")), F.col("doc_id").eqNullSafe(F.col("_d"))).select(
        "doc_id", F.xxhash64("text").alias("_t")
    ).distinct()
    copies = several.select(
        F.col("doc_id").alias("_d"), "_t",
        F.row_number().over(Window.partitionBy("doc_id").orderBy("_t")).alias("_copy"),
    )
    return chosen.join(
        copies, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left"
    ).select("doc_id", F.coalesce("_copy", F.lit(0)).cast("int").alias("copy"), "text")


def without_repeats(
    docs: DataFrame, params: SuffixParams = SuffixParams(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every document with the bytes that an earlier ``length``-byte string repeats cut out.

    Columns: doc_id, n_bytes, spans (merged runs of removed bytes), kept
    (binary).  A byte goes if a string of ``length`` bytes that covers it also
    starts earlier: in a document of smaller id, or before it in the same one.

    Windows are gathered by anchors, which sorting by range brings together
    however common an anchor is; regions that repeat as a whole are settled
    there.  Regions that share only their anchor are cut out of the texts, dealt
    into shards by anchor and sorted with external induced sorting; the common
    prefixes of the suffix array tell which windows are equal.  Equal windows
    always have equal anchors, so nothing is lost.

    Null texts are empty; texts shorter than ``length`` stay whole; an empty
    table gives no rows.  Rows with the same id and text get the same result;
    rows with the same id and different texts count as different documents,
    in an order of their own.  Null ids come first.  Other columns are not read.
    """
    rows = _numbered(docs, key, text)
    spans = repeated_spans(rows, params).groupBy("doc_id", "copy").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans")
    ).withColumnsRenamed({"doc_id": "_d", "copy": "_k"})
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("copy") == F.col("_k")), "left")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(iter([whole]), "text", 8 << 20):
                sizes, out, kept = [], [], []
                for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    data = (body or "").encode()
                    runs = merged([(s["start"], s["stop"]) for s in found or ()])
                    at, parts = 0, []
                    for start, stop in runs:
                        parts.append(data[at:start])
                        at = stop
                    parts.append(data[at:])
                    sizes.append(len(data))
                    out.append([{"start": a, "stop": b} for a, b in runs])
                    kept.append(b"".join(parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, kind), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )

    return joined.select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    )


def repeats_digest(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return without_repeats(docs, params).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
