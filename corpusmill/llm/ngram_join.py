"""N-gram Jaccard self-join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import others_as_json, materialized, pieces, text_bytes
from corpusmill.llm.components import connected_components
from corpusmill.llm.text_stats import BASE, mix, span_hashes, words_of


@dataclass(frozen=True)
class JoinParams:
    """``recall`` is the wanted chance that a pair just at ``threshold`` shares a band.

    ``block_grams`` and ``block_rows`` bound what one comparison task holds.
    """

    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9995
    max_hashes: int = 128
    block_grams: int = 1_000_000
    block_rows: int = 2048


def banding(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """Bands and rows per band: most rows (fewest false candidates) that reach the recall within the hashes."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word n-grams of every row, and where each row's begin.

    Words are runs of bytes other than white space, with A-Z lower-cased.  A text of fewer than ``n`` words has
    one gram, all its words; a text without words has none.
    """
    data = _LOWER[data]
    starts, ends, first = words_of(data, offsets)
    hashes = span_hashes(data, starts, ends)
    count = np.diff(first)
    rows = np.repeat(np.arange(len(count)), count)
    size = np.minimum(count, n)[rows]
    place = np.arange(len(hashes)) - first[:-1][rows]
    key = np.zeros(len(hashes), np.uint64)
    for j in range(n):
        later = np.zeros(len(hashes), np.uint64)
        later[: len(hashes) - j] = hashes[j:] if j else hashes
        key = key * BASE + np.where(j < size, later, np.uint64(0))
    key = mix(key)
    use = place <= count[rows] - size
    key, rows = key[use], rows[use]
    order = np.lexsort((key, rows))
    key, rows = key[order], rows[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])
    return key[new], np.searchsorted(rows[new], np.arange(len(count) + 1))


def signatures(keys: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (one row per text that has grams) from ``bands * rows`` minimum hashes."""
    draw = np.random.default_rng(5)
    factors = draw.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    at = first[:-1]
    out = np.zeros((len(at), bands), np.uint64)
    scratch = np.empty_like(keys)
    for k in range(bands * rows):
        np.multiply(keys, factors[k], out=scratch)
        np.right_shift(scratch, np.uint64(32), out=scratch)
        band = k // rows
        out[:, band] = out[:, band] * BASE + np.minimum.reduceat(scratch, at) + np.uint64(1)
    return mix(out ^ (np.arange(bands, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)))


def set_ids(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes per text that depend on its set of grams alone."""
    a = np.add.reduceat(mix(keys.copy()), first[:-1])
    b = np.add.reduceat(mix(keys * BASE + np.uint64(3)), first[:-1])
    return np.column_stack([a, b]).astype(">u8")


def _binary16(values: np.ndarray, filled: np.ndarray) -> pa.Array:
    ids = iter(values)
    return pa.array([next(ids).tobytes() if f else None for f in filled], pa.binary())


def _sketches(params: JoinParams):
    bands, rows = banding(params.threshold, params.recall, params.max_hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            keys, first = gram_sets(*text_bytes(batch.column(1)), params.n)
            filled = np.diff(first) > 0
            own = np.append(first[:-1][filled], len(keys))
            if len(keys):
                sids, sketch = set_ids(keys, own), signatures(keys, own, bands, rows).astype(np.int64)
            else:
                sids, sketch = np.zeros((0, 2), ">u8"), np.zeros((0, bands), np.int64)
            ends = np.concatenate([[0], np.cumsum(filled * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(np.diff(first).astype(np.int64)),
                    _binary16(sids, filled), pa.ListArray.from_arrays(pa.array(ends), pa.array(sketch.ravel())),
                ],
                ["doc_id", "text_hash", "n_grams", "sid", "bands"],
            )

    return run


def _compare(params: JoinParams):
    """Compare the rows of one task; every row says whether its block is the left or the right one."""

    def run(table: pa.Table) -> pa.Table:
        left, seen, unique = table.column("side").to_numpy(), set(), []
        for row, (sid, side) in enumerate(zip(table.column("sid").to_pylist(), left.tolist())):
            if (sid, side) not in seen:
                seen.add((sid, side))
                unique.append(row)
        table = table.take(pa.array(unique, pa.int64()))
        left = table.column("side").to_numpy()
        sids, copies = table.column("sid").to_pylist(), table.column("copies").to_numpy()
        # One list of grams per row, one number per distinct gram.
        parts, sizes = [], []
        for part in pieces(iter(table.select(["text"]).to_batches()), "text"):
            keys, first = gram_sets(*text_bytes(part.column(0)), params.n)
            parts.append(keys)
            sizes.append(np.diff(first))
        keys, sizes = np.concatenate(parts), np.concatenate(sizes)
        distinct, ids = np.unique(keys, return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        several = j >= 0 and i != j
        flag = np.zeros(len(distinct), bool)
        by_band: dict[int, list[int]] = {}
        for row, own in enumerate(bands.tolist()):
            for band in own:
                by_band.setdefault(band, []).append(row)
        links, texts, root = np.zeros(len(sids), np.int64), np.zeros(len(sids), np.int64), list(range(len(sids)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        arrays = {band: np.array(rows) for band, rows in by_band.items() if len(rows) > 1}
        for row, own in enumerate(bands.tolist()):
            near = [arrays[band] for band in own if band in arrays]
            if not near:
                continue
            other = np.unique(np.concatenate(near))
            other = other[other > row]
            if several:
                other = other[left[other] != left[row]]
            # Sets of too different sizes cannot be similar enough.
            small, large = np.minimum(sizes[other], sizes[row]), np.maximum(sizes[other], sizes[row])
            other = other[small >= params.threshold * large]
            if not len(other):
                continue
            mine = ids[ends[row] : ends[row + 1]]
            flag[mine] = True
            at = np.concatenate([[0], np.cumsum(sizes[other])])
            spots = np.repeat(ends[other] - at[:-1], sizes[other]) + np.arange(at[-1])
            common = np.add.reduceat(flag[ids[spots]].astype(np.int64), at[:-1])
            flag[mine] = False
            linked = other[common >= params.threshold * (sizes[other] + sizes[row] - common) - 1e-9]
            if len(linked):
                links[row] += copies[linked].sum()
                links[linked] += copies[row]
                texts[row] += len(linked)
                texts[linked] += 1
                for x in linked.tolist():
                    a, b = top(row), top(x)
                    root[max(a, b)] = min(a, b)
        hit = np.flatnonzero(texts)
        return pa.table(
            {
                "sid": pa.array([sids[r] for r in hit], pa.binary()),
                "root": pa.array([sids[top(r)] for r in hit.tolist()], pa.binary()),
                "linked_texts": pa.array(texts[hit]), "linked_docs": pa.array(links[hit]),
            }
        )

    return run


@dataclass(frozen=True)
class JoinResult:
    """``rows``: doc_id, text_hash, n_grams, sid of every document.  ``classes``: sid, set_id, copies, linked_texts,
    linked_docs, root of every distinct gram set."""

    rows: DataFrame
    classes: DataFrame


def ngram_jaccard_join(
    docs: DataFrame, params: JoinParams = JoinParams(), key: str = "doc_id", text: str = "text"
) -> JoinResult:
    """All links between documents whose sets of word n-grams have a Jaccard similarity of ``threshold`` or more.

    Documents with equal sets are one class, so copies are never paired.  The
    band hashes of the classes are shuffled; buckets with two or more classes
    tie them into candidate groups (by components of star edges, never all
    pairs).  The texts of candidate classes go once to their group's task; small
    groups share tasks, a large group is cut into blocks and each pair of
    blocks is a task.  A task verifies the pairs that share a band on their full
    sets and returns counts and tree edges per class, not pairs.  Rows without
    words (null, empty) have no grams: no class and no links.  Repeated rows are
    copies.  Only ``key`` and ``text`` are read.
    """
    bands, _ = banding(params.threshold, params.recall, params.max_hashes)
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = chosen.withColumn("text_hash", F.xxhash64("text"))
    rows = materialized(
        sketched.mapInArrow(
            _sketches(params), "doc_id long, text_hash long, n_grams long, sid binary, bands array<long>"
        ),
        "sketches",
    )
    classes = materialized(
        rows.where("sid is not null").groupBy("sid").agg(
            F.min("doc_id").alias("set_id"), F.count("*").alias("copies"), F.max("n_grams").alias("n_grams"),
            F.first("bands").alias("bands"), F.min(F.struct("doc_id", "text_hash")).alias("source_row"),
        ),
        "classes",
    )
    banded = classes.select("sid", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("sid").alias("first")).where("n > 1")
    stars = banded.join(shared, "band").where("sid <> first").select("sid", "first").distinct()
    groups = connected_components(stars, "sid", "first")
    grouped = classes.join(groups, F.col("sid") == F.col("node")).select(
        "sid", "root", "n_grams", "copies", "bands", "source_row"
    )
    sizes = grouped.groupBy(F.col("root").alias("_root")).agg(
        F.sum("n_grams").alias("grams"), F.count("*").alias("members")
    ).withColumn(
        "cuts",
        F.greatest(F.ceil(F.col("grams") / params.block_grams), F.ceil(F.col("members") / params.block_rows)).cast("int"),
    )
    whole = sizes.where("cuts = 1").agg(F.sum("grams"), F.sum("members")).first()
    buckets = max(1, -(-int(whole[0] or 0) // params.block_grams), -(-int(whole[1] or 0) // params.block_rows))
    cuts, block = F.col("cuts"), F.pmod(F.xxhash64("sid", F.lit(3)), F.col("cuts")).cast("int")
    # Where a class is needed: its group's shared task, or each pair of blocks that holds its block.
    tasks = F.when(
        cuts == 1,
        F.array(F.struct(
            F.lit(None).cast("binary").alias("root"), F.pmod(F.xxhash64("root"), F.lit(buckets)).cast("int").alias("i"),
            F.lit(-1).alias("j"), F.lit(0).alias("side"),
        )),
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), cuts - 1),
            lambda o: F.struct(
                F.col("root").alias("root"), F.least(o, block).alias("i"), F.greatest(o, block).alias("j"),
                (block > o).cast("int").alias("side"),
            ),
        )
    )
    placed = grouped.join(sizes, F.col("root") == F.col("_root")).select(
        "sid", "copies", "bands", "source_row", tasks.alias("tasks")
    )
    texts = sketched.alias("d").join(
        placed.alias("p"),
        F.col("d.doc_id").eqNullSafe(F.col("p.source_row.doc_id")) & (F.col("d.text_hash") == F.col("p.source_row.text_hash")),
    ).select("p.sid", "p.copies", "p.bands", "d.text", F.explode("p.tasks").alias("t"))
    compared = materialized(
        texts.select("sid", "copies", "bands", "text", "t.root", "t.i", "t.j", "t.side")
        .groupBy("root", "i", "j")
        .applyInArrow(_compare(params), "sid binary, root binary, linked_texts long, linked_docs long"),
        "links",
    )
    links = compared.groupBy("sid").agg(
        F.sum("linked_texts").alias("linked_texts"), F.sum("linked_docs").alias("linked_docs")
    )
    joined = connected_components(compared, "sid", "root")
    result = (
        classes.select("sid", "set_id", "copies")
        .join(links, "sid", "left")
        .join(joined.select(F.col("node").alias("sid"), "root"), "sid", "left")
        .select(
            "sid", "set_id", "copies", F.coalesce("linked_texts", F.lit(0)).alias("linked_texts"),
            F.coalesce("linked_docs", F.lit(0)).alias("linked_docs"), F.coalesce("root", "sid").alias("root"),
        )
    )
    return JoinResult(rows.drop("bands"), materialized(result, "classes"))


def similar_documents(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """One row per document: ``class_id`` (smallest doc_id of all that links connect), ``set_id`` (smallest with
    equal grams), ``n_copies`` and ``n_links``: how many other documents are similar to it, copies counted."""
    found = ngram_jaccard_join(docs, params)
    ids = found.classes.groupBy(F.col("root").alias("_root")).agg(F.min("set_id").alias("class_id"))
    classes = found.classes.join(ids, F.col("root") == F.col("_root")).select(
        F.col("sid").alias("_sid"), "class_id", "set_id", "copies", "linked_docs"
    )
    return found.rows.join(classes, F.col("sid") == F.col("_sid"), "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("set_id", "doc_id").alias("set_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.coalesce(F.col("copies") - 1 + F.col("linked_docs"), F.lit(0)).alias("n_links"), "n_grams",
    )


def one_of_each(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """The rows of ``docs``, with all columns, that are the first (by doc_id) of what links connect.

    Of rows that share the least id and its text, the one whose other columns
    come first as JSON stays, so a rerun keeps the same row.  Rows without words
    (null and empty texts) all stay, repeated or not.  Null ids come before
    others.  Texts of any length are compared whole.  An empty table
    gives no rows.  A row travels as one struct, so its columns may have any
    names and come back unchanged.
    """
    found = ngram_jaccard_join(docs, params)
    placed = found.rows.join(found.classes.select(F.col("sid").alias("_sid"), "root"), F.col("sid") == F.col("_sid"), "left")
    kept = placed.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select(
        F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash")
    )
    bare = placed.where("root is null").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row.doc_id").cast("long").alias("own_id"), F.xxhash64("row.text").alias("own_hash"),
        others_as_json(docs, "row").alias("others"),
    )
    match = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash"))
    first = rows.join(kept, match).groupBy("own_id", "own_hash").agg(F.min_by("row", "others").alias("row"))
    return first.select("row.*").unionByName(rows.join(bare, match).select("row.*"))
