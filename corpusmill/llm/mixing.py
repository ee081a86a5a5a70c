"""Mix sources to target weights in fixed-length blocks of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.llm.common import materialized, others_as_json, pieces, ranges, running_totals, word_count
from corpusmill.llm.feistel import permuted


@dataclass(frozen=True)
class MixParams:
    """``weights`` repeat over the sources in code-point order (null last).

    Sizes, targets and totals of the sources, one row each, are held by the driver and by each task: more than
    ``max_sources`` are refused.  ``draw_rows`` slots are drawn at a time.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share_percent: int = 150
    max_passes: int = 2
    block: int = 64
    slots_per_shard: int = 4096
    key: int = 77
    max_sources: int = 100_000
    draw_rows: int = 1 << 18


def targets(sizes: list[int], params: MixParams) -> list[float]:
    """Words of each source in the mix: by weight, at most ``max_passes`` times its size, the excess reshared."""
    weights = [params.weights[i % len(params.weights)] for i in range(len(sizes))]
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), sum(sizes) * params.share_percent / 100
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > params.max_passes * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(params.max_passes * sizes[i])
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _totals(sizes: list[int], goals: list[float], params: MixParams) -> list[int]:
    """Blocks that the mix takes of each source.

    ``goal * blocks / size`` of them hold ``goal`` words on average, also where the last block is short; the
    fraction is one more block or none, by a draw of the source's own.
    """
    out = []
    for no, (size, goal) in enumerate(zip(sizes, goals)):
        blocks = -(-size // params.block)
        wanted = goal * blocks / size if size else 0.0
        draw = np.random.default_rng([params.key, no]).random()
        out.append(min(int(wanted) + (draw < wanted % 1), params.max_passes * blocks))
    return out


def _shard_counts(spark, totals: list[int], params: MixParams) -> DataFrame:
    """Columns shard, source_no, n: what each output shard draws from each source.

    Every shard's counts are a multinomial draw, conditional on the settled
    totals: all slots of the mix, those of a source next to each other, go through one keyed
    permutation of their numbers, and a shard takes the slots that land in its
    part.  The slots are counted range by range, so no task sees all of them.
    """
    slots, ends = sum(totals), np.cumsum(np.array(totals, np.int64))
    shards = max(1, -(-slots // params.slots_per_shard))
    size, wider = slots // shards, slots % shards  # the first ``wider`` shards hold one slot more
    step = params.draw_rows

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                k = np.arange(number * step, min((number + 1) * step, slots))
                place = permuted(k, slots, params.key)
                late = place - wider * (size + 1)
                shard = np.where(late < 0, place // (size + 1), wider + late // max(size, 1))
                source = np.searchsorted(ends, k, "right")
                pair, n = np.unique(np.stack([source, shard]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[1]), pa.array(pair[0].astype(np.int32)), pa.array(n)], ["shard", "source_no", "n"]
                )

    numbers = -(-slots // step)
    parts = spark.range(0, numbers, 1, max(1, min(numbers, 4 * ranges(spark)))).mapInArrow(
        draw, "shard long, source_no int, n long"
    )
    return materialized(parts.groupBy("shard", "source_no").agg(F.sum("n").alias("n")), "draws")


@dataclass(frozen=True)
class Mix:
    """``sources``: source, source_no, source_size, target.  ``rows``: the documents with their place in the
    word stream of their source.  ``fragments``: which words of a document lie in which block.  ``slots``: shard,
    slot, source_no, block, pass of the mix."""

    sources: DataFrame
    rows: DataFrame
    fragments: DataFrame
    slots: DataFrame


def plan_mix(
    docs: DataFrame, params: MixParams = MixParams(), key: str = "doc_id", source: str = "source", text: str = "text",
    carry: tuple[str, ...] = (),
) -> Mix:
    """Pack every source into blocks of ``block`` words and decide which blocks the mix takes.

    The words of a source, in key order, form one stream; running sums give
    each document its place in it without gathering a source.  How many blocks
    the mix takes of a source is settled first, at most ``max_passes`` full
    passes, and dealt to the output shards; the ``k``-th block that the mix
    takes from a source with ``m`` blocks is number ``permutation(k mod m)``, in
    pass ``k div m``, so no word is taken more often.  Only one row per source
    reaches the driver.  Null texts have no words; a source of
    size 0 has target 0; an empty table gives an empty mix.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(text).alias("text_hash"), *carry,
    )
    rows = materialized(running_totals(sized, ["doc_id", "size", "text_hash"], {"before": "size"}, "source"), "stream")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(params.max_sources + 1).collect()
    if len(per_source) > params.max_sources:
        raise ValueError(f"more than {params.max_sources} sources: raise max_sources or group them")
    per_source = sorted(((r["source"], r["size"]) for r in per_source), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [size for _, size in per_source]
    goals = targets(sizes, params)
    blocks = [-(-size // params.block) for size in sizes]
    sources = spark.createDataFrame(
        [(name, i, int(size), float(goals[i])) for i, (name, size) in enumerate(per_source)],
        f"source {sized.schema['source'].dataType.simpleString()}, source_no int, source_size long, target double",
    )
    rows = rows.join(
        sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    b = params.block
    spread = rows.where("size > 0").select(
        "source_no", "doc_id", "before", "size",
        F.explode(F.expr(f"sequence(before div {b}, (before + size - 1) div {b})")).alias("block"),
    )
    fragments = spread.select(
        "source_no", "block", "doc_id", "before", "size",
        F.greatest(F.lit(0).cast("long"), F.col("block") * b - F.col("before")).alias("first"),
        F.least(F.col("size"), (F.col("block") + 1) * b - F.col("before")).alias("stop"),
    )
    counts = _shard_counts(spark, _totals(sizes, goals, params), params)
    drawn = running_totals(counts, ["shard"], {"start": "n"}, "source_no")
    place = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("ahead", F.coalesce(F.sum("n").over(place), F.lit(0))).withColumn(
        "in_shard", F.sum("n").over(Window.partitionBy("shard"))
    )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, no, n, start, ahead, size in zip(*(c.to_pylist() for c in batch.columns)):
                k = np.arange(start, start + n)
                spots = np.arange(ahead, ahead + len(k))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(k), shard)), pa.array(permuted(spots, size, params.key + 13 * shard + 1)),
                        pa.array(np.full(len(k), no, np.int32)),
                        pa.array(permuted(k % max(blocks[no], 1), blocks[no], params.key * 1009 + no)),
                        pa.array((k // max(blocks[no], 1)).astype(np.int32)),
                    ],
                    ["shard", "slot", "source_no", "block", "pass"],
                )

    # The counts are few rows that grow to many: deal them out first.
    slots = drawn.select("shard", "source_no", "n", "start", "ahead", "in_shard").repartition(
        ranges(spark), "shard", "source_no"
    ).mapInArrow(
        choose, "shard long, slot long, source_no int, block long, pass int"
    )
    # Spark takes them for as small as the counts that they grow from: no join may broadcast them.
    return Mix(sources, rows, fragments, slots.hint("merge"))


def taken_words(mix: Mix) -> DataFrame:
    """The documents of the mix with ``taken``: how many of their words it holds, repeats counted."""
    uses = mix.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
    taken = (
        mix.fragments.join(uses, ["source_no", "block"])
        .groupBy("source_no", "before", "doc_id", "size")
        .agg(F.sum((F.col("stop") - F.col("first")) * F.col("uses")).alias("taken"))
    )
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("source_no", "before", "doc_id", "size")]
    return mix.rows.alias("r").join(taken.alias("t"), [F.col("r.before") == F.col("t.before"), *same], "left").select(
        "r.*", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken")
    )


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words of each range with the white space between them; ranges are joined by a blank."""
    starts = [m.span() for m in _WORD.finditer(text)]
    return " ".join(text[starts[a][0] : starts[b - 1][1]] for a, b in ranges)


def mixed_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mix as documents: one row per document and pass that takes words of it, with all columns of ``docs``.

    ``text`` holds the words that the pass takes, in order; ``n_chars`` follows
    it where the table has that column.  Documents of which nothing is taken,
    null and empty texts among them, are left out; one in two passes comes twice.
    Rows that share source, id and text are told apart by their other columns as JSON
    and by nothing else, as their words are the same.  Null ids and sources are
    values like others.  An empty table gives no rows.  A row travels as one
    struct, so its columns may have any names.
    """
    mix = plan_mix(docs, params)
    parts = (
        mix.fragments.join(mix.slots.select("source_no", "block", "pass"), ["source_no", "block"])
        .groupBy("source_no", "before", "doc_id", "size", "pass")
        .agg(F.sort_array(F.collect_list(F.struct("first", "stop"))).alias("ranges"))
    )
    # Rows of one source that share id and text stand side by side in its stream: number both sides alike.
    twin = Window.partitionBy("source", "doc_id", "text_hash").orderBy("before")
    places = mix.rows.where("size > 0").withColumn("copy", F.row_number().over(twin)).select(
        "source_no", "source", "before", "doc_id", "size", "text_hash", "copy"
    )
    chosen = parts.alias("p").join(
        places.alias("q"),
        [F.col("p.before") == F.col("q.before"), F.col("p.source_no") == F.col("q.source_no"),
         F.col("p.size") == F.col("q.size"), F.col("p.doc_id").eqNullSafe(F.col("q.doc_id"))],
    ).select("q.source", "q.doc_id", "q.text_hash", "q.copy", "p.ranges")
    own = Window.partitionBy("own_source", "own_id", "own_hash").orderBy("others")
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row.source").alias("own_source"), F.col("row.doc_id").cast("long").alias("own_id"),
        F.xxhash64("row.text").alias("own_hash"), others_as_json(docs, "row").alias("others"),
    )
    rows = rows.withColumn("own_copy", F.row_number().over(own)).drop("others")
    joined = rows.join(
        chosen,
        [F.col("own_source").eqNullSafe(F.col("source")), F.col("own_id").eqNullSafe(F.col("doc_id")),
         F.col("own_hash") == F.col("text_hash"), F.col("own_copy") == F.col("copy")],
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = [
                cut_words(text, _joined([(r["first"], r["stop"]) for r in ranges]))
                for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    bare = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    carried = joined.select((F.struct(*bare) if bare else F.struct(F.lit(0))).alias("row"), "row.text", "ranges")
    kinds = StructType([carried.schema["row"], docs.schema["text"]])
    out = carried.mapInArrow(cut, kinds)
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    made = {"text": F.col("text"), "n_chars": length}
    return out.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring ranges become one."""
    out: list[tuple[int, int]] = []
    for first, stop in ranges:
        if out and out[-1][1] == first:
            out[-1] = (out[-1][0], stop)
        else:
            out.append((first, stop))
    return out
