"""Cheapest repair of a conversation's turn order, ties settled by ranked paths.

Every row of a conversation is kept, given another role, or deleted, and empty
rows may be inserted, so that the roles read ``(s?(ua)+)?``.  The states of that
pattern and the rows span a graph whose paths are the possible repairs:

* a dynamic programme gives the cost from every node to the end;
* the arcs that lie on cheapest paths remain, each with its edit's initial;
* prefix doubling ranks the nodes by their least audits of 1, 2, 4, ... letters,
  and the ranks pick the arc of each node; the pointers are doubled alongside,
  so that the t-th edit of a path is found by the binary digits of t.

A conversation is cut into blocks of rows.  A block acts on the costs at its
right end as a min-plus matrix, and on the state at its left end as a map of
states, so what enters a block from either side is a product over the others,
which ``_swept`` forms in a tree.  No task holds more than one block of a
conversation, however long it is; a conversation of one block needs no products.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialized, running_totals

#: States: nothing yet, after the system row, after a user row, after an assistant row.
NONE, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "suax"
#: Rows of one block are one text: the role's initial (``x``: any other), as a capital letter
#: for a truncated row, as a digit for a row that has to go.
CODES = {c: (kind, i) for kind, row in enumerate(("suax", "SUAX", "0123")) for i, c in enumerate(row)}
KEEP_TO = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: The state after the user or assistant row that the pattern wants next.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: What the end costs in each state: the rows still to be inserted.
CLOSE = np.array([0, 10, 5, 0], np.int64)
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
FAR = np.int64(1) << 40
LETTERS = np.array(list("DIKR"))
ROLES = np.array(list("-sua"))
BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class RepairParams:
    block_rows: int = 256
    fan_in: int = 256


# -- the graph of one batch of blocks ------------------------------------------------------------


def _cells(codes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds and initials of the rows of each block, one line per block, and the rows of each."""
    sizes = np.array([len(c) for c in codes], np.int64)
    table = np.zeros((128, 2), np.int64)
    for c, (kind, initial) in CODES.items():
        table[ord(c)] = kind, initial
    filled = np.frombuffer("".join(c.ljust(sizes.max(initial=0), "s") for c in codes).encode(), np.uint8)
    both = table[filled.reshape(len(codes), -1)]
    return both[..., 0], both[..., 1], sizes


def _row_costs(kind: np.ndarray, initial: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost through each edit that uses up the row, per state: delete, keep, rerole."""
    fixed = np.where(kind == 2, FAR, TRUNCATED * (kind == 1))[:, None]
    target = KEEP_TO[:, initial].T
    keep = np.where(target < 0, FAR, np.take_along_axis(after, np.maximum(target, 0), 1)) + fixed
    return after + DELETE, keep, after[:, NEXT] + REROLE + fixed


def _inserted(costs: np.ndarray) -> np.ndarray:
    """Costs of a position's nodes with insertions; two in a row are enough, as three come back to a state."""
    for _ in range(2):
        costs = np.minimum(costs, costs[:, NEXT] + INSERT)
    return costs


def _costs(kind: np.ndarray, initial: np.ndarray, sizes: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cost from every node (block, position, state) to the end, given the costs at the blocks' right ends."""
    length = kind.shape[1]
    out = np.empty((len(sizes), length + 1, 4), np.int64)
    out[:, length] = right
    for at in range(length - 1, -1, -1):
        through = np.minimum.reduce(_row_costs(kind[:, at], initial[:, at], out[:, at + 1]))
        out[:, at] = np.where((at < sizes)[:, None], _inserted(through), right)
    return np.minimum(out, FAR)


def _arcs(kind, initial, sizes, last, costs):
    """Targets of the optimal arcs of every node, in the order of LETTERS; -1 where there is none.

    The right end of a block that is not the last one of its conversation has
    no arcs, and neither have positions beyond a block's end.
    """
    n, width, _ = costs.shape
    node = np.arange(n * width * 4).reshape(n, width, 4)
    arcs = np.full((n, width, 4, 4), -1, np.int64)
    at_end = np.arange(width)[None, :] == sizes[:, None]
    may_insert = (np.arange(width)[None, :] < sizes[:, None]) | (at_end & last[:, None])
    here = node - np.arange(4)
    insert = (costs[:, :, NEXT] + INSERT == costs) & may_insert[..., None]
    arcs[..., 1] = np.where(insert, here + NEXT, -1)
    for at in range(width - 1):
        inside = (at < sizes)[:, None]
        beyond = here[:, at + 1]
        target = KEEP_TO[:, initial[:, at]].T
        through = _row_costs(kind[:, at], initial[:, at], costs[:, at + 1])
        for letter, cost, state in zip((0, 2, 3), through, (np.arange(4)[None], target, NEXT[None]), strict=True):
            arcs[:, at, :, letter] = np.where(inside & (cost == costs[:, at]) & (cost < FAR), beyond + state, -1)
    return arcs.reshape(-1, 4)


def _ranked(arcs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The letter of the arc that each node's least audit takes, its doubled pointers, and the audit's length.

    Nodes without an arc point to themselves and rank before all letters, as a
    text that has ended does.  Letters tell the arcs of a node apart, so a first
    ranking by them is right for one letter; each round ranks the pairs of a
    node's rank and the rank of the node that many letters on.
    """
    nodes = np.arange(len(arcs))
    has = arcs >= 0
    ends = ~has.any(1)

    def pointers(weight: np.ndarray) -> np.ndarray:
        """Target of each node's least arc by letter, then by the rank of its target."""
        key = np.where(has, np.arange(4) * (len(arcs) + 1) + weight[np.maximum(arcs, 0)], np.iinfo(np.int64).max)
        return key.argmin(1)

    letter = pointers(np.zeros(len(arcs), np.int64))
    jump = np.where(ends, nodes, arcs[nodes, letter])
    rank, span = np.where(ends, 0, letter + 1), 1
    while not ends[jump].all():
        rank = np.unique(rank * (len(arcs) + 1) + rank[jump], return_inverse=True)[1].reshape(-1)
        jump, span = jump[jump], span * 2
    letter = pointers(rank)
    step = np.where(ends, nodes, arcs[nodes, letter])
    doubled, length = [step], (~ends).astype(np.int64)
    while not ends[doubled[-1]].all():
        length = length + length[doubled[-1]]
        doubled.append(doubled[-1][doubled[-1]])
    length = length + np.where(ends[doubled[-1]], 0, length[doubled[-1]])
    return letter, doubled, length


def _batched(codes: list[str], limit: int = 1 << 18) -> Iterator[np.ndarray]:
    """Numbers of blocks in groups of similar size and bounded area."""
    order = np.argsort([len(c) for c in codes], kind="stable")
    start = 0
    for stop in range(1, len(order) + 1):
        if stop == len(order) or (stop + 1 - start) * (len(codes[order[stop]]) + 1) > limit:
            yield order[start:stop]
            start = stop


def _matrices(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Per block the costs from each state at its left end to each state at its right end."""
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        out = np.zeros((len(codes), 4, 4), np.int64)
        for chosen in _batched(codes):
            kind, initial, sizes = _cells([codes[i] for i in chosen])
            for state in range(4):
                right = np.full((len(chosen), 4), FAR)
                right[:, state] = 0
                out[chosen, :, state] = _costs(kind, initial, sizes, right)[:, 0]
        yield _with(batch, keys, {"m": _lists(out.reshape(len(codes), 16))})


def _paths(batches: Iterator[pa.RecordBatch], keys: list[str], only_maps: bool) -> Iterator[pa.RecordBatch]:
    """Per block its map of states, or one row per edit from the state that enters it."""
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        right = np.array(batch.column("right").to_pylist(), np.int64).reshape(-1, 4)
        last = np.array(batch.column("last").to_pylist(), bool)
        maps = np.full((len(codes), 4, 4), FAR)
        enter = None if only_maps else np.array(batch.column("enter").to_pylist(), np.int64).reshape(-1, 4).argmin(1)
        for chosen in _batched(codes):
            kind, initial, sizes = _cells([codes[i] for i in chosen])
            costs = _costs(kind, initial, sizes, right[chosen])
            letter, doubled, length = _ranked(_arcs(kind, initial, sizes, last[chosen], costs))
            width = costs.shape[1]
            first = np.arange(len(chosen)) * width * 4
            if only_maps:
                for state in range(4):
                    maps[chosen, state, doubled[-1][first + state] % 4] = 0
                continue
            start = first + enter[chosen]
            total = length[start]
            block = np.repeat(np.arange(len(chosen)), total)
            step = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            node = start[block]
            for bit, pointer in enumerate(doubled):
                node = np.where(step >> bit & 1, pointer[node], node)
            edit, after = letter[node], doubled[0][node] % 4
            row = (node // 4) % width
            rows = {
                "step": pa.array(step), "edit": pa.array(LETTERS[edit], pa.string()),
                "initial": pa.array(np.where(edit == 0, ROLES[0], ROLES[after]), pa.string()),
                "offset": pa.array(row, mask=edit == 1),
                "to_go": pa.array(costs.reshape(-1)[start[block]]),
            }
            yield _with(batch, keys, rows, pa.array(chosen[block]))
        if only_maps:
            yield _with(batch, keys, {"m": _lists(maps.reshape(len(codes), 16))})


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1)))


def _with(batch: pa.RecordBatch, keys: list[str], more: dict[str, pa.Array], rows: pa.Array | None = None) -> pa.RecordBatch:
    kept = [batch.column(k) if rows is None else batch.column(k).take(rows) for k in keys]
    return pa.RecordBatch.from_arrays([*kept, *more.values()], names=[*keys, *more])


# -- products over the blocks of a conversation --------------------------------------------------


def _product(matrices: list[list[int]]) -> np.ndarray:
    out = np.array(matrices[0], np.int64).reshape(4, 4)
    for m in matrices[1:]:
        out = np.minimum((out[:, :, None] + np.array(m, np.int64).reshape(4, 4)[None]).min(1), FAR)
    return out


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_product([x["m"] for x in xs]).reshape(16) for xs in batch.column("items").to_pylist()]
        yield _with(batch, ["conv_id", "i"], {"m": _lists(np.array(out, np.int64).reshape(-1, 16))})


def _handed(batches: Iterator[pa.RecordBatch], forward: bool) -> Iterator[pa.RecordBatch]:
    """What reaches each item of a group, from what reaches the group."""
    for batch in batches:
        rows, numbers, vectors = [], [], []
        for row, (items, v) in enumerate(zip(batch.column("items").to_pylist(), batch.column("v").to_pylist(), strict=True)):
            vector = np.array(v, np.int64)
            for item in items if forward else reversed(items):
                rows.append(row)
                numbers.append(item["i"])
                vectors.append(vector)
                m = np.array(item["m"], np.int64).reshape(4, 4)
                vector = np.minimum(((vector[:, None] + m) if forward else (m + vector[None]).T).min(0), FAR)
        if rows:
            yield _with(
                batch, ["conv_id"], {"i": pa.array(numbers, pa.int64()), "v": _lists(np.array(vectors))}, pa.array(rows)
            )


def _swept(items: DataFrame, seed: np.ndarray, forward: bool, fan_in: int) -> DataFrame:
    """(conv_id, i, v): ``seed`` through all items of the conversation before (after) item ``i``."""
    kind = items.schema["conv_id"].dataType.simpleString()
    if (items.agg(F.max("i")).first()[0] or 0) == 0:
        return items.select("conv_id", "i", F.array(*[F.lit(int(x)) for x in seed]).alias("v"))
    groups = (
        items.groupBy("conv_id", F.expr(f"i div {int(fan_in)}").alias("g"))
        .agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("items"))
    )
    parents = materialized(
        groups.select("conv_id", F.col("g").alias("i"), "items").mapInArrow(
            _products, f"conv_id {kind}, i long, m array<long>"
        ),
        "repair-products",
    )
    above = _swept(parents, seed, forward, fan_in).select(
        F.col("conv_id").alias("_c"), F.col("i").alias("_g"), "v"
    )
    met = groups.join(above, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("g") == F.col("_g")))
    return met.select("conv_id", "items", "v").mapInArrow(
        lambda b: _handed(b, forward), f"conv_id {kind}, i long, v array<long>"
    )


# -- tables --------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` (conv_id, turn, role, text) after the damage of the contract.

    The unsigned CRC-32 of ``conv_id:turn``, modulo 20, decides: 0 drops a row,
    1 empties its text, 2 removes ``.``, ``!`` and ``?`` from it, 3 repeats the
    row, 4 makes it a user row.  A null id or turn counts as one space there; null
    roles and texts become one space.
    """
    space = F.lit(" ")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(F.concat(
            F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
            F.coalesce(F.col("turn").cast("string"), space),
        )) % 20).alias("_hit"),
    )
    hit = F.col("_hit")
    return rows.where(hit != 0).select(
        "conv_id", "turn", F.when(hit == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def judged(rows: DataFrame) -> DataFrame:
    """Rows in order (``position`` from 0 in each conversation) with their first fault.

    Order: turn (nulls first), role, text; rows equal in all of them are
    interchangeable.  ``fault`` is ``blank``, ``duplicate``, ``truncated`` or null.
    The first of equal rows is found by an aggregate that combines before the
    shuffle, so a row that a conversation repeats any number of times is no
    hot spot.
    """
    facts = rows.select(
        "conv_id", "turn", "role", "text", F.col("turn").isNotNull().alias("_turned"), F.lit(1).cast("long").alias("_one"),
        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("_content"),
        F.rtrim("text", F.lit(BLANK)).alias("_end"),
    )
    facts = facts.withColumn("_blank", F.ltrim("_end", F.lit(BLANK)) == "").withColumn("_end", F.right("_end", F.lit(1)))
    placed = materialized(
        running_totals(facts, ["_turned", "turn", "role", "text"], {"position": "_one"}, group="conv_id"), "repair-rows"
    )
    first = placed.groupBy(F.col("conv_id").alias("_c"), F.col("_content").alias("_k")).agg(F.min("position").alias("_first"))
    met = placed.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_content") == F.col("_k")))
    return met.select(
        "conv_id", "position", "turn", "role", "text",
        F.when(F.col("_blank"), "blank").when(F.col("position") > F.col("_first"), "duplicate")
        .when(~F.col("_end").isin(".", "!", "?"), "truncated").alias("fault"),
    )


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row per block: its code text, whether it is the conversation's last, and its illegal neighbours.

    The first row of a block also goes to the block before it, for the pair
    across the cut and to tell that block that it is not the last.
    """
    position, start = F.col("position"), F.col("position") % size == 0
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    fault = F.col("fault")
    code = F.when(fault.isin("blank", "duplicate"), F.translate(initial, "suax", "0123")).when(
        fault == "truncated", F.upper(initial)
    ).otherwise(initial)
    block = F.expr(f"position div {int(size)}")
    dealt = rows.select(
        "conv_id", "position", code.alias("code"),
        F.explode(F.when(start & (position > 0), F.array(block, block - 1)).otherwise(F.array(block))).alias("block"),
    )
    texts = dealt.groupBy("conv_id", "block").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda x: x["code"]), ""
        ).alias("_all"),
        F.max(position >= (F.col("block") + 1) * size).alias("_more"),
    )
    plain = F.translate("_all", "SUAX0123", "suaxsuax")
    pairs = F.transform(F.sequence(F.lit(1), F.length("_all") - 1), lambda i: F.substr(plain, i, F.lit(2)))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))
    return texts.select(
        "conv_id", "block",
        F.when(F.col("_more"), F.expr("left(_all, length(_all) - 1)")).otherwise(F.col("_all")).alias("codes"),
        (~F.col("_more")).alias("last"), F.when(F.length("_all") > 1, illegal).otherwise(0).alias("illegal"),
    )


def edits(rows: DataFrame, params: RepairParams = RepairParams()) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits of judged rows, and the blocks they were found in.

    Edits: one row per edit with conv_id, block, step (order inside the block),
    edit (``K`` keep, ``R`` rerole, ``D`` delete, ``I`` insert), initial of the
    resulting role (``-``: deleted), position of the row (null: inserted) and
    to_go, the cost from the block's start to the conversation's end.  Among repairs
    of least cost it is the one whose initials, read in order, come first.
    """
    blocks = materialized(_blocks(rows, params.block_rows), "repair-blocks")
    kind = rows.schema["conv_id"].dataType.simpleString()
    keys, start = ["conv_id", "block"], np.array([0, FAR, FAR, FAR])

    def joined(left: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
        right = vectors.select(F.col("conv_id").alias("_c"), F.col("i").alias("_i"), F.col("v").alias(name))
        match = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_i"))
        return left.join(right, match).drop("_c", "_i")

    if (blocks.agg(F.max("block")).first()[0] or 0) == 0:
        ready = blocks.select(
            *keys, "codes", "last", F.array(*[F.lit(int(x)) for x in CLOSE]).alias("right"),
            F.array(*[F.lit(int(x)) for x in start]).alias("enter"),
        )
    else:
        products = blocks.select("conv_id", "block", "codes").mapInArrow(
            lambda b: _matrices(b, keys), f"conv_id {kind}, block long, m array<long>"
        )
        products = materialized(products.withColumnRenamed("block", "i"), "repair-matrices")
        costed = joined(blocks, _swept(products, CLOSE, False, params.fan_in), "right")
        costed = materialized(costed.select(*keys, "codes", "last", "right"), "repair-costs")
        maps = costed.mapInArrow(lambda b: _paths(b, keys, True), f"conv_id {kind}, block long, m array<long>")
        maps = materialized(maps.withColumnRenamed("block", "i"), "repair-maps")
        ready = joined(costed, _swept(maps, start, True, params.fan_in), "enter")
    found = ready.select(*keys, "codes", "last", "right", "enter").mapInArrow(
        lambda b: _paths(b, keys, False),
        f"conv_id {kind}, block long, step long, edit string, initial string, offset long, to_go long",
    )
    placed = found.withColumn("position", F.col("block") * params.block_rows + F.col("offset")).drop("offset")
    return materialized(placed, "repair-edits"), blocks


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Judged rows after their edits, in the order of (block, step); deleted rows have a null role and text.

    Inserted rows have an empty text and no turn.
    """
    texts = rows.select(F.col("conv_id").alias("_c"), F.col("position").alias("_p"), "turn", "role", "text")
    met = found.join(
        texts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("position") == F.col("_p")), "left"
    )
    named = F.when(F.col("initial") == "u", "user").otherwise("assistant")
    gone = F.col("edit") == "D"
    return met.select(
        "conv_id", "block", "step", "edit", "turn",
        F.when(gone, None).when(F.col("edit") == "K", F.col("role")).otherwise(named).alias("role"),
        F.when(gone, None).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of conversations whose rows come in order; only the open one's state is held."""
    kind, open_id, seen, audit, digest, any_text = None, None, False, [], hashlib.sha256(), False
    ids, audits, digests = [], [], []

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), pa.array(audits, pa.string()), pa.array(digests, pa.string())],
            names=["conv_id", "audit", "repaired_sha256"],
        )

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "edit", "line")]
        for conv, edit, line in zip(*columns, strict=True):
            if not seen or conv != open_id:
                if seen:
                    ids.append(open_id), audits.append("".join(audit)), digests.append(digest.hexdigest())
                open_id, seen, audit, digest, any_text = conv, True, [], hashlib.sha256(), False
            audit.append(edit)
            if line is not None:
                digest.update(b"\n" * any_text + line.encode("utf-8"))
                any_text = True
        if len(ids) > 4096:
            yield batch_of()
            ids, audits, digests = [], [], []
    if seen:
        ids.append(open_id), audits.append("".join(audit)), digests.append(digest.hexdigest())
        yield batch_of()


def repair_digest(conversations: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """Faults, cost, audit and digest of each conversation after damage and repair.

    Every conv_id of the table comes back, a null one as a conversation of its
    own; one without rows after the damage has zeros, an empty audit and the digest
    of an empty text.  Null roles and texts are one space, so such texts are blank.
    Repeated rows are duplicates.  Texts may be of any length, as may
    conversations: edits are found block by block.  Only the digest of a
    conversation is taken in one task, because SHA-256 reads a text from start to
    end; it streams over the sorted rows and holds no more than the audit.  An empty
    table gives no rows.  Only conv_id, turn, role and text are read; other columns do
    not matter, whatever their names.
    """
    every = conversations.select("conv_id").distinct()
    rows = materialized(judged(damaged(conversations)), "repair-judged")
    found, blocks = edits(rows, params)
    fault = F.col("fault")
    facts = rows.groupBy(F.col("conv_id").alias("_f")).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.sum((F.coalesce(fault, F.lit("")) == name).cast("long")).alias(name) for name in ("blank", "duplicate", "truncated")],
    )
    pairs = blocks.groupBy(F.col("conv_id").alias("_b")).agg(F.sum("illegal").alias("illegal"))
    costs = found.where((F.col("block") == 0) & (F.col("step") == 0)).select(F.col("conv_id").alias("_s"), F.col("to_go").alias("cost"))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    lines = repaired(rows, found).select("conv_id", "block", "step", "edit", F.concat("role", F.lit(":"), "text").alias("line"))
    texts = lines.repartition("conv_id").sortWithinPartitions("conv_id", "block", "step").select("conv_id", "edit", "line")
    digests = texts.mapInArrow(_digests, f"conv_id {kind}, audit string, repaired_sha256 string")
    out = every
    for part, key in ((facts, "_f"), (pairs, "_b"), (costs, "_s"), (digests.withColumnRenamed("conv_id", "_d"), "_d")):
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(key)), "left").drop(key)

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)

    return out.select(
        "conv_id", *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
