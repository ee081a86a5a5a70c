"""Merkle manifest of a table: only every few levels are stored, proofs regenerate the levels between.

Every step is a DataFrame operation.  A tree is a list of stored levels, the
first one the leaves, each further one the roots of the aligned subtrees of
``2 ** BAND`` nodes of the level before.  What lies between two stored levels is
never written: ``proofs`` builds it again, subtree by subtree, inside the row
that holds the subtree's stored descendants, takes the siblings from it and
drops it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialized, running_totals

#: Levels from one stored level to the next; a subtree has at most 2 ** BAND stored nodes, which make one row.
BAND = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, one after the other."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _pair(left: Column, right: Column) -> Column:
    """Digest of a run of two nodes, or of its one node where there is no second."""
    return F.sha2(F.concat(left, F.coalesce(right, F.lit(""))), 256)


def _grouped(nodes: DataFrame, band: int) -> DataFrame:
    """One row per aligned subtree with its nodes in order: at most ``2 ** band`` of them."""
    payload = [c for c in nodes.columns if c not in ("group", "position")]
    return nodes.groupBy("group", F.shiftright("position", band).alias("parent")).agg(
        F.sort_array(F.collect_list(F.struct("position", *payload))).alias("nodes")
    )


def _level_above(below: Column) -> Column:
    starts = F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1))
    return F.transform(starts, lambda i: _pair(F.get(below, i * 2), F.get(below, i * 2 + 1)))


def _with_levels(subtrees: DataFrame, band: int) -> DataFrame:
    """Add ``levels`` (digests of each level below the subtree's root), ``height`` and the ``root``.

    Only the first subtree of a group can be the only one, and only then the
    tree ends inside the band; all others rise through all of its levels, a
    last node alone as the digest of itself.
    """
    first = F.size("nodes")
    out = subtrees.withColumn(
        "height",
        F.when(F.col("parent") > 0, F.lit(band))
        .when(first > 1, F.length(F.bin((first - 1).cast("long"))))
        .otherwise(F.lit(0)),
    ).withColumn("_0", F.transform("nodes", lambda n: n["hash"]))
    for k in range(band):
        below = F.col(f"_{k}")
        out = out.withColumn(f"_{k + 1}", F.when(F.col("height") > k, _level_above(below)).otherwise(below))
    return out.select(
        "group", "parent", "nodes", "height",
        F.array(*[F.col(f"_{k}") for k in range(band)]).alias("levels"), F.get(f"_{band}", F.lit(0)).alias("root"),
    )


def build(nodes: DataFrame, band: int = BAND) -> list[DataFrame]:
    """Stored levels of the trees over ``nodes`` (group, position, hash, ...): one tree per group.

    Positions count from 0 in each group without gaps.  The last level has one
    row per group, its root; a group of one node has that node's digest as its
    root.  No nodes: one empty level.
    """
    levels = [nodes]
    top = nodes.agg(F.max("position")).first()[0] or 0
    while top > 0:
        roots = _with_levels(_grouped(levels[-1].select("group", "position", "hash"), band), band)
        levels.append(
            materialized(roots.select("group", F.col("parent").alias("position"), F.col("root").alias("hash")), "merkle")
        )
        top >>= band
    return levels


def proofs(levels: list[DataFrame], band: int = BAND, upper: DataFrame | None = None) -> DataFrame:
    """Every node of the first stored level with its ``path`` to the root and the ``root``.

    ``upper`` (group, top, upper) goes on from the roots of the groups: paths
    then lead on to ``top``.

    ``path`` has one struct per tree level from the node upwards: ``left`` (the
    sibling stands on the left) and ``sibling`` (null where the node is alone).
    A subtree's inner levels exist only inside its row.  The part of a path
    above a subtree is the same for all of its nodes and joined by subtree, so
    no task needs more than one subtree at a time and a large group is spread
    over its subtrees.
    """
    tops = levels[-1].select("group", F.col("position").alias("parent"), F.col("hash").alias("root"))
    if upper is None:
        above = tops.withColumn("top", F.col("root")).withColumn(
            "rest", F.array().cast("array<struct<left:boolean,sibling:string>>")
        )
    else:
        above = tops.join(upper.withColumnRenamed("upper", "rest"), "group")
    if len(levels) == 1:
        return levels[0].join(above.select("group", "root", "top", F.col("rest").alias("path")), "group")
    for depth in range(len(levels) - 2, -1, -1):
        nodes = levels[depth]
        payload = [c for c in nodes.columns if c not in ("group", "position")]
        subtrees = _with_levels(_grouped(nodes, band), band).drop("root").join(above, ["group", "parent"])

        def path(i: Column) -> Column:
            steps = F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(band - 1)), lambda k: k < F.col("height")),
                lambda k: F.struct(
                    (F.call_function("shiftright", i, k).bitwiseAND(F.lit(1)) == 1).alias("left"),
                    F.get(
                        F.get(F.col("levels"), k), F.call_function("shiftright", i, k).bitwiseXOR(F.lit(1))
                    ).alias("sibling"),
                ),
            )
            return F.concat(steps, F.col("rest"))

        opened = subtrees.select(
            "group", "root", "top",
            F.explode(F.transform("nodes", lambda n, i: F.struct(n.alias("node"), path(i).alias("path")))).alias("_x"),
        )
        named = opened.select(
            "group", F.col("_x.node.position").alias("position"),
            *[F.col(f"_x.node.{c}").alias(c) for c in payload], "root", "top",
            F.col("_x.path").alias("path"),
        )
        above = named.select("group", F.col("position").alias("parent"), "root", "top", F.col("path").alias("rest"))
    return named


def folded(leaf: Column, path: Column) -> Column:
    """Digest that a leaf and its siblings lead to."""
    return F.aggregate(
        path, leaf,
        lambda node, step: F.when(step["left"], _pair(step["sibling"], node)).otherwise(_pair(node, step["sibling"])),
    )


def siblings(path: Column) -> Column:
    """The siblings of a path, level by level, as one text."""
    return F.array_join(F.transform(F.filter(path, lambda s: s["sibling"].isNotNull()), lambda s: s["sibling"]), "")


def merkle_manifest(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", key: str = "doc_id",
    checked: Column | None = None, band: int = BAND,
) -> DataFrame:
    """One row per document: key, leaf, subroot, root and the path to the root, ready to be verified.

    Leaves of a group stand in the order of ``key`` (nulls last; equal keys by
    leaf; equal leaves are interchangeable), groups in the bytewise order of
    their names, null first.  ``checked`` is the leaf to verify, by default the
    leaf itself; it comes back as ``checked``.

    Null values are fields of their own (``-``), an empty text is ``0:``, texts
    of any length are one digest.  Repeated rows are leaves of their own.  An
    empty table gives no rows.  Only the named columns are read, so that other
    columns and their names do not matter.  A group of any size is spread over
    ranges of its keys and then over its subtrees.
    """
    leaf = leaf_hash([F.col(c) for c in columns])
    rows = docs.select(
        F.col(key).alias("key"), leaf.alias("hash"), (leaf if checked is None else checked).alias("checked"),
        # A name of its own for the null group that sorts before all others.
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("group"),
        F.lit(1).cast("long").alias("one"),
    )
    placed = running_totals(rows, ["key", "hash"], {"position": "one"}, group="group").drop("one")
    leaves = materialized(placed, "merkle-leaves")
    trees = build(leaves, band)
    tops = trees[-1].select(
        F.lit("").alias("group"), F.col("group").alias("name"), "hash", F.lit(1).cast("long").alias("one")
    )
    crown = build(
        materialized(running_totals(tops, ["name"], {"position": "one"}).drop("one"), "merkle-subroots"), band
    )
    upper = proofs(crown, band).select(
        F.col("name").alias("group"), F.col("root").alias("top"), F.col("path").alias("upper")
    )
    # Joined where a group has one row, so that no leaf moves for it.
    return proofs(trees, band, upper).select(
        F.col("key").alias(key), F.col("hash").alias("leaf"), F.col("root").alias("subroot"),
        F.col("top").alias("root"), "path", "checked",
    )


def manifest_digest(docs: DataFrame, band: int = BAND) -> DataFrame:
    """Proof digests of all documents, and which of them still verify after the tampering of the contract.

    Where 7 divides the unsigned CRC-32 of the decimal ``doc_id``, the checked
    leaf has ``n_chars`` plus one (null counts stay null, null ids stay as they are).
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    grown = F.when(hit, (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")).otherwise(
        F.col("n_chars").cast("string")
    )
    values = [grown if c == "n_chars" else F.col(c) for c in COLUMNS]
    out = merkle_manifest(docs, checked=leaf_hash(values), band=band)
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        folded(F.col("checked"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
