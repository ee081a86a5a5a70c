"""Replacing identifying content with fixed placeholders.

Line structure never changes and every placeholder is a fixed point, so a
second pass changes nothing.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from corpusmill.functions import batches as arrow
from corpusmill.functions import entities
from corpusmill.sources.materialize import materialized

# Placeholders by kind.
PLACEHOLDERS = {
    "company": "Acme",
    "product": "AppName",
    "person": "John Doe",
    "email": "user@example.com",
    "domain": "example.com",
    "phone": "+1-555-0100",
    "secret": "REDACTED",
}

# Patterns, applied in this order: (needed, pattern, replacement).  A text that in lower case has none of the
# needed pieces (texts, or plain patterns without look-around) cannot match and skips the pattern.
PATTERN_RULES = (
    # assigned secrets: token = "....", password: ....
    (
        ("key", "token", "secret", "passw"),
        r"(?i)((?:api_?key|access_?key|token|secret|passwd|password)[\"']?[ \t]*[:=][ \t]*[\"']?)"
        r"[A-Za-z0-9_/+\-]+",
        r"$1REDACTED",
    ),
    (("akia",), r"AKIA[0-9A-Z]{16}", "REDACTED"),
    (("bearer",), r"(?i)\b(bearer[ \t]+)[A-Za-z0-9._~+/=\-]+", r"$1REDACTED"),
    # tokens that show their vendor
    (
        ("gh", "glpat", "xox", "sk-"),
        r"\b(?:gh[oprsu]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_\-]{16,}|xox[abprs]-[A-Za-z0-9\-]{10,}|sk-[A-Za-z0-9_\-]{20,})",
        "REDACTED",
    ),
    # e-mail addresses; the user and host of a copy-style location (user@host:path) are none
    (
        ("@",),
        r"[A-Za-z0-9._%+\-]+@(?>[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})(?!:[A-Za-z0-9_~])",
        "user@example.com",
    ),
    (("@",), r"(@)[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+(?=:[A-Za-z0-9_~])", r"$1example.com"),
    # password inside a URL
    (("://",), r"(://[^/ \t\n:@]+:)[^/ \t\n@]+@", r"$1REDACTED@"),
    # host of a URL; user part, path and query stay
    (
        ("://",),
        r"((?:https?|ftp|ssh|git)://(?:[A-Za-z0-9._~%+\-]+(?::[^@/ \t\n]*)?@)?)[A-Za-z0-9.\-]+",
        r"$1example.com",
    ),
    (("www.",), r"www\.[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", "example.com"),
    # domains that stand alone
    (
        (".com", ".org", ".net", ".de", ".ru", ".fr", ".uk", ".eu", ".info", ".biz"),
        r"(?i)(?<![A-Za-z0-9_@/.\-])(?:[A-Za-z0-9][A-Za-z0-9\-]*\.)+(?:com|org|net|de|ru|fr|uk|eu|info|biz)"
        r"(?![A-Za-z0-9_(\-]|\.[A-Za-z0-9])",
        "example.com",
    ),
    # phone numbers: international, and domestic ones with a trunk 8
    (
        ("+",),
        r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3}(?:[ .\-]?[0-9]{4}|[ .\-][0-9]{2}[ .\-][0-9]{2})",
        "+1-555-0100",
    ),
    (
        (re.compile(r"8[ \-]?\(?[0-9]{3}"),),
        r"(?<![0-9A-Za-z_+.\-])8[ \-]?\(?[0-9]{3}\)?[ \-]?[0-9]{3}[ \-][0-9]{2}[ \-][0-9]{2}(?![0-9])",
        "+1-555-0100",
    ),
    # addresses of hosts
    ((re.compile(r"[0-9]\.[0-9]{1,3}\.[0-9]"),),
     r"(?<![0-9A-Za-z_.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z_]|\.[0-9])",
     "192.0.2.1"),
)

# The rules that find secrets.
SECRET_RULES = PATTERN_RULES[:4]

def with_patterns_redacted(texts: DataFrame, source: str, target: str) -> DataFrame:
    """Secrets, e-mail addresses, hosts and phone numbers of ``source``.

    One projection per rule: the text of the previous rule is used twice and
    must not be computed twice.  What a rule needs is looked for in the text as
    given, as no rule puts in what another one needs.
    """
    out = texts.withColumn("_low", F.lower(source)).withColumn(target, F.col(source))
    for needed, pattern, replacement in PATTERN_RULES:
        possible = reduce(
            Column.__or__,
            [F.col("_low").rlike(p.pattern) if isinstance(p, re.Pattern) else F.contains("_low", F.lit(p)) for p in needed],
        )
        out = out.withColumn(
            target,
            F.when(possible, F.regexp_replace(target, pattern, replacement)).otherwise(F.col(target)),
        )
    return out.drop("_low")


#: What redaction puts in, also as it stands inside an identifier: never touched again.
FIXED = tuple(sorted({form for p in (*PLACEHOLDERS.values(), "192.0.2.1") for form in (p, p.replace(" ", ""))}))
#: Bits of the filter per name, and the most bits of all (64 MB): a larger gazetteer passes more texts on, none is lost.
FILTER_BITS, FILTER_LIMIT = 32, 1 << 29


def _entries(gazetteer: DataFrame) -> DataFrame:
    """The gazetteer with one kind per name (and folder), whatever its case, and the key of its first units.

    Of several kinds the first in the order of ``PLACEHOLDERS`` holds; an unknown kind is an error.
    """
    cloudpickle.register_pickle_by_value(entities)
    scope = F.col("folder") if "folder" in gazetteer.columns else F.lit(None)
    order = F.array_position(F.array(*[F.lit(k) for k in PLACEHOLDERS]), F.col("kind"))
    known = F.when(F.coalesce(order, F.lit(0)) > 0, order).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of name: "), F.coalesce("kind", F.lit("null")))).cast("bigint")
    )
    single = (
        gazetteer.where(F.col("name").isNotNull())
        .select(scope.cast("string").alias("scope"), "name", F.lower("name").alias("folded"), known.alias("rank"))
        .groupBy("scope", "folded").agg(F.min("rank").alias("rank"), F.min("name").alias("name"))
    )
    puts = F.element_at(F.array(*[F.lit(p) for p in PLACEHOLDERS.values()]), F.col("rank").cast("int"))

    def keyed(batches):
        for batch in batches:
            scopes, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = [entities.name_key(n, s) for n, s in zip(names, scopes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(keys, pa.int64())], ["name", "put", "key"]
            )

    return materialized(
        single.select("scope", "name", puts.alias("put")).mapInArrow(keyed, "name string, put string, key long")
        .where(F.col("key").isNotNull()), "gazetteer",
    )


def name_filter(entries: DataFrame) -> np.ndarray:
    """Bloom filter over the keys of a gazetteer, as words of 64 bits: at most 64 MB on the driver."""
    count = entries.count()
    words = max(1, min(FILTER_LIMIT, FILTER_BITS * count) // 64)
    spot = F.expr(
        f"transform(sequence(0, {entities.PROBES - 1}), i -> pmod((key & 4294967295) + i * shiftrightunsigned(key, 32), {64 * words}L))"
    )
    bits = (
        entries.select(F.explode(spot).alias("spot"))
        .groupBy(F.expr("spot div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("bits"))
        .toArrow()
    )
    out = np.zeros(words, np.uint64)
    out[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return out


def with_name_keys(texts: DataFrame, column: str, words: np.ndarray, scoped: bool) -> DataFrame:
    """``texts`` with ``name_keys``: the keys of units and neighbours in ``column`` that the filter may hold."""
    for module in (entities, arrow):
        cloudpickle.register_pickle_by_value(module)
    shared = texts.sparkSession.sparkContext.broadcast(words)
    names = [*texts.columns, "name_keys"]
    text_at, folder_at = texts.columns.index(column), texts.columns.index("folder") if scoped else None

    def run(batches):
        held, known = entities.WordHashes(), shared.value
        for batch in itertools.chain.from_iterable(map(arrow.pieces, batches)):
            packed = [b"".join(map(held.__getitem__, entities.WORD.findall(t or ""))) for t in batch.column(text_at).to_pylist()]
            hashes = np.frombuffer(b"".join(packed), np.dtype("<u8"))
            rows = np.repeat(np.arange(batch.num_rows), [len(p) // 8 for p in packed])
            scopes = None
            if scoped:
                folders = batch.column(folder_at).to_pylist()
                scopes = np.array([entities.unit_hash(f) if f is not None else 0 for f in folders], np.uint64)
            marks = [np.zeros((2, 0), np.uint64)]
            for keys, owners in entities.text_keys(hashes, rows, scopes):
                hit = entities.in_filter(keys, known)
                marks.append(np.stack([owners[hit].astype(np.uint64), keys[hit]]))
            found = np.unique(np.concatenate(marks, axis=1), axis=1)
            offsets = np.searchsorted(found[0], np.arange(batch.num_rows + 1).astype(np.uint64))
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found[1].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names)

    schema = StructType([*texts.schema.fields, StructField("name_keys", ArrayType(LongType()))])
    return texts.mapInArrow(run, schema)


def with_names_redacted(texts: DataFrame, column: str) -> DataFrame:
    """``column`` with the ``names`` (array of name and put) of its row replaced; drops ``names``."""
    for module in (entities, arrow):
        cloudpickle.register_pickle_by_value(module)
    kept = [(c, i) for i, c in enumerate(texts.columns) if c != "names"]
    text_at, names_at = texts.columns.index(column), texts.columns.index("names")

    def run(batches):
        shapes = entities.Shapes()
        for batch in itertools.chain.from_iterable(map(arrow.pieces, batches)):
            rows = zip(batch.column(text_at).to_pylist(), batch.column(names_at).to_pylist(), strict=True)
            out = [
                t if t is None else entities.replaced(t, [(n["name"], n["put"]) for n in ns], FIXED, shapes) for t, ns in rows
            ]
            columns = [pa.array(out, pa.string()) if i == text_at else batch.column(i) for _, i in kept]
            yield pa.RecordBatch.from_arrays(columns, [c for c, _ in kept])

    return texts.mapInArrow(run, texts.drop("names").schema)


def redacted(
    texts: DataFrame, gazetteer: DataFrame | None = None, keys: list[str] = ["folder", "path"]
) -> DataFrame:
    """Texts (``keys``, which name a row, plus ``text``) with an added ``redacted`` column.

    Patterns come first, then gazetteer names (name, kind, optional folder),
    leftmost and longest first, in any case and inside identifiers.  A filter of the names' first units,
    whose size is bounded, is tested while the texts are scanned, and the result of the scan is written
    once: only texts with a hit go on to meet the names found in them, by an equi-join
    with the gazetteer of any size; the others are not shuffled.  Placeholders are fixed points.
    """
    cleaned = with_patterns_redacted(texts, "text", "redacted")
    if gazetteer is None:
        return cleaned
    entries = _entries(gazetteer)
    scoped = "folder" in gazetteer.columns
    marked = materialized(with_name_keys(cleaned, "redacted", name_filter(entries), scoped), "marked")
    hit = F.size("name_keys") > 0
    found = (
        marked.where(hit).select(*keys, F.explode("name_keys").alias("key"))
        .join(entries, "key").groupBy(*keys)
        .agg(F.array_sort(F.collect_set(F.struct("name", "put"))).alias("names"))
    )
    none = F.array().cast("array<struct<name:string,put:string>>")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    met = marked.where(hit).drop("name_keys").alias("t").join(found.alias("n"), same, "left").select(
        "t.*", F.coalesce("n.names", none).alias("names")
    )
    return with_names_redacted(met, "redacted").unionByName(marked.where(~hit).drop("name_keys"))
