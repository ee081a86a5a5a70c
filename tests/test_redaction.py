"""Names inside texts and identifiers, kinds, filter and plan of the redaction."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import entities
from corpusmill.operators import redaction

TEXTS = "folder string, path string, text string"


def redact(spark, text, names, schema="name string, kind string"):
    texts = spark.createDataFrame([("f", "p", text)], TEXTS)
    return redaction.redacted(texts, spark.createDataFrame(names, schema)).first().redacted


def test_names_are_found_in_any_case_and_in_identifiers(spark):
    names = [("Globex Client", "company"), ("globex", "product"), ("Jane Roe", "person"), ("Ünal", "person")]
    text = "globex_client GLOBEX GlobexClient getGlobexClient() globex-client Globexology jane_roe_id Jane Roe janeRoe ÜNAL ünals x_globex"
    assert redact(spark, text, names) == (
        "Acme AppName Acme getAcme() Acme Globexology JohnDoe_id John Doe JohnDoe John Doe ünals x_AppName".replace(
            "John Doe JohnDoe John Doe", "John Doe John Doe John Doe"
        )
    )


def test_kinds_of_the_policy(spark):
    text = (
        "corp.de, sub.corp.com/x self.net() a.b.de_x 8 (495) 123-45-67 +7 495 123-45-67 10.1.2.3 v1.2.3.4.5 300.1.2.3 "
        "git@gitlab.corp.de:x/y bob@corp.io: hi ssh://git@corp.de/x"
    )
    got = redact(spark, text, [("none", "company")])
    assert got == (
        "example.com, example.com/x self.net() a.b.de_x +1-555-0100 +1-555-0100 192.0.2.1 v1.2.3.4.5 300.1.2.3 "
        "git@example.com:x/y user@example.com: hi ssh://user@example.com/x"
    )
    assert redact(spark, got, [("none", "company")]) == got


def test_one_kind_per_name(spark):
    names = [("Initech", "person"), ("initech", "company"), ("INITECH", "product"), ("Initech", "company")]
    assert redact(spark, "Initech initech", names) == "Acme Acme"
    scoped = [("Initech", "person", "f"), ("Initech", "company", "g"), ("Initech", "product", "f")]
    assert redact(spark, "Initech", scoped, "name string, kind string, folder string") == "AppName"


def test_names_without_units_and_nulls(spark):
    texts = spark.createDataFrame([("f", "a", None), ("f", "b", ""), ("f", "c", "x ... y"), (None, "d", "Umbrella")], TEXTS)
    names = spark.createDataFrame([("...", "company"), (None, "person"), ("Umbrella", "company")], "name string, kind string")
    got = {r.path: r.redacted for r in redaction.redacted(texts, names).collect()}
    assert got == {"a": None, "b": "", "c": "x ... y", "d": "Acme"}
    empty = redaction.redacted(texts, names.limit(0)).collect()
    assert {r.path: r.redacted for r in empty} == {r.path: r.text for r in empty}


def plainly_replaced(text, names):
    """Tries every name at every unit, longest first; texts here hold no placeholders and no identifiers."""
    found, out, at, i = entities.units_of(text), "", 0, 0
    shapes = sorted(([u for u, _, _ in entities.units_of(n)], n, put) for n, put in names)
    while i < len(found):
        fits = [
            (units, n, put) for units, n, put in shapes
            if [u for u, _, _ in found[i : i + len(units)]] == units
            and all(text[a[2] : b[1]] in " _-" for a, b in zip(found[i : i + len(units)], found[i + 1 : i + len(units)], strict=False))
        ]
        if not fits:
            i += 1
            continue
        units, _, put = max(fits, key=lambda x: len(x[0]))
        out, at, i = out + text[at : found[i][1]] + put, found[i + len(units) - 1][2], i + len(units)
    return out + text[at:]


def test_leftmost_and_longest():
    draw = random.Random(8)
    for _ in range(300):
        names = {" ".join(draw.choice("abc") for _ in range(draw.randrange(1, 4))) for _ in range(4)}
        pairs = [(n, f"<{n.replace(' ', '.')}>") for n in sorted(names)]
        text = "".join(draw.choice(["a", "b", "c", "d"]) + draw.choice([" ", " ", ", ", "\n"]) for _ in range(20))
        assert entities.replaced(text, pairs, ("Acme",), entities.Shapes()) == plainly_replaced(text, pairs)


def test_filter_holds_every_key_and_few_others(spark):
    rows = [(f"name{i} of{i}", "company") for i in range(3000)]
    entries = redaction._entries(spark.createDataFrame(rows, "name string, kind string"))
    words = redaction.name_filter(entries)
    keys = np.array([r.key for r in entries.collect()], np.int64).view(np.uint64)
    assert len(entities.in_filter(keys, words)) == len(keys)
    others = np.random.default_rng(1).integers(0, 2**63, 200_000, np.uint64)
    assert len(entities.in_filter(others, words)) < 200


def test_only_texts_with_a_hit_are_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.range(500).select(
            F.lit("f").alias("folder"), F.col("id").cast("string").alias("path"),
            F.when(F.col("id") % 100 == 0, "at Hooli").otherwise("plain words " * 20).alias("text"),
        )
        names = spark.createDataFrame([("Hooli", "company")], "name string, kind string")
        out = redaction.redacted(texts, names)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.where("redacted = 'at Acme'").count() == 5
        exchanged = [line for line in plan.splitlines() if "Exchange" in line]
        assert exchanged and "BroadcastExchange" not in plan
        branches = plan.split("Union")[1]
        last = branches.rsplit("FileScan", 1)[0].rsplit("+-", 3)[-1]
        assert "Exchange" not in last  # the branch of texts without a hit
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unknown_kinds_are_an_error(spark):
    with pytest.raises(Exception, match="unknown kind"):
        redact(spark, "x", [("x", "planet")])
