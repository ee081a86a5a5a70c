"""Pipeline stages carry rows unharmed, whatever the names of their columns; draws against plain code."""

from __future__ import annotations

import base64
from collections import Counter, defaultdict

import numpy as np
import tiktoken

from corpusmill.llm.decontaminate import decontaminated
from corpusmill.llm.feistel import permuted
from corpusmill.llm.mixing import MixParams, _shard_counts, mixed_documents, plan_mix, taken_words
from corpusmill.llm.ngram_join import one_of_each
from corpusmill.llm.token_output import PATTERN, TokenParams, training_order, written_order

CLASH = "_own _id _hash _copy copy pass ranges text_hash row own_id own_hash others kept_id kept_hash own_source size before".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def made(spark, rows):
    return spark.createDataFrame([(*r, *[f"{c}{r[0]}{r[3]}" for c in CLASH]) for r in rows], SCHEMA)


def words(n, word="w"):
    return " ".join(f"{word}{i}" for i in range(n))


def test_one_of_each_keeps_rows_as_they_are(spark):
    rows = [(1, words(30), "en", "a", 1), (2, words(30), "en", "b", 2), (3, words(40, "x"), None, None, None), (4, None, "en", "a", 0),
            (4, None, "en", "a", 0), (None, "", "en", "a", 0)]
    frame = made(spark, rows)
    want = [tuple(r) for r in frame.collect() if r.doc_id != 2]
    got = one_of_each(frame)
    assert got.schema == frame.schema
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_one_of_each_keeps_the_same_row_of_twins(spark):
    frame = made(spark, [(1, words(30), "en", source, 1) for source in "cab"])
    assert [r.source for r in one_of_each(frame).collect()] == ["a"]


def test_mix_delivers_what_it_takes_under_the_right_source(spark):
    rows = [(7, words(400), "en", s, None) for s in ("b", "a", "a")] + [(i, words(700, f"v{i}"), "en", s, 0) for i in (1, 2, 3) for s in "ab"]
    frame = made(spark, rows)
    params = MixParams(weights=(1, 3), slots_per_shard=8)
    plan, out = plan_mix(frame, params), mixed_documents(frame, params).collect()
    taken, held = Counter(), Counter()
    for r in taken_words(plan).collect():
        taken[(r.source, r.doc_id)] += r.taken
    for r in out:
        held[(r.source, r.doc_id)] += len(r.text.split())
        assert all(r[c] == f"{c}{r.doc_id}{r.source}" for c in CLASH) and r.n_chars == len(r.text)
    assert held == {k: n for k, n in taken.items() if n}
    assert mixed_documents(frame, params).schema.names == frame.schema.names


def test_decontaminated_keeps_rows_as_they_are(spark):
    frame = made(spark, [(1, words(30), "en", "a", 1), (2, "clean", "en", "b", 2)])
    bench = spark.createDataFrame([(1, words(12))], "item_id long, text string")
    assert [tuple(r) for r in decontaminated(frame, bench).collect()] == [tuple(r) for r in frame.where("doc_id = 2").collect()]


def test_shards_draw_from_the_totals(spark):
    params = MixParams(slots_per_shard=10, draw_rows=16, key=5)
    totals = [40, 0, 13, 1]
    got = {(r.shard, r.source_no): r.n for r in _shard_counts(spark, totals, params).collect()}
    place = permuted(np.arange(54), 54, 5).tolist()
    sizes = [9] * 6
    edges = np.cumsum(sizes)
    source = [no for no, n in enumerate(totals) for _ in range(n)]
    want = Counter((int(np.searchsorted(edges, p, "right")), no) for p, no in zip(place, source, strict=True))
    assert got == dict(want)
    per_shard = defaultdict(int)
    for (shard, _), n in got.items():
        per_shard[shard] += n
    assert list(dict(sorted(per_shard.items())).values()) == sizes
    assert len({tuple(got.get((s, no), 0) for no in range(4)) for s in range(6)}) > 1  # drawn, not dealt evenly


def test_slots_are_the_permuted_numbers_of_the_sequences(spark):
    params = TokenParams(length=8, slots_per_shard=16, key=3)
    texts = [f"The {i} storm of lantern number {i * 7} " * (i % 5) for i in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    with open(params.vocabulary, "rb") as source:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in source)}
    encode = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    cut = []
    for doc_id, text in enumerate(texts):
        ids = encode(text)
        cut += [(doc_id, piece, ids[8 * piece : 8 * piece + 8]) for piece in range(max(1, -(-len(ids) // 8)))]
    slots = permuted(np.arange(len(cut)), len(cut), 3).tolist()
    assert sorted(slots) == list(range(len(cut)))
    want = sorted(
        (doc_id, piece, slot, slot // 16, slot % 16 * 16, (np.array(ids + [params.pad] * (8 - len(ids)), np.uint16)).tobytes())
        for (doc_id, piece, ids), slot in zip(cut, slots, strict=True)
    )
    for made_by in (training_order, written_order):
        got = made_by(frame, params).select("doc_id", "piece", "slot", "shard", "byte_offset", "record").collect()
        assert sorted((*r[:5], bytes(r.record)) for r in got) == want
