"""Operators against plain code, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm.common import text_bytes
from corpusmill.llm.components import connected_components
from corpusmill.llm.decontaminate import DecontaminationParams, contamination, contamination_digest, decontaminated
from corpusmill.llm.feistel import permuted
from corpusmill.llm.induced import Workspace, suffixes
from corpusmill.llm.mixing import MixParams, cut_words, mixed_documents, plan_mix, taken_words, targets
from corpusmill.llm.ngram_join import JoinParams, banding, one_of_each, similar_documents
from corpusmill.llm.quality_rules import QualityParams, quality_rules
from corpusmill.llm.rule_ensemble import EnsembleParams, fit_ensemble, quality_kept, rule_scores, score_expression
from corpusmill.llm.sharding import shard_by_bytes
from corpusmill.llm.suffix_dedup import SuffixParams, repeats_digest
from corpusmill.llm.text_stats import base_counts, feature_matrix
from corpusmill.llm.token_output import TokenParams, encoder, read_records, training_order, write_shard_files, written_order
from corpusmill.llm.url_filter import RULES, url_verdicts
from corpusmill.llm.warc import WarcParams, archived_pages, normalised, read_members, write_monolithic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEPT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if not isinstance(v, (list, dict)) else str(v)) for v in r))


# Sharding


def test_shards_are_contiguous_and_even(docs, rows):
    got = shard_by_bytes(docs, 6).collect()
    assert len(got) == len(rows)
    want = order((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert order((r.doc_id, r.size, r.text_crc32) for r in got) == want
    total, before, seen = sum(w[1] for w in want), 0, Counter()
    by_key = defaultdict(list)
    for r in got:
        by_key[(r.doc_id is None, r.doc_id, r.size, r.text_crc32)].append((r.shard, r.slot))
    for key in sorted(by_key, key=lambda k: (k[0], k[1] or 0, k[2], k[3])):
        for shard, slot in sorted(by_key[key]):
            assert shard == (2 * before + key[2]) * 6 // (2 * total)
            assert slot == seen[shard]
            seen[shard] += 1
            before += key[2]
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_sharding_uses_no_python(docs, capsys):
    shard_by_bytes(docs, 6).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


# Statistics of texts


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@pytest.mark.parametrize("start", [0, 2])
def test_base_counts(rows, start):
    texts = ["a b c a b c", "a\na\n a \na", "x\ty\x0bz é#*", "\n", "a b c d", "b c d e", *[r[1] for r in rows], None, ""]
    data, offsets = text_bytes(pa.array(texts)[start:])
    got = base_counts(data, offsets)
    assert [tuple(int(got[n][i]) for n in NAMES) for i in range(len(texts) - start)] == [
        plain_counts(t) for t in texts[start:]
    ]
    assert np.isfinite(feature_matrix(data, offsets)).all()


def test_quality_rules(docs, rows, labels):
    got = quality_rules(docs, labels, QualityParams(steps=10, bits=10)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.probability >= 0.3)
        assert 0 <= r.probability <= 1
    want = order((r[0], *plain_counts(r[1])) for r in rows)
    assert order((r.doc_id, *(r[n] for n in NAMES)) for r in got) == want


def test_scores_do_not_depend_on_neighbours(docs, labels):
    params = QualityParams(steps=10, bits=10)
    one = {(r.doc_id, r.n_words): r.probability for r in quality_rules(docs.coalesce(1), labels, params).collect()}
    many = quality_rules(docs.repartition(40), labels, params).collect()
    assert all(math.isclose(one[r.doc_id, r.n_words], r.probability, rel_tol=1e-9) for r in many)


def test_character_grams_are_of_characters():
    import pyarrow as pa

    from corpusmill.llm.common import text_bytes
    from corpusmill.llm.quality_rules import _gram_buckets
    from corpusmill.llm.text_stats import base_counts

    texts = ["caf\u00e9 au lait", "", "\u65e5\u672c\u8a9e\u306e\u6587", "ab", "\U0001f600a\U0001f601b\U0001f602", None, "caf\u00e9 au lait", "xyz"]
    data, offsets = text_bytes(pa.array(texts))
    params, size = QualityParams(), 1 << QualityParams.bits
    bucket, bounds = _gram_buckets(data, offsets, base_counts(data, offsets)["_words"], params)[2]
    assert np.diff(bounds).tolist() == [len(t or "") for t in texts]

    def plain(text):
        out = []
        for i in range(len(text)):
            code = 0
            for c in text[i : i + 4]:
                code = (code * 0x01000193 ^ int.from_bytes(c.encode())) % 2**32
            code ^= code >> 15
            code = code * 0x85EBCA6B % 2**32
            code ^= code >> 13
            out.append((code if i + 4 <= len(text) else 0) % size + 2 * size)
        return out

    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert bucket[a:b].tolist() == plain(text or "")


def test_quality_rules_without_labels(docs, empty, labels):
    none = labels.where("false")
    assert all(r.probability is None and r.kept == (not r.base_failed) for r in quality_rules(docs, none).collect())
    assert quality_rules(empty, labels).count() == 0


def test_rule_ensemble(docs, rows, labels, empty):
    params = EnsembleParams(trees=5, steps=50, min_leaf=3)
    got = rule_scores(docs, labels, params).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert rule_scores(empty, labels, params).count() == 0
    assert {r.score for r in rule_scores(docs, labels.where("quality = 1"), params).collect()} == {1.0}
    kept = quality_kept(docs, labels, EnsembleParams(trees=5, steps=50, min_leaf=3, threshold=0.0))
    assert kept.columns == docs.columns and kept.count() == len(rows)
    model = fit_ensemble(docs, labels, params)
    assert model == fit_ensemble(docs.repartition(3), labels.repartition(2), params)
    assert "CASE WHEN" in str(score_expression(model)) or b"" == model


def test_models_find_bad_texts(spark):
    texts = [(i, ("Plain words stand here number %d. " % i) * 12 if i % 2 else ("###|| $$ %% %d !! " % i) * 12) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    scored = {r.doc_id: r.predicted for r in rule_scores(docs, labels, EnsembleParams(trees=5)).collect()}
    graded = {r.doc_id: r.probability for r in quality_rules(docs, labels).collect()}
    out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scored[i] == i % 2 for i in out) and all((graded[i] > 0.5) == bool(i % 2) for i in out)


# Token output


def test_permutation():
    for n in (1, 2, 3, 17, 64, 1000):
        got = permuted(np.arange(n), n, 5)
        assert sorted(got.tolist()) == list(range(n))
    assert permuted(np.arange(1000), 1000, 5).tolist() != permuted(np.arange(1000), 1000, 6).tolist()


def test_encoding_in_parts_equals_the_whole(rows):
    from tiktoken import Encoding

    params = TokenParams(part_chars=20)
    with open(params.vocabulary, "rb") as source:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in source)}
    from corpusmill.llm.token_output import PATTERN

    whole = Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    own = encoder(params)
    odd = [" a", "a ", "a  b", "a \n b", "a\n b", "it's a' s", "\ta", "a\u00a0 b", "x\u3000 y", "don 't", "\x1c a", "e\u0301 \u0301"]
    for text in [r[1] or "" for r in rows] + odd + [o * 20 for o in odd] + ["".join(odd) * 9, "x" * 500]:
        assert np.frombuffer(own(text), np.uint16).tolist() == whole(text), text


def test_training_order_round_trip(spark, docs, rows, empty):
    params = TokenParams(length=16, slots_per_shard=50)
    index = write_shard_files(training_order(docs, params))
    listed = index.collect()
    assert sorted(r.slot for r in listed) == list(range(len(listed)))
    ids = {r.slot: r.ids for r in read_records(spark, index, params).collect()}
    found = defaultdict(list)
    for r in sorted(listed, key=lambda r: (r.piece, r.slot)):
        assert r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * 32 and r.n_tokens == len(ids[r.slot])
        with open(r.path.replace("file:", ""), "rb") as source:
            source.seek(r.byte_offset)
            assert zlib.crc32(source.read(32)) == r.record_crc32
        if r.doc_id not in (None, 21, 20):
            found[r.doc_id] += ids[r.slot]
    own = encoder(params)
    for r in rows:
        if r[0] not in (None, 21, 20) and sum(x[0] == r[0] for x in rows) == 1:
            assert found[r[0]] == np.frombuffer(own(r[1] or ""), np.uint16).tolist()
    later = read_records(spark, index, params, from_slot=77).collect()
    assert sorted(r.slot for r in later) == list(range(77, len(listed)))
    assert training_order(empty, params).count() == 0


def test_query_writes_shard_files(spark, docs, empty):
    from pathlib import Path

    from corpusmill.llm.queries import QUERIES
    from corpusmill.sources.materialize import shared_folder

    def files():
        return set(Path(shared_folder(spark).replace("file:", "")).glob("corpusmill-shards-*/shard-*.bin"))

    before = files()
    out = QUERIES["op3_training_order"](spark, "/root/testdata/sf0.001").collect()
    assert sum(f.stat().st_size for f in files() - before) == 512 * len(out) > 0
    params = TokenParams(length=16, slots_per_shard=50)
    got, want = written_order(docs, params), training_order(docs, params)
    assert order(map(tuple, got.select(want.columns).collect())) == order(map(tuple, want.collect()))
    assert written_order(empty, params).count() == 0


# N-gram join


def grams(text):
    words = [w.translate(LOWER) for w in WORD.findall(text or "")]
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def test_banding_reaches_the_recall():
    bands, rows = banding(0.8, 0.9995, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def similar_texts(spark, rows):
    more, base = [], rows[5][1].split()[:200]
    for i in range(40):
        words = list(base)
        words[5 * i] = "changed"
        more.append((100 + i, " ".join(words)))
    more += [(200 + i, " ".join(base[: 150 + i])) for i in range(12)]
    return [(r[0], r[1]) for r in rows] + more


@pytest.mark.parametrize("params", [JoinParams(), JoinParams(block_grams=900, block_rows=7)])
def test_ngram_join(spark, rows, params):
    texts = similar_texts(spark, rows)
    got = similar_documents(spark.createDataFrame(texts, "doc_id long, text string"), params).collect()
    sets = [grams(t) for _, t in texts]
    link = [
        [j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)
    ]
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        for i in range(len(sets)):
            root[i] = min([root[i], *[root[j] for j in link[i]]])
    ids = defaultdict(list)
    for i, (key, _) in enumerate(texts):
        ids[root[i]].append(key)
    low = lambda keys: min((k for k in keys if k is not None), default=None)
    want = [(key, low(ids[root[i]]), len(link[i]), len(sets[i])) for i, (key, _) in enumerate(texts)]
    assert order((r.doc_id, r.class_id, r.n_links, r.n_grams) for r in got) == order(want)


def test_one_of_each(docs, rows, empty):
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    sets = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        sets.setdefault(grams(r[1]) or r[0], r[0])
    assert order((i,) for i in ids) == order((v,) for v in sets.values())
    assert one_of_each(empty).count() == 0 and similar_documents(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (60, 50), (50, 60), (70, 60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 70: 50}


# Suffix arrays and repeats


@pytest.mark.parametrize("items", [2, 7, 1000])
def test_induced_sorting(items):
    draw = np.random.default_rng(items)
    for _ in range(120):
        text = np.append(draw.integers(1, draw.integers(2, 6), draw.integers(1, 70)), 0)
        limit = int(draw.choice([0, 5, 100]))
        work = Workspace(items)
        got = list(suffixes(text, work, limit))
        own = text.tolist()
        want = sorted(range(len(own)), key=lambda i: own[i:])
        assert np.concatenate([p for p, _ in got]).tolist() == want
        if limit:
            common = [0]
            for a, b in zip(want, want[1:]):
                k = 0
                while k < min(limit, len(own) - max(a, b)) and own[a + k] == own[b + k]:
                    k += 1
                common.append(k)
            assert np.concatenate([v for _, v in got]).tolist() == common
        work.close()


def plain_repeats(texts, n):
    seen, out = set(), {}
    for key, text in sorted(texts, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - n + 1):
            if data[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(data[p : p + n])
        kept = bytes(c for c, g in zip(data, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[key] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("more", [{}, {"hot_regions": 2}, {"memory_items": 300, "shard_bytes": 5000}])
def test_repeats(spark, rows, more):
    texts = [(r[0], r[1]) for r in rows if r[0] is not None and r[0] not in (20, 21)]
    texts = list({k: (k, t) for k, t in texts}.values())
    texts += [(500, "a" * 333), (501, "a" * 150 + "b" + "a" * 120), (502, (rows[9][1] + " ") * 3), (503, rows[5][1][700:])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    for length in (100, 40):
        params = SuffixParams(length=length, anchor=min(32, length // 3), **more)
        got = {r[0]: tuple(r)[1:] for r in repeats_digest(df, params).collect()}
        assert got == plain_repeats(texts, length)


def test_repeats_with_odd_rows(docs, rows, empty):
    got = repeats_digest(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.n_removed <= r.n_bytes for r in got)
    assert repeats_digest(empty).count() == 0


# WARC


PAGES = "page_id long, url string, html string, path string, digest string, payload binary"


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://h{i}.example/", "<p>%d</p>" % (i % 7), "x", "y", b"z") for i in range(40)]
    rows += [(90, None, None, None, None, None), (91, "u\r\nX: 1", "", None, None, None), (None, "n", "only", None, None, None)]
    rows += [(92, "http://long.example/", "long é " * 300000, None, None, None), rows[3], (93, "x", "WARC/1.1\r\n\r\n", None, None, None)]
    return spark.createDataFrame(rows, PAGES).repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_warc(pages, least):
    got = archived_pages(pages, WarcParams(archive_bytes=2000, revisit_from=least)).collect()
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for page, html in rows:
        if page is not None:
            first[html] = min(first.get(html, page), page)
    want = []
    for page, html in rows:
        later = len(html) >= least and page is not None and first[html] != page
        want.append((
            page, len(html), base64.b32encode(hashlib.sha1(html).digest()).decode(), "revisit" if later else "response",
            first[html] if later else None,
        ))
    assert order((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == order(want)


def test_archives_hold_one_member_then_one_per_record(spark, pages):
    whole = write_monolithic(pages)
    parts = normalised(whole)
    for r in whole.collect():
        with open(r.path.replace("file:", ""), "rb") as source:
            inflate = zlib.decompressobj(31)
            inflate.decompress(source.read())
        assert inflate.eof and not inflate.unused_data
    for r in parts.collect():
        with open(r.path.replace("file:", ""), "rb") as source, open(r.index_path.replace("file:", "")) as index:
            data, lines = source.read(), index.read().splitlines()
        assert len(lines) == r.records
        for line in lines:
            offset, length, kind, name = line.split(" ")
            head = zlib.decompress(data[int(offset) : int(offset) + int(length)], 31)
            assert f"WARC-Type: {kind}".encode() in head and f"WARC-Record-ID: {name}".encode() in head
    assert read_members(parts, payloads=True).where("length(payload) > 1000000").count() == 1
    assert archived_pages(pages.where("false")).count() == 0


def test_cut_archives_are_an_error(spark, pages):
    whole = write_monolithic(pages)
    path = whole.first().path.replace("file:", "")
    with open(path, "rb+") as source:
        source.truncate(200)
    with pytest.raises(Exception, match="ends inside"):
        normalised(whole)


# URLs


URLS = [
    ("http://Www.Example.COM/en/1?x=1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    ("https://a.example.com/de/#top", "a.example.com", "/de/", "com/", "allow"),
    ("x://b.net/fr/2", "b.net", "/fr/2", "net/fr/", "block"),
    ("x://net/es/", "net", "/es/", "net/es/", "block"),
    ("http://notcom/en/", "notcom", "/en/", None, None),
    ("http://a.com", "a.com", "", None, None),
    ("http://a.com?q=/x", "a.com", "", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://é.org/://x", "é.org", "/://x", None, None),
]


def test_url_verdicts(spark):
    df = spark.createDataFrame([(i, u[0], "clash", "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = sorted(url_verdicts(df, RULES).collect())
    for r, (_, host, path, rule, verdict) in zip(got, URLS):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_verdicts(df.where("false"), RULES).count() == 0
    assert {r.verdict for r in url_verdicts(df, ()).collect()} == {"allow"}


def test_trees_learn_lexical_features(spark):
    rows = [(i, f"http://h{i % 9}.example.org/{'7' * (i % 2 * 12)}/{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labelled = df.where("page_id < 400").selectExpr("url", "page_id % 2 AS label")
    got = {r.page_id: r.verdict for r in url_verdicts(df, (), labelled).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(400, 600))


# Decontamination


def plain_contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        words = KEPT.findall((text or "").translate(LOWER))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n and item is not None else 0):
            windows[tuple(words[i : i + n])].add(item)
    out = []
    for key, text in docs:
        words, hit, own = KEPT.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    own |= windows[w]
        names = hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
        out.append((key, len(words), len(hit), len(own), names, bool(hit)))
    return out


@pytest.mark.parametrize("block", [32 << 20, 60])
def test_contamination(docs, rows, benchmark, empty, block):
    params = DecontaminationParams(block_bytes=block)
    want = plain_contamination([(r[0], r[1]) for r in rows], [tuple(r) for r in benchmark.collect()])
    assert any(w[5] for w in want)
    assert order(map(tuple, contamination_digest(docs, benchmark, params).collect())) == order(want)
    kept = decontaminated(docs, benchmark, params)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)
    assert contamination_digest(empty, benchmark, params).count() == 0
    assert not any(r.contaminated for r in contamination_digest(docs, benchmark.where("false"), params).collect())


def test_spans_stand_in_the_original(spark):
    docs = spark.createDataFrame([(1, "Ä ÉÉ: one—TWO,  three ß")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two THREE")], "item_id long, text string")
    text = docs.first().text
    assert [text[s.start : s.end] for s in contamination(docs, items).first().spans] == []
    items = spark.createDataFrame([(1, "one—two, three")], "item_id long, text string")
    assert [text[s.start : s.end] for s in contamination(docs, items).first().spans] == ["one—TWO,  three"]


# Mixing


def test_targets():
    assert targets([100, 100, 100], MixParams()) == [200.0, 250 * 2 / 3, 250 / 3]
    assert targets([], MixParams()) == [] and targets([0, 0], MixParams()) == [0.0, 0.0]
    got = targets([10, 1000, 500, 3], MixParams())
    assert math.isclose(sum(got), 1513 * 1.5) and all(g <= 2 * s for g, s in zip(got, [10, 1000, 500, 3]))


def test_mix(docs, rows, empty):
    params = MixParams(block=16, slots_per_shard=40)
    got = taken_words(plan_mix(docs, params)).collect()
    assert order((r.doc_id, r.source, r.size) for r in got) == order((r[0], r[3], len(WORD.findall(r[1] or ""))) for r in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    sums, goal = Counter(), {}
    for r in got:
        sums[r.source] += r.taken
        goal[r.source] = r.target
    sizes = {s: sum(r["size"] for r in got if r.source == s) for s in goal}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [goal[n] for n in names] == targets([sizes[n] for n in names], params)
    assert all(abs(sums[n] - goal[n]) <= 4 * params.block + 0.02 * goal[n] for n in names)
    again = taken_words(plan_mix(docs.repartition(3), params)).collect()
    assert order(map(tuple, got)) == order(map(tuple, again))
    assert taken_words(plan_mix(empty, params)).count() == 0 and mixed_documents(empty, params).count() == 0


def test_mixed_documents_hold_what_is_taken(docs, rows):
    params = MixParams(block=16, slots_per_shard=40)
    taken, words = Counter(), Counter()
    for r in taken_words(plan_mix(docs, params)).collect():
        taken[r.doc_id] += r.taken
    mixed = mixed_documents(docs, params)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_slots_fill_their_shards(docs):
    params = MixParams(block=16, slots_per_shard=40)
    by_shard = defaultdict(list)
    for r in plan_mix(docs, params).slots.collect():
        by_shard[r.shard].append(r.slot)
    for slots in by_shard.values():
        assert len(set(slots)) == len(slots) and min(slots) >= 0


def test_small_sources_reach_their_targets(spark):
    """Sources below one block, far fewer than one slot per shard each."""
    params = MixParams(slots_per_shard=16)
    rows = [(i, "w " * 1280, f"a{i % 3}") for i in range(12)] + [(100 + i, "x " * 10, f"z{i:03d}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = plan_mix(docs, params)
    taken, goal, size = Counter(), {}, Counter()
    for r in taken_words(mix).collect():
        taken[r.source] += r.taken
        goal[r.source], size[r.source] = r.target, r.source_size
    full = [s for s in goal if goal[s] == 2 * size[s]]
    assert len(full) > 50 and all(taken[s] == goal[s] for s in full)
    tail = [s for s in goal if s[0] == "z"]
    assert abs(sum(taken[s] for s in tail) / sum(goal[s] for s in tail) - 1) < 0.1
    assert all(abs(taken[s] - goal[s]) < min(64, size[s]) for s in goal)
    shards = Counter(r.shard for r in mix.slots.collect())
    assert sorted(shards) == list(range(len(shards))) and max(shards.values()) - min(shards.values()) <= 1
    assert max(shards.values()) <= 16


def test_cut_words():
    assert cut_words(" a  b\nc d ", [(0, 2), (3, 4)]) == "a  b d"
