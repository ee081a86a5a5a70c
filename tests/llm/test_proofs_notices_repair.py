"""Merkle proofs, notice search and turn repair against plain code."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from corpusmill.llm.dialogue_repair import RepairParams, damaged, edits, judged, repair_digest, repaired
from corpusmill.llm.license_notices import NOTICES, Notice, Searcher, license_digest, normalised, notice_spans
from corpusmill.llm.merkle import manifest_digest, merkle_manifest
from tests.llm.conftest import SCHEMA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more: int = 0) -> str:
    doc_id, text, lang, source, n_chars = row[:5]
    return digest("".join(map(field, (doc_id, source, lang, None if n_chars is None else n_chars + more, text))))


def tree(nodes):
    """Root, and per node its (left, sibling) pairs upwards."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            path.append((i % 2, level[i ^ 1] if i ^ 1 < len(level) else None))
        at = [i // 2 for i in at]
        level = [digest("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
    return level[0], paths


def manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is None, r[0] or 0, leaf_of(r))) for x in langs}
    trees = {x: tree([leaf_of(r) for r in group]) for x, group in groups.items()}
    root, upper = tree([trees[x][0] for x in langs])
    out = []
    for lang, above in zip(langs, upper, strict=True):
        for row, path in zip(groups[lang], trees[lang][1], strict=True):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf_of(row, 1 if hit else 0)
            for left, sibling in path + above:
                node = digest((sibling + node) if left else node + (sibling or ""))
            proof = digest("".join(s for _, s in path + above if s))
            out.append((row[0], leaf_of(row), trees[lang][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def proven(frame, band=8):
    return sorted(map(tuple, manifest_digest(frame, band).collect()), key=repr)


@pytest.mark.parametrize("band", [2, 8])
def test_proofs_lead_to_the_root(spark, band):
    draw = random.Random(1)
    rows = [
        (i, f"text {i} é", draw.choice([None, "en", "de", "é", ""]), draw.choice([None, "a"]), draw.choice([None, 5]))
        for i in range(300)
    ]
    rows += [(None, None, "en", None, None), (5, "x", "en", None, 1), (5, "x", "en", None, 1), (6, "", "one", "", 2**63 - 1)]
    assert proven(spark.createDataFrame(rows, DOCS).repartition(3), band) == manifest(rows)


def test_one_leaf_per_group_and_one_group(spark):
    rows = [(i, "t", str(i), None, i) for i in range(5)]
    assert proven(spark.createDataFrame(rows, DOCS)) == manifest(rows)
    rows = [(1, "t", None, None, None)]
    got = proven(spark.createDataFrame(rows, DOCS))
    assert got == manifest(rows) and got[0][3] == leaf_of(rows[0]) and got[0][4] == digest("")


def test_manifest_with_clashing_columns(docs, rows, empty):
    assert proven(docs) == manifest(rows)
    assert merkle_manifest(empty).collect() == [] and manifest_digest(empty).collect() == []
    clash = docs.selectExpr("*", "1 as position", "2 as `group`", "3 as hash", "4 as path", "5 as parent", "6 as nodes")
    assert proven(clash) == manifest(rows)


def test_tampering_is_found(spark):
    frame = spark.createDataFrame([(i, "t", "en", "a", i) for i in range(64)], DOCS)
    got = manifest_digest(frame).collect()
    hit = {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
    assert hit and {r.doc_id for r in got if not r.verified} == hit


# License notices


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def all_spans(words: str):
    """Every word-aligned span within the errors of a notice that holds its required words."""
    starts = [0] + [i + 1 for i, c in enumerate(words) if c == " "]
    ends = [i for i, c in enumerate(words) if c == " "] + [len(words)]
    out = {}
    for number, n in enumerate(NOTICES):
        for a in starts:
            for e in ends:
                span = words[a:e]
                if a < e and abs(e - a - len(n.phrase)) <= n.errors and set(n.required) <= set(span.split()):
                    d = distance(span, n.phrase)
                    if d <= n.errors:
                        out.setdefault(number, set()).add((d, a, e))
    return out


def test_search_finds_what_brute_force_finds():
    draw, searcher, total = random.Random(5), Searcher(), 0
    for _ in range(150):
        parts = []
        for _ in range(draw.randrange(1, 4)):
            letters = list(draw.choice(NOTICES).phrase)
            for _ in range(draw.randrange(0, 4)):
                i, kind = draw.randrange(len(letters)), draw.randrange(3)
                letters[i : i + (kind > 0)] = [] if kind == 2 else [draw.choice("abc et")]
            parts.append(draw.choice(["The ", "ab ", "under ", "é "]) + "".join(letters))
        words, found = normalised(" ".join(parts).encode()), {}
        for start, end, number, edits_ in searcher.spans(words):
            found.setdefault(number, set()).add((edits_, start, end))
        want = all_spans(words)
        assert set(found) == set(want)
        for number, spans in found.items():
            assert spans <= want[number] and min(spans) == min(want[number])
            assert {s for s in spans if not s[0]} == {s for s in want[number] if not s[0]}
            total += len(spans)
    assert total > 150


def test_license_counts_and_places(docs, rows, empty):
    words_of = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    base = [n for n in NOTICES if n.base]
    extra = [
        (90, "Released UNDER the-MIT license!\nx under tha MIT license; cc by-nc 4.0 CC BY NC", "en", "a", 1, 1, 1, 1, 1.0),
        (91, "É. Apache License, Version 2.0 and apache licence version 2 " + "w " * 50_000 + "CC BY NC", "en", "a", 1, 1, 1, 1, 1.0),
        (92, "under the mpl license, apache license version 11, not  accbync", "en", "a", 1, 1, 1, 1, 1.0),
    ]
    frame = docs.unionByName(docs.sparkSession.createDataFrame(extra, SCHEMA))
    got = license_digest(notice_spans(frame)).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = []
    for row in [*rows, *extra]:
        words = words_of.findall((row[1] or "").translate(lower))
        places = [
            (i, n.label) for n in base for i in range(len(words)) if words[i : i + len(n.phrase.split())] == n.phrase.split()
        ]
        first, last = (min(places)[0], max(places)[0]) if places else (None, None)
        want.append((row[0], len(words), len(places), first, last, ",".join(sorted({p[1] for p in places}))))
    fields = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((tuple(r[f] for f in fields) for r in got), key=repr) == sorted(want, key=repr)
    by_id = {r.doc_id: r for r in got if r.doc_id in (90, 91, 92)}
    assert by_id[90].labels == "cc-by-nc,mit" and by_id[90].score == 1.0
    assert [s.edits for s in by_id[90].spans if s.label == "mit"] == [0, 1]
    for row in extra:
        for span in by_id[row[0]].spans:
            part = " ".join(words_of.findall(row[1][span.start : span.end].translate(lower)))
            assert distance(part, span.notice) == span.edits and len(part.split()) == span.n_words
    assert by_id[92].labels == "" and by_id[92].score == 0.0
    assert license_digest(notice_spans(empty)).collect() == []


def test_notices_are_checked():
    with pytest.raises(ValueError):
        Searcher((Notice("x", "two  blanks", 0),))
    with pytest.raises(ValueError):
        Searcher((Notice("x", "ab", 2),))


# Turn repair

CONVERSATIONS = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def mended(rows):
    """Every conversation's digest by a plain recursion over whole audits."""
    groups = {}
    for conv, turn, role, text in rows:
        out = groups.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return sorted((_mended(conv, group) for conv, group in groups.items()), key=repr)


def _mended(conv, rows):
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(BLANK)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else None if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    after = {}
    for i in range(len(rows), -1, -1):
        here = {}
        for state, want in NEXT.items():
            here[state] = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
            if i < len(rows):
                late = 5 if faults[i] == "truncated" else 0
                _, role, text = rows[i]
                cost, audit, lines = after[state]
                here[state].append((cost + 2, "D" + audit, lines))
                if faults[i] in (None, "truncated"):
                    if role[:1] == want or (state == "" and role[:1] == "s"):
                        cost, audit, lines = after[role[:1]]
                        here[state].append((cost + late, "K" + audit, (f"{role}:{text}", *lines)))
                    cost, audit, lines = after[want]
                    here[state].append((cost + late + 1, "R" + audit, (f"{NAMES[want]}:{text}", *lines)))
        for _ in range(4):
            for state, want in NEXT.items():
                if here[want]:
                    cost, audit, lines = min(here[want])
                    here[state].append((cost + 5, "I" + audit, (f"{NAMES[want]}:", *lines)))
        after = {state: min(found) for state, found in here.items()}
    cost, audit, lines = after[""]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return conv, gaps, *counts, illegal, cost, audit, digest("\n".join(lines))


def talk(n, conversations, seed):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Hi.", "what?", "cut", "x y.  \n", " ", None, "", "A!", "B. ", "C.", "D.", "E.", "F. ", "G"]
    ids, turns = [None, *range(conversations)], [None, *range(n // conversations + 3)]
    return [(draw.choice(ids), draw.choice(turns), draw.choice(roles), draw.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize(
    "n, conversations, params", [(600, 100, RepairParams()), (300, 5, RepairParams(3, 2)), (300, 1, RepairParams(5, 3))]
)
def test_repairs_are_the_cheapest_and_least(spark, n, conversations, params):
    rows = talk(n, conversations, n + conversations)
    frame = spark.createDataFrame(rows, CONVERSATIONS).repartition(3)
    assert sorted(map(tuple, repair_digest(frame, params).collect()), key=repr) == mended(rows)


def test_conversations_that_damage_empties(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, None, None, None)]
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    got = sorted(map(tuple, repair_digest(frame).collect()), key=repr)
    assert got == mended(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", digest("")) in got
    assert repair_digest(frame.limit(0)).collect() == []


def test_long_text_and_clashing_columns(spark):
    rows = [(2**40, i, "user" if i % 2 == 0 else "assistant", f"{i} " + "long text " * 30_000 + ".") for i in range(5)]
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    clash = frame.selectExpr("*", "1 as position", "2 as block", "3 as fault", "4 as step", "5 as `_copy`", "6 as codes")
    assert sorted(map(tuple, repair_digest(clash).collect()), key=repr) == mended(rows)


def test_repaired_rows_have_the_pattern(spark):
    rows = judged(damaged(spark.createDataFrame(talk(200, 20, 9), CONVERSATIONS)))
    found, _ = edits(rows, RepairParams(4, 2))
    roles = {}
    for r in sorted(repaired(rows, found).collect(), key=lambda r: (str(r.conv_id), r.block, r.step)):
        roles.setdefault(r.conv_id, []).append("" if r.role is None else r.role[:1])
    assert len(roles) > 10 and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in roles.values())
