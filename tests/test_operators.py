from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions import languages
from corpusmill.operators import (
    ancestry,
    audit,
    candidates,
    identity,
    manifest,
    packaging,
    profile,
    redaction,
    repos,
    runlog,
    transcripts,
)
from corpusmill.params import BudgetParams, CandidateParams, TranscriptParams
from corpusmill.sources import materialize


def files_of(spark, rows):
    return spark.createDataFrame([(r, p, bytearray(c), len(c)) for r, p, c in rows], schemas.FILES)


def test_language_profile(spark):
    files = files_of(
        spark,
        [
            ("r", "a.php", b"x\n" * 51), ("r", "b.js", b"y\n" * 10), ("r", "c.png", b"\0"),
            ("r", "node_modules/z.js", b"n\n" * 1000), ("r", ".git/c.xml", b"x\n"), ("r", "u.zzz", b"q"),
            ("r", "d.json", b"\0\n"), ("r", "vendor", b"x"), ("t", "a.go", b"1\n" * 5), ("t", "b.py", b"1\n" * 5),
            ("e", "empty.py", b""),
        ],
    )
    rows = {
        r.repo_url: r
        for r in profile.language_profile(profile.language_counts(files), files.select("repo_url")).collect()
    }
    assert rows["r"].counts == {"PHP": 51, "JavaScript": 10}
    assert (rows["r"].total, rows["r"].primary, rows["r"].source) == (61, "PHP", "walk")
    assert rows["t"].primary == "Go"
    assert (rows["e"].total, rows["e"].primary, rows["e"].source) == (0, None, "empty")


def test_focus_language(spark):
    cases = {
        "css": {"CSS": 600, "SVG": 200, "PHP": 150, "JavaScript": 50},
        "untracked": {"JSON": 500, "Solidity": 300, "Markdown": 150, "Go": 50},
        "none": {"CSS": 5, "HTML": 5}, "tie": {"PHP": 300, "Go": 300, "CSS": 400},
        "floor": {"Go": 30, "CSS": 970}, "xaml": {"XAML": 600, "C#": 400},
    }
    counts = spark.createDataFrame(
        [(k, lang, n) for k, v in cases.items() for lang, n in v.items()],
        "repo_url string, language string, lines bigint",
    )
    got = {r.repo_url: r.code_primary for r in profile.language_profile(counts).collect()}
    assert got == {"css": "PHP", "untracked": "Go", "none": None, "tie": "Go", "floor": None, "xaml": "C#"}


def test_distribution_keeps_small_shares_from_one_percent(spark):
    lines = {f"L{i}": 100 - i for i in range(9)} | {"tiny": 1}
    counts = spark.createDataFrame(
        [("r", k, n) for k, n in lines.items()], "repo_url string, language string, lines bigint"
    )
    text = profile.distribution_text(profile.language_profile(counts)).first().distribution
    assert text.split("\n")[0] == f"- L0: {100 / sum(lines.values()):.1%}"
    assert len(text.split("\n")) == 9 and "tiny" not in text


def test_repository_list(spark):
    lines = [" a ", "# c", "", "b", " # kept", "a"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, value string")
    got = [(r.repo_url, r.line_no) for r in repos.repository_list(df).orderBy("line_no").collect()]
    assert got == [("a", 0), ("b", 3), ("# kept", 4)]


def test_latest_branch(spark):
    df = spark.sql(
        """SELECT * FROM VALUES ('r', 'o/main', timestamp'2020-01-01', 's1'), ('r', 'o/feature/x', timestamp'2022-01-01', 's2'),
        ('r', 'o/HEAD', timestamp'2023-01-01', 's3'), ('r', 'o/z', timestamp'2022-01-01', 's4')
        AS t(repo_url, refname, committer_ts, tip_sha)"""
    )
    assert repos.latest_branch(df).first().refname == "o/feature/x"


def test_pending_repositories(spark):
    done = spark.createDataFrame([("a", 5000), ("b", 0), ("c", None)], "repo_url string, total_loc bigint")
    todo = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "repo_url string")
    got = repos.pending_repositories(todo, done).collect()
    assert sorted(r.repo_url for r in got) == ["b", "c", "d"]
    assert repos.pending_repositories(todo, done, force=True).count() == 4


def test_identity(spark):
    chain = [f"{i:040x}" for i in range(12)]
    rows = [
        ("https://h/g/s/r.git", sha, [chain[i - 1]] if i else [], 11 - i, True) for i, sha in enumerate(chain)
    ] + [("https://h/g/s/r.git", "f" * 40, [chain[3]], -1, False)]
    row = identity.repository_identity(spark.createDataFrame(rows, schemas.COMMITS)).first()
    assert row.first_commit_hash == chain[0]
    assert row.early_commit_hashes == ",".join(chain[:10])
    assert (row.head_commit_sha, row.repo_org, row.repo_name) == (chain[11], "g/s", "r")
    assert len(row.commit_minhash.split(",")) == 32


def test_ancestry_matches_graph_walk(spark):
    rng = random.Random(3)
    commits, heads = [], []
    for r in range(5):
        for i in range(60):
            parents = [] if i == 0 or rng.random() < 0.03 else [i - 1 if rng.random() < 0.7 else rng.randrange(i)]
            if i > 2 and rng.random() < 0.15:
                parents = sorted({*parents, rng.randrange(i)})
            commits.append((f"r{r}", str(i), [str(p) for p in parents]))
        heads.append((f"r{r}", str(rng.randrange(30, 60))))
    parents = {(r, s): p for r, s, p in commits}
    want = set()
    for r, s in heads:
        todo = [s]
        while todo:
            s = todo.pop()
            if (r, s) not in want:
                want.add((r, s))
                todo += parents[r, s]
    got = ancestry.ancestors_of_heads(
        spark.createDataFrame(commits, "repo_url string, sha string, parents array<string>"),
        spark.createDataFrame(heads, "repo_url string, sha string"),
    )
    rows = got.collect()
    assert len(rows) == len(commits)
    assert {(r.repo_url, r.sha) for r in rows if r.on_head} == want


def test_a_thousand_merges_take_few_rounds(spark, monkeypatch):
    n, rounds = 1000, []
    commits = [("r", "m0", []), ("r", "s0", ["m0"])]
    for i in range(1, n):
        commits += [("r", f"m{i}", [f"m{i - 1}", f"s{i - 1}"]), ("r", f"s{i}", [f"s{i - 1}", f"m{i - 1}"])]
    commits += [("r", "x", ["m500"]), ("r", "y", ["x", "gone"])]
    written, before = ancestry.materialized, len(materialize._made)
    monkeypatch.setattr(ancestry, "materialized", lambda df, name: rounds.append(name) or written(df, name))
    got = ancestry.ancestors_of_heads(
        spark.createDataFrame(commits, "repo_url string, sha string, parents array<string>"),
        spark.createDataFrame([("r", f"m{n - 1}")], "repo_url string, sha string"),
    )
    found = {r.sha: r.on_head for r in got.collect()}
    assert found == {s: s[0] in "ms" and s != f"s{n - 1}" for _, s, _ in commits}
    assert rounds.count("moved-marks") < 10 and rounds.count("jumps") < 14
    assert len(materialize._made) == before + 2  # places and marks, which the result reads


def saved_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "repo_url string, rank bigint, path string, layer string, loc_taken bigint, is_partial boolean, language string",
    )


def test_rollup_and_summary(spark):
    saved = saved_rows(
        spark,
        [
            ("r", 2, "b.go", "test", 40, False, "Go"), ("r", 1, "a.php", "business", 40, True, "PHP"),
            ("r", 3, "c.css", "infra", 100, False, "CSS"), ("r", 4, "odd", "util", 20, False, ""),
        ],
    )
    primaries = spark.createDataFrame([("r", "PHP")], "repo_url string, primary string")
    rollup = manifest.sample_rollup(saved, primaries)
    row = manifest.sample_shares(manifest.with_summary(rollup)).first()
    assert (row.total_loc, row.file_count, row.main_language) == (200, 4, "PHP")
    assert (row.test_share, row.logic_share, row.low_value_share, row.primary_share) == (0.2, 0.2, 0.5, 0.2)
    assert row.sample_lang_distribution == {"PHP": 0.2, "Go": 0.2, "CSS": 0.5, "Unknown": 0.1}
    assert [f["path"] for f in row.files] == ["a.php", "b.go", "c.css", "odd"]
    assert row.repo_summary.startswith("**Main language:** PHP\n\n# Sample of a repository")
    assert "By layer: infra: 50%, business: 20%, test: 20%, util: 10%" in row.repo_summary
    own = spark.createDataFrame([("r", "**Main language:** PHP\n\nmine")], "repo_url string, summary string")
    assert manifest.with_summary(rollup, own).first().repo_summary == "**Main language:** PHP\n\nmine"


def test_validation(spark):
    rows = [
        ("empty", 0, "JavaScript", 0, True), ("none", 5000, "JavaScript", 0, True),
        ("ten", 5000, "JavaScript", 500, True), ("thirty", 5000, "JavaScript", 1500, True),
        ("soft", 5000, "JavaScript", 100, False), ("close", 1000, "JavaScript", 196, True),
    ]
    df = spark.createDataFrame(
        rows, "repo_url string, total_loc bigint, primary string, primary_loc bigint, primary_forced boolean"
    )
    got = {r.repo_url: (r.stage, r.error) for r in manifest.validate_results(df).collect()}
    assert got["empty"][0] == "agent_empty"
    assert got["ten"] == (
        "agent_no_primary_lang", "primary language 'JavaScript': 500 LOC (10%) below the 20% minimum",
    )
    assert "(19%)" in got["close"][1] and got["none"][0] == "agent_no_primary_lang"
    assert got["thirty"] == got["soft"] == (None, None)


def test_upsert_and_flat(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "repo_url string, total_loc bigint")
    new = spark.createDataFrame([("b", 3)], "repo_url string, total_loc bigint")
    once = manifest.upserted(old, new)
    twice = manifest.upserted(once, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 3)]
    record = spark.createDataFrame([("u",)], "repo_url string").select(
        "repo_url",
        *[F.lit(None).cast(t).alias(n) for n, t in (("repo_name", "string"), ("language", "string"),
          ("total_loc", "bigint"), ("file_count", "bigint"), ("test_share", "double"), ("repo_summary", "string"),
          ("files", f"array<{schemas.SAVED_FILE}>"), ("meta", schemas.MANIFEST_META),
          ("sample_lang_distribution", "map<string,double>"))],
    )
    flat = manifest.flat_manifest(record).first()
    assert tuple(flat) == ("u", "", "", 0, 0, 0.0, "", "[]", "{}", "{}")


def test_redaction(spark):
    text = (
        'mail bob@corp.io or git@host.corp.io\ntoken = "24be64439e3e49cf46b2d7c90f36"\n'
        "see https://user:pw@intra.corp.io/x?y=1 and www.corp.io\ncall +1 (743) 555-3824\n"
        "Globex Corp makes Globex; Globexia does not. Привет, Иван Петров!\n"
    )
    texts = spark.createDataFrame([("f", "p", text), ("g", "q", text)], "folder string, path string, text string")
    names = spark.createDataFrame(
        [("Globex", "company", "f"), ("Globex Corp", "company", "f"), ("Иван Петров", "person", "f"),
         ("Globex", "product", "g")],
        "name string, kind string, folder string",
    )
    rows = {r.folder: r.redacted for r in redaction.redacted(texts, names).collect()}
    assert rows["f"] == (
        'mail user@example.com or user@example.com\ntoken = "REDACTED"\n'
        "see https://user:REDACTED@example.com/x?y=1 and example.com\ncall +1-555-0100\n"
        "Acme makes Acme; Globexia does not. Привет, John Doe!\n"
    )
    assert "AppName Corp makes AppName; Globexia" in rows["g"] and "Иван Петров" in rows["g"]
    again = spark.createDataFrame([("f", "p", rows["f"])], "folder string, path string, text string")
    assert redaction.redacted(again, names).first().redacted == rows["f"]


def test_names_are_replaced_in_one_pass(spark):
    names = spark.createDataFrame(
        [("John Smith", "person"), ("John", "person"), ("example", "product"), ("a\\E.*", "company"), ("Doe", "company")],
        "name string, kind string",
    )
    text = "John Smith met John. example user@corp.de and a\\E.* password='x1' Bearer abc.def ghp_" + "a" * 36
    once = redaction.redacted(spark.createDataFrame([("f", "p", text)], "folder string, path string, text string"), names)
    got = once.first().redacted
    assert got == (
        "John Doe met John Doe. AppName user@example.com and Acme password='REDACTED' Bearer REDACTED REDACTED"
    )
    again = redaction.redacted(once.select("folder", "path", F.col("redacted").alias("text")), names)
    assert again.first().redacted == got
    with pytest.raises(Exception, match="unknown kind"):
        redaction.redacted(once, names.withColumn("kind", F.lit("planet"))).collect()


def test_audit_against_a_line_diff(spark):
    rng = random.Random(5)
    rows = []
    for n in range(60):
        before = [f"line {i}" for i in range(rng.randrange(1, 60))]
        after = [f"changed {i}" if rng.random() < 0.12 else line for i, line in enumerate(before)]
        rows.append(("f", str(n), "\n".join(before) + "\n", "\n".join(after) + "\n"))
    rows.append(("f", "gap6", "a\n" * 9, "b\n" + "a\n" * 6 + "b\n" + "a\n"))
    rows.append(("f", "gap7", "a\n" * 9, "b\n" + "a\n" * 7 + "b\n"))
    pairs = spark.createDataFrame(rows, "folder string, path string, before string, after string")
    changes = audit.file_changes(pairs)
    got = {r.path: (r.hunks, r.additions, r.deletions) for r in changes.collect()}
    for _, path, before, after in rows:
        diff = list(difflib.unified_diff(before.splitlines(), after.splitlines(), n=3, lineterm=""))[2:]
        want = (
            sum(line.startswith("@@") for line in diff),
            sum(line.startswith("+") for line in diff), sum(line.startswith("-") for line in diff),
        )
        assert got.get(path, (0, 0, 0)) == want
    assert got["gap6"][0] == 1 and got["gap7"][0] == 2
    assert audit.folder_report(changes).first().files_changed == len(got)


def test_packaging(spark):
    records = spark.createDataFrame(
        [("f1", 10, 2, ("t",)), ("f2", 5, 1, (None,))],
        "folder_name string, total_loc bigint, file_count bigint, meta struct<sampled_at:string>",
    )
    ids = spark.createDataFrame(
        [("f1", "root", "early", "mh", "url", "org", "name", "head")],
        "folder string, first_commit_hash string, early_commit_hashes string, commit_minhash string, "
        "repo_url string, repo_org string, repo_name string, head_commit_sha string",
    )
    index = packaging.sample_index(records, ids, "9.9")
    assert tuple(index.columns) == schemas.INDEX_COLUMNS
    rows = {r.folder: tuple(r) for r in index.collect()}
    assert rows["f1"] == ("f1", "name", "org", "url", "root", "early", "mh", "10", "2", "t", "head", "9.9")
    assert rows["f2"] == ("f2", "", "", "", "", "", "", "5", "1", "", "", "9.9")
    bad = spark.createDataFrame([("f1",), ("f1",), ("..",), ("a/b",), (None,)], "folder_name string")
    have = spark.createDataFrame([("f1",)], "folder string")
    problems = packaging.index_problems(bad, have).collect()
    assert ("f1", "duplicate_folder") in {tuple(p) for p in problems}
    assert sorted(p.folder for p in problems if p.problem == "invalid_folder") == ["", "..", "a/b"]
    assert [r.folder for r in packaging.missing_identity(records, ids).collect()] == ["f2"]


def test_bundle(spark):
    rows = [("f", "samples/b.py", 1, False), ("f", "repo_summary.md", 2, False), ("f", "agent_log.json", 3, False),
            ("f", "samples/a.py", 4, False), ("f", "samples/link", 0, True)]
    df = spark.createDataFrame(rows, "folder string, path string, size bigint, is_symlink boolean")
    got = packaging.bundle_entries(df).orderBy("folder", "section", "entry_path").collect()
    assert [r.entry_path for r in got] == ["samples/f/repo_summary.md", "samples/f/samples/a.py", "samples/f/samples/b.py"]


def messages_of(spark, rows):
    full = [(1, i, role, content, f"call_{i}" if role == "tool" else None, calls) for i, (role, content, calls) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.MESSAGES)


def test_compaction(spark):
    rows = [("tool", c * 500, None) for c in "abcdef"] + [("assistant", "old", None)] * 2 + [("assistant", "new", None)] * 3
    messages = messages_of(spark, rows)
    once = transcripts.compacted(messages)
    got = [r.content for r in once.orderBy("pos").collect()]
    assert got[:4] == [c * 150 + "\n[truncated]" for c in "abcd"] and got[4:6] == ["e" * 500, "f" * 500]
    assert got[6:] == [None, None, "new", "new", "new"]
    assert [r.content for r in transcripts.compacted(once).orderBy("pos").collect()] == got


def test_rendering_parts_join_to_the_whole(spark):
    call = [("c1", "bash", '{"command": "ls"}')]
    rows = [("system", "s", None), ("assistant", None, call), ("tool", "out", None), ("user", "u", None)]
    messages = messages_of(spark, rows)
    whole = transcripts.rendered(messages, "- bash: x").first().prompt
    assert whole.startswith("Tools at hand:\n- bash: x\n\nMessages, oldest first:\n[system]\ns\n[assistant]\n\n")
    assert '[assistant tool call c1] bash({"command": "ls"})\n[tool result for call_2]\nout\n[user]\nu\n\nWrite' in whole
    parts = transcripts.rendered(messages, "- bash: x", TranscriptParams(messages_per_part=2)).orderBy("part").collect()
    assert len(parts) == 2 and "\n".join(p.prompt for p in parts) == whole


def test_turns(spark):
    good = '{"name":"bash","arguments_json":"{}"}'
    cases = {
        f'{{"content":"a","tool_calls":[{good}]}}': None, '{"content":null,"tool_calls":[]}': None,
        '{"content":"a"}': "missing_tool_calls", '{"tool_calls":{}}': "missing_tool_calls", "[]": "missing_tool_calls",
        "{": "missing_tool_calls", f'{{"tool_calls":[{good},"x"]}}': "call_not_object",
        '{"tool_calls":[{"name":3,"arguments_json":"{}"}]}': "call_without_name",
        '{"tool_calls":[{"name":"b","arguments_json":{}}]}': "invalid_arguments",
        '{"tool_calls":[{"name":"b"}]}': "invalid_arguments",
        '{"tool_calls":[{"name":"b","arguments_json":"[]"}]}': "arguments_not_object",
        '{"tool_calls":[{"name":"b","arguments_json":"nope"}]}': "invalid_arguments",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "turn_id int, payload string")
    rows = transcripts.validated_turns(df).orderBy("turn_id").collect()
    assert [r.reason for r in rows] == list(cases.values())
    assert rows[0].finish_reason == "tool_calls" and rows[0].tool_calls[0].id == "call_0"
    assert rows[1].finish_reason == "stop" and rows[1].content == ""


def test_error_classes(spark):
    cases = {"exit 1: 403 Forbidden": "auth", "14030": "other", "usage limit": "auth", "timeout": "retryable", "x": "other"}
    df = spark.createDataFrame([("r", "agent", e) for e in cases], "repo_url string, stage string, error string")
    got = df.select(transcripts.cli_error_class(F.col("error"))).collect()
    assert [r[0] for r in got] == list(cases.values())
    http = spark.sql("SELECT * FROM VALUES (402, false, true), (503, false, true), (200, false, false), (200, false, true), (418, false, true) AS t(s, t, j)")
    got = http.select(transcripts.http_error_class(F.col("s"), F.col("t"), F.col("j"))).collect()
    assert [r[0] for r in got] == ["auth", "retryable", "retryable", "ok", "other"]


def flags(spark, saves, primary, hard, **params):
    rows = [(1, t, loc > 0, loc, layer, lang) for t, loc, layer, lang in saves]
    df = spark.createDataFrame(rows, "run_id int, turn bigint, saved boolean, loc bigint, layer string, language string")
    goals = spark.createDataFrame([(1, primary, hard)], "run_id int, primary string, hard boolean")
    out = runlog.progress_flags(df, goals, BudgetParams(**params)).orderBy("turn").collect()
    return [(r.turn, r.flag) for r in out]


def test_progress_flags(spark):
    idle = [(t, 0, "util", "Go") for t in range(6)]
    assert flags(spark, idle, None, False) == [(3, "URGENT"), (4, "URGENT"), (5, "URGENT")]
    small = dict(target_loc=20, tolerance_loc=2, cap_loc=45)
    start = [(0, 40, "business", "Go")] + [(t, 0, "util", "Go") for t in range(1, 4)]
    # 10 more lines needed, 5 lines of room.
    assert flags(spark, start, "PHP", True, **small) == [(1, "ABORT")]
    soft = [(0, 10, "business", "Go"), (1, 0, "util", "Go")] + [(t, 0, "util", "Go") for t in range(2, 9)]
    got = flags(spark, soft, "PHP", False, target_loc=20, tolerance_loc=2, cap_loc=11)
    assert got == [(5, "STALLED"), (6, "STALLED"), (7, "STALLED"), (8, "STALLED")]
    dull = [(0, 15, "boilerplate", "Go")] + [(t, 0, "util", "Go") for t in range(1, 4)]
    assert flags(spark, dull, "Go", False, **small) == [(1, "LOGIC_LOW")]
    assert flags(spark, start, "Go", False, **small)[0] == (1, "STOP")


def test_run_totals(spark):
    results = spark.createDataFrame([("a", 5), ("b", 0)], "repo_url string, total_loc bigint")
    errors = spark.sql("SELECT 'b' AS repo_url, 'agent' AS stage, 'bad\n thing' AS error, timestamp'2024-01-01' AS ts")
    assert tuple(runlog.run_totals(results, errors).first()) == (1, 2, 1, 5, "bad thing")


def test_candidates_take_turns(spark):
    rows = [(f"r", f"{m}/f{i}.py", b"x\n" * 120) for m in ("a", "b") for i in range(3)]
    rows += [("r", "tests/test_a.py", b"x\n" * 120), ("r", "a/gen/z.py", b"x\n" * 120), ("r", "a/s.py", b"x\n" * 5)]
    tagged = candidates.tagged_layers(candidates.file_features(files_of(spark, rows)))
    got = [r.path for r in candidates.candidate_requests(tagged).orderBy("seq").collect()]
    assert got == ["a/f0.py", "b/f0.py", "a/f1.py", "b/f1.py", "a/f2.py", "tests/test_a.py", "b/f2.py"]


def test_candidates_are_numbered_before_any_cut(spark):
    rows = [("r", f"a/f{i:02d}.py", b"x\n" * 5) for i in range(20)] + [("r", "a/z0.py", b"x\n" * 3)]
    rows += [("r", f"b/f{i:02d}.py", b"x\n" * 4) for i in range(4)] + [("r", "b/y0.py", b"x\n" * 3)]
    tagged = candidates.tagged_layers(candidates.file_features(files_of(spark, rows)))
    small = CandidateParams(min_loc=1, preferred_min_loc=1, preferred_max_loc=10, partial_above_loc=20)
    wanted = candidates.candidate_requests(tagged, params=small).orderBy("seq").collect()
    assert len(wanted) == len(rows)
    left, took, loc = 12, [], {r[1]: len(r[2]) // 2 for r in rows}
    for r in wanted:
        if loc[r.path] <= left:
            left -= loc[r.path]
            took.append(r.path)
    assert took == ["a/f00.py", "b/f00.py", "b/y0.py"]


def test_runs_without_saves_are_flagged(spark):
    saves = spark.createDataFrame([("a", 0, True, 5, "util", "Go")], "run_id string, turn int, saved boolean, loc bigint, layer string, language string")
    goals = spark.createDataFrame([("a", None, False, 9), ("b", None, False, 6)], "run_id string, primary string, hard boolean, turns int")
    got = runlog.progress_flags(saves, goals, BudgetParams(target_loc=50, tolerance_loc=5, cap_loc=90)).collect()
    assert [r.turn for r in sorted(got) if r.run_id == "b"] == [3, 4, 5] and {r.flag for r in got if r.run_id == "b"} == {"URGENT"}
    assert [(r.turn, r.flag) for r in sorted(got) if r.run_id == "a"] == [(t, "STALLED") for t in (5, 6, 7, 8)]


def test_unknown_language_is_refused():
    assert languages.spelled_language(" python ") == "Python" and languages.spelled_language(None) is None
    with pytest.raises(ValueError, match="unknown language"):
        languages.spelled_language("klingon")


def test_audit_aligns_added_and_removed_lines(spark):
    draw, pairs = random.Random(8), [("f", "p", "a\nb\nc\nd\ne\n", "new\na\nb\nc\nd\ne\n"), ("f", "n", None, "x\ny\n")]
    for i in range(30):
        old = [f"line {draw.randrange(15)}" for _ in range(draw.randrange(1, 40))]
        new = list(old)
        for _ in range(draw.randrange(1, 4)):
            at = draw.randrange(len(new) + 1)
            new[at : at + draw.randrange(2)] = [f"more {draw.randrange(9)}"] * draw.randrange(3)
        if len(old) != len(new):
            pairs.append(("g", f"{i}", "\n".join(old) + "\n", "\n".join(new) + "\n" if new else ""))
    got = audit.file_changes(spark.createDataFrame(pairs, "folder string, path string, before string, after string"))
    want = set()
    for folder, path, old, new in pairs:
        lines = list(difflib.unified_diff((old or "").split("\n")[:-1], new.split("\n")[:-1], lineterm="", n=3))[2:]
        want.add((
            folder, path, sum(x.startswith("@@") for x in lines), sum(x[0] == "+" for x in lines), sum(x[0] == "-" for x in lines)
        ))
    assert {tuple(r)[:5] for r in got.collect()} == want
    assert ("f", "p", 1, 1, 0) in want
