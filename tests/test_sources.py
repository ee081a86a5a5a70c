from __future__ import annotations

import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.operators.audit import audit_records
from corpusmill.operators.profile import language_counts
from corpusmill.plans import delivery
from corpusmill.plans.sampling import sample_repositories
from corpusmill.params import BudgetParams, CandidateParams, ScanParams, Settings
from corpusmill.sources import readers, trees, writers
from corpusmill.operators.repos import tree_file_counts
from corpusmill.sources.trees import WorkingTrees, working_trees, write_working_trees
from corpusmill.sources.materialize import drop_intermediates, materialized, shared_folder

SMALL = "repo_url string, total_loc bigint"


def test_numbered_lines_over_many_splits(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(3000)]
    (tmp_path / "list.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "other.txt").write_text("a\nb\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = readers.numbered_lines(spark, str(tmp_path))
        rows = [r for r in df.collect() if r.file.endswith("list.txt")]
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in sorted(rows, key=lambda r: r.line_no)] == lines
    assert sorted(r.line_no for r in rows) == list(range(1, 3001))


TREE = {
    "f1/src/a.py": "x = 1\n", "f1/node_modules/d/b.js": "1\n" * 100, "f1/.git/c": "x", "f2/e.go": "x",
    "f2/empty.go": "", "f1/src/__init__.py": "", "f1/_x/y.py": "y = 2\n", "f1/.github/w/ci.yml": "on: push\n",
    "f2/src/deep/er/still/.hidden": "h",
}


@pytest.fixture
def tree(tmp_path):
    for name, content in {**TREE, "outside.txt": "no folder"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    return str(tmp_path)


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_every_file_of_a_working_tree_comes(spark, tree, partitions):
    got = working_trees(spark, tree, partitions=partitions).collect()
    assert sorted((f"{r.folder}/{r.path}", bytes(r.content).decode(), r.size) for r in got) == sorted(
        (name, content, len(content)) for name, content in TREE.items()
    )
    listed = working_trees(spark, tree, content=False).collect()
    assert len(listed) == len(TREE) and all(r.content is None for r in listed)


def test_working_trees_are_pruned_while_listing(spark, tree):
    everything = readers.read_working_trees(spark, tree)
    assert sorted(f"{r.folder}/{r.path}" for r in everything.collect()) == sorted(TREE)
    counts = tree_file_counts(everything.withColumnRenamed("folder", "repo_url"))
    assert sorted(map(tuple, counts.collect())) == [("f1", 6), ("f2", 3)]
    trees = readers.read_working_trees(spark, tree, ScanParams())
    assert sorted((r.folder, r.path) for r in trees.collect()) == [
        ("f1", ".github/w/ci.yml"), ("f1", "_x/y.py"), ("f1", "src/a.py"), ("f2", "e.go"), ("f2", "src/deep/er/still/.hidden"),
    ]
    counts = language_counts(trees.withColumnRenamed("folder", "repo_url")).collect()
    assert ("f1", "Python", 2) in {(r.repo_url, r.language, r.lines) for r in counts}


def test_files_that_fail_the_limits_are_not_opened(tree, monkeypatch):
    reader = WorkingTrees({"path": tree, "minBytes": "1", "maxBytes": "9", "names": r"\.(py|yml)$"}).reader(None)
    opened, store = [], trees.store_of(tree)[0]

    class Store:
        get_file_info = store.get_file_info

        def open_input_stream(self, path, compression=None):
            opened.append(os.path.relpath(path, tree))
            return store.open_input_stream(path, compression=compression)

    monkeypatch.setattr(trees, "store_of", lambda root: (Store(), root))
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert sorted(opened) == sorted(f"{r['folder']}/{r['path']}" for r in rows) == [
        "f1/.github/w/ci.yml", "f1/_x/y.py", "f1/src/a.py"
    ]


def test_branches_of_one_listing_do_not_cut_each_other(spark, tree):
    listed = working_trees(spark, tree, content=False)
    both = listed.where("size > 1").groupBy("folder").count().join(listed.groupBy("folder").agg(F.count("*").alias("n")), "folder")
    assert sorted(map(tuple, both.collect())) == [("f1", 4, 6)]


def test_written_trees_read_back(spark, tmp_path):
    rows = [("a", ".x/_y", b"1"), ("a", "b/c", b""), ("b", "d", None)]
    files = spark.createDataFrame(rows, "folder string, path string, content binary")
    root = f"file://{tmp_path}/out"
    assert write_working_trees(files, root).agg(F.sum("size")).first()[0] == 1
    got = working_trees(spark, root).collect()
    assert sorted((r.folder, r.path, bytes(r.content)) for r in got) == [("a", ".x/_y", b"1"), ("a", "b/c", b""), ("b", "d", b"")]


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_paths_come_as_on_disk(spark, tmp_path, scheme):
    root = tmp_path / "build" / "a b"
    for name in ("r/a b.py", "r/ä#%20.py", "r/vendor/x.py"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1\n")
    for params, more in ((None, ["vendor/x.py"]), (ScanParams(), [])):
        got = readers.read_working_trees(spark, f"{scheme}{root}/", params).collect()
        assert sorted((r.folder, r.path) for r in got) == [("r", p) for p in ["a b.py", *more, "ä#%20.py"]]


def test_tolerant_and_strict_reading(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text(
        json.dumps({"repo_url": "a", "total_loc": 5}) + "\n\n[{\"repo_url\": \"q\"}]\n" + json.dumps({"repo_url": "b"}) + '\n{"repo_url": "c'
    )
    good, broken = readers.read_records(spark, str(path), SMALL)
    assert sorted(map(tuple, good.collect())) == [("a", 5), ("b", None)]
    assert broken.count() == 2
    assert [r.line_no for r in readers.manifest_line_problems(spark, str(path)).collect()] == [5]
    with pytest.raises(ValueError, match="line 5"):
        readers.require_clean_manifest(spark, str(path))


def test_published_table(spark, tmp_path):
    base = str(tmp_path / "table")
    assert writers.read_current(spark, base, SMALL).count() == 0
    for rows in ([("a", 1), ("b", 2)], [("b", 3)]):
        writers.publish_table(spark.createDataFrame(rows, SMALL), base)
    assert [tuple(r) for r in writers.read_current(spark, base, SMALL).collect()] == [("b", 3)]


def test_manifest_table(spark, tmp_path):
    base = str(tmp_path / "manifest")
    assert writers.read_manifest_table(spark, base, SMALL).count() == 0
    writers.upsert_manifest(spark.createDataFrame([("a", 1), ("b", 2)], SMALL), base, SMALL)
    writers.upsert_manifest(spark.createDataFrame([("b", 3)], SMALL), base, SMALL)
    got = writers.read_manifest_table(spark, base, SMALL).collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("b", 3)]
    gone = spark.createDataFrame([("a",), ("zzz",)], "repo_url string")
    assert writers.remove_from_manifest(gone, base, SMALL) is True
    assert writers.remove_from_manifest(gone, base, SMALL) is False
    assert [tuple(r) for r in writers.read_manifest_table(spark, base, SMALL).collect()] == [("b", 3)]
    writers.upsert_manifest(spark.createDataFrame([("a", 9)], SMALL), base, SMALL)
    assert sorted(map(tuple, writers.read_manifest_table(spark, base, SMALL).collect())) == [("a", 9), ("b", 3)]


def test_index_csv_and_errors(spark, tmp_path):
    index = spark.createDataFrame([("f", 'na"me')], "folder string, repo_name string")
    writers.write_index(index, str(tmp_path / "index"))
    parts = [n for n in os.listdir(tmp_path / "index") if n.endswith(".csv")]
    raw = (tmp_path / "index" / parts[0]).read_bytes()
    assert raw.startswith(b"folder,repo_name\n") and b"\r" not in raw
    errors = spark.sql("SELECT 'u' AS repo_url, 'clone' AS stage, 'x' AS error, timestamp'2024-01-02 03:04:05' AS ts")
    writers.append_errors(errors, str(tmp_path / "errors"))
    writers.append_errors(errors, str(tmp_path / "errors"))
    rows = spark.read.json(str(tmp_path / "errors")).collect()
    assert len(rows) == 2 and rows[0].ts == "2024-01-02T03:04:05Z"
    with pytest.raises(ValueError, match="cannot"):
        writers.require_empty(errors, "cannot")


def test_materialized_uses_the_session_folder(spark):
    df = materialized(spark.range(3).toDF("n"), "probe")
    assert df.count() == 3
    assert drop_intermediates(spark) >= 1 and drop_intermediates(spark) == 0
    assert not os.path.exists(df.inputFiles()[0].removeprefix("file://"))
    assert spark.conf.get("spark.checkpoint.dir") == shared_folder(spark)
    assert shared_folder(spark) in df.inputFiles()[0]


def test_from_files_to_delivery(spark, tmp_path):
    body = "\n".join(f"if x{i}: y = 'Globex'" for i in range(12)) + "\n"
    rows = [(f"https://h/o/r{r}", f"{m}/f{i}.py", bytearray(body.encode()), len(body))
            for r in range(2) for m in ("core", "web") for i in range(4)]
    rows.append(("https://h/o/none", "README.md", bytearray(b"# x"), 3))
    files = spark.createDataFrame(rows, schemas.FILES)
    settings = Settings(
        budget=BudgetParams(target_loc=30, tolerance_loc=2, cap_loc=40),
        candidates=CandidateParams(min_loc=2, preferred_min_loc=5, preferred_max_loc=20),
    )
    result = sample_repositories(files, settings=settings)
    records = {r.repo_url: r for r in result.manifest.collect()}
    assert set(records) == {"https://h/o/r0", "https://h/o/r1"}
    one = records["https://h/o/r0"]
    assert (one.total_loc, one.file_count, one.folder_name) == (36, 3, "h__o__r0")
    assert [f.path for f in one.files] == ["core/f0.py", "web/f0.py", "core/f1.py"]
    assert one.meta.lang_stats_source == "walk" and one.meta.repo_lang_distribution == {"Python": 1.0}
    assert [(r.repo_url, r.stage) for r in result.rejected.collect()] == [("https://h/o/none", "agent_empty")]
    texts = result.samples.select(F.lit("h__o__r0").alias("folder"), "path", "text").where("repo_url = 'https://h/o/r0'")
    names = spark.createDataFrame([("Globex", "company")], "name string, kind string")
    done = delivery.redact_corpus(texts, names)
    assert done.report.first().total_additions == 36
    assert "Globex" not in "".join(r.text for r in done.texts.collect())
    again = delivery.redact_corpus(texts, names, reports=done.report)
    assert again.texts.count() == 0
    whole = delivery.deliver(files, None, names, settings)
    paths = {(r.folder, r.path) for r in whole.texts.collect()}
    assert ("h__o__r0", "samples/core/f0.py") in paths and ("h__o__r0", "repo_summary.md") in paths
    assert "Globex" not in "".join(r.text for r in whole.texts.collect())
    assert {r.folder for r in whole.index.collect()} == {r.folder_name for r in whole.manifest.collect()}
    base = str(tmp_path / "delivery")
    notes = spark.createDataFrame([("h__o__r0", "run.log", "raw")], "folder string, path string, text string")
    first = delivery.publish(whole, base, "rules", "2024-01-01T00:00:00Z", private=notes)
    assert [r.path for r in writers.published(spark, base, "private").collect()] == ["run.log"]
    records = {r.folder: r for r in writers.published(spark, base, "audit").collect()}
    assert records["h__o__r0"].total_additions == 36 and records["h__o__r0"].model == "rules"
    assert [c.path for c in records["h__o__r0"].changes] == sorted(c.path for c in records["h__o__r0"].changes)
    unpacked = replace(whole, texts=whole.texts.where(F.col("folder") != "h__o__r1"))
    with pytest.raises(ValueError, match="cannot pack"):
        delivery.publish(unpacked, base, "rules", "2024-01-02T00:00:00Z")
    with pytest.raises(Exception):
        writers.publish_tables({"index": whole.index, "bad": whole.texts.select(F.raise_error(F.lit("no")).alias("x"))}, base)
    assert writers.current_version(spark, base) == first
    assert writers.published(spark, base, "deliverable").count() == whole.texts.count()
    forced = sample_repositories(files, settings=settings, forced_language="javascript")
    assert {r.stage for r in forced.rejected.collect()} == {"agent_empty", "agent_no_primary_lang"}


def test_broken_identity_is_an_error(spark, tmp_path):
    ids = spark.createDataFrame([("a", "u")], "first_commit_hash string, repo_url string")
    writers.write_identity(ids, str(tmp_path / "identity"))
    assert [r.repo_url for r in readers.read_identity(spark, str(tmp_path / "identity")).collect()] == ["u"]
    (tmp_path / "identity" / "part-x.json").write_text('{"repo_url": "v"')
    with pytest.raises(ValueError, match="invalid repository identity"):
        readers.read_identity(spark, str(tmp_path / "identity"))


def test_audit_records_come_in_parts(spark):
    changes = spark.range(25).selectExpr(
        "if(id < 23, 'f', 'g') AS folder", "format_string('p%02d', id) AS path", "1L AS hunks", "2L AS additions", "id AS deletions", "id = 24 AS hidden"
    )
    folders = spark.createDataFrame([("f",), ("g",), ("none",)], "folder string")
    costs = spark.createDataFrame([("f", 0.5), ("f", 0.25)], "folder string, cost_usd double")
    got = {(r.folder, r.part): r for r in audit_records(changes, folders, "m", "now", costs, per_part=10).collect()}
    assert {k: len(r.changes) for k, r in got.items()} == {("f", 0): 10, ("f", 1): 10, ("f", 2): 3, ("g", 0): 1, ("none", 0): 0}
    assert got["f", 1].changes[0].path == "p10" and got["f", 2].total_additions == 46 and got["f", 0].cost_usd == 0.75
