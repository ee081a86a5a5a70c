from __future__ import annotations

import random

import pytest

from corpusmill import schemas
from corpusmill.operators.profile import line_masks
from corpusmill.operators.selection import budget_select, running_shares, sample_texts, saved_files, stored_sample_texts
from corpusmill.params import BudgetParams
from corpusmill.sources.materialize import materialized


def file_rows(contents: dict) -> list:
    return [(r, p, bytearray(t.encode()), len(t)) for (r, p), t in contents.items()]


def fold(requests, contents, target, cap):
    """The rules as a plain loop."""
    out, state = {}, {}
    for repo, seq, path, layer, start, end in sorted(requests):
        total, taken = state.get(repo, (0, set()))
        name = path.removeprefix("./")
        if (repo, name) not in contents:
            out[repo, seq] = ("not_found", None, None)
            continue
        lines = contents[repo, name].splitlines()
        chunk = lines
        if start is not None and end is not None:
            chunk = lines[max(1, start) - 1 : min(end, len(lines))]
            bad = max(1, start) - 1 >= min(end, len(lines))
        else:
            bad = False
        loc = sum(not line.startswith("#") for line in chunk)
        if name in taken:
            reason = "duplicate"
        elif bad:
            reason = "bad_range"
        elif loc == 0:
            reason = "zero_loc"
        elif total + loc > cap:
            reason = "budget_exhausted" if total >= target else "too_large"
        else:
            total += loc
            taken = taken | {name}
            state[repo] = (total, taken)
            out[repo, seq] = (None, len(taken), total)
            continue
        out[repo, seq] = (reason, None, None)
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(7)
    contents = {
        (f"r{r}", f"d/f{f}.py"): "".join(
            "x\n" if rng.random() < 0.8 else "# c\n" for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40]))
        )
        for r in range(4) for f in range(50)
    }
    requests = []
    for r in range(4):
        # The first repository holds most of all requests.
        for q in range(3000 if r == 0 else 250):
            path = ("./" if rng.random() < 0.1 else "") + f"d/f{rng.randrange(54)}.py"
            start = end = None
            if rng.random() < 0.5:
                start, end = rng.randrange(-1, 12), rng.choice([None, *range(45)])
            requests.append((f"r{r}", q * 3, path, rng.choice(schemas.LAYERS), start, end))
    rng.shuffle(requests)
    files = spark.createDataFrame(file_rows(contents), schemas.FILES)
    return requests, contents, files, materialized(line_masks(files), "masks")


@pytest.mark.parametrize("target, cap", [(20, 30), (100, 140), (1, 1), (5000, 6500)])
def test_same_as_plain_loop(spark, world, target, cap):
    requests, contents, _, masks = world
    outcome = budget_select(
        spark.createDataFrame(requests, schemas.REQUESTS).repartition(5), masks,
        params=BudgetParams(target_loc=target, cap_loc=cap),
    )
    got = {(r.repo_url, r.seq): (r.reason, r["rank"], r.running_total) for r in outcome.collect()}
    assert got == fold(requests, contents, target, cap)


def outcome_of(spark, contents, requests, target, cap, primaries=None):
    files = spark.createDataFrame(file_rows(contents), schemas.FILES)
    return files, budget_select(
        spark.createDataFrame(requests, schemas.REQUESTS), line_masks(files), primaries,
        BudgetParams(target_loc=target, cap_loc=cap),
    )


def test_retry_with_smaller_range(spark):
    contents = {("r", "big.py"): "x\n" * 100}
    requests = [
        ("r", 1, "big.py", "api", None, None), ("r", 2, "big.py", "api", 1, 30),
        ("r", 3, "./big.py", "api", None, None), ("r", 4, "big.py", "api", 10, 5),
        ("r", 5, "none.py", "api", None, None),
    ]
    _, outcome = outcome_of(spark, contents, requests, 30, 50)
    assert [(r.seq, r.reason, r.loc) for r in outcome.orderBy("seq").collect()] == [
        (1, "too_large", None), (2, None, 30), (3, "duplicate", None), (4, "duplicate", None),
        (5, "not_found", None),
    ]


def test_shares_and_texts(spark):
    contents = {("r", "a.py"): "1\n2\n3\r\n4\n", ("r", "b.go"): "x\n" * 3}
    requests = [("r", 1, "a.py", "business", 2, 3), ("r", 2, "b.go", "test", None, None)]
    primaries = spark.createDataFrame([("r", "Python")], "repo_url string, primary string")
    files, outcome = outcome_of(spark, contents, requests, 5000, 6500, primaries)
    shares = running_shares(outcome).orderBy("rank").collect()
    assert [(s.running_total, s.remaining, s.logic_share, s.primary_share) for s in shares] == [
        (2, 4998, 1.0, 1.0), (5, 4995, 0.4, 0.4),
    ]
    texts = {r.path: (r.text, r.is_partial) for r in sample_texts(saved_files(outcome), files).collect()}
    assert texts == {"a.py": ("2\n3\n", True), "b.go": ("x\nx\nx\n", False)}


def test_content_stays_out_of_exchanges(spark, tmp_path):
    rows = [(f"r{i % 7}", f"src/f{i}.py", f"a{i}\nb\nc\n".encode(), 9) for i in range(6000)]
    files = spark.createDataFrame(rows, "repo_url string, path string, content binary, size bigint")
    path = str(tmp_path / "stored files")
    files.repartition(3).write.option("parquet.block.size", 4096).parquet(path)
    saved = spark.createDataFrame(
        [(f"r{i % 7}", 1, f"src/f{i}.py", f"src/f{i}.py", "util", 1, i % 2 == 0, "Python", 1, 2) for i in range(0, 6000, 13)],
        "repo_url string, rank bigint, path string, norm_path string, layer string, loc_taken bigint, is_partial boolean, "
        "language string, first_line int, last_line int",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = stored_sample_texts(saved, path)
        plan = got._jdf.queryExecution().executedPlan().toString()
        below = plan.split("Exchange", 1)[1]
        assert "SortMergeJoin" in plan and "content#" not in below and "content:" not in below
        found = {r.path: r.text for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {r.path: r.text for r in sample_texts(saved, files).collect()}
    assert found == want and len(found) == len(range(0, 6000, 13))
    assert found["src/f26.py"] == "b\n" and found["src/f13.py"] == "a13\nb\nc\n"
    assert stored_sample_texts(saved.limit(0), path).collect() == []
