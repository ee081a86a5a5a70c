"""Quotas of lines and the files they choose, held against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict
from fractions import Fraction

from corpusmill.operators.quotas import language_quotas, steered_requests
from corpusmill.params import BudgetParams, CandidateParams

ROWS = "repo_url string, seq bigint, path string, layer string, language string, loc bigint, start_line int, end_line int"


def plain_quotas(lines, weights, goal):
    """Water level by filling the shallowest vessel first, in fractions; then largest remainders."""
    left, unfilled, quota = Fraction(goal), set(lines), {}
    while unfilled:
        level = left / sum(weights[k] for k in unfilled)
        full = {k for k in unfilled if lines[k] <= level * weights[k]}
        if not full:
            quota |= {k: level * weights[k] for k in unfilled}
            break
        for k in full:
            quota[k] = Fraction(lines[k])
            left -= lines[k]
        unfilled -= full
    whole = {k: int(q) for k, q in quota.items()}
    short = goal - sum(whole.values())
    for k in sorted(unfilled, key=lambda k: (whole[k] - quota[k], k))[:short]:
        whole[k] += 1
    return whole


def plain_within(files, quota, room):
    took, before = [], 0
    for f in sorted((f for f in files if f[5] <= room), key=lambda f: f[1]):
        if before < quota and before + f[5] <= room:
            took.append(f)
        before += f[5]
    return took


def plain_picked(files, weights, goal, room):
    lines = defaultdict(int)
    for f in files:
        lines[f[4]] += f[5]
    quotas = plain_quotas(lines, weights, goal) if goal else {}
    took = [f for k, q in quotas.items() for f in plain_within([f for f in files if f[4] == k], q, q)]
    done = sum(f[5] for f in took)
    if goal > done:
        took += plain_within([f for f in files if f not in took], goal - done, room - done)
    return took


def kind(f):
    return "test" if f[3] == "test" else "low" if f[3] in ("infra", "boilerplate", "autogen") else "main"


def plain_steered(files, budget, least):
    files = [f for f in files if f[5] >= least]
    weights, have = defaultdict(int), defaultdict(int)
    for f in files:
        weights[f[4]] += f[5]
        have[kind(f)] += f[5]
    of = {k: [f for f in files if kind(f) == k] for k in ("main", "test", "low")}
    target, cap = budget.target_loc, budget.cap_loc
    main = plain_picked(of["main"], weights, min(have["main"], target - min(have["test"], target * 15 // 100)), cap)
    done = sum(f[5] for f in main)
    if done:
        tests = max(0, min(have["test"], max(target - done, done * 15 // 85), done // 4, cap - done))
        low = max(0, min(have["low"], target - done - tests, done // 4))
    else:
        tests = min(have["test"], target)
        low = min(have["low"], target - tests)
    return main + plain_picked(of["test"], weights, tests, tests) + plain_picked(of["low"], weights, low, low)


def test_quotas_are_the_level_of_water(spark):
    rng, rows, want = random.Random(4), [], {}
    for i in range(60):
        names = [f"l{j}" for j in range(rng.randint(1, 6))]
        lines = {k: rng.choice([1, 3, 10, rng.randint(1, 400), 10**9]) for k in names}
        weights = {k: lines[k] + rng.choice([0, 0, rng.randint(0, 300)]) for k in names}
        goal = rng.randint(0, min(sum(lines.values()), 5000))
        rows += [(f"r{i}", "main", k, lines[k], weights[k], goal) for k in names]
        want |= {(f"r{i}", k): q for k, q in plain_quotas(lines, weights, goal).items()}
    strata = spark.createDataFrame(rows, "repo_url string, kind string, language string, lines bigint, weight bigint, goal bigint")
    got = {(r.repo_url, r.language): r.quota for r in language_quotas(strata).collect()}
    assert got == want
    assert language_quotas(strata.limit(0)).count() == 0


def test_steered_files_are_those_of_plain_loops(spark):
    rng, budget, params = random.Random(9), BudgetParams(target_loc=500, tolerance_loc=30, cap_loc=650), CandidateParams(min_loc=3)
    layers = ["business", "util", "test", "infra", "boilerplate"]
    mixes = [[6, 6, 3, 2, 2], [1, 1, 9, 3, 3], [0, 0, 1, 1, 1], [1, 0, 0, 0, 0], [1, 1, 0, 5, 5], [3, 3, 1, 0, 0]]
    rows = []
    for i in range(48):
        for seq in range(1, rng.choice([2, 8, 60, 250])):
            layer, language = rng.choices(layers, mixes[i % 6])[0], rng.choice(["Go", "PHP", "PHP", "Rust"])
            loc = rng.choice([1, 3, 5, 9, 20, rng.randint(3, 20), rng.randint(3, 60), rng.randint(30, 140)])
            rows.append((f"r{i}", seq, f"p{seq}", layer, language, loc, None, None))
    got = steered_requests(spark.createDataFrame(rows, ROWS), budget, params)
    assert got.columns == [c.split()[0] for c in ROWS.split(", ")]
    of = defaultdict(list)
    for f in rows:
        of[f[0]].append(f)
    want = [f for files in of.values() for f in plain_steered(files, budget, 3)]
    got = [tuple(r) for r in got.collect()]
    assert sorted(got, key=lambda f: f[:2]) == sorted(want, key=lambda f: f[:2])
    judged = 0
    for repo, files in of.items():
        lines = defaultdict(int)
        for f in got:
            if f[0] == repo:
                lines[kind(f)] += f[5]
        total = sum(lines.values())
        assert total <= budget.cap_loc
        if lines["main"]:
            assert 5 * lines["test"] <= total and 5 * lines["low"] <= total
            small = sum(f[5] for f in files if f[3] == "test" and 3 <= f[5] <= 20)
            if small >= 0.2 * total and total > 400:
                judged += 1
                assert 10 * lines["test"] >= total, (repo, lines)
    assert judged >= 5


def test_languages_are_mirrored(spark):
    rows = [("r", i, f"a{i}", "util", "Go" if i % 4 else "PHP", 10, None, None) for i in range(1, 401)]
    rows += [("r", 500 + i, f"t{i}", "test", "Go", 10, None, None) for i in range(100)]
    budget = BudgetParams(target_loc=1000, tolerance_loc=10, cap_loc=1100)
    got = steered_requests(spark.createDataFrame(rows, ROWS), budget, CandidateParams(min_loc=1)).collect()
    lines = defaultdict(int)
    for r in got:
        lines[r.layer, r.language] += r.loc
    assert lines["test", "Go"] == 150 and sum(lines.values()) == 1000
    assert abs(lines["util", "PHP"] - 850 * 1000 / 5000) < 10 + 10
    assert steered_requests(spark.createDataFrame([], ROWS), budget).count() == 0
