"""Line alignment against the plain table of common lengths."""

from __future__ import annotations

import random
import time

import pytest

from corpusmill.functions.alignment import change_counts, edit_runs, line_pairs, matched
from corpusmill.operators.audit import file_changes, line_changes


def common_length(old, new):
    row = [0] * (len(new) + 1)
    for a in old:
        row, last = [0], row
        for j, b in enumerate(new):
            row.append(last[j] + 1 if a == b else max(last[j + 1], row[j]))
    return row[-1]


def plainly_matched(old, new):
    """The stated choice, with the whole table."""
    head = next((k for k, (a, b) in enumerate(zip(old, new, strict=False)) if a != b), min(len(old), len(new)))
    left, right = old[head:], new[head:]
    tail = next((k for k, (a, b) in enumerate(zip(left[::-1], right[::-1], strict=False)) if a != b), min(len(left), len(right)))
    left, right = left[: len(left) - tail], right[: len(right) - tail]
    rows = [i for i, x in enumerate(left) if x in right]
    columns = [j for j, x in enumerate(right) if x in left]
    table = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
    for r in range(len(rows) - 1, -1, -1):
        for c in range(len(columns) - 1, -1, -1):
            same = left[rows[r]] == right[columns[c]]
            table[r][c] = table[r + 1][c + 1] + 1 if same else max(table[r + 1][c], table[r][c + 1])
    out, r, c = [(k, k) for k in range(head)], 0, 0
    while r < len(rows) and c < len(columns):
        if left[rows[r]] == right[columns[c]]:
            out.append((head + rows[r], head + columns[c]))
            r, c = r + 1, c + 1
        elif table[r][c + 1] == table[r][c]:
            c += 1
        else:
            r += 1
    return out + [(len(old) - k, len(new) - k) for k in range(tail, 0, -1)]


@pytest.mark.parametrize("letters", ["ab", "abcd", "abcdefghijklmnopqrstuvwxyz"])
def test_as_many_lines_stay_as_can(letters):
    draw = random.Random(len(letters))
    for _ in range(400):
        old = [draw.choice(letters) for _ in range(draw.randrange(25))]
        new = [x for x in old if draw.random() < 0.8]
        for _ in range(draw.randrange(4)):
            new.insert(draw.randrange(len(new) + 1), draw.choice(letters))
        pairs = matched(old, new)
        assert pairs == plainly_matched(old, new)
        assert len(pairs) == common_length(old, new) and all(old[i] == new[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False))
        hunks, additions, deletions = change_counts(old, new, 6)
        assert (additions, deletions) == (len(new) - len(pairs), len(old) - len(pairs))
        rebuilt, at = [], 0
        for first, stop, start, end in edit_runs(old, new):
            rebuilt, at = rebuilt + old[at:first] + new[start:end], stop
        assert rebuilt + old[at:] == new and (hunks == 0) == (old == new)


def test_moved_line_and_hunks():
    assert change_counts(list("abcde"), list("xabcd"), 6) == (1, 1, 1)
    lines = [str(i) for i in range(40)]
    assert change_counts(lines, ["x", *lines[1:7], *lines[7:14], "y", *lines[15:]], 6) == (2, 2, 2)
    assert change_counts(lines, ["x", *lines[1:7], "y", *lines[8:]], 6) == (1, 2, 2)
    assert change_counts([], ["a"], 6) == (1, 1, 0) and change_counts(["a"], [], 6) == (1, 0, 1)
    assert list(line_pairs(["a", "b"], ["a", "c", "d"])) == [(2, 2, "b", "c"), (None, 3, None, "d")]


def test_long_files_are_aligned_in_whole():
    draw = random.Random(4)
    old = [f"line {draw.randrange(9000)}" for _ in range(30_000)]
    new = [x for x in old if draw.random() < 0.9]
    started = time.time()
    assert len(matched(old, new)) == len(new) and time.time() - started < 60


def test_changes_of_files(spark):
    rows = [
        ("f", "moved", "a\nb\nc\nd\ne\n", "x\na\nb\nc\nd\n"), ("f", "same", "a", "a"), ("f", ".hidden", "a", "b"),
        ("f", "gone", "a\nb", None), ("f", "made", None, "a\n\nb"),
    ]
    pairs = spark.createDataFrame(rows, "folder string, path string, before string, after string")
    got = {r.path: (r.hunks, r.additions, r.deletions, r.hidden) for r in file_changes(pairs).collect()}
    assert got == {"moved": (1, 1, 1, False), ".hidden": (1, 1, 1, True), "gone": (1, 0, 2, False), "made": (1, 3, 0, False)}
    lines = [tuple(r)[2:] for r in line_changes(pairs).where("path = 'moved'").collect()]
    assert sorted(lines, key=repr) == [(5, None, "e", None), (None, 1, None, "x")]
    plan = file_changes(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and file_changes(pairs.limit(0)).collect() == []
