"""Line alignment of two versions of a file: fewest added and removed lines, always the same choice.

The common subsequence is found on bit rows (one integer holds a whole row of
the table of subsequence lengths), so time is the product of the line counts over
the word size, and memory two square roots of rows: the rows are computed from the last line to the
first, some are kept, and the walk from the first line on computes the rows
between two kept ones again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Iterator, Sequence
from math import isqrt


def matched(old: Sequence[Hashable], new: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Pairs of equal lines that stay, in order: as many as there can be.

    Common heads and tails stay.  Between them, lines that the other version
    lacks are set aside; the rest is walked from its start: equal lines match, else
    the new line is skipped where that loses no match, else the old one.
    What is equal at the start of the rest needs no walk.
    """
    n, m, head = len(old), len(new), 0
    while head < min(n, m) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and old[n - 1 - tail] == new[m - 1 - tail]:
        tail += 1
    left, right = Counter(old[head : n - tail]), Counter(new[head : m - tail])
    rows = [i for i in range(head, n - tail) if old[i] in right]
    columns = [j for j in range(head, m - tail) if new[j] in left]
    same = 0
    while same < min(len(rows), len(columns)) and old[rows[same]] == new[columns[same]]:
        same += 1
    inner = _walk([old[i] for i in rows[same:]], [new[j] for j in columns[same:]])
    return (
        [(i, i) for i in range(head)]
        + list(zip(rows[:same], columns[:same], strict=True))
        + [(rows[same + i], columns[same + j]) for i, j in inner]
        + [(n - k, m - k) for k in range(tail, 0, -1)]
    )


def _walk(old: list[Hashable], new: list[Hashable]) -> list[tuple[int, int]]:
    n, m = len(old), len(new)
    if not n or not m:
        return []
    full, places = (1 << m) - 1, {}
    for j, line in enumerate(new):
        places[line] = places.get(line, 0) | 1 << (m - 1 - j)

    def above(row: int, line: Hashable) -> int:
        """Bit row of the old lines from one further up: 0 where one more new line adds to the length."""
        hit = row & places.get(line, 0)
        return (row + hit | row - hit) & full

    step = isqrt(n) + 1
    kept, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = above(row, old[i])
        if i % step == 0:
            kept[i] = row
    out, i, j, rows = [], 0, 0, {}
    while i < n and j < m:
        if i not in rows:
            stop = min(n, (i // step + 1) * step)
            rows, row = {}, kept[stop]
            for k in range(stop - 1, i - 1, -1):
                rows[k] = row = above(row, old[k])
        if old[i] == new[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i] >> (m - 1 - j) & 1:
            j += 1
        else:
            i += 1
    return out


def edit_runs(old: Sequence[Hashable], new: Sequence[Hashable]) -> Iterator[tuple[int, int, int, int]]:
    """Changed runs as (first old, end old, first new, end new), in order; between two of them lines stay."""
    i = j = 0
    for a, b in [*matched(old, new), (len(old), len(new))]:
        if a > i or b > j:
            yield i, a, j, b
        i, j = a + 1, b + 1


def change_counts(old: Sequence[Hashable], new: Sequence[Hashable], gap: int) -> tuple[int, int, int]:
    """Hunks, additions and deletions; more than ``gap`` lines that stay separate two hunks."""
    hunks = additions = deletions = 0
    end = None
    for first, stop, start, finish in edit_runs(old, new):
        hunks += end is None or first - end > gap
        additions, deletions, end = additions + finish - start, deletions + stop - first, stop
    return hunks, additions, deletions


def line_pairs(old: Sequence[str], new: Sequence[str]) -> Iterator[tuple[int | None, int | None, str | None, str | None]]:
    """Changed lines as (old number, new number, before, after), numbers from 1.

    Inside a run the k-th removed line goes with the k-th added one; what is
    left over has no counterpart.
    """
    for first, stop, start, finish in edit_runs(old, new):
        for k in range(max(stop - first, finish - start)):
            i, j = (first + k if first + k < stop else None), (start + k if start + k < finish else None)
            yield (
                None if i is None else i + 1, None if j is None else j + 1,
                None if i is None else old[i], None if j is None else new[j],
            )
