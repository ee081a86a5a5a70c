"""Suffix arrays with common-prefix values by external induced sorting.

The suffixes at local minima (S* suffixes) are sorted by naming the pieces
between them and recursing on the names; then one ascending scan induces all
descending (L) suffixes and one descending scan all ascending (S) suffixes.
Tuples of induced suffixes wait in queues that go to disk in sorted runs, so a
shard may be far larger than the memory that ``Workspace`` grants.  Every tuple
carries the place of the suffix that induced it; the common prefix with its
neighbour is one more than the least value between their two inducers.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


class Workspace:
    """Arrays of more than ``items`` entries live in files of a private folder, deleted at the end.

    The folder is scratch space of one task attempt, as Spark's own spill files
    are: nothing outside the task reads it, and a repeated attempt starts anew.
    """

    def __init__(self, items: int):
        self.items = items
        self.folder: tempfile.TemporaryDirectory | None = None
        self.number = 0

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffixes-")
        self.number += 1
        return os.path.join(self.folder.name, str(self.number))

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= self.items:
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()
            self.folder = None


class BucketQueue:
    """Priority queue of (bucket, order, position) tuples; leaves memory in sorted runs.

    Orders are pushed ascending and buckets are taken out ascending.  Each run
    is sorted by bucket, so a bucket is one slice of every run.
    """

    def __init__(self, work: Workspace):
        self.work, self.fresh, self.size, self.runs = work, [], 0, []

    def push(self, bucket: np.ndarray, order: np.ndarray, position: np.ndarray) -> None:
        if len(bucket):
            self.fresh.append((bucket, order, position))
            self.size += len(bucket)
            if self.size > self.work.items:
                self._settle(to_disk=True)

    def _settle(self, to_disk: bool) -> None:
        if not self.fresh:
            return
        columns = [np.concatenate(c) for c in zip(*self.fresh)]
        by = np.argsort(columns[0], kind="stable")
        columns = [c[by] for c in columns]
        if to_disk:
            held = []
            for c in columns:
                held.append(np.memmap(self.work.path(), c.dtype, "w+", shape=c.shape))
                held[-1][:] = c
            columns = held
        self.runs.append(columns)
        self.fresh, self.size = [], 0

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """Orders and positions of the bucket, ascending by order."""
        self._settle(to_disk=False)
        orders, positions = [], []
        for buckets, order, position in self.runs:
            at, to = np.searchsorted(buckets, [bucket, bucket + 1])
            orders.append(order[at:to])
            positions.append(position[at:to])
        self._merge(bucket)
        order = np.concatenate(orders or [np.zeros(0, np.int64)])
        position = np.concatenate(positions or [np.zeros(0, np.int64)])
        if len(order) > 1 and (order[1:] < order[:-1]).any():
            by = np.argsort(order, kind="stable")
            order, position = order[by], position[by]
        return order, position

    def _merge(self, bucket: int) -> None:
        """Keep the number of runs in memory low: what is still to come goes back to the buffer as one."""
        small = [r for r in self.runs if not isinstance(r[0], np.memmap)]
        if len(small) > 8:
            self.runs = [r for r in self.runs if isinstance(r[0], np.memmap)]
            left = [[c[np.searchsorted(r[0], bucket) :] for c in r] for r in small]
            self.fresh = [tuple(np.concatenate(c) for c in zip(*left))]
            self.size = len(self.fresh[0][0])


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S); the last suffix is S."""
    n = len(text)
    rises, differs = np.zeros(n, bool), np.ones(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    differs[:-1] = text[:-1] != text[1:]
    rises[-1] = True
    turn = np.flatnonzero(differs)
    return np.repeat(rises[turn], np.diff(np.concatenate([[-1], turn])))


def _run(text: np.ndarray, position: int, limit: int) -> int:
    """Length, up to ``limit``, of the run of equal symbols that starts at a position."""
    part = text[position : position + limit]
    other = part != part[0]
    return int(other.argmax()) if other.any() else len(part)


def _index_type(n: int):
    return np.int32 if n < 2**31 - 1 else np.int64


def _doubled(text: np.ndarray) -> np.ndarray:
    """Suffix array of a text that fits in memory, by doubling the compared length."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        later = np.zeros(len(rank), np.int64)
        later[:-step] = rank[step:] + 1
        key = rank * (len(rank) + 2) + later
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = new
        if new[-1] == len(rank) - 1 or step >= len(rank):
            return order
        step *= 2


def _names(text: np.ndarray, rising: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of each piece between stars (both included) in their order; equal pieces, equal numbers."""
    length = np.append(stars[1:] - stars[:-1] + 1, 1)
    name, active, depth = np.zeros(len(stars), np.int64), np.arange(len(stars)), 0
    bits = int(int(text.max()) * 2 + 3).bit_length()
    pack = max(1, 62 // bits)
    while len(active):
        key = np.zeros(len(active), np.int64)
        for j in range(depth, depth + pack):
            at = np.minimum(stars[active] + j, len(text) - 1)
            own = np.where(j < length[active], text[at].astype(np.int64) * 2 + rising[at] + 1, 0)
            key = (key << bits) | own
        order = np.lexsort((key, name[active]))
        mine, key = active[order], key[order]
        old = name[mine]
        fresh = np.ones(len(mine), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1])
        # A name is the number of pieces that are smaller, so names of finished pieces stay as they are.
        group = np.flatnonzero(fresh)
        head = np.ones(len(mine), bool)
        head[1:] = old[1:] != old[:-1]
        base = np.maximum.accumulate(np.where(head, np.arange(len(mine)), 0))
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(mine)), 0))
        name[mine] = old + first - base
        size = np.diff(np.append(group, len(mine)))
        tied = np.repeat(size > 1, size)
        depth += pack
        active = mine[tied & (length[mine] > depth)]
        active.sort()
    distinct = np.unique(name)
    return np.searchsorted(distinct, name), len(distinct)


def _least(values: np.ndarray, orders: np.ndarray, before: int) -> np.ndarray:
    """Least of ``values`` after each earlier order and up to the next one."""
    if not len(orders):
        return np.zeros(0, np.uint8)
    starts = np.append(before, orders[:-1]) + 1
    low = starts[0]
    part = np.asarray(values[low : orders[-1] + 1])
    return np.minimum.reduceat(part, starts - low)


def _scan(text, rising, symbols, seeds, seed_lcp, limit: int, work: Workspace, down: bool):
    """One inducing scan.

    ``seeds`` maps a symbol to positions already sorted in scan order; after
    the induced suffixes of that symbol they are scanned too.  Returns, per
    symbol, induced positions and common prefixes in scan order.
    """
    queue, scanned, out = BucketQueue(work), 0, {}
    values = work.array(len(text) + 1, np.uint8) if limit else None
    sign, index = -1 if down else 1, _index_type(len(text) + 1)
    wide = np.int32 if text.dtype.itemsize <= 2 else np.int64

    def visit(symbol: int, positions: np.ndarray, lcp) -> None:
        nonlocal scanned
        if limit and len(positions):
            values[scanned : scanned + len(positions)] = lcp
        use = positions > 0
        order = (np.arange(len(positions), dtype=index) + index(scanned))[use]
        before = positions[use] - 1
        want = rising[before] if down else ~rising[before]
        before, order = before[want], order[want]
        queue.push(sign * text[before].astype(wide), order, before)
        scanned += len(positions)

    for symbol in symbols[::-1] if down else symbols:
        found, lcps, last = [], [], None
        while True:
            # Those that suffixes of this very bucket have put behind it come in later rounds.
            orders, positions = queue.pop(sign * symbol)
            new = orders > last if last is not None else np.ones(len(orders), bool)
            orders, positions = orders[new], positions[new]
            if not len(orders):
                break
            lcp = None
            if limit:
                if last is None:
                    least = np.append(np.uint8(0), _least(values, orders[1:], int(orders[0])))
                    lcp = np.minimum(least.astype(np.int16) + 1, limit)
                    lcp[0] = 0
                else:
                    lcp = np.minimum(_least(values, orders, last).astype(np.int16) + 1, limit)
                lcps.append(lcp)
            last = int(orders[-1])
            found.append(positions)
            visit(symbol, positions, lcp)
        own = np.concatenate(found) if found else np.zeros(0, index)
        out[symbol] = own, (np.concatenate(lcps) if lcps else np.zeros(0, np.int16))
        more = seeds.get(symbol)
        if more is not None and len(more):
            lcp = None
            if limit:
                lcp = seed_lcp[symbol].copy()
                lcp[0] = min(_run(text, own[-1], limit), _run(text, more[0], limit)) if len(own) else 0
            visit(symbol, more, lcp)
    return out


def _prefixes(words: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix, up to ``limit`` symbols, of each suffix with the one before it in ``order``."""
    out = np.zeros(len(order), np.int16)
    active = np.arange(1, len(order), dtype=_index_type(len(order)))
    for depth in range(0, limit, 8):
        if not len(active):
            break
        a = words[np.minimum(order[active] + depth, len(words) - 1)]
        b = words[np.minimum(order[active - 1] + depth, len(words) - 1)]
        x = (a ^ b).astype(np.uint64)
        same = x == 0
        rest = x[~same]
        zeros = np.zeros(len(rest), np.int16)
        for shift in (32, 16, 8):
            high = (rest >> np.uint64(64 - shift)) == 0
            zeros += np.where(high, shift // 8, 0)
            rest = np.where(high, rest << np.uint64(shift), rest)
        out[active[~same]] += zeros
        out[active[same]] += 8
        active = active[same]
    return np.minimum(out, limit)


def suffixes(text: np.ndarray, work: Workspace, limit: int = 0):
    """Suffix array of ``text`` by buckets, and common prefixes up to ``limit`` (0: none, at most 255).

    ``text`` holds positive integers and ends with a 0, which occurs nowhere
    else.  Yields (positions, common prefix with the suffix before) for one
    first symbol after the other, in suffix order; with ``limit`` symbols have to be below 256.
    """
    n = len(text)
    rising = _types(text)
    symbols = [int(s) for s in np.unique(text)]
    star = np.zeros(n, bool)
    star[1:] = rising[1:] & ~rising[:-1]
    stars = np.flatnonzero(star).astype(_index_type(n))
    del star
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int64)
        return
    names, distinct = _names(text, rising, stars)
    if distinct == len(stars):
        order = np.argsort(names, kind="stable")
    elif len(stars) <= work.items:
        order = _doubled(names)
    else:
        reduced = work.array(len(stars) + 1, np.int64)
        reduced[:-1] = names + 1
        order = np.concatenate([p for p, _ in suffixes(reduced, work)])[1:]
    ordered = stars[order].astype(_index_type(n))
    seed_lcp = {}
    if limit:
        # Eight symbols at every position as one number, without a copy of the text for each.
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = text
        prefix = _prefixes(np.ndarray((n,), ">u8", padded, strides=(1,)), ordered, limit)
    first = text[ordered]
    bounds = np.searchsorted(first, symbols + [symbols[-1] + 1])
    seeds = {}
    for k, s in enumerate(symbols):
        seeds[s] = ordered[bounds[k] : bounds[k + 1]]
        if limit:
            seed_lcp[s] = prefix[bounds[k] : bounds[k + 1]]
    lower = _scan(text, rising, symbols, seeds, seed_lcp, limit, work, down=False)
    # In the descending scan a value stands between a suffix and the one after it.
    back = {s: p[::-1] for s, (p, _) in lower.items()}
    back_lcp = {s: np.append(0, v[1:][::-1]) for s, (_, v) in lower.items()} if limit else {}
    upper = _scan(text, rising, symbols, back, back_lcp, limit, work, down=True)
    for s in symbols:
        low, low_lcp = lower[s]
        high, high_lcp = upper[s]
        if s == 0:
            low, low_lcp, high, high_lcp = np.array([n - 1]), np.zeros(1, np.int64), high[:0], high_lcp[:0]
        if not limit:
            yield np.concatenate([low, high[::-1]]), None
            continue
        up = np.append(0, high_lcp[1:][::-1]) if len(high) else high_lcp
        if len(low) and len(high):
            up[0] = min(_run(text, low[-1], limit), _run(text, high[-1], limit))
        yield np.concatenate([low, high[::-1]]), np.concatenate([low_lcp, up])
