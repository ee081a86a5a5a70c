"""Finding and replacing names by their units: the words of a text and the parts of its identifiers.

``acme_client``, ``AcmeClient``, ``ACME client`` and ``acme-client`` all have the units
``acme`` and ``client``.  Runs of letters and digits are words; a capital after
a small letter or digit begins a part, and so does the last of several
capitals before a small letter.  Units are compared in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

WORD = re.compile(r"[^\W_]+")
#: What may stand between two units of a name besides what the name itself has there.
JOINS = frozenset(("", " ", "\t", "_", "-"))
_PAIR, _SCOPE, _MASK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
PROBES = 8
#: Names are looked up by so many of their first units.
LOOKUP = 3
#: What a task remembers at most: some 60 MB of words, 20 MB of names.
HELD_WORDS, HELD_NAMES = 1 << 18, 1 << 14


def parts(word: str) -> list[tuple[int, int]]:
    """Where the units of a word are."""
    if word.islower() or word.isdigit() or word[1:].islower():
        return [(0, len(word))]
    cuts = [0]
    for i in range(1, len(word)):
        before, here = word[i - 1], word[i]
        if here.isupper() and (
            before.islower() or before.isnumeric() or before.isupper() and i + 1 < len(word) and word[i + 1].islower()
        ):
            cuts.append(i)
    return list(zip(cuts, [*cuts[1:], len(word)], strict=True))


def units_of(text: str) -> list[tuple[str, int, int]]:
    """Units of a text in lower case, with their places."""
    out = []
    for m in WORD.finditer(text):
        at, word = m.start(), m.group()
        if word.islower() or word.isdigit():
            out.append((word, at, m.end()))
        else:
            out += [(word[a:b].lower(), at + a, at + b) for a, b in parts(word)]
    return out


def unit_hash(unit: str) -> int:
    return int.from_bytes(blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class WordHashes(dict):
    """Hashes of the units of a word, 8 bytes each; forgets everything when full."""

    def __missing__(self, word: str) -> bytes:
        found = b"".join(unit_hash(word[a:b].lower()).to_bytes(8, "little") for a, b in parts(word))
        if len(self) >= HELD_WORDS:
            self.clear()
        self[word] = found
        return found


def name_key(name: str, scope: str | None) -> int | None:
    """Signed hash of a name's first units (``LOOKUP`` of them, if it has as many), and of the folder it holds for."""
    found = [unit_hash(u) for u, _, _ in units_of(name)[:LOOKUP]]
    if not found:
        return None
    key = 0
    for h in found:
        key = (key * _PAIR + h) & _MASK
    key = key if scope is None else (key + unit_hash(scope) * _SCOPE) & _MASK
    return key - (1 << 64) if key >> 63 else key


def text_keys(hashes: np.ndarray, rows: np.ndarray, scopes: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of all runs of 1 to ``LOOKUP`` units in the same row, and their rows, one run length at a time."""
    with np.errstate(over="ignore"):
        run = hashes
        for n in range(1, LOOKUP + 1):
            if n > 1:
                run = run[:-1] * np.uint64(_PAIR) + hashes[n - 1 :]
            same = rows[: len(run)] == rows[n - 1 :]
            keys, owners = run[same], rows[: len(run)][same]
            yield (keys if scopes is None else keys + scopes[owners] * np.uint64(_SCOPE)), owners
            if len(run) < 2:
                return


def in_filter(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers of the keys that the Bloom filter ``words`` (64 bits each) may hold."""
    size, left = np.uint64(len(words) * 64), np.arange(len(keys))
    for i in range(PROBES):
        low, high = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)
        spot = (low + np.uint64(i) * high) % size
        held = np.flatnonzero(words[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1))
        keys, left = keys[held], left[held]
    return left


class Shapes(dict):
    """Units of a name, what stands between them, before and after them; forgets everything when full."""

    def __missing__(self, name: str) -> tuple[tuple[str, ...], tuple[str, ...], str, str]:
        found = units_of(name)
        gaps = tuple(name[x[2] : y[1]] for x, y in zip(found, found[1:], strict=False))
        if len(self) >= HELD_NAMES:
            self.clear()
        self[name] = out = (tuple(u for u, _, _ in found), gaps, name[: found[0][1]], name[found[-1][2] :])
        return out


def replaced(text: str, names: list[tuple[str, str]], fixed: tuple[str, ...], shapes: dict) -> str:
    """``text`` with its (name, placeholder) pairs replaced: leftmost first, then the one of most units.

    What reads as a placeholder already, in the text as it comes, stays.  Inside an identifier a
    placeholder loses its blanks, so that the identifier stays one.
    """
    table: dict[str, list] = {}
    for name, put in names:
        units, gaps, before, after = shapes[name]
        table.setdefault(units[0], []).append((units, gaps, before, after, put, name))
    for found in table.values():
        found.sort(key=lambda x: (-len(x[0]), -len(x[5]), x[5], x[4]))
    kept = np.zeros(len(text) + 1, bool)
    for literal in fixed:
        start = text.find(literal)
        while start >= 0:
            kept[start : start + len(literal)] = True
            start = text.find(literal, start + 1)
    found, out, done, i = units_of(text), [], 0, 0
    while i < len(found):
        hit = None
        for units, gaps, before, after, put, _ in table.get(found[i][0], ()):
            if i + len(units) > len(found) or any(found[i + k][0] != units[k] for k in range(1, len(units))):
                continue
            between = [text[found[i + k][2] : found[i + k + 1][1]] for k in range(len(gaps))]
            if any(gap not in JOINS and gap != own for gap, own in zip(between, gaps, strict=True)):
                continue
            start, end = found[i][1], found[i + len(units) - 1][2]
            if before and text.endswith(before, done, start):
                start -= len(before)
            if after and text.startswith(after, end):
                end += len(after)
            if not kept[start:end].any():
                hit = (start, end, put, len(units))
                break
        if hit is None:
            i += 1
            continue
        start, end, put, count = hit
        inside = _joined(text, start - 1) or _joined(text, end) or not text[start:end].isalnum() and "_" in text[start:end]
        out += [text[done:start], put.replace(" ", "") if inside else put]
        done, i = end, i + count
        while i < len(found) and found[i][1] < done:
            i += 1
    return "".join([*out, text[done:]])


def _joined(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at] == "_" or text[at].isalnum())
