"""Word, line and character statistics of whole texts, computed on the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np

# White space of the word rule, symbols of the symbol count.
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

_rng = np.random.default_rng(20240611)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


IS_SPACE, IS_SYMBOL = flags(SPACES), flags(SYMBOLS)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes; changes ``x`` in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; kept between calls up to two million."""
    known = _powers.get(int(base))
    if known is None or len(known) <= n:
        known = np.full(max(n, 1 << 16) + 1, base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= 1 << 21:
            _powers[int(base)] = known
    return known[: n + 1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every ``data[start:end]``; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up = powers(BASE, len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=prefix[1:])
    down = powers(INVERSE, len(data))
    out = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets, which cover all values.

    Fractions are added row by row, so that no sum depends on the rows before.
    """
    if values.dtype.kind in "biu":
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]
    out, filled = np.zeros(len(offsets) - 1), offsets[1:] > offsets[:-1]
    if filled.any():
        out[filled] = np.add.reduceat(values.astype(np.float64), offsets[:-1][filled])
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE):
    """Starts and ends of all words, and for every row the index of its first word (``n + 1`` entries)."""
    edge = np.empty(len(data) + 1, np.uint8)
    solid = 1 - space[data]
    edge[:-1] = solid
    edge[-1] = 0
    begin = solid.copy()
    begin[1:] &= 1 - solid[:-1]
    inner = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    begin[inner] = solid[inner]
    stop = np.zeros(len(data) + 1, np.uint8)
    stop[1:] = solid & (1 - edge[1:])
    stop[inner] = edge[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, offsets)


def repeat_words(hashes: np.ndarray, first: np.ndarray, window: int = 3) -> np.ndarray:
    """Per row, how many words lie in a window of ``window`` words found twice or more in the row."""
    n = len(hashes)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if n < window:
        return np.zeros(len(first) - 1, np.int64)
    m = n - window + 1
    key = np.zeros(m, np.uint64)
    for j in range(window):
        key = key * BASE + hashes[j : j + m]
    inside = rows[:m] == rows[window - 1 :]
    key = mix(key ^ (rows[:m].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    where = np.flatnonzero(inside)
    order = where[np.argsort(key[where], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(m, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for j in range(window):
        covered[j : j + m] |= hit
    return row_sums(covered, first)


def line_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines with a word, and such lines that equal an earlier one of the row."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    rows = np.searchsorted(offsets[1:], starts, "right") if len(starts) else starts
    # A break at the end of a row starts one more, empty, line; it has no word either way.
    ends = np.append(starts[1:], len(data))
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(1 - IS_SPACE[data], out=filled[1:])
    has = (filled[ends] > filled[starts]) & (starts < len(data))
    starts, ends, rows = starts[has], ends[has], rows[has]
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10)) if len(starts) else ends
    key = span_hashes(data, starts, ends)
    key = mix(key ^ (rows.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:][key[order][1:] == key[order][:-1]]] = True
    n = len(offsets) - 1
    return np.bincount(rows, minlength=n), np.bincount(rows[again], minlength=n)


def counted(chars: bytes) -> np.ndarray:
    return flags(chars).astype(bool)


UPPER = counted(bytes(range(65, 91)))
LOWER = counted(bytes(range(97, 123)))
DIGIT = counted(bytes(range(48, 58)))
CONTINUED = counted(bytes(range(128, 192)))
HIGH = counted(bytes(range(192, 256)))
PUNCTUATION = counted(b".,;:!?\"'()-")
STRESS = counted(b"!?")


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per row that both quality operators use, and the words they come from."""
    starts, ends, first = words_of(data, offsets)
    hashes = span_hashes(data, starts, ends)
    lines, dup_lines = line_counts(data, offsets)
    space, after = IS_SPACE[data].astype(bool), CONTINUED[data]
    return {
        "n_words": np.diff(first),
        "word_chars": row_sums(~space & ~after, offsets),
        "n_symbols": row_sums(IS_SYMBOL[data], offsets),
        "n_lines": lines,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words(hashes, first),
        "_words": (starts, ends, first, hashes),
    }


FEATURES = (
    "words_log", "chars_per_word", "lines_log", "words_per_line", "upper_share", "digit_share",
    "symbol_share", "stress_share", "punctuation_share", "high_share", "control_share", "dup_line_share",
    "repeat_word_share", "distinct_word_share", "short_word_share", "long_word_share", "capital_word_share",
    "stop_share",
)


def feature_matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``FEATURES`` of every row; all finite, also for texts without words."""
    base = base_counts(data, offsets)
    starts, ends, first, hashes = base["_words"]
    n_bytes = np.maximum(np.diff(offsets), 1)
    n_words = np.maximum(base["n_words"], 1)
    lines = np.maximum(base["n_lines"], 1)
    share = lambda mask: row_sums(mask[data], offsets) / n_bytes
    per_word = lambda mask: row_sums(mask, first) / n_words
    rows = np.repeat(np.arange(len(offsets) - 1), base["n_words"])
    key = mix(hashes ^ (rows.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    length = ends - starts
    control = np.zeros(256, bool)
    control[:9] = control[14:32] = True
    control[[124, 60, 62, 123, 125, 92, 95, 126, 94]] = True
    last = data[np.maximum(ends - 1, 0)] if len(ends) else data[:0]
    columns = (
        np.log1p(base["n_words"]), base["word_chars"] / n_words, np.log1p(base["n_lines"]), n_words / lines,
        share(UPPER), share(DIGIT), share(IS_SYMBOL.astype(bool)), share(STRESS), share(PUNCTUATION), share(HIGH),
        share(control), base["n_dup_lines"] / lines, base["n_repeat_words"] / n_words,
        np.bincount(rows[order][new], minlength=len(n_words)) / n_words, per_word(length <= 2),
        per_word(length >= 12), per_word(UPPER[data[starts]] if len(starts) else length > 0),
        per_word((last == 46) | (last == 33) | (last == 63)),
    )
    return np.column_stack(columns).astype(np.float64)
