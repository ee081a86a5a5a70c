"""Anchors depend on the window alone, not on the size of the piece."""

from __future__ import annotations

import numpy as np

from corpusmill.llm import suffix_dedup
from corpusmill.llm.suffix_dedup import SuffixParams, anchor_regions
from corpusmill.llm.text_stats import mix


def test_close_hashes_choose_alike_in_any_piece(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: mix(x) & np.uint64(0xFFF))
    draw = np.random.default_rng(1)
    copy, more = draw.integers(97, 122, 300).astype(np.uint8), draw.integers(97, 122, 9000).astype(np.uint8)

    def anchors(data, offsets):
        row, start, count, anchor, _ = anchor_regions(data, np.array(offsets), SuffixParams())
        return [int(a) for r, n, a in zip(row, count, anchor) if r == 0 for _ in range(n)]

    assert anchors(copy, [0, 300]) == anchors(np.concatenate([copy, more]), [0, 300, 9300])
