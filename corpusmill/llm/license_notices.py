"""Fuzzy search for short license notices: exact seeds find candidates, bounded-error matching verifies them.

A notice that stands in a text with at most ``k`` edits leaves at least one of
its ``k + 1`` pieces unchanged (pigeonhole), at most ``k`` characters away from
its place.  One automaton over the pieces of all notices therefore finds every
candidate in one pass over the text; the word-aligned spans around a seed are
then verified by the ``regex`` library with that many errors allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pieces, text_bytes


@dataclass(frozen=True)
class Notice:
    """A phrase in normalised words; ``required`` words must stand in a match unchanged."""

    label: str
    phrase: str
    errors: int
    required: tuple[str, ...] = ()
    base: bool = False


#: The first three are the base phrases; names and versions that tell licenses apart are required words.
NOTICES = (
    Notice("mit", "under the mit license", 2, ("mit",), base=True),
    Notice("apache-2", "apache license version 2", 3, ("2",), base=True),
    Notice("cc-by-nc", "cc by nc", 0, (), base=True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("bsd", "bsd 3 clause license", 1, ("bsd", "3")),
    Notice("bsd", "bsd 2 clause license", 1, ("bsd", "2")),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4),
    Notice("gpl", "gnu general public license", 2, ("gnu",)),
    Notice("lgpl", "gnu lesser general public license", 3, ("gnu",)),
    Notice("agpl", "gnu affero general public license", 3, ("gnu",)),
    Notice("mpl-2", "mozilla public license version 2", 3, ("2",)),
    Notice("public-domain", "released into the public domain", 3),
    Notice("all-rights-reserved", "all rights reserved", 1),
    Notice("spdx", "spdx license identifier", 2, ("spdx",)),
)

#: Space for all ASCII that is no letter or digit, small letters for capitals; bytes of other characters stay.
_NORMAL = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

SPANS = "array<struct<label:string,notice:string,base:boolean,first_word:long,n_words:long,start:long,end:long,edits:int>>"


def normalised(text: bytes) -> str:
    """Words of a UTF-8 text, A-Z as small letters, one space between them."""
    return b" ".join(text.translate(_NORMAL).split()).decode("utf-8")


class Searcher:
    """Seeds and verifiers of a list of notices, built once per task."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices, self.seeds, found = notices, ahocorasick.Automaton(), {}
        self.verify = [regex.compile(f"(?b)(?:{regex.escape(n.phrase)}){{e<={n.errors}}}") for n in notices]
        for number, notice in enumerate(notices):
            if " ".join(notice.phrase.split()) != notice.phrase or not notice.phrase:
                raise ValueError(f"a notice is words with one space between them: {notice.phrase!r}")
            n, k = len(notice.phrase), notice.errors
            if not 0 <= k < n:
                raise ValueError(f"{k} errors leave no piece of {notice.phrase!r}")
            cuts = [n * i // (k + 1) for i in range(k + 2)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                found.setdefault(notice.phrase[start:stop], []).append((number, start))
        for seed, places in found.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def spans(self, words: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) in ``words``, in order.

        Every word-aligned span within a notice's errors that holds its required
        words counts; of spans of one notice that overlap, the one of fewest
        edits stays, then the first, then the shortest.  Exact spans all stay.
        """
        line, best = f" {words} ", {}
        tried: set[tuple[int, int, int]] = set()
        for last, (length, places) in self.seeds.iter(line):
            for number, offset in places:
                notice = self.notices[number]
                n, k = len(notice.phrase), notice.errors
                at = last + 1 - length - offset
                for start in range(max(1, at - k), at + k + 1):
                    if line[start - 1 : start] != " " or line[start : start + 1] in ("", " "):
                        continue
                    end = line.find(" ", max(start + 1, start + n - k))
                    while 0 <= end <= start + n + k:
                        if (number, start, end) not in tried:
                            tried.add((number, start, end))
                            span = line[start:end]
                            match = self.verify[number].fullmatch(span)
                            if match and set(notice.required) <= set(span.split(" ")):
                                best.setdefault(number, []).append((sum(match.fuzzy_counts), start, end))
                        end = line.find(" ", end + 1)
        out = []
        for number, found in best.items():
            kept: list[tuple[int, int, int]] = []
            found.sort()
            exact = [f for f in found if not f[0]]
            # In order of edits a span meets only better ones; those near it are few, as spans of a notice are short.
            taken: dict[int, list[tuple[int, int]]] = {}
            width = 2 * len(self.notices[number].phrase) + 1
            for edits, start, end in [*exact, *found[len(exact) :]]:
                near = [s for cell in range(start // width - 1, end // width + 2) for s in taken.get(cell, [])]
                if edits and any(start < e and s < end for s, e in near):
                    continue
                taken.setdefault(start // width, []).append((start, end))
                kept.append((edits, start, end))
            out += [(start - 1, end - 1, number, edits) for edits, start, end in kept]
        return sorted(out)


def _search(batches: Iterator[pa.RecordBatch], notices: tuple[Notice, ...]) -> Iterator[pa.RecordBatch]:
    searcher = Searcher(notices)
    schema = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([
        ("label", pa.string()), ("notice", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()),
        ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()),
    ])))])
    for batch in pieces(batches, "text"):
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
        raw, counts, spans = data.tobytes(), [], []
        for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words = normalised(raw[start:stop])
            counts.append(words.count(" ") + 1 if words else 0)
            spans.append(_described(searcher, words, raw[start:stop]))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(counts, pa.int64()), pa.array(spans, schema.field("spans").type)],
            schema=pa.schema([pa.field("doc_id", ids.type), *schema]),
        )


def _described(searcher: Searcher, words: str, raw: bytes) -> list[dict]:
    """Spans with their place in the original text, in words and in code points."""
    out, at, count = [], 0, 0
    for start, end, number, edits in searcher.spans(words):
        count += words.count(" ", at, start)
        at = start
        notice = searcher.notices[number]
        out.append({
            "label": notice.label, "notice": notice.phrase, "base": notice.base, "first_word": count,
            "n_words": words.count(" ", start, end) + 1, "edits": edits,
        })
    if out:
        text = raw.decode("utf-8")
        wanted = {s["first_word"] for s in out} | {s["first_word"] + s["n_words"] - 1 for s in out}
        places = {
            i: m.span() for i, m in enumerate(islice(_WORD.finditer(text), max(wanted) + 1)) if i in wanted
        }
        for span in out:
            span["start"] = places[span["first_word"]][0]
            span["end"] = places[span["first_word"] + span["n_words"] - 1][1]
    return out


def notice_spans(
    docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document its ``doc_id``, ``n_words`` and the ``spans`` of notices with label, place and edits.

    Whole texts are searched, whatever their length; one text is in memory at a
    time.  A null or empty text has no words and no spans.  ``start`` and
    ``end`` count code points of the original text.  Repeated rows and ids
    are rows of their own, null ids stay.  An empty table gives no rows.  Only
    ``key`` and ``text`` are read; other columns do not matter, whatever their names.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _search(b, notices), f"doc_id {kind}, n_words long, spans {SPANS}")


def license_digest(spans: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Counts, labels and score of each document.

    Base places are the exact spans of base notices.  The score is 1 less the
    edits of the best span per character of its notice, 0 without a span.
    """
    exact = F.filter("spans", lambda s: s["base"] & (s["edits"] == 0))

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda s: s["label"]))), ",")

    likeness = F.transform("spans", lambda s: 1 - s["edits"].cast("double") / F.length(s["notice"]))
    return spans.select(
        "doc_id", "n_words", F.size(exact).cast("long").alias("n_base"),
        F.array_min(F.transform(exact, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(exact, lambda s: s["first_word"])).alias("last_word"),
        labels(exact).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"),
        "spans",
    )
