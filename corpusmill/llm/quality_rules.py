"""Quality rules: counted base rules, then a calibrated n-gram logistic regression."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pieces, text_bytes
from corpusmill.llm.text_stats import BASE, base_counts, mix, row_sums
from corpusmill.llm.training import calibration, fitted, labelled_sample, logistic


@dataclass(frozen=True)
class QualityParams:
    """``max_rows`` bounds the labelled rows that the model is fitted on."""

    max_rows: int = 4000
    bits: int = 16
    char_order: int = 4
    steps: int = 80
    ridge: float = 1e-4
    min_words: int = 50
    max_repeat_percent: int = 50
    keep_from: float = 0.3


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number per character (its UTF-8 bytes) and the row offsets counted in characters."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[starts].astype(np.uint32)
    wide = np.flatnonzero(points >= 0xC0)
    # A lead byte says how many bytes follow: 0xC0 one, 0xE0 two, 0xF0 three.
    for j, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        wide = wide[data[starts[wide]] >= least]
        points[wide] = points[wide] << np.uint32(8) | data[starts[wide] + j]
    return points, np.searchsorted(starts, offsets)


def _gram_buckets(data, offsets, words, params) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of word 1-grams, word 2-grams and character n-grams, each with row offsets.

    A row's last word has no pair and its last characters no whole n-gram; they
    all go to one bucket, so that a score never depends on the rows beside it.
    """
    size = 1 << params.bits
    starts, ends, first, hashes = words
    out = [((hashes & np.uint64(size - 1)).astype(np.int64), first)]
    pair = np.zeros(len(hashes), np.uint64)
    if len(hashes) > 1:
        pair[:-1] = mix(hashes[:-1] * BASE + hashes[1:])
    ends_row = first[1:][np.diff(first) > 0] - 1
    pair[ends_row] = 0
    out.append((((pair & np.uint64(size - 1)) + np.uint64(size)).astype(np.int64), first))
    points, bounds = _characters(data, offsets)
    code = np.zeros(len(points), np.uint32)
    for j in range(params.char_order):
        code *= np.uint32(0x01000193)
        code[: max(len(points) - j, 0)] ^= points[j:]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    code ^= code >> np.uint32(13)
    for j in range(1, params.char_order):
        last = bounds[1:] - j
        code[last[last >= bounds[:-1]]] = 0
    out.append(((code & np.uint32(size - 1)).astype(np.int64) + 2 * size, bounds))
    return out


def _fit(params: QualityParams):
    def fit(sample: pa.Table) -> bytes:
        sample = sample.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        labels = sample.column("label").to_numpy()
        if labels.min() == labels.max():
            return b""
        data, offsets = text_bytes(sample.column("text"))
        n, size = len(labels), 3 << params.bits
        rows, columns, values = [], [], []
        for at in range(0, n, 64):
            to = min(at + 64, n)
            cut = offsets[at : to + 1] - offsets[at]
            part = data[offsets[at] : offsets[to]]
            words = base_counts(part, cut)["_words"]
            for bucket, bounds in _gram_buckets(part, cut, words, params):
                count = np.diff(bounds)
                row = np.repeat(np.arange(at, to), count)
                key, times = np.unique(row * size + bucket, return_counts=True)
                rows.append(key // size)
                columns.append(key % size)
                values.append(times / np.maximum(count, 1)[key // size - at])
        rows, columns, values = map(np.concatenate, (rows, columns, values))
        mean = np.bincount(columns, values, size) / n
        scale = 1 / np.sqrt(mean + 1e-5)
        values = (values * scale[columns]).astype(np.float64)
        fold = np.arange(n) % 5 == 4
        use = ~fold[rows]
        r, c, v = rows[use], columns[use], values[use]
        y, weight = labels, np.zeros(n)
        for k in (0, 1):
            own = (labels == k) & ~fold
            weight[own] = 0.5 / max(own.sum(), 1)
        w, bias, m, s = np.zeros(size), 0.0, np.zeros(size + 1), np.zeros(size + 1)
        for step in range(1, params.steps + 1):
            p = logistic(np.bincount(r, w[c] * v, n) + bias)
            error = weight * (p - y)
            gradient = np.append(np.bincount(c, error[r] * v, size) + params.ridge * w, error.sum())
            m = 0.9 * m + 0.1 * gradient
            s = 0.99 * s + 0.01 * gradient**2
            move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            w -= move[:-1]
            bias -= move[-1]
        raw = np.bincount(rows, w[columns] * values, n) + bias
        slope, shift = calibration(raw[fold], labels[fold])
        return pickle.dumps(((w * scale).astype(np.float32), bias, slope, shift))

    return fit


def fit_quality(docs: DataFrame, labels: DataFrame, params: QualityParams, key="doc_id", text="text") -> bytes:
    """Model as bytes; empty if the labels hold one class only."""
    return fitted(labelled_sample(docs, labels, "quality", params.max_rows, key, text), _fit(params))


def quality_rules(
    docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), key="doc_id", text="text"
) -> DataFrame:
    """Counts, base rules, calibrated probability and verdict for every row of ``docs``.

    Base rules fail texts with fewer than ``min_words`` words or with more than
    ``max_repeat_percent`` of the words in repeated 3-word windows.  The others
    are kept if the probability of good quality is at least ``keep_from``.  The
    model: logistic regression over hashed word 1- and 2-grams and character
    n-grams of whole texts, calibrated on rows that it was not fitted on; texts
    are scored in Arrow batches.  Null texts have no words, so they fail.
    Without usable labels the probability is null and the base rules decide.
    Repeated rows each get their result; columns other than ``key`` and
    ``text`` are not read.
    """
    model = fit_quality(docs, labels, params, key, text)
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, probability double"
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, slope, shift = pickle.loads(model) if model else (None, 0.0, 0.0, 0.0)
        for batch in pieces(batches, "text"):
            data, offsets = text_bytes(batch.column(1))
            base = base_counts(data, offsets)
            failed = (base["n_words"] < params.min_words) | (
                100 * base["n_repeat_words"] > params.max_repeat_percent * base["n_words"]
            )
            chance = None
            if model:
                total = np.full(batch.num_rows, bias)
                for bucket, bounds in _gram_buckets(data, offsets, base["_words"], params):
                    total += row_sums(weights[bucket], bounds) / np.maximum(np.diff(bounds), 1)
                chance = logistic(slope * total + shift)
            kept = ~failed & (chance >= params.keep_from) if model else ~failed
            columns = [base[c].astype(np.int64) for c in schema_names[1:6]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *map(pa.array, columns), pa.array(failed), pa.array(kept),
                    pa.array(chance, pa.float64()) if model else pa.nulls(batch.num_rows, pa.float64()),
                ],
                schema_names,
            )

    schema_names = [f.split()[0] for f in schema.split(", ")]
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, schema)
