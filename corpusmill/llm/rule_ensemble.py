"""Quality classifier: tree paths as rules, lasso weights, compiled into Spark column expressions."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusmill.llm.common import pieces, text_bytes
from corpusmill.llm.text_stats import FEATURES, feature_matrix
from corpusmill.llm.training import fitted, labelled_sample, logistic

#: One condition of a rule: feature, True for ``<=`` and False for ``>``, threshold.
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class EnsembleParams:
    """``max_rows`` bounds the labelled rows that the model is fitted on."""

    max_rows: int = 8000
    trees: int = 40
    depth: int = 3
    rate: float = 0.1
    subsample: float = 0.5
    min_leaf: int = 20
    bins: int = 64
    penalty: float = 3e-4
    steps: int = 300
    threshold: float = 0.3


def _grow(x, residual, rows, path: tuple[Condition, ...], params, cuts, binned, out) -> None:
    """Least-squares tree; appends every node's path and leaf step to ``out``."""
    if path:
        out.append((path, float(residual[rows].mean())))
    if len(path) >= params.depth or len(rows) < 2 * params.min_leaf:
        return
    best = (1e-9, None, None)
    total, n = residual[rows].sum(), len(rows)
    for f in range(x.shape[1]):
        width = len(cuts[f]) + 1
        if width < 2:
            continue
        count = np.bincount(binned[rows, f], minlength=width).cumsum()[:-1]
        sums = np.bincount(binned[rows, f], residual[rows], width).cumsum()[:-1]
        usable = (count >= params.min_leaf) & (n - count >= params.min_leaf)
        if not usable.any():
            continue
        right = np.maximum(n - count, 1)
        gain = np.where(usable, sums**2 / np.maximum(count, 1) + (total - sums) ** 2 / right - total**2 / n, 0)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), f, at)
    if best[1] is None:
        return
    _, f, at = best
    left = binned[rows, f] <= at
    for side, part in ((True, rows[left]), (False, rows[~left])):
        _grow(x, residual, part, (*path, (f, side, float(cuts[f][at]))), params, cuts, binned, out)


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, below, cut in rule:
        out &= (x[:, f] <= cut) if below else (x[:, f] > cut)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, params: EnsembleParams) -> list[tuple[Condition, ...]]:
    """Distinct node paths of boosted shallow trees, each fitted to a random part of the rows."""
    cuts = []
    for f in range(x.shape[1]):
        cuts.append(np.unique(np.quantile(x[:, f], np.arange(1, params.bins) / params.bins)))
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    draw = np.random.default_rng(11)
    raw, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(params.trees):
        rows = np.flatnonzero(draw.random(len(y)) < params.subsample)
        nodes: list = []
        _grow(x, y - logistic(raw), rows, (), params, cuts, binned, nodes)
        inner = {path[:-1] for path, _ in nodes}
        for path, step in nodes:
            rules.setdefault(tuple(sorted(path)), None)
            if path not in inner:
                raw += params.rate * 4 * step * _holds(x, path)
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights (many exactly zero) and intercept by accelerated proximal gradient steps."""
    n = len(y)
    size = 0.25 * np.linalg.norm(z, 2) ** 2 / n + 0.25
    w, bias = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    w0, bias0, t = w, bias, 1.0
    for _ in range(steps):
        error = (logistic(z @ w0 + bias0) - y) / n
        moved = w0 - z.T @ error / size
        new = np.sign(moved) * np.maximum(np.abs(moved) - penalty / size, 0)
        new_bias = bias0 - error.sum() / size
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w0, bias0 = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    return w, bias


def _fit(params: EnsembleParams):
    def fit(sample: pa.Table) -> bytes:
        sample = sample.sort_by([(c, "ascending") for c in ("doc_id", *FEATURES)])
        y = sample.column("label").to_numpy()
        if y.min() == y.max():
            return b""
        x = np.column_stack([sample.column(f).to_numpy() for f in FEATURES])
        rules = tree_rules(x, y, params)
        z = np.column_stack([_holds(x, r) for r in rules]).astype(np.float64)
        scale = np.maximum(z.std(axis=0), 0.05)
        w, bias = lasso_logistic(z / scale, y, params.penalty, params.steps)
        kept = [(r, float(v)) for r, v in zip(rules, w / scale) if v]
        return pickle.dumps((kept, bias))

    return fit


def text_features(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the carried columns and ``FEATURES`` of every row (null text: as empty)."""
    names = ["doc_id", *carry, *FEATURES]
    chosen = docs.select(F.col(key).alias("doc_id"), *carry, F.col(text).alias("text"))
    schema = StructType([*chosen.drop("text").schema.fields, *[StructField(c, DoubleType()) for c in FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            matrix = feature_matrix(*text_bytes(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(np.ascontiguousarray(c)) for c in matrix.T]], names
            )

    return chosen.mapInArrow(run, schema)


def score_expression(model: bytes) -> Column:
    """The ensemble as one column expression over ``FEATURES``; 1 where nothing could be learnt."""
    if not model:
        return F.lit(1.0)
    rules, bias = pickle.loads(model)
    total = F.lit(bias)
    for rule, weight in rules:
        holds = F.lit(True)
        for f, below, cut in rule:
            column = F.col(FEATURES[f])
            holds = holds & ((column <= cut) if below else (column > cut))
        total = total + F.when(holds, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit_ensemble(docs: DataFrame, labels: DataFrame, params: EnsembleParams, key="doc_id", text="text") -> bytes:
    sample = labelled_sample(docs, labels, "quality", params.max_rows, key, text)
    return fitted(text_features(sample, carry=("label",)), _fit(params))


def rule_scores(
    docs: DataFrame, labels: DataFrame, params: EnsembleParams = EnsembleParams(), key="doc_id", text="text"
) -> DataFrame:
    """``doc_id``, ``score`` (probability of quality 1) and ``predicted`` of every row.

    Only statistics of the whole text are inputs.  Null and empty texts have
    statistics of zero and get a score like any other.  Without two label
    classes every row scores 1.  Rows that repeat are scored each; columns
    other than ``key`` and ``text`` are not read.  Labels of the held-out fifth
    are never learnt from.
    """
    score = score_expression(fit_ensemble(docs, labels, params, key, text))
    return (
        text_features(docs, key, text)
        .select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"))
        .withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))
    )


def quality_kept(
    docs: DataFrame, labels: DataFrame, params: EnsembleParams = EnsembleParams(), key="doc_id", text="text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier accepts; texts are not shuffled."""
    model = fit_ensemble(docs, labels, params, key, text)
    marked = text_features(docs.withColumn("_row", F.struct("*")), key, text, carry=("_row",))
    return marked.where(score_expression(model) >= params.threshold).select("_row.*")
