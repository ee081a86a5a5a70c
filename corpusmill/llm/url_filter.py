"""URL verdicts: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.training import fitted, logistic

# The rules of the production query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class UrlParams:
    """``max_rows`` bounds the labelled urls that the trees are fitted on."""

    max_rows: int = 20000
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    min_leaf: int = 15
    bins: int = 48
    block_from: float = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr("substring(_url, instr(_url, '://') + 3)")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, low).otherwise(""), F.when(has, path).otherwise("")


def with_rules(urls: DataFrame, rules, key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id``, ``url``, ``host``, ``path``, ``rule`` and ``rule_verdict`` (null where no rule fits).

    A rule fits its host and all subdomains where the path starts with its path;
    the one with the longest host and path wins.  ``rules`` is configuration of
    a few entries and becomes one expression.
    """
    chosen = urls.select(F.col(key).alias("page_id"), F.col(url).alias("_url"))
    host, path = url_parts(F.col("_url"))
    named = chosen.select("page_id", F.col("_url").alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, where, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == where) | F.col("host").endswith("." + where)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, where + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return named.withColumns({"rule": rule, "rule_verdict": verdict})


FEATURES = (
    "length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens",
    "fragment", "extension", "top_rate", "top_count", "suffix_rate", "suffix_count", "segment_rate",
)


def suffixes(host: str, path: str) -> tuple[str, str, str]:
    """Last label, last two labels, and last label with the first path segment."""
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]), labels[-1] + "/" + (path.split("/")[1] if "/" in path else "")


def statistics(names: list[tuple[str, str, str]], labels: np.ndarray) -> list[dict[str, tuple[int, float]]]:
    """Per kind of suffix: how often it was labelled, and its smoothed share of label 1."""
    share, out = labels.mean(), []
    for kind in range(3):
        count, ones = Counter(), Counter()
        for name, label in zip(names, labels):
            count[name[kind]] += 1
            ones[name[kind]] += label
        out.append({n: (c, (ones[n] + 5 * share) / (c + 5)) for n, c in count.items()})
    return out


def lexical(url: str | None, host: str, path: str, stats, share: float) -> list[float]:
    url = url or ""
    size = max(len(url), 1)
    entropy = -sum(c / size * math.log2(c / size) for c in Counter(url).values())
    query = url.split("#", 1)[0].partition("?")[2]
    top, suffix, segment = (s.get(n, (0, share)) for s, n in zip(stats, suffixes(host, path)))
    return [
        len(url), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url) / size, entropy,
        len([p for p in query.split("&") if p]), host.count(".") + 1, host.count("-"), "#" in url,
        "." in path.rsplit("/", 1)[-1], top[1], math.log1p(top[0]), suffix[1], math.log1p(suffix[0]), segment[1],
    ]


def _tree(x, gradient, weight, rows, depth: int, cuts, binned, params):
    """Newton step tree as nested tuples (feature, cut, left, right); a leaf is a number."""
    g, h = gradient[rows].sum(), weight[rows].sum()
    leaf = float(g / (h + 1.0))
    if depth == params.depth or len(rows) < 2 * params.min_leaf:
        return leaf
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        width = len(cuts[f]) + 1
        if width == 1:
            continue
        n = np.bincount(binned[rows, f], minlength=width).cumsum()[:-1]
        gl = np.bincount(binned[rows, f], gradient[rows], width).cumsum()[:-1]
        hl = np.bincount(binned[rows, f], weight[rows], width).cumsum()[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(n < params.min_leaf) | (len(rows) - n < params.min_leaf)] = 0
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), f, at)
    if best[1] is None:
        return leaf
    _, f, at = best
    below = binned[rows, f] <= at
    grow = lambda part: _tree(x, gradient, weight, part, depth + 1, cuts, binned, params)
    return f, float(cuts[f][at]), grow(rows[below]), grow(rows[~below])


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, _value(left, x), _value(right, x))


def boosted(x: np.ndarray, y: np.ndarray, params: UrlParams) -> tuple[float, list]:
    """Gradient boosting of the logistic loss with histogram splits."""
    cuts = [np.unique(np.quantile(c, np.arange(1, params.bins) / params.bins, method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    raw, trees, every = np.full(len(y), start), [], np.arange(len(y))
    for _ in range(params.trees):
        p = logistic(raw)
        tree = _tree(x, y - p, p * (1 - p), every, 0, cuts, binned, params)
        raw += params.rate * _value(tree, x)
        trees.append(tree)
    return start, trees


def _fit(params: UrlParams):
    def fit(sample: pa.Table) -> bytes:
        rows = sorted(zip(*(sample.column(c).to_pylist() for c in ("url", "host", "path", "label"))))
        y = np.array([r[3] for r in rows], np.float64)
        if y.min() == y.max():
            return pickle.dumps((None, float(y.min()), None, None))
        # A row's own label is kept out of its statistics: two halves exchange theirs.
        names, half = [suffixes(r[1], r[2]) for r in rows], np.arange(len(rows)) % 2 == 0
        x = np.zeros((len(rows), len(FEATURES)))
        for side in (half, ~half):
            stats = statistics([n for n, s in zip(names, ~side) if s], y[~side])
            for i in np.flatnonzero(side):
                x[i] = lexical(*rows[i][:3], stats, y[~side].mean())
        start, trees = boosted(x, y, params)
        return pickle.dumps((statistics(names, y), float(y.mean()), start, trees))

    return fit


def fit_urls(labelled: DataFrame, params: UrlParams) -> bytes:
    """Trees from rows with url, host, path and label (1: block); at most ``max_rows``, drawn by hash order."""
    sample = (
        labelled.where("url is not null and label is not null")
        .select("url", "host", "path", F.col("label").cast("double").alias("label"))
        .orderBy(F.xxhash64("url", F.lit(3)), "url", "label").limit(params.max_rows)
    )
    return fitted(sample, _fit(params))


def url_chances(named: DataFrame, model: bytes, params: UrlParams) -> DataFrame:
    """``named`` (page_id, url, host, path, rule, rule_verdict) with ``chance`` that the url is one to block."""
    fields = [f"{c} {t}" for c, t in named.dtypes] + ["chance double"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, share, start, trees = pickle.loads(model) if model else (None, 0.0, None, None)
        at = [named_columns.index(c) for c in ("url", "host", "path")]
        for batch in batches:
            raw = np.full(batch.num_rows, share)
            if trees and batch.num_rows:
                rows = zip(*(batch.column(k).to_pylist() for k in at))
                x = np.array([lexical(*row, stats, share) for row in rows])
                raw = logistic(start + params.rate * sum(_value(t, x) for t in trees))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw)], [*named_columns, "chance"])

    named_columns = named.columns
    return named.mapInArrow(score, ", ".join(fields))


def url_verdicts(
    urls: DataFrame, rules=RULES, labelled: DataFrame | None = None, params: UrlParams = UrlParams(),
    key: str = "page_id", url: str = "url",
) -> DataFrame:
    """Host, path, rule, verdict and block chance of every url.

    The longest fitting rule decides.  The others get the verdict of boosted
    trees on lexical features (lengths, depth, digit ratio, entropy, parameter
    count, statistics of host suffixes), fitted to labelled urls.  ``labelled``
    (columns url, label with 1 for block) may be supplied; without it the urls
    that a rule decides are the labelled ones.  Where nothing is labelled,
    everything that no rule fits is allowed; with one class only, that class
    decides.  Null urls and such without ``://`` have empty host and path and
    are judged by the trees.  Repeated rows are judged each.
    """
    named = with_rules(urls, rules, key, url)
    if labelled is None:
        known = named.where("rule is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("int"))
    else:
        parts = with_rules(labelled, (), "label", "url")
        known = parts.select("url", "host", "path", F.col("page_id").alias("label"))
    model = fit_urls(known, params)
    scored = url_chances(named, model, params)
    own = F.when(F.col("chance") >= params.block_from, "block").otherwise("allow")
    return scored.select(
        "page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "chance"
    )
