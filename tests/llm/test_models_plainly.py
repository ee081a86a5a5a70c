"""Fitted models recomputed in plain code: compiled rules, lasso weights, boosted trees, lexical features."""

from __future__ import annotations

import math
import pickle
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm.rule_ensemble import (
    EnsembleParams, _holds, fit_ensemble, lasso_logistic, rule_scores, score_expression, text_features, tree_rules,
)
from corpusmill.llm.text_stats import FEATURES
from corpusmill.llm.url_filter import UrlParams, fit_urls, lexical, url_chances, with_rules


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_compiled_rules_score_as_the_rules_do(docs, labels):
    params = EnsembleParams(trees=6, steps=80, min_leaf=3)
    model = fit_ensemble(docs, labels, params)
    rules, bias = pickle.loads(model)
    assert rules
    rows = text_features(docs).withColumn("score", score_expression(model)).collect()
    for r in rows:
        total = bias
        for conditions, weight in rules:
            if all((r[FEATURES[f]] <= cut) if below else (r[FEATURES[f]] > cut) for f, below, cut in conditions):
                total += weight
        assert math.isclose(r.score, sigmoid(total), rel_tol=1e-9)
    scored = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in rule_scores(docs, labels, params).collect())
    assert scored == sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in rows)


def test_rules_are_conjunctions_of_tree_paths():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.1)).astype(float)
    rules = tree_rules(x, y, EnsembleParams(trees=4, min_leaf=5))
    assert len(rules) == len(set(rules)) and all(len(r) for r in rules)
    for rule in rules:
        plain = np.array([all((row[f] <= cut) if below else (row[f] > cut) for f, below, cut in rule) for row in x])
        assert (plain == _holds(x, rule).astype(bool)).all() and 0 < plain.sum() < len(x)
    both = [r for r in rules if {f for f, _, _ in r} >= {0, 3}]
    assert both  # the interaction is a rule


@pytest.mark.parametrize("penalty", [0.002, 0.02])
def test_lasso_weights_are_optimal(penalty):
    draw = np.random.default_rng(7)
    z = (draw.random((500, 12)) < 0.4).astype(float)
    y = (draw.random(500) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1.5 * z[:, 4])))).astype(float)
    w, bias = lasso_logistic(z, y, penalty, 3000)
    error = 1 / (1 + np.exp(-(z @ w + bias))) - y
    slope = z.T @ error / len(y)
    assert abs(error.mean()) < 1e-4  # the intercept is free
    assert (np.abs(slope[w == 0]) <= penalty + 1e-4).all()
    assert np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-4)
    assert w[0] > 0 > w[4] or penalty > 0.01


def plain_features(url, host, path, stats, share):
    size = max(len(url), 1)
    labels, parts = host.split("."), path.split("/")
    names = (labels[-1], ".".join(labels[-2:]), labels[-1] + "/" + (parts[1] if len(parts) > 1 else ""))
    found = [s.get(n, (0, share)) for s, n in zip(stats, names, strict=True)]
    query = url.split("#")[0].split("?", 1)[1] if "?" in url.split("#")[0] else ""
    return [
        len(url), len(host), len(path), len(parts) - 1, len([c for c in url if c.isdigit()]) / size,
        sum(-n / size * math.log(n / size, 2) for n in Counter(url).values()), len([p for p in query.split("&") if p]),
        len(labels), sum(c == "-" for c in host), int("#" in url), int("." in parts[-1]), found[0][1],
        math.log(1 + found[0][0]), found[1][1], math.log(1 + found[1][0]), found[2][1],
    ]


def value_of(tree, x):
    while isinstance(tree, tuple):
        f, cut, left, right = tree
        tree = left if x[f] <= cut else right
    return tree


def test_url_chances_are_those_of_the_trees(spark):
    draw = random.Random(3)
    urls = [
        f"http{draw.choice(['', 's'])}://{draw.choice(['a', 'b-c', 'www.d'])}.{draw.choice(['com', 'net', 'de'])}/"
        + "/".join(draw.choice(["x", "y1", "77", "p.html"]) for _ in range(draw.randrange(4)))
        + draw.choice(["", "?a=1&b=&&c", "#f", "?q#f?x=1"])
        for _ in range(500)
    ] + ["no scheme", "", "http://É.de/ü?ß"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    named = with_rules(frame, (), "page_id", "url")
    params = UrlParams()
    label = (F.length("url") % 2).cast("int")
    model = fit_urls(named.withColumn("label", label), params)
    stats, share, start, trees = pickle.loads(model)
    assert trees
    for r in url_chances(named, model, params).collect():
        # Cuts are values of the sample, so the trees get the same last bits.
        x = lexical(r.url, r.host, r.path, stats, share)
        assert np.allclose(x, plain_features(r.url, r.host, r.path, stats, share), rtol=1e-12)
        assert math.isclose(r.chance, sigmoid(start + params.rate * sum(value_of(t, x) for t in trees)), rel_tol=1e-6)
