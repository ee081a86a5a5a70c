"""Choosing files by rule when nobody supplied requests: layer, fitness, order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.languages import code_line_mask, is_code_language, language_of, ones_in
from corpusmill.functions.paths import below_any, module_of
from corpusmill.functions.text import decode_text, text_lines
from corpusmill.operators.quotas import steered_requests
from corpusmill.operators.redaction import SECRET_RULES
from corpusmill.operators.skew import ranked
from corpusmill.params import BudgetParams, CandidateParams, ScanParams
from corpusmill.schemas import LOGIC_LAYERS
from corpusmill.sources.materialize import materialized

# Pieces of text that show control flow or generated code.
FLOW_MARKS = ("if ", "if(", "for ", "for(", "while ", "while(", "switch", "catch", "except")
GENERATED_MARKS = ("do not edit", "@generated", "autogenerated", "auto-generated")
DENSE_FLOW = 0.15

# Layer by lower-case path, first match wins; plain RE2-compatible patterns.
PATH_RULES = (
    ("test", r"(^|/)(tests?|spec|__tests__)/|(^|/)test_[^/]*$|[._-](test|spec)\.[^/]*$"),
    ("autogen", r"(^|/)(gen|generated|migrations)/|\.min\.[a-z]+$|\.pb\.[a-z]+$|_pb2\.py$|(^|/)[^/]*[.-]lock(\.[a-z]+)?$"),
    ("infra", r"(^|/)(\.github|ci|deploy|docker|infra|scripts|terraform)/|(^|/)(dockerfile|makefile)$|\.(tf|hcl|cmake|gradle|sh|bash|bat|ps1)$"),
    ("data", r"(^|/)(dao|queries|repositories|etl)/|\.sql$"),
    ("api", r"(^|/)(api|routes?|controllers?|handlers?|endpoints?)/"),
    ("boilerplate", r"(^|/)(config|dto|models|constants)/|(^|/)(__init__|settings|constants)\.[a-z]+$"),
    ("util", r"(^|/)(utils?|helpers?|common|shared)/"),
    ("algorithm", r"(^|/)(core|engine|algorithms?|parser)/"),
)


def _occurrences(text: Column, piece: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)


def file_features(files: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """Mask, control-flow marks, generated and secret signs: one pass over the
    content.  Write the result once (``materialized``)."""
    lowered = F.lower("text")
    text_rows = (
        files.where((F.col("size") > 0) & (F.col("size") <= params.max_file_bytes))
        .where(~below_any(F.col("path"), params.excluded_dirs))
        .select(
            "repo_url", "path", "size",
            language_of(F.col("path")).alias("language"),
            decode_text(F.col("content")).alias("text"),
        )
        .where(F.col("language") != "")
        .select("*", text_lines(F.col("text")).alias("lines"), lowered.alias("lowered"))
    )

    def any_of(pieces: tuple[str, ...]) -> Column:
        return reduce(Column.__or__, [F.contains("lowered", F.lit(piece)) for piece in pieces])

    flow = reduce(Column.__add__, [_occurrences(F.col("text"), mark) for mark in FLOW_MARKS])
    return text_rows.select(
        "repo_url", "path", "size", "language",
        code_line_mask(F.col("lines"), F.col("language")).alias("mask"),
        F.round(flow).cast("bigint").alias("flow_marks"),
        any_of(GENERATED_MARKS).alias("is_generated"),
        reduce(
            Column.__or__, [any_of(needed) & F.col("text").rlike(secret) for needed, secret, _ in SECRET_RULES]
        ).alias("has_secret"),
    )


def layer_of(path: Column, language: Column, loc: Column, flow_marks: Column, generated: Column) -> Column:
    """Layer by rule; the default of ``tagged_layers``."""
    lowered = F.lower(path)
    rules = F.when(generated, "autogen")
    for layer, pattern in PATH_RULES:
        rules = rules.when(lowered.rlike(pattern), layer)
    dense = flow_marks >= DENSE_FLOW * F.greatest(loc, F.lit(1))
    return (
        rules.when(~is_code_language(language), "boilerplate")
        .when(dense, "business")
        .otherwise("util")
    )


def tagged_layers(features: DataFrame, layer_fn=layer_of) -> DataFrame:
    """Features with ``loc`` and ``layer``; a supplied layer column wins."""
    rows = features.withColumn("loc", ones_in(F.col("mask")))
    by_rule = layer_fn(
        F.col("path"), F.col("language"), F.col("loc"), F.col("flow_marks"), F.col("is_generated")
    )
    if "layer" in features.columns:
        return rows.withColumn("layer", F.coalesce("layer", by_rule))
    return rows.withColumn("layer", by_rule)


def numbered_candidates(
    tagged: DataFrame,
    primaries: DataFrame | None = None,
    budget: BudgetParams = BudgetParams(),
    params: CandidateParams = CandidateParams(),
) -> DataFrame:
    """Save requests in order, with language and lines: modules take turns, logic and middle-sized files
    of the focus language first, one test file after five others.

    Generated files, secrets, low-value sizes and non-code are left out; very
    long files are asked for in part.
    """
    fit = tagged.where(
        is_code_language(F.col("language"))
        & ~F.col("is_generated")
        & ~F.col("has_secret")
        & (F.col("layer") != "autogen")
    )
    if primaries is None:
        fit = fit.withColumn("primary", F.lit(None).cast("string"))
    else:
        fit = fit.join(primaries.select("repo_url", "primary"), "repo_url", "left")
    long = F.col("loc") > params.partial_above_loc
    rows = (
        fit.select(
            "repo_url",
            "path",
            "layer",
            "language",
            module_of(F.col("path")).alias("module"),
            (F.col("layer") == "test").alias("is_test"),
            F.when(long, 1).cast("int").alias("start_line"),
            F.when(long, params.preferred_max_loc).cast("int").alias("end_line"),
            F.when(long, ones_in(F.substring("mask", 1, params.preferred_max_loc)))
            .otherwise(F.col("loc")).alias("loc"),
            F.coalesce((F.col("language") != F.col("primary")).cast("int"), F.lit(0)).alias("off_focus"),
            (~F.col("layer").isin(*LOGIC_LAYERS)).cast("int").alias("off_logic"),
        )
        .where((F.col("loc") >= params.min_loc) & (F.col("loc") <= budget.cap_loc))
        .withColumn(
            "off_size",
            (~F.col("loc").between(params.preferred_min_loc, params.preferred_max_loc)).cast("int"),
        )
    )
    # Every row is numbered; what the budget can take of them is decided later, by ``budget_select``.
    rows = ranked(rows, ["repo_url", "is_test", "module"], ["off_focus", "off_logic", "off_size", "path"], "round")
    rows = ranked(rows, ["repo_url", "is_test"], ["round", "module", "path"], "nth")
    seq = F.when(F.col("is_test"), F.col("nth") * 6).otherwise(
        F.col("nth") + F.floor((F.col("nth") - 1) / 5)
    )
    return rows.select(
        "repo_url", seq.cast("bigint").alias("seq"), "path", "layer", "language", "loc", "start_line", "end_line"
    )


def candidate_requests(
    tagged: DataFrame,
    primaries: DataFrame | None = None,
    budget: BudgetParams = BudgetParams(),
    params: CandidateParams = CandidateParams(),
) -> DataFrame:
    """``numbered_candidates`` as requests of ``budget_select``; with ``steer_shares`` those of ``steered_requests`` only."""
    rows = numbered_candidates(tagged, primaries, budget, params)
    if params.steer_shares:
        rows = steered_requests(materialized(rows, "candidates"), budget, params)
    return rows.select("repo_url", "seq", "path", "layer", "start_line", "end_line")
