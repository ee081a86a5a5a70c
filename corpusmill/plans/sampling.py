"""Sampling from working trees to manifest, for all repositories at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.languages import spelled_language
from corpusmill.operators import candidates, identity, manifest, profile, selection
from corpusmill.params import Settings
from corpusmill.sources.materialize import materialized


@dataclass(frozen=True)
class SamplingResult:
    """Lazy tables of one run."""

    profile: DataFrame
    outcome: DataFrame
    samples: DataFrame
    manifest: DataFrame
    rejected: DataFrame


def sample_repositories(
    files: DataFrame,
    commits: DataFrame | None = None,
    requests: DataFrame | None = None,
    summaries: DataFrame | None = None,
    settings: Settings = Settings(),
    forced_language: str | None = None,
) -> SamplingResult:
    """Profile, choose, fill the budget, roll up and validate.

    Contents are read for line counts, for features, and for the texts of
    accepted files; tables in between are written once.  Without ``requests`` the files are chosen by rule.
    """
    forced_language = spelled_language(forced_language)
    counts = materialized(profile.language_counts(files, settings.scan), "language-counts")
    profiles = profile.language_profile(counts, files.select("repo_url"))
    primary = F.lit(forced_language) if forced_language else F.col("code_primary")
    primaries = profiles.select("repo_url", primary.alias("primary"))
    if requests is None:
        masks = materialized(candidates.file_features(files, settings.scan), "features")
        requests = candidates.candidate_requests(
            candidates.tagged_layers(masks), primaries, settings.budget, settings.candidates
        )
    else:
        masks = materialized(profile.line_masks(files), "masks")
    outcome = materialized(
        selection.budget_select(requests, masks, primaries, settings.budget), "outcome"
    )
    saved = selection.saved_files(outcome)
    rollup = manifest.with_summary(manifest.sample_rollup(saved, primaries), summaries)
    checked = manifest.validate_results(
        profiles.select("repo_url")
        .join(rollup.select("repo_url", "total_loc", "primary", "primary_loc"), "repo_url", "left")
        .fillna({"total_loc": 0, "primary_loc": 0})
        .withColumn("primary_forced", F.lit(forced_language is not None)),
        settings.budget,
    )
    rejected = checked.where(F.col("stage").isNotNull()).select("repo_url", "stage", "error")
    kept = rollup.join(rejected.select("repo_url"), "repo_url", "left_anti")
    heads = None if commits is None else identity.history_ends(commits)
    records = manifest.manifest_records(
        kept, profile.language_shares(profiles), heads, meta=settings.meta,
        forced=F.lit(forced_language is not None),
    )
    samples = selection.sample_texts(
        saved.join(rejected.select("repo_url"), "repo_url", "left_anti"), files
    )
    return SamplingResult(profiles, outcome, samples, records, rejected)
