"""Redacting and packing a sampled corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.urls import folder_name
from corpusmill.operators import audit, identity, packaging, redaction
from corpusmill.params import Settings
from corpusmill.plans.sampling import sample_repositories
from corpusmill.schemas import IDENTITY
from corpusmill.sources import writers
from corpusmill.sources.materialize import materialized


@dataclass(frozen=True)
class RedactionResult:
    texts: DataFrame
    changes: DataFrame
    report: DataFrame


def redact_corpus(
    texts: DataFrame,
    gazetteer: DataFrame | None = None,
    reports: DataFrame | None = None,
    force: bool = False,
) -> RedactionResult:
    """Redact folders without a report and audit every change.

    ``texts``: folder, path, text, summaries included; ``reports``: folder.
    """
    todo = texts
    if reports is not None:
        folders = audit.pending_folders(texts, reports, force=force)
        todo = texts.join(folders, "folder", "left_semi")
    done = materialized(redaction.redacted(todo, gazetteer), "redacted")
    changes = audit.file_changes(
        done.select("folder", "path", done["text"].alias("before"), done["redacted"].alias("after"))
    )
    clean = done.select("folder", "path", done["redacted"].alias("text"))
    return RedactionResult(clean, changes, audit.folder_report(changes, done))


def publish_delivery(
    manifest: DataFrame,
    identity: DataFrame,
    samples: DataFrame,
    summaries: DataFrame,
    path: str,
    tool_version: str,
) -> DataFrame:
    """Write the index after all checks passed; an earlier index stays on error."""
    writers.require_empty(packaging.index_problems(manifest, samples, summaries), "cannot pack")
    index = packaging.sample_index(manifest, identity, tool_version)
    writers.write_index(index, path)
    return index


@dataclass(frozen=True)
class Delivery:
    """``texts`` (folder, path, text; ``#rank`` marks a line range) are redacted; ``index`` has one row per folder."""

    texts: DataFrame
    report: DataFrame
    manifest: DataFrame
    index: DataFrame
    changes: DataFrame
    identity: DataFrame


def publish(
    delivery: Delivery, base: str, model: str, at: str, costs: DataFrame | None = None, private: DataFrame | None = None
) -> str:
    """Publish deliverable and private rows, identity, index and audit records as one version.

    Rows (folder, path, text) outside the roots that may ship, and those of ``private``, go to the
    private table.  The checks come first, and the pointer is switched once all tables are
    written, so that a failure leaves the delivery before in place.
    """
    marked = packaging.split_deliverables(delivery.texts)
    ships = marked.where("ships").drop("ships")
    samples = ships.where(F.col("path") != packaging.SUMMARY_NAME)
    summaries = ships.where(F.col("path") == packaging.SUMMARY_NAME)
    writers.require_empty(packaging.index_problems(delivery.manifest, samples, summaries), "cannot pack")
    kept = marked.where(~F.col("ships")).drop("ships")
    return writers.publish_tables(
        {
            "deliverable": ships,
            "private": kept if private is None else kept.unionByName(private.select(*kept.columns)),
            "identity": delivery.identity,
            "index": delivery.index,
            "audit": audit.audit_records(delivery.changes, delivery.texts, model, at, costs),
        },
        base,
    )


def deliver(
    files: DataFrame,
    commits: DataFrame | None = None,
    gazetteer: DataFrame | None = None,
    settings: Settings = Settings(),
) -> Delivery:
    """From working trees to redacted samples and their index, for all repositories.

    ``files`` and ``commits`` as ``sample_repositories`` takes them.  Samples
    and summaries are redacted together; the checks of the index come first,
    so nothing is handed on that cannot be packed.  Repositories without
    commits get blank identity columns.
    """
    result = sample_repositories(files, commits, settings=settings)
    manifest = materialized(result.manifest, "manifest")
    part = F.when(F.col("is_partial"), F.concat(F.lit("#"), F.col("rank").cast("string")))
    samples = result.samples.select(
        folder_name(F.col("repo_url")).alias("folder"),
        F.concat(F.lit("samples/"), F.col("path"), F.coalesce(part, F.lit(""))).alias("path"), "text",
    )
    summaries = manifest.select(
        F.col("folder_name").alias("folder"), F.lit(packaging.SUMMARY_NAME).alias("path"),
        F.col("repo_summary").alias("text"),
    )
    done = redact_corpus(samples.unionByName(summaries), gazetteer)
    writers.require_empty(packaging.index_problems(manifest, samples, summaries), "cannot pack")
    known = identity.repository_identity(commits) if commits is not None else None
    if known is None:
        known = files.sparkSession.createDataFrame([], IDENTITY)
    # The index and the published identity both read it: the histories are gone through once.
    known = materialized(known.withColumn("folder", folder_name(F.col("repo_url"))), "identity")
    index = packaging.sample_index(manifest, known, settings.meta.tool_version)
    return Delivery(done.texts, done.report, manifest, index, done.changes, known)
