"""Registered queries: each operator run over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import languages
from corpusmill.functions.text import error_lines, short_error
from corpusmill.operators import (
    ancestry,
    audit,
    candidates,
    identity,
    manifest,
    packaging,
    profile,
    quotas,
    redaction,
    repos,
    runlog,
    selection,
    transcripts,
)
from corpusmill.plans import adapters as a
from corpusmill.plans.adapters import BUDGET
from corpusmill.params import ScanParams
from corpusmill.schemas import LOW_VALUE_LAYERS
from corpusmill.sources.materialize import materialized, new_folder
from corpusmill.sources import readers, writers
from corpusmill.sources.deltas import DeltaTable
from corpusmill.sources.readers import read_working_trees
from corpusmill.sources.trees import working_trees, write_working_trees
from corpusmill.streaming.intake import list_file_stream, new_repositories
from corpusmill.streaming.live_budget import OUTPUT as LIVE_OUTCOME
from corpusmill.streaming.live_budget import live_budget
from corpusmill.streaming.manifest_feed import start_manifest_feed

Query = Callable[[SparkSession, str], DataFrame]

TOOL_VERSION = "0.1.0"


def _map_text(name: str) -> Column:
    """Map column as sorted ``key=value`` text."""
    entries = F.array_sort(
        F.transform(
            F.map_entries(name),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        )
    )
    return F.array_join(entries, ";").alias(name)


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = a.files(spark, sf_dir)
    return profile.language_profile(profile.language_counts(files), files.select("repo_url"))


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(profile.line_masks(a.files(spark, sf_dir)), "masks")


def _primaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).select("repo_url", F.col("code_primary").alias("primary"))


def _outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.budget_select(
        a.requests(spark, sf_dir), _masks(spark, sf_dir), _primaries(spark, sf_dir), BUDGET
    )


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = selection.saved_files(_outcome(spark, sf_dir))
    return manifest.sample_rollup(saved, _primaries(spark, sf_dir))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = profile.language_shares(_profile(spark, sf_dir))
    return manifest.manifest_records(manifest.with_summary(_rollup(spark, sf_dir)), shares)


def lang_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).select(
        "repo_url", _map_text("counts"), "total", "primary", "code_primary", "source"
    )


def lang_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distribution_text(_profile(spark, sf_dir))


def lang_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = profile.language_shares(_profile(spark, sf_dir))
    return shares.select("repo_url", F.explode("shares").alias("language", "share"))


def language_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focus language of every repository, given in capitals, with its registered spelling and file marks."""
    given = _profile(spark, sf_dir).select("repo_url", F.upper("code_primary").alias("given"))
    spelled = given.withColumn("language", languages.spelling_of(F.col("given")))
    return spelled.withColumn("marks", F.array_join(languages.marks_of(F.col("language")), " "))


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.file_lines(a.files(spark, sf_dir))


def file_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.file_loc(a.files(spark, sf_dir))


def repo_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repos.repository_list(a.list_lines(spark, sf_dir))


def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repos.repository_names(repos.repository_list(a.list_lines(spark, sf_dir)), ssh_port=10022)


def latest_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repos.latest_branch(a.refs(spark, sf_dir)).withColumn(
        "committer_ts", F.date_format("committer_ts", "yyyy-MM-dd")
    )


def resume_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = manifest.latest_versions(a.manifest_versions(spark, sf_dir), ["version", "event_id"])
    return repos.pending_repositories(a.user_repos(spark, sf_dir), current)


def snapshot_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = a.files(spark, sf_dir)
    return repos.snapshot_diagnostics(files, files.select("repo_url")).withColumn(
        "sample_paths", F.array_join("sample_paths", ",")
    )


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repos.tree_file_counts(a.files(spark, sf_dir))


def working_tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files by the tasks, then listed and read by the tree source."""
    root = new_folder(spark, "trees")
    write_working_trees(a.tree_files(spark, sf_dir), root).write.format("noop").mode("overwrite").save()
    return working_trees(spark, root).select("folder", "path", "size", F.sha2("content", 256).alias("sha256"))


def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per tree, the ones below ``.git`` and the largest size among those a profile looks at."""
    root = new_folder(spark, "trees")
    write_working_trees(a.tree_files(spark, sf_dir), root).write.format("noop").mode("overwrite").save()
    listed = working_trees(spark, root, content=False).withColumnRenamed("folder", "repo_url")
    scanned = read_working_trees(spark, root, ScanParams()).groupBy(F.col("folder").alias("repo_url")).agg(
        F.count("*").alias("scanned"), F.max("size").alias("largest")
    )
    below = listed.where(F.col("path").startswith(".git/")).groupBy("repo_url").agg(F.count("*").alias("git_files"))
    return repos.tree_file_counts(listed).join(below, "repo_url", "left").join(scanned, "repo_url", "left").select(
        "repo_url", "file_count", F.coalesce("git_files", F.lit(0)).alias("git_files"),
        F.coalesce("scanned", F.lit(0)).alias("scanned"), "largest",
    )


def commit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.commit_minhash(a.commit_ids(spark, sf_dir))


def repo_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.repository_identity(a.commits(spark, sf_dir)).drop("commit_minhash")


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with its chunk, before the budget is looked at."""
    checked = selection.checked_requests(a.requests(spark, sf_dir), _masks(spark, sf_dir))
    return checked.select(
        "repo_url", "seq", "norm_path", "first_line", "last_line", "is_partial", "loc",
        F.coalesce("missing", "flaw").alias("flaw"),
    )


def budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcome(spark, sf_dir).select(
        "repo_url", "seq", "path", "saved", "reason", "loc", "is_partial", "rank", "running_total"
    )


def live_budget_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``budget_select`` on a stream whose files hold the requests in no order; a last request moves the watermark on."""
    session = spark.newSession()  # the state store provider is a setting of this stream alone
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    source, out = new_folder(spark, "requests"), new_folder(spark, "live-budget")
    timed = a.requests(session, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("seq") + 86400))
    timed.repartition(4, F.xxhash64("seq")).write.parquet(f"{source}/b=0")
    last = timed.agg(F.max("ts").alias("ts")).select(
        F.lit("").alias("repo_url"), F.lit(-1).cast("bigint").alias("seq"), F.lit("").alias("path"), F.lit("").alias("layer"),
        F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"),
        (F.col("ts") + F.expr("interval 100000 days")).alias("ts"),
    )
    last.write.parquet(f"{source}/b=1")
    stream = session.readStream.schema(timed.schema).option("maxFilesPerTrigger", 2).parquet(f"{source}/*")
    checked = selection.checked_requests(stream.withWatermark("ts", "50000 days"), _masks(session, sf_dir))
    query = (
        live_budget(checked, BUDGET).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", new_folder(spark, "live-checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(LIVE_OUTCOME).parquet(out)


def running_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.running_shares(_outcome(spark, sf_dir), BUDGET)


def sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = selection.saved_files(_outcome(spark, sf_dir))
    stored = new_folder(spark, "files")
    a.files(spark, sf_dir).write.parquet(stored)
    return selection.stored_sample_texts(saved, stored).select(
        "repo_url", "rank", "path", "text"
    )


def sample_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.sample_shares(_rollup(spark, sf_dir))
    listing = F.array_join(
        F.transform(
            "files",
            lambda f: F.concat_ws(
                ":", f["rank"].cast("string"), f["path"], f["layer"], f["loc_taken"].cast("string")
            ),
        ),
        ";",
    )
    return rows.select(
        "repo_url", "total_loc", "file_count", "test_share", "logic_share", "low_value_share",
        "primary_share", _map_text("sample_lang_loc"), listing.alias("files"),
    )


def main_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir).select("repo_url", "main_language", "primary")


def layer_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir).select(
        "repo_url", manifest.layer_breakdown(F.col("files")).alias("breakdown")
    )


def repo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.with_summary(_rollup(spark, sf_dir)).select("repo_url", "repo_summary")


def manifest_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.flat_manifest(_manifest(spark, sf_dir)).select(
        "repo_url", "repo_name", "language", "total_loc", "file_count", "test_share",
        F.get_json_object("files_json", "$[0].path").alias("first_path"),
        F.get_json_object("meta_json", "$.lang_stats_source").alias("stats_source"),
        F.get_json_object("meta_json", "$.commit_sha").alias("commit_sha"),
    )


def manifest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.latest_versions(a.manifest_versions(spark, sf_dir), ["version", "event_id"])


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of even events are the current manifest, those of odd events the fresh one."""
    versions = a.manifest_versions(spark, sf_dir)

    def part(odd: int) -> DataFrame:
        return manifest.latest_versions(versions.where(F.col("event_id") % 2 == odd), ["version", "event_id"])

    return manifest.upserted(part(0), part(1))


def manifest_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = manifest.latest_versions(a.manifest_versions(spark, sf_dir), ["version", "event_id"])
    return manifest.without_repositories(current, current.where(F.col("total_loc") == 0)).select(
        "repo_url", "total_loc"
    )


def manifest_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions as a stream of files, appended batch by batch to the manifest table, compacted and read."""
    source, base = new_folder(spark, "versions"), new_folder(spark, "manifest-table")
    versions = a.manifest_versions(spark, sf_dir)
    versions.repartition(6, "event_id").write.parquet(source)
    schema, order = ", ".join(f"{name} {kind}" for name, kind in versions.dtypes), ["version", "event_id"]
    stream = spark.readStream.schema(versions.schema).option("maxFilesPerTrigger", 2).parquet(source)
    start_manifest_feed(stream, base, schema, order, new_folder(spark, "feed-checkpoint")).awaitTermination()
    table = DeltaTable(spark, base, schema, order=tuple(order))
    table.compact()
    return table.read()


def manifest_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit stamp of every record; half of the repositories have a known head."""
    records = manifest.with_summary(_rollup(spark, sf_dir))
    heads = records.where(F.length("repo_url") % 2 == 0).select("repo_url", F.sha2("repo_url", 256).alias("head_commit_sha"))
    shares = profile.language_shares(_profile(spark, sf_dir))
    return manifest.manifest_records(records, shares, heads).select("repo_url", "meta.commit_sha")


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines on disk, some cut short, no objects or blank: records, broken lines, strict problems."""
    event, record = F.col("event_id") % 50, F.to_json(F.struct("repo_url", "total_loc"))
    line = F.when(event == 0, F.regexp_replace(record, "}$", "")).when(event == 1, "[1]").when(event == 2, "  ").otherwise(record)
    path = new_folder(spark, "lines")
    a.manifest_versions(spark, sf_dir).select(line.alias("value")).write.text(path)
    good, broken = readers.read_records(spark, path, "repo_url string, total_loc bigint")
    strict = readers.manifest_line_problems(spark, path).agg(F.count("*").alias("total_loc"))
    none = F.lit(None).cast("string")
    return (
        good.select(F.lit("record").alias("kind"), "repo_url", "total_loc", none.alias("line"))
        .unionByName(broken.select(F.lit("broken").alias("kind"), none.alias("repo_url"), F.lit(None).cast("bigint").alias("total_loc"), "line"))
        .unionByName(strict.select(F.lit("strict").alias("kind"), none.alias("repo_url"), "total_loc", none.alias("line")))
    )


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors appended to the log in two runs and read back."""
    path, rows = new_folder(spark, "errors"), a.errors(spark, sf_dir)
    for odd in (0, 1):
        writers.append_errors(rows.where(F.col("event_id") % 2 == odd), path)
    return spark.read.schema("repo_url string, stage string, error string, ts string").json(path)


def intake_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List files as a stream: repositories that are new and not processed yet."""
    folder, out = new_folder(spark, "lists"), new_folder(spark, "intake")
    a.list_lines(spark, sf_dir).select("value").repartition(4, "value").write.text(folder)
    done = a.table(spark, sf_dir, "pages").where("page_id % 3 = 0").select(
        F.col("url").alias("repo_url"), (F.col("page_id") % 2).alias("total_loc")
    )
    query = (
        new_repositories(list_file_stream(spark, folder, 2), done)
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, "intake-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema("repo_url string").parquet(out)


def result_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.validate_results(a.results(spark, sf_dir)).select("repo_url", "stage", "error")


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.redacted(a.texts(spark, sf_dir), a.gazetteer(spark, sf_dir)).select(
        "folder", "path", "redacted"
    )


def redaction_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second redaction of the redacted texts would still change: nothing."""
    names = a.gazetteer(spark, sf_dir)
    once = redaction.redacted(a.texts(spark, sf_dir), names).drop("text").withColumnRenamed("redacted", "text")
    twice = redaction.redacted(once, names)
    return twice.groupBy("folder").agg(
        F.count("*").alias("files"), F.count_if(F.col("text") != F.col("redacted")).alias("changed_again")
    )


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = redaction.redacted(a.texts(spark, sf_dir), a.gazetteer(spark, sf_dir)).select(
        "folder", "path", F.col("text").alias("before"), F.col("redacted").alias("after")
    )
    return audit.file_changes(pairs)


def audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.folder_report(_changes(spark, sf_dir), a.texts(spark, sf_dir))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited text (lines changed, added and removed) against the plain text of the same document."""
    return audit.line_changes(audit.paired_texts(a.texts(spark, sf_dir), a.edited_texts(spark, sf_dir)))


def audit_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``audit_lines``, per file."""
    return audit.file_changes(audit.paired_texts(a.texts(spark, sf_dir), a.edited_texts(spark, sf_dir)))


def sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest manifest versions joined with the identity of some of their folders."""
    from corpusmill.functions.urls import folder_name

    records = manifest.latest_versions(
        a.manifest_versions(spark, sf_dir), ["version", "event_id"]
    ).select(
        folder_name(F.col("repo_url")).alias("folder_name"), "total_loc", "file_count",
        F.struct("sampled_at").alias("meta"),
    )
    ids = identity.repository_identity(a.commits(spark, sf_dir)).withColumn(
        "folder",
        F.concat(F.lit("git.example.com__u__"), F.regexp_extract("repo_url", r"(repo[0-9]+)", 1)),
    )
    return packaging.sample_index(records, ids, TOOL_VERSION).drop("commit_minhash")


def index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written as CSV and read back; an empty field reads as null."""
    path = new_folder(spark, "index-file")
    writers.write_index(sample_index(spark, sf_dir), path)
    return spark.read.option("header", True).csv(path)


def index_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest folders of all versions against sample and summary folders."""
    versions = a.manifest_versions(spark, sf_dir).select(
        F.concat(F.col("language"), F.lit("-"), F.col("total_loc").cast("string")).alias("folder_name")
    )
    have = a.table(spark, sf_dir, "events").select(
        F.concat(F.col("event_type"), F.lit("-"), (F.col("event_id") % 60).cast("string")).alias("folder")
    )
    return packaging.index_problems(versions, have, have).distinct()


def bundle_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    artefacts = a.texts(spark, sf_dir).select(
        "folder",
        F.when(F.col("path").startswith("src/"), F.concat(F.lit("samples/"), F.col("path")))
        .when(F.col("path").startswith("tests/"), "repo_summary.md")
        .otherwise(F.col("path")).alias("path"),
        F.length("text").cast("bigint").alias("size"),
    )
    return packaging.bundle_entries(artefacts)


def transcript_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.compacted(a.messages(spark, sf_dir)).select("run_id", "pos", "role", "content")


def transcript_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.rendered(a.messages(spark, sf_dir), "- bash: run a command\n  parameters: {}")


def turn_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = F.array_join(
        F.transform("tool_calls", lambda c: F.concat_ws("|", c["id"], c["name"], c["arguments"])), ";"
    )
    return transcripts.validated_turns(a.turns(spark, sf_dir)).select(
        "turn_id", "reason", "content", calls.alias("tool_calls"), "finish_reason"
    )


def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.error_classes(a.errors(spark, sf_dir))


def usage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.redaction_runs(spark, sf_dir).select(
        "folder",
        transcripts.reported_cost(F.col("answer")).alias("cost"),
        transcripts.token_usage(F.col("answer"))["tokens_in"].alias("tokens_in"),
    )


def redaction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = a.redaction_runs(spark, sf_dir)
    return runlog.redaction_totals(
        runs.withColumn("cost", transcripts.reported_cost(F.col("answer")))
    )


def progress_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.progress_flags(a.run_turns(spark, sf_dir), a.run_goals(spark, sf_dir), a.RUN_BUDGET)


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.run_statistics(a.run_events(spark, sf_dir))


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.run_totals(a.results(spark, sf_dir), a.errors(spark, sf_dir))


def layer_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.tagged_layers(candidates.file_features(a.files(spark, sf_dir))).select(
        "repo_url", "path", "loc", "flow_marks", "is_generated", "has_secret", "layer"
    )


def own_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers by a function that the caller supplies."""
    def by_place(path: Column, language: Column, loc: Column, flow_marks: Column, generated: Column) -> Column:
        return F.when(path.startswith("src/"), "business").when(flow_marks > loc, "algorithm").when(generated, "autogen").otherwise(
            F.when(language == "Go", "api").otherwise("data")
        )

    return candidates.tagged_layers(candidates.file_features(a.files(spark, sf_dir)), by_place).select("repo_url", "path", "layer")


def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = materialized(candidates.file_features(a.files(spark, sf_dir)), "features")
    return candidates.candidate_requests(
        candidates.tagged_layers(features), _primaries(spark, sf_dir), BUDGET, a.CANDIDATES
    )


def steered_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files chosen by quotas of lines per language and kind."""
    features = materialized(candidates.file_features(a.files(spark, sf_dir)), "features")
    rows = candidates.numbered_candidates(
        candidates.tagged_layers(features), _primaries(spark, sf_dir), BUDGET, a.CANDIDATES
    )
    return quotas.steered_requests(materialized(rows, "candidates"), BUDGET, a.CANDIDATES)


def steered_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to manifest with steered shares of lines."""
    from corpusmill.params import Settings
    from corpusmill.plans.sampling import sample_repositories

    settings = Settings(budget=BUDGET, candidates=replace(a.CANDIDATES, steer_shares=True))
    records = sample_repositories(a.files(spark, sf_dir), settings=settings).manifest

    def lines(*layers: str) -> Column:
        chosen = F.filter("files", lambda f: f["layer"].isin(*layers))
        return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda total, f: total + f["loc_taken"])

    return records.select(
        "repo_url", "language", "total_loc", "file_count", lines("test").alias("test_loc"),
        lines(*LOW_VALUE_LAYERS).alias("low_value_loc"), F.array_join("files.path", ";").alias("paths"),
    )


def sampled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to manifest without supplied requests."""
    from corpusmill.params import Settings
    from corpusmill.plans.sampling import sample_repositories

    settings = Settings(budget=BUDGET, candidates=a.CANDIDATES)
    records = sample_repositories(a.files(spark, sf_dir), settings=settings).manifest
    return records.select(
        "repo_url", "folder_name", "language", "total_loc", "file_count",
        F.array_join("files.path", ";").alias("paths"),
    )


def delivered_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to redacted samples that passed the checks of the index."""
    from corpusmill.params import Settings
    from corpusmill.plans.delivery import deliver

    settings = Settings(budget=BUDGET, candidates=a.CANDIDATES)
    done = deliver(a.files(spark, sf_dir), a.commits(spark, sf_dir), a.gazetteer(spark, sf_dir), settings)
    return done.texts.where(F.col("path").startswith("samples/")).select(
        "folder", F.regexp_replace("path", "#[0-9]+$", "").alias("path"), "text"
    )


def published_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of a delivery that was published as one version, read from its deliverable table."""
    from corpusmill.params import Settings
    from corpusmill.plans.delivery import deliver, publish

    settings = Settings(budget=BUDGET, candidates=a.CANDIDATES)
    done = deliver(a.files(spark, sf_dir), a.commits(spark, sf_dir), a.gazetteer(spark, sf_dir), settings)
    base = new_folder(spark, "delivery")
    publish(done, base, "rules", "1970-01-01T00:00:00Z")
    return writers.published(spark, base, "deliverable").where(F.col("path").startswith("samples/")).select(
        "folder", F.regexp_replace("path", "#[0-9]+$", "").alias("path"), "text"
    )


def audit_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit record of every folder with its changed files."""
    changes = materialized(_changes(spark, sf_dir), "changes")
    records = audit.audit_records(changes, a.texts(spark, sf_dir), "rules", "1970-01-01T00:00:00Z", per_part=1_000_000)
    listing = F.transform(
        "changes", lambda c: F.concat_ws(":", c["path"], *[c[n].cast("string") for n in ("hunks", "additions", "deletions")])
    )
    return records.withColumn("changes", F.array_join(listing, ";"))


def history_of_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which commits are reachable from the head, from parent links alone."""
    return ancestry.ancestors_of_heads(
        a.commit_graph(spark, sf_dir), a.graph_heads(spark, sf_dir)
    ).select("repo_url", "sha", "on_head")


def redaction_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders to redact: one per document, labels stand for the two report places."""
    def folders(rows: DataFrame) -> DataFrame:
        return rows.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("folder"))

    labels = a.table(spark, sf_dir, "labels")
    return audit.pending_folders(
        folders(a.table(spark, sf_dir, "documents")),
        folders(labels.where("quality = 1")),
        folders(labels.where("toxic = 1")),
        skip=("d7",),
    )


def deliverable_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    artefacts = a.texts(spark, sf_dir).select(
        "folder", F.regexp_replace("path", "^src/", "samples/").alias("path")
    )
    return packaging.split_deliverables(artefacts)


def sample_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.display_rows(_manifest(spark, sf_dir))


def identity_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of customers without a commit history under the same number."""
    records = a.user_repos(spark, sf_dir).select(
        F.substring_index("repo_url", "/", -1).alias("folder_name")
    )
    known = a.commit_ids(spark, sf_dir).select(
        F.regexp_extract("repo_url", r"(repo[0-9]+)\.git$", 1).alias("folder")
    )
    return packaging.missing_identity(records, known)


def error_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error lines and the short one-line form of every page source."""
    pages = a.table(spark, sf_dir, "pages")
    stderr = F.concat(F.regexp_replace("html", "<(p|li)>", "\nERROR: "), F.lit("\nend"))
    return pages.select(
        "page_id",
        error_lines(F.when(F.col("page_id") % 2 == 0, stderr).otherwise(F.col("html"))).alias("errors"),
        short_error(F.col("html"), 200).alias("short"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        repo_list, repo_urls, latest_branch, resume_repos, snapshot_diag, tree_files, working_tree_files, tree_listing,
        lang_profile, lang_distribution, lang_shares, language_marks, file_lines, file_loc,
        commit_minhash, repo_identity,
        line_ranges, budget_select, live_budget_stream, running_share, sample_texts,
        sample_manifest, main_language, layer_breakdown, repo_summary, manifest_flat,
        manifest_latest, manifest_upsert, manifest_remove, manifest_feed, manifest_heads, manifest_lines,
        error_log, intake_stream, index_file, own_layers, result_validation,
        redacted_documents, redaction_twice, audit_files, audit_report, audit_lines, audit_hunks,
        sample_index, index_problems, bundle_listing,
        transcript_compact, transcript_render, turn_validate, error_classes,
        usage_costs, redaction_totals, progress_flags, run_statistics, run_totals,
        layer_tags, candidate_order, steered_order, steered_corpus, sampled_corpus, delivered_corpus, published_delivery, audit_record,
        history_of_heads, redaction_resume, deliverable_split, sample_display, identity_gaps, error_previews,
    )
}
