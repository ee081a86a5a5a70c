"""One query per operator over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import ship_package, table
from corpusmill.llm.decontaminate import contamination_digest
from corpusmill.llm.dialogue_repair import repair_digest
from corpusmill.llm.license_notices import license_digest, notice_spans
from corpusmill.llm.merkle import manifest_digest
from corpusmill.llm.mixing import plan_mix, taken_words
from corpusmill.llm.ngram_join import similar_documents
from corpusmill.llm.quality_rules import quality_rules
from corpusmill.llm.rule_ensemble import rule_scores
from corpusmill.llm.sharding import shard_by_bytes
from corpusmill.llm.sql import SQL
from corpusmill.llm.suffix_dedup import repeats_digest
from corpusmill.llm.token_output import written_order
from corpusmill.llm.training import held_out
from corpusmill.llm.url_filter import url_verdicts
from corpusmill.llm.warc import archived_pages


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 24)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_order(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages")).drop("url")


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = rule_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled urls: those of pages whose path names a labelled document; low quality is what to block."""
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract("url", r"://[^?#]*/([0-9]{1,18})(?:[./?#]|$)", 1)
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id")).groupBy("doc_id").agg(
        (1 - F.max("quality")).alias("label")
    )
    labelled = (
        pages.select("url", number.alias("_n")).where("_n <> ''")
        .join(labels, F.col("_n").cast("long") == F.col("doc_id")).select("url", "label")
    )
    return url_verdicts(pages, labelled=labelled).drop("url")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(plan_mix(table(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_digest(table(spark, sf_dir, "documents"))


def op12_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(notice_spans(table(spark, sf_dir, "documents"))).drop("spans")


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(table(spark, sf_dir, "conversations"))


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_training_order": op3_training_order,
    "op4_ngram_join": op4_ngram_join,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc": op6_warc,
    "op7_rule_ensemble": op7_rule_ensemble,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_license_notices": op12_license_notices,
    "op13_dialogue_repair": op13_dialogue_repair,
}
QUERIES = {name: _shipped(query) for name, query in QUERIES.items()}
