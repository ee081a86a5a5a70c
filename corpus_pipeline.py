"""Documents to training-order token records, stage by stage.

Each stage works on all rows that the one before it kept, and its result is
written to the shared folder and read again.  Filtering stages return the
rows of ``documents`` that they keep, unchanged; the mix returns one row per
document and pass with the words that it takes; the last stage returns records.
Empty and null texts: the classifier scores them like others, the join and the
decontamination keep them, the mix takes nothing of them.  An empty table gives
an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.common import new_folder, ship_package, table
from corpusmill.llm.decontaminate import decontaminated
from corpusmill.llm.mixing import mixed_documents
from corpusmill.llm.ngram_join import one_of_each
from corpusmill.llm.rule_ensemble import quality_kept
from corpusmill.llm.token_output import written_order


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sparse rule ensemble accepts."""
    ship_package(spark)
    return quality_kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group that similar word n-gram sets connect."""
    ship_package(spark)
    return one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    ship_package(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, one row per document and pass."""
    ship_package(spark)
    return mixed_documents(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride token records in training order, written to shard files and read back."""
    ship_package(spark)
    return written_order(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", mixed),
    ("token-ID output in training order", token_records),
]

#: A fitted classifier decides in the first stage, which SQL cannot repeat; tests hold a run against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        folder = new_folder(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
