"""Writing results; a reader sees the old version or the new one, never half."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.urls import folder_name
from corpusmill.sources.deltas import DeltaTable
from corpusmill.sources.materialize import file_system

_POINTER = "CURRENT"


def current_version(spark: SparkSession, base: str) -> str | None:
    """Name of the published version of a table."""
    location, fs = file_system(spark, f"{base}/{_POINTER}")
    if not fs.exists(location):
        return None
    stream = fs.open(location)
    try:
        return str(stream.readUTF())
    finally:
        stream.close()


def read_current(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The published version; an empty table before the first one."""
    version = current_version(spark, base)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/{version}")


def publish_table(df: DataFrame, base: str, version: str | None = None) -> str:
    """Write a new version directory, then switch the pointer by rename.

    The version before stays for its readers; older ones are deleted.
    """
    version = version or f"v-{uuid.uuid4().hex}"
    before = current_version(df.sparkSession, base)
    df.write.mode("overwrite").parquet(f"{base}/{version}")
    _switch(df.sparkSession, base, version, before)
    return version


def publish_tables(tables: dict[str, DataFrame], base: str) -> str:
    """Write several tables as one version and switch the pointer once: readers see all of them or none.

    Where a table fails, the version before stays the published one.
    """
    spark = next(iter(tables.values())).sparkSession
    version, before = f"v-{uuid.uuid4().hex}", current_version(spark, base)
    for name, table in tables.items():
        table.write.parquet(f"{base}/{version}/{name}")
    _switch(spark, base, version, before)
    return version


def published(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of the published version."""
    version = current_version(spark, base)
    if version is None:
        raise ValueError(f"nothing is published at {base}")
    return spark.read.parquet(f"{base}/{version}/{name}")


def _switch(spark: SparkSession, base: str, version: str, before: str | None) -> None:
    temporary, fs = file_system(spark, f"{base}/{_POINTER}.{uuid.uuid4().hex}")
    stream = fs.create(temporary, True)
    stream.writeUTF(version)
    stream.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        temporary.toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, jvm.org.apache.hadoop.fs.Path(f"{base}/{_POINTER}"), option)
    location, fs = file_system(spark, base)
    for entry in fs.listStatus(location):
        name = str(entry.getPath().getName())
        if entry.isDirectory() and name not in (version, before):
            fs.delete(entry.getPath(), True)


def upsert_manifest(fresh: DataFrame, base: str, schema: str) -> int:
    """Replace records of the same URLs by appending the new ones; any number of writers at a time."""
    return DeltaTable(fresh.sparkSession, base, schema).append(fresh)


def read_manifest_table(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The newest record per URL; an empty table before the first write."""
    return DeltaTable(spark, base, schema).read()


def remove_from_manifest(removed: DataFrame, base: str, schema: str) -> bool:
    """Drop records by URL; tells whether there was anything to drop."""
    table = DeltaTable(removed.sparkSession, base, schema)
    gone = table.read().join(removed.select("repo_url").distinct(), "repo_url", "left_semi")
    if gone.isEmpty():
        return False
    table.append(gone, deleted=True)
    return True


def append_errors(errors: DataFrame, path: str) -> None:
    """Append to the error log; times as UTC text."""
    stamp = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    errors.select("repo_url", "stage", "error", stamp.alias("ts")).write.mode("append").json(path)


def write_samples(samples: DataFrame, path: str, buckets: int = 64) -> None:
    """Sample texts with their ``folder_name``; a folder lies in one of ``buckets`` directories.

    The number of directories and files does not grow with the number of
    repositories, and a reader of one folder prunes by its bucket.
    """
    if "folder_name" not in samples.columns:
        samples = samples.withColumn("folder_name", folder_name(F.col("repo_url")))
    dealt = samples.withColumn("bucket", F.pmod(F.xxhash64("folder_name"), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket").sortWithinPartitions("bucket", "folder_name").write.mode("overwrite").partitionBy(
        "bucket"
    ).parquet(path)


def write_identity(identity: DataFrame, path: str) -> None:
    """Identity records as JSON lines, one per repository."""
    identity.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_index(index: DataFrame, path: str) -> None:
    """Index as CSV with header and LF line ends, in parts."""
    index.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def require_empty(problems: DataFrame, what: str) -> None:
    """Stop before publishing when a check found something; shows a few rows."""
    shown = problems.limit(5).collect()
    if shown:
        raise ValueError(f"{what}: " + "; ".join(str(row.asDict()) for row in shown))
