"""Cutting lineage with tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local session without it (tests) gets a folder of its own; a cluster
    has to name one that all executors share.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


_made: list[tuple[str, str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder; ``drop_intermediates`` deletes it."""
    path = f"{shared_folder(spark)}/corpusmill-{name}-{uuid.uuid4().hex}"
    _made.append((spark.sparkContext.applicationId, path))
    return path


def drop_intermediates(spark: SparkSession) -> int:
    """Delete the tables that this session wrote on the way; returns how many.

    Results that are not written yet read them, so call it after the last write.
    """
    own = [path for app, path in _made if app == spark.sparkContext.applicationId]
    for path in own:
        location, fs = file_system(spark, path)
        fs.delete(location, True)
    _made[:] = [(app, path) for app, path in _made if path not in own]
    return len(own)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    For a table that several branches of a job need: it is computed once,
    survives the loss of executors, and gives the optimizer real sizes.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``materialized`` wrote and that nothing reads any more (a round that the next one replaces)."""
    spark, known = df.sparkSession, {path.split(":", 1)[-1].lstrip("/"): path for _, path in _made}
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = known.get(folder.split(":", 1)[-1].lstrip("/"))
        if path is not None:
            location, fs = file_system(spark, path)
            fs.delete(location, True)
            _made[:] = [(app, p) for app, p in _made if p != path]


def file_system(spark: SparkSession, path: str):
    """Hadoop path and file system of a location."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
