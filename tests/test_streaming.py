from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.operators.profile import line_masks
from corpusmill.operators.selection import budget_select, checked_requests
from corpusmill.params import BudgetParams
from corpusmill.sources.deltas import DeltaTable
from corpusmill.sources.materialize import materialized
from corpusmill.streaming.intake import list_file_stream, new_repositories
from corpusmill.streaming.live_budget import live_budget
from corpusmill.streaming.manifest_feed import start_manifest_feed, upsert_batch

START = datetime(2024, 1, 1)
VERSIONS = "repo_url string, version bigint, total_loc bigint"


def current(spark, base):
    return sorted(map(tuple, DeltaTable(spark, base, VERSIONS, order=("version",)).read().collect()))


def test_intake_skips_repeats_and_processed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\n# c\ny\nx\n")
    (tmp_path / "in" / "b.txt").write_text("y\nz\n\ndone\n")
    manifest = spark.createDataFrame([("done", 10), ("z", 0)], "repo_url string, total_loc bigint")
    query = (
        new_repositories(list_file_stream(spark, str(tmp_path / "in"), 1), manifest)
        .writeStream.format("memory").queryName("intake")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert sorted(r.repo_url for r in spark.table("intake").collect()) == ["x", "y", "z"]


def test_manifest_feed_is_idempotent(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "manifest")
    for rows in ([("a", 1, 1), ("b", 1, 2), ("a", 2, 5)], [("b", 3, 7), ("c", 1, 1)]):
        spark.createDataFrame(rows, VERSIONS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", 1).parquet(source)
    start_manifest_feed(stream, base, VERSIONS, ["version"], str(tmp_path / "cp")).awaitTermination(120)
    want = [("a", 2, 5), ("b", 3, 7), ("c", 1, 1)]
    assert current(spark, base) == want
    late = spark.createDataFrame([("a", 0, 0)], VERSIONS)
    upsert_batch(base, VERSIONS, ["version"])(late, 7)
    assert current(spark, base) == want


def test_manifest_feed_takes_new_checkpoints_and_other_writers(spark, tmp_path):
    base, apply = str(tmp_path / "manifest"), upsert_batch(str(tmp_path / "manifest"), VERSIONS, ["version"])
    apply(spark.createDataFrame([("a", 1, 1)], VERSIONS), 5)
    DeltaTable(spark, base, VERSIONS, order=("version",)).append(spark.createDataFrame([("b", 1, 2)], VERSIONS))
    apply(spark.createDataFrame([("a", 3, 9)], VERSIONS), 0)
    got = current(spark, base)
    assert got == [("a", 3, 9), ("b", 1, 2)]


def test_live_budget_equals_batch(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rng = random.Random(11)
    files = [(f"r{r}", f"f{i}.py", bytearray(b"x\n" * rng.randrange(0, 12)), 9) for r in range(3) for i in range(20)]
    masks = materialized(line_masks(spark.createDataFrame(files, schemas.FILES)), "masks")
    requests = [
        (f"r{r}", q, f"f{rng.randrange(22)}.py", "api", *((2, 4) if rng.random() < 0.3 else (None, None)))
        for r in range(3) for q in range(60)
    ]
    params = BudgetParams(target_loc=40, cap_loc=50)
    source = str(tmp_path / "in")
    for part in range(3):
        rows = [q for q in requests if q[1] // 20 == part]
        spark.createDataFrame(rows, schemas.REQUESTS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schemas.REQUESTS).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        live_budget(checked_requests(stream, masks), params)
        .writeStream.format("memory").queryName("live").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    columns = ("repo_url", "seq", "reason", "rank", "running_total")
    live = {tuple(r) for r in spark.table("live").select(*columns).collect()}
    batch = budget_select(spark.createDataFrame(requests, schemas.REQUESTS), masks, params=params)
    assert live == {tuple(r) for r in batch.select(*columns).collect()}
    assert len(live) == len(requests)


def ordered_outcome(spark, tmp_path, name, batches, masks, params, idle=None):
    """Outcome of timed requests that come in the given batches; a last request far ahead moves the watermark."""
    kinds, source = schemas.REQUESTS + ", ts timestamp", str(tmp_path / name)
    far = ("zzz", 10**6, "none.py", "api", None, None, START + timedelta(days=90))
    for i, rows in enumerate([*batches, [far]]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{source}/b={i:03d}")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    stream = stream.withWatermark("ts", "2 hours")
    query = (
        live_budget(checked_requests(stream, masks), params, idle)
        .writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_shuffled_batches_give_the_ordered_outcome(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rng = random.Random(5)
    files = [(f"r{r}", f"f{i}.py", bytearray(b"x\n" * rng.randrange(0, 12)), 9) for r in range(3) for i in range(20)]
    masks = materialized(line_masks(spark.createDataFrame(files, schemas.FILES)), "masks")
    requests = [(f"r{r}", q, f"f{rng.randrange(22)}.py", "api", None, None) for r in range(3) for q in range(40)]
    timed = [(*q, START + timedelta(minutes=q[1])) for q in requests]
    rng.shuffle(timed)  # all within the delay of the watermark
    params = BudgetParams(target_loc=40, cap_loc=50)
    got = ordered_outcome(spark, tmp_path, "ordered", [timed[k::3] for k in range(3)], masks, params)
    batch = budget_select(spark.createDataFrame(requests, schemas.REQUESTS), masks, params=params)
    want = sorted(tuple(r) for r in batch.select("repo_url", "seq", "reason", "rank", "running_total").collect())
    assert got == want


def test_idle_repositories_are_forgotten(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    masks = materialized(line_masks(spark.createDataFrame([("r", "f.py", bytearray(b"x\n"), 2)], schemas.FILES)), "masks")
    days = [("r", d, "f.py", "api", None, None, START + timedelta(days=d)) for d in (0, 1, 40)]
    mark = [("z", d, "f.py", "api", None, None, START + timedelta(days=d, hours=12)) for d in (2, 20, 41)]
    batches = [[days[0]], [days[1]], [mark[0]], [mark[1]], [days[2]], [mark[2]]]
    params = BudgetParams(target_loc=40, cap_loc=50)
    got = ordered_outcome(spark, tmp_path, "idle", batches, masks, params, idle="10 days")
    assert [(q, reason) for r, q, reason, *_ in got if r == "r"] == [(0, None), (1, "duplicate"), (40, None)]
