"""Streams with state against the batch jobs, in several batches and after a restart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rallypoint.operators import lineage
from rallypoint.sources import series_lens
from rallypoint.sources.stages import work_dir
from rallypoint.streaming import stateful


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set(*stateful.STATE_STORE)
    yield
    spark.conf.unset(stateful.STATE_STORE[0])


def test_walk_in_pages_equals_the_batch_job(spark, small):
    """Three pages, the newest first, and a restart from the checkpoint before the last."""
    rows = series_lens.history(spark, small).withColumn("tie", F.col("event_id")).select("user_id", "ts", "tie", "value")
    want = {tuple(r) for r in lineage.history_state(rows, "user_id", "ts", F.col("value") < 40, 3, 8).collect()}
    folder = work_dir(spark, "walk")
    edges = rows.selectExpr("percentile(unix_micros(to_timestamp(ts)), array(0.34, 0.67))").first()[0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    pages = [rows.where(at > edges[1]), rows.where((at > edges[0]) & (at <= edges[1])), rows.where(at <= edges[0])]

    def go():
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        return stateful.run_available(stateful.walked(source, "user_id", "ts", "tie", F.col("value") < 40, 3, 8), folder, "walks", "update")

    for page in pages[:2]:
        page.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    go()
    pages[2].coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = go()
    assert out.select("batch").distinct().count() == 3
    got = {tuple(r) for r in stateful.latest(out, "player").collect()}
    assert got == want and len({r[3] for r in got}) > 1


def test_platforms_are_sealed_by_a_timer(spark):
    folder = work_dir(spark, "seal")
    fields = "platform string, at timestamp, id int, patch string"

    def put(*rows):
        spark.createDataFrame(rows, "platform string, at string, id int, patch string").select("platform", F.col("at").cast("timestamp").alias("at"), "id", "patch").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def go():
        source = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        side = F.when(F.col("patch") == "26.13", "target").when(F.col("patch") > "26.13", "newer").otherwise("older")
        return stateful.run_available(stateful.sealed(source, "platform", "at", "id", "patch", side, 3_600_000), folder, "seals", "append")

    put(("a", "2026-01-01 00:00:00", 1, "26.13"), ("a", "2026-01-01 00:10:00", 2, "26.12"), ("b", "2026-01-01 00:10:00", 3, "26.13"))
    put(("a", "2026-01-01 01:00:00", 4, "26.14"), ("a", "2026-01-01 01:20:00", 5, "26.13"))
    assert go().count() == 0
    put(("a", "2026-01-01 01:50:00", 6, "26.14"), ("b", "2026-01-01 03:00:00", 7, "26.13"))
    put(("a", "2026-01-01 03:01:00", 8, "26.13"), ("b", "2026-01-01 03:30:00", 9, "26.15"))
    out = go().drop("batch").collect()
    assert [(r.platform, r.patch, r.accepted, r.older, r.newer) for r in out] == [("a", "26.14", 2, 1, 2)]
