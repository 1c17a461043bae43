"""Trajectory, history and interval inputs derived from orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallypoint.functions.clock import seconds

#: Days after the first order at which a pair's spending is compared.
ENDPOINTS = (90, 180, 270, 360, 450)
TOLERANCE_DAYS = 30
DAY_SECONDS = 86_400


def spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """custkey, at (seconds), total: each customer's running order total, a frame per order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    running = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select(F.col("o_custkey").alias("custkey"), seconds(orders, "o_orderdate").alias("at"), "o_orderkey", F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).over(running) / 100, 2).alias("total"))


def requests(frames: DataFrame) -> DataFrame:
    """custkey, at, pair, day: both customers of a pair (2i, 2i + 1) at each endpoint after the pair's first order."""
    pair = F.floor(F.col("custkey") / 2)
    own = frames.select("custkey", pair.alias("pair"), "at").groupBy("custkey", "pair").agg(F.min("at").alias("first"))
    first = F.min("first").over(W.partitionBy("pair"))
    days = F.explode(F.array(*map(F.lit, ENDPOINTS)))
    return own.select("custkey", "pair", first.alias("first"), days.alias("day")).select("custkey", (F.col("first") + F.col("day") * DAY_SECONDS).alias("at"), "pair", "day")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, champion, value of every event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", "ts", "user_id", (F.get_json_object("props", "$.k").cast("int") % 4).alias("champion"), "event_type", "value")
