"""Incremental ingest: each key once, with a status table that reruns leave alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallypoint.sources.stages import work_dir


def unseen(batch: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """One row of the batch for each key that the ledger doesn't hold."""
    first = batch.dropDuplicates([key])
    return first.join(ledger.select(F.col(key).alias("known")), F.col(key) == F.col("known"), "left_anti")


def ingest_stream(spark: SparkSession, source: DataFrame, key: str, folder: str) -> None:
    """Reads what is there, once: rows of new keys go to folder/ledger, batch by batch.

    A batch that is run again finds its own keys in the ledger and adds nothing,
    so a restart after a lost executor or driver neither drops nor doubles rows.
    """
    ledger, schema = f"{folder}/ledger", source.schema

    def add(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        known = own.read.schema(schema).parquet(ledger)
        unseen(batch, known, key).write.mode("append").parquet(ledger)

    spark.createDataFrame([], schema).write.mode("append").parquet(ledger)
    query = source.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_all(spark: SparkSession, path: str) -> DataFrame:
    """event_type, n: events ingested from a Parquet file, twice over, counted from the ledger."""
    folder = work_dir(spark, "ingest")
    schema = spark.read.parquet(path).schema
    where, _, name = path.rpartition("/")
    for _ in range(2):
        source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(where) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
        ingest_stream(spark, source, "event_id", folder)
    return spark.read.schema(schema).parquet(f"{folder}/ledger").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the table is a folder of files rather than one file."""
    first = spark.read.parquet(path).select("_metadata.file_path").limit(1).collect()
    return not first or not first[0][0].endswith(path.rpartition("/")[2])


def windowed_counts(source: DataFrame, at: str, kind: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts per event-time window and kind; rows later than the watermark are left out."""
    return source.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))
