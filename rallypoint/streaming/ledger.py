"""A ledger of keys that is read where a batch can meet it, and only for the configuration it was made for.

Keys lie in folders by their hash. A batch reads the folders of its own keys, and
of these only the Parquet row groups whose key range it touches.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallypoint.sources.blobs import ordered_digest
from rallypoint.sources.stages import exists
from rallypoint.sources.writers import put_if_absent, read_small

BUCKETS = 256


def config_digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def bind(spark: SparkSession, folder: str, config: dict) -> None:
    """Binds the ledger to a configuration; raises ValueError if it belongs to another one."""
    own = config_digest(config)
    put_if_absent(spark, f"{folder}/bound/config", json.dumps({"digest": own}))
    if read_small(spark, f"{folder}/bound")["config"]["digest"] != own:
        raise ValueError(f"{folder} belongs to another configuration")


def bucket_of(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def reachable(batch: DataFrame, folder: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The ledger's rows in the folders and key ranges that the batch can meet; at most `buckets` rows reach the driver."""
    spark = batch.sparkSession
    if not exists(spark, f"{folder}/keys"):
        return spark.createDataFrame([], batch.select(key).schema)
    own = batch.groupBy(bucket_of(key, buckets).alias("b")).agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low IS NOT NULL").collect()
    places = [f"{folder}/keys/bucket={r.b}" for r in own]
    places = [x for x in places if _there(spark, x)]
    if not places:
        return spark.createDataFrame([], batch.select(key).schema)
    low, high = min(r.low for r in own), max(r.high for r in own)
    kept = spark.read.schema(f"{key} {batch.schema[key].dataType.simpleString()}, content string, bucket int").option("basePath", f"{folder}/keys").parquet(*places)
    return kept.where(F.col(key).between(low, high))


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def add_new(batch: DataFrame, folder: str, key: str, content: str, config: dict, batch_id: int | str, buckets: int = BUCKETS) -> DataFrame:
    """Enters the batch's new keys, once each, with their content's digest; returns those rows as entered.

    A batch that runs again replaces what it entered before, and nothing else.
    """
    spark = batch.sparkSession
    bind(spark, folder, config)
    known = reachable(batch, folder, key, buckets)
    if "bucket" in known.columns:
        known = known.where(~F.input_file_name().contains(f"/from-{batch_id}-"))
    first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.sha2(F.col(content).cast("string"), 256)).alias("content"))
    new = first.join(known.select(F.col(key).alias("known")), F.col(key) == F.col("known"), "left_anti").withColumn("bucket", bucket_of(key, buckets))
    path = f"{folder}/entered/{batch_id}"
    new.write.mode("overwrite").parquet(path)
    rows = spark.read.schema(new.schema).parquet(path)
    _file(rows, folder, batch_id)
    return rows


def _file(rows: DataFrame, folder: str, batch_id: int | str) -> None:
    """Puts a batch's rows into the buckets' folders; the batch's earlier files there go."""
    spark = rows.sparkSession
    staged = f"{folder}/filed/from-{batch_id}"
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(place(f"{staged}/bucket=*/part-*")) or []:
        source = status.getPath()
        target = place(f"{folder}/keys/{source.getParent().getName()}/from-{batch_id}-0.parquet")
        files.mkdirs(target.getParent())
        files.delete(target, False)
        if not files.rename(source, target):
            raise OSError(f"could not file {target}")


def set_fingerprint(spark: SparkSession, folder: str, key: str) -> str:
    """A digest of all keys' own digests and contents, in the order of the former, by blocks."""
    rows = spark.read.parquet(f"{folder}/keys").select(F.sha2(F.col(key).cast("string"), 256).alias("path"), F.lit(0).alias("size"), F.col("content").alias("digest"))
    return ordered_digest(rows)[2]
