"""Helpers that the text operators share: input, shared tables, Arrow slicing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles; longer single texts go alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Lets local Python workers import this package wherever they start."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach.

    Where it is unset, a local session gets a temporary folder; a cluster
    session raises ValueError, as no machine-local folder would do there.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    Cuts lineage: a lost executor costs no recomputation, and the planner sees
    the real size, so it broadcasts only tables under its own threshold.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it holds more than this share of the rows, so fewer than HOT_KEYS keys are.
HOT_KEYS = 1024


def hot_keys(counts: DataFrame, key: str, n: str, rows: int) -> list:
    """The keys that hold more than 1/HOT_KEYS of the rows; counts has one row per key."""
    return [r[0] for r in counts.where(F.col(n) * HOT_KEYS > rows).select(key).collect()]


def join_unique(many: DataFrame, one: DataFrame, on: tuple[str, str], hot: list) -> DataFrame:
    """Inner join of many rows with a table that holds each key once; hot keys skip the shuffle.

    The hot rows of `one`, of which there are fewer than HOT_KEYS, are broadcast.
    """
    a, b = on
    if not hot:
        return many.join(one, F.col(a) == F.col(b))
    rest = many.where(~F.col(a).isin(hot)).join(one.where(~F.col(b).isin(hot)), F.col(a) == F.col(b))
    return rest.union(many.where(F.col(a).isin(hot)).join(F.broadcast(one.where(F.col(b).isin(hot))), F.col(a) == F.col(b)))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't hold yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def by_bytes(array: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Slices of a string array of about `most` bytes each, one text at least."""
    array = array.cast(pa.large_binary())
    sizes = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(array):
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right"))
        end = max(end, at + 1)
        yield array.slice(at, end - at)
        at = end


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of binary texts (null: none), flat, and words per text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, b"").cast(pa.large_string()))
    flat = lists.flatten()
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    upto = np.concatenate(([0], np.cumsum(filled)))
    return (flat if filled.all() else flat.filter(pa.array(filled))), np.diff(upto[ends])


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def release_memory() -> None:
    """Gives back what earlier tasks of this Python worker freed; workers live on from stage to stage."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
