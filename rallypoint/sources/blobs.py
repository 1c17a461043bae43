"""Content-addressed blobs, digests of whole trees in path order, duplicates between scopes."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallypoint.sources.records import blob_path, inventory, verified
from rallypoint.sources.stages import stage

#: Files whose lines one digest covers.
BLOCK_FILES = 4096


def _put(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, base = FileSystem.from_uri(folder)
    for batch in batches:
        new = []
        for digest, place, content in zip(*(batch.column(c).to_pylist() for c in ("digest", "place", "content")), strict=True):
            raw, path = content.encode(), f"{base}/{place}"
            there = store.get_file_info(path).type == FileType.File
            if there:
                with store.open_input_stream(path) as f:
                    if hashlib.sha256(f.read()).hexdigest() != digest:
                        raise ValueError(f"content differs from its name: {path}")
            else:
                own = f"{base}/.put/{uuid.uuid4().hex}"
                store.create_dir(os.path.dirname(path), recursive=True)
                with store.open_output_stream(own) as f:
                    f.write(raw)
                store.move(own, path)
            new.append(not there)
        yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("place"), pa.array([len(x.encode()) for x in batch.column("content").to_pylist()], pa.int64()), pa.array(new)], names=["digest", "place", "size", "added"])


def store_blobs(rows: DataFrame, content: str, folder: str) -> DataFrame:
    """Writes each distinct content to the folder, by tasks; digest, place, size and whether it was added.

    A blob that is there is verified, not written again; one is written aside and
    moved into place whole, so a task that runs again finds or repeats the same
    bytes. Raises an error if a blob there has other content. Null contents are left out.
    """
    store, base = FileSystem.from_uri(folder)
    store.create_dir(f"{base}/.put", recursive=True)
    digest = F.sha2(F.col(content), 256)
    each = rows.where(F.col(content).isNotNull()).select(digest.alias("digest"), F.col(content).alias("content")).dropDuplicates(["digest"])
    placed = each.select("digest", blob_path(F.col("digest")).alias("place"), "content")
    return stage(placed.mapInArrow(lambda batches: _put(batches, folder), "digest string, place string, size bigint, added boolean"), "blobs")


def read_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, digest, content of every blob; one whose content isn't its name's raises an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    read = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("digest"), F.col("content").cast("string").alias("content"))
    return verified(read)


@F.arrow_udf(T.BooleanType())
def _is_link(paths: pa.Array) -> pa.Array:
    def link(path: str) -> bool:
        where = urlsplit(path)
        local = unquote(where.path)
        return where.scheme in ("", "file") and os.path.realpath(local) != os.path.abspath(local)

    return pa.array([link(x) for x in paths.to_pylist()], pa.bool_())


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), size, digest of every regular file; a symbolic link on the way to one raises an error."""
    where = urlsplit(root)
    real = f"file://{os.path.realpath(where.path)}" if where.scheme in ("", "file") else root.rstrip("/")
    files = inventory(spark, real)
    checked = F.when(_is_link("path"), F.raise_error(F.concat(F.lit("a symbolic link leads to "), F.col("path")))).otherwise(F.col("path"))
    begin = len(urlsplit(real).path.rstrip("/")) + 1
    below = F.substring(F.regexp_replace(checked, "^[a-z0-9]+:(//[^/]*)?", ""), begin + 1, 1 << 30)
    return files.select(below.alias("path"), "size", "digest")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """Adds nth (from 0) in the order of a column: ranks within ranges, and how many rows lie in the ranges before."""
    parts = stage(rows.repartitionByRange(F.col(by)).withColumn("range_no", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("range_no")) - F.col("n")
    offsets = counts.select(F.col("range_no").alias("of"), before.alias("before"))
    within = F.row_number().over(Window.partitionBy("range_no").orderBy(by)) - 1
    return parts.withColumn("within", within).join(offsets, F.col("range_no") == F.col("of")).withColumn("nth", F.col("within") + F.col("before")).drop("range_no", "of", "within", "before")


def ordered_digest(files: DataFrame, block: int = BLOCK_FILES) -> tuple[int, int, str]:
    """Number of files, bytes, and a digest of all files in path order.

    A file's line is path, NUL, size, NUL, digest, line end. Lines are digested by
    blocks of so many files; one block's digest is the tree's, and those of several,
    a line each, are digested again. No task sees more than a block's lines.
    """
    line = F.concat(F.col("path"), F.lit("\0"), F.col("size").cast("string"), F.lit("\0"), F.col("digest"), F.lit("\n"))
    each = numbered(files, "path").select(F.floor(F.col("nth") / block).alias("block"), "nth", "size", line.alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "")
    parts = each.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sha2(lines, 256).alias("d")).orderBy("block").collect()
    if not parts:
        return 0, 0, hashlib.sha256(b"").hexdigest()
    whole = parts[0].d if len(parts) == 1 else hashlib.sha256("".join(f"{r.d}\n" for r in parts).encode()).hexdigest()
    return sum(r.n for r in parts), sum(r.size for r in parts), whole


def duplicates(first: DataFrame, second: DataFrame, component: Column) -> DataFrame:
    """component, duplicate_files, duplicate_bytes: files of equal digest and size in both scopes, each counted as often as both hold it."""
    count = lambda df, name: df.groupBy(component.alias("component"), "digest", "size").agg(F.count(F.lit(1)).alias(name))
    both = count(first, "a").join(count(second, "b"), ["component", "digest", "size"])
    copies = F.least("a", "b")
    return both.groupBy("component").agg(F.sum(copies).alias("duplicate_files"), F.sum(copies * F.col("size")).alias("duplicate_bytes"))
