"""Product codes of vectors by filtering Lloyd rounds.

Vectors become whole numbers and are cut into PARTS parts. Every task gathers its
vectors in chunks and builds, once, a balanced kd-tree over each chunk's parts, with
every node's bounding box and sum; trees lie in the shared folder. A round sends
the entries down each tree level by level: an entry that another one beats in the
whole box is eliminated, and a node with one entry left goes to it as a whole, by its
cached sum and count. Only leaves in which several entries are left look at points.
Tasks report sums and counts of entries alone; the codebooks, a few thousand
numbers, are all that reaches the driver.

All arithmetic is in whole numbers, so results don't depend on how vectors are
dealt to tasks, chunks and trees.

Defined results for unusual input: a null vector, or one with a null or non-finite
component, is dropped, and so is one whose length isn't that of the smallest kept
vec_id; a length that PARTS doesn't divide is filled up with zeros; components
whose whole numbers are too large for exact 64-bit distances stay at that bound
(2**27 for 64 components, that is 32768 before scaling); nulls come last in the order
of vec_ids, and rows with equal vec_id are in the order of their vectors, then
labels; with fewer than ENTRIES vectors there are as many entries; repeated rows are
coded one by one; null labels are one label; an empty table gives an empty
result; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallypoint.llm.common import hot_keys, join_unique, materialise, new_dir, partitions_for

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Points of a leaf, at most about twice as many.
LEAF = 16
#: Components that a chunk holds, about.
CHUNK_VALUES = 1 << 20
CHUNKS_PER_TASK = 1


def whole_numbers(vectors: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """floor(SCALE * x) of each component, by vector, part and position; clipped where squares of distances could leave 64 bits."""
    n, width = vectors.shape
    size = max(1, -(-width // parts))
    bound = 1 << (58 - math.ceil(math.log2(size))) // 2
    out = np.zeros((n, parts * size), np.int64)
    with np.errstate(over="ignore"):
        out[:, :width] = np.clip(np.floor(vectors.astype(np.float64) * SCALE), -bound, bound)
    return out.reshape(n, parts, size)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return np.stack([((points - e) ** 2).sum(-1) for e in entries], -1)


@dataclass
class Tree:
    """A balanced kd-tree: node i of level l holds the points from i * n >> l on; levels follow one another in low, high and sums."""

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Tree:
        n, depth = len(points), max(0, (len(points) // LEAF).bit_length() - 1)
        order, lows, highs, sums = np.arange(n), [], [], []
        for level in range(depth + 1):
            starts = np.arange(1 << level) * n >> level
            held = points[order]
            lows.append(np.minimum.reduceat(held, starts))
            highs.append(np.maximum.reduceat(held, starts))
            sums.append(np.add.reduceat(held, starts))
            if level < depth:
                node = np.repeat(np.arange(1 << level), np.diff(np.append(starts, n)))
                widest = (highs[-1] - lows[-1]).argmax(1)
                order = order[np.lexsort((held[np.arange(n), widest[node]], node))]
        return cls(points[order].astype(np.int32), order.astype(np.int32), np.concatenate(lows).astype(np.int32), np.concatenate(highs).astype(np.int32), np.concatenate(sums))

    def filter(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each entry's sum and count, and each point's entry, in tree order."""
        n, k = len(self.points), len(entries)
        depth = (len(self.low) + 1).bit_length() - 2
        total, count, codes = np.zeros_like(entries), np.zeros(k, np.int64), np.zeros(n, np.int8)
        node, left = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level in range(depth + 1):
            at = (1 << level) - 1 + node
            low, high = self.low[at].astype(np.int64), self.high[at].astype(np.int64)
            left = self._possible(low, high, entries, left)
            begin, end = node * n >> level, (node + 1) * n >> level
            settled = left.sum(1) == 1
            best = left.argmax(1)
            np.add.at(total, best[settled], self.sums[at[settled]])
            np.add.at(count, best[settled], (end - begin)[settled])
            for a, b, e in zip(begin[settled].tolist(), end[settled].tolist(), best[settled].tolist(), strict=True):
                codes[a:b] = e
            node, left, begin, end = node[~settled], left[~settled], begin[~settled], end[~settled]
            if level < depth:
                node, left = np.repeat(2 * node, 2) + np.tile([0, 1], len(node)), np.repeat(left, 2, axis=0)
        if len(node):
            sizes = end - begin
            rows = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            held = self.points[rows].astype(np.int64)
            far = np.where(np.repeat(left, sizes, axis=0), distances(held, entries), np.iinfo(np.int64).max)
            own = far.argmin(1)
            codes[rows] = own
            mine = own[:, None] == np.arange(k)
            total += mine.T.astype(np.int64) @ held
            count += mine.sum(0)
        return total, count, codes

    @staticmethod
    def _possible(low: np.ndarray, high: np.ndarray, entries: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Entries that are nearest to some point of each box, or may be: those the box's best entry doesn't beat in all of it.

        Ties go to the lower index; the difference of two entries' distances is
        least at one corner of the box, where it is computed exactly.
        """
        k = len(entries)
        middle = np.where(left, distances(low + high, 2 * entries), np.iinfo(np.int64).max)
        best = middle.argmin(1)
        near = entries[best]
        out = np.zeros_like(left)
        for z in range(k):
            corner = np.where(entries[z] > near, high, low)
            more = ((entries[z] - corner) ** 2 - (near - corner) ** 2).sum(1)
            out[:, z] = left[:, z] & ((best == z) | (more < 0) | ((more == 0) & (z < best)))
        return out


FIELDS = ("points", "order", "low", "high", "sums")


def write_chunks(batches: Iterator[pa.RecordBatch], folder: str, parts: int, most: int) -> Iterator[pa.RecordBatch]:
    """Builds the trees of this task's vectors (columns vec_id, label, vector), chunk by chunk; yields each chunk's file and size."""
    store, base = FileSystem.from_uri(folder)

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        path = f"{base}/trees-{uuid.uuid4().hex}"
        rows = pa.Table.from_batches(held).combine_chunks()
        flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        points = whole_numbers(flat.reshape(len(rows), -1), parts)
        trees, raw = [Tree.of(points[:, p]) for p in range(parts)], io.BytesIO()
        np.savez(raw, **{f"{name}{p}": getattr(tree, name) for p, tree in enumerate(trees) for name in FIELDS})
        with store.open_output_stream(f"{path}.npz", compression=None) as out:
            out.write(raw.getvalue())
        with store.open_output_stream(f"{path}.arrow", compression=None) as out, pa.ipc.new_stream(out, (kept := rows.drop_columns("vector")).schema) as to:
            to.write_table(kept)
        return pa.RecordBatch.from_pydict({"file": [path], "n": [len(rows)]})

    held, values = [], 0
    for batch in batches:
        width = max(1, len(batch.column("vector").flatten()) // max(1, len(batch)))
        for at in range(0, len(batch), each := max(1, most // width)):
            part = batch.slice(at, each)
            if held and values + len(part) * width > most:
                yield chunk(held)
                held, values = [], 0
            held.append(part)
            values += len(part) * width
    if held:
        yield chunk(held)


def _trees(store: FileSystem, path: str, parts: int) -> Iterator[Tree]:
    with store.open_input_stream(f"{path}.npz", compression=None) as f, np.load(io.BytesIO(f.read())) as held:
        for p in range(parts):
            yield Tree(*(held[f"{name}{p}"] for name in FIELDS))


def sum_entries(batches: Iterator[pa.RecordBatch], folder: str, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """part, entry, n and sums of what this task's chunks assign to each entry of the books (by part, entry and position)."""
    store, _ = FileSystem.from_uri(folder)
    parts, k, _ = books.shape
    sums, counts = np.zeros_like(books), np.zeros((parts, k), np.int64)
    for batch in batches:
        for path in batch.column("file").to_pylist():
            for p, tree in enumerate(_trees(store, path, parts)):
                total, count, _ = tree.filter(books[p])
                sums[p] += total
                counts[p] += count
    part, entry = np.nonzero(counts)
    yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": counts[part, entry], "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})


def code_chunks(batches: Iterator[pa.RecordBatch], folder: str, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """vec_id, label, code and error of every vector."""
    store, _ = FileSystem.from_uri(folder)
    for batch in batches:
        for path in batch.column("file").to_pylist():
            with store.open_input_stream(f"{path}.arrow", compression=None) as f:
                rows = pa.ipc.open_stream(f.read()).read_all().combine_chunks()
            error, codes = np.zeros(len(rows), np.int64), np.zeros((len(rows), len(books)), np.uint8)
            for p, tree in enumerate(_trees(store, path, len(books))):
                _, _, own = tree.filter(books[p])
                codes[tree.order, p] = own
                error[tree.order] += ((tree.points - books[p][own]) ** 2).sum(1)
            whole = codes.tobytes().hex()
            each = 2 * len(books)
            texts = pa.array([whole[i * each : (i + 1) * each] for i in range(len(rows))], pa.string())
            for part in pa.Table.from_arrays([*(c.combine_chunks() for c in rows.columns), texts, pa.array(error)], names=["vec_id", "label", "code", "error"]).to_batches():
                yield part


def kept_vectors(vectors: DataFrame, vector: str, vec_id: str, label: str) -> DataFrame:
    """vec_id, label and vector of the rows whose vectors are whole and finite."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(x.isNotNull() & fine).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), x.alias("vector"))


def first_books(kept: DataFrame, parts: int, entries: int) -> tuple[np.ndarray, int]:
    """The parts of the smallest vec_ids, and the length of vectors."""
    order = [F.asc_nulls_last("vec_id"), F.asc("vector"), F.asc_nulls_first("label")]
    first = kept.orderBy(*order).limit(entries).collect()
    width = len(first[0].vector) if first else 0
    if any(len(r.vector) != width for r in first):
        first = kept.where(F.size("vector") == width).orderBy(*order).limit(entries).collect()
    numbers = whole_numbers(np.array([r.vector for r in first], np.float64).reshape(len(first), width), parts)
    return np.ascontiguousarray(numbers.transpose(1, 0, 2)), width


def compress(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk_values: int = CHUNK_VALUES,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, and label, of every kept vector."""
    spark, kept = vectors.sparkSession, kept_vectors(vectors, vector, vec_id, label)
    ids, labels = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    books, width = first_books(kept, parts, entries)
    folder = new_dir(spark, "vector-trees")
    store, base = FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    written = kept.where(F.size("vector") == width).mapInArrow(lambda batches: write_chunks(batches, folder, parts, chunk_values), "file string, n bigint")
    chunks = materialise(written, "chunks")
    chunks = chunks.repartition(partitions_for(chunks.count(), CHUNKS_PER_TASK))
    for _ in range(rounds):
        found = chunks.mapInArrow(lambda batches, books=books: sum_entries(batches, folder, books), "part int, entry int, n bigint, sums array<bigint>")
        summed = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        books = books.copy()
        for r in summed.collect():
            books[r.part, r.entry, r.at] = r.x // r.n
    coded = materialise(chunks.mapInArrow(lambda batches: code_chunks(batches, folder, books), f"vec_id {ids}, label {labels}, code string, error bigint"), "coded")
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    keyed = coded.withColumn("_label", key)
    by_label = materialise(keyed.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label-errors")
    out = join_unique(keyed, by_label, ("_label", "_of"), hot_keys(by_label, "_of", "_n", coded.count()))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")
