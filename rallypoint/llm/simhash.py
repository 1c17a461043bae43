"""SimHash near-duplicates through one-wildcard variants of two segments.

A 64-bit fingerprint is cut into two 32-bit segments. Of at most three
differing bits, one segment gets at most one, so two such fingerprints agree in
some segment with some bit masked. Every distinct fingerprint therefore files 64
variants (which bit is masked, what is left of its segment); equal variants
meet, and the whole fingerprints are verified.

Each fingerprint files one variant under each of 64 masked bits, so no bucket
can hold more than a 64th of all variants. A bucket emits a spanning forest of
its verified links, never all pairs; a bucket of more than `block` fingerprints
is dealt to tasks as pairs of blocks, which loses no link. Chance lets buckets
grow with the table (32 bits, less one, tell them apart), so beyond some ten
billion distinct fingerprints three segments would be due. Rows of a fingerprint
that very many texts share meet its component without a shuffle.

Defined results for unusual input: a null, empty or blank text has fingerprint
zero and links like any other; a null doc_id never names a component unless all
ids of the component are null; a very long text is read whole; repeated rows share a component; an empty table
gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from xxhash import xxh64_intdigest

from rallypoint.llm.common import hot_keys, join_unique, materialise
from rallypoint.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints of a bucket that one task compares at a time.
BLOCK = 4096


def fingerprint_of(text: bytes | None) -> int:
    """Unsigned SimHash of the lower-cased words' 3-word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], ">u8")
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_binary())
    return pa.array(np.array([fingerprint_of(x.as_py()) for x in texts], np.uint64).view(np.int64))


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def spanning_links(values: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links between the values: as few links as join what links."""
    found: list[tuple[int, int]] = []
    left = np.unique(values)
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                new = left[near]
                found += [(int(at), int(x)) for x in new.tolist()]
                reached.extend(new)
                left = left[~near]
    return found


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])))
def bucket_links(buckets: pa.Array) -> pa.Array:
    ends = np.append(buckets.offsets.to_numpy()[: len(buckets)], buckets.offsets[len(buckets)].as_py()) - buckets.offsets[0].as_py()
    values = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    out, sizes = [], [0]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a == 2:
            x, y = int(values[a]), int(values[a + 1])
            out += [(x, y)] if 0 < (x ^ y).bit_count() <= MAX_BITS else []
        else:
            out += spanning_links(values[a:b])
        sizes.append(len(out))
    pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    links = pa.StructArray.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), links)


def near_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: links that join all distinct values of column fp that lie within MAX_BITS bits."""
    half = "CASE WHEN p < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END"
    variants = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select(
        "fp", F.expr(f"shiftleft(CAST(p AS BIGINT), 32) | (({half}) & ~shiftleft(1L, p % 32))").alias("variant")
    )
    shared = variants.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("variant"))).where("n > 1")
    blocks = F.expr(f"CAST(ceil(n / {block}) AS INT)")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        shared.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .groupBy("variant", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    return dealt.select(F.explode(bucket_links("fps")).alias("x")).select("x.u", "x.v").distinct()


def components_by_print(prints: DataFrame, doc_id: str) -> DataFrame:
    """fp, component_id, n for each distinct fp: the least doc_id that links lead to, and the rows that have this fp."""
    least = materialise(prints.groupBy("fp").agg(F.min(doc_id).alias("least_id"), F.count(F.lit(1)).alias("n")), "prints")
    roots = materialise(components(near_links(least.select("fp")), "simhash"), "roots")
    linked = roots.join(least, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least_id").alias("root_id"), F.count(F.lit(1)).alias("members"))
    linked = materialise(linked.withColumnRenamed("root", "r"), "linked")
    hot = hot_keys(linked, "r", "members", roots.count())
    moved = join_unique(roots, linked, ("root", "r"), hot).select(F.col("node"), "root_id")
    return least.join(moved, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root_id", "least_id").alias("component_id"), "n")


def group_near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row of docs."""
    prints = materialise(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    found = materialise(components_by_print(prints, "doc_id").withColumnRenamed("fp", "at"), "components")
    hot = hot_keys(found, "at", "n", prints.count())
    return join_unique(prints, found, ("fp", "at"), hot).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of docs, unchanged, for each component: that of its least doc_id."""
    rows = materialise(
        docs.select(F.struct("*").alias("row"), fingerprint(F.col(text)).alias("fp"), F.monotonically_increasing_id().alias("rid")), "printed"
    )
    prints = rows.select("fp", "rid", F.col(f"row.{doc_id}").alias("doc_id"))
    found = components_by_print(prints, "rid").withColumnRenamed("fp", "at")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid"))
    by_print = prints.groupBy("fp").agg(first.alias("first"))
    by_group = by_print.join(found, F.col("fp") == F.col("at")).groupBy("component_id").agg(F.min("first").alias("first"))
    kept = by_group.select(F.col("first.rid").alias("kept_rid"))
    return rows.join(kept, F.col("rid") == F.col("kept_rid"), "left_semi").select("row.*")
