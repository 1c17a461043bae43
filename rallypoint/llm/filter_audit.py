"""How five filters act together, in every order and for every part of a corpus.

Rows are range-sorted by text fingerprint, full text and doc_id; ranges are cut by
a SHA-256 digest in the text's place, as the driver samples what they are cut by,
and tasks sort by the text itself. Each task then
compares rows with their predecessors and measures the texts as they pass, so one
shuffle serves all five filters. A run of equal texts that began in an earlier
partition is mended afterwards: each partition reports the texts of its first and
last run (by fingerprint and SHA-256), and only these few rows meet.

A document's failures are a five-bit mask. Masks are counted by part, and every
figure of every order is a sum of such counts, so orders cost nothing per row.

Defined results for unusual input: a null text is empty; a null part is the empty
string; a null doc_id is larger than all others and smaller than none, so among
equal texts with null ids alone none is a duplicate; repeated rows are counted one
by one, and rows with equal text and the smallest doc_id are no duplicates; very
long texts are compared and measured whole; labels of a doc_id that come twice
hold if any row has them; null labels count as absent; an empty table gives no
rows; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallypoint.llm.common import by_bytes, materialise, tokens

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = b"#$%&*|"

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
#: Bytes that begin a code point.
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False

DUPLICATE = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)


def text_masks(texts: pa.Array) -> np.ndarray:
    """The failures of A to D of each text, as bits; no nulls."""
    out = [np.zeros(0, np.int32)]
    for part in by_bytes(texts):
        n = len(part)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + n + 1]
        raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets - offsets[0]

        def count(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(flags[raw], dtype=np.int64)))[ends])

        words, n_words = tokens(part)
        ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(n, dtype=np.int64), n_words)
        n_distinct = np.bincount(np.unique(doc << 32 | ids) >> 32, minlength=n)
        fails = (n_words < MIN_WORDS, 100 * n_distinct < MIN_DISTINCT_PERCENT * n_words, 100 * count(_UPPER) > MAX_UPPER_PERCENT * count(_POINT), count(_SYMBOL) > 0)
        out.append(sum((x.astype(np.int32) << i for i, x in enumerate(fails)), np.zeros(n, np.int32)))
    return np.concatenate(out)


def _edge(fingerprint: int, text: str) -> str:
    raw = text.encode()
    return f"{fingerprint}:{len(raw)}:{hashlib.sha256(raw).hexdigest()}"


def judge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of rows that come sorted by fingerprint, text and doc_id.

    Yields doc_id, part, mask, partition, head (the row is in the partition's
    first run) and, in one or two rows of no document, edge: the text of the first
    (head) and the last run, with the run's smallest doc_id.
    """
    partition, before, run, edges = TaskContext.get().partitionId(), None, 0, []
    names = ["doc_id", "part", "mask", "partition", "head", "edge"]
    kind = part_kind = None
    for batch in batches:
        if not len(batch):
            continue
        prints, texts, ids, parts = (batch.column(c) for c in ("_print", "text", "doc_id", "part"))
        kind, part_kind = ids.type, parts.type
        n, fresh = len(batch), np.ones(len(batch), bool)
        same = pc.and_(pc.equal(prints[1:], prints[:-1]), pc.equal(texts[1:], texts[:-1]))
        fresh[1:] = ~same.to_numpy(zero_copy_only=False)
        first = pa.array([None], kind)
        if before is not None and before[0] == prints[0].as_py() and before[1] == texts[0].as_py():
            fresh[0], first = False, before[2]
        runs = run + np.cumsum(fresh) - (before is None)
        firsts = pa.concat_arrays([first, ids])
        began = firsts.take(pa.array(np.maximum.accumulate(np.where(fresh, np.arange(1, n + 1), 0))))
        later = pc.or_(pc.fill_null(pc.greater(ids, began), False), pc.and_(pc.is_null(ids), pc.is_valid(began)))
        mask = text_masks(texts) | np.where(later.to_numpy(zero_copy_only=False), DUPLICATE, 0).astype(np.int32)
        if before is None:
            edges.append((_edge(prints[0].as_py(), texts[0].as_py()), ids[:1], True))
        run, before = int(runs[-1]), (prints[n - 1].as_py(), texts[n - 1].as_py(), began[n - 1 :])
        yield pa.RecordBatch.from_arrays([ids, parts, pa.array(mask), pa.array([partition] * n, pa.int32()), pa.array(runs == 0), pa.nulls(n, pa.string())], names=names)
    if before is not None:
        if run:
            edges.append((_edge(*before[:2]), before[2], False))
        n = len(edges)
        yield pa.RecordBatch.from_arrays([
            pa.concat_arrays([x[1] for x in edges]), pa.nulls(n, part_kind), pa.array([0] * n, pa.int32()), pa.array([partition] * n, pa.int32()),
            pa.array([x[2] for x in edges]), pa.array([x[0] for x in edges]),
        ], names=names)


def failure_masks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """doc_id, part and mask (bit i: the document fails filter i of FILTERS) of every row."""
    ids, parts = (docs.schema[c].dataType.simpleString() for c in (doc_id, part))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(part).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    ranges = [F.asc("_print"), F.asc("_digest"), F.asc_nulls_last("doc_id")]
    dealt = read.withColumns({"_print": F.xxhash64("text"), "_digest": F.unhex(F.sha2("text", 256))}).repartitionByRange(*ranges)
    dealt = dealt.sortWithinPartitions(*ranges[:2], F.asc("text"), ranges[2]).select("_print", "text", "doc_id", "part")
    judged = materialise(dealt.mapInArrow(judge_sorted, f"doc_id {ids}, part {parts}, mask int, partition int, head boolean, edge string"), "judged")
    edges = judged.where(F.col("edge").isNotNull())
    smallest = edges.groupBy("edge").agg(F.min("doc_id").alias("smallest"))
    heads = edges.where("head").join(smallest, "edge").select(F.col("partition").alias("_partition"), F.col("smallest").alias("_smallest"))
    rows = judged.where(F.col("edge").isNull()).join(heads, F.col("head") & (F.col("partition") == F.col("_partition")), "left")
    later = F.coalesce(F.col("doc_id") > F.col("_smallest"), F.col("doc_id").isNull() & F.col("_smallest").isNotNull())
    return rows.select("doc_id", "part", F.when(later, F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))


def part_counters(masks: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """part, and arrays by mask of all its documents (n), those of quality 1 (good) and the toxic ones (toxic).

    Equal rows are counted before they meet their labels, so a doc_id with very many rows is a few.
    """
    known = labels.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    counted = masks.groupBy("doc_id", F.coalesce("part", F.lit("")).alias("part"), "mask").agg(F.count(F.lit(1)).alias("n"))
    met = counted.join(known, F.col("doc_id") == F.col("_id"), "left")

    def by_mask(holds: Column) -> Column:
        return F.array(*(F.coalesce(F.sum(F.when(holds & (F.col("mask") == m), F.col("n"))), F.lit(0)) for m in range(MASKS)))

    return met.groupBy("part").agg(by_mask(F.lit(True)).alias("n"), by_mask(F.coalesce("good", F.lit(False))).alias("good"), by_mask(F.coalesce("toxic", F.lit(False))).alias("toxic"))


def _steps() -> Column:
    """Every (set of earlier filters, filter) with the orders and steps that it is found in."""
    found: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(range(len(FILTERS))):
        for k, i in enumerate(order):
            found.setdefault((sum(1 << x for x in order[:k]), 1 << i), []).append(("".join(FILTERS[x] for x in order), k + 1))
    def places(at: list[tuple[str, int]]) -> Column:
        return F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step")) for o, k in at))

    return F.array(*(F.struct(F.lit(s).alias("earlier"), F.lit(f).alias("own"), places(at).alias("places")) for (s, f), at in found.items()))


def _sum(counts: str, holds: str, times: str = "1") -> Column:
    return F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (total, m) -> total + if({holds}, {counts}[m] * ({times}), 0L))")


def audit_orders(counters: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step, from the counters alone."""
    steps = counters.select("*", F.explode(_steps()).alias("s")).select("part", "n", "good", "toxic", "s.*")
    own, removed = "(m & own) != 0", "(m & own) != 0 AND (m & earlier) = 0"
    counted = steps.select(
        "part", F.explode("places").alias("at"),
        _sum("n", "(m & (own | earlier)) = 0").alias("kept"), _sum("n", removed).alias("removed"), _sum("n", f"{own} AND (m & earlier) != 0").alias("redundant"),
        _sum("n", "m = own").alias("unique_fails"), _sum("good", removed).alias("good_lost"), _sum("toxic", removed).alias("toxic_lost"),
        _sum("n", own, "120 div bit_count(m)").alias("shapley"),
    )
    return counted.select("part", "at.filter_order", "at.step", *counted.columns[2:])


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit_orders(part_counters(failure_masks(docs, text, doc_id, part), labels, doc_id))
