"""Host-level quality rules.

Each text is measured once. Failures of each rule are summed by host (`source`).
A rule's failure rates are shrunk with a beta prior fitted to the hosts
themselves, less what chance alone makes rates of small hosts differ, and a host
with a rule whose shrunk rate is too high takes its documents along.

Defined results for unusual input: a null or blank text has no words and fails;
a null host has no verdict, so only the base rule counts; repeated rows are
measured, counted and returned one by one; a very long text is measured whole;
one host alone, or hosts that differ by no more than chance, get the heaviest
prior; an empty table gives an empty result; other columns, whatever their
names, are never read, and filter_hosts returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallypoint.llm.common import by_bytes, free_name, materialise, tokens

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Further rules that count towards a host's failures.
MAX_SYMBOLS_PER_100_WORDS = 50
MAX_DUP_LINES_PERCENT = 30
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight in documents, where the hosts' rates give none.
PRIOR_WEIGHT = (2.0, 1000.0)

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS_SYMBOL = _flags(SYMBOLS)
#: Bytes that are no code point of a word: white space and UTF-8 continuation.
_NO_CHAR = _flags(b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0)))


def _per_text(hit: np.ndarray, ends: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
    return np.diff(upto[ends])


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words per text that lie in a 3-word window found twice or more in that text."""
    if len(ids) < 3:
        return np.zeros(n_docs, np.int64)
    inside = doc[:-2] == doc[2:]
    at, a, b, c = np.flatnonzero(inside), ids[:-2][inside], ids[1:-1][inside], ids[2:][inside]
    if ids.max(initial=0) < 1 << 21:
        keys = ((a << 42) | (b << 21) | c, doc[:-2][inside])
    else:
        keys = (c, b, a, doc[:-2][inside])
    order = np.lexsort(keys)
    same = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        key = key[order]
        same &= key[1:] == key[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = at[order[twice]]
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[starts + shift] = True
    return np.bincount(doc[covered], minlength=n_docs)


def measure(texts: pa.Array) -> pa.Array:
    """The STATS struct of each text."""
    parts = []
    for part in by_bytes(texts):
        part = pc.fill_null(part, b"")
        n = len(part)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + n + 1]
        raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets - offsets[0]
        words, n_words = tokens(part)
        ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(n), n_words)
        lines, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, text in enumerate(part.to_pylist()):
            filled = [x for x in text.split(b"\n") if x.strip()]
            lines[i], dups[i] = len(filled), len(filled) - len(set(filled))
        columns = (n_words, _per_text(~_NO_CHAR[raw], ends), _per_text(_IS_SYMBOL[raw], ends), lines, dups, repeated_words(ids, doc, n))
        parts.append(pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], names=list(STATS)))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(x, pa.int64()) for x in STATS]))


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in STATS]))
def text_stats(texts: pa.Array) -> pa.Array:
    return measure(texts)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def rules(stats: Column) -> dict[str, Column]:
    """Each rule's failure."""
    return {
        "base": base_failed(stats),
        "symbols": 100 * stats["n_symbols"] > MAX_SYMBOLS_PER_100_WORDS * stats["n_words"],
        "dup_lines": 100 * stats["n_dup_lines"] > MAX_DUP_LINES_PERCENT * stats["n_lines"],
    }


RULES = ("base", "symbols", "dup_lines")


def beta_prior(n: float, k: float, squares: float, n_squares: float, hosts: int, weight: tuple[float, float] = PRIOR_WEIGHT) -> tuple[float, float]:
    """Mean and weight of a rule's prior, by moments of beta-binomial counts.

    n and k sum documents and failures, squares failures squared per document,
    n_squares squared documents. The variance of the rates, each host weighted by
    its documents, less what binomial chance adds, gives the weight.
    """
    low, high = weight
    if not n:
        return 0.0, high
    mean = k / n
    spread, chance = mean * (1 - mean), (hosts - 1) / n
    room = spread * (1 - n_squares / n**2 - chance)
    between = (squares - k**2 / n) / n - spread * chance
    if between <= 0 or room <= 0:
        return mean, high
    return mean, min(high, max(low, room / between - 1))


def host_rates(measured: DataFrame, host: str, stats: str, prior_weight: tuple[float, float] = PRIOR_WEIGHT) -> DataFrame:
    """host, n_docs, failed_<rule>, rate_<rule> and host_rate, the highest: failure rates shrunk to each rule's own beta prior.

    Only a few sums over the hosts reach the driver.
    """
    failed = [F.count_if(x).alias(f"failed_{r}") for r, x in rules(F.col(stats)).items()]
    hosts = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *failed)
    hosts = materialise(hosts, "hosts")
    n = F.col("n_docs").cast("double")
    sums = [F.struct(F.sum(f"failed_{r}").alias("k"), F.sum(F.pow(f"failed_{r}", F.lit(2)) / n).alias("squares")).alias(r) for r in RULES]
    got = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("n"), F.sum(n * n).alias("n_squares"), *sums).first()
    for r in RULES:
        mean, weight = beta_prior(got.n or 0, got[r].k or 0, got[r].squares or 0.0, got.n_squares or 0.0, got.hosts, prior_weight)
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"failed_{r}") + F.lit(mean * weight)) / (n + F.lit(weight)))
    return hosts.withColumn("host_rate", F.greatest(*(f"rate_{r}" for r in RULES)))


def _judged(docs: DataFrame, text: str, host: str, keep: list[str], max_host_rate: float) -> tuple[DataFrame, str]:
    """The columns `keep`, the stats struct, host_rate and host_failed of each row."""
    stats = free_name(docs, "rule_stats")
    measured = materialise(docs.select(*keep, text_stats(F.col(text)).alias(stats)), "measured")
    rates = host_rates(measured, host, stats).select(F.col("host").alias(f"{stats}_host"), F.col("host_rate").alias(f"{stats}_rate"))
    out = measured.join(rates, measured[host] == rates[f"{stats}_host"], "left").drop(f"{stats}_host")
    return out, stats


def score_hosts(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per document: its measures, base_failed, rules_failed (names), host_rate and kept."""
    out, stats = _judged(docs, text, host, list(dict.fromkeys([doc_id, host])), max_host_rate)
    s, rate = F.col(stats), F.col(f"{stats}_rate")
    return out.select(
        doc_id,
        *(s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed(s).alias("base_failed"),
        F.concat_ws(",", *(F.when(x, F.lit(r)) for r, x in rules(s).items())).alias("rules_failed"),
        rate.alias("host_rate"),
        (~base_failed(s) & ~F.coalesce(rate > max_host_rate, F.lit(False))).alias("kept"),
    )


def filter_hosts(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs, unchanged, that pass the base rule and whose host passes."""
    out, stats = _judged(docs, text, host, docs.columns, max_host_rate)
    rate = F.col(f"{stats}_rate")
    return out.where(~base_failed(F.col(stats)) & ~F.coalesce(rate > max_host_rate, F.lit(False))).select(*docs.columns)
