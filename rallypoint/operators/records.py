"""Status tables, deduplication, multisets, allocation and rank attachment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallypoint.functions.identity import hash_order
from rallypoint.operators.series import numbered_by_digest


def keep_one(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("nth = 1").drop("nth")


def latest_status(updates: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The last update of each key: a partial maximum, no list of a key's updates."""
    rest = [c for c in updates.columns if c not in (key, at, *ties)]
    return updates.groupBy(key).agg(F.max(F.struct(at, *ties, *rest)).alias("u")).select(key, "u.*")


def status_counts(current: DataFrame, status: str) -> DataFrame:
    return current.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


#: How a patch was resolved when it still has to be resolved anew.
UNMIGRATED = "legacy_unresolved"


def needs_migration(status: Column, patch_status: Column) -> Column:
    """Whether a processed entry's patch has never been resolved, or by the old rules alone."""
    return F.coalesce(status == "processed", F.lit(False)) & (patch_status.isNull() | (patch_status == UNMIGRATED))


def catalog_statistics(current: DataFrame, status: str, failure: str, patch_status: str) -> DataFrame:
    """kind, name, n: entries in all, by status, rejected ones by failure, and those to migrate; one scan of grouped counts.

    A rejected entry without a failure code counts under a null name.
    """
    cells = current.groupBy(F.col(status).alias("s"), F.col(failure).alias("f"), needs_migration(F.col(status), F.col(patch_status)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    one = lambda kind, name, on: F.when(on, F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name")))
    kinds = F.array(one("total", none, F.lit(True)), one("status", F.col("s"), F.lit(True)), one("failure", F.col("f"), F.coalesce(F.col("s") == "rejected", F.lit(False))), one("needs_migration", none, F.col("m")))
    each = cells.select(F.explode(F.array_compact(kinds)).alias("k"), "n")
    return each.groupBy("k.kind", "k.name").agg(F.sum("n").alias("n"))


def not_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the index of known keys; a null key is never known."""
    return rows.join(known.select(F.col(key).alias("known")).distinct(), F.col(key) == F.col("known"), "left_anti")


def multiset_overlap(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """key, copies: how often each value occurs on both sides."""
    a = left.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    b = right.groupBy(*(F.col(k).alias(f"r_{k}") for k in key)).agg(F.count(F.lit(1)).alias("m"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key))
    return a.join(b, same).select(*key, F.least("n", "m").alias("copies"))


def even_allocation(strata: DataFrame, key: str, target: int) -> DataFrame:
    """key, planned: the target shared out evenly, the remainder to the first strata in order."""
    n, nth = F.count(F.lit(1)).over(W.partitionBy()), F.row_number().over(W.orderBy(key))
    return strata.select(key, (F.floor(F.lit(target) / n) + F.when(nth <= F.lit(target) % n, 1).otherwise(0)).alias("planned"))


def balanced_schedule(candidates: DataFrame, stratum: str, candidate: str, seed: int) -> DataFrame:
    """stratum, candidate, turn: each stratum in hash order; turns interleave the strata."""
    rows = numbered_by_digest(candidates.select(stratum, candidate), [stratum], hash_order(seed, F.col(candidate)), candidate)
    return rows.select(stratum, candidate, F.col("nth").cast("int").alias("turn"))


def attach_rank(participants: DataFrame, observed: DataFrame, player: str, rank: str) -> DataFrame:
    """Adds rank and rank_status: not_collected, observed, or ambiguous (several ranks, none taken)."""
    ranks = observed.groupBy(F.col(player).alias("of")).agg(F.count_distinct(rank).alias("n"), F.min(rank).alias("r"))
    n = F.coalesce("n", F.lit(0))
    joined = participants.join(ranks, F.col(player) == F.col("of"), "left")
    return joined.select(*participants.columns, F.when(n == 1, F.col("r")).alias("rank"), F.when(n == 0, "not_collected").when(n == 1, "observed").otherwise("ambiguous").alias("rank_status"))


def contexts(sources: DataFrame, key: list[str], at: str, *ties: str) -> DataFrame:
    """Discovery contexts: the last write of each key, which is a hash of its parts."""
    digest = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)), 256)
    return latest_status(sources.withColumn("context_key", digest), "context_key", at, *ties)
