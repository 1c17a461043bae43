"""Where rows came from: legacy records, discovery overlaps, provenance joins, collection accounting, feature tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallypoint.functions import patches
from rallypoint.operators.drafts import SLOTS

RARE_MINIMUM = 20
# The token of a rare category, and the statuses that count as approved.
RARE = "__RARE_KEYSTONE__"
APPROVED = ("approved", "approved_with_warnings", "reapproved")


def match_group(namespace: str, platform: Column, match_id: Column) -> Column:
    """A group name from the digest of platform and match, null if one is missing."""
    return F.concat(F.lit("match_group_"), F.substring(F.sha2(F.concat(F.lit(namespace), F.char(F.lit(0)), platform, F.char(F.lit(0)), match_id), 256), 1, 32))


def objective(objectives: Column, name: str, field: str) -> Column:
    """A field of a named objective; null wherever a level is missing."""
    return objectives.getField(name).getField(field)


def legacy_view(rows: DataFrame) -> DataFrame:
    """Rows (version, created, patch, api_version) with api_patch, public_patch and patch_status.

    Rows that have an api_version stay as they are; for others the build version
    is resolved, and what can't be is `legacy_unresolved`.
    """
    p = patches.resolve(F.col("version"), F.col("created"))
    new = F.col("api_version").isNull()
    api_patch = F.coalesce(F.nullif(F.regexp_extract("version", r"^(\d+\.\d+)", 1), F.lit("")), F.col("patch"))
    status = F.when(p["patch_status"] == "resolved", "resolved").otherwise("legacy_unresolved")
    return rows.withColumns({"api_patch": F.when(new, api_patch), "public_patch": F.when(new, p["public_patch"]), "patch_status": F.when(new, status), "api_version": F.coalesce("api_version", "version")}).drop("version", "patch")


def project(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed fields, in their order; one that rows don't have is an error."""
    return rows.select(*allowed)


def feature_tokens(rows: DataFrame, training: DataFrame, focal: str, other: str, category: str, least: int = RARE_MINIMUM) -> DataFrame:
    """Adds pair (focal>other), token (the category, or RARE below `least` training rows) and focal_token."""
    counts = training.groupBy(F.col(category).alias("of")).agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)
    token = F.when(F.col("support").isNotNull(), F.col(category).cast("string")).otherwise(RARE)
    out = rows.join(counts, F.col(category).eqNullSafe(F.col("of")), "left").withColumns({"pair": F.concat_ws(">", focal, other), "token": token})
    return out.withColumn("focal_token", F.concat_ws(">", focal, "token")).drop("of", "support")


def least_evidence(drafts: DataFrame, training: DataFrame) -> DataFrame:
    """match_id, evidence: the least number of training games among a draft's ten champion and role pairs."""

    def slots(df: DataFrame, *keep: str) -> DataFrame:
        every = F.array(*(F.struct(F.lit(s.split("_")[1]).alias("role"), F.col(s).alias("champion")) for s in SLOTS))
        return df.select(*keep, F.explode(every).alias("s")).select(*keep, "s.role", "s.champion")

    counts = slots(training).groupBy("role", "champion").agg(F.count(F.lit(1)).alias("n"))
    return slots(drafts, "match_id").join(counts, ["role", "champion"], "left").groupBy("match_id").agg(F.min(F.coalesce("n", F.lit(0))).alias("evidence"))


def align(parents: DataFrame, rows: DataFrame, index: str, digest: str) -> DataFrame:
    """Rows beside their parents by index; a row without a parent, or whose digest is not its parent's, raises an error."""
    p = parents.withColumnsRenamed({c: f"parent_{c}" for c in parents.columns})
    same = F.col(f"parent_{digest}").eqNullSafe(F.col(digest)) & F.col(f"parent_{index}").isNotNull()
    checked = F.when(same, F.col(index)).otherwise(F.raise_error(F.concat(F.lit("row does not match its parent: "), F.coalesce(F.col(index).cast("string"), F.lit("none")))))
    return rows.join(p, F.col(index) == F.col(f"parent_{index}"), "left").withColumn(index, checked).drop(f"parent_{index}", f"parent_{digest}")


def provenance(approvals: DataFrame, manifest: DataFrame, catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """match_id, conflict: what keeps an approved match from being used, null if all four tables agree.

    approvals has match_id and status, the others match_id and digest.
    """
    ok = approvals.where(F.col("status").isin(*APPROVED)).select("match_id").distinct()
    one = lambda df, n: df.groupBy("match_id").agg(F.min("digest").alias(n), F.count_distinct("digest").alias(f"{n}_n"))
    rows = ok
    for df, n in ((manifest, "m"), (catalog, "c"), (stored, "s")):
        rows = rows.join(one(df, n), "match_id", "left")
    reason = (
        F.when(F.col("m").isNull(), "not_in_manifest").when(F.col("c").isNull(), "not_in_catalog").when(F.col("s").isNull(), "not_stored")
        .when((F.col("m_n") > 1) | (F.col("c_n") > 1) | (F.col("s_n") > 1), "ambiguous").when((F.col("m") != F.col("c")) | (F.col("m") != F.col("s")), "digests_differ")
    )
    return rows.select("match_id", reason.alias("conflict"))


def merged_sources(found: DataFrame, key: str, source: str, *order: str) -> DataFrame:
    """key, n_sources, sources and first_source: one row per key, however many discovered it, in source order."""
    distinct = found.groupBy(key, source).agg(F.min(F.struct(*order)).alias("at"))
    return distinct.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_sources"), F.array_join(F.array_sort(F.collect_list(F.col(source).cast("string"))), ",").alias("sources"), F.min_by(F.col(source).cast("string"), F.struct("at", source)).alias("first_source")
    )


def seed_contexts(participants: DataFrame, seeds: DataFrame, match: str, player: str) -> DataFrame:
    """Per participant how many of the match's seeds are the participant, and the lineage status."""
    n = seeds.groupBy(match, player).agg(F.count(F.lit(1)).alias("n_seeds"))
    out = participants.join(n, [match, player], "left").withColumn("n_seeds", F.coalesce("n_seeds", F.lit(0)))
    return out.withColumn("seed_status", F.when(F.col("n_seeds") == 0, "collection_context").when(F.col("n_seeds") == 1, "observed").otherwise("ambiguous"))


def accounting(outcomes: DataFrame, known: DataFrame, key: str, accepted: Column) -> DataFrame:
    """outcome, n: each key in one class, credited or not, downloaded now or known before."""
    k = known.select(key, F.lit(True).alias("before")).distinct()
    rows = outcomes.select(key, accepted.alias("accepted")).groupBy(key).agg(F.max("accepted").alias("accepted")).join(k, key, "left")
    old = F.coalesce("before", F.lit(False))
    name = F.when(old & F.col("accepted"), "reused_accepted").when(old, "reused_other").when(F.col("accepted"), "downloaded_accepted").otherwise("downloaded_other")
    return rows.groupBy(name.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def efficiency(rows: DataFrame, **ratios: tuple[Column, Column]) -> DataFrame:
    """Ratios of sums rounded to six digits, null where the denominator is zero."""
    return rows.agg(*(F.round(F.try_divide(F.sum(a), F.sum(b)), 6).alias(n) for n, (a, b) in ratios.items()))


def transitions(rows: DataFrame, target: str) -> DataFrame:
    """patch_side, n, first_at of rows of older, the target's, newer and unknown patches; a newer one seals a run."""
    age = patches.age(F.col("public_patch"), F.lit(target))
    side = F.when(F.col("public_patch").isNull(), "unknown").when(age.isNull(), F.when(patches.major(F.col("public_patch")) > patches.major(F.lit(target)), "newer").otherwise("older")).when(age > 0, "older").when(age < 0, "newer").otherwise("target")
    return rows.groupBy(side.alias("patch_side")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))


def history_state(rows: DataFrame, player: str, at: str, older: Column, stop_after: int, most: int) -> DataFrame:
    """player, offset, consecutive_older, status after walking each player's rows from the newest back.

    A walk ends behind the stop_after-th older row in a row (cutoff), or at `most`
    rows; every key column is followed by at and the row's own order.
    """
    back = W.partitionBy(player).orderBy(F.col(at).desc(), F.col("tie").desc())
    rows = rows.withColumn("nth", F.row_number().over(back)).where(F.col("nth") <= most).withColumn("old", F.coalesce(older, F.lit(False)))
    rows = rows.withColumn("since", F.max(F.when(~F.col("old"), F.col("nth"))).over(back.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("run", F.when(F.col("old"), F.col("nth") - F.coalesce("since", F.lit(0))).otherwise(0))
    per = rows.groupBy(player).agg(F.min(F.when(F.col("run") == stop_after, F.col("nth"))).alias("cut"), F.max("nth").alias("n"), F.max_by("run", "nth").alias("last_run"))
    status = F.when(F.col("cut").isNotNull(), "history_old_patch_cutoff").when(F.col("n") >= most, "history_max_reached").otherwise("history_examined")
    return per.select(player, F.coalesce("cut", "n").alias("offset"), F.when(F.col("cut").isNotNull(), stop_after).otherwise(F.col("last_run")).alias("consecutive_older"), status.alias("status"))


def vocabulary_sides(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """key and where it occurs: both, first or second."""
    both = a.select(*key).distinct().withColumn("w", F.lit(1)).unionByName(b.select(*key).distinct().withColumn("w", F.lit(2)))
    return both.groupBy(*key).agg(F.sum("w").alias("w")).select(*key, F.when(F.col("w") == 3, "both").when(F.col("w") == 1, "first").otherwise("second").alias("side"))


