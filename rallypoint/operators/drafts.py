"""Match drafts: one row per complete match, features, baselines, folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallypoint.functions.formulas import POSITIONS
from rallypoint.functions.identity import hash_order
from rallypoint.operators.series import numbered_by_digest

SLOTS = [f"{side}_{role.lower()}" for side in ("blue", "red") for role in POSITIONS]


def exclusions(observed: DataFrame) -> DataFrame:
    """match_id, reason: the first rule that a match's draft fails, null if complete."""
    team = observed.groupBy("match_id", "team_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("role_reasons") > 0).alias("bad"), F.count_distinct("position").alias("roles")
    )
    m = team.groupBy("match_id").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("teams"), F.min("n").alias("least"), F.max("n").alias("most"), F.array_sort(F.collect_list(F.struct("team_id", "bad", "roles"))).alias("t")
    )
    # The teams are looked at in turn: a team's roles count before the next team's eligibility.
    first = F.get(F.filter(F.transform("t", lambda x: F.when(x["bad"] > 0, "role_analysis_ineligible").when(x["roles"] != 5, "roles_not_complete_and_unique")), lambda x: x.isNotNull()), F.lit(0))
    return m.select("match_id", F.when(F.col("rows") != 10, "participant_count_not_ten").when((F.col("teams") != 2) | (F.col("least") != 5) | (F.col("most") != 5), "team_structure_not_five_vs_five").otherwise(first).alias("reason"))


def corpus(observed: DataFrame) -> DataFrame:
    """match_id, platform, public_patch, game_creation, outcome of the lower team (blue), and ten champion slots.

    Complete matches by the rules of exclusions. Rows are summed to teams before
    they are shuffled, and each match's teams meet once.
    """
    keys = ["match_id", "platform", "public_patch", "game_creation"]
    picks = [F.max(F.when(F.col("position") == r, F.col("champion_id"))).alias(r) for r in POSITIONS]
    seen = [F.max(F.when(F.col("position") == r, 1).otherwise(0)) for r in POSITIONS]
    team = observed.groupBy(*keys, "team_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("role_reasons") > 0).alias("bad"), reduce(lambda x, y: x + y, seen).alias("roles"), F.max(F.col("win").cast("int")).alias("won"), *picks)
    held = F.array_sort(F.collect_list(F.struct("team_id", "n", "bad", "roles", "won", *POSITIONS)))
    teams = team.groupBy(*keys).agg(held.alias("t"))
    complete = (F.size("t") == 2) & ~F.exists("t", lambda x: (x["n"] != 5) | (x["bad"] > 0) | (x["roles"] != 5))
    slot = [F.get("t", F.lit(i))[r].alias(f"{side}_{r.lower()}") for i, side in enumerate(("blue", "red")) for r in POSITIONS]
    return teams.where(complete).select(*keys, F.get("t", F.lit(0))["won"].alias("outcome"), *slot)


def swap(drafts: DataFrame) -> DataFrame:
    """The same drafts seen from the other side."""
    other = {s: (s.replace("blue", "red") if s.startswith("blue") else s.replace("red", "blue")) for s in SLOTS}
    return drafts.select(*(F.col(other[c]).alias(c) if c in other else (1 - F.col(c)).alias(c) if c == "outcome" else F.col(c) for c in drafts.columns))


def slots(drafts: DataFrame) -> DataFrame:
    """Long form: match_id, outcome, sign (1 blue, -1 red), role, champion, won (of the slot's side)."""
    one = lambda s: F.struct(F.lit(1 if s.startswith("blue") else -1).alias("sign"), F.lit(s.split("_")[1].upper()).alias("role"), F.col(s).alias("champion"))
    rows = drafts.select("match_id", "platform", "public_patch", "outcome", F.explode(F.array(*map(one, SLOTS))).alias("x")).select("match_id", "platform", "public_patch", "outcome", "x.*")
    return rows.withColumn("won", F.when(F.col("sign") == 1, F.col("outcome")).otherwise(1 - F.col("outcome")))


def features(drafts: DataFrame, matchups: bool = True) -> DataFrame:
    """match_id, kind, role, low, high, value: antisymmetric features, zeros left in."""
    single = slots(drafts).select("match_id", F.lit("composition").alias("kind"), "role", F.col("champion").alias("low"), F.lit(0).alias("high"), F.col("sign").alias("value"))
    if not matchups:
        return single
    pair = lambda r: F.struct(F.lit(r).alias("role"), F.col(f"blue_{r.lower()}").alias("b"), F.col(f"red_{r.lower()}").alias("r"))
    lanes = drafts.select("match_id", F.explode(F.array(*map(pair, POSITIONS))).alias("x")).where("x.b <> x.r")
    return single.union(lanes.select("match_id", F.lit("lane_matchup"), "x.role", F.least("x.b", "x.r"), F.greatest("x.b", "x.r"), F.when(F.col("x.b") < F.col("x.r"), 1).otherwise(-1)))


def vocabulary(training: DataFrame, matchups: bool = True) -> DataFrame:
    """kind, role, low, high, index in key order, from the training drafts alone.

    The number of keys is bounded by roles and champions, not by matches.
    """
    keys = features(training, matchups).select("kind", "role", "low", "high").distinct()
    return keys.withColumn("index", F.row_number().over(W.orderBy("kind", "role", "low", "high")) - 1)


def vectors(drafts: DataFrame, known: DataFrame, matchups: bool = True) -> DataFrame:
    """match_id, index, value: sparse vectors; unseen features and zeros are left out."""
    found = features(drafts, matchups).join(known, ["kind", "role", "low", "high"])
    return found.groupBy("match_id", "index").agg(F.sum("value").cast("int").alias("value")).where("value <> 0")


def slot_rates(training: DataFrame, minimum: int = 1) -> DataFrame:
    """role, champion, wins, games over both sides of the training drafts."""
    found = slots(training).groupBy("role", "champion").agg(F.sum("won").alias("wins"), F.count(F.lit(1)).alias("games"))
    return found.where(F.col("games") >= minimum)


def rate_baseline(drafts: DataFrame, rates: DataFrame, fallback: Column, clip: bool) -> DataFrame:
    """match_id, outcome, probability: fallback plus half the sides' difference in mean slot rate."""
    known = rates.select(F.col("role").alias("r_role"), F.col("champion").alias("r_champion"), (F.col("wins") / F.col("games")).alias("rate"))
    rows = slots(drafts).join(known, (F.col("role") == F.col("r_role")) & (F.col("champion") == F.col("r_champion")), "left")
    rate = F.coalesce("rate", fallback)
    p = fallback + F.sum(rate * F.col("sign")) / 10
    out = rows.groupBy("match_id", "outcome").agg(p.alias("probability"))
    return out.withColumn("probability", F.least(F.greatest("probability", F.lit(0.0)), F.lit(1.0))) if clip else out


def hash_folds(drafts: DataFrame, folds: int, seed: int, scope: str) -> DataFrame:
    """match_id, stratum, fold: strata of platform and outcome dealt out in hash order."""
    digest = F.sha2(F.concat_ws("|", F.lit(scope), F.lit(str(seed)), "platform", "match_id"), 256)
    rows = numbered_by_digest(drafts.select("match_id", "platform", "outcome"), ["platform", "outcome"], digest, "match_id")
    return rows.select("match_id", "platform", "outcome", (F.col("nth") % folds).cast("int").alias("fold"))


def learning_curve(drafts: DataFrame, fractions: tuple[float, ...], seed: int) -> DataFrame:
    """match_id, fraction: the first ceil(f n) matches, two at least, in hash order per platform."""
    rows = numbered_by_digest(drafts.select("match_id", "platform"), ["platform"], hash_order(seed, F.col("match_id")), "match_id")
    rows = rows.select("match_id", "platform", (F.col("nth") + 1).cast("int").alias("nth"), F.col("total").alias("n"))
    wanted = rows.select("*", F.explode(F.array(*map(F.lit, fractions))).alias("fraction"))
    return wanted.where(F.col("nth") <= F.greatest(F.lit(2), F.ceil(F.col("fraction") * F.col("n")))).groupBy("platform", "fraction").agg(F.count(F.lit(1)).alias("matches"), F.max("nth").alias("last"))


def unseen_rates(validation: DataFrame, known: DataFrame, same_is_unseen: bool = True) -> DataFrame:
    """kind, slots, unseen_slots, matches, matches_with_unseen; a lane of equal champions counts as unseen if asked."""
    single = slots(validation).select("match_id", F.lit("composition").alias("kind"), "role", F.col("champion").alias("low"), F.lit(0).alias("high"))
    pair = lambda r: F.struct(F.lit(r).alias("role"), F.least(f"blue_{r.lower()}", f"red_{r.lower()}").alias("low"), F.greatest(f"blue_{r.lower()}", f"red_{r.lower()}").alias("high"))
    lanes = validation.select("match_id", F.lit("lane_matchup").alias("kind"), F.explode(F.array(*map(pair, POSITIONS))).alias("x")).select("match_id", "kind", "x.*")
    rows = single.union(lanes if same_is_unseen else lanes.where("low <> high"))
    seen = rows.join(known.select("kind", "role", "low", "high", F.lit(1).alias("seen")), ["kind", "role", "low", "high"], "left")
    by_match = seen.groupBy("kind", "match_id").agg(F.count(F.lit(1)).alias("slots"), F.count_if(F.col("seen").isNull()).alias("unseen"))
    return by_match.groupBy("kind").agg(F.sum("slots").alias("slots"), F.sum("unseen").alias("unseen_slots"), F.count(F.lit(1)).alias("matches"), F.count_if(F.col("unseen") > 0).alias("matches_with_unseen"))


def time_folds(rows: DataFrame, created: str, starts: list[str], days: int) -> DataFrame:
    """fold, training, validation: rows before each start, and rows in the days from it."""
    cuts = F.explode(F.array(*(F.struct(F.lit(i).alias("fold"), F.to_timestamp(F.lit(s)).alias("start")) for i, s in enumerate(starts)))).alias("c")
    t = rows.select(F.col(created).alias("t"), cuts)
    end = F.col("c.start") + F.expr(f"INTERVAL {days} DAYS")
    return t.groupBy("c.fold").agg(F.count_if(F.col("t") < F.col("c.start")).alias("training"), F.count_if((F.col("t") >= F.col("c.start")) & (F.col("t") < end)).alias("validation"))


def counterfactuals(drafts: DataFrame, slot: str, champions: DataFrame) -> DataFrame:
    """Each draft with one slot replaced by every champion, and a hash of the nine that stay."""
    rest = F.sha2(F.concat_ws("|", *(F.concat_ws("=", F.lit(s), s) for s in SLOTS if s != slot)), 256)
    wanted = champions.select("candidate").distinct().agg(F.array_sort(F.collect_list("candidate")))
    grid = drafts.withColumn("candidates", wanted.scalar()).withColumn("candidate", F.explode("candidates"))
    return grid.select(*(F.col("candidate").alias(c) if c == slot else F.col(c) for c in drafts.columns), rest.alias("unchanged"), F.col(slot).alias("original"))


def symmetric(drafts: DataFrame) -> DataFrame:
    """Two rows of weight one half per draft: both perspectives."""
    return drafts.withColumn("weight", F.lit(0.5)).union(swap(drafts).withColumn("weight", F.lit(0.5)))
