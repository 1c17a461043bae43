"""Match eligibility, team totals, participant features and their reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallypoint.functions import formulas as f
from rallypoint.sources.lens import Tables

TOTALS = ("kills", "deaths", "assists", "gold", "damage", "cs")


def with_positions(participants: DataFrame) -> DataFrame:
    """Adds position, position_source, position_disagreement and cs."""
    policy = f.position_policy(F.col("team_position"), F.col("individual_position"))
    return participants.withColumn("policy", policy).select(
        "*",
        F.col("policy.position").alias("position"),
        F.col("policy.source").alias("position_source"),
        F.col("policy.disagreement").alias("position_disagreement"),
        f.total_cs(F.col("lane_cs"), F.col("jungle_cs")).alias("cs"),
    ).drop("policy")


def match_context(t: Tables) -> DataFrame:
    """One row per match: completeness, position counts, ordered exclusion reasons."""
    people = with_positions(t.participants)
    counts = people.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("participant_count"),
        F.count_distinct("participant_id").alias("distinct_participants"),
        F.count_if("position_disagreement").alias("disagreements"),
        F.count_if(F.col("position_source") == "individual_position_fallback").alias("fallbacks"),
        F.count_if(F.col("position").isNull()).alias("unresolved"),
    )
    sides = t.teams.groupBy("match_id").agg(F.count(F.lit(1)).alias("team_count"), F.count_distinct("team_id").alias("distinct_teams"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("participant_count", "distinct_participants", "disagreements", "fallbacks", "unresolved", "team_count", "distinct_teams")]
    m = t.matches.join(counts, "match_id", "left").join(sides, "match_id", "left").select(*t.matches.columns, *zero)
    m = m.withColumn("participants_complete", (F.col("participant_count") == 10) & (F.col("distinct_participants") == 10))
    m = m.withColumn("teams_complete", (F.col("team_count") == 2) & (F.col("distinct_teams") == 2))
    d = F.col("duration_seconds")
    basic = ((d <= 0, "invalid_duration"), ((d > 0) & (d < f.SHORT_GAME_SECONDS), "short_game"), (~F.col("participants_complete"), "incomplete_participants"), (~F.col("teams_complete"), "incomplete_teams"))
    role = ((F.col("disagreements") > 0, "position_disagreement"), (F.col("fallbacks") > 0, "position_fallback"), (F.col("unresolved") > 0, "unresolved_position"))
    return m.select("*", f.reasons(*basic).alias("exclusion_reasons"), f.reasons(*basic, *role).alias("role_exclusion_reasons")).drop("distinct_participants", "distinct_teams")


def team_totals(t: Tables) -> DataFrame:
    """Complete sums per team; null unless the team has five members and no value is missing."""
    people = with_positions(t.participants)
    five = F.count(F.lit(1)) == 5
    return people.groupBy("match_id", "team_id").agg(F.count(F.lit(1)).alias("members"), *(F.when(five, f.complete_sum(F.col(c))).alias(f"team_{c}") for c in TOTALS))


def participant_features(t: Tables) -> DataFrame:
    """Rates and shares per participant; the team's sums come from one window by match."""
    people = with_positions(t.participants).join(t.matches, "match_id")
    team = W.partitionBy("match_id", "team_id")
    size = F.count(F.lit(1)).over(team)
    for c in ("kills", "gold", "damage"):
        whole = (F.count(c).over(team) == size) & (size == 5)
        people = people.withColumn(f"team_{c}", F.when(whole, F.sum(c).over(team)))
    minutes = f.duration_minutes(F.col("duration_seconds"))
    return people.select(
        "match_id", "participant_id", "team_id", "champion_id", "position", "position_source", "position_disagreement", "cs",
        f.kda(F.col("kills"), F.col("deaths"), F.col("assists")).alias("kda"),
        f.legacy_kda(F.col("kills"), F.col("deaths"), F.col("assists")).alias("legacy_kda"),
        f.legacy_kill_participation(F.col("kills"), F.col("assists"), F.col("team_kills")).alias("legacy_kill_participation"),
        f.ratio(F.col("kills") + F.col("assists"), F.col("team_kills")).alias("kill_participation"),
        f.per_minute(F.col("cs"), minutes).alias("cs_per_minute"),
        f.per_minute(F.col("gold"), minutes).alias("gold_per_minute"),
        f.ratio(F.col("gold"), F.col("team_gold")).alias("gold_share"),
        f.ratio(F.col("damage"), F.col("team_damage")).alias("damage_share"),
    )


def reconciliation(t: Tables) -> DataFrame:
    """check, failures: invariants that must hold between the tables."""
    features = participant_features(t)
    shares = features.groupBy("match_id", "team_id").agg(F.count(F.lit(1)).alias("n"), F.count("gold_share").alias("filled"), F.sum("gold_share").alias("total"))
    torn = ((F.col("filled") > 0) & (F.col("filled") < F.col("n"))) | (F.abs(F.col("total") - 1) > 1e-9)
    keys = t.participants.agg((F.count(F.lit(1)) - F.count_distinct("match_id", "participant_id")).alias("failures"))
    winners = t.teams.groupBy("match_id").agg(F.count_if("win").alias("wins"))
    orphans = t.participants.join(t.matches, "match_id", "left_anti")
    count = lambda df, name, c=None: df.agg((F.count(F.lit(1)) if c is None else F.count_if(F.coalesce(c, F.lit(False)))).alias("failures")).select(F.lit(name).alias("check"), "failures")
    return (
        count(shares, "share_sum", torn)
        .union(keys.select(F.lit("duplicate_participant").alias("check"), "failures"))
        .union(count(winners, "one_winner", F.col("wins") != 1))
        .union(count(orphans, "participant_without_match"))
        .union(count(t.teams.join(t.participants, ["match_id", "team_id"], "left_anti"), "team_without_members"))
    )


def missingness(df: DataFrame, *fields: str) -> DataFrame:
    """field, n_rows, n_null, null_rate per field, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in fields))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n_null")) for c in fields)))
    return one.select(F.col("n").alias("n_rows"), pairs.alias("x")).select("x.field", "n_rows", "x.n_null", F.when(F.col("n_rows") > 0, F.round(F.col("x.n_null") / F.col("n_rows"), 6)).alias("null_rate"))
