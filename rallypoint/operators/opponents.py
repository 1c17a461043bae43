"""Draft observations: reciprocal role opponents, allies and pair eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallypoint.functions import formulas as f
from rallypoint.operators.quality import match_context, with_positions
from rallypoint.sources.lens import Tables

#: Nullable by meaning; groups and joins treat nulls as equal.
CONTEXT = ("queue_id", "platform", "region", "rank_bracket")


def observations(t: Tables) -> DataFrame:
    """One row per participant with its opponent and eligibility.

    All windows start with the match, so one shuffle by match serves them, and one
    sort by match, position and team: every window's order begins it, and a team's
    size is counted in the list of the match's teams. A resolved position has exactly two eligible rows, one a side, so the
    opponent is the group's sum less the row itself: no self-join.
    """
    context = match_context(t).select("match_id", "platform", "queue_id", "public_patch", "game_creation", "duration_seconds", "exclusion_reasons", "participants_complete", "teams_complete")
    rows = with_positions(t.participants).join(context, "match_id")
    rows = rows.sortWithinPartitions("match_id", "position", "team_id")
    teams = F.collect_list(F.struct("team_id")).over(W.partitionBy("match_id"))
    own_team = F.filter("teams", lambda x: x["team_id"].eqNullSafe(F.col("team_id")))
    rows = rows.withColumn("teams", teams).withColumn("team_size", F.size(own_team)).withColumn("match_size", F.size("teams"))
    rows = rows.withColumn("five_a_side", F.col("teams_complete") & (F.col("team_size") == 5) & (F.col("match_size") == 10))
    pairing = F.col("position").isNotNull() & (F.col("position_source") == "team_position") & ~F.col("position_disagreement")
    rows = rows.withColumn("pairing", pairing)
    place, side = W.partitionBy("match_id", "position"), W.partitionBy("match_id", "position", "team_id")
    eligible = F.when(F.col("pairing"), 1).otherwise(0)
    rows = rows.withColumn("own_n", F.sum(eligible).over(side)).withColumn("other_n", F.sum(eligible).over(place) - F.col("own_n"))
    for c in ("participant_id", "champion_id"):
        rows = rows.withColumn(f"pair_{c}", F.sum(F.when(F.col("pairing"), F.col(c))).over(place) - F.col(c))
    status = (
        F.when(~F.col("five_a_side"), "invalid_team_structure")
        .when(~F.col("pairing"), "participant_position_ineligible")
        .when((F.col("other_n") == 1) & (F.col("own_n") == 1), "resolved_unique")
        .when(F.col("other_n") == 1, "nonreciprocal_position_group")
        .when(F.col("other_n") == 0, "missing_unique_opponent")
        .otherwise("ambiguous_opponent_position")
    )
    rows = rows.withColumn("resolution", status)
    resolved = F.col("resolution") == "resolved_unique"
    own = f.reasons(
        (F.col("position_disagreement"), "position_disagreement"),
        (F.col("position_source") == "individual_position_fallback", "position_fallback"),
        (F.col("position").isNull(), "unresolved_position"),
    )
    role = F.array_distinct(F.concat("exclusion_reasons", own))
    return rows.select(
        "match_id", "participant_id", "team_id", "champion_id", "player_key", "win", "public_patch", "game_creation", "queue_id", "platform",
        F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("rank_bracket"),
        "position", "gold", "damage", "kills", "resolution",
        F.when(resolved, F.col("pair_participant_id")).cast("int").alias("opponent_participant_id"),
        F.when(resolved, F.col("pair_champion_id")).cast("int").alias("opponent_champion_id"),
        "exclusion_reasons",
        role.alias("role_reasons"),
        F.array_distinct(F.concat(role, f.reasons((~resolved, "lane_opponent_unresolved")))).alias("matchup_reasons"),
        F.array_distinct(F.concat("exclusion_reasons", f.reasons((F.col("team_size") != 5, "invalid_team_structure")))).alias("synergy_reasons"),
    )


def reciprocal_pairs(observed: DataFrame) -> DataFrame:
    """match_id, low_id, high_id of resolved pairs, and whether both sides name each other."""
    resolved = observed.where("resolution = 'resolved_unique'").select("match_id", F.least("participant_id", "opponent_participant_id").alias("low_id"), F.greatest("participant_id", "opponent_participant_id").alias("high_id"))
    return resolved.groupBy("match_id", "low_id", "high_id").agg((F.count(F.lit(1)) == 2).alias("reciprocal"))


def compositions(observed: DataFrame) -> DataFrame:
    """Allied and enemy champions of each team in participant order."""
    teams = observed.groupBy("match_id", "team_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("participant_id", "champion_id"))), lambda x: x["champion_id"]).alias("allied"))
    sides = W.partitionBy("match_id").orderBy("team_id")
    other = F.coalesce(F.lead("allied").over(sides), F.lag("allied").over(sides))
    return teams.select("match_id", "team_id", F.array_join("allied", ",").alias("allied"), F.array_join(other, ",").alias("enemy"))


def matchups(observed: DataFrame) -> DataFrame:
    """One directional contribution per matchup-eligible row: focal against its role opponent."""
    rows = observed.where((F.size("matchup_reasons") == 0) & F.col("position").isNotNull())
    return rows.select(
        "match_id", "public_patch", "win", *CONTEXT,
        F.col("champion_id").alias("focal"), F.col("position").alias("focal_position"),
        F.col("opponent_champion_id").alias("other"), F.col("position").alias("other_position"),
    )


def synergies(observed: DataFrame, strict_allies: bool = False) -> DataFrame:
    """One directional contribution per eligible row and teammate with a position.

    With strict_allies the teammate must be role-eligible too.
    """
    keep = F.col("position").isNotNull()
    focal = observed.where((F.size("synergy_reasons") == 0) & keep)
    mates = observed.where(keep & (F.size("role_reasons") == 0)) if strict_allies else observed.where(keep)
    mates = mates.select("match_id", "team_id", F.col("participant_id").alias("mate"), F.col("champion_id").alias("other"), F.col("position").alias("other_position"))
    return focal.join(mates, ["match_id", "team_id"]).where(F.col("mate") != F.col("participant_id")).select(
        "match_id", "team_id", "participant_id", "public_patch", "win", *CONTEXT, F.col("champion_id").alias("focal"), F.col("position").alias("focal_position"), "other", "other_position"
    )
