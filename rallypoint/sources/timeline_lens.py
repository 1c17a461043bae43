"""Match timelines derived from the lens's participants: events and frames, deterministic row for row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallypoint.sources.lens import Tables

MINUTES = (5, 10, 15)


def events(t: Tables) -> DataFrame:
    """One event per participant: kills, top and other towers, plates and heralds, by the participant's number."""
    k, own = F.col("event_id"), F.col("participant_id")
    kind = F.element_at(F.array(*map(F.lit, ("CHAMPION_KILL", "BUILDING_KILL", "TURRET_PLATE_DESTROYED", "ELITE_MONSTER_KILL", "BUILDING_KILL", "BUILDING_KILL"))), (k % 6 + 1).cast("int"))
    is_kill, is_tower = kind == "CHAMPION_KILL", kind == "BUILDING_KILL"
    return t.participants.select(
        "match_id",
        F.when(k % 43 != 0, (k * 7919) % 1_800_000).alias("timestamp"),
        kind.alias("type"),
        F.when(is_tower, "TOWER_BUILDING").alias("building_type"),
        F.when(is_tower, F.when(k % 6 == 4, "INNER_TURRET").otherwise("OUTER_TURRET")).alias("tower_type"),
        F.when(k % 6 == 5, "MID_LANE").when(is_tower | (kind == "TURRET_PLATE_DESTROYED"), "TOP_LANE").alias("lane_type"),
        F.when(k % 41 == 0, 300).otherwise(F.col("team_id")).alias("team_id"),
        F.when(kind == "ELITE_MONSTER_KILL", "RIFTHERALD").alias("monster_type"),
        F.when(is_kill, own).alias("killer_id"),
        F.when(is_kill, own % 10 + 1).alias("victim_id"),
        F.when(is_kill & (k % 4 != 0), F.array((k % 10 + 1).cast("int"))).alias("assisting_ids"),
        (k * 37 % 12_000).cast("int").alias("x"),
        (k * 53 % 12_000).cast("int").alias("y"),
    )


def timelines(t: Tables) -> DataFrame:
    """match_id, frames: a frame for each of MINUTES with all participants' values; some parts are missing."""
    nth = F.substring("match_id", 2, 20).cast("bigint")
    values = F.struct(F.col("gold").alias("total_gold"), (F.col("event_id") % 9000).alias("xp"), F.col("lane_cs").alias("minions"), F.col("jungle_cs").alias("jungle_minions"), (F.col("event_id") % 60 % 20).cast("int").alias("level"))
    people = t.participants.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("participant_id", values))).alias("people"))
    frame = lambda m: F.struct((m * 60_000 + nth * m % 90 * 1000).alias("timestamp"), F.when(nth % 23 != 0, F.col("people")).alias("people"))
    frames = F.when(nth % 13 != 0, F.array(*(frame(m) for m in MINUTES)))
    return people.where(nth % 17 != 0).select("match_id", frames.alias("frames"))
