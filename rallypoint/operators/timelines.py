"""Timelines: top-lane pairs, frame values, ordered exclusions, tower outcomes, kill participation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallypoint.functions.formulas import near_top

TEAMS = (100, 200)
PLATE_CUTOFF_MS = 14 * 60_000
HERALD_WINDOW_MS = 120_000
PRIMARY_MINUTES = (5, 10, 15)
LATENESS_MS = 60_000
FELL_MINUTES = (10, 15, 20, 25)


def top_pairs(participants: DataFrame) -> DataFrame:
    """match_id, blue_top, red_top: matches with exactly one top player on each of the two teams and none elsewhere.

    A top player's own position, where there is one, must be TOP too.
    """
    tops = participants.where((F.col("team_position") == "TOP") & (F.col("individual_position").isNull() | (F.col("individual_position") == "TOP")))
    side = lambda team: F.max(F.when(F.col("team_id") == team, F.col("participant_id")))
    found = tops.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), side(TEAMS[0]).alias("blue_top"), side(TEAMS[1]).alias("red_top"))
    return found.where("n = 2 AND blue_top IS NOT NULL AND red_top IS NOT NULL").drop("n")


def frame_values(raw: Column) -> Column:
    """gold, xp, lane_cs, jungle_cs, level and farm of a participant's frame; null unless all are non-negative and the level is 1 to 18."""
    names = {"gold": "total_gold", "xp": "xp", "lane_cs": "minions", "jungle_cs": "jungle_minions", "level": "level"}
    good = raw["level"].between(1, 18)
    for c in names.values():
        good = good & (raw[c] >= 0)
    return F.when(good, F.struct(*(raw[c].alias(n) for n, c in names.items()), (raw["minions"] + raw["jungle_minions"]).alias("farm")))


def frame_at(frames: Column, minute: int, lateness_ms: int = LATENESS_MS) -> Column:
    """The earliest frame at or after the minute, at most lateness_ms behind it."""
    begin = minute * 60_000
    return F.array_min(F.transform(F.filter(frames, lambda f: f["timestamp"].between(begin, begin + lateness_ms)), lambda f: F.struct(f["timestamp"].alias("timestamp"), F.map_entries(f["people"]).alias("people"))))


def timeline_exclusions(matches: DataFrame, participants: DataFrame, timelines: DataFrame, patch: str, queue: int = 420, least_seconds: int = 300) -> DataFrame:
    """match_id, reason: the first rule that a match's timeline fails, null if it may be used."""
    rows = matches.join(top_pairs(participants), "match_id", "left").join(timelines.withColumn("downloaded", F.lit(True)), "match_id", "left")
    frames = [frame_at(F.col("frames"), m) for m in PRIMARY_MINUTES]
    rows = rows.select("*", *(f.alias(f"frame_{m}") for f, m in zip(frames, PRIMARY_MINUTES, strict=True)))
    missing, by_minute = F.lit(False), []
    for m in PRIMARY_MINUTES:
        frame = F.col(f"frame_{m}")
        missing = missing | frame.isNull()
        people = F.map_from_entries(frame["people"])
        bad = F.lit(False)
        for top in ("blue_top", "red_top"):
            bad = bad | frame_values(F.try_element_at(people, F.col(top))).isNull()
        by_minute.append(F.when(frame["people"].isNull(), "participant_frames_missing").when(bad, "primary_target_invalid"))
    reason = (
        F.when(F.col("downloaded").isNull(), "timeline_not_downloaded")
        .when(~F.coalesce(F.col("public_patch") == patch, F.lit(False)), "wrong_patch")
        .when(~F.coalesce(F.col("queue_id") == queue, F.lit(False)), "wrong_queue")
        .when(~F.coalesce(F.col("duration_seconds") >= least_seconds, F.lit(False)), "remake_or_short_game")
        .when(F.col("blue_top").isNull(), "top_participant_identification")
        .when(F.col("frames").isNull(), "timeline_frames_missing")
        .when(missing, "primary_frame_missing")
        .otherwise(F.coalesce(*by_minute))
    )
    return rows.select("match_id", reason.alias("reason"))


def tower_outcomes(events: DataFrame, matches: DataFrame) -> DataFrame:
    """match_id, focal_team and, for both teams of every match, who lost the first outer top tower and when, and the plates.

    Events without a valid time or team don't count; a plate without them makes
    the match's plate difference null.
    """
    in_top, valid = F.col("lane_type") == "TOP_LANE", F.col("team_id").isin(*TEAMS) & (F.col("timestamp") >= 0)
    tower = in_top & (F.col("type") == "BUILDING_KILL") & (F.col("building_type") == "TOWER_BUILDING") & (F.col("tower_type") == "OUTER_TURRET") & valid
    plate = in_top & (F.col("type") == "TURRET_PLATE_DESTROYED")
    counted = plate & valid & (F.col("timestamp") <= PLATE_CUTOFF_MS)
    per = events.groupBy("match_id").agg(
        F.min(F.when(tower, F.struct("timestamp", "team_id"))).alias("first"),
        F.count_if(plate & ~F.coalesce(valid, F.lit(False))).alias("bad_plates"),
        *(F.count_if(counted & (F.col("team_id") == team)).alias(f"lost_{team}") for team in TEAMS),
    )
    rows = matches.select("match_id").join(per, "match_id", "left").withColumn("focal_team", F.explode(F.array(*map(F.lit, TEAMS))))
    at, own = F.col("first.timestamp"), F.col("first.team_id") == F.col("focal_team")
    lost = F.when(F.col("focal_team") == TEAMS[0], F.col(f"lost_{TEAMS[1]}") - F.col(f"lost_{TEAMS[0]}")).otherwise(F.col(f"lost_{TEAMS[0]}") - F.col(f"lost_{TEAMS[1]}"))
    supported = F.coalesce(F.col("bad_plates") == 0, F.lit(True))
    return rows.select(
        "match_id",
        "focal_team",
        F.when(at.isNull() | (at > 900_000), "neither_by_15").when(own, "allied_top_outer_first").otherwise("enemy_top_outer_first").alias("label_at_15"),
        F.when(own, "allied").when(at.isNotNull(), "enemy").alias("first_relation"),
        at.alias("first_timestamp"),
        *(F.coalesce(at <= m * 60_000, F.lit(False)).alias(f"fell_before_{m}") for m in FELL_MINUTES),
        F.when(supported, F.coalesce(lost, F.lit(0))).alias("plate_difference"),
        supported.alias("plates_supported"),
    )


def interventions(events: DataFrame, participants: DataFrame, cutoff_ms: int) -> DataFrame:
    """match_id of every top pair, and whether others took part in kills of a top player up to the cutoff.

    A kill counts if killer, victim and assistants meet the two top players;
    the others among them speak by their position. herald_tower tells a herald
    followed within two minutes by a top tower of the other team; any_recorded that any of the four holds.
    """
    tops = top_pairs(participants).withColumn("tops", F.array("blue_top", "red_top"))
    roles = participants.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("participant_id", F.coalesce("team_position", F.lit("")).alias("role")))).alias("roles"))
    rows = events.where(F.col("timestamp").between(0, cutoff_ms)).join(tops.join(roles, "match_id"), "match_id")
    involved = F.filter(F.array_distinct(F.concat(F.array("killer_id", "victim_id"), F.coalesce("assisting_ids", F.array().cast("array<int>")))), lambda x: x.isNotNull())
    others = F.transform(F.array_except(involved, F.col("tops")), lambda p: F.try_element_at("roles", p))
    kill = (F.col("type") == "CHAMPION_KILL") & F.arrays_overlap(involved, F.col("tops"))
    flags = rows.select(
        "match_id", "type", "timestamp", "team_id",
        (kill & F.exists(others, lambda r: F.coalesce(r == "JUNGLE", F.lit(False)))).alias("jungle"),
        (kill & F.exists(others, lambda r: F.coalesce(~r.isin("", "TOP", "JUNGLE"), F.lit(False)))).alias("other"),
        (kill & F.coalesce(near_top(F.col("x"), F.col("y")), F.lit(False))).alias("near"),
        ((F.col("type") == "ELITE_MONSTER_KILL") & (F.col("monster_type") == "RIFTHERALD")).alias("herald"),
        ((F.col("type") == "BUILDING_KILL") & (F.col("building_type") == "TOWER_BUILDING") & (F.col("lane_type") == "TOP_LANE")).alias("tower"),
    )
    times = lambda c: F.collect_list(F.when(F.col(c) & F.col("team_id").isin(*TEAMS), F.struct("timestamp", "team_id")))
    per = flags.groupBy("match_id").agg(F.max("jungle").alias("j"), F.max("other").alias("o"), F.max("near").alias("n"), times("herald").alias("heralds"), times("tower").alias("towers"))
    follows = F.exists("heralds", lambda h: F.exists("towers", lambda t: (h["team_id"] != t["team_id"]) & (t["timestamp"] - h["timestamp"]).between(0, HERALD_WINDOW_MS)))
    out = tops.select("match_id").join(per, "match_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return out.select("match_id", no(F.col("j")).alias("jungle_with_top"), no(F.col("o")).alias("other_with_top"), no(F.col("n")).alias("kill_near_top"), no(follows).alias("herald_tower"), (no(F.col("j")) | no(F.col("o")) | no(F.col("n")) | no(follows)).alias("any_recorded"))
