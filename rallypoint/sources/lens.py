"""Match tables derived from the `events` table, row for row and deterministic.

Each event is one participant: its kind is the role, its place in time within
the kind is the seat. Two consecutive seats of all five roles make a match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallypoint.functions.formulas import POSITIONS
from rallypoint.functions.identity import pseudonym
from rallypoint.sources.stages import stage, still_there

#: Event kinds in the order of the positions they stand for.
KINDS = ("signup", "view", "click", "purchase", "error")
NAMESPACE = "lens"


@dataclass
class Tables:
    """matches, participants and teams; keys match_id, (match_id, participant_id), (match_id, team_id).

    staged holds stage tables that were made of these.
    """

    matches: DataFrame
    participants: DataFrame
    teams: DataFrame
    staged: dict[str, DataFrame] = field(default_factory=dict)

    def once(self, label: str, make: Callable[[], DataFrame]) -> DataFrame:
        if label not in self.staged or not still_there(self.staged[label]):
            self.staged[label] = stage(make(), label)
        return self.staged[label]


def places(events: DataFrame) -> DataFrame:
    """Adds place: an event's number among those of its kind in time.

    Ranks within a kind's hour, plus how many of its events lie before that hour,
    so that no task sees all events of a kind; only counts by hour meet in one window.
    """
    rows = events.withColumn("hour", F.date_trunc("hour", "ts"))
    counts = rows.groupBy("event_type", "hour").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("event_type").orderBy("hour")) - F.col("n")
    offsets = counts.select(F.col("event_type").alias("of"), F.col("hour").alias("at"), before.alias("before"))
    within = F.row_number().over(W.partitionBy("event_type", "hour").orderBy("ts", "event_id")) - 1
    rows = rows.withColumn("within", within).join(offsets, (F.col("event_type") == F.col("of")) & F.col("hour").eqNullSafe(F.col("at")))
    return rows.withColumn("place", (F.col("within") + F.col("before")).cast("int")).drop("hour", "of", "at", "within", "before")


def seats(events: DataFrame) -> DataFrame:
    """One row per event with its match, team and derived counts."""
    role = F.element_at(F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i + 1)))), F.col("event_type"))
    e = places(events).select("event_id", "ts", "user_id", role.alias("role_no"), "place", F.get_json_object("props", "$.k").cast("int").alias("k"), F.round(F.col("value") * 100).cast("bigint").alias("gold"))
    side = F.col("place") % 2
    name = lambda n: F.element_at(F.array(*map(F.lit, POSITIONS)), n)
    own = name(F.col("role_no").cast("int"))
    other = name((F.col("role_no") % 5 + 1).cast("int"))
    unset = F.col("event_id") % 101 == 0
    return e.select(
        F.concat(F.lit("M"), F.floor(F.col("place") / 2).cast("string")).alias("match_id"),
        F.floor(F.col("place") / 2).cast("bigint").alias("match_no"),
        (100 + 100 * side).cast("int").alias("team_id"),
        (F.col("role_no") + 5 * side).cast("int").alias("participant_id"),
        (F.col("k") % 40 + 1).cast("int").alias("champion_id"),
        pseudonym(F.col("user_id"), NAMESPACE).alias("player_key"),
        F.when(~(unset | (F.col("event_id") % 97 == 0)), own).alias("team_position"),
        F.when(~unset, F.when(F.col("event_id") % 50 == 0, other).otherwise(own)).alias("individual_position"),
        (F.col("event_id") % 15).cast("int").alias("kills"),
        (F.col("event_id") % 7).cast("int").alias("deaths"),
        (F.col("event_id") % 21).cast("int").alias("assists"),
        "gold",
        (F.col("gold") * 3 + F.col("event_id") % 1000).alias("damage"),
        F.when(F.col("event_id") % 89 != 0, F.col("event_id") % 200).cast("int").alias("lane_cs"),
        (F.col("event_id") % 60).cast("int").alias("jungle_cs"),
        "ts",
        "event_id",
    )


def listing(spark: SparkSession, df: DataFrame) -> str:
    """A digest of the files that df reads: their paths, sizes and times, from the file system; no row is read."""
    jvm, lines = spark._jvm, []
    for path in sorted(df.inputFiles()):
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
        status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
        lines.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


#: Staged tables by application and by the input's files as they were.
_STAGED: dict[tuple, Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The match tables of a folder's events, derived once a session and input, and read back from stage tables."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = (spark.sparkContext.applicationId, listing(spark, events))
    if key not in _STAGED or not all(still_there(df) for df in (_STAGED[key].matches, _STAGED[key].participants, _STAGED[key].teams)):
        made = derived(events)
        _STAGED[key] = Tables(*(stage(df, f"lens-{name}") for name, df in (("matches", made.matches), ("participants", made.participants), ("teams", made.teams))))
    return _STAGED[key]


def derived(events: DataFrame) -> Tables:
    placed = stage(seats(events), "lens-seats")
    day = F.dayofmonth("game_creation")
    matches = placed.groupBy("match_id", "match_no").agg(F.min("ts").alias("game_creation")).select(
        "match_id",
        "game_creation",
        F.when(F.col("match_no") % 2 == 0, "eun1").otherwise("euw1").alias("platform"),
        F.lit(420).alias("queue_id"),
        (240 + (F.col("match_no") * 37) % 1800).cast("int").alias("duration_seconds"),
        F.concat(F.lit("26."), F.least(F.lit(15), 10 + F.floor((day - 1) / 5)).cast("string")).alias("public_patch"),
    )
    gold = placed.groupBy("match_id", "team_id").agg(F.sum("gold").alias("gold"))
    best = F.max(F.struct("gold", -F.col("team_id"))).over(W.partitionBy("match_id"))
    won = F.struct("gold", -F.col("team_id")) == best
    teams = gold.select("match_id", "team_id", won.alias("win"))
    participants = placed.join(teams, ["match_id", "team_id"]).drop("match_no", "ts")
    return Tables(matches, participants, teams)
