"""Row formulas under one null-safe contract: a result is null, never NaN or infinite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIONS = ("TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY")
#: Other names of positions.
POSITION_ALIASES = {"MID": "MIDDLE", "BOT": "BOTTOM", "SUPPORT": "UTILITY"}
SHORT_GAME_SECONDS = 300


def total_cs(lane: Column, jungle: Column) -> Column:
    return lane + jungle


def duration_minutes(seconds: Column) -> Column:
    return F.when(seconds > 0, seconds / 60)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator)


per_minute = ratio


def kda(kills: Column, deaths: Column, assists: Column) -> Column:
    """`greatest` skips nulls, so null deaths are kept out by hand."""
    return F.when(deaths.isNotNull(), (kills + assists) / F.greatest(F.lit(1), deaths))


def legacy_kda(kills: Column, deaths: Column, assists: Column) -> Column:
    """Missing counts are zero, no deaths count as one, six decimals."""
    k, d, a = (F.coalesce(x, F.lit(0)) for x in (kills, deaths, assists))
    return F.round((k + a) / F.when(d == 0, F.lit(1)).otherwise(d), 6)


def legacy_kill_participation(kills: Column, assists: Column, team_kills: Column) -> Column:
    """Zero, not null, where the team has no kills."""
    taken = F.coalesce(kills, F.lit(0)) + F.coalesce(assists, F.lit(0))
    return F.round(F.when(team_kills > 0, taken / team_kills).otherwise(F.lit(0.0)), 6)


def complete_sum(value: Column) -> Column:
    """An aggregate: null if any value is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def normalize_position(raw: Column) -> Column:
    name = F.upper(F.trim(raw))
    known = reduce(lambda out, x: out.when(name == x[0], F.lit(x[1])), POSITION_ALIASES.items(), F.when(name == "", F.lit(None)))
    return known.otherwise(name)


def position_policy(team: Column, individual: Column) -> Column:
    """struct(position, source, disagreement): the team position, else the individual one."""
    team_ok, own_ok = (F.coalesce(x.isin(*POSITIONS), F.lit(False)) for x in (team, individual))
    return F.struct(
        F.when(team_ok, team).when(own_ok, individual).alias("position"),
        F.when(team_ok, "team_position").when(own_ok, "individual_position_fallback").otherwise("unresolved").alias("source"),
        F.coalesce(team_ok & own_ok & (team != individual), F.lit(False)).alias("disagreement"),
    )


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in pairs))))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def log_loss(p: Column, outcome: Column) -> Column:
    """Null where the outcome had no probability."""
    chosen = F.when(outcome == 1, p).otherwise(1 - p)
    return F.when(chosen > 0, -F.log(chosen))


def evidence_bucket(n: Column) -> Column:
    """Null without a number, as for both grades below."""
    out = F.when(n == 0, "0_unseen").when(n == 1, "1").when(n < 5, "2_4").when(n < 10, "5_9").when(n < 20, "10_19")
    return out.when(n.isNotNull(), "20_plus")


def support_tier(n: Column) -> Column:
    return F.when(n < 5, "0-4").when(n < 20, "5-19").when(n < 50, "20-49").when(n.isNotNull(), "50+")


def evidence_tier(p: Column) -> Column:
    return F.when(p < 0.90, "insufficient").when(p < 0.95, "moderate").when(p.isNotNull(), "strong")


def near_top(x: Column, y: Column) -> Column:
    return ((x <= 6000) & (y >= 8000)) | ((x <= 8000) & (y >= 10000))


def safe_segment(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_")
