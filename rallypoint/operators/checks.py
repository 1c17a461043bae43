"""Reconciliation across teams and statistics bundles, ranges, set assertions, source unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallypoint.operators import aggregates
from rallypoint.operators.aggregates import DECAY, MAX_AGE, PAIR


def _counted(df: DataFrame, **checks: Column) -> DataFrame:
    """check, failures of one pass over df."""
    one = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in checks))).alias("x")).select("x.*")


def cross_team(participants: DataFrame, teams: DataFrame, totals: DataFrame, matches: DataFrame) -> DataFrame:
    """check, failures between players, teams and opponents.

    teams has match_id, team_id, win and champion_kills, totals match_id, team_id,
    members, team_kills and team_deaths. One shuffle by match serves the teams.
    """
    people = participants.select("match_id", "team_id", F.col("win").alias("own_win")).join(teams.select("match_id", "team_id", F.col("win").alias("team_win"), F.lit(True).alias("known")), ["match_id", "team_id"], "left")
    first = _counted(people, participant_without_team=F.col("known").isNull(), participant_team_win=F.col("own_win") != F.col("team_win"))
    rows = teams.join(totals, ["match_id", "team_id"], "left").join(matches.select("match_id", F.lit(True).alias("has_match")), "match_id", "left")
    match = W.partitionBy("match_id")
    rows = rows.withColumn("n_teams", F.count(F.lit(1)).over(match)).withColumn("other_deaths", F.when(F.count("team_deaths").over(match) == 2, F.sum("team_deaths").over(match) - F.col("team_deaths")))
    second = _counted(
        rows,
        team_kills_champion_kills=~F.col("team_kills").eqNullSafe(F.col("champion_kills")),
        team_participant_count=F.coalesce("members", F.lit(0)) != 5,
        team_kills_opponent_deaths=(F.col("n_teams") == 2) & (F.col("team_kills") != F.col("other_deaths")),
        team_without_context=F.col("has_match").isNull(),
    )
    return first.union(second)


def bundle_checks(rows: DataFrame, statistics: DataFrame, by_patch: DataFrame, windows: DataFrame, target: str, max_age: int = MAX_AGE) -> DataFrame:
    """check, failures of a statistics bundle against the rows it was made of, twelve rules.

    Tables as pair_statistics, patch_specific and cumulative_windows give them;
    values are rounded there, so sums may differ by a millionth.
    """
    key = list(PAIR)
    near = lambda a, b: F.abs(a - b) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(b))
    at = lambda df, prefix: df.select(F.struct(*key).alias("key"), *(F.col(c).alias(prefix + c) for c in df.columns if c not in key))
    source = aggregates.with_age(rows, target).groupBy(*key).agg(F.count(F.lit(1)).alias("source_n"), F.count_if("win").alias("source_wins"))
    patches = by_patch.groupBy(*key).agg(F.sum("games").alias("patch_games"), F.sum("wins").alias("patch_wins"))
    ages = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("windows"), F.sort_array(F.collect_list("oldest_age")).alias("ages"), F.max_by(F.struct("games", "wins", "sum_weights"), "oldest_age").alias("last"))
    joined = at(statistics, "").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("games", "wins", "losses", "sum_weights")))
    for other in (source, patches, ages):
        o = at(other, "")
        joined = joined.alias("a").join(o.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")), "full_outer").select(
            F.coalesce("a.key", "b.key").alias("key"), *(F.col(f"a.{c}") for c in joined.columns if c != "key"), *(F.col(f"b.{c}") for c in o.columns if c != "key")
        )
    pairs = _counted(
        joined,
        duplicate_key=F.col("copies") > 1,
        contribution_totals=~F.col("games").eqNullSafe(F.col("source_n")) | ~F.col("wins").eqNullSafe(F.col("source_wins")),
        outcomes=F.col("wins") + F.col("losses") != F.col("games"),
        aggregate_patch_totals=~F.col("games").eqNullSafe(F.col("patch_games")) | ~F.col("wins").eqNullSafe(F.col("patch_wins")),
        cumulative_window_count=~F.coalesce(F.col("windows") == max_age + 1, F.lit(False)),
        cumulative_window_order=F.col("ages") != F.sequence(F.lit(0), F.col("windows").cast("int") - 1),
        final_window_total=(F.col("last.games") != F.col("games")) | (F.col("last.wins") != F.col("wins")) | ~near(F.col("last.sum_weights"), F.col("sum_weights")),
    )
    each = _counted(
        windows,
        cumulative_window_outcomes=F.col("wins") + F.col("losses") != F.col("games"),
        weighted_outcomes=~near(F.col("weighted_wins") + F.col("weighted_losses"), F.col("sum_weights")),
        effective_sample_size=~near(F.col("effective_sample_size"), F.try_divide(F.col("sum_weights") * F.col("sum_weights"), F.col("sum_squared_weights"))) | (F.col("effective_sample_size").isNull() != (F.col("games") == 0)),
    )
    weights = _counted(by_patch, patch_weight=~near(F.col("patch_weight"), F.pow(F.lit(DECAY), F.col("age"))), patch_outcomes=F.col("wins") + F.col("losses") != F.col("games"))
    return pairs.union(each).union(weights)


def ranges(df: DataFrame, *metrics: str) -> DataFrame:
    """metric, n_null, least, most of each metric, in one pass."""
    one = df.agg(*(F.struct(F.count_if(F.col(c).isNull()).alias("n_null"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most")).alias(c) for c in metrics))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in metrics))).alias("x")).select("x.metric", "x.v.*")


def key_difference(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """key and side of the keys that only one table has (nulls equal); empty if the sets are equal."""
    both = a.select(*key).distinct().withColumn("in_a", F.lit(1)).unionByName(b.select(*key).distinct().withColumn("in_a", F.lit(0)))
    return both.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("in_a").alias("a")).where("n = 1").select(*key, F.when(F.col("a") == 1, "first").otherwise("second").alias("side"))


def union_sources(sources: dict[str, DataFrame], *key: str) -> DataFrame:
    """All rows of the named sources; a key in two of them raises an error where it is read."""
    whole = reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(n)) for n, df in sources.items()])
    over = W.partitionBy(*key)
    first, last = F.min("source").over(over), F.max("source").over(over)
    clash = F.raise_error(F.concat(F.lit("sources overlap: "), first, F.lit(" and "), last))
    return whole.withColumn("source", F.when(first == last, F.col("source")).otherwise(clash))


def overlaps(sources: dict[str, DataFrame], *key: str) -> DataFrame:
    """key, sources of the keys that several sources hold."""
    whole = reduce(DataFrame.unionByName, [df.select(*key).withColumn("source", F.lit(n)) for n, df in sources.items()])
    return whole.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_distinct("source").alias("n")).where("n > 1").drop("n")


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in order, no more; every task hands on at most n."""
    return rows.orderBy(*order).limit(n)


def attach_times(rows: DataFrame, times: DataFrame, *key: str) -> DataFrame:
    """rows with the columns of times; raises an error for a key that only one side has, or that times repeats."""
    n = times.groupBy(*key).agg(F.count(F.lit(1)).alias("n_times"), *(F.first(c).alias(c) for c in times.columns if c not in key))
    met = rows.withColumn("in_rows", F.lit(True)).join(n, list(key), "full_outer")
    good = F.coalesce(F.col("in_rows") & (F.col("n_times") == 1), F.lit(False))
    checked = F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("times are incomplete, repeated or extraneous")))
    return met.withColumn("in_rows", checked).where("in_rows").drop("in_rows", "n_times")
