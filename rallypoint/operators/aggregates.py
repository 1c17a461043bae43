"""Directional pair statistics with patch decay, windows and leave-one-out baselines.

Games and wins are kept as whole numbers per patch age and weighted once at the
end, so results don't depend on the order of rows, and a baseline without one
counterpart is a subtraction instead of a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallypoint.functions import patches
from rallypoint.operators.opponents import CONTEXT, synergies

DECAY = 0.8
MAX_AGE = 5
PAIR = ("focal", "focal_position", "other", "other_position", *CONTEXT)
ROLE_SHARE, ROLE_GAMES = 0.05, 50


def with_age(rows: DataFrame, target: str, max_age: int = MAX_AGE) -> DataFrame:
    """Keeps patches at most max_age behind the target and adds their age.

    Rows newer than the target, and rows of another major, raise an error where
    they are read; rows without a patch are left out.
    """
    age = patches.age(F.col("public_patch"), F.lit(target))
    checked = (
        F.when(age < 0, F.raise_error(F.lit("input is newer than the target patch")))
        .when(F.col("public_patch").isNotNull() & age.isNull(), F.raise_error(F.concat(F.lit("no age across majors: "), F.col("public_patch"))))
        .otherwise(age)
    )
    return rows.withColumn("age", checked).where(F.col("age") <= max_age)


def by_age(rows: DataFrame, *key: str, max_age: int = MAX_AGE) -> DataFrame:
    """key, games and wins: arrays of whole numbers indexed by age."""
    ages = range(max_age + 1)
    grouped = rows.groupBy(*key).agg(
        *(F.count_if(F.col("age") == a).alias(f"g{a}") for a in ages), *(F.count_if((F.col("age") == a) & F.col("win")).alias(f"w{a}") for a in ages)
    )
    return grouped.select(*key, F.array(*(f"g{a}" for a in ages)).alias("games_by_age"), F.array(*(f"w{a}" for a in ages)).alias("wins_by_age"))


def _weighted(counts: Column, power: int = 1) -> Column:
    return F.aggregate(F.transform(counts, lambda n, a: n * F.pow(F.lit(DECAY), a * power)), F.lit(0.0), lambda s, x: s + x)


def statistics(games: Column, wins: Column, prefix: str = "") -> list[Column]:
    """Sufficient statistics of games and wins by age; rates and size are null without games."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v)
    n, w = total(games), total(wins)
    sw, sw2, ww = _weighted(games), _weighted(games, 2), _weighted(wins)
    r = lambda x, name: F.round(x, 9).alias(prefix + name)
    return [
        n.alias(prefix + "games"), w.alias(prefix + "wins"), (n - w).alias(prefix + "losses"), r(F.when(n > 0, w / n), "raw_win_rate"),
        r(ww, "weighted_wins"), r(sw - ww, "weighted_losses"), r(F.when(n > 0, ww / sw), "weighted_win_rate"), r(sw, "sum_weights"), r(sw2, "sum_squared_weights"),
        r(F.when(n > 0, sw * sw / sw2), "effective_sample_size"),
    ]


def pair_statistics(rows: DataFrame, target: str) -> DataFrame:
    table = by_age(with_age(rows, target), *PAIR)
    return table.select(*PAIR, *statistics(F.col("games_by_age"), F.col("wins_by_age")))


def patch_specific(rows: DataFrame, target: str) -> DataFrame:
    """Each pair's statistics per observed patch, long form."""
    aged = with_age(rows, target).groupBy(*PAIR, "public_patch", "age").agg(F.count(F.lit(1)).alias("games"), F.count_if("win").alias("wins"))
    return aged.select(*PAIR, "public_patch", "age", F.round(F.pow(F.lit(DECAY), F.col("age")), 6).alias("patch_weight"), "games", "wins", (F.col("games") - F.col("wins")).alias("losses"), F.round(F.col("wins") / F.col("games"), 6).alias("raw_win_rate"))


def cumulative_windows(rows: DataFrame, target: str, max_age: int = MAX_AGE) -> DataFrame:
    """Each pair's statistics over ages 0..oldest for every oldest age, long form."""
    table = by_age(with_age(rows, target), *PAIR)
    dense = table.select(*PAIR, "games_by_age", "wins_by_age", F.explode(F.sequence(F.lit(0), F.lit(max_age))).alias("oldest_age"))
    upto = lambda c: F.slice(c, F.lit(1), F.col("oldest_age") + 1)
    observed = F.size(F.filter(upto("games_by_age"), lambda n: n > 0))
    return dense.select(*PAIR, "oldest_age", observed.alias("observed_patches"), *statistics(upto("games_by_age"), upto("wins_by_age")))


def window_patches(rows: DataFrame, target: str, max_age: int = MAX_AGE) -> DataFrame:
    """oldest_age, considered, missing_ages of each cumulative window: its patches, and the ages without any row."""
    present = with_age(rows, target, max_age).agg(F.collect_set("age").alias("ages"))
    each = present.select("ages", F.explode(F.sequence(F.lit(0), F.lit(max_age))).alias("oldest_age"))
    ages = F.sequence(F.lit(0), F.col("oldest_age"))
    text = lambda x: F.array_join(F.transform(x, lambda a: a.cast("string")), ",")
    return each.select("oldest_age", F.array_join(F.transform(ages, lambda a: patches.at_age(F.lit(target), a)), ",").alias("considered"), text(F.array_except(ages, "ages")).alias("missing_ages"))


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _totals(table: DataFrame, *key: str, max_age: int = MAX_AGE) -> list[Column]:
    over = W.partitionBy(*key)
    return [F.array(*(F.sum(F.get(c, F.lit(a))).over(over) for a in range(max_age + 1))).alias(f"all_{c}") for c in ("games_by_age", "wins_by_age")]


def leave_one_out(rows: DataFrame, target: str) -> DataFrame:
    """Each matchup with both champions' baselines that leave the other out."""
    table = by_age(with_age(rows, target), *PAIR)
    table = table.select("*", *_totals(table, "focal", "focal_position", *CONTEXT))
    back = table.select(*(F.col(c).alias(f"b_{c}") for c in table.columns))
    same = (F.col("focal") == F.col("b_other")) & (F.col("other") == F.col("b_focal")) & (F.col("focal_position") == F.col("b_other_position")) & (F.col("other_position") == F.col("b_focal_position"))
    for c in CONTEXT:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    both = table.join(back, same, "left")
    return both.select(
        *PAIR,
        *statistics(F.col("games_by_age"), F.col("wins_by_age"))[:2],
        *statistics(_minus(F.col("all_games_by_age"), F.col("games_by_age")), _minus(F.col("all_wins_by_age"), F.col("wins_by_age")), "focal_out_"),
        *statistics(_minus(F.col("b_all_games_by_age"), F.col("b_games_by_age")), _minus(F.col("b_all_wins_by_age"), F.col("b_wins_by_age")), "other_out_"),
    )


def synergy_leave_one_out(pairs: DataFrame, observed: DataFrame, target: str) -> DataFrame:
    """Each ally pair with both champions' baselines over their games without the other.

    Rows of a champion and role holding the ally are counted once each, however
    often the ally repeats in the team.
    """
    eligible = observed.where((F.size("synergy_reasons") == 0) & F.col("position").isNotNull())
    role = by_age(with_age(eligible, target), "champion_id", "position", *CONTEXT).withColumnsRenamed({"games_by_age": "rg", "wins_by_age": "rw"})
    once = pairs.dropDuplicates(["match_id", "participant_id", "other", "other_position"])
    with_other = by_age(with_age(once, target), *PAIR)
    games = by_age(with_age(pairs, target), *PAIR).withColumnsRenamed({"games_by_age": "pg", "wins_by_age": "pw"})

    def matched(left: DataFrame, right: DataFrame, ties: dict[str, str], kind: str) -> DataFrame:
        right = right.select(*(F.col(c).alias(f"j_{c}") for c in right.columns))
        same = F.lit(True)
        for a, b in {**ties, **{c: c for c in CONTEXT}}.items():
            same = same & F.col(a).eqNullSafe(F.col(f"j_{b}"))
        return left.join(right, same, kind)

    zero = F.array(*[F.lit(0).cast("bigint")] * (MAX_AGE + 1))
    swap = {"focal": "other", "focal_position": "other_position", "other": "focal", "other_position": "focal_position"}
    out = matched(games, with_other, {k: k for k in PAIR[:4]}, "left").withColumnsRenamed({"j_games_by_age": "ag", "j_wins_by_age": "aw"}).drop(*(f"j_{c}" for c in PAIR))
    out = matched(out, with_other, swap, "left").withColumnsRenamed({"j_games_by_age": "bg", "j_wins_by_age": "bw"}).drop(*(f"j_{c}" for c in PAIR))
    out = matched(out, role, {"focal": "champion_id", "focal_position": "position"}, "left").withColumnsRenamed({"j_rg": "fg", "j_rw": "fw"}).drop("j_champion_id", "j_position", *(f"j_{c}" for c in CONTEXT))
    out = matched(out, role, {"other": "champion_id", "other_position": "position"}, "left").withColumnsRenamed({"j_rg": "og", "j_rw": "ow"})
    take = lambda a, b: _minus(F.coalesce(a, zero), F.coalesce(b, zero))
    return out.select(
        *PAIR, *statistics(F.col("pg"), F.col("pw"))[:2],
        *statistics(take(F.col("fg"), F.col("ag")), take(F.col("fw"), F.col("aw")), "focal_without_"),
        *statistics(take(F.col("og"), F.col("bg")), take(F.col("ow"), F.col("bw")), "other_without_"),
    )


def role_share(observed: DataFrame, target: str) -> DataFrame:
    """Statistics per champion and role, and the role's share of the champion's eligible games."""
    rows = with_age(observed.where((F.size("role_reasons") == 0) & F.col("position").isNotNull()), target)
    table = by_age(rows, "champion_id", "position", *CONTEXT).select("champion_id", "position", *CONTEXT, *statistics(F.col("games_by_age"), F.col("wins_by_age")))
    all_roles = F.sum("games").over(W.partitionBy("champion_id", *CONTEXT))
    share = F.col("games") / all_roles
    return table.select(
        "*", all_roles.alias("all_role_games"), F.round(share, 6).alias("role_share"), (share >= ROLE_SHARE).alias("meets_share"), (F.col("games") >= ROLE_GAMES).alias("meets_games"),
        ((share >= ROLE_SHARE) & (F.col("games") >= ROLE_GAMES)).alias("provisional"),
    )


BUNDLES = ("role", "matchup", "synergy")


def bundle_counts(observed: DataFrame, target: str) -> DataFrame:
    """champion_id, position, context and, by bundle and age, games and wins: one count vector per champion and role.

    Entry b * (MAX_AGE + 1) + a of games counts the rows of age a that bundle b is
    eligible for, so one grouped pass serves all bundles.
    """
    rows = with_age(observed.where(F.col("position").isNotNull()), target)
    holds = [F.size(f"{b}_reasons") == 0 for b in BUNDLES]
    cells = [(F.col("age") == a) & on for on in holds for a in range(MAX_AGE + 1)]
    counts = rows.groupBy("champion_id", "position", *CONTEXT).agg(*(F.count_if(c).alias(f"g{i}") for i, c in enumerate(cells)), *(F.count_if(c & F.col("win")).alias(f"w{i}") for i, c in enumerate(cells)))
    return counts.select("champion_id", "position", *CONTEXT, F.array(*(f"g{i}" for i in range(len(cells)))).alias("games"), F.array(*(f"w{i}" for i in range(len(cells)))).alias("wins"))


def role_bundles(observed: DataFrame, target: str) -> DataFrame:
    """Per champion, role, bundle and cumulative window (ages 0 to oldest_age) the sufficient statistics; viability by the role bundle.

    A champion and role stand here if any row has them, eligible or not; games_by_age
    are the bundle's games of each single patch.
    """
    table = bundle_counts(observed, target)
    ages = MAX_AGE + 1
    own = F.aggregate(F.slice("games", 1, ages), F.lit(0).cast("bigint"), lambda s, x: s + x)
    table = table.withColumn("role_games", own)
    all_roles = F.sum("role_games").over(W.partitionBy("champion_id", *CONTEXT))
    table = table.withColumn("all_role_games", all_roles).withColumn("share", F.when(F.col("all_role_games") > 0, F.col("role_games") / F.col("all_role_games")))
    each = table.select("*", F.posexplode(F.array(*map(F.lit, BUNDLES))).alias("b", "bundle")).select("*", F.explode(F.sequence(F.lit(0), F.lit(MAX_AGE))).alias("oldest_age"))
    part = lambda c: F.slice(c, F.col("b") * ages + 1, F.col("oldest_age") + 1)
    meets = F.coalesce(F.col("share") >= ROLE_SHARE, F.lit(False)), F.col("role_games") >= ROLE_GAMES
    return each.select(
        "champion_id", "position", *CONTEXT, "bundle", "oldest_age", F.array_join(F.transform(part("games"), lambda n: n.cast("string")), ",").alias("games_by_age"),
        *statistics(part("games"), part("wins")), "all_role_games", F.round("share", 6).alias("role_share"), meets[0].alias("meets_share"), meets[1].alias("meets_games"), (meets[0] & meets[1]).alias("provisional"),
    )


def _without(rows: DataFrame, every: DataFrame, kind: str) -> DataFrame:
    """Each counterpart of `rows` with the totals of `every` less its own: one map per champion and role."""
    key = ("champion_id", "position", *CONTEXT)
    own = by_age(rows, *key, "other", "other_position")
    entry = F.struct(F.struct("other", "other_position").alias("k"), F.struct("games_by_age", "wins_by_age").alias("v"))
    maps = own.groupBy(*key).agg(F.map_from_entries(F.collect_list(entry)).alias("by_other"))
    totals = by_age(every, *key)
    right = totals.select(*(F.col(c).alias(f"t_{c}") for c in totals.columns))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    met = maps.join(right, same)
    rest = F.transform_values("by_other", lambda _, v: F.struct(_minus(F.col("t_games_by_age"), v["games_by_age"]).alias("g"), _minus(F.col("t_wins_by_age"), v["wins_by_age"]).alias("w")))
    return met.select(*key, F.lit(kind).alias("kind"), F.explode(rest).alias("k", "v"))


def exclusion_components(observed: DataFrame, target: str) -> DataFrame:
    """Per champion, role and counterpart: the bundle of the champion's eligible games without that counterpart.

    kind is opponent (matchup-eligible rows with an opponent) or ally
    (synergy-eligible rows; one that holds the ally twice is left out once).
    Counterparts are bounded by champions and roles, so a map per champion and role is.
    """
    rows = with_age(observed.where(F.col("position").isNotNull()), target)
    against = rows.where((F.size("matchup_reasons") == 0) & F.col("opponent_champion_id").isNotNull()).withColumns({"other": F.col("opponent_champion_id"), "other_position": F.col("position")})
    pairs = with_age(synergies(observed), target).dropDuplicates(["match_id", "participant_id", "other", "other_position"]).withColumnsRenamed({"focal": "champion_id", "focal_position": "position"})
    found = _without(against, against, "opponent").unionByName(_without(pairs, rows.where(F.size("synergy_reasons") == 0), "ally"))
    stats_ = statistics(F.col("v.g"), F.col("v.w"))
    status = F.when(F.aggregate(F.col("v.g"), F.lit(0).cast("bigint"), lambda s, x: s + x) > 0, "available").otherwise("unavailable_no_leave_pair_out_observations")
    return found.select("champion_id", "position", *CONTEXT, "kind", F.col("k.other").alias("other"), F.col("k.other_position").alias("other_position"), status.alias("availability"), *stats_)


def reverse_pair_check(rows: DataFrame, target: str) -> DataFrame:
    """check, failures: every pair has its reverse, with equal games and wins against losses."""
    table = pair_statistics(rows, target)
    back = table.select(*(F.col(c).alias(f"b_{c}") for c in table.columns))
    same = (F.col("focal") == F.col("b_other")) & (F.col("other") == F.col("b_focal")) & (F.col("focal_position") == F.col("b_other_position"))
    for c in CONTEXT:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    torn = F.col("b_games").isNull() | (F.col("games") != F.col("b_games")) | (F.col("wins") != F.col("b_losses"))
    return table.join(back, same, "left").agg(F.count_if(torn).alias("failures")).select(F.lit("reverse_pair").alias("check"), "failures")
