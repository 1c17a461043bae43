"""Reference policies over rolling-origin patch folds, and how well they predict.

Training counts lie in arrays by patch age. A row is predicted from strictly
earlier patches, that is from ages above its own, so one table serves all folds
and no training row is copied per fold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallypoint.functions import formulas as f
from rallypoint.functions import patches
from rallypoint.operators.aggregates import MAX_AGE, by_age, with_age
from rallypoint.sources.stages import stage

PRIOR_GAMES = 10.0
BINS = 10
#: Probabilities are settled to so many digits, so that an edge value falls in one bin whatever order sums took.
DIGITS = 12
POLICIES = ("naive_empirical", "champion_role_baseline", "shrunk_directional_matchup", "shrunk_directional_synergy", "matchup_synergy_combination")


def rolling_origin(matches: DataFrame) -> DataFrame:
    """evaluation_patch, training_patches (oldest first), and the matches on either side."""
    order = patches.order(F.col("public_patch"))
    counts = matches.groupBy("public_patch").agg(F.count(F.lit(1)).alias("n")).withColumn("o", order)
    later = counts.select(F.col("public_patch").alias("evaluation_patch"), F.col("n").alias("evaluation_matches"), F.col("o").alias("eo"))
    pairs = later.join(counts, F.col("o") < F.col("eo"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "public_patch"))), lambda x: x["public_patch"]), ",")
    return pairs.groupBy("evaluation_patch", "evaluation_matches").agg(names.alias("training_patches"), F.sum("n").alias("training_matches"))


def _before(counts: str) -> Column:
    """By age, the training total of a count array: what lies at greater ages."""
    return F.array(*(reduce(lambda x, y: x + y, (F.get(counts, F.lit(b)) for b in range(a + 1, MAX_AGE + 1)), F.lit(0).cast("bigint")) for a in range(MAX_AGE + 1)))


def _counts(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """name_ and key columns, name_g and name_w: training games and wins by a row's age; staged, so that joins know its size."""
    totals = by_age(rows, *key).select(*(F.col(k).alias(f"{name}_{k}") for k in key), _before("games_by_age").alias(f"{name}_g"), _before("wins_by_age").alias(f"{name}_w"))
    return stage(totals, f"{name}-counts")


def _on(left: list[str], name: str, right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x) == F.col(f"{name}_{y}") for x, y in zip(left, right, strict=True)))


def _at_age(name: str) -> tuple[Column, Column]:
    """Training games and wins for a row of column age, zero without counts."""
    return F.coalesce(F.get(f"{name}_g", F.col("age")), F.lit(0)), F.coalesce(F.get(f"{name}_w", F.col("age")), F.lit(0))


def _teams(rows: DataFrame) -> DataFrame:
    """One row per match and team: its rows as an array of structs (members)."""
    held = ("participant_id", "age", "champion_id", "position", "opponent_champion_id", "resolution", "eligible", "allied", "public_patch", "platform", "win")
    return rows.groupBy("match_id", "team_id").agg(F.collect_list(F.struct(*held)).alias("members"))


def _mates(teams: DataFrame) -> DataFrame:
    """match_id, member and each of its allies: role-eligible rows of the team, for members that are synergy-eligible too."""
    each = teams.select("match_id", F.explode("members").alias("m"), F.filter("members", lambda x: x["eligible"]).alias("others")).where("m.eligible AND m.allied")
    return each.select("match_id", "m", F.explode("others").alias("o")).where("o.participant_id <> m.participant_id").select(
        "match_id", F.col("m.participant_id").alias("participant_id"), F.col("m.age").alias("age"), F.col("m.win").alias("win"),
        F.col("m.champion_id").alias("focal"), F.col("m.position").alias("focal_position"), F.col("o.champion_id").alias("other"), F.col("o.position").alias("other_position"),
    )


def predictions(observed: DataFrame, target: str, prior: float = PRIOR_GAMES) -> DataFrame:
    """policy, row keys, outcome, probability (null: abstained), evidence, missing_reason.

    Counts by role, opponent and ally are bounded by roles and champions, not by
    matches, and are staged, so that rows needn't be shuffled to meet them.
    """
    rows = with_age(observed, target)
    allied = F.size("synergy_reasons") == 0
    rows = rows.withColumn("eligible", (F.size("role_reasons") == 0) & F.col("position").isNotNull()).withColumn("allied", allied)
    train = rows.where("eligible")
    teams = stage(_teams(rows), "teams")
    role = _counts(train, ["champion_id", "position"], "role")
    match = _counts(train.where("resolution = 'resolved_unique'"), ["champion_id", "position", "opponent_champion_id"], "match")
    ally = _counts(_mates(teams), ["focal", "focal_position", "other", "other_position"], "ally")
    # All games by age, one row and none without training rows, as a subquery.
    whole = role.agg(*(F.sum(F.get(f"role_{c}", F.lit(a))).alias(f"{c}{a}") for c in "gw" for a in range(MAX_AGE + 1)))
    whole = whole.select(F.struct(*(F.array(*(f"{c}{a}" for a in range(MAX_AGE + 1))).alias(f"all_{c}") for c in "gw")))
    ev = teams.select("match_id", F.explode("members").alias("m"), F.filter("members", lambda x: x["eligible"]).alias("others")).where(F.col("m.age") < MAX_AGE).select("match_id", "m.*", "others")
    ev = ev.join(role, _on(["champion_id", "position"], "role", ["champion_id", "position"]), "left")
    ev = ev.join(match, _on(["champion_id", "position", "opponent_champion_id"], "match", ["champion_id", "position", "opponent_champion_id"]), "left")
    ev = ev.withColumn("all", whole.scalar()).withColumns({"all_g": F.col("all.all_g"), "all_w": F.col("all.all_w")})
    n = {f"{name}{c}": x for name in ("all", "role", "match") for c, x in zip("nw", _at_age(name), strict=True)}
    ev = ev.withColumns(n)
    keys = ["match_id", "participant_id"]
    held = [*keys, "public_patch", "platform", "position", "win", "resolution", "eligible", "allied", "alln", "allw", "rolen", "rolew", "matchn", "matchw"]
    rate = lambda name: F.when(F.col(f"{name}n") > 0, F.col(f"{name}w") / F.col(f"{name}n"))
    base = F.coalesce(rate("role"), rate("all"))
    # A row that is no ally's focal row stays once, without ally.
    others = F.when(F.col("eligible") & F.col("allied"), F.filter("others", lambda x: x["participant_id"] != F.col("participant_id")))
    each = ev.select(*held, "age", "champion_id", F.explode_outer(others).alias("o")).withColumns({"other": F.col("o.champion_id"), "other_position": F.col("o.position")})
    each = each.join(ally, _on(["champion_id", "position", "other", "other_position"], "ally", ["focal", "focal_position", "other", "other_position"]), "left")
    sg, sw = _at_age("ally")
    met = F.col("o").isNotNull()
    ev = each.groupBy(*held).agg(F.avg(F.when(met, (sw + base * prior) / (sg + prior))).alias("ally_p"), F.sum(F.when(met, sg)).alias("ally_n"))
    ev = ev.select("*", rate("all").alias("global_p"), F.col("alln").alias("global_n"), rate("role").alias("role_p"), F.col("rolen").alias("role_n"), F.col("matchn").alias("match_n"), ((F.col("matchw") + base * prior) / (F.col("matchn") + prior)).alias("match_p"))
    ok = F.col("eligible")
    no_match = F.when(~ok, "role_ineligible").when(F.col("resolution") != "resolved_unique", "matchup_ineligible")
    no_ally = F.when(~ok, "role_ineligible").when(~F.col("allied"), "synergy_ineligible").when(F.col("ally_p").isNull(), "no_eligible_allies")
    both = F.coalesce(no_match, no_ally)
    total = F.col("match_n") + F.coalesce("ally_n", F.lit(0))

    def one(policy: str, p: Column, evidence: Column, missing: Column) -> Column:
        missing = F.coalesce(missing, F.lit(None).cast("string"))
        return F.struct(F.lit(policy).alias("policy"), F.round(F.when(missing.isNull(), p), DIGITS).alias("probability"), F.when(missing.isNull(), evidence).otherwise(0).cast("bigint").alias("evidence"), missing.alias("missing_reason"))

    made = F.array(
        one(POLICIES[0], F.col("global_p"), F.col("global_n"), F.when(~ok, "role_ineligible")),
        one(POLICIES[1], F.col("role_p"), F.col("role_n"), F.when(~ok, "role_ineligible").when(F.col("role_n") == 0, "unseen_champion_role")),
        one(POLICIES[2], F.col("match_p"), F.col("match_n"), no_match),
        one(POLICIES[3], F.col("ally_p"), F.col("ally_n"), no_ally),
        one(POLICIES[4], (F.col("match_p") + F.col("ally_p")) / 2, total, both),
    )
    out = ev.select(*keys, "public_patch", "platform", F.coalesce("position", F.lit("<missing>")).alias("role"), F.col("win").cast("int").alias("outcome"), F.when(ok, F.col("role_n")).otherwise(0).alias("role_games"), F.explode(made).alias("x"))
    return out.select("x.policy", *keys, "public_patch", "platform", "role", "role_games", "outcome", "x.probability", "x.evidence", "x.missing_reason")


def _sums(records: DataFrame, *key: str, bins: int) -> DataFrame:
    """key, bin (null: no probability) and what metrics adds up: one row per key and bin, from one pass."""
    p, y = F.col("probability"), F.col("outcome")
    has = p.isNotNull()
    chosen = F.when(y == 1, p).otherwise(1 - p)
    square, right, loss = F.pow(p - y, 2), F.when(has, ((p >= 0.5) == (y == 1)).cast("int")), f.log_loss(p, y)
    at = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    added = {"square": square, "right": right, "loss": loss, "p": p, "y": F.when(has, y)}
    return records.groupBy(*key, F.when(has, at).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), *(x for name, c in added.items() for x in (F.sum(c).alias(f"{name}_s"), F.count(c).alias(f"{name}_n"))), F.max(F.when(has & (chosen <= 0), 1)).alias("impossible"))


def _metrics(sums: DataFrame, *key: str) -> DataFrame:
    names = ("square", "right", "loss", "p", "y")
    by = sums.groupBy(*key, "bin").agg(F.sum("rows").alias("rows"), *(F.sum(f"{x}_{c}").alias(f"{x}_{c}") for x in names for c in "sn"), F.max("impossible").alias("impossible"))
    mean = lambda x: F.try_divide(F.sum(f"{x}_s"), F.sum(f"{x}_n"))
    gap = F.col("p_n") * F.abs(F.try_divide(F.col("p_s"), F.col("p_n")) - F.try_divide(F.col("y_s"), F.col("y_n")))
    out = by.groupBy(*key).agg(
        F.sum("rows").alias("candidate_rows"), F.sum("p_n").alias("evaluated_rows"), mean("square").alias("brier_score"), mean("right").alias("accuracy"),
        F.when(F.coalesce(F.max("impossible"), F.lit(0)) == 0, mean("loss")).alias("log_loss"), F.sum(F.when(F.col("bin").isNotNull(), gap)).alias("gap"),
    )
    n = F.col("evaluated_rows")
    return out.select(
        *key, "candidate_rows", n, (F.col("candidate_rows") - n).alias("abstained_rows"), (n / F.col("candidate_rows")).alias("coverage"), "log_loss", "brier_score", "accuracy",
        F.when(n > 0, F.col("gap") / n).alias("calibration_error"),
    )


def metrics(records: DataFrame, *key: str, bins: int = BINS) -> DataFrame:
    """Coverage, Brier score, log loss, accuracy and calibration error per key, from one pass over the records."""
    return _metrics(_sums(records, *key, bins=bins), *key)


def calibration(records: DataFrame, *key: str, bins: int = BINS) -> DataFrame:
    """Per key and equal-width bin: count, mean probability, observed rate; empty bins stay."""
    p = F.col("probability")
    grid = records.select(*key).distinct().select(*key, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    at = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    found = records.where(p.isNotNull()).groupBy(*(F.col(k).alias(f"f_{k}") for k in key), at.alias("f_bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_probability"), F.avg("outcome").alias("observed_rate"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in (*key, "bin")))
    return grid.join(found, same, "left").select(*key, "bin", (F.col("bin") / bins).alias("lower"), F.coalesce("n", F.lit(0)).alias("n"), "mean_probability", "observed_rate")


def _reached(value: Column, edges: list[float]) -> Column:
    """How many of the edges are at most the value."""
    return reduce(lambda a, b: a + b, ((value >= F.lit(e)).cast("int") for e in edges))


def interval_ece(records: DataFrame, *key: str, bins: int = BINS) -> DataFrame:
    """Calibration error with bins i/n <= p < (i+1)/n, one in the last bin; edges compared, not multiplied."""
    p = F.col("probability")
    at = F.least(_reached(p, [(i + 1) / bins for i in range(bins)]), F.lit(bins - 1))
    by_bin = records.where(p.isNotNull()).groupBy(*key, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg("outcome").alias("y"))
    return by_bin.groupBy(*key).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("interval_ece"))


def confidence_ece(records: DataFrame, *key: str) -> DataFrame:
    """Weighted error over ten confidence bins whose upper edge reaches 1e-12 too far, so an edge value counts in two bins.

    One pass sums rows by the last bin that they reach and by whether they lie in it
    and in the one before; only these sums are dealt to bins.
    """
    p, edges = F.col("probability"), [0.9 * i / 9 for i in range(10)]
    c = F.greatest(p, 1 - p)
    right = ((p >= 0.5) == (F.col("outcome") == 1)).cast("double")
    lowers = F.array(*map(F.lit, edges))
    rows = records.where(p.isNotNull()).select(*key, c.alias("c"), right.alias("right"), (_reached(c, edges) - 1).alias("last"))
    within = lambda back: F.coalesce((F.col("last") >= back) & (F.col("c") < F.get(lowers, F.col("last") - back) + 0.1 + 1e-12), F.lit(False))
    sums = rows.groupBy(*key, "last", within(0).alias("own"), within(1).alias("before")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("right").alias("right_s"), F.count("right").alias("right_n"), F.sum("c").alias("c_s"))
    bins = F.explode(F.array_compact(F.array(F.when(F.col("own"), F.col("last")), F.when(F.col("before"), F.col("last") - 1), F.lit(-1))))
    dealt = sums.select(*key, "n", "right_s", "right_n", "c_s", bins.alias("bin"))
    # Bin -1 holds every row once, for the total.
    by_bin = dealt.groupBy(*key, "bin").agg(F.sum("n").alias("n"), (F.sum("n") * F.abs(F.sum("right_s") / F.sum("right_n") - F.sum("c_s") / F.sum("n"))).alias("gap"))
    total = F.sum(F.when(F.col("bin") == -1, F.col("n")))
    return by_bin.groupBy(*key).agg((F.sum(F.when(F.col("bin") >= 0, F.col("gap"))) / total).alias("confidence_ece"))


def slices(records: DataFrame) -> DataFrame:
    """policy, dimension, value and the metrics of each slice: one pass sums by all dimensions at once, and these few sums are stacked."""
    dims = {"public_patch": F.col("public_patch"), "platform": F.col("platform"), "role": F.col("role"), "champion_frequency": f.evidence_bucket(F.col("role_games")), "training_evidence": f.evidence_bucket(F.col("evidence"))}
    cells = _sums(records.select("policy", "probability", "outcome", *(v.alias(f"of_{k}") for k, v in dims.items())), "policy", *(f"of_{k}" for k in dims), bins=BINS)
    stacked = cells.withColumn("d", F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(f"of_{k}").alias("value")) for k in dims))))
    return _metrics(stacked.select("*", "d.dimension", "d.value"), "policy", "dimension", "value")
