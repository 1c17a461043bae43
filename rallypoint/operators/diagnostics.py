"""How predictions spread and differ: exact quantiles, bands, disagreement, and ladders of paired comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallypoint.operators.audits import values_below

# Bands of probabilities, closed on both sides, and quantiles.
BANDS = ((0.49, 0.51), (0.45, 0.55), (0.40, 0.60))
QUANTILES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
OVERALL = "overall"


def scoped(rows: DataFrame, scope: str) -> DataFrame:
    """Every row twice: under its own scope and under `overall`."""
    return rows.withColumn("scope", F.explode(F.array(F.lit(OVERALL), F.col(scope).cast("string"))))


def quantiles(rows: DataFrame, value: str, *key: str, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """key and q00 ... q100: exact interpolated quantiles, from counts of ranges of distinct values.

    No task sorts a key's values as a whole.
    """
    cells = values_below(rows.where(F.col(value).isNotNull()), value, *key)
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*(F.col(k).alias(f"of_{k}") for k in key)).agg(F.count(F.lit(1)).alias("of_n"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key))
    met = cells.join(sizes, same)
    ends = []
    for i, q in enumerate(at):
        place = (F.col("of_n") - 1) * F.lit(q)
        for name, where in (("low", F.floor(place)), ("high", F.ceil(place))):
            ends.append(F.max(F.when(F.col("below") <= where, F.col(value))).alias(f"{name}_{i}"))
        ends.append(F.max(place - F.floor(place)).alias(f"part_{i}"))
    found = met.groupBy(*key).agg(*ends)
    return found.select(*key, *((F.col(f"low_{i}") + F.col(f"part_{i}") * (F.col(f"high_{i}") - F.col(f"low_{i}"))).alias(f"q{round(100 * q):02d}") for i, q in enumerate(at)))


def _beside(left: DataFrame, right: DataFrame, key: tuple[str, ...]) -> DataFrame:
    right = right.select(*(F.col(c).alias(f"r_{c}") if c in key else F.col(c) for c in right.columns))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key))
    return left.join(right, same, "left").drop(*(f"r_{k}" for k in key))


def prediction_summary(predictions: DataFrame, model: str, scope: str, probability: str = "probability") -> DataFrame:
    """model, scope, n, mean, deviation, distance (mean from one half), share of each band, quantiles; of given probabilities."""
    p = F.col(probability)
    rows = scoped(predictions.where(p.isNotNull()).select(model, scope, probability), scope).select(model, "scope", probability)
    bands = [F.avg(p.between(a, b).cast("double")).alias(f"band_{round(100 * a)}_{round(100 * b)}") for a, b in BANDS]
    whole = rows.groupBy(model, "scope").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("deviation"), F.avg(F.abs(p - 0.5)).alias("distance"), *bands)
    return _beside(whole, quantiles(rows, probability, model, "scope"), (model, "scope"))


def disagreement(predictions: DataFrame, model: str, first: str, second: str, scope: str, *row: str, probability: str = "probability") -> DataFrame:
    """scope, band (of the first model's probability; all: every row), n, signed, absolute, most and quantiles of the absolute difference second less first.

    Both models' probabilities of a row meet in one grouped pass; rows that only
    one model predicts are left out. Bands are closed, so an edge is in two.
    """
    side = lambda name: F.max(F.when(F.col(model) == name, F.col(probability)))
    both = predictions.where(F.col(model).isin(first, second)).groupBy(scope, *row).agg(side(first).alias("p1"), side(second).alias("p2")).where("p1 IS NOT NULL AND p2 IS NOT NULL")
    in_band = F.array_compact(F.array(F.lit("all"), *(F.when(F.col("p1").between(a, b), F.lit(f"{a:.2f}-{b:.2f}")) for a, b in BANDS)))
    rows = scoped(both, scope).select("scope", F.explode(in_band).alias("band"), (F.col("p2") - F.col("p1")).alias("d"), F.abs(F.col("p2") - F.col("p1")).alias("a"))
    whole = rows.groupBy("scope", "band").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("signed"), F.avg("a").alias("absolute"), F.max("a").alias("most"))
    return _beside(whole, quantiles(rows, "a", "scope", "band"), ("scope", "band"))


def ladder(predictions: DataFrame, model: str, losses: dict[str, Column], pairs: list[tuple[str, str]], folds: list[str], *row: str) -> DataFrame:
    """candidate, comparator, metric, one column per fold (null: over all of it), n, difference, deviation, better: every comparison from one scan.

    A row's losses under the paired models are one column each, from one grouped
    pass; each pair that has both gives a difference per metric, and grouping sets
    sum these over folds, each alone, and over everything. A model's name may stand
    in any number of pairs; a row has one loss per model.
    """
    names = sorted({m for pair in pairs for m in pair})
    at = {(m, name): f"x_{i}_{j}" for i, m in enumerate(names) for j, name in enumerate(losses)}
    wide = predictions.where(F.col(model).isin(names)).select(*folds, *row, model, *(x.alias(f"of_{j}") for j, x in enumerate(losses.values())))
    held = wide.groupBy(*folds, *row).agg(*(F.max(F.when(F.col(model) == m, F.col(f"of_{j}"))).alias(at[m, name]) for m in names for j, name in enumerate(losses)))
    asked = [(a, b, name) for a, b in pairs for name in losses]
    each = held.select(*folds, F.posexplode(F.array(*(F.col(at[a, name]) - F.col(at[b, name]) for a, b, name in asked))).alias("i", "d")).where("d IS NOT NULL")
    # Moments by all folds at once; the grouping sets are taken of these few rows.
    cells = each.groupBy(*folds, "i").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.var_pop("d").alias("spread"), F.count_if(F.col("d") < 0).alias("less"))
    named = F.get(F.array(*(F.struct(F.lit(a).alias("candidate"), F.lit(b).alias("comparator"), F.lit(name).alias("metric")) for a, b, name in asked)), F.col("i"))
    by = ["candidate", "comparator", "metric"]
    sets = [[F.col(c) for c in by], *([F.col(c) for c in [*by, f]] for f in folds)]
    cells = cells.withColumn("q", named).select(*folds, "q.*", "n", "mean", "spread", "less")
    n, m = F.col("n"), F.col("mean")
    sums = cells.groupingSets(sets, *by, *folds).agg(F.sum(n * m).alias("s"), F.sum(n * (F.col("spread") + m * m)).alias("q"), F.sum("less").alias("less"), F.sum(n).alias("n"))
    mean = F.col("s") / n
    deviation = F.when(n > 1, F.sqrt(F.greatest(F.col("q") - n * mean * mean, F.lit(0.0)) / (n - 1)))
    return sums.select(*by, *folds, "n", mean.alias("difference"), deviation.alias("deviation"), (F.col("less") / n).alias("better"))
