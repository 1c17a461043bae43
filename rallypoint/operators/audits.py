"""Distributions, correlations, supports and weighted model metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallypoint.sources.stages import stage


def values_below(rows: DataFrame, value: str, *key: str) -> DataFrame:
    """key, value, cell_n, below: each distinct value, its rows, and the key's rows with lower values.

    Values are dealt out by ranges; ranges are summed within themselves, and only
    the ranges' totals of a key meet in one window.
    """
    cells = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("cell_n"))
    parts = stage(cells.repartitionByRange(*key, value).withColumn("range_no", F.spark_partition_id()), "ranges")
    totals = parts.groupBy(*key, "range_no").agg(F.sum("cell_n").alias("range_n"))
    before = F.sum("range_n").over(W.partitionBy(*key).orderBy("range_no")) - F.col("range_n")
    totals = totals.select(*(F.col(k).alias(f"total_{k}") for k in key), F.col("range_no").alias("total_no"), before.alias("before"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"total_{k}")) for k in key), F.col("range_no") == F.col("total_no"))
    within = F.sum("cell_n").over(W.partitionBy(*key, "range_no").orderBy(value)) - F.col("cell_n")
    return parts.withColumn("within", within).join(totals, same).select(*key, value, "cell_n", (F.col("before") + F.col("within")).alias("below"))


def distribution(rows: DataFrame, value: str, *key: str) -> DataFrame:
    """Counts, mean, population deviation and exact quartiles of a value per key; nothing of a key meets in one task but sums."""
    whole = rows.groupBy(*key).agg(
        F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most")
    )
    named = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    of = whole.select(*(F.col(k).alias(f"of_{k}") for k in key), F.col("n").alias("of_n"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key))
    cells = values_below(rows.where(F.col(value).isNotNull()), value, *key).join(of, same)
    place = lambda q: (F.col("of_n") - 1) * q
    at = lambda i: F.max(F.when(F.col("below") <= i, F.col(value)))
    ends = [x for name, q in named.items() for x in (at(F.floor(place(q))).alias(f"{name}_low"), at(F.ceil(place(q))).alias(f"{name}_high"), F.first(place(q) - F.floor(place(q))).alias(f"{name}_part"))]
    found = cells.groupBy(*(F.col(k).alias(f"of_{k}") for k in key)).agg(*ends)
    mixed = [((1 - F.col(f"{n}_part")) * F.col(f"{n}_low") + F.col(f"{n}_part") * F.col(f"{n}_high")).alias(n) for n in named]
    return whole.join(found, same, "left").select(*key, "n", "missing", "mean", "deviation", "least", *mixed, "most")


def correlations(rows: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Pearson and Spearman per key; null where a side doesn't vary."""
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c, name in ((x, "rx"), (y, "ry")):
        cells = values_below(ranked, c, key).select(F.col(key).alias(f"{name}_key"), F.col(c).alias(f"{name}_at"), (F.col("below") + (F.col("cell_n") + 1) / 2).alias(name))
        ranked = ranked.join(cells, F.col(key).eqNullSafe(F.col(f"{name}_key")) & (F.col(c) == F.col(f"{name}_at")))
    varies = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.when(varies, F.corr(x, y)).alias("pearson"), F.when(varies, F.corr("rx", "ry")).alias("spearman"))


def cosine(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Cosine similarity of two weightings over their common keys."""
    both = left.select(F.col(key), F.col(value).alias("x")).join(right.select(F.col(key).alias("k2"), F.col(value).alias("y")), F.col(key) == F.col("k2"))
    return both.agg(F.count(F.lit(1)).alias("common"), F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("cosine"))


def support(rows: DataFrame, group: str, levels: dict[str, list[str]], thresholds: tuple[int, ...] = (2, 5, 10, 20, 50)) -> DataFrame:
    """Per level of grouping: combinations, rows, top share, and combinations with at least so many groups."""
    out = []
    for level, keys in levels.items():
        cells = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("groups"))
        out.append(
            cells.agg(
                F.lit(level).alias("level"), F.count(F.lit(1)).alias("combinations"), F.sum("n").alias("rows"), F.try_divide(F.max("n"), F.sum("n")).alias("top_share"),
                *(F.count_if(F.col("groups") >= t).alias(f"groups_{t}") for t in thresholds),
            )
        )
    return reduce(DataFrame.union, out)


def top_supported(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k most frequent combinations; ties by key."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *key).limit(k)


def top_coefficients(coefficients: DataFrame, k: int = 10, minimum: int = 100) -> DataFrame:
    """The k largest coefficients by size among features with enough support; ties by name."""
    return coefficients.where(F.col("support") >= minimum).orderBy(F.desc(F.abs("coefficient")), "feature").limit(k)


def class_balance(rows: DataFrame, outcome: str, stratum: str) -> DataFrame:
    """Wins, losses and rate overall (null stratum) and per stratum."""
    found = rows.rollup(stratum).agg(F.sum(outcome).alias("wins"), F.count(F.lit(1)).alias("n"), F.grouping(stratum).alias("is_all"))
    return found.select(F.when(F.col("is_all") == 1, "<all>").otherwise(F.col(stratum)).alias("stratum"), "wins", (F.col("n") - F.col("wins")).alias("losses"), (F.col("wins") / F.col("n")).alias("rate"))


def regression_metrics(rows: DataFrame, target: str, predicted: str, weight: str, *key: str) -> DataFrame:
    """Weighted MAE, RMSE, R2 (null without variance) and sign accuracy, from sums alone."""
    t, p, w = F.col(target).cast("double"), F.col(predicted).cast("double"), F.col(weight).cast("double")
    e = p - t
    centers = rows.groupBy(*(F.col(k).alias(f"of_{k}") for k in key)).agg(F.avg(t).alias("center"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key))
    rows = rows.join(centers, same).withColumn("shifted", t - F.col("center"))
    s = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("weight_sum"), F.sum(w * F.abs(e)).alias("a"), F.sum(w * e * e).alias("e2"), F.sum(w * F.col("shifted")).alias("s1"),
        F.sum(w * F.col("shifted") * F.col("shifted")).alias("s2"), F.sum(w * (F.signum(p) == F.signum(t)).cast("int")).alias("right"),
    )
    spread = F.col("s2") - F.col("s1") * F.col("s1") / F.col("weight_sum")
    return s.select(*key, "n", "weight_sum", (F.col("a") / F.col("weight_sum")).alias("mae"), F.sqrt(F.col("e2") / F.col("weight_sum")).alias("rmse"), F.when(spread > 0, 1 - F.col("e2") / spread).alias("r2"), (F.col("right") / F.col("weight_sum")).alias("sign_accuracy"))


def multiclass_metrics(rows: DataFrame, target: str, probabilities: list[str], weight: str, *key: str) -> DataFrame:
    """Weighted log loss and Brier score over all classes; target is the class's number."""
    brier = reduce(lambda a, b: a + b, (F.pow(F.col(c) - (F.col(target) == i).cast("int"), 2) for i, c in enumerate(probabilities)))
    own = F.get(F.array(*probabilities), F.col(target))
    w = F.col(weight)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), (F.sum(-F.log(F.greatest(own, F.lit(1e-15))) * w) / F.sum(w)).alias("log_loss"), (F.sum(brier * w) / F.sum(w)).alias("brier"))


def multiclass_calibration(rows: DataFrame, target: str, probabilities: list[str], weight: str, *key: str) -> DataFrame:
    """key, match_weight, ece, n_class_<i>: calibration of the likeliest class over ten bins, and rows per class.

    A bin ends a hair above its upper edge, so a confidence on an edge counts in both.
    """
    every, conf = F.array(*probabilities), F.greatest(*probabilities)
    hit = (F.array_position(every, conf) - 1 == F.col(target)).cast("double")
    low = lambda i: i * F.lit(0.1)
    bins = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("conf") >= low(i)) & (F.col("conf") < low(i) + 0.1 + 1e-12))
    scored = rows.select(*key, F.col(target).alias("y"), F.col(weight).alias("w"), conf.alias("conf"), hit.alias("hit"))
    each = scored.select(*(F.col(k).alias(f"of_{k}") for k in key), "w", "conf", "hit", F.explode(bins).alias("bin"))
    gaps = each.groupBy(*(f"of_{k}" for k in key), "bin").agg(F.abs(F.sum(F.col("w") * F.col("hit")) - F.sum(F.col("w") * F.col("conf"))).alias("gap"))
    gaps = gaps.groupBy(*(f"of_{k}" for k in key)).agg(F.sum("gap").alias("gap"))
    counts = scored.groupBy(*key).agg(F.sum("w").alias("match_weight"), *(F.count_if(F.col("y") == i).alias(f"n_class_{i}") for i in range(len(probabilities))))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key))
    return counts.join(gaps, same, "left").select(*key, "match_weight", F.try_divide(F.col("gap"), F.col("match_weight")).alias("ece"), *(f"n_class_{i}" for i in range(len(probabilities))))


def histogram(rows: DataFrame, *fields: str) -> DataFrame:
    """field, value, n: how often each value of each field occurs; missing ones under `<missing>`."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias("value")) for c in fields)))
    return rows.select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def means_or_overall(rows: DataFrame, key: str, value: str, weight: str, minimum: int = 10) -> DataFrame:
    """The weighted mean per key, or the overall one where a key has too few rows."""
    v, w = F.col(value) * F.col(weight), F.col(weight)
    cells = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("v"), F.sum(w).alias("w"))
    overall = rows.agg(F.sum(v) / F.sum(w)).scalar()
    return cells.select(key, "n", F.when(F.col("n") >= minimum, F.col("v") / F.col("w")).otherwise(overall).alias("mean"))


def survivors(rows: DataFrame, key: str, endpoint: str, value: str) -> DataFrame:
    """Per endpoint: how many keys still have a value, and their mean first value against the rest's."""
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(endpoint))).over(W.partitionBy(key))
    has = F.col(value).isNotNull()
    return rows.withColumn("first", first).groupBy(endpoint).agg(F.count_if(has).alias("present"), F.count_if(~has).alias("absent"), F.avg(F.when(has, F.col("first"))).alias("present_first"), F.avg(F.when(~has, F.col("first"))).alias("absent_first"))
