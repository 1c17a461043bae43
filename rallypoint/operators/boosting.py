"""Ordered boosting of oblivious trees over categorical slots.

Categories become numbers by ordered target statistics: a row's value is the
smoothed mean of the target over earlier rows of its category, in a hashed order,
so no row sees its own target. Values are cut into bins; a tree splits all its
leaves by the same feature and bin, level by level, each level being one grouped
sum of gradients by leaf, feature and bin. Only these sums, bounded by leaves,
features and bins, reach the driver. Whole numbers and decimals keep sums equal
for any partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallypoint.functions.formulas import sigmoid
from rallypoint.sources.stages import stage

PRIOR_WEIGHT = 1.0
BINS = 32
#: Digits that gradients are settled to, so that their sums are exact.
DIGITS = 12


def ordered_statistics(rows: DataFrame, row: str, category: list[str], target: str, prior: float, seed: int) -> DataFrame:
    """rows with earlier_n, earlier_sum and value: rows of the category before this one in the order of a digest, and their smoothed mean.

    The order is one of all rows of a category; ranges of the digest are summed
    within, and only ranges' totals meet, so no task sees a hot category whole.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(row).cast("string")), 256)
    part = F.substring("digest", 1, 3)
    held = rows.withColumn("digest", digest).withColumn("part", part)
    order = Window.partitionBy(*category, "part").orderBy("digest", row).rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(*category, "part").agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("s"))
    upto = Window.partitionBy(*category).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*(F.col(c).alias(f"b_{c}") for c in category), F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("b_n"), F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("b_s"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in (*category, "part")))
    within = held.select("*", F.count(F.lit(1)).over(order).alias("w_n"), F.coalesce(F.sum(target).over(order), F.lit(0)).alias("w_s"))
    met = within.join(before, same)
    n, s = F.col("b_n") + F.col("w_n"), F.col("b_s") + F.col("w_s")
    return met.select(*rows.columns, n.alias("earlier_n"), s.alias("earlier_sum"), ((s + F.lit(prior * PRIOR_WEIGHT)) / (n + F.lit(PRIOR_WEIGHT))).alias("value"))


def whole_statistics(rows: DataFrame, category: list[str], target: str, prior: float) -> DataFrame:
    """category, value: the smoothed mean over all training rows, for rows that are scored."""
    found = rows.groupBy(*category).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("s"))
    return found.select(*category, ((F.col("s") + F.lit(prior * PRIOR_WEIGHT)) / (F.col("n") + F.lit(PRIOR_WEIGHT))).alias("value"))


def binned(value: Column, bins: int = BINS) -> Column:
    """Bins of equal width over [0, 1]."""
    return F.least(F.greatest(F.floor(value * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


@dataclass(frozen=True)
class Tree:
    """splits: (feature number, least bin of the right side) of each level; values by leaf, the first level in the lowest bit."""

    splits: tuple[tuple[int, int], ...]
    values: tuple[float, ...]

    def leaf(self, bins: str) -> Column:
        return reduce(lambda a, b: a + b, (F.when(F.get(bins, F.lit(f)) >= b, 1 << i).otherwise(0) for i, (f, b) in enumerate(self.splits)), F.lit(0))

    def score(self, bins: str) -> Column:
        return F.get(F.array(*map(F.lit, self.values)), self.leaf(bins))


def _exact(x: Column) -> Column:
    return F.sum(F.round(x, DIGITS).cast(f"decimal(20,{DIGITS})"))


def _grow(rows: DataFrame, features: int, bins: int, depth: int, l2: float, rate: float) -> Tree:
    """One tree on the gradients g and h of rows; ties go to the lower feature, then bin."""
    splits: list[tuple[int, int]] = []
    leaf: Column = F.lit(0)
    sums: dict[int, list[float]] = {0: [0.0, 0.0]}
    for level in range(depth):
        long = rows.select(leaf.alias("leaf"), "g", "h", F.posexplode("bins").alias("f", "b"))
        cells = long.groupBy("leaf", "f", "b").agg(_exact(F.col("g")).alias("g"), _exact(F.col("h")).alias("h")).collect()
        table: dict[int, dict[int, list[list[float]]]] = {}
        for r in cells:
            at = table.setdefault(r.f, {}).setdefault(r.leaf, [[0.0, 0.0] for _ in range(bins)])
            at[r.b] = [float(r.g), float(r.h)]
        best = (-1.0, 0, 0)
        for f in sorted(table):
            for cut in range(1, bins):
                gain = 0.0
                for cell in table[f].values():
                    for part in (cell[:cut], cell[cut:]):
                        g, h = sum(x[0] for x in part), sum(x[1] for x in part)
                        gain += g * g / (h + l2)
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
        _, f, cut = best
        sums = {}
        for number, cell in table.get(f, {}).items():
            for side, part in enumerate((cell[:cut], cell[cut:])):
                sums[number | side << level] = [sum(x[0] for x in part), sum(x[1] for x in part)]
        splits.append((f, cut))
        leaf = leaf + F.when(F.get("bins", F.lit(f)) >= cut, 1 << level).otherwise(0)
    values = [-rate * sums[i][0] / (sums[i][1] + l2) if i in sums else 0.0 for i in range(1 << depth)]
    return Tree(tuple(splits), tuple(values))


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Tree, ...]

    def probability(self, bins: str) -> Column:
        z = reduce(lambda a, b: a + b, (t.score(bins) for t in self.trees), F.lit(self.start))
        return sigmoid(z)


def boost(rows: DataFrame, features: int, trees: int = 20, depth: int = 3, rate: float = 0.3, l2: float = 1.0, bins: int = BINS, start: float = 0.0, every: int = 5) -> Model:
    """Fits rows (bins: array of bin numbers by feature, y: 0 or 1) by logistic loss; scores are staged every few trees."""
    now = stage(rows.select("bins", F.col("y").cast("double").alias("y")).withColumn("z", F.lit(start)), "boosting")
    grown: list[Tree] = []
    fresh: list[Tree] = []
    for i in range(trees):
        z = reduce(lambda a, b: a + b, (t.score("bins") for t in fresh), F.col("z"))
        p = sigmoid(z)
        tree = _grow(now.select("bins", (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h")), features, bins, depth, l2, rate)
        grown.append(tree)
        fresh.append(tree)
        if (i + 1) % every == 0 and i + 1 < trees:
            now = stage(now.withColumn("z", z + tree.score("bins")), "boosting")
            fresh = []
    return Model(start, tuple(grown))
