"""Exact multinomial redraws within strata, and power by resampling.

Every replicate draws as many units of a stratum as it holds. A stratum's units
are numbered by digest and cut into blocks; how many draws fall to a block is split
down a tree of blocks by conditional binomials, each node's from its own digest, so
every block finds its count alone, and the counts of all blocks add up to the
stratum's size in each replicate. Within a block the draws themselves are digests.
Nothing is rescaled, no weight is approximate, and a result doesn't depend on how
rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallypoint.functions.beta import student_quantiles
from rallypoint.operators.series import numbered_by_digest
from rallypoint.sources.stages import stage

#: Units of a block at most.
BLOCK = 1024
#: Draws that one digest gives: its words' first 52 bits.
WORDS = 4


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def _text(x: object) -> str:
    return "null" if x is None or x != x else str(x)


def block_counts(total: int, blocks: int, block: int, replicates: int, *seed: object) -> np.ndarray:
    """How many of each replicate's `total` draws fall to a block; block b holds the units numbered from b * total / blocks on."""

    def units(a: int, b: int) -> int:
        return -(-b * total // blocks) - -(-a * total // blocks)

    drawn, low, high = np.full(replicates, total, np.int64), 0, blocks
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng(_seed(*seed, "node", low, high)).binomial(drawn, units(low, middle) / units(low, high))
        drawn, low, high = (left, low, middle) if block < middle else (drawn - left, middle, high)
    return drawn


def draw_counts(drawn: np.ndarray, units: int, first: int, *seed: object) -> np.ndarray:
    """How often each of a block's units is drawn, by replicate; drawn are the replicates' draws, the first numbered `first`."""
    texts, which, kept = "|".join(map(str, seed)), [], []
    for r, n in enumerate(drawn.tolist()):
        digests = b"".join(hashlib.sha256(f"{texts}|{first + r}|{i}".encode()).digest() for i in range(-(-n // WORDS)))
        words = np.frombuffer(digests, ">u8")[:n]
        kept.append(np.floor((words >> np.uint64(12)).astype(float) / 2**52 * units).astype(np.int64))
        which.append(np.full(n, r))
    at = np.concatenate([w * units + k for w, k in zip(which, kept, strict=True)]) if which else np.zeros(0, np.int64)
    return np.bincount(at, minlength=len(drawn) * units).reshape(len(drawn), units)


def redraw(units: DataFrame, key: str, stratum: str, unit: str, values: list[str], replicates: int, seed: int, block: int = BLOCK, each: int = 100) -> DataFrame:
    """key, replicate (from 1), drawn (units), sums (of each value over the drawn units): one row of units per key, stratum and unit.

    Null keys and strata are keys and strata; null values count as zero.
    """
    names = [F.col(c).alias(f"u_{n}") for n, c in (("key", key), ("stratum", stratum), ("unit", unit))]
    held = units.select(*names, F.array(*(F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values)).alias("v"))
    numbered = numbered_by_digest(held, ["u_key", "u_stratum"], F.sha2(F.coalesce(F.col("u_unit").cast("string"), F.lit("")), 256), "u_unit")
    blocks = F.ceil(F.col("total") / block)
    numbered = numbered.withColumn("blocks", blocks).withColumn("block", F.floor(F.col("nth") * F.col("blocks") / F.col("total")))
    wanted = numbered.select("u_key", "u_stratum", "block", "blocks", "total", "nth", "v")
    kind = units.schema[key].dataType.simpleString()

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        k, s, b, bs, total = (rows[c].iloc[0] for c in ("u_key", "u_stratum", "block", "blocks", "total"))
        own = (seed, _text(k), _text(s))
        drawn = block_counts(int(total), int(bs), int(b), replicates, *own)
        v, sums = np.stack(rows.v.tolist()), []
        for i in range(0, replicates, each):
            sums += (draw_counts(drawn[i : i + each], len(rows), i + 1, *own, int(b)) @ v).tolist()
        return pd.DataFrame({"u_key": [k] * replicates, "replicate": np.arange(1, replicates + 1), "drawn": drawn, "sums": sums})

    # The work of a block is its replicates, not its bytes, so blocks are dealt out by number.
    spark = units.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = wanted.repartition(tasks, "u_key", "u_stratum", "block").groupBy("u_key", "u_stratum", "block").applyInPandas(draw, f"u_key {kind}, replicate int, drawn bigint, sums array<double>")
    added = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(len(values))]
    out = parts.groupBy("u_key", "replicate").agg(F.sum("drawn").alias("drawn"), *added)
    return out.select(F.col("u_key").alias(key), "replicate", "drawn", F.array(*(f"s{i}" for i in range(len(values)))).alias("sums"))


def interval(redrawn: DataFrame, key: str, units: DataFrame, statistic: Column, estimate: Column) -> DataFrame:
    """key, estimate, low, high, share_below: percentiles of a statistic of redrawn rows; estimate aggregates units."""
    each = redrawn.select(F.col(key).alias("i_key"), statistic.alias("m"))
    q = each.groupBy("i_key").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((F.col("m") < 0).cast("double")).alias("share_below"))
    real = units.groupBy(F.col(key).alias("real_key")).agg(estimate.alias("estimate"))
    found = q.join(real, F.col("i_key").eqNullSafe(F.col("real_key")))
    return found.select(F.col("i_key").alias(key), "estimate", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "share_below")


def paired_bootstrap(differences: DataFrame, key: str, stratum: str, unit: str, value: str, replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """Interval of the mean paired difference, units redrawn within strata; one difference per key and unit."""
    units = stage(differences.where(F.col(value).isNotNull()).select(key, stratum, unit, value), "differences")
    mean = F.get("sums", F.lit(0)) / F.col("drawn")
    return interval(redraw(units, key, stratum, unit, [value], replicates, seed, block), key, units, mean, F.avg(value))


def cluster_bootstrap(losses: DataFrame, key: str, cluster: str, stratum: str, value: str, replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """Interval of the mean loss over rows, whole clusters redrawn within strata."""
    units = losses.groupBy(key, stratum, cluster).agg(F.sum(value).alias("loss_sum"), F.count(value).alias("loss_n"))
    units = stage(units, "clusters")
    mean = F.try_divide(F.get("sums", F.lit(0)), F.get("sums", F.lit(1)))
    found = interval(redraw(units, key, stratum, cluster, ["loss_sum", "loss_n"], replicates, seed, block), key, units, mean, F.try_divide(F.sum("loss_sum"), F.sum("loss_n")))
    return found.drop("share_below")


def metric_bootstrap(rows: DataFrame, key: str, stratum: str, unit: str, metrics: list[str], replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """key, metric, estimate, low, high, share_below: every metric's mean difference over the same redraws; one row per key and unit."""
    units = stage(rows.select(key, stratum, unit, *metrics), "metrics")
    redrawn = stage(redraw(units, key, stratum, unit, metrics, replicates, seed, block), "redrawn")
    out = None
    for i, m in enumerate(metrics):
        one = interval(redrawn, key, units, F.get("sums", F.lit(i)) / F.col("drawn"), F.avg(m)).withColumn("metric", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


# Power


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def rejection_rates(differences: DataFrame, key: str, unit: str, value: str, effects: dict[object, list[float]], sizes: int, replicates: int, seed: int, level: float) -> DataFrame:
    """key, effect (number in the key's list), n, power: share of replicates whose t-test of the first n of `sizes` nested draws rejects.

    Residuals are shifted by each effect; draw i of a replicate is the same unit
    whatever the sample's size, so running sums give every size at once.
    """
    return _rates(*_residuals(differences, key, unit, value), key, effects, sizes, replicates, seed, level)


def _residuals(differences: DataFrame, key: str, unit: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Staged: k, nth (in digest order) and x, a unit's difference less its key's mean; and of (key), units."""
    kept = differences.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(unit).alias("u"), F.col(value).cast("double").alias("d"))
    numbered = numbered_by_digest(kept, ["k"], F.sha2(F.col("u").cast("string"), 256), "u")
    means = stage(kept.groupBy(F.col("k").alias("of")).agg(F.avg("d").alias("mean"), F.count(F.lit(1)).alias("units")), "means")
    residuals = numbered.join(F.broadcast(means), F.col("k").eqNullSafe(F.col("of"))).select("k", "nth", (F.col("d") - F.col("mean")).alias("x"))
    return stage(residuals, "residuals"), means


def _rates(residuals: DataFrame, means: DataFrame, key: str, effects: dict[object, list[float]], sizes: int, replicates: int, seed: int, level: float) -> DataFrame:
    spark = residuals.sparkSession
    draws = spark.range(replicates * sizes).select((F.floor(F.col("id") / sizes) + 1).alias("r"), (F.col("id") % sizes + 1).alias("n"))
    every = means.select(F.col("of").alias("dk"), "units")
    asked = draws.withColumn("keys", every.agg(F.collect_list(F.struct("dk", "units"))).scalar()).select("r", "n", F.explode("keys").alias("q")).select("r", "n", "q.*")
    asked = asked.withColumn("at", F.floor(_uniform(F.lit(seed), F.col("dk"), F.col("r"), F.col("n")) * F.col("units")))
    met = asked.join(residuals, F.col("dk").eqNullSafe(F.col("k")) & (F.col("at") == F.col("nth")))
    upto = Window.partitionBy("k", "r").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    summed = met.select("k", "r", F.col("n").cast("double").alias("n"), F.sum("x").over(upto).alias("s"), F.sum(F.col("x") * F.col("x")).over(upto).alias("q")).where("n >= 2")
    critical = spark.createDataFrame([(float(n), x) for n, x in enumerate(student_quantiles(1 - level / 2, list(range(1, sizes))), 2)], "cn double, cut double")
    shifts = F.element_at(F.create_map(*(x for k, v in effects.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("k"))
    tested = summed.join(F.broadcast(critical), F.col("n") == F.col("cn")).select("k", "r", "n", "s", "q", "cut", F.posexplode(shifts).alias("effect", "shift"))
    spread = F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))
    error = F.sqrt(spread / F.col("n"))
    off = F.abs(F.col("s") / F.col("n") - F.col("shift"))
    rejects = F.when(error > 0, off / error >= F.col("cut")).otherwise(True)
    return tested.groupBy(F.col("k").alias(key), "effect", F.col("n").cast("int").alias("n")).agg((F.count_if(rejects) / F.lit(replicates)).alias("power"))


def required_sizes(
    differences: DataFrame, key: str, unit: str, value: str, shares: list[float], targets: list[float], replicates: int, seed: int, eligibility: float = 1.0, reserve: float = 0.1, level: float = 0.05, first: int = 32, most: int = 10_000_000,
) -> DataFrame:
    """key, effect (share of the differences' deviation), target, eligible, accepted, reserved: matches that a paired t-test needs.

    The size doubles from `first` until each target is reached, then bisection finds
    the least size; accepted is inflated by the share of eligible matches, reserved
    by the reserve. Null where the differences don't vary. Raises ValueError beyond `most`.
    """
    differences = stage(differences.select(key, unit, value), "differences")
    spread = differences.where(F.col(value).isNotNull()).groupBy(key).agg(F.stddev_samp(value).alias("sd")).where("sd > 0").collect()
    effects = {r[0]: [s * r.sd for s in shares] for r in spread}
    power: dict[tuple, float] = {}
    size, out = first, []
    held = _residuals(differences.where(F.col(key).isin(list(effects))), key, unit, value)
    wanted = {(k, e, t) for k in effects for e in range(len(shares)) for t in targets}
    reached: dict[tuple, int] = {}
    while len(reached) < len(wanted):
        if size > most:
            raise ValueError(f"a target needs more than {most} matches")
        rates = _rates(*held, key, effects, size, replicates, seed, level)
        power = {(r[0], r.effect, r.n): r.power for r in rates.collect()}
        for k, e, t in wanted - set(reached):
            if power[k, e, size] >= t:
                reached[k, e, t] = size
        size *= 2
    for (k, e, t), high in sorted(reached.items(), key=str):
        low = high // 2 + 1 if high > first else 2
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if power[k, e, middle] >= t else (middle + 1, high)
        accepted = math.ceil(low / eligibility)
        out.append((k, shares[e], t, low, accepted, math.ceil(accepted * (1 + reserve))))
    kind = differences.schema[key].dataType.simpleString()
    return differences.sparkSession.createDataFrame(out, f"{key} {kind}, effect double, target double, eligible int, accepted int, reserved int")
