"""Ordered operators: as-of and interval matching, changes, strict history, blocks, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallypoint.functions.clock import micros

DECAY = 0.8
#: Rows of history behind which an exponential mean's weights vanish in a double.
REACH = 200
PRIOR_MEAN, PRIOR_GAMES = 0.5, 10.0
DAY = 86_400_000_000


def asof_forward(requests: DataFrame, frames: DataFrame, key: str, at: str, tolerance: int, *values: str) -> DataFrame:
    """Each request with the earliest frame at or after it, at most `tolerance` later.

    Both sides are laid out in one order per key and the next frame is carried
    back to the request, so the cost is a sort, never a product of both sides.
    Frames of equal time go by their values.
    """
    extra = [c for c in requests.columns if c not in (key, at)]
    frame = F.struct(F.col(at).alias("frame_at"), *values)
    a = requests.select(key, at, F.lit(0).alias("is_frame"), F.lit(None).cast(frames.select(frame.alias("f")).schema["f"].dataType).alias("frame"), F.struct(*extra).alias("request"))
    b = frames.select(key, at, F.lit(1).alias("is_frame"), frame.alias("frame"), F.lit(None).cast(a.schema["request"].dataType).alias("request"))
    later = W.partitionBy(key).orderBy(F.col(at).desc(), F.col("is_frame").desc(), F.col("frame").desc()).rowsBetween(W.unboundedPreceding, 0)
    found = a.union(b).withColumn("next", F.last("frame", ignorenulls=True).over(later)).where("is_frame = 0")
    near = F.when(F.col("next.frame_at") - F.col(at) <= tolerance, F.col("next"))
    return found.withColumn("next", near).select(key, at, "request.*", "next.*")


def within_before(events: DataFrame, key: str, at: str, first: Column, second: Column, span: int) -> DataFrame:
    """The rows where `second` holds, with whether a row where `first` holds lies at most `span` before, inclusive."""
    before = W.partitionBy(key).orderBy(at).rangeBetween(-span, 0)
    return events.withColumn("preceded", F.coalesce(F.max(F.when(first, F.col(at))).over(before).isNotNull(), F.lit(False))).where(second)


def first_label(events: DataFrame, key: str, at: str, side: str, cutoff: int) -> DataFrame:
    """key, first_at, first_side, label: which side's event came first, 'neither' if after the cutoff."""
    first = events.groupBy(key).agg(F.min(F.struct(at, side)).alias("f"))
    label = F.when(F.col(f"f.{at}") > cutoff, "neither").otherwise(F.concat(F.col(f"f.{side}").cast("string"), F.lit("_first")))
    return first.select(key, F.col(f"f.{at}").alias("first_at"), F.col(f"f.{side}").alias("first_side"), label.alias("label"))


def changes(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Adds change: the value less the one before in a dense grid, null if either is null."""
    return rows.withColumn("change", F.col(value) - F.lag(value).over(W.partitionBy(key).orderBy(at)))


def strict_history(rows: DataFrame, player: str, champion: str, at: str, win: Column, value: str, recent_days: int = 30) -> DataFrame:
    """Adds what a player's strictly earlier rows say; rows of equal time never see each other."""
    rows = rows.withColumn("us", micros(rows, at)).withColumn("won", win.cast("int"))
    every = W.partitionBy(player).orderBy("us").rangeBetween(W.unboundedPreceding, -1)
    own = W.partitionBy(player, champion).orderBy("us").rangeBetween(W.unboundedPreceding, -1)
    recent = W.partitionBy(player, champion).orderBy("us").rangeBetween(-recent_days * DAY, -1)
    n = F.count(F.lit(1)).over(every)
    rows = rows.withColumn("prior_games", n).withColumn("prior_wins", F.coalesce(F.sum("won").over(every), F.lit(0)))
    rows = rows.withColumn("champion_games", F.count(F.lit(1)).over(own)).withColumn("recent_champion_games", F.count(F.lit(1)).over(recent))
    rows = rows.withColumn("days_since", (F.col("us") - F.max("us").over(own)) / DAY)
    rows = rows.withColumn("mean_value", F.avg(value).over(every)).withColumn("champion_mean_value", F.avg(value).over(own))
    rate = (F.col("prior_wins") + PRIOR_MEAN * PRIOR_GAMES) / (F.col("prior_games") + PRIOR_GAMES)
    return rows.select(
        "*", (F.col("champion_mean_value") - F.col("mean_value")).alias("relative_value"), rate.alias("shrunk_rate"),
        F.sqrt(rate * (1 - rate) / (F.col("prior_games") + PRIOR_GAMES + 1)).alias("shrunk_rate_error"),
    ).drop("us", "won")


def exponential_history(rows: DataFrame, keys: list[str], at: str, ties: list[str], value: str, decay: float = DECAY, reach: int = REACH) -> DataFrame:
    """Adds ewm: first value, then decay times the mean so far plus the rest times the value, over strictly earlier rows.

    A row's own mean folds its last `reach` values, whose earlier ones weigh less
    than a double can tell; so lists stay bounded for any key. The mean known
    before a time is that of the last row of an earlier time. Null values are
    passed over.
    """
    rows = rows.withColumn("us", micros(rows, at))
    order = W.partitionBy(*keys).orderBy("us", *ties)
    filled = F.count(value).over(order)
    upto = F.collect_list(value).over(order.rowsBetween(-reach, 0))
    fold = F.aggregate(F.slice(upto, F.lit(2), F.lit(reach + 1)), F.get(upto, F.lit(0)).cast("double"), lambda m, x: decay * m + (1 - decay) * x)
    rows = rows.withColumn("so_far", F.when(filled > 0, fold))
    last = F.max_by("so_far", F.struct("us", *ties)).over(W.partitionBy(*keys).orderBy("us").rangeBetween(W.unboundedPreceding, -1))
    return rows.withColumn("ewm", last).drop("us", "so_far")


def ordered_index(rows: DataFrame, at: str, *ties: str, unit: str = "hour") -> DataFrame:
    """Adds nth (from 0) and total over all rows in the order of `at` and ties.

    Rows are numbered within time units, and the units' counts, a small table,
    give each unit's offset; no task sees all rows.
    """
    rows = rows.withColumn("unit", F.date_trunc(unit, at))
    counts = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(F.col("unit").alias("of"), (F.sum("n").over(W.orderBy("unit")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("total"))
    nth = F.row_number().over(W.partitionBy("unit").orderBy(at, *ties)) - 1
    return rows.withColumn("within", nth).join(offsets, F.col("unit").eqNullSafe(F.col("of"))).withColumn("nth", F.col("within") + F.col("before")).drop("unit", "of", "within", "before")


def numbered_by_digest(rows: DataFrame, stratum: list[str], digest: Column, *ties: str) -> DataFrame:
    """Adds nth (from 0) in the order of a hex digest within each stratum, and the stratum's total.

    Ranks within 4096 ranges of the digest, plus the ranges before: no task sees a stratum whole.
    """
    rows = rows.withColumn("digest", digest).withColumn("part", F.substring("digest", 1, 3))
    counts = rows.groupBy(*stratum, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy(*stratum).orderBy("part")) - F.col("n")
    offsets = counts.select(*(F.col(s).alias(f"of_{s}") for s in stratum), F.col("part").alias("of_part"), before.alias("before"), F.sum("n").over(W.partitionBy(*stratum)).alias("total"))
    same = reduce(lambda a, b: a & b, (F.col(s).eqNullSafe(F.col(f"of_{s}")) for s in stratum), F.col("part") == F.col("of_part"))
    within = F.row_number().over(W.partitionBy(*stratum, "part").orderBy("digest", *ties)) - 1
    out = rows.withColumn("within", within).join(offsets, same).withColumn("nth", F.col("within") + F.col("before"))
    return out.drop("digest", "part", "of_part", "before", "within", *(f"of_{s}" for s in stratum))


def blocks(rows: DataFrame, at: str, *ties: str, n: int = 5) -> DataFrame:
    """Adds block: block b holds the rows numbered [b * total // n, (b + 1) * total // n)."""
    return ordered_index(rows, at, *ties).withColumn("block", F.floor((n * (F.col("nth") + 1) - 1) / F.col("total")))


def runs(rows: DataFrame, key: str, at: str, ties: list[str], flag: Column) -> DataFrame:
    """Adds run: how many rows in a row, up to this one, carry the flag."""
    order = W.partitionBy(key).orderBy(at, *ties)
    rows = rows.withColumn("flag", F.coalesce(flag, F.lit(False))).withColumn("island", F.sum(F.when(F.col("flag"), 0).otherwise(1)).over(order))
    nth = F.row_number().over(W.partitionBy(key, "island").orderBy(F.col("flag").asc(), at, *ties))
    first = F.min(F.col("flag").cast("int")).over(W.partitionBy(key, "island"))
    return rows.withColumn("run", F.when(F.col("flag"), nth - F.when(first == 0, 1).otherwise(0)).otherwise(0)).drop("flag", "island")
