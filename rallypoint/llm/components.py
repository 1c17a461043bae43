"""Connected components of a graph whose links are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallypoint.llm.common import hot_keys, join_unique, materialise


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"), "n")
    least = materialise(least, "least")
    return join_unique(both.where("v > u"), least, ("u", "at"), hot_keys(least, "at", "n", 2 * rows)).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of these."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialise(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("u", "at"), "least")
    met = join_unique(down, least, ("u", "at"), hot_keys(least, "at", "n", rows))
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("at", F.col("m").alias("v")))


def _state(links: DataFrame) -> tuple:
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(links: DataFrame, label: str = "links", max_rounds: int = 60) -> DataFrame:
    """node, root for every node of links (u, v): root is the least node reachable.

    Alternates large-star and small-star until the links stop changing; each
    round's links are written to the shared folder, so lineage stays short. A
    node with very many links costs a partial minimum, and its links meet that
    minimum where they lie, never in one task. Null ends and self-links are left
    out; repeated links count once; an empty table has no nodes.
    """
    links = materialise(links.where("u <> v").distinct(), label)
    before = _state(links)
    for _ in range(max_rounds):
        large = materialise(_large_star(links, before[0]).distinct(), label)
        links = materialise(_small_star(large, before[0]).distinct(), label)
        now = _state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
