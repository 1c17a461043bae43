from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallypoint.operators import boosting, diagnostics


def test_quantiles_of_ties_and_single_values(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.integers(0, 9, 101)] + [("b", 0.25), ("c", None)]
    got = {r.k: r for r in diagnostics.quantiles(spark.createDataFrame(rows, "k string, v double"), "v", "k").collect()}
    v = np.array([x for k, x in rows if k == "a"])
    assert [got["a"][f"q{round(100 * q):02d}"] for q in diagnostics.QUANTILES] == pytest.approx([np.quantile(v, q) for q in diagnostics.QUANTILES])
    assert set(got) == {"a", "b"} and got["b"].q05 == got["b"].q95 == 0.25


def test_band_edges_count_in_both(spark):
    rows = spark.createDataFrame([("m", "x", 1, 0.45), ("m", "x", 2, 0.4), ("m", "x", 3, 0.7), ("n", "x", 1, 0.5), ("n", "x", 2, 0.1), ("n", "x", 4, 0.2)], "m string, s string, i int, probability double")
    one = {(r.m, r.scope): r for r in diagnostics.prediction_summary(rows, "m", "s").collect()}
    assert (one["m", "overall"].band_45_55, one["m", "overall"].band_40_60, one["m", "x"].n) == (pytest.approx(1 / 3), pytest.approx(2 / 3), 3)
    two = {(r.scope, r.band): r for r in diagnostics.disagreement(rows, "m", "m", "n", "s", "i").collect()}
    assert two["overall", "all"].n == 2 and two["overall", "all"].signed == pytest.approx(-0.125) and two["x", "0.45-0.55"].n == 1 and two["x", "0.40-0.60"].n == 2


def test_ladder_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(m, f, i, float(rng.random()) if rng.random() > 0.1 else None) for i in range(200) for m in "abc" for f in ["fg"[i % 2]]]
    df = spark.createDataFrame(rows, "m string, f string, i int, p double")
    got = {(r.candidate, r.comparator, r.metric, r.f): r for r in diagnostics.ladder(df, "m", {"p": F.col("p"), "sq": F.col("p") * F.col("p")}, [("b", "a"), ("c", "a"), ("c", "b")], ["f"], "i").collect()}
    assert len(got) == 3 * 2 * 3
    p = {(m, i): x for m, _, i, x in rows}
    for x, y in (("b", "a"), ("c", "b")):
        d = [p[x, i] - p[y, i] for i in range(200) if p[x, i] is not None and p[y, i] is not None and i % 2]
        assert got[x, y, "p", "g"].n == len(d) and got[x, y, "p", "g"].difference == pytest.approx(np.mean(d)) and got[x, y, "p", "g"].better == pytest.approx(np.mean([v < 0 for v in d]))


def planted(spark, n=1500):
    """Two features whose product decides, a third that is noise."""
    rng = np.random.default_rng(3)
    b = rng.integers(0, 8, (n, 3))
    y = (((b[:, 0] >= 4) ^ (b[:, 1] >= 4)) ^ (rng.random(n) < 0.1)).astype(int)
    return spark.createDataFrame([(x.tolist(), int(v)) for x, v in zip(b, y)], "bins array<int>, y int"), y


def test_trees_find_a_planted_interaction(spark):
    df, y = planted(spark)
    one = boosting.boost(df.repartition(3), 3, trees=6, depth=2, rate=0.6, bins=8, every=3)
    scored = df.withColumn("p", one.probability("bins"))
    loss = scored.select(F.avg(-F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))))).first()[0]
    assert loss < 0.5 < 0.69
    assert one == boosting.boost(df.repartition(7), 3, trees=6, depth=2, rate=0.6, bins=8, every=3)


def test_no_row_sees_its_own_target(spark):
    rows = [(i, "ab"[i % 2], i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame([(i, c, int(t)) for i, c, t in rows], "i int, c string, y int")
    got = {r.i: r for r in boosting.ordered_statistics(df.repartition(5), "i", ["c"], "y", 0.5, 9).collect()}
    flipped = {r.i: r for r in boosting.ordered_statistics(df.withColumn("y", F.when(F.col("i") == 7, 1 - F.col("y")).otherwise(F.col("y"))), "i", ["c"], "y", 0.5, 9).collect()}
    assert got[7].value == flipped[7].value
    assert sorted(r.earlier_n for r in got.values()) == sorted([*range(150)] * 2)
    later = [i for i, r in got.items() if r.earlier_n > got[7].earlier_n and i % 2]
    assert all(got[i].earlier_sum != flipped[i].earlier_sum for i in later) and all(got[i].value == flipped[i].value for i in got if i not in later)
