"""Redraws against plain loops, and against the law that they must follow."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from rallypoint.functions.beta import student_quantiles
from rallypoint.operators import resampling


def test_block_counts_add_up_in_every_replicate():
    for total, blocks in ((1, 1), (10, 3), (1000, 7), (5000, 64)):
        drawn = np.stack([resampling.block_counts(total, blocks, b, 300, 1, "k", "s") for b in range(blocks)])
        assert (drawn.sum(0) == total).all() and (drawn >= 0).all()
    units = np.array([-(-(b + 1) * 5000 // 64) - -(-b * 5000 // 64) for b in range(64)])
    assert units.sum() == 5000
    spread = np.sqrt(units * (1 - units / 5000) / 300)
    assert (np.abs(drawn.mean(1) - units) < 5 * spread).all()
    want = units * (1 - units / 5000)
    assert abs(drawn.var(1).mean() / want.mean() - 1) < 0.1


def test_draws_are_uniform_and_as_many_as_wanted():
    drawn = np.array([0, 1, 7, 400, 5000])
    counts = resampling.draw_counts(drawn, 10, 1, "x")
    assert (counts.sum(1) == drawn).all() and np.abs(counts[4] - 500).max() < 110
    word = int.from_bytes(hashlib.sha256(b"x|2|0").digest()[:8], "big") >> 12
    assert counts[1].argmax() == math.floor(word / 2**52 * 10)


def sample(spark, n=300):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([("a", f"s{i % 2}", f"m{i}", float(v)) for i, v in enumerate(rng.normal(0.5, 1, n))], "k string, s string, m string, d double")


@pytest.mark.parametrize("block", [16, 1024])
def test_every_replicate_draws_the_strata_whole(spark, block):
    rows = sample(spark)
    got = resampling.redraw(rows, "k", "s", "m", ["d"], 50, 9, block).collect()
    assert len(got) == 50 and {r.drawn for r in got} == {300}
    again = {r.replicate: r.sums[0] for r in resampling.redraw(rows.repartition(7), "k", "s", "m", ["d"], 50, 9, block).collect()}
    assert all(r.sums[0] == pytest.approx(again[r.replicate]) for r in got)


def test_redraws_equal_a_plain_loop(spark):
    rows = [("a", f"s{i % 2}", f"m{i}", float(i)) for i in range(40)] + [("b", None, "m1", 2.0)]
    df = spark.createDataFrame(rows, "k string, s string, m string, d double")
    got = {(r.k, r.replicate): r.sums[0] for r in resampling.redraw(df, "k", "s", "m", ["d"], 5, 9).collect()}
    for key in "ab":
        for rep in range(1, 6):
            whole = 0.0
            for s in {r[1] for r in rows if r[0] == key}:
                own = sorted((hashlib.sha256(r[2].encode()).hexdigest(), r[3]) for r in rows if r[0] == key and r[1] == s)
                for i in range(len(own)):
                    h = hashlib.sha256(f"9|{key}|{'null' if s is None else s}|0|{rep}|{i // 4}".encode()).hexdigest()
                    whole += own[math.floor(int(h[16 * (i % 4) : 16 * (i % 4) + 13], 16) / 2**52 * len(own))][1]
            assert got[key, rep] == pytest.approx(whole)


def test_intervals_of_both_bootstraps(spark):
    rows = sample(spark)
    one = resampling.paired_bootstrap(rows, "k", "s", "m", "d", 1000, 1).first()
    two = resampling.paired_bootstrap(rows.repartition(5), "k", "s", "m", "d", 1000, 1, block=16).first()
    values = np.array([r.d for r in rows.collect()])
    half = 1.96 * values.std() / math.sqrt(300)
    for got in (one, two):
        assert got.estimate == pytest.approx(values.mean()) and abs(got.low - values.mean() + half) < 0.03 and abs(got.high - values.mean() - half) < 0.03
    c = resampling.cluster_bootstrap(rows, "k", "m", "s", "d", 300, 2).first()
    assert c["low"] < c["estimate"] < c["high"] and abs(c["low"] - one["low"]) < 0.06
    m = {r.metric: r for r in resampling.metric_bootstrap(rows.withColumn("e", -rows.d), "k", "s", "m", ["d", "e"], 200, 3).collect()}
    assert m["d"].low == pytest.approx(-m["e"].high) and m["d"].share_below == 0 and m["e"].share_below == 1


def test_power_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(0.1, 1, 120)
    df = spark.createDataFrame([("a", f"m{i}", float(x)) for i, x in enumerate(d)] + [("flat", "m1", 1.0), ("flat", "m2", 1.0)], "k string, m string, d double")
    got = {(r.effect, r.target): r for r in resampling.required_sizes(df, "k", "m", "d", [0.5, 0.8], [0.8], 60, 4, eligibility=0.9).collect()}
    own = [x for _, x in sorted((hashlib.sha256(f"m{i}".encode()).hexdigest(), x) for i, x in enumerate(d))]
    x, sd = np.array(own) - d.mean(), d.std(ddof=1)

    cuts = dict(enumerate(student_quantiles(0.975, list(range(1, 256))), 2))

    def power(effect, n):
        hits = 0
        for r in range(1, 61):
            at = [math.floor(int(hashlib.sha256(f"4|a|{r}|{i}".encode()).hexdigest()[:13], 16) / 2**52 * 120) for i in range(1, n + 1)]
            v = x[at]
            hits += abs(v.mean() - effect * sd) / (v.std(ddof=1) / math.sqrt(n)) >= cuts[n]
        return hits / 60

    for effect in (0.5, 0.8):
        low, high = 2, 32
        while power(effect, high) < 0.8:
            low, high = high + 1, high * 2
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if power(effect, middle) >= 0.8 else (middle + 1, high)
        r = got[effect, 0.8]
        assert (r.k, r.eligible) == ("a", low) and r.accepted == math.ceil(low / 0.9) and r.reserved == math.ceil(r.accepted * 1.1)
    assert abs(got[0.5, 0.8].eligible - 34) < 10 and len(got) == 2


def test_power_beyond_the_bound_is_an_error(spark):
    with pytest.raises(ValueError):
        resampling.required_sizes(sample(spark, 40), "k", "m", "d", [0.001], [0.9], 20, 4, most=32)
