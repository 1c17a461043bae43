"""Golden values and edges of the row formulas."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rallypoint.functions import beta, formulas, identity, patches


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(v, kind="int"):
    return F.lit(v).cast(kind)


def test_kda_and_ratio_keep_nulls(spark):
    assert one(spark, formulas.kda(lit(3), lit(0), lit(4))) == 7
    assert one(spark, formulas.kda(lit(3), lit(None), lit(4))) is None
    assert one(spark, formulas.ratio(lit(1), lit(0))) is None
    assert one(spark, formulas.ratio(lit(1), lit(None))) is None
    assert one(spark, formulas.duration_minutes(lit(-60))) is None
    assert one(spark, formulas.legacy_kda(lit(None), lit(0), lit(2))) == 2
    assert one(spark, formulas.legacy_kill_participation(lit(1), lit(1), lit(0))) == 0


def test_complete_sum(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (2, 5)], "k int, v int")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(formulas.complete_sum(F.col("v")).alias("s")).collect()}
    assert got == {1: None, 2: 5}


@pytest.mark.parametrize(("raw", "want"), [(" mid ", "MIDDLE"), ("Bot", "BOTTOM"), ("support", "UTILITY"), ("", None), ("odd", "ODD"), (None, None)])
def test_positions(spark, raw, want):
    assert one(spark, formulas.normalize_position(lit(raw, "string"))) == want


@pytest.mark.parametrize(
    ("team", "own", "want"),
    [("TOP", "TOP", ("TOP", "team_position", False)), ("TOP", "JUNGLE", ("TOP", "team_position", True)), (None, "TOP", ("TOP", "individual_position_fallback", False)), ("X", None, (None, "unresolved", False))],
)
def test_position_policy(spark, team, own, want):
    assert tuple(one(spark, formulas.position_policy(lit(team, "string"), lit(own, "string")))) == want


@pytest.mark.parametrize(("n", "want"), [(0, "0_unseen"), (1, "1"), (4, "2_4"), (5, "5_9"), (19, "10_19"), (20, "20_plus")])
def test_evidence(spark, n, want):
    assert one(spark, formulas.evidence_bucket(lit(n))) == want


@pytest.mark.parametrize(
    ("version", "created", "want"),
    [("16.14.1", "2026-02-01", ("26.14", "resolved")), ("16", "2026-02-01", (None, "malformed")), ("v16.14", "2026-02-01", (None, "malformed")), (None, "2026-02-01", (None, "malformed")),
     ("16.14", "2025-02-01", (None, "unsupported_year")), ("15.14", "2026-02-01", (None, "unsupported_api_patch")), ("16.x.1", "2026-02-01", (None, "malformed"))],
)
def test_patches(spark, version, created, want):
    assert tuple(one(spark, patches.resolve(lit(version, "string"), lit(created, "timestamp")))) == want


def test_patch_order_and_windows(spark):
    assert one(spark, patches.order(lit("26.9", "string")) < patches.order(lit("26.10", "string")))
    assert one(spark, patches.window(lit("26.3", "string"), 6)) == ["26.3", "26.2", "26.1"]
    assert one(spark, patches.age(lit("26.12", "string"), lit("26.14", "string"))) == 2
    assert one(spark, patches.age(lit("25.12", "string"), lit("26.14", "string"))) is None


def test_pseudonym(spark):
    import hashlib

    want = "player_" + hashlib.sha256(b"ns\x00abc").hexdigest()[:32]
    assert one(spark, identity.pseudonym(lit("abc", "string"), "ns")) == want
    assert one(spark, identity.pseudonym(lit("  ", "string"), "ns")) is None


def test_beta_survival(spark):
    cases = [(1.0, 1.0, 0.25, 0.75), (2.0, 2.0, 0.5, 0.5), (3.0, 2.0, 0.0, 1.0), (3.0, 2.0, 1.0, 0.0), (0.5, 3.5, -1.0, 1.0)]
    df = spark.createDataFrame(cases, "a double, b double, t double, want double")
    for r in df.withColumn("got", beta.beta_survival(F.col("a"), F.col("b"), F.col("t"))).collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-12)
    assert beta.student_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)


def test_sigmoid_is_stable(spark):
    assert one(spark, formulas.sigmoid(lit(-800.0, "double"))) == 0.0
    assert one(spark, formulas.sigmoid(lit(800.0, "double"))) == 1.0
