"""Hand-built cases: decay, opponents, folds, series, records, models."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from rallypoint.operators import aggregates, audits, drafts, models, opponents, policies, records, series
from rallypoint.sources.lens import Tables


def pair_rows(spark, *rows):
    data = [(p, w, 420, "eun1", None, None, 1, "TOP", 11, "TOP") for p, w in rows]
    return spark.createDataFrame(data, "public_patch string, win boolean, queue_id int, platform string, region string, rank_bracket string, focal int, focal_position string, other int, other_position string")


def test_decay_over_patches(spark):
    rows = pair_rows(spark, ("26.14", True), ("26.12", False))
    r = aggregates.pair_statistics(rows, "26.14").first()
    assert (r["games"], r["wins"], r["sum_weights"]) == (2, 1, 1.64)
    assert r["effective_sample_size"] == pytest.approx(1.64**2 / (1 + 0.64**2), abs=1e-9)
    w = {x["oldest_age"]: (x["games"], x["observed_patches"]) for x in aggregates.cumulative_windows(rows, "26.14").collect()}
    assert w[0] == (1, 1) and w[1] == (1, 1) and w[2] == (2, 2) and w[5] == (2, 2)


def test_newer_input_is_refused(spark):
    with pytest.raises(Exception, match="newer than the target"):
        aggregates.pair_statistics(pair_rows(spark, ("26.15", True)), "26.14").collect()


def match(spark, edit=None):
    roles = ["TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY"]
    people = [{"match_id": "m", "participant_id": i + 1, "team_id": 100 if i < 5 else 200, "champion_id": i + 1, "player_key": f"p{i}", "team_position": roles[i % 5], "individual_position": roles[i % 5], "kills": 1, "deaths": 1, "assists": 2, "gold": 10, "damage": 5, "lane_cs": 3, "jungle_cs": 1, "win": i < 5} for i in range(10)]
    for k, v in (edit or {}).items():
        people[k].update(v)
    p = spark.createDataFrame([tuple(x.values()) for x in people], "match_id string, participant_id int, team_id int, champion_id int, player_key string, team_position string, individual_position string, kills int, deaths int, assists int, gold bigint, damage bigint, lane_cs int, jungle_cs int, win boolean")
    m = spark.createDataFrame([("m", datetime.datetime(2026, 1, 1), "eun1", 420, 1800, "26.14")], "match_id string, game_creation timestamp, platform string, queue_id int, duration_seconds int, public_patch string")
    t = spark.createDataFrame([("m", 100, True), ("m", 200, False)], "match_id string, team_id int, win boolean")
    return {r["participant_id"]: r for r in opponents.observations(Tables(m, p, t)).collect()}


def test_opponents_are_reciprocal(spark):
    rows = match(spark)
    assert all(rows[i]["opponent_participant_id"] == (i + 5 if i <= 5 else i - 5) for i in rows)
    assert rows[1]["opponent_champion_id"] == 6 and rows[1]["matchup_reasons"] == []


def test_opponent_statuses(spark):
    rows = match(spark, {0: {"team_position": None}, 1: {"individual_position": "TOP"}, 7: {"team_position": "BOTTOM", "individual_position": "BOTTOM"}})
    assert rows[1]["resolution"] == "participant_position_ineligible" and rows[1]["role_reasons"] == ["position_fallback"]
    assert rows[2]["role_reasons"] == ["position_disagreement"]
    assert rows[6]["resolution"] == "missing_unique_opponent"
    assert rows[4]["resolution"] == "ambiguous_opponent_position"
    assert rows[9]["resolution"] == "nonreciprocal_position_group"
    assert rows[3]["matchup_reasons"] == ["lane_opponent_unresolved"]


def test_metrics_and_edges(spark):
    r = spark.createDataFrame([("a", 1, 0.8), ("a", 0, 0.4), ("a", 1, None)], "policy string, outcome int, probability double")
    m = policies.metrics(r, "policy").first()
    assert m["brier_score"] == pytest.approx(0.1) and m["accuracy"] == 1.0 and m["coverage"] == pytest.approx(2 / 3)
    assert m["log_loss"] == pytest.approx(-(np.log(0.8) + np.log(0.6)) / 2)
    sure = spark.createDataFrame([("a", 1, 0.0), ("a", 1, 1.0)], "policy string, outcome int, probability double")
    assert policies.metrics(sure, "policy").first()["log_loss"] is None
    bins = {x["bin"]: x["n"] for x in policies.calibration(sure, "policy").collect()}
    assert len(bins) == 10 and bins[0] == 1 and bins[9] == 1


def test_asof_takes_the_next_frame_within_tolerance(spark):
    frames = spark.createDataFrame([("a", t, t) for t in (299_999, 300_010, 300_020)] + [("b", 360_001, 1)], "k string, t bigint, v bigint")
    asked = spark.createDataFrame([("a", 300_000, 5), ("b", 300_000, 5), ("c", 1, 5)], "k string, t bigint, minute int")
    got = {r["k"]: r["v"] for r in series.asof_forward(asked, frames, "k", "t", 60_000, "v").collect()}
    assert got == {"a": 300_010, "b": None, "c": None}


def test_strict_history_excludes_equal_times(spark):
    day = lambda d: datetime.datetime(2026, 1, d)
    rows = spark.createDataFrame([(1, "p", 7, day(1), True, 10.0), (2, "p", 7, day(2), True, 20.0), (3, "p", 7, day(2), False, 40.0), (4, "p", 8, day(3), True, None)], "id int, p string, c int, t timestamp, w boolean, v double")
    got = {r["id"]: r for r in series.strict_history(rows, "p", "c", "t", F.col("w"), "v").collect()}
    assert [got[i]["prior_games"] for i in (1, 2, 3, 4)] == [0, 1, 1, 3]
    assert got[1]["shrunk_rate"] == 0.5 and got[2]["shrunk_rate"] == pytest.approx(6 / 11)
    assert got[4]["champion_games"] == 0 and got[4]["days_since"] is None
    ewm = {r["id"]: r["ewm"] for r in series.exponential_history(rows, ["p"], "t", ["id"], "v").collect()}
    assert ewm[1] is None and ewm[2] == ewm[3] == 10.0 and ewm[4] == pytest.approx(0.8 * (0.8 * 10 + 0.2 * 20) + 0.2 * 40)


def test_runs_and_blocks(spark):
    t0 = datetime.datetime(2026, 1, 1)
    rows = spark.createDataFrame([(i, "p", t0 + datetime.timedelta(hours=i), f) for i, f in enumerate([True, True, False, True, None, True, True, True])], "id int, p string, t timestamp, f boolean")
    got = {r["id"]: r["run"] for r in series.runs(rows, "p", "t", ["id"], F.col("f")).collect()}
    assert [got[i] for i in range(8)] == [1, 2, 0, 1, 0, 1, 2, 3]
    blocks = [r["block"] for r in series.blocks(rows, "t", "id").orderBy("nth").collect()]
    assert blocks == [0, 1, 1, 2, 3, 3, 4, 4]


def draft(spark, *rows):
    return spark.createDataFrame([(f"m{i}", "eun1", "26.14", y, *c) for i, (y, c) in enumerate(rows)], "match_id string, platform string, public_patch string, outcome int, " + ", ".join(f"{s} int" for s in drafts.SLOTS))


def test_draft_features_are_antisymmetric(spark):
    d = draft(spark, (1, (1, 2, 3, 4, 5, 6, 2, 8, 9, 10)))
    known = drafts.vocabulary(d)
    a = {r["index"]: r["value"] for r in drafts.vectors(d, known).collect()}
    b = {r["index"]: r["value"] for r in drafts.vectors(drafts.swap(d), known).collect()}
    assert a and a == {k: -v for k, v in b.items()}
    assert drafts.swap(d).first()["outcome"] == 0
    assert drafts.symmetric(d).agg(F.sum("weight")).first()[0] == 1.0
    unseen = {r["kind"]: r["unseen_slots"] for r in drafts.unseen_rates(d, known).collect()}
    assert unseen == {"composition": 0, "lane_matchup": 1}
    assert {r["kind"]: r["unseen_slots"] for r in drafts.unseen_rates(d, known, False).collect()} == {"composition": 0, "lane_matchup": 0}


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 2, (200, 4)).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(-x @ [1, -1, 0.5, 0]))).astype(float)
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"])
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / 200 + 0.1 * np.eye(4), x.T @ (p - y) / 200 + 0.1 * w)
    assert np.allclose(models.fit_logistic(df, 0.1), w, atol=1e-5)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(4)
    x, t = rng.normal(size=(120, 3)), None
    t = x @ [1.0, -2.0, 0.5] + rng.normal(size=120)
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, t)], ["label", "features"])
    xc, tc = x - x.mean(0), t - t.mean()
    want = np.linalg.solve(xc.T @ xc + 10 * np.eye(3), xc.T @ tc)
    assert np.allclose(models.fit_ridge(df, 10.0)[0], want, atol=1e-4)


def test_few_rows_take_the_overall_mean(spark):
    rows = spark.createDataFrame([("a", float(i), 1.0 + i % 2) for i in range(10)] + [("b", 100.0, 3.0), ("c", 7.0, 1.0)], "k string, v double, w double")
    got = {r["k"]: (r["n"], r["mean"]) for r in audits.means_or_overall(rows, "k", "v", "w", 10).collect()}
    own, weight = sum(i * (1 + i % 2) for i in range(10)), sum(1 + i % 2 for i in range(10))
    assert got["a"] == (10, pytest.approx(own / weight)) and got["b"] == (1, pytest.approx((own + 307) / (weight + 4)))
    assert got["c"] == (1, got["b"][1])


def test_calibration_line_matches_newton_on_all_rows(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k, a, b in (("x", 0.3, 0.7), ("y", -0.2, 1.4)):
        p = rng.uniform(0.05, 0.95, 400).round(2)
        z = np.log(p / (1 - p))
        y = (rng.uniform(size=400) < 1 / (1 + np.exp(-a - b * z))).astype(int)
        rows += [(k, float(i), int(j)) for i, j in zip(p, y, strict=True)]
        d, w = np.column_stack([np.ones(400), z]), np.zeros(2)
        for _ in range(30):
            q = 1 / (1 + np.exp(-d @ w))
            w = w + np.linalg.solve((d * (q * (1 - q))[:, None]).T @ d, d.T @ (y - q))
        want[k] = w
    rows += [("flat", 0.5, 1), ("flat", 0.5, 1), ("flat", 0.5, 1), ("flat", 0.5, 0), ("sure", 0.5, 1), ("flat", None, 1)]
    df = models.calibration_line(spark.createDataFrame(rows, "k string, probability double, outcome int"), "k")
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    got = {r["k"]: (r["intercept"], r["slope"]) for r in df.collect()}
    assert all(np.allclose(got[k], want[k], atol=1e-8) for k in want)
    assert got["flat"] == (pytest.approx(np.log(3)), None) and got["sure"] == (None, None)


def test_overall_mean_needs_no_window(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0)], "k string, v double, w double")
    assert "Window" not in audits.means_or_overall(rows, "k", "v", "w")._jdf.queryExecution().toString()


def test_sample_size():
    assert 30 <= models.required_sample_size(0.5, 1.0) <= 36
    assert models.required_sample_size(0.0, 1.0) is None


def test_records(spark):
    seen = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], "k string, t int, s string")
    assert {(r["k"], r["s"]) for r in records.latest_status(seen, "k", "t").collect()} == {("a", "y"), ("b", "x")}
    people = spark.createDataFrame([("a",), ("b",), ("c",)], "p string")
    ranks = spark.createDataFrame([("a", "I"), ("a", "I"), ("b", "I"), ("b", "II")], "p string, rank string")
    assert {r["p"]: (r["rank"], r["rank_status"]) for r in records.attach_rank(people, ranks, "p", "rank").collect()} == {"a": ("I", "observed"), "b": (None, "ambiguous"), "c": (None, "not_collected")}
    strata = spark.createDataFrame([(x,) for x in "abc"], "s string")
    assert [r["planned"] for r in records.even_allocation(strata, "s", 8).orderBy("s").collect()] == [3, 3, 2]


def test_configuration_ties(spark):
    r = spark.createDataFrame([(2, 0.1, 0.5), (2, 1.0, 0.5 + 1e-13), (1, 1.0, 0.5), (1, 9.0, 0.6)], "dimension int, l2 double, loss double")
    best = models.best_configuration(r).first()
    assert (best["dimension"], best["l2"]) == (1, 1.0)


def test_distribution_of_nulls(spark):
    r = audits.distribution(spark.createDataFrame([("a", None)], "k string, v double"), "v", "k").first()
    assert (r["n"], r["missing"], r["median"]) == (0, 1, None)


def test_catalog_statistics_of_odd_entries(spark):
    rows = [("processed", None, None), ("processed", "x", "legacy_unresolved"), ("processed", None, "resolved"), ("rejected", "a", None), ("rejected", None, None), (None, "a", None)]
    got = {(r.kind, r.name): r.n for r in records.catalog_statistics(spark.createDataFrame(rows, "s string, f string, p string"), "s", "f", "p").collect()}
    assert got == {("total", None): 6, ("status", "processed"): 3, ("status", "rejected"): 2, ("status", None): 1, ("failure", "a"): 1, ("failure", None): 1, ("needs_migration", None): 2}
