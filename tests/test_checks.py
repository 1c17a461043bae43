from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rallypoint.functions import formulas, patches
from rallypoint.operators import aggregates, checks, lineage, timelines
from rallypoint.sources.lens import KINDS, places


def test_grades_of_nothing_are_nothing(spark):
    rows = spark.createDataFrame([(None, None), (0, 0.95), (60, 0.1), (20, 0.9)], "n int, p double")
    got = rows.select(formulas.evidence_bucket(F.col("n")), formulas.support_tier(F.col("n")), formulas.evidence_tier(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(None, None, None), ("0_unseen", "0-4", "strong"), ("20_plus", "50+", "insufficient"), ("20_plus", "20-49", "moderate")]


def test_patches_of_another_major_raise(spark):
    rows = spark.createDataFrame([("26.13",), (None,)], "public_patch string")
    assert [r.age for r in aggregates.with_age(rows, "26.15").collect()] == [2]
    for bad in ("25.24", "27.1", "26.16"):
        with pytest.raises(Exception, match="across majors|newer than"):
            aggregates.with_age(rows.union(spark.createDataFrame([(bad,)], "p string")), "26.15").collect()


def test_long_build_numbers_and_years_at_new_year(spark):
    rows = spark.createDataFrame([("99999999999.1", 1_780_000_000), ("16.99999999999", 1_780_000_000), ("16.3.1", 1_767_225_600), ("16.3.1", 1_767_225_599)], "v string, s bigint")
    got = rows.select(patches.resolve(F.col("v"), F.timestamp_seconds("s")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [(None, "unsupported_api_patch"), (None, "unsupported_api_patch"), ("26.3", "resolved"), (None, "unsupported_year")]


def test_places_number_each_kind_in_time(spark):
    rows = [(i, KINDS[i % 2], f"2024-01-0{1 + i % 3} 0{i % 5}:00:00", 1) for i in range(60)] + [(99, KINDS[0], "2024-01-01 00:00:00", 1)]
    df = spark.createDataFrame(rows, "event_id bigint, event_type string, ts string, user_id bigint").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {}
    for kind in KINDS[:2]:
        for n, r in enumerate(sorted((x for x in rows if x[1] == kind), key=lambda x: (x[2], x[0]))):
            want[r[0]] = n
    assert {r.event_id: r.place for r in places(df).collect()} == want


def test_rows_that_must_match_do(spark):
    parents = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "i int, digest string, v int")
    rows = spark.createDataFrame([(2, "b", "x"), (1, "a", "y")], "i int, digest string, w string")
    assert {(r.i, r.w, r.parent_v) for r in lineage.align(parents, rows, "i", "digest").collect()} == {(1, "y", 10), (2, "x", 20)}
    for bad in ((3, "c", "z"), (1, "b", "z"), (None, None, "z")):
        with pytest.raises(Exception, match="does not match"):
            lineage.align(parents, rows.union(spark.createDataFrame([bad], rows.schema)), "i", "digest").collect()


def test_times_are_complete_and_not_extraneous(spark):
    rows, times = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1, "t1"), (2, "t2")], "k int, at string")
    assert sorted(tuple(r) for r in checks.attach_times(rows, times, "k").collect()) == [(1, "t1"), (1, "t1"), (2, "t2")]
    for bad in ((3, "t3"), (2, "again")):
        with pytest.raises(Exception, match="extraneous"):
            checks.attach_times(rows, times.union(spark.createDataFrame([bad], times.schema)), "k").collect()
    with pytest.raises(Exception, match="incomplete"):
        checks.attach_times(rows, times.where("k = 1"), "k").collect()


def test_sources_must_not_overlap(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(3,)], "k int")
    assert sorted(tuple(r) for r in checks.union_sources({"a": a, "b": b}, "k").collect()) == [(1, "a"), (2, "a"), (3, "b")]
    with pytest.raises(Exception, match="sources overlap: a and b"):
        checks.union_sources({"a": a, "b": b.union(a)}, "k").collect()
    assert [tuple(r) for r in checks.overlaps({"a": a, "b": b.union(a.where("k = 1"))}, "k").collect()] == [(1, "a,b")]
    assert {tuple(r) for r in checks.key_difference(a, b.union(a.where("k = 1")), "k").collect()} == {(2, "first"), (3, "second")}


def test_bundle_checks_find_planted_faults(spark):
    rows = spark.createDataFrame([(1, "TOP", 2, "TOP", "26.15", w) for w in (True, False, True)] + [(2, "TOP", 1, "TOP", "26.13", True)], "focal int, focal_position string, other int, other_position string, public_patch string, win boolean")
    rows = rows.select("*", F.lit(420).alias("queue_id"), F.lit("x").alias("platform"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("rank_bracket"))
    stats, by_patch, windows = (f(rows, "26.15") for f in (aggregates.pair_statistics, aggregates.patch_specific, aggregates.cumulative_windows))

    def failed(**changed):
        made = {"statistics": stats, "by_patch": by_patch, "windows": windows, "rows": rows} | changed
        found = {r.check: r.failures for r in checks.bundle_checks(made["rows"], made["statistics"], made["by_patch"], made["windows"], "26.15").collect()}
        assert len(found) == 12
        return {k for k, n in found.items() if n}

    assert failed() == set()
    assert failed(statistics=stats.union(stats.where("focal = 1"))) == {"duplicate_key"}
    assert failed(statistics=stats.where("focal = 1")) >= {"contribution_totals", "aggregate_patch_totals"}
    assert failed(windows=windows.where("oldest_age <> 2")) == {"cumulative_window_count", "cumulative_window_order"}
    assert failed(windows=windows.withColumn("effective_sample_size", F.col("effective_sample_size") + 1)) == {"effective_sample_size"}
    assert failed(windows=windows.withColumn("sum_weights", F.col("sum_weights") * 2)) >= {"final_window_total", "weighted_outcomes"}
    assert failed(by_patch=by_patch.where("focal = 2")) == {"aggregate_patch_totals"}


def test_tower_outcome_of_odd_events(spark):
    fields = "match_id string, timestamp bigint, type string, building_type string, tower_type string, lane_type string, team_id int"
    tower = lambda m, at, team, lane="TOP_LANE": (m, at, "BUILDING_KILL", "TOWER_BUILDING", "OUTER_TURRET", lane, team)
    plate = lambda m, at, team: (m, at, "TURRET_PLATE_DESTROYED", None, None, "TOP_LANE", team)
    rows = [tower("a", 600_000, 200), tower("a", 500_000, 300), tower("a", 1, 100, "MID_LANE"), plate("a", 840_000, 200), plate("a", 840_001, 200), tower("b", 900_001, 100), plate("b", None, 100), tower("b", None, 200)]
    out = timelines.tower_outcomes(spark.createDataFrame(rows, fields), spark.createDataFrame([("a",), ("b",), ("c",)], "match_id string"))
    got = {(r.match_id, r.focal_team): r for r in out.collect()}
    assert len(got) == 6
    a, b, c = got["a", 100], got["b", 100], got["c", 200]
    assert (a.label_at_15, a.first_relation, a.first_timestamp, a.fell_before_10, a.plate_difference) == ("enemy_top_outer_first", "enemy", 600_000, True, 1)
    assert got["a", 200].label_at_15 == "allied_top_outer_first" and got["a", 200].plate_difference == -1
    assert (b.label_at_15, b.first_relation, b.fell_before_15, b.fell_before_20, b.plate_difference, b.plates_supported) == ("neither_by_15", "allied", False, True, None, False)
    assert (c.label_at_15, c.first_relation, c.plate_difference, c.plates_supported) == ("neither_by_15", None, 0, True)


def test_cleared_stage_tables_are_made_again(spark, small):
    import shutil

    from rallypoint.sources.lens import tables

    t = tables(spark, small)
    assert tables(spark, small) is t
    made = t.once("probe", lambda: spark.range(3).toDF("id"))
    assert t.once("probe", lambda: spark.range(9).toDF("id")).count() == made.count() == 3
    shutil.rmtree(made.inputFiles()[0].removeprefix("file://").rpartition("/")[0])
    assert t.once("probe", lambda: spark.range(9).toDF("id")).count() == 9


def test_exclusions_go_minute_by_minute(spark):
    """An invalid target at one minute comes before missing people at a later one; a missing frame before both."""
    good, bad = (100, 1, 1, 1, 5), (100, 1, 1, 1, 19)
    people = lambda v: {1: v, 2: good}
    frames = {
        "ok": [(300_000, people(good)), (600_000, people(good)), (900_000, people(good))],
        "bad_then_none": [(300_000, people(good)), (600_000, people(bad)), (900_000, None)],
        "none_then_bad": [(300_000, None), (600_000, people(bad)), (900_000, people(good))],
        "late": [(300_000, people(bad)), (600_000, None), (960_001, people(good))],
        "early_bad": [(300_000, people(bad)), (600_000, people(good)), (900_000, people(good))],
    }
    value = "struct<total_gold:int,xp:int,minions:int,jungle_minions:int,level:int>"
    lines = spark.createDataFrame(list(frames.items()), f"match_id string, frames array<struct<timestamp:bigint,people:map<int,{value}>>>")
    matches = spark.createDataFrame([(m, "26.15", 420, 1800) for m in frames], "match_id string, public_patch string, queue_id int, duration_seconds int")
    seats = spark.createDataFrame([(m, p, 100 * p, "TOP", "TOP") for m in frames for p in (1, 2)], "match_id string, participant_id int, team_id int, team_position string, individual_position string")
    got = {r.match_id: r.reason for r in timelines.timeline_exclusions(matches, seats, lines, "26.15").collect()}
    assert got == {"ok": None, "bad_then_none": "primary_target_invalid", "none_then_bad": "participant_frames_missing", "late": "primary_frame_missing", "early_bad": "primary_target_invalid"}


def test_a_herald_counts_for_two_minutes(spark):
    people = spark.createDataFrame([(m, p, 100 * p, "TOP", "TOP") for m in "abcd" for p in (1, 2)], "match_id string, participant_id int, team_id int, team_position string, individual_position string")
    fields = "match_id string, timestamp bigint, type string, building_type string, tower_type string, lane_type string, team_id int, monster_type string, killer_id int, victim_id int, assisting_ids array<int>, x int, y int"
    none = (None,) * 5
    rows = []
    for m, later, team in (("a", 120_000, 200), ("b", 120_001, 200), ("c", -1, 200), ("d", 60_000, 100)):
        rows += [(m, 300_000, "ELITE_MONSTER_KILL", None, None, None, 100, "RIFTHERALD", *none), (m, 300_000 + later, "BUILDING_KILL", "TOWER_BUILDING", "OUTER_TURRET", "TOP_LANE", team, None, *none)]
    got = {r.match_id: (r.herald_tower, r.any_recorded) for r in timelines.interventions(spark.createDataFrame(rows, fields), people, 900_000).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (False, False), "d": (False, False)}


def test_key_difference_tells_both_sides(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,), (2,)], "k int")
    assert {(r.k, r.side) for r in checks.key_difference(a, b, "k").collect()} == {(1, "first"), (None, "first"), (3, "second")}
