"""Plans that must not grow faster than their input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rallypoint.operators import diagnostics, drafts, interactions, opponents, policies, resampling
from rallypoint.plans import queries
from rallypoint.sources.lens import tables


def logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def records(spark):
    """Predictions from a range, so that a plan shows how often they are read."""
    k = F.col("id")
    return spark.range(400).select(
        F.concat(F.lit("p"), k % 2).alias("policy"), F.when(k % 7 > 0, k % 101 / 100).alias("probability"), (k % 3 == 0).cast("int").alias("outcome"),
        F.concat(F.lit("26."), k % 4).alias("public_patch"), F.when(k % 5 > 0, "a").alias("platform"), F.lit("TOP").alias("role"), (k % 30).alias("role_games"), (k % 11).alias("evidence"),
    )


def test_predictions_meet_counts_without_a_shuffle_of_rows(spark, small):
    made = policies.predictions(queries.observed(spark, small), queries.TARGET)
    assert "SortMergeJoin" not in physical(made)
    assert made.groupBy("match_id", "participant_id", "policy").count().where("count > 1").isEmpty()


def test_metrics_and_slices_read_records_once(spark):
    rows = records(spark)
    for df in (policies.metrics(rows, "policy"), policies.slices(rows)):
        assert logical(df).count("Range (") == 1


def test_slices_equal_metrics_of_one_dimension(spark):
    rows = records(spark)
    sliced = {(r.policy, r.value): r for r in policies.slices(rows).where("dimension = 'platform'").collect()}
    for r in policies.metrics(rows, "policy", "platform").collect():
        s = sliced[r.policy, r.platform]
        assert (s.candidate_rows, s.evaluated_rows) == (r.candidate_rows, r.evaluated_rows)
        assert all(abs(s[c] - r[c]) < 1e-12 for c in ("brier_score", "accuracy", "calibration_error"))


def test_confidence_ece_reads_records_once_and_counts_edges_twice(spark):
    rows = records(spark)
    assert logical(policies.confidence_ece(rows, "policy")).count("Range (") == 1
    known = rows.where("probability IS NOT NULL").collect()
    for r in policies.confidence_ece(rows, "policy").collect():
        own, gap = [x for x in known if x.policy == r.policy], 0.0
        for i in range(10):
            low = 0.9 * i / 9
            met = [(max(x.probability, 1 - x.probability), (x.probability >= 0.5) == (x.outcome == 1)) for x in own]
            met = [(c, hit) for c, hit in met if low <= c < low + 0.1 + 1e-12]
            gap += abs(sum(hit for _, hit in met) - sum(c for c, _ in met))
        assert abs(r.confidence_ece - gap / len(own)) < 1e-12


def test_ladder_sums_before_the_grouping_sets(spark):
    rows = records(spark).withColumn("i", F.monotonically_increasing_id())
    df = diagnostics.ladder(rows, "policy", {"p": F.col("probability")}, [("p1", "p0")], ["platform"], "i")
    assert "collect_list" not in logical(df)
    plan = logical(df)
    assert plan.index("Expand") < plan.rindex("Aggregate") and plan[plan.index("Expand") :].count("Aggregate") == 2


def test_observations_sort_rows_once_for_all_windows(spark, small):
    plan = physical(opponents.observations(tables(spark, small)))
    # Above the join of rows and context only one sort stands.
    assert plan[: plan.index("Join")].count("Sort [") + plan[: plan.index("Join")].count("TakeOrdered") == 1


def test_corpus_shuffles_teams_not_rows(spark, small):
    plan = logical(drafts.corpus(queries.observed(spark, small)))
    assert "Join" not in plan and "Window" not in plan


def test_scoring_shuffles_no_draft(spark):
    row = (1, 1, *range(1, 11))
    made = spark.createDataFrame([row], ["match_id", "outcome", *drafts.SLOTS])
    table = spark.createDataFrame([("f", "c", "TOP", 1, 0.5, True, [], [], [], 0.25)], "fold string, config_id string, role string, champion int, main double, supported boolean, synergy array<double>, attack array<double>, defence array<double>, intercept double")
    scored = interactions.score(made, table)
    assert "Join" not in logical(scored) and "Aggregate" not in logical(scored)
    assert abs(scored.first().probability - 1 / (1 + np.exp(-0.75))) < 1e-12


def test_driver_gets_one_row_a_cell(spark, monkeypatch):
    """However many partitions the drafts have."""
    layout = interactions.Layout(11, 0, 0)
    rows = spark.range(160, numPartitions=16).select((F.col("id") * 0).alias("at"), (F.col("id") % 2).cast("int").alias("outcome"), F.sequence(F.lit(1), F.lit(10)).alias("c"))
    got, collect = [], type(rows).collect

    def counted(self):
        out = collect(self)
        got.append(len(out))
        return out

    monkeypatch.setattr(type(rows), "collect", counted)
    found = interactions.summed(rows, 16, {0: interactions.Problem(5, 6, layout, np.ones(11, bool))}, {0: np.zeros(layout.size)}, True)
    assert got == [1] and found[0][0] == 160


def test_power_reads_differences_once(spark):
    """The sizes that are tried all stand on the same staged residuals."""
    uses = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            uses.add(b.num_rows)
            yield b

    made = spark.range(200).select(F.lit("k").alias("k"), F.col("id").alias("m"), (F.col("id") % 7 - 2.5).alias("d")).mapInArrow(seen, "k string, m bigint, d double")
    resampling.required_sizes(made, "k", "m", "d", [0.5], [0.8], 40, 4).collect()
    assert uses.value == 200


def test_blocks_of_redraws_are_dealt_to_many_tasks(spark):
    units = spark.range(300).select(F.lit("k").alias("k"), F.lit("s").alias("s"), F.col("id").alias("m"), F.col("id").cast("double").alias("d"))
    assert "REPARTITION_BY_NUM" in resampling.redraw(units, "k", "s", "m", ["d"], 5, 1, block=16)._jdf.queryExecution().executedPlan().toString()
