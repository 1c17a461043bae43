"""Named queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallypoint.functions import clock, identity, patches
from rallypoint.functions.formulas import POSITIONS
from rallypoint.operators import aggregates, audits, drafts, interactions, models, opponents, policies, quality, records, resampling, series
from rallypoint.sources import series_lens
from rallypoint.sources.lens import tables
from rallypoint.sources.stages import stage
from rallypoint.streaming import ingest

TARGET = "26.15"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations, staged once for all queries on the same tables."""
    t = tables(spark, sf_dir)
    return t.once("observations", lambda: opponents.observations(t))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def joined(df: DataFrame) -> DataFrame:
    """Arrays of text as one text each."""
    return df.select(*(F.array_join(c, ",").alias(c) if kind == "array<string>" else F.col(c) for c, kind in df.dtypes))


def with_seconds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("s", clock.seconds(rows, "ts"))


@query
def match_context(spark, sf_dir):
    return joined(quality.match_context(tables(spark, sf_dir)).drop("game_creation", "queue_id"))


@query
def position_policy(spark, sf_dir):
    return quality.with_positions(tables(spark, sf_dir).participants).select("match_id", "participant_id", "position", "position_source", "position_disagreement")


@query
def team_totals_shares(spark, sf_dir):
    return quality.team_totals(tables(spark, sf_dir))


@query
def formula_contract(spark, sf_dir):
    return rounded(quality.participant_features(tables(spark, sf_dir)).drop("team_id", "champion_id", "position", "position_source", "position_disagreement"))


@query
def reconciliation_checks(spark, sf_dir):
    t = tables(spark, sf_dir)
    return quality.reconciliation(t).union(aggregates.reverse_pair_check(opponents.matchups(observed(spark, sf_dir)), TARGET))


@query
def lane_opponents(spark, sf_dir):
    return joined(observed(spark, sf_dir).select("match_id", "participant_id", "resolution", "opponent_participant_id", "opponent_champion_id", "role_reasons", "matchup_reasons", "synergy_reasons"))


@query
def reciprocal_pairs(spark, sf_dir):
    return opponents.reciprocal_pairs(observed(spark, sf_dir))


@query
def draft_compositions(spark, sf_dir):
    return opponents.compositions(tables(spark, sf_dir).participants)


@query
def matchup_statistics(spark, sf_dir):
    return aggregates.pair_statistics(opponents.matchups(observed(spark, sf_dir)), TARGET)


@query
def synergy_statistics(spark, sf_dir):
    return aggregates.pair_statistics(opponents.synergies(observed(spark, sf_dir)), TARGET)


@query
def matchup_patch_specific(spark, sf_dir):
    return aggregates.patch_specific(opponents.matchups(observed(spark, sf_dir)), TARGET)


@query
def matchup_cumulative_windows(spark, sf_dir):
    return aggregates.cumulative_windows(opponents.matchups(observed(spark, sf_dir)), TARGET)


@query
def matchup_leave_one_out(spark, sf_dir):
    return aggregates.leave_one_out(opponents.matchups(observed(spark, sf_dir)), TARGET)


@query
def synergy_leave_one_out(spark, sf_dir):
    rows = observed(spark, sf_dir)
    return aggregates.synergy_leave_one_out(opponents.synergies(rows), rows, TARGET)


@query
def role_share(spark, sf_dir):
    return aggregates.role_share(observed(spark, sf_dir), TARGET)


def predictions(spark, sf_dir):
    rows = observed(spark, sf_dir)
    return tables(spark, sf_dir).once("predictions", lambda: policies.predictions(rows, TARGET))


def split(spark, sf_dir):
    """Drafts before the target patch, and those of it."""
    rows = observed(spark, sf_dir)
    drafts_ = tables(spark, sf_dir).once("drafts", lambda: drafts.corpus(rows))
    return drafts_.where(F.col("public_patch") != TARGET), drafts_.where(F.col("public_patch") == TARGET)


@query
def rolling_origin_folds(spark, sf_dir):
    return policies.rolling_origin(tables(spark, sf_dir).matches)


@query
def policy_predictions(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).select("policy", "match_id", "participant_id", "outcome", "probability", "evidence", "missing_reason"), 9)


@query
def policy_metrics(spark, sf_dir):
    return rounded(policies.metrics(predictions(spark, sf_dir), "policy"), 9)


@query
def calibration_table(spark, sf_dir):
    return rounded(policies.calibration(predictions(spark, sf_dir), "policy"), 9)


@query
def ece_variants(spark, sf_dir):
    p = predictions(spark, sf_dir)
    a, b = policies.interval_ece(p, "policy"), policies.confidence_ece(p, "policy")
    return rounded(a.join(b, "policy"), 9)


@query
def metric_slices(spark, sf_dir):
    return rounded(policies.slices(predictions(spark, sf_dir)), 9)


@query
def draft_exclusions(spark, sf_dir):
    return drafts.exclusions(observed(spark, sf_dir))


@query
def draft_corpus(spark, sf_dir):
    return drafts.corpus(observed(spark, sf_dir)).drop("game_creation")


@query
def draft_vector(spark, sf_dir):
    train, test = split(spark, sf_dir)
    return drafts.vectors(test, drafts.vocabulary(train))


@query
def champion_role_baseline(spark, sf_dir):
    train, test = split(spark, sf_dir)
    return rounded(drafts.rate_baseline(test, drafts.slot_rates(train), F.lit(0.5), clip=False), 9)


@query
def role_rate_baseline(spark, sf_dir):
    train, test = split(spark, sf_dir)
    rate = train.agg(F.avg("outcome")).first()[0]
    return rounded(drafts.rate_baseline(test, drafts.slot_rates(train, 10), F.lit(0.5 if rate is None else rate), clip=True), 9)


@query
def hash_folds(spark, sf_dir):
    return drafts.hash_folds(drafts.corpus(observed(spark, sf_dir)), 5, 34, "pooled")


@query
def learning_curve(spark, sf_dir):
    return drafts.learning_curve(drafts.corpus(observed(spark, sf_dir)), (0.1, 0.25, 0.5, 1.0), 7)


@query
def unseen_rates(spark, sf_dir):
    train, test = split(spark, sf_dir)
    return drafts.unseen_rates(test, drafts.vocabulary(train))


@query
def time_folds(spark, sf_dir):
    return drafts.time_folds(tables(spark, sf_dir).matches, "game_creation", ["2024-01-10", "2024-01-15", "2024-01-20", "2024-01-25"], 5)


@query
def counterfactual_slots(spark, sf_dir):
    train, test = split(spark, sf_dir)
    every = spark.range(1, 6).select(F.col("id").cast("int").alias("candidate"))
    swapped = drafts.counterfactuals(test.select("match_id", "platform", "public_patch", "outcome", *drafts.SLOTS), "blue_top", every)
    swapped = swapped.withColumn("match_id", F.concat_ws("/", "match_id", "blue_top"))
    return rounded(drafts.rate_baseline(swapped, drafts.slot_rates(train), F.lit(0.5), clip=False), 9)


def trajectories(spark, sf_dir):
    frames = series_lens.spending(spark, sf_dir)
    found = series.asof_forward(series_lens.requests(frames), frames.select("custkey", "at", "total"), "custkey", "at", series_lens.TOLERANCE_DAYS * series_lens.DAY_SECONDS, "total")
    return found.select("custkey", "pair", "day", F.col("frame_at"), F.col("total"))


def differences(spark, sf_dir):
    own = trajectories(spark, sf_dir)
    side = lambda k: F.max(F.when(F.col("custkey") % 2 == k, F.col("total")))
    return own.groupBy("pair", "day").agg((side(0) - side(1)).alias("difference"))


@query
def asof_trajectory(spark, sf_dir):
    return trajectories(spark, sf_dir)


@query
def trajectory_changes(spark, sf_dir):
    return rounded(series.changes(differences(spark, sf_dir), "pair", "day", "difference"), 2)


@query
def survivor_bias(spark, sf_dir):
    return rounded(audits.survivors(differences(spark, sf_dir), "pair", "day", "difference"), 4)


@query
def interval_proxy(spark, sf_dir):
    rows = with_seconds(series_lens.history(spark, sf_dir))
    found = series.within_before(rows, "user_id", "s", F.col("event_type") == "purchase", F.col("event_type") == "error", 6 * 3600)
    return found.select("event_id", "preceded")


@query
def first_event_label(spark, sf_dir):
    rows = series_lens.history(spark, sf_dir).where(F.col("event_type").isin("click", "view"))
    return series.first_label(with_seconds(rows), "user_id", "s", "event_type", 1_704_844_800)


@query
def strict_history(spark, sf_dir):
    rows = series_lens.history(spark, sf_dir)
    return rounded(series.strict_history(rows, "user_id", "champion", "ts", F.col("value") > 50, "value").drop("ts", "value", "event_type"), 9)


@query
def ewm_history(spark, sf_dir):
    rows = series_lens.history(spark, sf_dir)
    return rounded(series.exponential_history(rows, ["user_id"], "ts", ["event_id"], "value").select("event_id", "ewm"))


@query
def chronological_blocks(spark, sf_dir):
    return series.blocks(series_lens.history(spark, sf_dir), "ts", "event_id").select("event_id", "nth", "block")


@query
def consecutive_runs(spark, sf_dir):
    return series.runs(series_lens.history(spark, sf_dir), "user_id", "ts", ["event_id"], F.col("value") < 50).select("event_id", "run")


@query
def support_audit(spark, sf_dir):
    rows = series_lens.history(spark, sf_dir)
    return rounded(audits.support(rows, "user_id", {"kind": ["event_type"], "champion": ["champion"], "champion_kind": ["champion", "event_type"]}))


@query
def distribution_summary(spark, sf_dir):
    return rounded(audits.distribution(series_lens.history(spark, sf_dir), "value", "event_type"))


@query
def correlation_audit(spark, sf_dir):
    return rounded(audits.correlations(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_quantity", "l_extendedprice", "l_returnflag"))


@query
def cosine_similarity(spark, sf_dir):
    rows = series_lens.history(spark, sf_dir).groupBy("champion", "event_type").agg(F.count(F.lit(1)).alias("n"))
    pick = lambda k: rows.where(F.col("event_type") == k)
    return rounded(audits.cosine(pick("click"), pick("view"), "champion", "n"))


@query
def missing_fields(spark, sf_dir):
    return quality.missingness(tables(spark, sf_dir).participants, "team_position", "individual_position", "lane_cs", "jungle_cs", "champion_id")


@query
def class_balance(spark, sf_dir):
    return rounded(audits.class_balance(drafts.corpus(observed(spark, sf_dir)), "outcome", "platform"))


@query
def top_supported(spark, sf_dir):
    return audits.top_supported(tables(spark, sf_dir).participants, ["champion_id", "team_position"], 10)


@query
def regression_metrics(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500).alias("p"), (1 - F.col("l_discount")).alias("w"))
    return rounded(audits.regression_metrics(rows, "t", "p", "w", "l_returnflag"))


@query
def multiclass_metrics(spark, sf_dir):
    k = F.col("event_id")
    rows = series_lens.history(spark, sf_dir).select("event_type", (k % 3).cast("int").alias("y"), (0.2 + k % 5 * 0.1).alias("p0"), F.lit(0.25).alias("p1"), (0.55 - k % 5 * 0.1).alias("p2"), (1 + k % 2).cast("double").alias("w"))
    return rounded(audits.multiclass_metrics(rows, "y", ["p0", "p1", "p2"], "w", "event_type"))


@query
def champion_means(spark, sf_dir):
    rows = series_lens.history(spark, sf_dir).withColumn("weight", F.lit(0.5))
    return rounded(audits.means_or_overall(rows, "user_id", "value", "weight", 10))


@query
def status_catalog(spark, sf_dir):
    rows = series_lens.history(spark, sf_dir)
    return records.status_counts(records.latest_status(rows.select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id"), "event_type")


@query
def dedup_antijoin(spark, sf_dir):
    events, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "customer"))
    return records.not_known(customers.select(F.col("c_custkey").alias("user_id")), events, "user_id")


@query
def keep_first_dedup(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("price"))
    return records.keep_one(rows, ["l_orderkey", "l_linenumber"], F.col("price").desc(), F.col("l_partkey"), F.col("l_suppkey"))


@query
def multiset_duplicates(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = lambda flag: rows.where(F.col("l_returnflag") == flag).select("l_quantity", "l_linenumber")
    return records.multiset_overlap(side("A"), side("R"), "l_quantity", "l_linenumber")


@query
def even_allocation(spark, sf_dir):
    return records.even_allocation(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name"), "n_name", 1013)


@query
def sampling_schedule(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment", "c_custkey")
    return records.balanced_schedule(rows, "c_mktsegment", "c_custkey", 11)


@query
def rank_attach(spark, sf_dir):
    people = tables(spark, sf_dir).participants.select("match_id", "participant_id", "player_key", "champion_id")
    seen = people.where(F.col("champion_id") <= 12).select("player_key", F.concat(F.lit("TIER"), (F.col("champion_id") % 3).cast("string")).alias("rank"))
    return records.attach_rank(people.drop("champion_id"), seen, "player_key", "rank")


@query
def pseudonyms(spark, sf_dir):
    return tables(spark, sf_dir).participants.select("player_key").distinct()


@query
def set_fingerprints(spark, sf_dir):
    return tables(spark, sf_dir).matches.groupBy("public_patch").agg(identity.set_fingerprint(F.col("match_id")).alias("fingerprint"))


@query
def patch_resolution(spark, sf_dir):
    rows = series_lens.history(spark, sf_dir)
    k = F.col("event_id")
    version = F.when(k % 11 == 0, F.lit("v16.1")).when(k % 13 == 0, F.lit(None)).otherwise(F.concat_ws(".", (15 + k % 3).cast("string"), (k % 102).cast("string"), (k % 900).cast("string")))
    made = rows.select("event_id", version.alias("version"), F.when(k % 5 == 0, F.lit("2025-06-01")).otherwise(F.lit("2026-06-01")).cast("timestamp").alias("created"))
    return made.select("event_id", patches.resolve(F.col("version"), F.col("created")).alias("p")).select("event_id", "p.*")


@query
def beta_posterior(spark, sf_dir):
    """Whole-number parameters, so that SQL can sum the binomial identity."""
    stats = aggregates.pair_statistics(opponents.matchups(observed(spark, sf_dir)), TARGET).select("focal", "focal_position", "other", "platform", "games", "wins", F.lit(0.5).alias("baseline"))
    found = models.beta_posterior(stats, "wins", "games", "baseline", 10.0, 0.05)
    return rounded(found.select("focal", "focal_position", "other", "platform", "posterior_mean", "posterior_advantage", "p_advantage", "tier"), 9)


@query
def logistic_scores(spark, sf_dir):
    train, test = split(spark, sf_dir)
    known = stage(drafts.vocabulary(train, matchups=False), "vocabulary")
    size = known.count()
    weights = models.fit_logistic(models.as_vectors(drafts.vectors(train, known, False), train, size), 0.01)
    table = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "index int, coefficient double")
    return rounded(models.score_logistic(drafts.vectors(test, known, False), test, table), 4)


@query
def paired_bootstrap(spark, sf_dir):
    p = predictions(spark, sf_dir).where("probability IS NOT NULL").withColumn("loss", F.pow(F.col("probability") - F.col("outcome"), 2))
    by_match = p.groupBy("policy", "platform", "match_id").agg(F.avg("loss").alias("loss"))
    base = by_match.where("policy = 'naive_empirical'").select(F.col("match_id").alias("m"), F.col("loss").alias("base"))
    rest = by_match.where("policy <> 'naive_empirical'").join(base, F.col("match_id") == F.col("m"))
    return rounded(resampling.paired_bootstrap(rest.select("policy", "platform", "match_id", (F.col("loss") - F.col("base")).alias("difference")), "policy", "platform", "match_id", "difference", 2000, 34))


@query
def cluster_bootstrap(spark, sf_dir):
    p = predictions(spark, sf_dir).where("probability IS NOT NULL").withColumn("loss", F.pow(F.col("probability") - F.col("outcome"), 2))
    return rounded(resampling.cluster_bootstrap(p, "policy", "match_id", "platform", "loss", 200, 33))


@query
def calibration_line(spark, sf_dir):
    return models.calibration_line(predictions(spark, sf_dir), "policy")


@query
def shared_interactions(spark, sf_dir):
    """Held-out loss of each configuration: drafts of one fifth of the hashes, all configurations fitted side by side on the rest."""
    rows, grid = tables(spark, sf_dir).once("drafts", lambda: drafts.corpus(observed(spark, sf_dir))), [(2, 0.001), (2, 0.01), (4, 0.01)]
    coded, known = interactions.coded(rows, F.pmod(F.xxhash64("match_id"), F.lit(5)))
    cells = [interactions.Cell("hash", None, interactions.Config(f"{d}-{l2}", l2, l2, d, d), 4, 5) for d, l2 in grid]
    losses = interactions.validation_losses(coded, *interactions.fit_cells(coded, known.count(), cells, 34))
    return rounded(spark.createDataFrame([(d, l2, losses[i][1], losses[i][0]) for i, (d, l2) in enumerate(grid)], "dimension int, l2 double, loss double, rows bigint"))


@query
def incremental_ingest(spark, sf_dir):
    return ingest.ingest_all(spark, f"{sf_dir}/events.parquet")
