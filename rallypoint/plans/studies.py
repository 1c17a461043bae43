"""Named queries of studies: nested selection, interaction models, exact bootstraps, power and further audits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallypoint.functions.beta import student_quantiles
from rallypoint.operators import aggregates, boosting, diagnostics, drafts, interactions, records, resampling
from rallypoint.plans.further import PLATFORM, exact_draws
from rallypoint.plans.oracles import OBSERVED, stats
from rallypoint.plans.oracles import SQL as KNOWN
from rallypoint.plans.queries import TARGET, observed, predictions, rounded, split
from rallypoint.sources import blobs
from rallypoint.sources.lens import tables
from rallypoint.sources.stages import work_dir
from rallypoint.streaming import ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


DAY = 86400
#: Outer folds of five days each, in seconds since 1970, and the inner windows before them.
OUTER = [(f"block-{i}", 1705363200 + i * 5 * DAY, 1705363200 + (i + 1) * 5 * DAY) for i in range(3)]
INNER, INNER_SECONDS = 3, 2 * DAY
LEAST, LEAST_PER_PLATFORM = 20, 8
SEED = 34
GRID = [
    interactions.Config("main", 0.01, 0.01, 0, 0),
    interactions.Config("synergy-2", 0.01, 0.01, 2, 0),
    interactions.Config("counter-2", 0.01, 0.01, 0, 2),
    interactions.Config("both-2", 0.01, 0.1, 2, 2),
]
_DRAFT = KNOWN["draft_corpus"].removeprefix("WITH ").rpartition(" SELECT match_id, platform")[0]


def seconds(column: str):
    """A time-zone-free timestamp's whole seconds since 1970."""
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', {column})") / 1_000_000).cast("bigint")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).once("drafts", lambda: drafts.corpus(observed(spark, sf_dir)))


def windows() -> list:
    return interactions.nested_windows(OUTER, INNER, INNER_SECONDS)


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).select("platform", seconds("game_creation").alias("at"))
    return interactions.nested_folds(rows, "at", windows(), LEAST, LEAST_PER_PLATFORM)


_WINDOWS = "VALUES " + ", ".join(f"('{f}', {'NULL' if i is None else i}::INTEGER, {a}::BIGINT, {b}::BIGINT)" for f, i, a, b in windows())


@query(f"""WITH {_DRAFT}, m AS (SELECT DISTINCT match_id, platform, floor(epoch(game_creation))::BIGINT AS t FROM ds JOIN matches USING (match_id, platform)),
    c AS (SELECT fold, inner_no, platform, count(*) FILTER (t < a) AS training, count(*) FILTER (t >= a AND t < b) AS validation FROM m, ({_WINDOWS}) w(fold, inner_no, a, b) GROUP BY ALL)
    SELECT fold, inner_no AS inner, sum(training)::BIGINT AS training, sum(validation)::BIGINT AS validation, min(training) AS fewest,
        sum(training) >= {LEAST} AND min(training) >= {LEAST_PER_PLATFORM} AND sum(validation) > 0 AS accepted FROM c GROUP BY ALL""")
def nested_folds(spark, sf_dir):
    return folds(spark, sf_dir)


#: Fits by application and by the staged drafts that they were made of.
_FITTED: dict[tuple, interactions.Nested] = {}


def nested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, interactions.Nested]:
    rows = corpus(spark, sf_dir)
    key = (spark.sparkContext.applicationId, *sorted(rows.inputFiles()))
    if key not in _FITTED:
        coded, known = interactions.coded(rows, seconds("game_creation"))
        accepted = [(r.fold, r.inner) for r in folds(spark, sf_dir).where("accepted").collect()]
        _FITTED[key] = interactions.nested_selection(coded, known, windows(), accepted, GRID, SEED)
    return rows, _FITTED[key]


@query()
def nested_selection(spark, sf_dir):
    return rounded(nested(spark, sf_dir)[1].selection, 6)


@query()
def nested_fits(spark, sf_dir):
    return rounded(nested(spark, sf_dir)[1].fits, 6)


@query()
def interaction_parameters(spark, sf_dir):
    return nested(spark, sf_dir)[1].parameters


@query()
def interaction_probabilities(spark, sf_dir):
    """The refits' probabilities for the drafts of their own outer blocks."""
    rows, found = nested(spark, sf_dir)
    t = seconds("game_creation")
    scored = [interactions.score(rows.where((t >= a) & (t < b)), found.parameters.where(F.col("fold") == f)) for f, a, b in OUTER]
    return rounded(reduce(DataFrame.unionByName, scored), 6)


def paired_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """policy, platform, match_id, log_loss and brier: each policy's mean losses in a match less the naive ones."""
    p = F.least(F.greatest("probability", F.lit(1e-15)), F.lit(1 - 1e-15))
    known = predictions(spark, sf_dir).where("probability IS NOT NULL")
    by = known.groupBy("platform", "match_id", "policy").agg(
        F.avg(-F.when(F.col("outcome") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("l"), F.avg(F.pow(F.col("probability") - F.col("outcome"), 2)).alias("b"))
    # A match's policies lie in one list, the naive one's losses beside it: one exchange, no join of the losses with themselves.
    naive = F.col("policy") == "naive_empirical"
    beside = by.groupBy("platform", "match_id").agg(F.max(F.when(naive, F.col("l"))).alias("bl"), F.max(F.when(naive, F.col("b"))).alias("bb"), F.collect_list(F.when(~naive, F.struct("policy", "l", "b"))).alias("rest"))
    met = beside.where("bl IS NOT NULL AND bb IS NOT NULL").select("platform", "match_id", "bl", "bb", F.explode("rest").alias("r")).select("r.policy", "platform", "match_id", F.col("r.l").alias("l"), F.col("r.b").alias("b"), "bl", "bb")
    return met.select("policy", "platform", "match_id", (F.col("l") - F.col("bl")).alias("log_loss"), (F.col("b") - F.col("bb")).alias("brier"))


_BY = """SELECT policy, match_id, avg(-ln(CASE WHEN outcome = 1 THEN least(greatest(probability, 1e-15), 1 - 1e-15) ELSE 1 - least(greatest(probability, 1e-15), 1 - 1e-15) END)) AS l,
    avg(pow(probability - outcome, 2)) AS b FROM p WHERE probability IS NOT NULL GROUP BY policy, match_id"""
_PAIRED = f"SELECT a.policy, match_id, {PLATFORM}, a.l - n.l AS log_loss, a.b - n.b AS brier FROM ({_BY}) a JOIN ({_BY}) n USING (match_id) WHERE n.policy = 'naive_empirical' AND a.policy <> 'naive_empirical'"
_BOTH = exact_draws(_PAIRED, "avg(log_loss) AS ml, avg(brier) AS mb", 36, 1000, ", ".join(
    f"round((SELECT avg({c}) FROM c WHERE c.policy = m.policy), 6) + 0 AS e{m}, round(quantile_cont({m}, 0.025), 6) + 0 AS l{m}, round(quantile_cont({m}, 0.975), 6) + 0 AS h{m}, round(avg(({m} < 0)::INTEGER), 6) AS s{m}" for c, m in (("log_loss", "ml"), ("brier", "mb"))))


@query(f"""SELECT policy, unnest(['log_loss', 'brier']) AS metric, unnest([eml, emb]) AS estimate, unnest([lml, lmb]) AS low, unnest([hml, hmb]) AS high, unnest([sml, smb]) AS share_below FROM ({_BOTH})""")
def metric_bootstrap(spark, sf_dir):
    """Intervals of both metrics' differences to the naive policy, over the same exact redraws."""
    return rounded(resampling.metric_bootstrap(paired_losses(spark, sf_dir), "policy", "platform", "match_id", ["log_loss", "brier"], 1000, 36))


#: Sizes for which the SQL of power_requirements has the t-test's bounds.
_SIZES = 256
_CUTS = "[0, " + ", ".join(map(repr, student_quantiles(0.975, list(range(1, _SIZES))))) + "]"
SHARES, TARGETS, REPLICATES, POWER_SEED, ELIGIBILITY = [0.4, 0.6], [0.8, 0.9], 400, 41, 0.85


@query(f"""WITH RECURSIVE p AS ({KNOWN["policy_predictions"]}), c AS ({_PAIRED}),
    o AS (SELECT policy, brier - avg(brier) OVER (PARTITION BY policy) AS x, row_number() OVER (PARTITION BY policy ORDER BY sha256(match_id), match_id) - 1 AS i FROM c),
    g AS (SELECT policy, count(*) AS k, stddev_samp(brier) AS sd FROM c GROUP BY policy HAVING stddev_samp(brier) > 0),
    d AS (SELECT policy, r, n, floor(('0x' || substr(sha256('{POWER_SEED}|' || policy || '|' || r || '|' || n), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * k)::BIGINT AS i FROM g, range(1, {REPLICATES + 1}) t(r), range(1, {_SIZES + 1}) u(n)),
    s AS (SELECT policy, r, n, sum(x) OVER w AS s, sum(x * x) OVER w AS q FROM d JOIN o USING (policy, i) WINDOW w AS (PARTITION BY policy, r ORDER BY n)),
    t AS (SELECT s.policy, e AS effect, r, n, abs(s / n - e * sd) AS off, sqrt(greatest((q - s * s / n) / (n - 1), 0) / n) AS error, ({_CUTS})[n] AS cut FROM s JOIN g USING (policy), (SELECT unnest({SHARES}::DOUBLE[]) AS e) WHERE n >= 2),
    w AS MATERIALIZED (SELECT policy, effect, n, count(*) FILTER (error <= 0 OR off / error >= cut) / {REPLICATES}.0::DOUBLE AS power FROM t GROUP BY ALL),
    z AS (SELECT policy, effect, target, min(n) AS high FROM w, (SELECT unnest({TARGETS}::DOUBLE[]) AS target) WHERE n IN (32, 64, 128, 256) AND power >= target GROUP BY ALL),
    b AS (SELECT policy, effect, target, CASE WHEN high > 32 THEN high // 2 + 1 ELSE 2 END AS low, high FROM z
        UNION ALL SELECT b.policy, b.effect, target, CASE WHEN power >= target THEN low ELSE n + 1 END, CASE WHEN power >= target THEN n ELSE high END FROM b JOIN w ON b.policy = w.policy AND b.effect = w.effect AND n = (low + high) // 2 WHERE low < high)
    SELECT policy, effect, target, low::INTEGER AS eligible, ceil(low / {ELIGIBILITY})::INTEGER AS accepted, ceil(ceil(low / {ELIGIBILITY}) * 1.1::DOUBLE)::INTEGER AS reserved FROM b WHERE low >= high""")
def power_requirements(spark, sf_dir):
    """Matches that a paired test of each policy's Brier difference needs, by resampling."""
    return resampling.required_sizes(paired_losses(spark, sf_dir), "policy", "match_id", "brier", SHARES, TARGETS, REPLICATES, POWER_SEED, ELIGIBILITY)


_AGED = f"WITH {OBSERVED}, e AS (SELECT *, 15 - split_part(public_patch, '.', 2)::INTEGER AS age FROM observed WHERE position IS NOT NULL AND 15 - split_part(public_patch, '.', 2)::INTEGER <= 5)"
_GROUP = "champion_id, position, queue_id, platform, region, rank_bracket"
_ELIGIBLE = {"role": "len(role_reasons) = 0", "matchup": "len(role_reasons) = 0 AND resolution = 'resolved_unique'", "synergy": "len(synergy_reasons) = 0"}


@query(f"""{_AGED}, w AS (SELECT unnest(range(0, 6))::INTEGER AS oldest_age),
    g AS ({" UNION ALL ".join(f"SELECT {_GROUP}, '{b}' AS bundle, oldest_age, string_agg(n::VARCHAR, ',' ORDER BY a) AS games_by_age FROM (SELECT {_GROUP}, oldest_age, a, count(*) FILTER (age = a AND {on}) AS n FROM e, w, range(0, 6) t(a) WHERE a <= oldest_age GROUP BY ALL) GROUP BY ALL" for b, on in _ELIGIBLE.items())}),
    s AS ({" UNION ALL ".join(f"SELECT {_GROUP}, '{b}' AS bundle, oldest_age, {stats('', f'age <= oldest_age AND {on}')} FROM e, w GROUP BY {_GROUP}, oldest_age" for b, on in _ELIGIBLE.items())}),
    r AS (SELECT champion_id AS c, position AS p, platform AS f, count(*) FILTER ({_ELIGIBLE["role"]}) AS role_games FROM e GROUP BY ALL),
    t AS (SELECT *, sum(role_games) OVER (PARTITION BY c, f)::BIGINT AS all_role_games FROM r)
    SELECT s.*, games_by_age, all_role_games, round(CASE WHEN all_role_games > 0 THEN role_games / all_role_games END, 6) AS role_share, coalesce(CASE WHEN all_role_games > 0 THEN role_games / all_role_games END >= 0.05, false) AS meets_share,
        role_games >= 50 AS meets_games, coalesce(CASE WHEN all_role_games > 0 THEN role_games / all_role_games END >= 0.05, false) AND role_games >= 50 AS provisional
    FROM s JOIN g ON s.champion_id = g.champion_id AND s.position = g.position AND s.platform = g.platform AND s.bundle = g.bundle AND s.oldest_age = g.oldest_age JOIN t ON c = s.champion_id AND p = s.position AND f = s.platform""")
def role_bundles(spark, sf_dir):
    return aggregates.role_bundles(observed(spark, sf_dir), TARGET)


@query(f"""{_AGED}, o AS (SELECT DISTINCT {_GROUP}, opponent_champion_id AS other FROM e WHERE {_ELIGIBLE["matchup"]} AND opponent_champion_id IS NOT NULL),
    a AS (SELECT DISTINCT focal AS champion_id, focal_position AS position, platform, other, other_position FROM synergies WHERE age <= 5),
    x AS (SELECT o.champion_id, o.position, o.platform, 'opponent' AS kind, o.other, o.position AS other_position, e.win, e.age, e.opponent_champion_id <> o.other AS left_in FROM o JOIN e ON e.champion_id = o.champion_id AND e.position = o.position AND e.platform = o.platform
            AND len(e.role_reasons) = 0 AND e.resolution = 'resolved_unique' AND e.opponent_champion_id IS NOT NULL
        UNION ALL SELECT a.champion_id, a.position, a.platform, 'ally', a.other, a.other_position, e.win, e.age,
            NOT EXISTS (SELECT 1 FROM synergies y WHERE y.match_id = e.match_id AND y.participant_id = e.participant_id AND y.other = a.other AND y.other_position = a.other_position)
            FROM a JOIN e ON e.champion_id = a.champion_id AND e.position = a.position AND e.platform = a.platform AND len(e.synergy_reasons) = 0)
    SELECT champion_id, position, 420 AS queue_id, platform, NULL::VARCHAR AS region, NULL::VARCHAR AS rank_bracket, kind, other, other_position,
        CASE WHEN count(*) FILTER (left_in) > 0 THEN 'available' ELSE 'unavailable_no_leave_pair_out_observations' END AS availability, {stats('', 'left_in')} FROM x GROUP BY champion_id, position, platform, kind, other, other_position""")
def exclusion_components(spark, sf_dir):
    return aggregates.exclusion_components(observed(spark, sf_dir), TARGET)


_P = KNOWN["policy_predictions"]
_PLACE = "CASE WHEN substr(match_id, 2)::BIGINT % 2 = 0 THEN 'eun1' ELSE 'euw1' END"


def _quantile_columns(value: str) -> str:
    return ", ".join(f"round(quantile_cont({value}, {q}), 6) AS q{round(100 * q):02d}" for q in diagnostics.QUANTILES)


@query(f"""WITH p AS ({_P}), s AS (SELECT policy, unnest(['overall', {_PLACE}]) AS scope, probability AS v FROM p WHERE probability IS NOT NULL)
    SELECT policy, scope, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, round(avg(abs(v - 0.5)), 6) AS distance,
    {", ".join(f"round(avg((v BETWEEN {a} AND {b})::INTEGER), 6) AS band_{round(100 * a)}_{round(100 * b)}" for a, b in diagnostics.BANDS)}, {_quantile_columns("v")} FROM s GROUP BY ALL""")
def prediction_bands(spark, sf_dir):
    return rounded(diagnostics.prediction_summary(predictions(spark, sf_dir), "policy", "platform"))


@query(f"""WITH p AS ({_P}), b AS (SELECT a.match_id, a.probability AS p1, c.probability AS p2 FROM p a JOIN p c USING (match_id, participant_id) WHERE a.policy = 'champion_role_baseline' AND c.policy = 'matchup_synergy_combination' AND a.probability IS NOT NULL AND c.probability IS NOT NULL),
    s AS (SELECT unnest(['overall', {_PLACE}]) AS scope, p1, p2 - p1 AS d, abs(p2 - p1) AS a FROM b),
    t AS (SELECT scope, 'all' AS band, d, a FROM s {" ".join(f"UNION ALL SELECT scope, '{a:.2f}-{b:.2f}', d, a FROM s WHERE p1 BETWEEN {a} AND {b}" for a, b in diagnostics.BANDS)})
    SELECT scope, band, count(*) AS n, round(avg(d), 6) + 0 AS signed, round(avg(a), 6) AS absolute, round(max(a), 6) AS most, {_quantile_columns("a")} FROM t GROUP BY ALL""")
def prediction_disagreement(spark, sf_dir):
    return rounded(diagnostics.disagreement(predictions(spark, sf_dir), "policy", "champion_role_baseline", "matchup_synergy_combination", "platform", "match_id", "participant_id"))


_NAMES = ("naive_empirical", "champion_role_baseline", "shrunk_directional_matchup", "shrunk_directional_synergy", "matchup_synergy_combination")
_PAIRS = [(b, a) for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]]


_ROLED = KNOWN["policy_predictions"].replace("SELECT policy, match_id, participant_id, outcome,", "SELECT policy, match_id, participant_id, role, outcome,")


@query(f"""WITH p AS ({_ROLED}), l AS (SELECT policy, match_id, participant_id, {_PLACE} AS platform, role, unnest(['brier', 'log_loss']) AS metric,
        unnest([pow(probability - outcome, 2), -ln(CASE WHEN outcome = 1 THEN least(greatest(probability, 1e-15), 1 - 1e-15) ELSE 1 - least(greatest(probability, 1e-15), 1 - 1e-15) END)]) AS x FROM p WHERE probability IS NOT NULL),
    d AS (SELECT a.policy AS candidate, b.policy AS comparator, metric, a.platform, a.role, a.x - b.x AS d FROM l a JOIN l b USING (match_id, participant_id, metric)
        WHERE (a.policy, b.policy) IN ({", ".join(map(str, _PAIRS))}))
    SELECT candidate, comparator, metric, platform, role, count(*) AS n, round(avg(d), 6) + 0 AS difference, round(stddev_samp(d), 6) AS deviation, round(avg((d < 0)::INTEGER), 6) AS better
    FROM d GROUP BY GROUPING SETS ((candidate, comparator, metric), (candidate, comparator, metric, platform), (candidate, comparator, metric, role))""")
def comparison_ladder(spark, sf_dir):
    """Every pair of policies by both metrics, over all rows and by platform and role, from one scan."""
    p, y = F.least(F.greatest("probability", F.lit(1e-15)), F.lit(1 - 1e-15)), F.col("outcome")
    losses = {"brier": F.pow(F.col("probability") - y, 2), "log_loss": -F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))}
    return rounded(diagnostics.ladder(predictions(spark, sf_dir).where("probability IS NOT NULL"), "policy", losses, _PAIRS, ["platform", "role"], "match_id", "participant_id"))


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = split(spark, sf_dir)
    slots = drafts.slots(train).withColumn("slot_id", F.concat_ws("/", "match_id", F.col("sign").cast("string")))
    return boosting.ordered_statistics(slots.select("slot_id", "match_id", "sign", "role", "champion", "won"), "slot_id", ["role", "champion"], "won", 0.5, 7)


@query(f"""WITH {_DRAFT}, t AS (SELECT match_id || '/' || sign AS slot_id, match_id, sign, role, champion, won FROM ds WHERE public_patch <> '26.15'),
    o AS (SELECT *, count(*) OVER w AS earlier_n, coalesce(sum(won) OVER w, 0)::BIGINT AS earlier_sum FROM t WINDOW w AS (PARTITION BY role, champion ORDER BY sha256('7|' || slot_id), slot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT *, round((earlier_sum + 0.5) / (earlier_n + 1), 9) AS value FROM o""")
def ordered_statistics(spark, sf_dir):
    """Each training slot's smoothed win rate over earlier slots of its role and champion, in a hashed order."""
    return rounded(ordered(spark, sf_dir), 9)


@query()
def boosted_scores(spark, sf_dir):
    """Ordered boosting on the ten slots before the target patch; probabilities of the target patch's drafts."""
    train, test = split(spark, sf_dir)
    names = [f"{side}_{r}" for side in (1, -1) for r in ("TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY")]
    at = F.array_position(F.array(*map(F.lit, names)), F.concat_ws("_", F.col("sign").cast("string"), "role"))

    def wide(values: DataFrame) -> DataFrame:
        by = values.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("i"), boosting.binned(F.col("value")).alias("b")))).alias("x"))
        return by.select("match_id", F.transform("x", lambda v: v["b"]).alias("bins"))

    y = train.select(F.col("match_id").alias("of"), F.col("outcome").alias("y"))
    fitted = boosting.boost(wide(ordered(spark, sf_dir)).join(y, F.col("match_id") == F.col("of")).select("bins", "y"), 10, trees=12, depth=2)
    rates = boosting.whole_statistics(drafts.slots(train), ["role", "champion"], "won", 0.5).withColumnsRenamed({"role": "r", "champion": "c"})
    asked = drafts.slots(test).join(rates, (F.col("role") == F.col("r")) & (F.col("champion") == F.col("c")), "left").withColumn("value", F.coalesce("value", F.lit(0.5)))
    scored = wide(asked.select("match_id", "sign", "role", "value")).withColumn("probability", fitted.probability("bins"))
    out = test.select(F.col("match_id").alias("of"), "outcome")
    return rounded(scored.join(out, F.col("match_id") == F.col("of")).select("match_id", "outcome", "probability"))


@query("""WITH f AS (SELECT event_type AS component, sha256(round(value)::BIGINT::VARCHAR) AS digest, round(value)::BIGINT AS size, user_id % 2 AS scope FROM events WHERE value IS NOT NULL),
    a AS (SELECT component, digest, size, count(*) AS n FROM f WHERE scope = 0 GROUP BY ALL), b AS (SELECT component, digest, size, count(*) AS n FROM f WHERE scope = 1 GROUP BY ALL)
    SELECT component, sum(least(a.n, b.n))::BIGINT AS duplicate_files, sum(least(a.n, b.n) * size)::BIGINT AS duplicate_bytes FROM a JOIN b USING (component, digest, size) GROUP BY component""")
def duplicate_files(spark, sf_dir):
    """Contents (rounded values) that users of either parity both hold, by event type."""
    size = F.round("value").cast("bigint")
    files = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL").select("event_type", F.col("user_id") % 2 == 0, size.alias("size"), F.sha2(size.cast("string"), 256).alias("digest")).toDF("event_type", "even", "size", "digest")
    return blobs.duplicates(files.where("even"), files.where("NOT even"), F.col("event_type"))


@query("SELECT count(DISTINCT event_id) AS keys, count(DISTINCT event_type) AS kinds FROM events")
def ledger_keys(spark, sf_dir):
    """Events entered into a ledger in two batches that overlap, each key once."""
    folder, config = work_dir(spark, "ledger"), {"table": "events"}
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = F.expr("user_id % 3 <> 0")
    for no, batch in enumerate((events.where(half), events)):
        ledger.add_new(batch, folder, "event_id", "event_type", config, no, 32)
    entered = spark.read.parquet(f"{folder}/keys")
    return entered.agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("content").alias("kinds"))


@query("""WITH l AS (SELECT user_id, arg_max({'e': event_type, 'i': event_id}, {'t': ts, 'e': event_id}) AS u FROM events GROUP BY user_id),
    c AS (SELECT CASE WHEN u.e = 'error' THEN 'rejected' WHEN u.e = 'signup' THEN 'processing' ELSE 'processed' END AS s, CASE WHEN u.i % 3 > 0 THEN 'code_' || u.i % 3 END AS f, CASE u.i % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'legacy_unresolved' WHEN 2 THEN 'resolved' END AS p FROM l)
    SELECT 'total' AS kind, NULL AS name, count(*) AS n FROM c UNION ALL SELECT 'status', s, count(*) FROM c GROUP BY s UNION ALL SELECT 'failure', f, count(*) FROM c WHERE s = 'rejected' GROUP BY f
    UNION ALL SELECT 'needs_migration', NULL, count(*) FROM c WHERE s = 'processed' AND (p IS NULL OR p = 'legacy_unresolved') HAVING count(*) > 0""")
def catalog_statistics(spark, sf_dir):
    """Users' last events as catalog entries: by status, failures by code, and entries whose patch must be resolved anew."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    last = records.latest_status(events, "user_id", "ts", "event_id")
    kind, k = F.col("event_type"), F.col("event_id")
    made = last.select(
        F.when(kind == "error", "rejected").when(kind == "signup", "processing").otherwise("processed").alias("status"), F.when(k % 3 > 0, F.concat(F.lit("code_"), (k % 3).cast("string"))).alias("failure"),
        F.when(k % 4 == 1, records.UNMIGRATED).when(k % 4 != 3, "resolved").alias("patch_status"))
    return records.catalog_statistics(made, "status", "failure", "patch_status")
