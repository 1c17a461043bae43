"""Further named queries, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallypoint.functions import formulas, patches
from rallypoint.operators import aggregates, audits, checks, lineage, models, opponents, quality, resampling, timelines
from rallypoint.plans.oracles import CONTEXT, LENS, OBSERVED, PAIR
from rallypoint.plans.oracles import SQL as KNOWN
from rallypoint.plans.queries import TARGET, observed, predictions, rounded, split
from rallypoint.sources import records, series_lens, timeline_lens
from rallypoint.sources.lens import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_EVENTS = LENS + """, ev AS (
    SELECT match_id, event_id, participant_id, CASE WHEN event_id % 43 <> 0 THEN (event_id * 7919) % 1800000 END AS ts_ms, event_id % 6 AS k, CASE WHEN event_id % 41 = 0 THEN 300 ELSE team_id END AS team
    FROM seat
), tp AS (
    SELECT match_id, max(participant_id) FILTER (team_id = 100) AS b, max(participant_id) FILTER (team_id = 200) AS r FROM seat
    WHERE team_position = 'TOP' AND (individual_position IS NULL OR individual_position = 'TOP') GROUP BY match_id HAVING count(*) = 2 AND b IS NOT NULL AND r IS NOT NULL
)"""
_GOOD = "event_id % 60 % 20 BETWEEN 1 AND 18 AND gold >= 0 AND coalesce(lane_cs >= 0, false) AND jungle_cs >= 0"


@query(f"WITH {_EVENTS} SELECT match_id, b AS blue_top, r AS red_top FROM tp")
def top_pairs(spark, sf_dir):
    return timelines.top_pairs(tables(spark, sf_dir).participants)


@query(f"""WITH {LENS} SELECT match_id, participant_id, CASE WHEN {_GOOD} THEN gold END AS gold, CASE WHEN {_GOOD} THEN event_id % 9000 END AS xp, CASE WHEN {_GOOD} THEN lane_cs END AS lane_cs,
    CASE WHEN {_GOOD} THEN jungle_cs END AS jungle_cs, CASE WHEN {_GOOD} THEN (event_id % 60 % 20)::INTEGER END AS level, CASE WHEN {_GOOD} THEN lane_cs + jungle_cs END AS farm
    FROM seat WHERE match_no % 17 <> 0 AND match_no % 13 <> 0 AND match_no % 23 <> 0""")
def frame_values(spark, sf_dir):
    """The values of the first frame of every timeline that has one with people."""
    frames = timeline_lens.timelines(tables(spark, sf_dir)).select("match_id", F.explode(F.get("frames", F.lit(0))["people"]).alias("participant_id", "raw"))
    return frames.select("match_id", "participant_id", timelines.frame_values(F.col("raw")).alias("v")).select("match_id", "participant_id", "v.*")


@query(f"""WITH {_EVENTS}, bad AS (
    SELECT match_id, bool_or(NOT ({_GOOD})) AS bad FROM seat JOIN tp USING (match_id) WHERE participant_id IN (b, r) GROUP BY match_id
), n AS (SELECT match_id, any_value(match_no) AS k FROM seat GROUP BY match_id)
SELECT match_id, CASE WHEN k % 17 = 0 THEN 'timeline_not_downloaded' WHEN public_patch <> '26.15' THEN 'wrong_patch' WHEN queue_id <> 420 THEN 'wrong_queue'
    WHEN duration_seconds < 300 THEN 'remake_or_short_game' WHEN b IS NULL THEN 'top_participant_identification' WHEN k % 13 = 0 THEN 'timeline_frames_missing'
    WHEN k * 5 % 90 > 60 OR k * 10 % 90 > 60 OR k * 15 % 90 > 60 THEN 'primary_frame_missing' WHEN k % 23 = 0 THEN 'participant_frames_missing' WHEN bad THEN 'primary_target_invalid' END AS reason
FROM matches JOIN n USING (match_id) LEFT JOIN tp USING (match_id) LEFT JOIN bad USING (match_id)""")
def timeline_exclusions(spark, sf_dir):
    t = tables(spark, sf_dir)
    return timelines.timeline_exclusions(t.matches, t.participants, timeline_lens.timelines(t), TARGET)


@query(f"""WITH {_EVENTS}, first AS (
    SELECT match_id, arg_min(team, (ts_ms, team)) AS team, min(ts_ms) AS ts FROM ev WHERE k = 1 AND team IN (100, 200) AND ts_ms IS NOT NULL GROUP BY match_id
), plates AS (
    SELECT match_id, count(*) FILTER (team NOT IN (100, 200) OR ts_ms IS NULL) AS bad, count(*) FILTER (team = 100 AND ts_ms <= 840000) AS l100, count(*) FILTER (team = 200 AND ts_ms <= 840000) AS l200
    FROM ev WHERE k = 2 GROUP BY match_id
)
SELECT match_id, focal_team, CASE WHEN ts IS NULL OR ts > 900000 THEN 'neither_by_15' WHEN team = focal_team THEN 'allied_top_outer_first' ELSE 'enemy_top_outer_first' END AS label_at_15,
    CASE WHEN team = focal_team THEN 'allied' WHEN ts IS NOT NULL THEN 'enemy' END AS first_relation, ts AS first_timestamp,
    coalesce(ts <= 600000, false) AS fell_before_10, coalesce(ts <= 900000, false) AS fell_before_15, coalesce(ts <= 1200000, false) AS fell_before_20, coalesce(ts <= 1500000, false) AS fell_before_25,
    CASE WHEN coalesce(bad, 0) = 0 THEN coalesce(CASE WHEN focal_team = 100 THEN l200 - l100 ELSE l100 - l200 END, 0) END AS plate_difference, coalesce(bad, 0) = 0 AS plates_supported
FROM matches CROSS JOIN (VALUES (100), (200)) f(focal_team) LEFT JOIN first USING (match_id) LEFT JOIN plates USING (match_id)""")
def tower_outcomes(spark, sf_dir):
    t = tables(spark, sf_dir)
    return timelines.tower_outcomes(timeline_lens.events(t), t.matches)


@query(f"""WITH {_EVENTS}, early AS (SELECT * FROM ev JOIN tp USING (match_id) WHERE ts_ms <= 900000),
people AS (
    SELECT match_id, event_id, b, r, unnest(list_distinct(CASE WHEN event_id % 4 <> 0 THEN [participant_id, participant_id % 10 + 1, (event_id % 10 + 1)::INTEGER] ELSE [participant_id, participant_id % 10 + 1] END)) AS p FROM early WHERE k = 0
), kills AS (
    SELECT match_id, event_id, bool_or(p IN (b, r)) AS top, bool_or(p NOT IN (b, r) AND team_position = 'JUNGLE') AS j, bool_or(p NOT IN (b, r) AND team_position IN ('MIDDLE', 'BOTTOM', 'UTILITY')) AS o
    FROM people LEFT JOIN (SELECT match_id, participant_id AS p, team_position FROM seat) USING (match_id, p) GROUP BY match_id, event_id
), marks AS (
    SELECT match_id, bool_or(top AND coalesce(j, false)) AS j, bool_or(top AND coalesce(o, false)) AS o,
        bool_or(top AND ((x <= 6000 AND y >= 8000) OR (x <= 8000 AND y >= 10000))) AS n FROM (SELECT *, event_id * 37 % 12000 AS x, event_id * 53 % 12000 AS y FROM kills) GROUP BY match_id
), herald AS (
    SELECT DISTINCT h.match_id FROM early h JOIN early t ON h.match_id = t.match_id AND h.k = 3 AND t.k IN (1, 4) AND h.team <> t.team AND h.team < 300 AND t.team < 300 AND t.ts_ms - h.ts_ms BETWEEN 0 AND 120000
)
SELECT match_id, coalesce(j, false) AS jungle_with_top, coalesce(o, false) AS other_with_top, coalesce(n, false) AS kill_near_top, match_id IN (SELECT match_id FROM herald) AS herald_tower,
    coalesce(j, false) OR coalesce(o, false) OR coalesce(n, false) OR match_id IN (SELECT match_id FROM herald) AS any_recorded FROM tp LEFT JOIN marks USING (match_id)""")
def top_interventions(spark, sf_dir):
    t = tables(spark, sf_dir)
    return timelines.interventions(timeline_lens.events(t), t.participants, 900_000)


@query(f"""WITH {LENS}, r AS (
    SELECT match_id, team_id, count(*) AS members, CASE WHEN count(*) = 5 THEN sum(kills) END AS tk, CASE WHEN count(*) = 5 THEN sum(deaths) END AS td,
        sum(kills) + CASE WHEN any_value(match_no) % 50 = 0 THEN 1 ELSE 0 END AS ck FROM seat GROUP BY match_id, team_id
), o AS (SELECT *, CASE WHEN count(td) OVER w = 2 THEN sum(td) OVER w - td END AS od, count(*) OVER w AS nt FROM r WINDOW w AS (PARTITION BY match_id))
SELECT unnest(['participant_without_team', 'participant_team_win', 'team_kills_champion_kills', 'team_participant_count', 'team_kills_opponent_deaths', 'team_without_context']) AS "check",
    unnest([0, 0, count(*) FILTER (tk IS DISTINCT FROM ck), count(*) FILTER (members <> 5), count(*) FILTER (nt = 2 AND tk <> od), 0]) AS failures FROM o""")
def cross_team_checks(spark, sf_dir):
    """Champion kills are the sums of kills, one more in every fiftieth match."""
    t = tables(spark, sf_dir)
    extra = (F.substring("match_id", 2, 20).cast("bigint") % 50 == 0).cast("int")
    kills = t.participants.groupBy("match_id", "team_id").agg((F.sum("kills") + F.first(extra)).alias("champion_kills"))
    return checks.cross_team(t.participants, t.teams.join(kills, ["match_id", "team_id"]), quality.team_totals(t).select("match_id", "team_id", "members", "team_kills", "team_deaths"), t.matches)


@query(f"""WITH {OBSERVED}
SELECT unnest(['duplicate_key', 'contribution_totals', 'outcomes', 'aggregate_patch_totals', 'cumulative_window_count', 'cumulative_window_order', 'final_window_total', 'weighted_outcomes', 'effective_sample_size', 'patch_outcomes']) AS "check", 0::BIGINT AS failures
UNION ALL SELECT 'cumulative_window_outcomes', count(*) FROM (SELECT DISTINCT {PAIR} FROM matchups WHERE focal = 7 AND age <= 5)
UNION ALL SELECT 'patch_weight', count(*) FROM (SELECT DISTINCT {PAIR}, age FROM matchups WHERE focal = 9 AND age = 2)""")
def bundle_checks(spark, sf_dir):
    """The bundle has two faults of its own: wins of champion 7 in windows of age 3, and weights of champion 9 at age 2."""
    rows = opponents.matchups(observed(spark, sf_dir))
    windows = aggregates.cumulative_windows(rows, TARGET)
    windows = windows.withColumn("wins", F.col("wins") + ((F.col("focal") == 7) & (F.col("oldest_age") == 3)).cast("int"))
    patches = aggregates.patch_specific(rows, TARGET)
    patches = patches.withColumn("patch_weight", F.col("patch_weight") + ((F.col("focal") == 9) & (F.col("age") == 2)).cast("int"))
    return checks.bundle_checks(rows, aggregates.pair_statistics(rows, TARGET), patches, windows, TARGET)


_METRICS = ("kda", "kill_participation", "cs_per_minute", "gold_per_minute", "gold_share", "damage_share")


@query("WITH f AS (" + KNOWN["formula_contract"] + ") " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER ({m} IS NULL) AS n_null, min({m})::DOUBLE AS least, max({m})::DOUBLE AS most FROM f" for m in _METRICS))
def metric_ranges(spark, sf_dir):
    return rounded(checks.ranges(quality.participant_features(tables(spark, sf_dir)), *_METRICS))


@query("""SELECT l_partkey AS partkey, 'first' AS side FROM (SELECT l_partkey FROM lineitem WHERE l_quantity < 3 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)
    UNION ALL SELECT l_partkey, 'second' FROM (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 3)""")
def key_difference(spark, sf_dir):
    """Parts sold in small quantities, and parts sold at a high discount: those that only one of the two sets holds."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("partkey", F.col("l_partkey"))
    return checks.key_difference(lines.where("l_quantity < 3"), lines.where("l_discount > 0.08"), "partkey")


@query("SELECT k, string_agg(s, ',' ORDER BY s) AS sources FROM (SELECT c_custkey AS k, 'customer' AS s FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier UNION ALL SELECT p_partkey, 'part' FROM part) GROUP BY k HAVING count(*) > 1")
def source_overlaps(spark, sf_dir):
    read = lambda t, c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias("k"))
    return checks.overlaps({"customer": read("customer", "c_custkey"), "supplier": read("supplier", "s_suppkey"), "part": read("part", "p_partkey")}, "k")


@query("SELECT source, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT 'nation' AS source, n_nationkey AS k FROM nation UNION ALL SELECT 'region', -1 - r_regionkey FROM region) GROUP BY source")
def source_union(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("k"))
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select((-1 - F.col("r_regionkey")).cast("bigint").alias("k"))
    return checks.union_sources({"nation": nation, "region": region}, "k").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query(f"WITH {CONTEXT} SELECT match_id, platform FROM context WHERE len(exclusion_reasons) = 0 ORDER BY game_creation, platform, match_id LIMIT 200")
def first_eligible(spark, sf_dir):
    rows = quality.match_context(tables(spark, sf_dir)).where(F.size("exclusion_reasons") == 0)
    return checks.first_n(rows.select("match_id", "platform", "game_creation"), 200, "game_creation", "platform", "match_id").drop("game_creation")


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def timestamp_join(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return checks.attach_times(lines, orders.join(lines.select("l_orderkey").distinct(), "l_orderkey", "left_semi"), "l_orderkey")


@query("SELECT platform, match_id, 'match_group_' || substr(sha256('groups' || chr(0) || platform || chr(0) || match_id), 1, 32) AS match_group FROM (WITH " + LENS + " SELECT * FROM matches)")
def match_groups(spark, sf_dir):
    return tables(spark, sf_dir).matches.select("platform", "match_id", lineage.match_group("groups", F.col("platform"), F.col("match_id")).alias("match_group"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'old' ELSE '16.' || event_id % 120 || '.1' END AS api_version,
    CASE WHEN event_id % 5 <> 0 THEN '16.' || event_id % 120 END AS api_patch, CASE WHEN event_id % 5 <> 0 AND event_id % 120 BETWEEN 1 AND 99 THEN '26.' || event_id % 120 END AS public_patch,
    CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 120 BETWEEN 1 AND 99 THEN 'resolved' ELSE 'legacy_unresolved' END END AS patch_status FROM events""")
def legacy_records(spark, sf_dir):
    k = F.col("event_id")
    rows = series_lens.history(spark, sf_dir).select("event_id", F.concat(F.lit("16."), (k % 120).cast("string"), F.lit(".1")).alias("version"), F.timestamp_seconds(F.lit(1_780_000_000)).alias("created"), F.lit("16.0").alias("patch"), F.when(k % 5 == 0, "old").alias("api_version"))
    return lineage.legacy_view(rows).drop("created")


@query(f"""WITH {OBSERVED}, m AS (SELECT * FROM matchups), c AS (SELECT other FROM m WHERE age > 0 GROUP BY other HAVING count(*) >= 20)
SELECT match_id, focal, focal_position, focal || '>' || other AS pair, CASE WHEN c.other IS NOT NULL THEN m.other::VARCHAR ELSE '__RARE_KEYSTONE__' END AS token, focal || '>' || CASE WHEN c.other IS NOT NULL THEN m.other::VARCHAR ELSE '__RARE_KEYSTONE__' END AS focal_token
FROM m LEFT JOIN c USING (other)""")
def feature_tokens(spark, sf_dir):
    rows = opponents.matchups(observed(spark, sf_dir)).select("match_id", "public_patch", "focal", "focal_position", "other")
    return lineage.feature_tokens(rows, rows.where(F.col("public_patch") != TARGET), "focal", "other", "other").drop("public_patch", "other")


_SLOTS = [f"{s}_{r}" for s in ("blue", "red") for r in ("top", "jungle", "middle", "bottom", "utility")]


@query("WITH d AS (" + KNOWN["draft_corpus"] + f"""), s AS (SELECT match_id, public_patch, unnest([{', '.join(repr(x.split('_')[1]) for x in _SLOTS)}]) AS role, unnest([{', '.join(_SLOTS)}]) AS champion FROM d),
c AS (SELECT role, champion, count(*) AS n FROM s WHERE public_patch <> '26.15' GROUP BY role, champion)
SELECT match_id, min(coalesce(n, 0)) AS evidence FROM s LEFT JOIN c USING (role, champion) WHERE public_patch = '26.15' GROUP BY match_id""")
def least_evidence(spark, sf_dir):
    train, test = split(spark, sf_dir)
    return lineage.least_evidence(test, train)


@query("SELECT l_orderkey * 8 + l_linenumber AS row_index, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber) = 1 AND count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def row_alignment(spark, sf_dir):
    index = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_index")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    once = lines.join(lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n = 1"), ["l_orderkey", "l_linenumber"], "left_semi")
    digest = F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber"), 256).alias("digest")
    return lineage.align(once.select(index, digest, "l_quantity"), once.select(index, digest, "l_partkey"), "row_index", "digest").select("row_index", "l_partkey", F.col("parent_l_quantity").alias("l_quantity"))


@query("""WITH a AS (SELECT DISTINCT user_id::VARCHAR AS match_id FROM events WHERE event_type IN ('click', 'view')), u AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT match_id, CASE WHEN match_id::BIGINT % 9 = 0 AND match_id::BIGINT % 4 = 0 THEN 'digests_differ' WHEN match_id::BIGINT % 4 <> 0 AND match_id::BIGINT % 9 = 0 THEN 'digests_differ' END AS conflict FROM a WHERE match_id::BIGINT IN (SELECT user_id FROM u)
UNION ALL SELECT match_id, 'not_stored' FROM a WHERE match_id::BIGINT NOT IN (SELECT user_id FROM u)""")
def provenance(spark, sf_dir):
    """Users who clicked or viewed are approved, those who purchased stored; every ninth one's stored digest differs."""
    rows = series_lens.history(spark, sf_dir).select(F.col("user_id").cast("string").alias("match_id"), "event_type", F.col("user_id").alias("u"))
    status = F.when(F.col("event_type") == "click", "approved").when(F.col("event_type") == "view", "reapproved").otherwise("rejected")
    digest = F.sha2("match_id", 256).alias("digest")
    own = rows.select("match_id", digest).distinct()
    stored = rows.where("event_type = 'purchase'").select("match_id", F.when(F.col("u") % 9 == 0, F.lit("other")).otherwise(F.sha2("match_id", 256)).alias("digest")).distinct()
    return lineage.provenance(rows.select("match_id", status.alias("status")), own, own, stored)


@query("""WITH d AS (SELECT user_id, event_type, min(ts) AS t0 FROM events GROUP BY ALL)
SELECT user_id, count(*) AS n_sources, string_agg(event_type, ',' ORDER BY event_type) AS sources, arg_min(event_type, (t0, event_type)) AS first_source FROM d GROUP BY user_id""")
def merged_sources(spark, sf_dir):
    return lineage.merged_sources(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type", "ts")


@query(f"""WITH {LENS}, s AS (SELECT match_id, player_key, count(*) AS n FROM participants WHERE team_position = 'TOP' GROUP BY ALL)
SELECT match_id, participant_id, coalesce(n, 0) AS n_seeds, CASE WHEN n IS NULL THEN 'collection_context' WHEN n = 1 THEN 'observed' ELSE 'ambiguous' END AS seed_status FROM participants LEFT JOIN s USING (match_id, player_key)""")
def seed_contexts(spark, sf_dir):
    people = tables(spark, sf_dir).participants
    return lineage.seed_contexts(people.select("match_id", "participant_id", "player_key"), people.where("team_position = 'TOP'"), "match_id", "player_key").drop("player_key")


@query("""WITH o AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS ok FROM orders GROUP BY 1), b AS (SELECT DISTINCT s_suppkey AS k, true AS old FROM supplier)
SELECT CASE WHEN old AND ok THEN 'reused_accepted' WHEN old THEN 'reused_other' WHEN ok THEN 'downloaded_accepted' ELSE 'downloaded_other' END AS outcome, count(*) AS n FROM o LEFT JOIN b USING (k) GROUP BY 1""")
def run_accounting(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("k", F.col("o_custkey"))
    known = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    return lineage.accounting(orders, known, "k", F.col("o_orderstatus") == "F")


@query("""SELECT round(sum((event_type = 'purchase')::INTEGER) / sum((event_type = 'click')::INTEGER), 6) AS purchases_per_click, round(sum((event_type = 'error')::INTEGER) / count(*), 6) AS error_rate, NULL::DOUBLE AS never FROM events""")
def efficiency(spark, sf_dir):
    is_kind = lambda k: (F.col("event_type") == k).cast("int")
    return lineage.efficiency(spark.read.parquet(f"{sf_dir}/events.parquet"), purchases_per_click=(is_kind("purchase"), is_kind("click")), error_rate=(is_kind("error"), F.lit(1)), never=(is_kind("click"), is_kind("nothing")))


@query(f"""WITH {LENS} SELECT CASE WHEN public_patch = '26.13' THEN 'target' WHEN split_part(public_patch, '.', 2)::INTEGER > 13 THEN 'newer' ELSE 'older' END AS patch_side, count(*) AS n, min(game_creation) AS first_at FROM matches GROUP BY 1""")
def patch_transitions(spark, sf_dir):
    return lineage.transitions(tables(spark, sf_dir).matches.withColumn("at", F.col("game_creation")), "26.13")


@query("""WITH r AS (SELECT user_id, event_id, value < 80 AS old, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events QUALIFY nth <= 60),
s AS (SELECT *, CASE WHEN old THEN nth - coalesce(max(CASE WHEN NOT old THEN nth END) OVER (PARTITION BY user_id ORDER BY nth), 0) ELSE 0 END AS run FROM r),
p AS (SELECT user_id, min(CASE WHEN run = 5 THEN nth END) AS cut, max(nth) AS n, arg_max(run, nth) AS last_run FROM s GROUP BY user_id)
SELECT user_id, coalesce(cut, n) AS "offset", CASE WHEN cut IS NOT NULL THEN 5 ELSE last_run END AS consecutive_older, CASE WHEN cut IS NOT NULL THEN 'history_old_patch_cutoff' WHEN n >= 60 THEN 'history_max_reached' ELSE 'history_examined' END AS status FROM p""")
def history_state(spark, sf_dir):
    rows = series_lens.history(spark, sf_dir).withColumn("tie", F.col("event_id"))
    return lineage.history_state(rows, "user_id", "ts", F.col("value") < 80, 5, 60)


@query("WITH d AS (" + KNOWN["draft_corpus"] + """), a AS (SELECT DISTINCT blue_top AS c FROM d), b AS (SELECT DISTINCT red_top AS c FROM d)
SELECT coalesce(a.c, b.c) AS champion, CASE WHEN a.c IS NULL THEN 'second' WHEN b.c IS NULL THEN 'first' ELSE 'both' END AS side FROM a FULL JOIN b ON a.c = b.c""")
def vocabulary_sides(spark, sf_dir):
    train, test = split(spark, sf_dir)
    rows = train.unionByName(test)
    return lineage.vocabulary_sides(rows.select(F.col("blue_top").alias("champion")), rows.select(F.col("red_top").alias("champion")), "champion")


@query(f"""WITH {LENS}, p AS (SELECT DISTINCT public_patch AS patch, split_part(public_patch, '.', 2)::INTEGER AS m FROM matches)
SELECT patch, array_to_string(list_transform(range(m, greatest(0, m - 3), -1), lambda x: '26.' || x), ',') AS newest, '26.' || (m - 3) AS three_behind, rank() OVER (ORDER BY m) AS nth FROM p""")
def patch_windows(spark, sf_dir):
    """The newest three patches up to each, the one three behind, and the patches' order by number."""
    rows = tables(spark, sf_dir).matches.select(F.col("public_patch").alias("patch")).distinct()
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct(patches.order(F.col("patch")).alias("o"), "patch"))).alias("all")).select(F.posexplode("all").alias("i", "x"))
    p = F.col("x.patch")
    return ordered.select(p.alias("patch"), F.array_join(patches.window(p, 3), ",").alias("newest"), patches.at_age(p, F.lit(3)).alias("three_behind"), (F.col("i") + 1).alias("nth"))


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT CASE WHEN n < 5 THEN '0-4' WHEN n < 20 THEN '5-19' WHEN n < 50 THEN '20-49' ELSE '50+' END AS tier, count(*) AS users, sum(n)::BIGINT AS rows FROM c GROUP BY 1""")
def support_tiers(spark, sf_dir):
    cells = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(formulas.support_tier(F.col("n")).alias("tier")).agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("rows"))


@query("""WITH r AS (SELECT event_id, ['  mid ', 'Bot', 'SUPPORT', '', ' ', 'top', 'jungle', 'Other thing', NULL][event_id % 9 + 1] AS raw FROM events), u AS (SELECT event_id, upper(trim(raw)) AS x FROM r)
SELECT event_id, CASE x WHEN 'MID' THEN 'MIDDLE' WHEN 'BOT' THEN 'BOTTOM' WHEN 'SUPPORT' THEN 'UTILITY' WHEN '' THEN NULL ELSE x END AS position FROM u""")
def position_aliases(spark, sf_dir):
    names = F.array(*map(F.lit, ("  mid ", "Bot", "SUPPORT", "", " ", "top", "jungle", "Other thing")), F.lit(None).cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get(names, (F.col("event_id") % 9).cast("int")).alias("raw"))
    return rows.select("event_id", formulas.normalize_position(F.col("raw")).alias("position"))


@query("""SELECT p_partkey, regexp_replace(p_brand || '/' || p_type || ' ' || p_partkey, '[^A-Za-z0-9_.-]', '_', 'g') AS segment FROM part""")
def safe_segments(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", formulas.safe_segment(F.concat("p_brand", F.lit("/"), "p_type", F.lit(" "), F.col("p_partkey").cast("string"))).alias("segment"))


@query("""WITH f AS (SELECT p_brand AS feature, avg(l_discount) - 0.05 AS c, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
SELECT feature, round(c, 9) AS coefficient, n AS support FROM f WHERE n >= 100 ORDER BY abs(round(c, 9)) DESC, feature LIMIT 10""")
def top_coefficients(spark, sf_dir):
    lines, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    by_brand = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.avg("l_discount") - 0.05, 9).alias("coefficient"), F.count(F.lit(1)).alias("support"))
    return audits.top_coefficients(by_brand, 10, 100)


@query("""WITH b AS (SELECT l_orderkey, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_linenumber % 4 END AS turn, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE (l_partkey % 170)::INTEGER END AS champion FROM lineitem)
SELECT l_orderkey, string_agg(coalesce(turn::VARCHAR, '-') || ':' || coalesce(champion::VARCHAR, '-'), ',' ORDER BY coalesce(turn, 10000), coalesce(champion, -1)) AS bans FROM b GROUP BY l_orderkey""")
def sorted_bans(spark, sf_dir):
    line = (F.col("l_linenumber") % 4).cast("int")
    ban = F.struct(F.when(F.col("l_partkey") % 10 != 0, (F.col("l_partkey") % 170).cast("int")).alias("championId"), F.when(line != 0, line).alias("pickTurn"))
    per = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(ban).alias("b"))
    text = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    return per.select("l_orderkey", F.array_join(F.transform(records.sorted_bans(F.col("b")), lambda x: F.concat(text(x["pickTurn"]), F.lit(":"), text(x["championId"]))), ",").alias("bans"))


@query("""SELECT n_regionkey AS style, n_nationkey AS keystone, n_name AS name FROM nation""")
def keystones(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    trees = nation.groupBy(F.col("n_regionkey").alias("id")).agg(F.array(F.struct(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("runes"))).alias("slots"))
    return records.keystones(trees)


@query("""WITH r AS (SELECT event_id, user_id % 7 AS style, event_id % 40 AS a, event_id % 25 AS b, event_id % 5 AS k FROM events), n AS (SELECT n_regionkey AS style, list(n_nationkey) AS ids FROM nation GROUP BY 1),
m AS (SELECT r.*, n.style AS known, len(list_intersect(list_distinct([a, b]), ids)) AS met, list_intersect([a, b], ids) AS got FROM r LEFT JOIN n USING (style))
SELECT event_id, CASE WHEN k = 0 THEN 'perks_missing' WHEN k = 1 THEN 'primary_style_missing' WHEN k = 2 THEN 'primary_style_ambiguous' WHEN known IS NULL THEN 'primary_style_unknown'
    WHEN met = 0 THEN 'keystone_unmatched' WHEN met > 1 THEN 'keystone_ambiguous' ELSE 'mapped' END AS keystone_status,
    CASE WHEN k > 2 AND known IS NOT NULL AND met = 1 THEN got[1]::INTEGER END AS keystone_id FROM m""")
def keystone_mapping(spark, sf_dir):
    """Perks of every event: no perks, no primary style, two of them, or one whose selections meet a region's nations."""
    k, n = (F.col("event_id") % 5).cast("int"), lambda c, m: (F.col(c) % m).cast("int")
    style = lambda name: F.struct(F.lit(name).alias("description"), n("user_id", 7).alias("style"), F.array(F.struct(n("event_id", 40).alias("perk")), F.struct(n("event_id", 25).alias("perk"))).alias("selections"))
    primary, sub = style(" PrimaryStyle "), style("subStyle")
    perks = F.when(k != 0, F.struct(F.when(k == 1, F.array(sub)).when(k == 2, F.array(primary, primary)).otherwise(F.array(sub, primary)).alias("styles")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", perks.alias("perks"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").cast("int").alias("style"), F.col("n_nationkey").cast("int").alias("keystone"))
    return records.map_keystone(rows, "perks", nation).select("event_id", "keystone_status", "keystone_id")


@query("""WITH s AS (SELECT event_type AS component, value FROM events) SELECT component, count(*) AS n_files, sum(round(value * 100)::BIGINT)::BIGINT AS size, ceil(sum(round(value * 100)::BIGINT) * (10000 / 500.0 * 1.1))::BIGINT AS projected FROM s GROUP BY component""")
def storage_projection(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("size"))
    return records.storage_projection(rows, F.col("event_type"), 500)


def exact_draws(units: str, values: str, seed: int, replicates: int, columns: str) -> str:
    """SQL over units (policy, platform, match_id and values), strata of at most 1024 units: columns of each policy's replicates m.

    Digest q of a replicate gives its draws 4q to 4q + 3.
    """
    return f"""WITH p AS ({KNOWN["policy_predictions"]}), c AS ({units}),
o AS (SELECT *, row_number() OVER (PARTITION BY policy, platform ORDER BY sha256(match_id), match_id) - 1 AS i, count(*) OVER (PARTITION BY policy, platform) AS k FROM c),
h AS (SELECT policy, platform, k, r, q, sha256('{seed}|' || policy || '|' || platform || '|0|' || r || '|' || q) AS h
    FROM (SELECT DISTINCT policy, platform, k FROM o), range(1, {replicates + 1}) t(r), range(0, 256) u(q) WHERE q * 4 < k),
d AS (SELECT policy, platform, r, floor(('0x' || substr(h, 16 * j + 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * k)::BIGINT AS i FROM h, range(0, 4) v(j) WHERE q * 4 + j < k),
m AS (SELECT policy, r, {values} FROM d JOIN o USING (policy, platform, i) GROUP BY policy, r)
SELECT policy, {columns} FROM m GROUP BY policy"""


PLATFORM = "CASE WHEN substr(match_id, 2)::BIGINT % 2 = 0 THEN 'eun1' ELSE 'euw1' END AS platform"


def _quantiles(m: str) -> str:
    return f"round(quantile_cont({m}, 0.025), 6) + 0 AS low, round(quantile_cont({m}, 0.975), 6) + 0 AS high"


def _bootstrap(rows: str, seed: int, replicates: int) -> str:
    """SQL over rows (policy, match_id, v): clusters are matches, strata their platforms."""
    units = f"SELECT policy, match_id, {PLATFORM}, sum(v) AS s, count(v) AS n FROM ({rows}) GROUP BY policy, match_id"
    estimate = "round((SELECT sum(s) / sum(n) FROM c WHERE c.policy = m.policy), 6) + 0 AS estimate"
    return exact_draws(units, "sum(s) / nullif(sum(n), 0) AS m", seed, replicates, f"{estimate}, {_quantiles('m')}")


_LOSS = "SELECT policy, match_id, avg(pow(probability - outcome, 2)) AS loss FROM p WHERE probability IS NOT NULL GROUP BY policy, match_id"
SQL["paired_bootstrap"] = exact_draws(
    f"SELECT a.policy, match_id, {PLATFORM}, a.loss - b.loss AS v FROM ({_LOSS}) a JOIN ({_LOSS}) b USING (match_id) WHERE b.policy = 'naive_empirical' AND a.policy <> 'naive_empirical'",
    "sum(v) / count(*) AS m", 34, 2000, f"round((SELECT avg(v) FROM c WHERE c.policy = m.policy), 6) + 0 AS estimate, {_quantiles('m')}, round(avg((m < 0)::INTEGER), 6) AS share_below")
SQL["cluster_bootstrap"] = _bootstrap("SELECT policy, match_id, pow(probability - outcome, 2) AS v FROM p WHERE probability IS NOT NULL", 33, 200)


@query(_bootstrap("""SELECT a.policy, match_id, pow(a.probability - a.outcome, 2) - pow(b.probability - b.outcome, 2) AS v FROM p a JOIN p b USING (match_id, participant_id)
    WHERE b.policy = 'naive_empirical' AND a.policy <> 'naive_empirical' AND a.probability IS NOT NULL AND b.probability IS NOT NULL""", 35, 200))
def group_bootstrap(spark, sf_dir):
    """Intervals of each policy's squared error less the naive one's, matches redrawn whole."""
    p = predictions(spark, sf_dir).where("probability IS NOT NULL").withColumn("loss", F.pow(F.col("probability") - F.col("outcome"), 2))
    # A row's losses lie in one list, the naive one beside it; no join of the predictions with themselves.
    naive = F.col("policy") == "naive_empirical"
    beside = p.groupBy("platform", "match_id", "participant_id").agg(F.max(F.when(naive, F.col("loss"))).alias("base"), F.collect_list(F.when(~naive, F.struct("policy", "loss"))).alias("rest"))
    both = beside.where("base IS NOT NULL").select("platform", "match_id", "base", F.explode("rest").alias("r")).select("r.policy", "platform", "match_id", "r.loss", "base")
    return rounded(resampling.cluster_bootstrap(both.withColumn("difference", F.col("loss") - F.col("base")), "policy", "match_id", "platform", "difference", 200, 35))


@query(f"""WITH p AS ({KNOWN["policy_predictions"]}) SELECT policy, coalesce(missing_reason, 'predicted') AS reason, count(*) AS n FROM p GROUP BY 1, 2""")
def abstention_reasons(spark, sf_dir):
    reason = F.coalesce("missing_reason", F.lit("predicted")).alias("reason")
    return predictions(spark, sf_dir).groupBy("policy", reason).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OBSERVED}, a AS (SELECT DISTINCT age FROM matchups), w AS (SELECT range AS oldest_age FROM range(0, 6))
SELECT oldest_age, array_to_string(list_transform(range(0, oldest_age + 1), lambda x: '26.' || (15 - x)), ',') AS considered,
    coalesce((SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT range AS m FROM range(0, 6)) t WHERE m <= oldest_age AND m NOT IN (SELECT age FROM a)), '') AS missing_ages FROM w""")
def window_patches(spark, sf_dir):
    return aggregates.window_patches(opponents.matchups(observed(spark, sf_dir)), TARGET)


@query(f"""WITH {CONTEXT}, h AS (SELECT unnest(['champion_id', 'position', 'public_patch']) AS field, unnest([champion_id::VARCHAR, position, public_patch]) AS value FROM placed JOIN matches USING (match_id))
SELECT field, coalesce(value, '<missing>') AS value, count(*) AS n FROM h GROUP BY 1, 2""")
def histograms(spark, sf_dir):
    t = tables(spark, sf_dir)
    rows = quality.with_positions(t.participants).join(t.matches.select("match_id", "public_patch"), "match_id")
    return audits.histogram(rows, "champion_id", "position", "public_patch")


@query("""WITH r AS (SELECT event_type, event_id % 3 AS y, 0.2::DOUBLE + event_id % 5 * 0.1::DOUBLE AS p0, 0.25::DOUBLE AS p1, 0.55::DOUBLE - event_id % 5 * 0.1::DOUBLE AS p2, (1 + event_id % 2)::DOUBLE AS w FROM events),
c AS (SELECT *, greatest(p0, p1, p2) AS conf, (list_position([p0, p1, p2], greatest(p0, p1, p2)) - 1 = y)::INTEGER AS hit FROM r),
g AS (SELECT event_type, abs(sum(w * hit) - sum(w * conf)) AS gap FROM c, range(0, 10) b(i) WHERE conf >= i * 0.1::DOUBLE AND conf < i * 0.1::DOUBLE + 0.1::DOUBLE + 1e-12::DOUBLE GROUP BY event_type, i),
e AS (SELECT event_type, sum(gap) AS gap FROM g GROUP BY event_type)
SELECT event_type, sum(w) AS match_weight, round(any_value(gap) / sum(w), 6) AS ece, count(*) FILTER (y = 0) AS n_class_0, count(*) FILTER (y = 1) AS n_class_1, count(*) FILTER (y = 2) AS n_class_2 FROM c JOIN e USING (event_type) GROUP BY event_type""")
def multiclass_calibration(spark, sf_dir):
    k = F.col("event_id")
    rows = series_lens.history(spark, sf_dir).select("event_type", (k % 3).cast("int").alias("y"), (0.2 + k % 5 * 0.1).alias("p0"), F.lit(0.25).alias("p1"), (0.55 - k % 5 * 0.1).alias("p2"), (1 + k % 2).cast("double").alias("w"))
    return rounded(audits.multiclass_calibration(rows, "y", ["p0", "p1", "p2"], "w", "event_type"))
