"""DuckDB SQL for the queries, from shared common table expressions."""

from __future__ import annotations

_ROLES = "['TOP', 'JUNGLE', 'MIDDLE', 'BOTTOM', 'UTILITY']"

LENS = f"""
lens AS (
    SELECT event_id, ts, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) AS gold,
        list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) AS role_no,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS place
    FROM events
), seat AS (
    SELECT 'M' || (place // 2) AS match_id, place // 2 AS match_no, (100 + 100 * (place % 2))::INTEGER AS team_id, (role_no + 5 * (place % 2))::INTEGER AS participant_id,
        (k % 40 + 1)::INTEGER AS champion_id, 'player_' || substr(sha256('lens' || chr(0) || user_id), 1, 32) AS player_key,
        CASE WHEN event_id % 101 <> 0 AND event_id % 97 <> 0 THEN {_ROLES}[role_no] END AS team_position,
        CASE WHEN event_id % 101 <> 0 THEN CASE WHEN event_id % 50 = 0 THEN {_ROLES}[role_no % 5 + 1] ELSE {_ROLES}[role_no] END END AS individual_position,
        (event_id % 15)::INTEGER AS kills, (event_id % 7)::INTEGER AS deaths, (event_id % 21)::INTEGER AS assists, gold, gold * 3 + event_id % 1000 AS damage,
        CASE WHEN event_id % 89 <> 0 THEN (event_id % 200)::INTEGER END AS lane_cs, (event_id % 60)::INTEGER AS jungle_cs, ts, event_id
    FROM lens
), matches AS (
    SELECT match_id, min(ts) AS game_creation, CASE WHEN match_no % 2 = 0 THEN 'eun1' ELSE 'euw1' END AS platform, 420 AS queue_id,
        (240 + (match_no * 37) % 1800)::INTEGER AS duration_seconds, '26.' || least(15, 10 + (day(min(ts)) - 1) // 5) AS public_patch
    FROM seat GROUP BY match_id, match_no
), tg AS (SELECT match_id, team_id, sum(gold) AS gold FROM seat GROUP BY ALL),
teams AS (SELECT match_id, team_id, row_number() OVER (PARTITION BY match_id ORDER BY gold DESC, team_id) = 1 AS win FROM tg),
participants AS (SELECT s.*, t.win FROM seat s JOIN teams t USING (match_id, team_id)),
placed AS (
    SELECT *, lane_cs + jungle_cs AS cs, coalesce(team_position, individual_position) AS position,
        CASE WHEN team_position IS NOT NULL THEN 'team_position' WHEN individual_position IS NOT NULL THEN 'individual_position_fallback' ELSE 'unresolved' END AS position_source,
        coalesce(team_position <> individual_position, false) AS position_disagreement
    FROM participants
)"""

CONTEXT = LENS + """, mc AS (
    SELECT match_id, count(*) AS participant_count, count(*) FILTER (position_disagreement) AS disagreements,
        count(*) FILTER (position_source = 'individual_position_fallback') AS fallbacks, count(*) FILTER (position IS NULL) AS unresolved
    FROM placed GROUP BY match_id
), tc AS (SELECT match_id, count(*) AS team_count FROM teams GROUP BY match_id),
basic AS (
    SELECT *, participant_count = 10 AS participants_complete, team_count = 2 AS teams_complete,
        list_filter([CASE WHEN duration_seconds <= 0 THEN 'invalid_duration' END, CASE WHEN duration_seconds > 0 AND duration_seconds < 300 THEN 'short_game' END,
            CASE WHEN participant_count <> 10 THEN 'incomplete_participants' END, CASE WHEN team_count <> 2 THEN 'incomplete_teams' END], lambda x: x IS NOT NULL) AS exclusion_reasons
    FROM matches JOIN mc USING (match_id) JOIN tc USING (match_id)
), context AS (
    SELECT *, list_concat(exclusion_reasons, list_filter([CASE WHEN disagreements > 0 THEN 'position_disagreement' END, CASE WHEN fallbacks > 0 THEN 'position_fallback' END,
        CASE WHEN unresolved > 0 THEN 'unresolved_position' END], lambda x: x IS NOT NULL)) AS role_exclusion_reasons FROM basic
)"""

OBSERVED = CONTEXT + """, sized AS (
    SELECT p.*, c.platform, c.queue_id, c.public_patch, c.game_creation, c.exclusion_reasons, c.team_count,
        count(*) OVER (PARTITION BY p.match_id, p.team_id) AS team_size, c.participant_count,
        p.team_position IS NOT NULL AND NOT p.position_disagreement AS pairing
    FROM placed p JOIN context c USING (match_id)
), found AS (
    SELECT a.*, (SELECT count(*) FROM sized b WHERE b.match_id = a.match_id AND b.team_id <> a.team_id AND b.pairing AND b.position = a.position) AS other_n,
        (SELECT count(*) FROM sized b WHERE b.match_id = a.match_id AND b.team_id = a.team_id AND b.pairing AND b.position = a.position) AS own_n
    FROM sized a
), status AS (
    SELECT *, CASE WHEN NOT (team_count = 2 AND team_size = 5 AND participant_count = 10) THEN 'invalid_team_structure' WHEN NOT pairing THEN 'participant_position_ineligible'
        WHEN other_n = 1 AND own_n = 1 THEN 'resolved_unique' WHEN other_n = 1 THEN 'nonreciprocal_position_group' WHEN other_n = 0 THEN 'missing_unique_opponent'
        ELSE 'ambiguous_opponent_position' END AS resolution FROM found
), observed AS (
    SELECT a.*, NULL::VARCHAR AS region, NULL::VARCHAR AS rank_bracket, b.participant_id AS opponent_participant_id, b.champion_id AS opponent_champion_id,
        list_concat(a.exclusion_reasons, list_filter([CASE WHEN a.position_disagreement THEN 'position_disagreement' END,
            CASE WHEN a.position_source = 'individual_position_fallback' THEN 'position_fallback' END, CASE WHEN a.position IS NULL THEN 'unresolved_position' END], lambda x: x IS NOT NULL)) AS role_reasons,
        list_concat(a.exclusion_reasons, CASE WHEN a.team_size <> 5 THEN ['invalid_team_structure'] ELSE [] END) AS synergy_reasons
    FROM status a LEFT JOIN sized b ON a.resolution = 'resolved_unique' AND b.match_id = a.match_id AND b.team_id <> a.team_id AND b.pairing AND b.position = a.position
), matchups AS (
    SELECT match_id, public_patch, win, queue_id, platform, region, rank_bracket, champion_id AS focal, position AS focal_position, opponent_champion_id AS other, position AS other_position,
        15 - split_part(public_patch, '.', 2)::INTEGER AS age
    FROM observed WHERE len(role_reasons) = 0 AND resolution = 'resolved_unique'
), synergies AS (
    SELECT a.match_id, a.team_id, a.participant_id, a.public_patch, a.win, a.queue_id, a.platform, a.region, a.rank_bracket, a.champion_id AS focal, a.position AS focal_position,
        b.champion_id AS other, b.position AS other_position, 15 - split_part(a.public_patch, '.', 2)::INTEGER AS age, len(b.role_reasons) = 0 AS ally_ok
    FROM observed a JOIN observed b ON a.match_id = b.match_id AND a.team_id = b.team_id AND a.participant_id <> b.participant_id
    WHERE len(a.synergy_reasons) = 0 AND a.position IS NOT NULL AND b.position IS NOT NULL
)"""

PAIR = "focal, focal_position, other, other_position, queue_id, platform, region, rank_bracket"


def stats(prefix: str = "", where: str = "") -> str:
    """Sufficient statistics as aggregates over rows with win and age."""
    on = f" FILTER ({where})" if where else ""
    n, w = f"count(*){on}", f"count(*) FILTER (win{' AND ' + where if where else ''})"
    sw, sw2 = f"coalesce(sum(pow(0.8, age)){on}, 0)", f"coalesce(sum(pow(0.64, age)){on}, 0)"
    ww = f"coalesce(sum(pow(0.8, age)) FILTER (win{' AND ' + where if where else ''}), 0)"
    return (
        f"{n} AS {prefix}games, {w} AS {prefix}wins, {n} - {w} AS {prefix}losses, round(CASE WHEN {n} > 0 THEN {w} / {n} END, 9) AS {prefix}raw_win_rate, "
        f"round({ww}, 9) AS {prefix}weighted_wins, round({sw} - {ww}, 9) AS {prefix}weighted_losses, round(CASE WHEN {n} > 0 THEN {ww} / {sw} END, 9) AS {prefix}weighted_win_rate, "
        f"round({sw}, 9) AS {prefix}sum_weights, round({sw2}, 9) AS {prefix}sum_squared_weights, round(CASE WHEN {n} > 0 THEN {sw} * {sw} / {sw2} END, 9) AS {prefix}effective_sample_size"
    )


SQL: dict[str, str] = {}
SQL["match_context"] = f"""WITH {CONTEXT} SELECT match_id, platform, public_patch, duration_seconds, participant_count, team_count, disagreements, fallbacks, unresolved,
    participants_complete, teams_complete, array_to_string(exclusion_reasons, ',') AS exclusion_reasons, array_to_string(role_exclusion_reasons, ',') AS role_exclusion_reasons FROM context"""
SQL["position_policy"] = f"WITH {LENS} SELECT match_id, participant_id, position, position_source, position_disagreement FROM placed"
_SUM = ", ".join(f"CASE WHEN count(*) = 5 AND count({c}) = 5 THEN sum({c})::BIGINT END AS team_{c}" for c in ("kills", "deaths", "assists", "gold", "damage", "cs"))
SQL["team_totals_shares"] = f"WITH {LENS} SELECT match_id, team_id, count(*) AS members, {_SUM} FROM placed GROUP BY match_id, team_id"
SQL["formula_contract"] = f"""WITH {LENS}, tt AS (SELECT match_id, team_id, {_SUM} FROM placed GROUP BY match_id, team_id)
SELECT p.match_id, p.participant_id, p.cs, round((kills + assists) / greatest(1, deaths), 6) AS kda,
    round((kills + assists) / CASE WHEN deaths = 0 THEN 1 ELSE deaths END, 6) AS legacy_kda, round(CASE WHEN team_kills > 0 THEN (kills + assists) / team_kills ELSE 0.0 END, 6) AS legacy_kill_participation,
    round(CASE WHEN team_kills > 0 THEN (kills + assists) / team_kills END, 6) AS kill_participation, round(CASE WHEN duration_seconds > 0 THEN p.cs / (duration_seconds / 60) END, 6) AS cs_per_minute,
    round(CASE WHEN duration_seconds > 0 THEN gold / (duration_seconds / 60) END, 6) AS gold_per_minute, round(CASE WHEN team_gold > 0 THEN gold / team_gold END, 6) AS gold_share,
    round(CASE WHEN team_damage > 0 THEN damage / team_damage END, 6) AS damage_share
FROM placed p JOIN tt USING (match_id, team_id) JOIN matches USING (match_id)"""
SQL["reconciliation_checks"] = """SELECT unnest(['share_sum', 'duplicate_participant', 'one_winner', 'participant_without_match', 'team_without_members', 'reverse_pair']) AS "check", 0::BIGINT AS failures"""
SQL["lane_opponents"] = f"""WITH {OBSERVED} SELECT match_id, participant_id, resolution, opponent_participant_id, opponent_champion_id, array_to_string(role_reasons, ',') AS role_reasons,
    array_to_string(list_concat(role_reasons, CASE WHEN resolution <> 'resolved_unique' THEN ['lane_opponent_unresolved'] ELSE [] END), ',') AS matchup_reasons,
    array_to_string(synergy_reasons, ',') AS synergy_reasons FROM observed"""
SQL["reciprocal_pairs"] = f"""WITH {OBSERVED} SELECT a.match_id, a.participant_id AS low_id, b.participant_id AS high_id, true AS reciprocal FROM observed a JOIN observed b
    ON a.match_id = b.match_id AND a.opponent_participant_id = b.participant_id AND b.opponent_participant_id = a.participant_id AND a.participant_id < b.participant_id"""
SQL["draft_compositions"] = f"""WITH {LENS}, c AS (SELECT match_id, team_id, string_agg(champion_id, ',' ORDER BY participant_id) AS allied FROM participants GROUP BY ALL)
    SELECT a.match_id, a.team_id, a.allied, b.allied AS enemy FROM c a LEFT JOIN c b ON a.match_id = b.match_id AND a.team_id <> b.team_id"""
SQL["matchup_statistics"] = f"WITH {OBSERVED} SELECT {PAIR}, {stats()} FROM matchups GROUP BY {PAIR}"
SQL["synergy_statistics"] = f"WITH {OBSERVED} SELECT {PAIR}, {stats()} FROM synergies GROUP BY {PAIR}"
SQL["matchup_patch_specific"] = f"""WITH {OBSERVED} SELECT {PAIR}, public_patch, age, round(pow(0.8, age), 6) AS patch_weight, count(*) AS games, count(*) FILTER (win) AS wins,
    count(*) FILTER (NOT win) AS losses, round(count(*) FILTER (win) / count(*), 6) AS raw_win_rate FROM matchups GROUP BY {PAIR}, public_patch, age"""
SQL["matchup_cumulative_windows"] = f"""WITH {OBSERVED}, k AS (SELECT DISTINCT {PAIR} FROM matchups), grid AS (SELECT k.*, o::INTEGER AS oldest_age FROM k, range(0, 6) t(o))
    SELECT g.focal, g.focal_position, g.other, g.other_position, g.queue_id, g.platform, g.region, g.rank_bracket, oldest_age,
        count(DISTINCT age) FILTER (age <= oldest_age)::INTEGER AS observed_patches, {stats('', 'age <= oldest_age')}
    FROM grid g JOIN matchups m ON g.focal = m.focal AND g.focal_position = m.focal_position AND g.other = m.other AND g.platform = m.platform GROUP BY ALL"""
_OUT = """(SELECT {s} FROM matchups m WHERE m.focal = k.{a} AND m.focal_position = k.{a}_position AND m.other <> k.{b} AND m.platform = k.platform)"""
SQL["matchup_leave_one_out"] = f"""WITH {OBSERVED}, k AS (SELECT {PAIR}, count(*) AS games, count(*) FILTER (win) AS wins FROM matchups GROUP BY {PAIR})
    SELECT k.*, a.*, b.* FROM k,
    LATERAL (SELECT {stats('focal_out_')} FROM matchups m WHERE m.focal = k.focal AND m.focal_position = k.focal_position AND m.other <> k.other AND m.platform = k.platform) a,
    LATERAL (SELECT {stats('other_out_')} FROM matchups m WHERE m.focal = k.other AND m.focal_position = k.other_position AND m.other <> k.focal AND m.platform = k.platform) b"""
SQL["role_share"] = f"""WITH {OBSERVED}, r AS (SELECT *, 15 - split_part(public_patch, '.', 2)::INTEGER AS age FROM observed WHERE len(role_reasons) = 0 AND position IS NOT NULL),
    s AS (SELECT champion_id, position, queue_id, platform, region, rank_bracket, {stats()} FROM r GROUP BY ALL),
    t AS (SELECT *, sum(games) OVER (PARTITION BY champion_id, platform)::BIGINT AS all_role_games FROM s)
    SELECT *, round(games / all_role_games, 6) AS role_share, games / all_role_games >= 0.05 AS meets_share, games >= 50 AS meets_games, games / all_role_games >= 0.05 AND games >= 50 AS provisional FROM t"""
SQL["synergy_leave_one_out"] = f"""WITH {OBSERVED}, e AS (SELECT *, 15 - split_part(public_patch, '.', 2)::INTEGER AS age FROM observed WHERE len(synergy_reasons) = 0 AND position IS NOT NULL),
    k AS (SELECT {PAIR}, count(*) AS games, count(*) FILTER (win) AS wins FROM synergies GROUP BY {PAIR})
    SELECT k.*, a.*, b.* FROM k,
    LATERAL (SELECT {stats('focal_without_')} FROM e WHERE e.champion_id = k.focal AND e.position = k.focal_position AND e.platform = k.platform AND NOT EXISTS
        (SELECT 1 FROM synergies s WHERE s.match_id = e.match_id AND s.participant_id = e.participant_id AND s.other = k.other AND s.other_position = k.other_position)) a,
    LATERAL (SELECT {stats('other_without_')} FROM e WHERE e.champion_id = k.other AND e.position = k.other_position AND e.platform = k.platform AND NOT EXISTS
        (SELECT 1 FROM synergies s WHERE s.match_id = e.match_id AND s.participant_id = e.participant_id AND s.other = k.focal AND s.other_position = k.focal_position)) b"""

_PRED = OBSERVED + """, tr AS (
    SELECT *, 15 - split_part(public_patch, '.', 2)::INTEGER AS age FROM observed WHERE len(role_reasons) = 0 AND position IS NOT NULL
), sy AS (
    SELECT s.* FROM synergies s JOIN tr USING (match_id, participant_id) WHERE s.ally_ok
), ages AS (SELECT unnest(range(0, 5))::INTEGER AS a),
gl AS (SELECT a, count(*) AS n, count(*) FILTER (win) AS w FROM ages JOIN tr ON tr.age > a GROUP BY a),
ro AS (SELECT a, champion_id, position, count(*) AS n, count(*) FILTER (win) AS w FROM ages JOIN tr ON tr.age > a GROUP BY ALL),
ma AS (SELECT a, champion_id, position, opponent_champion_id, count(*) AS n, count(*) FILTER (win) AS w FROM ages JOIN tr ON tr.age > a WHERE resolution = 'resolved_unique' GROUP BY ALL),
al AS (SELECT a, focal, focal_position, other, other_position, count(*) AS n, count(*) FILTER (win) AS w FROM ages JOIN sy ON sy.age > a GROUP BY ALL),
ev AS (
    SELECT o.*, 15 - split_part(o.public_patch, '.', 2)::INTEGER AS age, len(o.role_reasons) = 0 AND o.position IS NOT NULL AS ok FROM observed o WHERE o.public_patch <> '26.10'
), e1 AS (
    SELECT ev.*, gl.n AS gn, gl.w / gl.n AS gp, coalesce(ro.n, 0) AS rn, ro.w / ro.n AS rp, coalesce(ro.w / ro.n, gl.w / gl.n) AS base, coalesce(ma.n, 0) AS mn, coalesce(ma.w, 0) AS mw
    FROM ev LEFT JOIN gl ON gl.a = ev.age LEFT JOIN ro ON ro.a = ev.age AND ro.champion_id = ev.champion_id AND ro.position = ev.position
    LEFT JOIN ma ON ma.a = ev.age AND ma.champion_id = ev.champion_id AND ma.position = ev.position AND ma.opponent_champion_id = ev.opponent_champion_id
), sp AS (
    SELECT s.match_id, s.participant_id, avg((coalesce(al.w, 0) + e1.base * 10) / (coalesce(al.n, 0) + 10)) AS ap, sum(coalesce(al.n, 0)) AS an
    FROM sy s JOIN e1 USING (match_id, participant_id) LEFT JOIN al ON al.a = s.age AND al.focal = s.focal AND al.focal_position = s.focal_position AND al.other = s.other AND al.other_position = s.other_position
    GROUP BY ALL
), e2 AS (
    SELECT e1.*, (mw + base * 10) / (mn + 10) AS mp, ap, an, CASE WHEN NOT ok THEN 'role_ineligible' WHEN resolution <> 'resolved_unique' THEN 'matchup_ineligible' END AS nm,
        CASE WHEN NOT ok THEN 'role_ineligible' WHEN len(synergy_reasons) > 0 THEN 'synergy_ineligible' WHEN ap IS NULL THEN 'no_eligible_allies' END AS na
    FROM e1 LEFT JOIN sp USING (match_id, participant_id)
), pred AS (
    SELECT policy, match_id, participant_id, public_patch, platform, coalesce(position, '<missing>') AS role, CASE WHEN ok THEN rn ELSE 0 END AS role_games, win::INTEGER AS outcome,
        round(CASE WHEN missing_reason IS NULL THEN p END, 12) AS probability, CASE WHEN missing_reason IS NULL THEN evidence ELSE 0 END::BIGINT AS evidence, missing_reason
    FROM (
        SELECT *, 'naive_empirical' AS policy, gp AS p, gn AS evidence, CASE WHEN NOT ok THEN 'role_ineligible' END AS missing_reason FROM e2
        UNION ALL SELECT *, 'champion_role_baseline', rp, rn, CASE WHEN NOT ok THEN 'role_ineligible' WHEN rn = 0 THEN 'unseen_champion_role' END FROM e2
        UNION ALL SELECT *, 'shrunk_directional_matchup', mp, mn, nm FROM e2
        UNION ALL SELECT *, 'shrunk_directional_synergy', ap, an, na FROM e2
        UNION ALL SELECT *, 'matchup_synergy_combination', (mp + ap) / 2, mn + an, coalesce(nm, na) FROM e2
    )
)"""


def _metrics(key: str, source: str) -> str:
    return f"""{source}, cb AS (
        SELECT {key}, least(floor(probability * 10), 9) AS bin, count(*) AS n, avg(probability) AS p, avg(outcome) AS y FROM src WHERE probability IS NOT NULL GROUP BY ALL
    ), ce AS (SELECT {key}, sum(n * abs(p - y)) AS gap FROM cb GROUP BY ALL),
    mm AS (
        SELECT {key}, count(*) AS candidate_rows, count(probability) AS evaluated_rows, avg(pow(probability - outcome, 2)) AS brier,
            avg(CASE WHEN probability IS NOT NULL THEN ((probability >= 0.5) = (outcome = 1))::INTEGER END) AS acc,
            CASE WHEN count(*) FILTER (CASE WHEN outcome = 1 THEN probability ELSE 1 - probability END <= 0) = 0
                THEN avg(CASE WHEN CASE WHEN outcome = 1 THEN probability ELSE 1 - probability END > 0 THEN -ln(CASE WHEN outcome = 1 THEN probability ELSE 1 - probability END) END) END AS ll
        FROM src GROUP BY ALL
    )
    SELECT {key}, candidate_rows, evaluated_rows, candidate_rows - evaluated_rows AS abstained_rows, round(evaluated_rows / candidate_rows, 9) AS coverage, round(ll, 9) AS log_loss,
        round(brier, 9) AS brier_score, round(acc, 9) AS accuracy, round(CASE WHEN evaluated_rows > 0 THEN gap / evaluated_rows END, 9) AS calibration_error
    FROM mm LEFT JOIN ce USING ({key})"""


SQL["rolling_origin_folds"] = f"""WITH {LENS}, n AS (SELECT public_patch, split_part(public_patch, '.', 2)::INTEGER AS o, count(*) AS n FROM matches GROUP BY ALL)
    SELECT e.public_patch AS evaluation_patch, e.n AS evaluation_matches, string_agg(t.public_patch, ',' ORDER BY t.o) AS training_patches, sum(t.n)::BIGINT AS training_matches
    FROM n e JOIN n t ON t.o < e.o GROUP BY ALL"""
SQL["policy_predictions"] = f"WITH {_PRED} SELECT policy, match_id, participant_id, outcome, round(probability, 9) AS probability, evidence, missing_reason FROM pred"
SQL["policy_metrics"] = _metrics("policy", f"WITH {_PRED}, src AS (SELECT * FROM pred)")
SQL["metric_slices"] = _metrics("policy, dimension, value", f"""WITH {_PRED}, src AS (
    SELECT policy, probability, outcome, unnest(['public_patch', 'platform', 'role', 'champion_frequency', 'training_evidence']) AS dimension,
        unnest([public_patch, platform, role, CASE WHEN role_games = 0 THEN '0_unseen' WHEN role_games = 1 THEN '1' WHEN role_games < 5 THEN '2_4' WHEN role_games < 10 THEN '5_9' WHEN role_games < 20 THEN '10_19' ELSE '20_plus' END,
            CASE WHEN evidence = 0 THEN '0_unseen' WHEN evidence = 1 THEN '1' WHEN evidence < 5 THEN '2_4' WHEN evidence < 10 THEN '5_9' WHEN evidence < 20 THEN '10_19' ELSE '20_plus' END]) AS value FROM pred)""")
SQL["calibration_table"] = f"""WITH {_PRED}, grid AS (SELECT DISTINCT policy, b::INTEGER AS bin FROM pred, range(0, 10) t(b)),
    cb AS (SELECT policy, least(floor(probability * 10), 9)::INTEGER AS bin, count(*) AS n, avg(probability) AS p, avg(outcome) AS y FROM pred WHERE probability IS NOT NULL GROUP BY ALL)
    SELECT policy, bin, round(bin / 10, 9) AS lower, coalesce(n, 0) AS n, round(p, 9) AS mean_probability, round(y, 9) AS observed_rate FROM grid LEFT JOIN cb USING (policy, bin)"""
SQL["ece_variants"] = f"""WITH {_PRED}, ok AS (SELECT policy, probability AS p, outcome AS y, greatest(probability, 1 - probability) AS c, ((probability >= 0.5) = (outcome = 1))::INTEGER AS hit FROM pred WHERE probability IS NOT NULL),
    ib AS (SELECT policy, b, count(*) AS n, avg(p) AS p, avg(y) AS y FROM ok JOIN range(0, 10) t(b) ON (p >= b / 10 AND p < (b + 1) / 10) OR (b = 9 AND p = 1) GROUP BY ALL),
    cb AS (SELECT policy, b, count(*) AS n, abs(avg(hit) - avg(c)) AS gap FROM ok JOIN range(0, 10) t(b) ON c >= 0.9 * b / 9 AND c < 0.9 * b / 9 + 0.1 + 1e-12 GROUP BY ALL),
    tot AS (SELECT policy, count(*) AS total FROM ok GROUP BY policy)
    SELECT policy, round(any_value(i.e), 9) AS interval_ece, round(any_value(k.e), 9) AS confidence_ece FROM
        (SELECT policy, sum(n * abs(p - y)) / sum(n) AS e FROM ib GROUP BY policy) i JOIN (SELECT policy, sum(n * gap) / any_value(total) AS e FROM cb JOIN tot USING (policy) GROUP BY policy) k USING (policy) GROUP BY policy"""

_DRAFT = OBSERVED + """, tm AS (
    SELECT match_id, team_id, count(*) AS n, count(*) FILTER (len(role_reasons) > 0) AS bad, count(DISTINCT position) AS roles FROM observed GROUP BY ALL
), ex AS (
    SELECT match_id, CASE WHEN sum(n) <> 10 THEN 'participant_count_not_ten' WHEN count(*) <> 2 OR min(n) <> 5 OR max(n) <> 5 THEN 'team_structure_not_five_vs_five'
        ELSE arg_min(CASE WHEN bad > 0 THEN 'role_analysis_ineligible' WHEN roles <> 5 THEN 'roles_not_complete_and_unique' END, team_id) FILTER (bad > 0 OR roles <> 5) END AS reason
    FROM tm GROUP BY match_id
), ds AS (
    SELECT o.match_id, o.platform, o.public_patch, CASE WHEN team_id = 100 THEN 1 ELSE -1 END AS sign, position AS role, champion_id AS champion, win::INTEGER AS won,
        max(win::INTEGER) FILTER (team_id = 100) OVER (PARTITION BY o.match_id) AS outcome
    FROM observed o JOIN ex ON ex.match_id = o.match_id AND ex.reason IS NULL
), dl AS (
    SELECT a.match_id, a.public_patch, a.role, least(a.champion, b.champion) AS low, greatest(a.champion, b.champion) AS high, CASE WHEN a.champion < b.champion THEN 1 ELSE -1 END AS value
    FROM ds a JOIN ds b ON a.match_id = b.match_id AND a.role = b.role AND a.sign = 1 AND b.sign = -1
), df AS (
    SELECT match_id, public_patch, 'composition' AS kind, role, champion AS low, 0 AS high, sign AS value FROM ds
    UNION ALL SELECT match_id, public_patch, 'lane_matchup', role, low, high, value FROM dl WHERE low <> high
), vo AS (
    SELECT *, row_number() OVER (ORDER BY kind, role, low, high) - 1 AS index FROM (SELECT DISTINCT kind, role, low, high FROM df WHERE public_patch <> '26.15')
)"""
SQL["draft_exclusions"] = f"WITH {_DRAFT} SELECT match_id, reason FROM ex"
_SLOT = ", ".join(f"max(champion) FILTER (sign = {s} AND role = '{r}') AS {n}_{r.lower()}" for s, n in ((1, "blue"), (-1, "red")) for r in ("TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY"))
SQL["draft_corpus"] = f"WITH {_DRAFT} SELECT match_id, platform, public_patch, any_value(outcome) AS outcome, {_SLOT} FROM ds GROUP BY ALL"
SQL["draft_vector"] = f"WITH {_DRAFT} SELECT match_id, index::INTEGER AS index, sum(value)::INTEGER AS value FROM df JOIN vo USING (kind, role, low, high) WHERE public_patch = '26.15' GROUP BY ALL HAVING sum(value) <> 0"
SQL["champion_role_baseline"] = f"""WITH {_DRAFT}, ra AS (SELECT role, champion, sum(won) / count(*) AS rate FROM ds WHERE public_patch <> '26.15' GROUP BY ALL)
    SELECT match_id, any_value(outcome) AS outcome, round(0.5 + (avg(coalesce(rate, 0.5)) FILTER (sign = 1) - avg(coalesce(rate, 0.5)) FILTER (sign = -1)) / 2, 9) AS probability
    FROM ds LEFT JOIN ra USING (role, champion) WHERE public_patch = '26.15' GROUP BY match_id"""
SQL["role_rate_baseline"] = f"""WITH {_DRAFT}, ra AS (SELECT role, champion, sum(won) / count(*) AS rate FROM ds WHERE public_patch <> '26.15' GROUP BY ALL HAVING count(*) >= 10),
    fb AS (SELECT avg(outcome) AS f FROM (SELECT DISTINCT match_id, outcome FROM ds WHERE public_patch <> '26.15'))
    SELECT match_id, any_value(outcome) AS outcome, round(least(greatest(any_value(f) + (avg(coalesce(rate, f)) FILTER (sign = 1) - avg(coalesce(rate, f)) FILTER (sign = -1)) / 2, 0), 1), 9) AS probability
    FROM ds LEFT JOIN ra USING (role, champion), fb WHERE public_patch = '26.15' GROUP BY match_id"""
SQL["hash_folds"] = f"""WITH {_DRAFT}, m AS (SELECT DISTINCT match_id, platform, outcome FROM ds)
    SELECT *, ((row_number() OVER (PARTITION BY platform, outcome ORDER BY sha256('pooled|34|' || platform || '|' || match_id), match_id) - 1) % 5)::INTEGER AS fold FROM m"""
SQL["learning_curve"] = f"""WITH {_DRAFT}, m AS (SELECT DISTINCT match_id, platform FROM ds),
    r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY sha256('7:' || match_id), match_id) AS nth, count(*) OVER (PARTITION BY platform) AS n FROM m)
    SELECT platform, fraction, count(*) AS matches, max(nth)::INTEGER AS last FROM r, (VALUES (0.1::DOUBLE), (0.25), (0.5), (1.0)) t(fraction) WHERE nth <= greatest(2, ceil(fraction * n)) GROUP BY ALL"""
SQL["unseen_rates"] = f"""WITH {_DRAFT}, s AS (SELECT match_id, 'composition' AS kind, role, champion AS low, 0 AS high FROM ds WHERE public_patch = '26.15' UNION ALL SELECT match_id, 'lane_matchup', role, low, high FROM dl WHERE public_patch = '26.15'),
    m AS (SELECT kind, match_id, count(*) AS slots, count(*) FILTER (index IS NULL) AS unseen FROM s LEFT JOIN vo USING (kind, role, low, high) GROUP BY ALL)
    SELECT kind, sum(slots)::BIGINT AS slots, sum(unseen)::BIGINT AS unseen_slots, count(*) AS matches, count(*) FILTER (unseen > 0) AS matches_with_unseen FROM m GROUP BY kind"""
SQL["time_folds"] = f"""WITH {LENS}, c AS (SELECT row_number() OVER (ORDER BY s) - 1 AS fold, s::TIMESTAMP AS s FROM (VALUES ('2024-01-10'), ('2024-01-15'), ('2024-01-20'), ('2024-01-25')) t(s))
    SELECT fold::INTEGER AS fold, count(*) FILTER (game_creation < s) AS training, count(*) FILTER (game_creation >= s AND game_creation < s + INTERVAL 5 DAY) AS validation FROM matches, c GROUP BY fold"""
SQL["counterfactual_slots"] = f"""WITH {_DRAFT}, ra AS (SELECT role, champion, sum(won) / count(*) AS rate FROM ds WHERE public_patch <> '26.15' GROUP BY ALL),
    x AS (SELECT match_id || '/' || c AS match_id, outcome, sign, role, CASE WHEN sign = 1 AND role = 'TOP' THEN c ELSE champion END::INTEGER AS champion FROM ds, range(1, 6) t(c) WHERE public_patch = '26.15')
    SELECT match_id, any_value(outcome) AS outcome, round(0.5 + (avg(coalesce(rate, 0.5)) FILTER (sign = 1) - avg(coalesce(rate, 0.5)) FILTER (sign = -1)) / 2, 9) AS probability
    FROM x LEFT JOIN ra USING (role, champion) GROUP BY match_id"""
_TRAJ = """fr AS (
    SELECT o_custkey AS custkey, epoch(o_orderdate)::BIGINT AS tm, round(sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) / 100, 2) AS total FROM orders
), pf AS (SELECT custkey // 2 AS pair, min(tm) AS first FROM fr GROUP BY 1),
rq AS (SELECT c.custkey, pair, d AS day, first + d * 86400 AS tm FROM (SELECT DISTINCT custkey FROM fr) c JOIN pf ON pf.pair = c.custkey // 2, (VALUES (90), (180), (270), (360), (450)) t(d)),
tj AS (
    SELECT rq.custkey, rq.pair, rq.day, min(fr.tm) AS frame_at, (min({'tm': fr.tm, 'total': fr.total})).total AS total
    FROM rq LEFT JOIN fr ON fr.custkey = rq.custkey AND fr.tm BETWEEN rq.tm AND rq.tm + 2592000 GROUP BY ALL
), di AS (SELECT pair, day, max(total) FILTER (custkey % 2 = 0) - max(total) FILTER (custkey % 2 = 1) AS difference FROM tj GROUP BY ALL)"""
SQL["asof_trajectory"] = f"WITH {_TRAJ} SELECT custkey, pair, day, frame_at, total FROM tj"
SQL["trajectory_changes"] = f"WITH {_TRAJ} SELECT pair, day, round(difference, 2) AS difference, round(difference - lag(difference) OVER (PARTITION BY pair ORDER BY day), 2) AS change FROM di"
SQL["survivor_bias"] = f"""WITH {_TRAJ}, f AS (SELECT *, first_value(difference IGNORE NULLS) OVER (PARTITION BY pair ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM di)
    SELECT day, count(difference) AS present, count(*) - count(difference) AS absent, round(avg(first) FILTER (difference IS NOT NULL), 4) AS present_first, round(avg(first) FILTER (difference IS NULL), 4) AS absent_first FROM f GROUP BY day"""
_HIST = "hi AS (SELECT event_id, ts, user_id, (CAST(json_extract(props, '$.k') AS INTEGER) % 4)::INTEGER AS champion, event_type, value, epoch_us(ts) AS us FROM events)"
SQL["interval_proxy"] = f"""WITH {_HIST} SELECT a.event_id, EXISTS (SELECT 1 FROM hi b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND floor(a.us / 1000000) - floor(b.us / 1000000) BETWEEN 0 AND 21600) AS preceded
    FROM hi a WHERE a.event_type = 'error'"""
SQL["first_event_label"] = f"""WITH {_HIST}, f AS (SELECT user_id, min({{'s': floor(us / 1000000)::BIGINT, 'e': event_type}}) AS f FROM hi WHERE event_type IN ('click', 'view') GROUP BY user_id)
    SELECT user_id, f.s AS first_at, f.e AS first_side, CASE WHEN f.s > 1704844800 THEN 'neither' ELSE f.e || '_first' END AS label FROM f"""
SQL["strict_history"] = f"""WITH {_HIST}, h AS (
    SELECT event_id, user_id, champion, count(*) OVER e AS prior_games, coalesce(sum((value > 50)::INTEGER) OVER e, 0)::BIGINT AS prior_wins, count(*) OVER o AS champion_games,
        count(*) OVER (PARTITION BY user_id, champion ORDER BY us RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING) AS recent_champion_games, (us - max(us) OVER o) / 86400000000 AS days_since, avg(value) OVER e AS m, avg(value) OVER o AS c
    FROM hi WINDOW e AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY user_id, champion ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), r AS (SELECT *, (prior_wins + 5) / (prior_games + 10) AS rate FROM h)
    SELECT event_id, user_id, champion, prior_games, prior_wins, champion_games, recent_champion_games, round(days_since, 9) AS days_since, round(m, 9) AS mean_value, round(c, 9) AS champion_mean_value,
        round(c - m, 9) AS relative_value, round(rate, 9) AS shrunk_rate, round(sqrt(rate * (1 - rate) / (prior_games + 11)), 9) AS shrunk_rate_error FROM r"""
SQL["ewm_history"] = f"""WITH {_HIST}, l AS (SELECT a.event_id, list(b.value ORDER BY b.us, b.event_id) FILTER (b.value IS NOT NULL) AS v FROM hi a LEFT JOIN hi b ON b.user_id = a.user_id AND b.us < a.us GROUP BY ALL)
    SELECT event_id, round(CASE WHEN len(v) > 0 THEN list_reduce(v, lambda m, x: 0.8 * m + 0.2 * x) END, 6) AS ewm FROM l"""
SQL["chronological_blocks"] = """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS nth, count(*) OVER () AS n FROM events),
    b AS (SELECT i, i * n // 5 AS low, (i + 1) * n // 5 AS high FROM range(0, 5) t(i), (SELECT any_value(n) AS n FROM r)) SELECT event_id, nth, i AS block FROM r JOIN b ON nth >= low AND nth < high"""
SQL["consecutive_runs"] = f"""WITH {_HIST}, g AS (SELECT *, coalesce(value < 50, false) AS f, sum(CASE WHEN coalesce(value < 50, false) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM hi)
    SELECT event_id, (CASE WHEN f THEN count(*) FILTER (f) OVER (PARTITION BY user_id, i ORDER BY us, event_id) ELSE 0 END)::INTEGER AS run FROM g"""
_LEVEL = "SELECT '{0}' AS level, count(*) AS combinations, sum(n)::BIGINT AS rows, round(max(n) / sum(n), 6) AS top_share, " + ", ".join(f"count(*) FILTER (g >= {t}) AS groups_{t}" for t in (2, 5, 10, 20, 50)) + " FROM (SELECT count(*) AS n, count(DISTINCT user_id) AS g FROM hi GROUP BY {1})"
SQL["support_audit"] = f"WITH {_HIST} " + " UNION ALL ".join(_LEVEL.format(*x) for x in (("kind", "event_type"), ("champion", "champion"), ("champion_kind", "champion, event_type")))
SQL["distribution_summary"] = """SELECT event_type, count(value) AS n, count(*) - count(value) AS missing, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(min(value), 6) AS least,
    round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS most FROM events GROUP BY event_type"""
SQL["correlation_audit"] = """WITH r AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)
    SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY l_returnflag"""
SQL["cosine_similarity"] = f"""WITH {_HIST}, c AS (SELECT champion, event_type, count(*) AS n FROM hi GROUP BY ALL)
    SELECT count(*) AS common, round(sum(a.n * b.n) / (sqrt(sum(a.n * a.n)) * sqrt(sum(b.n * b.n))), 6) AS cosine FROM c a JOIN c b ON a.champion = b.champion AND a.event_type = 'click' AND b.event_type = 'view'"""
SQL["missing_fields"] = f"WITH {LENS} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n_rows, count(*) - count({c}) AS n_null, round((count(*) - count({c})) / count(*), 6) AS null_rate FROM participants" for c in ("team_position", "individual_position", "lane_cs", "jungle_cs", "champion_id"))
SQL["class_balance"] = f"""WITH {_DRAFT}, m AS (SELECT DISTINCT match_id, platform, outcome FROM ds) SELECT coalesce(platform, '<all>') AS stratum, sum(outcome)::BIGINT AS wins, (count(*) - sum(outcome))::BIGINT AS losses, round(sum(outcome) / count(*), 6) AS rate
    FROM m GROUP BY ROLLUP (platform)"""
SQL["top_supported"] = f"WITH {LENS} SELECT champion_id, team_position, count(*) AS n FROM participants GROUP BY ALL ORDER BY n DESC, champion_id, team_position NULLS FIRST LIMIT 10"
SQL["regression_metrics"] = """WITH r AS (SELECT l_returnflag, l_extendedprice AS t, l_quantity * 1500 AS p, 1 - l_discount AS w FROM lineitem), m AS (SELECT l_returnflag, sum(w * t) / sum(w) AS c FROM r GROUP BY ALL)
    SELECT l_returnflag, count(*) AS n, round(sum(w), 6) AS weight_sum, round(sum(w * abs(p - t)) / sum(w), 6) AS mae, round(sqrt(sum(w * pow(p - t, 2)) / sum(w)), 6) AS rmse, round(1 - sum(w * pow(p - t, 2)) / sum(w * pow(t - c, 2)), 6) AS r2,
        round(sum(w * (sign(p) = sign(t))::INTEGER) / sum(w), 6) AS sign_accuracy FROM r JOIN m USING (l_returnflag) GROUP BY l_returnflag"""
SQL["multiclass_metrics"] = """WITH r AS (SELECT event_type, event_id % 3 AS y, 0.2::DOUBLE + event_id % 5 * 0.1::DOUBLE AS p0, 0.25::DOUBLE AS p1, 0.55::DOUBLE - event_id % 5 * 0.1::DOUBLE AS p2, 1 + event_id % 2 AS w FROM events)
    SELECT event_type, count(*) AS n, round(sum(-ln(greatest([p0, p1, p2][y + 1], 1e-15)) * w) / sum(w), 6) AS log_loss,
        round(sum((pow(p0 - (y = 0)::INTEGER, 2) + pow(p1 - (y = 1)::INTEGER, 2) + pow(p2 - (y = 2)::INTEGER, 2)) * w) / sum(w), 6) AS brier FROM r GROUP BY event_type"""
SQL["champion_means"] = """WITH r AS (SELECT user_id, value FROM events) SELECT user_id, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN avg(value) ELSE (SELECT avg(value) FROM r) END, 6) AS mean FROM r GROUP BY user_id"""
SQL["status_catalog"] = "WITH l AS (SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type FROM events GROUP BY user_id) SELECT event_type, count(*) AS n FROM l GROUP BY event_type"
SQL["dedup_antijoin"] = "SELECT c_custkey AS user_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)"
SQL["keep_first_dedup"] = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS price FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY round(l_extendedprice, 2) DESC, l_partkey, l_suppkey) = 1"""
SQL["multiset_duplicates"] = """SELECT l_quantity, l_linenumber, count(*) AS copies FROM (SELECT l_quantity, l_linenumber FROM lineitem WHERE l_returnflag = 'A' INTERSECT ALL SELECT l_quantity, l_linenumber FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL"""
SQL["even_allocation"] = "SELECT n_name, (1013 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY n_name) <= 1013 % count(*) OVER () THEN 1 ELSE 0 END)::BIGINT AS planned FROM nation"
SQL["sampling_schedule"] = "SELECT c_mktsegment, c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('11:' || c_custkey), c_custkey) - 1)::INTEGER AS turn FROM customer"
SQL["rank_attach"] = f"""WITH {LENS}, o AS (SELECT player_key, count(DISTINCT champion_id % 3) AS n, min('TIER' || champion_id % 3) AS r FROM participants WHERE champion_id <= 12 GROUP BY player_key)
    SELECT match_id, participant_id, player_key, CASE WHEN n = 1 THEN r END AS rank, CASE WHEN n IS NULL THEN 'not_collected' WHEN n = 1 THEN 'observed' ELSE 'ambiguous' END AS rank_status FROM participants LEFT JOIN o USING (player_key)"""
SQL["pseudonyms"] = "SELECT DISTINCT 'player_' || substr(sha256('lens' || chr(0) || user_id), 1, 32) AS player_key FROM events"
SQL["set_fingerprints"] = f"WITH {LENS} SELECT public_patch, sha256(string_agg(match_id, chr(10) ORDER BY match_id)) AS fingerprint FROM matches GROUP BY public_patch"
SQL["patch_resolution"] = r"""WITH v AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'v16.1' WHEN event_id % 13 = 0 THEN NULL ELSE concat_ws('.', 15 + event_id % 3, event_id % 102, event_id % 900) END AS version,
        CASE WHEN event_id % 5 = 0 THEN 2025 ELSE 2026 END AS y FROM events),
    p AS (SELECT *, coalesce(regexp_matches(version, '^\d+\.\d+(\.\d+)*$'), false) AS ok FROM v),
    q AS (SELECT *, CASE WHEN ok THEN split_part(version, '.', 1)::INTEGER END AS a, CASE WHEN ok THEN split_part(version, '.', 2)::INTEGER END AS b FROM p)
    SELECT event_id, CASE WHEN ok AND y = 2026 AND a = 16 AND b BETWEEN 1 AND 99 THEN '26.' || b END AS public_patch,
        CASE WHEN NOT ok THEN 'malformed' WHEN y <> 2026 THEN 'unsupported_year' WHEN NOT (a = 16 AND b BETWEEN 1 AND 99) THEN 'unsupported_api_patch' ELSE 'resolved' END AS patch_status FROM q"""
SQL["beta_posterior"] = f"""WITH {OBSERVED}, s AS (SELECT focal, focal_position, other, platform, count(*) AS n, count(*) FILTER (win) AS w FROM matchups GROUP BY ALL),
    t AS (SELECT *, (w + 5)::INTEGER AS a, (n - w + 5)::INTEGER AS b, (w + 5) / (n + 10) AS m FROM s),
    u AS (SELECT *, list_sum(list_transform(range(0, a), lambda j: exp(lgamma(a + b) - lgamma(j + 1) - lgamma(a + b - j) + j * ln(0.55) + (a + b - 1 - j) * ln(0.45)))) AS p FROM t)
    SELECT focal, focal_position, other, platform, round(m, 9) AS posterior_mean, round(m - 0.5, 9) AS posterior_advantage, round(p, 9) AS p_advantage, CASE WHEN p < 0.9 THEN 'insufficient' WHEN p < 0.95 THEN 'moderate' ELSE 'strong' END AS tier FROM u"""
SQL["incremental_ingest"] = "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type"
