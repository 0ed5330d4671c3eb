"""Invariant checks (V*): each is one row of counts, unioned into a report."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftgrain.operators import box as B
from shiftgrain.operators import checks as K
from shiftgrain.plans.catalog import query

C = F.col


def _row(stage, name, kind, value, low, high):
    st = f"CASE WHEN v IS NULL THEN 'skip' WHEN v < {low} OR v > {high} THEN '{'fail' if kind == 'exact' else 'warn'}' ELSE 'pass' END"
    return f"SELECT '{stage}' AS stage, '{name}' AS name, '{kind}' AS kind, {st} AS status, round(v::DOUBLE, 6) AS observed, {low}::DOUBLE AS low, {high}::DOUBLE AS high FROM ({value})"


def _union(*rows):
    return " UNION ALL ".join(_row(*r) for r in rows)


@query("V1_shift_checks", _union(
    ("shifts", "duration is end minus start and positive", "exact", "SELECT count(*) FILTER (duration_s <> end_g - start_g OR duration_s <= 0) AS v FROM shifts", 0, 0),
    ("shifts", "no overlap per player", "exact", "SELECT count(*) AS v FROM shifts a JOIN shifts b ON a.game_id = b.game_id AND a.player_id = b.player_id AND b.shift_number = a.shift_number + 1 AND b.start_g < a.end_g", 0, 0),
    ("shots", "unique (game, event)", "exact", "SELECT count(*) AS v FROM (SELECT 1 FROM shots GROUP BY game_id, event_idx HAVING count(*) > 1)", 0, 0)))
def v1(t):
    return K.combine(K.check_shifts(t.shifts), K.check_unique_shots(t.shots))


@query("V2_stint_checks", _union(
    ("stints", "duration", "exact", "SELECT count(*) FILTER (duration_s <> end_g - start_g OR duration_s <= 0) AS v FROM stints", 0, 0),
    ("stints", "no gap or overlap", "exact", "SELECT count(*) AS v FROM stints a JOIN stints b ON a.game_id = b.game_id AND b.stint_idx = a.stint_idx + 1 AND b.start_g <> a.end_g", 0, 0),
    ("stints", "index follows time", "exact", "SELECT count(*) FILTER (stint_idx <> rn) AS v FROM (SELECT stint_idx, row_number() OVER (PARTITION BY game_id ORDER BY start_g) - 1 AS rn FROM stints)", 0, 0),
    ("stints", "counts match personnel", "exact", "SELECT count(*) FILTER (home_n <> len(home_skaters) OR away_n <> len(away_skaters)) AS v FROM stints", 0, 0),
    ("stints", "strength label", "exact", "SELECT count(*) FILTER (strength <> CAST(home_n AS VARCHAR) || 'v' || CAST(away_n AS VARCHAR)) AS v FROM stints", 0, 0),
    ("stints", "overload rate", "approx", "SELECT avg(CASE WHEN overload THEN 1 ELSE 0 END) AS v FROM stints", 0, 0.001)))
def v2(t):
    return K.check_stints(t.stints)


@query("V3_shot_sum_checks", _union(
    ("shots_onice", "stint sums equal shot sums", "exact", "SELECT count(*) FILTER (abs(a - coalesce(b, 0)) > 0.02) AS v FROM (SELECT game_id, sum(home_xgf + away_xgf) AS a FROM stints GROUP BY 1) LEFT JOIN (SELECT game_id, sum(xg) AS b FROM onice GROUP BY 1) USING (game_id)", 0, 0),
    ("shots_onice", "stint index in range", "exact", "SELECT count(*) AS v FROM onice o WHERE NOT EXISTS (SELECT 1 FROM stints s WHERE s.game_id = o.game_id AND s.stint_idx = o.stint_idx)", 0, 0),
    ("shots_onice", "goal is 0 or 1", "exact", "SELECT count(*) FILTER (goal NOT IN (0, 1)) AS v FROM onice", 0, 0)))
def v3(t):
    return K.check_shot_sums(t.stints, t.shots_onice)


@query("V4_onice_checks", _union(
    ("onice", "match share", "approx", "SELECT avg(CASE WHEN onice_match IN ('exact', 'within1') THEN 1 ELSE 0 END) AS v FROM onice", 0.97, 1.0),
    ("onice", "goal strength mismatch", "approx", "SELECT avg(CASE WHEN strength <> concat_ws('v', sit_home_n, sit_away_n) THEN 1 ELSE 0 END) AS v FROM onice WHERE goal = 1", 0.0, 0.03)))
def v4(t):
    return K.check_onice(t.shots_onice)


@query("V5_calibration_checks", _union(
    ("chance", "season calibration worst", "approx", "SELECT max(abs(x / g - 1)) AS v FROM (SELECT season, sum(xg) AS x, sum(goal) AS g FROM scored WHERE xg IS NOT NULL GROUP BY 1)", 0.0, 0.04),
    ("chance", "pooled calibration", "approx", "SELECT sum(xg) / sum(goal) - 1 AS v FROM scored WHERE xg IS NOT NULL", -0.005, 0.005)))
def v5(t):
    return K.check_calibration(t.scored_shots)


@query("V8_log_box_checks", _union(
    ("gamelog", "goals", "exact", "SELECT count(*) FILTER (a.g <> coalesce(c.g, 0)) AS v FROM (SELECT player_id, season, sum(g) AS g FROM gamelog WHERE (game_id // 10000) % 100 = 2 GROUP BY 1, 2) a LEFT JOIN (SELECT * FROM counted WHERE game_type = 'regular') c USING (player_id, season)", 0, 0),
    ("gamelog", "shots on goal", "exact", "SELECT count(*) FILTER (a.g <> coalesce(c.sog, 0)) AS v FROM (SELECT player_id, season, sum(sog) AS g FROM gamelog WHERE (game_id // 10000) % 100 = 2 GROUP BY 1, 2) a LEFT JOIN (SELECT * FROM counted WHERE game_type = 'regular') c USING (player_id, season)", 0, 0),
    ("gamelog", "ice time", "exact", "SELECT count(*) FILTER (a.s <> c.toi_s) AS v FROM (SELECT player_id, season, sum(toi_s) AS s FROM gamelog WHERE (game_id // 10000) % 100 = 2 GROUP BY 1, 2) a JOIN (SELECT * FROM ice WHERE game_type = 'regular') c USING (player_id, season)", 0, 0)))
def v8(t):
    log = B.game_log(t.shifts, t.events, B.game_scores(t.headers, t.events))
    return K.check_log_against_box(log, B.season_box(t.shifts, t.events, t.roster, t.stints))


@query("V9_goalie_checks", _union(
    ("goalies", "saves", "exact", "SELECT count(*) FILTER (sv <> sog - g) AS v FROM (SELECT count(*) FILTER (is_sog) AS sog, sum(goal) AS g, count(*) FILTER (is_sog AND goal = 0) AS sv FROM faced GROUP BY player_id, season)", 0, 0),
    ("goalies", "goals saved above expected", "exact", "SELECT count(*) FILTER (abs(d - (x - g)) > 1e-6) AS v FROM (SELECT sum(xg - goal) AS d, sum(xg) AS x, sum(goal) AS g FROM faced GROUP BY player_id, season)", 0, 0),
    ("goalies", "danger split closes", "exact", "SELECT count(*) FILTER (a + b + c <> n) AS v FROM (SELECT count(*) AS n, count(*) FILTER (bucket = 'ld') AS a, count(*) FILTER (bucket = 'md') AS b, count(*) FILTER (bucket = 'hd') AS c FROM faced GROUP BY player_id, season)", 0, 0)))
def v9(t):
    from shiftgrain.plans.q_aggregates import _gbox

    return K.check_goalies(_gbox(t))


@query("V11_document_checks", _union(
    ("documents", "document present", "exact", "SELECT count(*) AS v FROM (SELECT DISTINCT game_id FROM stints) WHERE game_id NOT IN (SELECT game_id FROM scores)", 0, 0),
    ("documents", "no NaN or Infinity", "exact", "SELECT count(*) FILTER (NOT isfinite(home_xgf) OR NOT isfinite(away_xgf)) AS v FROM stints", 0, 0),
    ("documents", "totals equal stint sums", "exact", "SELECT count(*) FILTER (abs(a - coalesce(b, 0)) > 0.01) AS v FROM (SELECT game_id, sum(home_xgf) AS a FROM stints GROUP BY 1) LEFT JOIN (SELECT game_id, sum(xg) AS b FROM onice WHERE is_home GROUP BY 1) USING (game_id)", 0, 0)))
def v11(t):
    from shiftgrain.sources import documents as DOC

    idx = B.game_index(B.game_scores(t.headers, t.events), t.stints, t.shots_onice)
    docs = DOC.game_documents(idx, t.stints, B.game_players(t.shifts, t.events, t.shots_onice))
    return K.check_documents(docs, idx.select("game_id", "home_xgf"))


@query("V12_key_assert", "SELECT count(*) AS n, count(*) - count(DISTINCT (game_id, event_idx)) AS duplicates FROM shots")
def v12(t):
    n = t.shots.groupBy("game_id", "event_idx").agg(F.count(F.lit(1)).alias("c"))
    return n.agg(F.sum("c").alias("n"), F.sum(C("c") - 1).alias("duplicates"))
