"""Aggregations (A*): box scores, logs, goalies, dimensions, grids, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S
from shiftgrain.operators import box as B
from shiftgrain.operators import dims as D
from shiftgrain.operators import eligibility as E
from shiftgrain.operators import grids as GR
from shiftgrain.operators import pairs as P
from shiftgrain.operators import ranking as R
from shiftgrain.operators import rates as RT
from shiftgrain.plans.catalog import query
from shiftgrain.plans.oracle import CTES
from shiftgrain.plans.q_joins import GAMES_DIM, PAIRS, VENUES
from shiftgrain.sources import documents as DOC

C = F.col


def _credit_sql() -> str:
    parts = []
    for so, table in ((False, B.FLOW_CREDITS), (True, B.SHOOTOUT_CREDITS)):
        for kind, role, stats in table:
            for st in stats:
                parts.append(f"SELECT game_id, season, {role} AS player_id, '{st}' AS stat FROM ev WHERE type = '{kind}' AND period {'>=' if so else '<'} 5")
    return " UNION ALL ".join(parts)


CTES["credit_rows"] = f"SELECT * FROM ({_credit_sql()}) WHERE player_id IS NOT NULL"
CTES["counted"] = ("SELECT season, CASE WHEN (game_id // 10000) % 100 = 2 THEN 'regular' ELSE 'playoff' END AS game_type, player_id, "
                   + ", ".join(f"count(*) FILTER (stat = '{s}') AS {s}" for s in B.STATS)
                   + ", count(*) FILTER (stat IN ('g', 'a1', 'a2')) AS points FROM credit_rows GROUP BY 1, 2, 3")
CTES["ice"] = """
SELECT season, game_type, player_id, sum(games)::BIGINT AS gp, sum(s)::BIGINT AS toi_s, first(team ORDER BY games DESC, team) AS team,
  array_to_string(list(team ORDER BY games DESC, team), ',') AS teams
FROM (SELECT season, CASE WHEN (game_id // 10000) % 100 = 2 THEN 'regular' ELSE 'playoff' END AS game_type, player_id, team, count(DISTINCT game_id) AS games, sum(duration_s) AS s
  FROM shifts GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""
CTES["side_stints"] = """
SELECT game_id, stint_idx, season, duration_s, strength, unnest(home_skaters) AS player_id, home_n AS n, away_n AS m, home_xgf AS xgf, away_xgf AS xga, home_corsi AS cf, away_corsi AS ca, start_zone AS zone
FROM stints WHERE (game_id // 10000) % 100 = 2 AND NOT overload AND duration_s >= 10
UNION ALL SELECT game_id, stint_idx, season, duration_s, strength, unnest(away_skaters), away_n, home_n, away_xgf, home_xgf, away_corsi, home_corsi,
  CASE start_zone WHEN 'O' THEN 'D' WHEN 'D' THEN 'O' ELSE start_zone END
FROM stints WHERE (game_id // 10000) % 100 = 2 AND NOT overload AND duration_s >= 10"""
CTES["onice_sums"] = """
SELECT player_id, season,
  coalesce(sum(xgf) FILTER (strength = '5v5'), 0) AS ev_xgf_on, coalesce(sum(xga) FILTER (strength = '5v5'), 0) AS ev_xga_on,
  coalesce(sum(cf) FILTER (strength = '5v5'), 0)::BIGINT AS ev_cf_on, coalesce(sum(ca) FILTER (strength = '5v5'), 0)::BIGINT AS ev_ca_on,
  coalesce(sum(duration_s) FILTER (strength = '5v5'), 0)::BIGINT AS ev_onice_s,
  coalesce(sum(xgf) FILTER (strength <> '5v5' AND n > m), 0) AS pp_xgf_on, coalesce(sum(duration_s) FILTER (strength <> '5v5' AND n > m), 0)::BIGINT AS pp_onice_s,
  coalesce(sum(xga) FILTER (strength <> '5v5' AND n < m), 0) AS pk_xga_on, coalesce(sum(duration_s) FILTER (strength <> '5v5' AND n < m), 0)::BIGINT AS pk_onice_s,
  count(*) FILTER (strength = '5v5' AND zone = 'O') AS ev_oz_starts, count(*) FILTER (strength = '5v5' AND zone = 'D') AS ev_dz_starts
FROM side_stints GROUP BY 1, 2"""
CTES["scores"] = """
SELECT h.*, count(g.game_id) FILTER (g.is_home) AS home_score, count(g.game_id) FILTER (NOT g.is_home) AS away_score,
  h.game_id IN (SELECT game_id FROM ev WHERE period >= 4) AS ot
FROM headers h LEFT JOIN ev g ON g.game_id = h.game_id AND g.type = 'goal' AND g.period < 5 GROUP BY ALL"""
CTES["gcounts"] = """
SELECT game_id, player_id, count(*) FILTER (stat = 'g') AS g, count(*) FILTER (stat = 'a1') AS a1, count(*) FILTER (stat = 'a2') AS a2,
  count(*) FILTER (stat = 'sog') AS sog, count(*) FILTER (stat = 'pen_taken') AS pen FROM credit_rows GROUP BY 1, 2"""
CTES["gamelog"] = """
SELECT b.*, coalesce(c.g, 0) AS g, coalesce(c.a1, 0) + coalesce(c.a2, 0) AS a, coalesce(c.g, 0) + coalesce(c.a1, 0) + coalesce(c.a2, 0) AS p,
  coalesce(c.sog, 0) AS sog, coalesce(c.pen, 0) AS pen, s.game_date, b.team = s.home_team AS home,
  CASE WHEN b.team = s.home_team THEN s.away_team ELSE s.home_team END AS opp,
  CASE WHEN b.team = s.home_team THEN s.home_score ELSE s.away_score END AS gf, CASE WHEN b.team = s.home_team THEN s.away_score ELSE s.home_score END AS ga, s.ot
FROM (SELECT game_id, season, player_id, any_value(team) AS team, sum(duration_s)::BIGINT AS toi_s FROM shifts GROUP BY 1, 2, 3) b
LEFT JOIN gcounts c USING (game_id, player_id) JOIN scores s USING (game_id)"""
CTES["glines"] = """
SELECT game_id, goalie_id AS player_id, count(*) AS sa, sum(xg) AS xga, sum(goal)::BIGINT AS ga, count(*) FILTER (event IN ('shot-on-goal', 'goal')) AS sog
FROM onice WHERE goalie_id IS NOT NULL AND xg IS NOT NULL AND (game_id // 10000) % 100 = 2 GROUP BY 1, 2"""
CTES["ggames"] = """
SELECT *, row_number() OVER (PARTITION BY game_id, team ORDER BY first_start, player_id) = 1 AS started, count(*) OVER (PARTITION BY game_id, team) = 1 AS sole
FROM (SELECT game_id, season, player_id, any_value(team) AS team, sum(duration_s)::BIGINT AS toi_s, min(start_g) AS first_start FROM shifts
  WHERE (game_id // 10000) % 100 = 2 AND player_id IN (SELECT player_id FROM goalie_ids) GROUP BY 1, 2, 3)"""
CTES["glog"] = """
SELECT b.game_id, b.season, b.player_id, b.team, b.toi_s, b.started, coalesce(l.sa, 0) AS sa, coalesce(l.sog, 0) AS sog_against, coalesce(l.sog - l.ga, 0) AS saves,
  coalesce(l.ga, 0) AS ga, coalesce(l.xga, 0) AS xga, coalesce(l.xga - l.ga, 0) AS gsax,
  b.started AND b.sole AND (CASE WHEN b.team = s.home_team THEN s.away_score ELSE s.home_score END) = 0 AS shutout,
  coalesce(b.started AND l.sog > 0 AND ((l.sog - l.ga) / l.sog >= 0.917 OR (l.sog < 20 AND l.ga <= 2)), false) AS qs,
  coalesce(b.started AND l.sog > 0 AND (l.sog - l.ga) / l.sog < 0.85, false) AS rbs
FROM ggames b LEFT JOIN glines l USING (game_id, player_id) JOIN scores s USING (game_id)"""
CTES["faced"] = """
SELECT season, goalie_id AS player_id, xg, goal, shot_type, event IN ('shot-on-goal', 'goal') AS is_sog,
  CASE WHEN xg < CAST(0.05 AS DOUBLE) THEN 'ld' WHEN xg < CAST(0.15 AS DOUBLE) THEN 'md' ELSE 'hd' END AS bucket,
  CASE WHEN o IS NULL OR q IS NULL OR o = q THEN 'ev' WHEN o < q THEN 'pk' ELSE 'pp' END AS sit
FROM (SELECT *, CASE WHEN is_home THEN sit_away_n ELSE sit_home_n END AS o, CASE WHEN is_home THEN sit_home_n ELSE sit_away_n END AS q FROM onice
  WHERE goalie_id IS NOT NULL AND xg IS NOT NULL AND (game_id // 10000) % 100 = 2)"""


@query("A1_box_counters", "SELECT * FROM counted")
def a1(t):
    keys = ["season", "game_type"]
    return B.counters(B.credits(t.events.withColumn("game_type", B.game_type()), *keys), *keys)


@query("A2_ice_and_team", "SELECT * FROM ice")
def a2(t):
    d = B.ice_time(t.shifts.withColumn("game_type", B.game_type()), "season", "game_type")
    return d.withColumn("teams", F.array_join("teams", ","))


ROUNDED_ON = ", ".join(f"round({c}, 6) AS {c}" if "xg" in c else c for c in B.ONICE)


@query("A3_onice_sums", f"SELECT player_id, season, {ROUNDED_ON} FROM onice_sums")
def a3(t):
    return B.onice_sums(t.stints)


@query("A4_season_box", f"""SELECT i.season, i.game_type, i.player_id, i.gp, i.toi_s, i.team, round_even(i.toi_s / 60.0, 1)::DOUBLE AS toi_min, r.position AS pos, coalesce(c.points, 0) AS points,
 coalesce(c.hits, 0) AS hits, coalesce(c.so_att, 0) AS so_att, round(CASE WHEN i.game_type = 'regular' THEN coalesce(o.ev_xgf_on, 0) ELSE 0 END, 6) AS ev_xgf_on
 FROM ice i LEFT JOIN counted c USING (season, game_type, player_id) LEFT JOIN roster r USING (player_id, season) LEFT JOIN onice_sums o USING (player_id, season)""")
def a4(t):
    b = B.season_box(t.shifts, t.events, t.roster, t.stints)
    return b.select("season", "game_type", "player_id", "gp", "toi_s", "team", "toi_min", "pos", "points", "hits", "so_att", "ev_xgf_on")


@query("A5_game_counts", "SELECT * FROM gcounts WHERE g + a1 + a2 + sog + pen > 0")
def a5(t):
    return B.game_counts(t.events)


@query("A6_game_log", """SELECT game_id, season, player_id, team, toi_s, g, a, p, sog, pen, game_date::VARCHAR AS game_date, home, opp, gf, ga,
 CASE WHEN gf > ga THEN 'W' WHEN gf < ga AND ot THEN 'OTL' WHEN gf < ga THEN 'L' ELSE 'T' END AS result FROM gamelog""")
def a6(t):
    return _log(t).drop("a1", "a2")


def _log(t):
    return B.game_log(t.shifts, t.events, B.game_scores(t.headers, t.events))


@query("A7_goalie_lines", "SELECT game_id, player_id, sa, round(xga, 6) AS xga, ga, sog AS sog_against, sog - ga AS saves, round(xga - ga, 6) AS gsax FROM glines")
def a7(t):
    return B.goalie_lines(t.shots_onice)


def _goalies(t):
    return t.roster.where("position = 'G'").select("player_id").distinct()


@query("A8_starters", "SELECT game_id, player_id, team, toi_s, first_start, started, sole AS sole_goalie FROM ggames")
def a8(t):
    return B.goalie_games(t.shifts, _goalies(t)).select("game_id", "player_id", "team", "toi_s", "first_start", "started", "sole_goalie")


def _glog(t):
    return B.goalie_game_log(t.shifts, _goalies(t), t.shots_onice, B.game_scores(t.headers, t.events))


GBOX = ", ".join(f"count(*) FILTER (bucket = '{b}')::BIGINT AS {b}_sa, round(coalesce(sum(xg) FILTER (bucket = '{b}'), 0), 6) AS {b}_xga, coalesce(sum(goal) FILTER (bucket = '{b}'), 0)::BIGINT AS {b}_ga, count(*) FILTER (bucket = '{b}' AND is_sog) AS {b}_sog" for b in B.DANGER)


@query("A9_goalie_box", """SELECT player_id, season, l.gp, l.starts, l.shutouts, l.qs, l.rbs, l.toi_s, coalesce(f.sa, 0) AS sa, round(coalesce(f.xga, 0), 6) AS xga, coalesce(f.ga, 0) AS ga,
 coalesce(f.sog, 0) AS sog_against, round(coalesce(f.xs, 0), 6) AS xga_sog, coalesce(f.hd, 0) AS hd_sa, coalesce(f.pk, 0) AS pk_sa FROM
 (SELECT player_id, season, count(DISTINCT game_id) AS gp, count(*) FILTER (started) AS starts, count(*) FILTER (shutout) AS shutouts, count(*) FILTER (qs) AS qs, count(*) FILTER (rbs) AS rbs, sum(toi_s)::BIGINT AS toi_s
  FROM glog GROUP BY 1, 2) l LEFT JOIN (SELECT player_id, season, count(*) AS sa, sum(xg) AS xga, sum(goal)::BIGINT AS ga, count(*) FILTER (is_sog) AS sog, sum(xg) FILTER (is_sog) AS xs,
  count(*) FILTER (bucket = 'hd') AS hd, count(*) FILTER (sit = 'pk') AS pk FROM faced GROUP BY 1, 2) f USING (player_id, season)""")
def a9(t):
    return _gbox(t).select("player_id", "season", "gp", "starts", "shutouts", "qs", "rbs", "toi_s", "sa", "xga", "ga", "sog_against", "xga_sog", "hd_sa", "pk_sa")


def _gbox(t):
    return B.goalie_box(_glog(t), B.facing_shots(t.shots_onice))


@query("A10_split_wide", f"SELECT player_id, season, {GBOX} FROM faced GROUP BY 1, 2")
def a10(t):
    return B.split_wide(B.facing_shots(t.shots_onice), ["player_id", "season"], "bucket", B.DANGER)


@query("A11_shot_type_split", "SELECT player_id, season, shot_type, count(*) AS sa, round(sum(xg), 6) AS xga, sum(goal)::BIGINT AS ga, count(*) FILTER (is_sog) AS sog FROM faced WHERE shot_type IS NOT NULL GROUP BY 1, 2, 3")
def a11(t):
    return B.shot_type_split(B.facing_shots(t.shots_onice))


@query("A12_career", """SELECT player_id, sum(gp)::BIGINT AS gp, sum(toi_s)::BIGINT AS toi_s, sum(points)::BIGINT AS points, arg_max(team, season) AS team,
 (SELECT array_to_string(list_sort(list(DISTINCT s.team)), ',') FROM shifts s WHERE s.player_id = i.player_id AND (s.game_id // 10000) % 100 = 2) AS teams
 FROM ice i LEFT JOIN counted c USING (season, game_type, player_id) WHERE i.game_type = 'regular' GROUP BY player_id""")
def a12(t):
    keys = ["season", "game_type"]
    ice = B.ice_time(t.shifts.withColumn("game_type", B.game_type()), *keys).where("game_type = 'regular'")
    cnt = B.counters(B.credits(t.events.withColumn("game_type", B.game_type()), *keys), *keys)
    return RT.career(ice.join(cnt, [*keys, "player_id"], "left"), ["gp", "toi_s", "points"]).withColumn("teams", F.array_join("teams", ","))


CTES["career_on"] = "SELECT player_id, " + ", ".join(f"sum({c}) AS {c}" for c in B.ONICE) + " FROM onice_sums GROUP BY 1"
CTES["onice_rates"] = """
SELECT player_id, ev_onice_s, CASE WHEN ev_onice_s > 0 THEN ev_xgf_on * 3600.0 / ev_onice_s END AS ev_xgf60, CASE WHEN ev_onice_s > 0 THEN ev_xga_on * 3600.0 / ev_onice_s END AS ev_xga60,
  CASE WHEN ev_xgf_on + ev_xga_on > 0 THEN ev_xgf_on / (ev_xgf_on + ev_xga_on) END AS ev_xgshare,
  CASE WHEN ev_onice_s > 0 THEN ev_cf_on * 3600.0 / ev_onice_s END AS ev_cf60, CASE WHEN ev_onice_s > 0 THEN ev_ca_on * 3600.0 / ev_onice_s END AS ev_ca60,
  CASE WHEN ev_cf_on + ev_ca_on > 0 THEN ev_cf_on / (ev_cf_on + ev_ca_on) END AS ev_cfshare,
  CASE WHEN pp_onice_s > 0 THEN pp_xgf_on * 3600.0 / pp_onice_s END AS pp_xgf60, CASE WHEN pk_onice_s > 0 THEN pk_xga_on * 3600.0 / pk_onice_s END AS pk_xga60,
  CASE WHEN ev_oz_starts + ev_dz_starts > 0 THEN ev_oz_starts / (ev_oz_starts + ev_dz_starts) END AS ozs
FROM career_on"""
CTES["poss"] = "SELECT player_id, CASE WHEN position = 'D' THEN 'D' ELSE 'F' END AS grp2 FROM roster WHERE position <> 'G' GROUP BY ALL"


@query("A13_onice_rates", """SELECT player_id, grp2 AS grp, round(ev_xgf60, 6) AS ev_xgf60, round(ev_xga60, 6) AS ev_xga60, round(ev_xgshare, 6) AS ev_xgshare, round(ev_cf60, 6) AS ev_cf60, round(ev_ca60, 6) AS ev_ca60,
 round(ev_cfshare, 6) AS ev_cfshare, round(pp_xgf60, 6) AS pp_xgf60, round(pk_xga60, 6) AS pk_xga60, round(ozs, 6) AS ozs,
 CASE WHEN ev_onice_s >= 300 THEN round_even(100 * (rank() OVER (PARTITION BY grp2, ev_onice_s >= 300 ORDER BY ev_xgf60) + (count(*) OVER (PARTITION BY grp2, ev_onice_s >= 300, ev_xgf60) - 1) / 2)
   / count(*) OVER (PARTITION BY grp2, ev_onice_s >= 300), 0) END AS ev_xgf60_pct,
 CASE WHEN ev_onice_s >= 300 THEN round_even(100 * (1 - (rank() OVER (PARTITION BY grp2, ev_onice_s >= 300 ORDER BY ev_xga60) + (count(*) OVER (PARTITION BY grp2, ev_onice_s >= 300, ev_xga60) - 1) / 2)
   / count(*) OVER (PARTITION BY grp2, ev_onice_s >= 300)), 0) END AS ev_xga60_pct
 FROM onice_rates JOIN poss USING (player_id)""")
def a13(t):
    rates = RT.onice_rates(B.onice_sums(t.stints))
    pos = RT.skater_groups(t.roster)
    df = rates.join(pos, "player_id")
    ranked = RT.ranked_metrics(df, "player_id", "grp", {"ev_xgf60": (True, "ev_onice_s", 300), "ev_xga60": (False, "ev_onice_s", 300)})
    return ranked.drop("ev_onice_s", "n_zs")


@query("A14_individual_rates", """SELECT player_id, round(shots * 3600.0 / secs, 6) AS shots60, round(ixg * 3600.0 / secs, 6) AS ixg60, round(CASE WHEN shots > 0 THEN ixg / shots END, 6) AS xg_per_shot, round(g * 3600.0 / secs, 6) AS g60,
 round(a * 3600.0 / secs, 6) AS a60, round(a1 * 3600.0 / secs, 6) AS a1_60, round(pd * 3600.0 / secs, 6) AS pen_drawn60, round(pt * 3600.0 / secs, 6) AS pen_taken60,
 round(CASE WHEN fw + fl > 0 THEN fw / (fw + fl) END, 6) AS fo_win FROM (SELECT i.player_id, sum(i.toi_s) AS secs, coalesce(sum(c.g), 0) AS g, coalesce(sum(c.a1), 0) AS a1, coalesce(sum(c.a1 + c.a2), 0) AS a,
 coalesce(sum(pen_drawn), 0) AS pd, coalesce(sum(pen_taken), 0) AS pt, coalesce(sum(fo_won), 0) AS fw, coalesce(sum(fo_lost), 0) AS fl FROM ice i LEFT JOIN counted c USING (season, game_type, player_id) WHERE i.game_type = 'regular' GROUP BY 1)
 LEFT JOIN (SELECT shooter_id AS player_id, count(*) AS n, sum(xg) AS x FROM onice WHERE xg IS NOT NULL AND goalie_id IS NOT NULL GROUP BY 1) USING (player_id)
 CROSS JOIN (SELECT 0) z(zz), LATERAL (SELECT coalesce(n, 0) AS shots, coalesce(x, 0) AS ixg)""")
def a14(t):
    keys = ["season", "game_type"]
    ice = B.ice_time(t.shifts.withColumn("game_type", B.game_type()), *keys).where("game_type = 'regular'")
    cnt = B.counters(B.credits(t.events.withColumn("game_type", B.game_type()), *keys), *keys)
    box = ice.join(cnt, [*keys, "player_id"], "left")
    shots = E.duel_shots(t.shots_onice).groupBy(C("shooter_id").alias("player_id")).agg(F.count(F.lit(1)).alias("shots"), F.sum("xg").alias("ixg"))
    return RT.individual_rates(box, shots).select("player_id", "shots60", "ixg60", "xg_per_shot", "g60", "a60", "a1_60", "pen_drawn60", "pen_taken60", "fo_win")


@query("A15_goalie_rates", """SELECT player_id, round(CASE WHEN sog > 0 THEN (sog - ga) / sog END, 6) AS sv_pct, round(ga * 3600.0 / toi, 6) AS gaa, round(gsax * 3600.0 / toi, 6) AS gsax60, round(sog * 3600.0 / toi, 6) AS sa60,
 round(CASE WHEN hsog > 0 THEN (hsog - hga) / hsog END, 6) AS hd_sv_pct, round(CASE WHEN starts > 0 THEN qs / starts END, 6) AS qs_pct FROM
 (SELECT player_id, sum(toi_s) AS toi, count(*) FILTER (started) AS starts, count(*) FILTER (qs) AS qs, sum(ga) AS ga, sum(gsax) AS gsax, sum(sog_against) AS sog FROM glog GROUP BY 1)
 LEFT JOIN (SELECT player_id, count(*) FILTER (bucket = 'hd' AND is_sog) AS hsog, sum(goal) FILTER (bucket = 'hd') AS hga FROM faced GROUP BY 1) USING (player_id)""")
def a15(t):
    return RT.goalie_rates(_gbox(t)).select("player_id", "sv_pct", "gaa", "gsax60", "sa60", "hd_sv_pct", "qs_pct")


STRENGTH_SHOTS = """SELECT shooter_id AS player_id, count(*) FILTER (strength = '5v5') AS shots5, count(*) FILTER (own = 5 AND opp = 4) AS shotspp, round(coalesce(sum(xg) FILTER (strength = '5v5'), 0), 6) AS ixg5,
 round(coalesce(sum(xg) FILTER (own = 5 AND opp = 4), 0), 6) AS ixgpp FROM (SELECT *, CASE WHEN is_home THEN st_home_n ELSE st_away_n END AS own, CASE WHEN is_home THEN st_away_n ELSE st_home_n END AS opp FROM onice WHERE xg IS NOT NULL) GROUP BY 1"""


@query("A16_shots_by_strength", STRENGTH_SHOTS)
def a16(t):
    return RT.shots_by_strength(t.shots_onice)


PENV = """SELECT CASE WHEN n > 0 THEN (pp - sh) / n ELSE 0 END AS v FROM (SELECT count(*) FILTER (own = 5 AND opp = 4) AS pp, count(*) FILTER (own = 4 AND opp = 5) AS sh FROM
 (SELECT CASE WHEN is_home THEN st_home_n ELSE st_away_n END AS own, CASE WHEN is_home THEN st_away_n ELSE st_home_n END AS opp FROM onice WHERE goal = 1)),
 (SELECT sum(pen_drawn) AS n FROM counted c JOIN ice USING (season, game_type, player_id) WHERE game_type = 'regular')"""


@query("A17_penalty_value", f"SELECT round(v, 6) AS v FROM ({PENV})")
def a17(t):
    box = B.season_box(t.shifts, t.events, t.roster, t.stints).where("game_type = 'regular'")
    return RT.penalty_value(t.shots_onice, box)


CTES["gplayers"] = """
SELECT i.game_id, i.player_id, i.team, i.shifts, i.toi_s, coalesce(p.g, 0) AS g, coalesce(p.a1, 0) AS a1, coalesce(p.a2, 0) AS a2, coalesce(p.g, 0) + coalesce(p.a1, 0) + coalesce(p.a2, 0) AS pts,
  coalesce(s.shots, 0) AS shots, coalesce(s.xg, 0) AS xg
FROM (SELECT game_id, player_id, any_value(team) AS team, count(*) AS shifts, sum(duration_s)::BIGINT AS toi_s FROM shifts GROUP BY 1, 2) i
LEFT JOIN (SELECT game_id, player_id, count(*) FILTER (k = 'g') AS g, count(*) FILTER (k = 'a1') AS a1, count(*) FILTER (k = 'a2') AS a2 FROM (
  SELECT game_id, primary_player_id AS player_id, 'g' AS k FROM ev WHERE type = 'goal' UNION ALL SELECT game_id, assist1_player_id, 'a1' FROM ev WHERE type = 'goal'
  UNION ALL SELECT game_id, assist2_player_id, 'a2' FROM ev WHERE type = 'goal') GROUP BY 1, 2) p USING (game_id, player_id)
LEFT JOIN (SELECT game_id, shooter_id AS player_id, count(*) AS shots, sum(xg) AS xg FROM onice GROUP BY 1, 2) s USING (game_id, player_id)"""


@query("A18_game_players", "SELECT game_id, player_id, team, shifts, toi_s, g, a1, a2, pts, shots, round(xg, 6) AS xg FROM gplayers")
def a18(t):
    return B.game_players(t.shifts, t.events, t.shots_onice)


@query("A19_game_index", """SELECT s.game_id, s.home_score, s.away_score, s.ot, st.n_stints, round(st.home_xgf, 6) AS home_xgf, st.overload_stints, coalesce(o.n_shots, 0) AS n_shots, round(o.match_exact, 6) AS match_exact,
 coalesce(o.large_mismatch, 0) AS large_mismatch FROM scores s JOIN (SELECT game_id, count(*) AS n_stints, sum(home_xgf) AS home_xgf, count(*) FILTER (overload) AS overload_stints FROM stints GROUP BY 1) st USING (game_id)
 LEFT JOIN (SELECT game_id, count(*) AS n_shots, avg(CASE WHEN onice_match = 'exact' THEN 1 ELSE 0 END) AS match_exact, count(*) FILTER (onice_match = 'large') AS large_mismatch FROM onice GROUP BY 1) o USING (game_id)""")
def a19(t):
    g = B.game_index(B.game_scores(t.headers, t.events), t.stints, t.shots_onice)
    return g.select("game_id", "home_score", "away_score", "ot", "n_stints", "home_xgf", "overload_stints", "n_shots", "match_exact", "large_mismatch")


@query("A20_nested_logs", """SELECT player_id, array_to_string(list(CAST(game_id AS VARCHAR) || ':' || CAST(p AS VARCHAR) ORDER BY game_date DESC, game_id DESC), ',') AS games FROM gamelog GROUP BY 1""")
def a20(t):
    logs = DOC.nested_game_logs(_log(t))
    txt = F.transform("games", lambda g: F.concat_ws(":", g["game_id"].cast("string"), g["p"].cast("string")))
    return logs.select("player_id", F.array_join(txt, ",").alias("games"))


@query("A21_team_season_map", "SELECT player_id, team, season, count(*) AS gp, sum(g)::BIGINT AS g, sum(a)::BIGINT AS a, sum(p)::BIGINT AS p, sum(toi_s)::BIGINT AS toi_s FROM gamelog GROUP BY 1, 2, 3")
def a21(t):
    m = DOC.team_season_map(_log(t))
    one = m.select("player_id", F.explode("by_team").alias("team", "seasons"))
    two = one.select("player_id", "team", F.explode("seasons").alias("season", "line"))
    return two.select("player_id", "team", C("season").cast("long").alias("season"), "line.*")


@query("A22_goalie_by_season", """SELECT player_id, season, gp, round(CASE WHEN sog > 0 THEN round_even((sog - ga) / sog, 4) END, 6) AS sv_pct, toi_s FROM (SELECT player_id, season, count(DISTINCT game_id) AS gp, sum(sog_against) AS sog, sum(ga) AS ga,
 sum(toi_s)::BIGINT AS toi_s FROM glog GROUP BY 1, 2)""")
def a22(t):
    m = DOC.season_map(_gbox(t).withColumn("sv_pct", F.bround(S.ratio("saves", "sog_against"), 4)), ["gp", "sv_pct", "toi_s"])
    one = m.select("player_id", F.explode("by_season").alias("season", "line"))
    return one.select("player_id", C("season").cast("long").alias("season"), "line.*")


@query("A23_venues", VENUES)
def a23(t):
    v = D.venues(t.headers)
    return v.select("canonical", "venue_id", F.array_join("raw_names", ",").alias("raw_names"), F.array_join(C("active_seasons").cast("array<string>"), ",").alias("active_seasons"))


@query("A24_player_seasons", "SELECT player_id, season, position, number FROM roster")
def a24(t):
    return D.player_seasons(t.roster).select("player_id", "season", "position", "number")


@query("A25_games_dimension", f"SELECT game_id, venue_id, raw_venue FROM ({GAMES_DIM})")
def a25(t):
    return D.games_dimension(t.headers, D.venues(t.headers)).select("game_id", "venue_id", "raw_venue")


@query("A26_team_seasons", """SELECT team, season, count(*) AS gp, count(*) FILTER (gf > ga) AS w, count(*) FILTER (gf < ga AND NOT ot) AS l, count(*) FILTER (gf < ga AND ot) AS otl,
 2 * count(*) FILTER (gf > ga) + count(*) FILTER (gf < ga AND ot) AS pts, sum(gf)::BIGINT AS gf, sum(ga)::BIGINT AS ga, sum(sf)::BIGINT AS sf, sum(sa)::BIGINT AS sa, round(sum(xf), 6) AS xgf, round(sum(xa), 6) AS xga,
 round(CASE WHEN sum(xf) + sum(xa) > 0 THEN sum(xf) / (sum(xf) + sum(xa)) END, 6) AS xg_share FROM (
 SELECT season, ot, home_team AS team, home_score AS gf, away_score AS ga, coalesce(hs, 0) AS sf, coalesce(vs, 0) AS sa, coalesce(hx, 0) AS xf, coalesce(vx, 0) AS xa FROM scores LEFT JOIN (SELECT game_id, count(*) FILTER (is_home) AS hs, count(*) FILTER (NOT is_home) AS vs, sum(xg) FILTER (is_home) AS hx, sum(xg) FILTER (NOT is_home) AS vx FROM onice GROUP BY 1) USING (game_id)
 UNION ALL SELECT season, ot, away_team, away_score, home_score, coalesce(vs, 0), coalesce(hs, 0), coalesce(vx, 0), coalesce(hx, 0) FROM scores LEFT JOIN (SELECT game_id, count(*) FILTER (is_home) AS hs, count(*) FILTER (NOT is_home) AS vs, sum(xg) FILTER (is_home) AS hx, sum(xg) FILTER (NOT is_home) AS vx FROM onice GROUP BY 1) USING (game_id)) GROUP BY 1, 2""")
def a26(t):
    return D.team_seasons(B.game_scores(t.headers, t.events), t.shots_onice)


@query("A27_team_index", """SELECT coalesce(a.team, b.team) AS team, coalesce(players, 0) AS players, coalesce(games, 0) AS games FROM (SELECT team, count(DISTINCT player_id) AS players FROM shifts GROUP BY 1) a FULL JOIN
 (SELECT team, count(DISTINCT game_id) AS games FROM (SELECT home_team AS team, game_id FROM headers UNION ALL SELECT away_team, game_id FROM headers) GROUP BY 1) b ON a.team = b.team""")
def a27(t):
    return RT.team_index(t.shifts, t.headers)


_CELLS = """
SELECT entity, ix, iy, count(*) AS s, sum(goal)::BIGINT AS g, coalesce(sum(xg), 0) AS xg FROM (SELECT {who} AS entity, *, floor((abs(x) - 25) / 3.0)::BIGINT AS ix,
  floor((y * CASE WHEN x >= 0 THEN 1 ELSE -1 END + 42.5) / 3.0)::BIGINT AS iy FROM {rows}) WHERE entity IS NOT NULL AND ix BETWEEN 0 AND 24 AND iy BETWEEN 0 AND 28 GROUP BY 1, 2, 3"""
CTES["cells"] = _CELLS.format(who="shooter_id", rows="scored")
CTES["goalie_cells"] = _CELLS.format(who="goalie_id", rows="onice")


@query("A28_shot_grid", "SELECT entity, ix, iy, s, g, round(xg, 6) AS xg FROM cells WHERE entity IN (SELECT entity FROM cells GROUP BY 1 HAVING sum(s) >= 25)")
def a28(t):
    return GR.shot_grid(t.scored_shots, "shooter_id", GR.SHOOTER_SHOTS)


@query("A28_goalie_grid", "SELECT entity, ix, iy, s, g, round(xg, 6) AS xg FROM goalie_cells WHERE entity IN (SELECT entity FROM goalie_cells GROUP BY 1 HAVING sum(s) >= 100)")
def a28b(t):
    return GR.shot_grid(t.shots_onice, "goalie_id", GR.GOALIE_SHOTS)


@query("A29_blurred_grid", """SELECT entity, ix, iy, round(sum(v), 6) AS s FROM (
 SELECT entity, ix, iy + d AS iy, v * w AS v FROM (SELECT entity, ix + d AS ix, iy, s * w AS v FROM cells,
  (SELECT d, exp(-0.5 * (d / 1.1) ** 2) / sum(exp(-0.5 * (d / 1.1) ** 2)) OVER () AS w FROM (SELECT unnest(range(-3, 4)) AS d)) WHERE ix + d BETWEEN 0 AND 24
   AND entity IN (SELECT entity FROM cells GROUP BY 1 HAVING sum(s) >= 25)),
  (SELECT d, exp(-0.5 * (d / 1.1) ** 2) / sum(exp(-0.5 * (d / 1.1) ** 2)) OVER () AS w FROM (SELECT unnest(range(-3, 4)) AS d))) WHERE iy BETWEEN 0 AND 28 GROUP BY 1, 2, 3""")
def a29(t):
    return GR.blur(GR.shot_grid(t.scored_shots, "shooter_id", GR.SHOOTER_SHOTS), ["s"])


@query("A32_reliability", """SELECT bin, count(*) AS n, round(avg(xg), 6) AS mean_p, round(avg(goal), 6) AS rate FROM (SELECT *, least(floor(xg / 0.05), 19)::BIGINT AS bin FROM scored WHERE xg IS NOT NULL) GROUP BY 1""")
def a32(t):
    from shiftgrain.models.scoring import reliability

    return reliability(t.scored_shots.where("xg is not null"), "xg", "goal", 0.05, 20)


@query("A32_scores", """SELECT count(*) AS n, round(avg((xg - goal) ** 2), 6) AS brier, round(-avg(goal * ln(xg) + (1 - goal) * ln(1 - xg)), 6) AS log_loss, round(sum(xg), 6) AS total_p, sum(goal)::BIGINT AS total_y,
 round((sum(CASE WHEN goal = 1 THEN r END) - sum(goal) * (sum(goal) + 1) / 2) / (sum(goal) * (count(*) - sum(goal))), 6) AS auc FROM
 (SELECT xg, goal, rank() OVER (ORDER BY xg) + (count(*) OVER (PARTITION BY xg) - 1) / 2 AS r FROM scored WHERE xg IS NOT NULL)""")
def a32b(t):
    from shiftgrain.models.scoring import binary_scores

    return binary_scores(t.scored_shots.where("xg is not null"), "xg", "goal")


@query("A33_quantiles", """SELECT q, round(v, 6) AS v FROM (SELECT unnest([0.05::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.95::DOUBLE]) AS q,
 unnest(quantile_cont(goal - xg, [0.05, 0.25, 0.5, 0.75, 0.95])) AS v FROM scored WHERE xg IS NOT NULL)""")
def a33(t):
    from shiftgrain.models.scoring import quantiles

    return quantiles(t.scored_shots.where("xg is not null").select((C("goal") - C("xg")).alias("r")), "r", [0.05, 0.25, 0.5, 0.75, 0.95])


@query("A34_weighted_means", "SELECT grp2 AS grp, round(sum(ev_xgf60 * ev_onice_s) / sum(ev_onice_s), 6) AS wmean FROM onice_rates JOIN poss USING (player_id) WHERE ev_xgf60 IS NOT NULL GROUP BY 1")
def a34(t):
    rates = RT.onice_rates(B.onice_sums(t.stints))
    pos = RT.skater_groups(t.roster)
    return rates.join(pos, "player_id").groupBy("grp").agg(RT.weighted_mean("ev_xgf60", "ev_onice_s").alias("wmean"))


CTES["unpriced"] = """
SELECT shooter_id AS player_id, season, CAST(own AS VARCHAR) || 'v' || CAST(opp AS VARCHAR) AS label FROM (SELECT *, CASE WHEN is_home THEN sit_home_n ELSE sit_away_n END AS own, CASE WHEN is_home THEN sit_away_n ELSE sit_home_n END AS opp
 FROM onice WHERE goal = 1 AND sit_home_n IS NOT NULL AND sit_away_n IS NOT NULL) WHERE NOT (own = 5 AND opp IN (5, 4))"""


@query("A35_unpriced_goals", """SELECT player_id, count(*) AS up_window, count(*) FILTER (season = (SELECT max(season) FROM onice)) AS up_last,
 (SELECT array_to_string(list(label || ':' || CAST(n AS VARCHAR) ORDER BY label), ',') FROM (SELECT label, count(*) AS n FROM unpriced u2 WHERE u2.player_id = u.player_id AND u2.season = (SELECT max(season) FROM onice) GROUP BY 1)) AS detail FROM unpriced u GROUP BY 1""")
def a35(t):
    d = RT.unpriced_goals(t.shots_onice, t.shots_onice.agg(F.max("season")).first()[0] or 0)
    txt = F.transform(F.map_entries("detail"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return d.select("player_id", "up_window", "up_last", F.when(F.size("detail") > 0, F.array_join(txt, ",")).alias("detail"))


@query("A36_linemates", f"""SELECT player_id, mate, secs, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY secs DESC, mate) AS rn FROM (
 SELECT a AS player_id, b AS mate, secs FROM ({PAIRS}) UNION ALL SELECT b, a, secs FROM ({PAIRS}))) WHERE rn <= 8""")
def a36(t):
    return P.linemates(E.attribution_stints(t.stints, ("5v5",), 10), 8)


@query("A39_health", """SELECT o.season, o.shots, o.exact, o.within1, o.large, s.stints, s.illegal, s.games, coalesce(a.after_last, 0) AS after_last FROM (SELECT season, count(*) AS shots, count(*) FILTER (onice_match = 'exact') AS exact, count(*) FILTER (onice_match = 'within1') AS within1,
 count(*) FILTER (onice_match = 'large') AS large FROM onice GROUP BY 1) o JOIN (SELECT season, count(*) AS stints, count(*) FILTER (overload) AS illegal, count(DISTINCT game_id) AS games FROM stints GROUP BY 1) s USING (season)
 LEFT JOIN (SELECT season, count(*) AS after_last FROM shots sh JOIN (SELECT game_id, max(t) AS e FROM edges GROUP BY 1) m USING (game_id) WHERE sh.time_g > m.e GROUP BY 1) a USING (season)""")
def a39(t):
    from shiftgrain.operators.checks import health

    last = t.clock.groupBy("game_id").agg(F.max(F.when(C("edge").isNotNull(), C("t"))).alias("e"))
    after = t.shots.join(last, "game_id").where("time_g > e").groupBy("season").agg(F.count(F.lit(1)).alias("after_last"))
    return health(t.shots_onice, t.stints, after)
