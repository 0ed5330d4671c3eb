"""Projections and predicates over the game feed (P*, F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S
from shiftgrain.operators import eligibility as E
from shiftgrain.operators import shots as X
from shiftgrain.plans.catalog import query

C = F.col
KEY = ("game_id", "event_idx")


@query("P1_clock_seconds", """
SELECT game_id, event_idx, mmss, CASE WHEN regexp_full_match(mmss, '\\d+:\\d{2}')
  THEN CAST(split_part(mmss, ':', 1) AS INTEGER) * 60 + CAST(split_part(mmss, ':', 2) AS INTEGER) END AS secs
FROM (SELECT game_id, event_idx, CASE WHEN event_idx % 9 = 0 THEN 'bad' ELSE
  lpad(CAST((time_g % 1200) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(time_g % 60 AS VARCHAR), 2, '0') END AS mmss FROM ev)""")
def p1(t):
    within = C("time_g") % 1200
    mmss = F.when(C("event_idx") % 9 == 0, "bad").otherwise(F.format_string("%02d:%02d", F.floor(within / 60), within % 60))
    return t.events.select(*KEY, mmss.alias("mmss")).withColumn("secs", S.clock_seconds("mmss"))


@query("P2_game_seconds", "SELECT game_id, event_idx, (period - 1) * 1200 + time_g % 1200 AS secs, time_g // 1200 + 1 AS period2 FROM ev")
def p2(t):
    within = C("time_g") % 1200
    mmss = F.format_string("%02d:%02d", F.floor(within / 60), within % 60)
    return t.events.select(*KEY, S.game_seconds("period", mmss).alias("secs"), S.period_of("time_g").alias("period2"))


@query("P3_season_of_id", """
SELECT game_id, ((game_id // 1000000) % 10000) AS season, CAST(((game_id // 1000000) % 10000) AS VARCHAR) || '-' || substr(CAST(((game_id // 1000000) % 10000) + 1 AS VARCHAR), 3) AS label,
  CAST(((game_id // 1000000) % 10000) AS VARCHAR) || CAST(((game_id // 1000000) % 10000) + 1 AS VARCHAR) AS pair, right(CAST(game_id AS VARCHAR), 6) AS tail
FROM headers""")
def p3(t):
    s = S.season_of_id("game_id")
    return t.headers.select("game_id", s.alias("season"), S.season_label(s).alias("label"), S.season_pair(s).alias("pair"), S.id_tail("game_id").alias("tail"))


@query("P4_season_of_date", "SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 9 THEN 1 ELSE 0 END AS BIGINT) AS season FROM orders")
def p4(t):
    return t.raw("orders").select("o_orderkey", S.season_of_date("o_orderdate").alias("season"))


@query("P5_regular_season", "SELECT game_id, (game_id // 10000) % 100 = 2 AS regular FROM headers")
def p5(t):
    return t.headers.select("game_id", S.is_regular("game_id").alias("regular"))


@query("P6_situation_code", "SELECT game_id, event_idx, ag AS away_goalie_in, an AS away_skaters_n, hn AS home_skaters_n, hg AS home_goalie_in FROM ev_prev")
def p6(t):
    return t.events.select(*KEY, *S.situation("situation_code"))


@query("P7_attack_sign", "SELECT game_id, event_idx, CAST(sgn AS DOUBLE) AS sgn FROM ev_prev")
def p7(t):
    return t.events.select(*KEY, S.attack_sign("is_home", "home_defending_side").alias("sgn"))


@query("P8_oriented_xy", "SELECT game_id, event_idx, CAST(x * sgn AS DOUBLE) AS xo, CAST(y * sgn AS DOUBLE) AS yo, CAST(abs(x) AS DOUBLE) AS xf, CAST(y * CASE WHEN x >= 0 THEN 1 ELSE -1 END AS DOUBLE) AS yf FROM ev_prev WHERE x IS NOT NULL")
def p8(t):
    sg = S.attack_sign("is_home", "home_defending_side")
    fold = F.when(C("x") >= 0, 1.0).otherwise(-1.0)
    return t.events.where("x is not null").select(*KEY, (C("x") * sg).alias("xo"), (C("y") * sg).alias("yo"), (C("x") * fold).alias("xf"), (C("y") * fold).alias("yf"))


@query("P9_distance_angle", """SELECT game_id, event_idx, round(sqrt((89 - x * sgn) ** 2 + y ** 2), 6) AS distance,
 round(degrees(atan2(abs(y), 89 - x * sgn)), 6) AS angle FROM ev_prev WHERE x IS NOT NULL""")
def p9(t):
    sg = S.attack_sign("is_home", "home_defending_side")
    x, y = C("x") * sg, C("y") * sg
    return t.events.where("x is not null").select(*KEY, S.distance_to_net(x, y).alias("distance"), S.abs_angle(x, y).alias("angle"))


@query("P10_rebound_rush", """SELECT game_id, event_idx, CASE WHEN prev_type IN ('shot-on-goal', 'missed-shot', 'goal') AND gap <= 3 THEN 1 ELSE 0 END AS rebound,
 CASE WHEN prev_zone IN ('N', 'D') AND gap <= 4 THEN 1 ELSE 0 END AS rush FROM ev_prev""")
def p10(t):
    e = X.with_previous(t.events).withColumn("gap", C("time_g") - C("prev_time_g"))
    return e.select(*KEY, S.rebound("prev_type", "gap").alias("rebound"), S.rush("prev_zone", "gap").alias("rush"))


@query("P11_motion", """
SELECT game_id, event_idx,
  round(abs(degrees(atan2(y * sgn, 89 - x * sgn)) - degrees(atan2(prev_y * sgn, 89 - prev_x * sgn))), 6) AS angle_change,
  CASE WHEN sign(prev_y * sgn) <> sign(y * sgn) AND abs(prev_y) > 3 AND abs(y) > 3 AND gap <= 4 THEN 1 ELSE 0 END AS royal_road,
  CASE WHEN prev_x * sgn > 89 THEN 1 ELSE 0 END AS last_behind_net,
  CASE WHEN gap > 0 THEN round(sqrt((x * sgn - prev_x * sgn) ** 2 + (y * sgn - prev_y * sgn) ** 2) / gap, 6) ELSE 0 END AS speed,
  CASE hand WHEN 'L' THEN CASE WHEN y * sgn < 0 THEN 1 ELSE 0 END WHEN 'R' THEN CASE WHEN y * sgn < 0 THEN 0 ELSE 1 END END AS off_wing
FROM ev_prev LEFT JOIN bios ON player_id = primary_player_id WHERE x IS NOT NULL AND y IS NOT NULL""")
def p11(t):
    e = X.with_previous(t.events).where("x is not null and y is not null").withColumn("gap", C("time_g") - C("prev_time_g"))
    sg = S.attack_sign("is_home", "home_defending_side")
    e = e.join(t.bios.select(C("player_id").alias("primary_player_id"), "hand"), "primary_player_id", "left")
    x, y, px, py = C("x") * sg, C("y") * sg, C("prev_x") * sg, C("prev_y") * sg
    d = F.sqrt((x - px) ** 2 + (y - py) ** 2)
    return e.select(
        *KEY, F.abs(S.signed_angle(x, y) - S.signed_angle(px, py)).alias("angle_change"), S.cross_slot(py, y, "gap").alias("royal_road"),
        S.flag(px > S.GOAL_X).alias("last_behind_net"), S.speed(d, "gap").alias("speed"), S.off_wing("hand", y).alias("off_wing"),
    )


@query("P12_first_role", "SELECT game_id, event_idx, coalesce(nullif(assist2_player_id, 0), nullif(assist1_player_id, 0), nullif(primary_player_id, 0)) AS pid FROM ev")
def p12(t):
    return t.events.select(*KEY, S.first_role("assist2_player_id", "assist1_player_id", "primary_player_id").alias("pid"))


@query("P13_facing_goalie", "SELECT game_id, event_idx, CASE WHEN is_home THEN away_goalie ELSE home_goalie END AS goalie_id FROM onice")
def p13(t):
    return t.shots_onice.select(*KEY, S.facing_goalie("is_home", "home_goalie", "away_goalie").alias("goalie_id"))


@query("P14_danger_bucket", "SELECT game_id, event_idx, CASE WHEN xg / 1.5 < CAST(0.05 AS DOUBLE) THEN 'ld' WHEN xg / 1.5 < CAST(0.15 AS DOUBLE) THEN 'md' ELSE 'hd' END AS bucket FROM xg")
def p14(t):
    return t.xg.select(*KEY, S.danger_bucket(C("xg") / 1.5).alias("bucket"))


@query("P15_situation_bucket", """SELECT game_id, event_idx, CASE WHEN o IS NULL OR p IS NULL OR o = p THEN 'ev' WHEN o < p THEN 'pk' ELSE 'pp' END AS sit
FROM (SELECT *, CASE WHEN is_home THEN away_n ELSE home_n END AS o, CASE WHEN is_home THEN home_n ELSE away_n END AS p FROM shots)""")
def p15(t):
    own = F.when(C("is_home"), C("away_n")).otherwise(C("home_n"))
    opp = F.when(C("is_home"), C("home_n")).otherwise(C("away_n"))
    return t.shots.select(*KEY, S.situation_bucket(own, opp).alias("sit"))


@query("P16_strength_parse", """SELECT game_id, event_idx, strength, TRY_CAST(split_part(strength, 'v', CASE WHEN is_home THEN 1 ELSE 2 END) AS BIGINT) AS own,
 TRY_CAST(split_part(strength, 'v', CASE WHEN is_home THEN 2 ELSE 1 END) AS BIGINT) AS opp FROM onice""")
def p16(t):
    return t.shots_onice.select(*KEY, "strength", S.strength_side("strength", "is_home").alias("own"), S.strength_side("strength", ~C("is_home")).alias("opp"))


@query("P17_side_context", """
SELECT game_id, stint_idx, home, CASE WHEN home THEN 1 ELSE 0 END AS c_home,
  CASE WHEN start_type = 'faceoff' AND start_zone = CASE WHEN home THEN 'O' ELSE 'D' END THEN 1 ELSE 0 END AS ozone,
  CASE WHEN start_type = 'faceoff' AND start_zone = CASE WHEN home THEN 'D' ELSE 'O' END THEN 1 ELSE 0 END AS dzone,
  CASE WHEN (home AND home_lead < 0) OR (NOT home AND home_lead > 0) THEN 1 ELSE 0 END AS trail,
  CASE WHEN (home AND home_lead > 0) OR (NOT home AND home_lead < 0) THEN 1 ELSE 0 END AS lead
FROM stints CROSS JOIN (SELECT unnest([true, false]) AS home)""")
def p17(t):
    from shiftgrain.operators.sides import attacking_context

    both = t.stints.select("game_id", "stint_idx", "start_type", "start_zone", "home_lead", F.explode(F.array(F.lit(True), F.lit(False))).alias("home"))
    return both.select("game_id", "stint_idx", "home", *attacking_context("home"))


@query("P18_clock_label", """SELECT game_id, event_idx, 'P' || CAST(time_g // 1200 + 1 AS VARCHAR) || ' ' || lpad(CAST((time_g % 1200) // 60 AS VARCHAR), 2, '0')
 || ':' || lpad(CAST(time_g % 60 AS VARCHAR), 2, '0') AS label FROM ev""")
def p18(t):
    return t.events.select(*KEY, S.clock_label("time_g").alias("label"))


@query("P19_full_name", """SELECT c_custkey, nullif(trim(concat_ws(' ', nullif(CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END, ''),
 nullif(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END, ''))), '') AS name FROM customer""")
def p19(t):
    first = F.when(C("c_custkey") % 7 == 0, "").otherwise(C("c_mktsegment"))
    last = F.when(C("c_custkey") % 5 != 0, C("c_name"))
    return t.raw("customer").select("c_custkey", S.full_name(first, last).alias("name"))


@query("P20_rates", """SELECT game_id, stint_idx, round(CASE WHEN duration_s > 0 THEN home_xgf * 3600.0 / duration_s END, 6) AS xgf60,
 round(CASE WHEN home_corsi + away_corsi > 0 THEN home_corsi / (home_corsi + away_corsi) END, 6) AS cfshare,
 round(CASE WHEN home_sog > 0 THEN home_xgf / home_sog ELSE 0 END, 6) AS xg_per_sog FROM stints""")
def p20(t):
    return t.stints.select(
        "game_id", "stint_idx", S.per60("home_xgf", "duration_s").alias("xgf60"), S.share("home_corsi", "away_corsi").alias("cfshare"),
        S.ratio("home_xgf", "home_sog", 0.0).alias("xg_per_sog"),
    )


SCORES = """SELECT h.game_id, count(g.game_id) FILTER (g.is_home) AS hs, count(g.game_id) FILTER (NOT g.is_home) AS aw,
 h.game_id IN (SELECT game_id FROM ev WHERE period >= 4) AS ot FROM headers h LEFT JOIN ev g ON g.game_id = h.game_id AND g.type = 'goal' AND g.period < 5 GROUP BY 1"""


@query("P21_game_result", f"SELECT game_id, hs, aw, CASE WHEN hs > aw THEN 'W' WHEN hs < aw AND ot THEN 'OTL' WHEN hs < aw THEN 'L' ELSE 'T' END AS result FROM ({SCORES})")
def p21(t):
    from shiftgrain.operators.box import game_scores

    g = game_scores(t.headers, t.events)
    return g.select("game_id", C("home_score").alias("hs"), C("away_score").alias("aw"), S.game_result("home_score", "away_score", "ot").alias("result"))


@query("P22_start_quality", """SELECT l_suppkey, starts_, sog, ga, saves, sog > 0 AND (saves / sog >= 0.917 OR (sog < 20 AND ga <= 2)) AS qs,
 sog > 0 AND saves / sog < 0.85 AS rbs, ga = 0 AS shutout FROM (SELECT l_suppkey, l_shipdate, count(*) AS starts_, count(*) FILTER (l_returnflag <> 'A') AS sog,
 count(*) FILTER (l_returnflag = 'R') AS ga, count(*) FILTER (l_returnflag = 'N') AS saves FROM lineitem GROUP BY 1, 2)""")
def p22(t):
    f = C("l_returnflag")
    g = t.raw("lineitem").groupBy("l_suppkey", "l_shipdate").agg(
        F.count(F.lit(1)).alias("starts_"), F.count_if(f != "A").alias("sog"), F.count_if(f == "R").alias("ga"), F.count_if(f == "N").alias("saves"))
    yes = F.lit(True)
    return g.select("l_suppkey", "starts_", "sog", "ga", "saves", S.quality_start(yes, "saves", "sog", "ga").alias("qs"),
                    S.really_bad_start(yes, "saves", "sog").alias("rbs"), (C("ga") == 0).alias("shutout"))


@query("P23_age_basis", """SELECT player_id, season, round(datediff('day', birthdate, make_date(season + 1, 1, 1)) / 365.25, 6) AS age,
 round(coalesce((datediff('day', birthdate, make_date(season + 1, 1, 1)) / 365.25 - 27) / 10, 0), 6) AS z FROM roster JOIN bios USING (player_id)""")
def p23(t):
    age = S.midseason_age("season", "birthdate")
    return t.roster.join(t.bios, "player_id").select("player_id", "season", age.alias("age"), S.age_z(age).alias("z"))


@query("P24_sigmoid_logit", "SELECT game_id, event_idx, round(ln(xg / (1 - xg)), 6) AS lx, round(1 / (1 + exp(-(xg * 4 - 1))), 6) AS sg FROM xg")
def p24(t):
    return t.xg.select(*KEY, S.logit("xg").alias("lx"), S.sigmoid(C("xg") * 4 - 1).alias("sg"))


@query("P25_curve_lookup", """
SELECT game_id, event_idx, round(CASE WHEN d <= 5 THEN 0.30 WHEN d >= 80 THEN 0.01
  WHEN d < 15 THEN 0.30 + (d - 5) / 10 * (0.18 - 0.30) WHEN d < 30 THEN 0.18 + (d - 15) / 15 * (0.09 - 0.18)
  WHEN d < 50 THEN 0.09 + (d - 30) / 20 * (0.04 - 0.09) ELSE 0.04 + (d - 50) / 30 * (0.01 - 0.04) END, 6) AS p
FROM (SELECT game_id, event_idx, distance AS d FROM shots)""")
def p25(t):
    from shiftgrain.models.chance import piecewise

    curve = [(5.0, 0.30), (15.0, 0.18), (30.0, 0.09), (50.0, 0.04), (80.0, 0.01)]
    return t.shots.select(*KEY, piecewise("distance", curve).alias("p"))


@query("P26_bin_index", """SELECT game_id, event_idx, least(floor(xg / 0.05), 19)::BIGINT AS bin, CASE WHEN abs(x) >= 25 AND abs(x) < 100 THEN floor((abs(x) - 25) / 3.0)::BIGINT END AS ix
 FROM xg JOIN shots USING (game_id, event_idx)""")
def p26(t):
    return t.xg.join(t.shots.select(*KEY, "x"), list(KEY)).select(
        *KEY, F.least(F.floor(C("xg") / 0.05), F.lit(19)).alias("bin"), S.grid_cell(F.abs("x"), 25, 3, 25).alias("ix"))


VENUE_CASE = "CASE raw_venue WHEN 'Brand#1' THEN 'Brand#2' WHEN 'Brand#7' THEN 'Brand#8' WHEN 'Brand#13' THEN 'Brand#14' ELSE raw_venue END"


@query("P27_alias", f"SELECT game_id, {VENUE_CASE} AS venue FROM headers")
def p27(t):
    from shiftgrain.operators.dims import canonical_venue

    return canonical_venue(t.headers).select("game_id", C("canonical").alias("venue"))


@query("P28_match_class", "SELECT game_id, event_idx, onice_match FROM onice")
def p28(t):
    return t.shots_onice.select(*KEY, "onice_match")


@query("P30_half_even", "SELECT o_orderkey, round_even(o_totalprice / 8, 1) AS v FROM orders")
def p30(t):
    return t.raw("orders").select("o_orderkey", S.half_even(C("o_totalprice") / 8, 1).alias("v"))


# --- predicates ---------------------------------------------------------------------------------

@query("F1_unblocked_universe", "SELECT game_id, event_idx, period FROM shots")
def f1(t):
    return t.shots.select(*KEY, "period")


@query("F2_modelled_universe", "SELECT game_id, event_idx FROM xg")
def f2(t):
    return X.modelled(t.shots).select(*KEY)


@query("F3_attribution_stints", "SELECT game_id, stint_idx, strength, duration_s FROM stints WHERE (game_id // 10000) % 100 = 2 AND strength IN ('5v5', '5v4', '4v5') AND NOT overload AND duration_s >= 10")
def f3(t):
    return E.attribution_stints(t.stints, ("5v5", "5v4", "4v5"), 10).select("game_id", "stint_idx", "strength", "duration_s")


@query("F4_count_stints", "SELECT game_id, stint_idx, strength FROM stints WHERE (game_id // 10000) % 100 = 2 AND strength = '5v5' AND NOT overload AND duration_s >= 1")
def f4(t):
    return E.attribution_stints(t.stints, ("5v5",), 1).select("game_id", "stint_idx", "strength")


@query("F5_duel_universe", "SELECT game_id, event_idx, shooter_id, goalie_id FROM onice WHERE shooter_id IS NOT NULL AND goalie_id IS NOT NULL AND xg IS NOT NULL")
def f5(t):
    return E.duel_shots(t.shots_onice).select(*KEY, "shooter_id", "goalie_id")


@query("F6_timeline_events", "SELECT game_id, event_idx, type FROM ev WHERE type IN ('goal', 'shot-on-goal', 'missed-shot', 'blocked-shot', 'penalty', 'faceoff', 'hit', 'giveaway', 'takeaway', 'stoppage') AND game_id IN (SELECT game_id FROM shots)")
def f6(t):
    games = t.shots.select("game_id").distinct()
    return t.events.where(C("type").isin(*E.TIMELINE_TYPES)).join(games, "game_id", "left_semi").select(*KEY, "type")


@query("F7_known_teams", "SELECT game_id, player_id, shift_number, s.team FROM shifts s JOIN headers h USING (game_id) WHERE s.team IN (h.home_team, h.away_team)")
def f7(t):
    from shiftgrain.operators.intervals import keep_known_teams

    return keep_known_teams(t.shifts, t.headers).select("game_id", "player_id", "shift_number", "team")


@query("F8_teams_reconcile", """SELECT game_id, bool_or(s.team = h.home_team) AND bool_and(s.team IN (h.home_team, h.away_team)) AS reconciled, bool_or(s.team = h.home_team) AS usable
 FROM shifts s JOIN headers h USING (game_id) GROUP BY 1""")
def f8(t):
    j = t.shifts.join(t.headers, "game_id")
    home = F.bool_or(C("team") == C("home_team"))
    return j.groupBy("game_id").agg((home & F.bool_and(C("team").isin(C("home_team"), C("away_team")))).alias("reconciled"), home.alias("usable"))


@query("F9_metric_gates", """SELECT player_id, CASE WHEN n >= 6 THEN round(ixg * 3600.0 / secs, 6) END AS ixg60, CASE WHEN secs >= 6000 THEN g * 3600.0 / secs END AS g60
FROM (SELECT shooter_id AS player_id, count(*) AS n, sum(xg) AS ixg, sum(goal)::BIGINT AS g FROM onice WHERE xg IS NOT NULL GROUP BY 1)
JOIN (SELECT player_id, sum(duration_s)::BIGINT AS secs FROM shifts GROUP BY 1) USING (player_id)""")
def f9(t):
    sh = t.shots_onice.where("xg is not null").groupBy(C("shooter_id").alias("player_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("xg").alias("ixg"), F.sum("goal").alias("g"))
    ice = t.shifts.groupBy("player_id").agg(F.sum("duration_s").alias("secs"))
    df = sh.join(ice, "player_id").withColumn("ixg60", S.per60("ixg", "secs")).withColumn("g60", S.per60("g", "secs"))
    return E.gate(df, {"ixg60": ("n", 6), "g60": ("secs", 6000)}).select("player_id", "ixg60", "g60")


EVTOI = """SELECT player_id, sum(duration_s)::BIGINT AS secs FROM (SELECT unnest(list_concat(home_skaters, away_skaters)) AS player_id, duration_s FROM stints
 WHERE strength = '5v5' AND NOT overload AND duration_s >= 10 AND (game_id // 10000) % 100 = 2) GROUP BY 1"""


@query("F10_membership", f"SELECT player_id, secs FROM ({EVTOI}) WHERE secs >= 600")
def f10(t):
    st = E.attribution_stints(t.stints, ("5v5",), 10)
    both = st.select("duration_s", F.explode(F.concat("home_skaters", "away_skaters")).alias("player_id"))
    return both.groupBy("player_id").agg(F.sum("duration_s").alias("secs")).where("secs >= 600")


@query("F11_priced_situations", """SELECT game_id, event_idx, (CASE WHEN is_home THEN sit_home_n ELSE sit_away_n END, CASE WHEN is_home THEN sit_away_n ELSE sit_home_n END)
 IN ((5, 5), (5, 4)) AS priced FROM onice WHERE goal = 1 AND sit_home_n IS NOT NULL AND sit_away_n IS NOT NULL""")
def f11(t):
    g = t.shots_onice.where("goal = 1 and sit_home_n is not null and sit_away_n is not null")
    return g.select(*KEY, E.is_priced().alias("priced"))


@query("F12_search", "SELECT player_id, season, player_name FROM roster WHERE player_name ILIKE '%#1%' AND position IN ('D', 'G') AND team = 'T000'")
def f12(t):
    return t.roster.where(C("player_name").ilike("%#1%") & C("position").isin("D", "G") & (C("team") == "T000")).select("player_id", "season", "player_name")
