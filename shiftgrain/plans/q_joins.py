"""Joins (J*), interval algebra (I*) and set operations (U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S
from shiftgrain.operators import box as B
from shiftgrain.operators import dims as D
from shiftgrain.operators import eligibility as E
from shiftgrain.operators import intervals as I
from shiftgrain.operators import pairs as P
from shiftgrain.operators import shots as X
from shiftgrain.operators.segments import ordered_scan
from shiftgrain.operators.sides import attacking_sides
from shiftgrain.plans.catalog import query

C = F.col
KEY = ["game_id", "event_idx"]


@query("J1_shots_chance", "SELECT game_id, event_idx, round(xg, 6) AS xg FROM scored")
def j1(t):
    return t.shots.select(*KEY).join(t.xg, KEY, "left")


@query("J2_shots_assists", "SELECT game_id, event_idx, assist1_player_id, assist2_player_id FROM scored")
def j2(t):
    ga = t.events.where("type = 'goal'").select(*KEY, "assist1_player_id", "assist2_player_id")
    return t.shots.select(*KEY).join(ga, KEY, "left")


@query("J3_shot_stint", """SELECT e.game_id, e.event_idx, c.stint_idx FROM ev e LEFT JOIN cuts c ON c.game_id = e.game_id AND e.time_g > c.start_g AND e.time_g <= c.end_g
 WHERE e.type IN ('shot-on-goal', 'missed-shot', 'blocked-shot', 'goal') AND e.game_id IN (SELECT game_id FROM edges)""")
def j3(t):
    e = t.events.where(C("type").isin(*S.CORSI)).select(*KEY, "time_g")
    return I.attach_stint(e, t.clock, "shot").join(t.clock.select("game_id").distinct(), "game_id", "left_semi").select(*KEY, "stint_idx")


@query("J4_other_stint", """SELECT e.game_id, e.event_idx, c.stint_idx FROM ev e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY stint_idx DESC) = 1 AS is_last FROM cuts) c
 ON c.game_id = e.game_id AND e.time_g >= c.start_g AND (e.time_g < c.end_g OR (is_last AND e.time_g = c.end_g))
 WHERE e.type NOT IN ('shot-on-goal', 'missed-shot', 'blocked-shot', 'goal') AND e.game_id IN (SELECT game_id FROM edges)""")
def j4(t):
    e = t.events.where(~C("type").isin(*S.CORSI)).select(*KEY, "time_g")
    return I.attach_stint(e, t.clock, "other").join(t.clock.select("game_id").distinct(), "game_id", "left_semi").select(*KEY, "stint_idx")


@query("J5_presence", "SELECT game_id, stint_idx, player_id, is_home, is_goalie FROM present")
def j5(t):
    return t.presence.select("game_id", "stint_idx", "player_id", "is_home", "is_goalie").distinct()


@query("J6_faceoff_zones", "SELECT game_id, stint_idx, start_zone, end_zone, start_type FROM stints")
def j6(t):
    return I.stint_context(t.clock).select("game_id", "stint_idx", "start_zone", "end_zone", "start_type")


@query("J7_score_asof", "SELECT game_id, stint_idx, home_lead FROM lead_at")
def j7(t):
    return I.stint_context(t.clock).select("game_id", "stint_idx", "home_lead")


@query("J8_previous_event", "SELECT game_id, event_idx, prev_type, prev_zone, prev_x, prev_y, gap, prev_home FROM ev_prev")
def j8(t):
    return X.with_previous(t.events).select(*KEY, "prev_type", "prev_zone", "prev_x", "prev_y", (C("time_g") - C("prev_time_g")).alias("gap"), C("prev_is_home").alias("prev_home"))


@query("J9_last_faceoff_attempt", """SELECT game_id, event_idx, time_g - last_value(CASE WHEN type = 'faceoff' THEN time_g END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS since_faceoff,
 time_g - last_value(CASE WHEN type IN ('shot-on-goal', 'missed-shot', 'blocked-shot', 'goal') THEN time_g END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since_attempt
 FROM ev WINDOW w AS (PARTITION BY game_id ORDER BY time_g, event_idx)""")
def j9(t):
    e = ordered_scan(
        t.events.select(*KEY, "time_g", "type"), ["game_id"], "time_g", ["event_idx"],
        last_seen={"fo": F.when(C("type") == "faceoff", C("time_g"))}, seen_before={"at": F.when(C("type").isin(*S.CORSI), C("time_g"))})
    return e.select(*KEY, (C("time_g") - C("fo")).alias("since_faceoff"), (C("time_g") - C("at")).alias("since_attempt"))


@query("J10_event_first_shot", """SELECT e.game_id, e.event_idx, round(s.xg, 6) AS xg, s.onice_match, s.shot_type FROM ev e LEFT JOIN
 (SELECT *, row_number() OVER (PARTITION BY game_id, shooter_id, time_g ORDER BY event_idx) AS rn FROM onice) s
 ON s.game_id = e.game_id AND s.shooter_id = e.primary_player_id AND s.time_g = e.time_g AND s.rn = 1 WHERE e.type IN ('shot-on-goal', 'missed-shot', 'goal')""")
def j10(t):
    first = t.shots_onice.groupBy("game_id", C("shooter_id").alias("primary_player_id"), "time_g").agg(
        F.min_by(F.struct("xg", "onice_match", "shot_type"), "event_idx").alias("s"))
    e = t.events.where(C("type").isin(*S.FENWICK)).select(*KEY, "primary_player_id", "time_g")
    return e.join(first, ["game_id", "primary_player_id", "time_g"], "left").select(*KEY, "s.xg", "s.onice_match", "s.shot_type")


@query("J11_offence_defence", """SELECT coalesce(o.season, d.season) AS season, coalesce(o.team, d.team) AS team, sf, gf, sa, ga FROM
 (SELECT season, off_nation AS team, count(*) AS sf, sum(goal)::BIGINT AS gf FROM duels GROUP BY 1, 2) o FULL JOIN
 (SELECT season, def_nation AS team, count(*) AS sa, sum(goal)::BIGINT AS ga FROM duels GROUP BY 1, 2) d ON o.season = d.season AND o.team = d.team""")
def j11(t):
    o = t.duels.groupBy("season", C("off_nation").alias("team")).agg(F.count(F.lit(1)).alias("sf"), F.sum("goal").alias("gf"))
    d = t.duels.groupBy("season", C("def_nation").alias("team")).agg(F.count(F.lit(1)).alias("sa"), F.sum("goal").alias("ga"))
    return o.join(d, ["season", "team"], "full").select("season", "team", "sf", "gf", "sa", "ga")


GAME_COUNTS = """SELECT game_id, player_id, count(*) FILTER (k = 'g') AS g, count(*) FILTER (k = 'a1') AS a1, count(*) FILTER (k = 'a2') AS a2,
 count(*) FILTER (k = 'sog') AS sog, count(*) FILTER (k = 'pen') AS pen FROM (
 SELECT game_id, primary_player_id AS player_id, 'g' AS k FROM ev WHERE type = 'goal' AND period < 5
 UNION ALL SELECT game_id, assist1_player_id, 'a1' FROM ev WHERE type = 'goal' AND period < 5
 UNION ALL SELECT game_id, assist2_player_id, 'a2' FROM ev WHERE type = 'goal' AND period < 5
 UNION ALL SELECT game_id, primary_player_id, 'sog' FROM ev WHERE type IN ('goal', 'shot-on-goal') AND period < 5
 UNION ALL SELECT game_id, primary_player_id, 'pen' FROM ev WHERE type = 'penalty' AND period < 5) WHERE player_id IS NOT NULL GROUP BY 1, 2"""


@query("J12_count_series", GAME_COUNTS)
def j12(t):
    return B.game_counts(t.events)


@query("J13_box_base", f"""SELECT s.game_id, s.player_id, s.secs, coalesce(c.g, 0) AS g, coalesce(c.sog, 0) AS sog, r.position FROM
 (SELECT game_id, season, player_id, sum(duration_s)::BIGINT AS secs FROM shifts GROUP BY 1, 2, 3) s LEFT JOIN ({GAME_COUNTS}) c USING (game_id, player_id)
 LEFT JOIN roster r ON r.player_id = s.player_id AND r.season = s.season""")
def j13(t):
    base = t.shifts.groupBy("game_id", "season", "player_id").agg(F.sum("duration_s").alias("secs"))
    j = base.join(B.game_counts(t.events), ["game_id", "player_id"], "left").join(t.roster.select("player_id", "season", "position"), ["player_id", "season"], "left")
    return j.fillna(0, ["g", "sog"]).select("game_id", "player_id", "secs", "g", "sog", "position")


@query("J14_goalie_members", "SELECT game_id, player_id, shift_number FROM shifts WHERE player_id IN (SELECT player_id FROM goalie_ids)")
def j14(t):
    g = t.roster.where("position = 'G'").select("player_id").distinct()
    return t.shifts.join(g, "player_id", "left_semi").select("game_id", "player_id", "shift_number")


VENUE = "CASE raw_venue WHEN 'Brand#1' THEN 'Brand#2' WHEN 'Brand#7' THEN 'Brand#8' WHEN 'Brand#13' THEN 'Brand#14' ELSE raw_venue END"
VENUES = f"""SELECT canonical, row_number() OVER (ORDER BY canonical) - 1 AS venue_id, raw_names, active_seasons FROM (SELECT {VENUE} AS canonical,
 array_to_string(list_sort(list(DISTINCT raw_venue)), ',') AS raw_names, array_to_string(list_sort(list(DISTINCT season)), ',') AS active_seasons FROM headers WHERE raw_venue IS NOT NULL GROUP BY 1)"""
GAMES_DIM = f"SELECT game_id, season, raw_venue, coalesce(v.venue_id, -1) AS venue_id FROM headers LEFT JOIN ({VENUES}) v ON v.canonical = {VENUE}"


@query("J15_venue_lookup", f"SELECT game_id, venue_id FROM ({GAMES_DIM})")
def j15(t):
    return D.games_dimension(t.headers, D.venues(t.headers)).select("game_id", "venue_id")


@query("J16_log_vs_box", f"""SELECT a.player_id, a.season, log_sog, box_sog, log_sog = box_sog AS ok FROM
 (SELECT player_id, (game_id // 1000000) % 10000 AS season, sum(sog)::BIGINT AS log_sog FROM ({GAME_COUNTS}) GROUP BY 1, 2) a JOIN
 (SELECT primary_player_id AS player_id, season, count(*) AS box_sog FROM ev WHERE period < 5 AND type IN ('goal', 'shot-on-goal') GROUP BY 1, 2) b
 ON a.player_id = b.player_id AND a.season = b.season""")
def j16(t):
    log = B.game_counts(t.events).groupBy("player_id", S.season_of_id("game_id").cast("long").alias("season")).agg(F.sum("sog").alias("log_sog"))
    box = B.counters(B.credits(t.events, "season"), "season").select("player_id", "season", C("sog").alias("box_sog")).where("box_sog > 0")
    return log.join(box, ["player_id", "season"]).select("player_id", "season", "log_sog", "box_sog", (C("log_sog") == C("box_sog")).alias("ok"))


PAIRS = """SELECT a, b, sum(duration_s)::BIGINT AS secs FROM (SELECT duration_s, unnest(ids) AS a, ids FROM (SELECT duration_s, unnest([home_skaters, away_skaters]) AS ids FROM stints
 WHERE strength = '5v5' AND NOT overload AND duration_s >= 10 AND (game_id // 10000) % 100 = 2)), unnest(ids) AS u(b) WHERE a < b GROUP BY 1, 2"""


@query("J17_pairs_on_ice", PAIRS)
def j17(t):
    return P.pair_seconds(E.attribution_stints(t.stints, ("5v5",), 10))


@query("J18_slot_parameters", """SELECT game_id, stint_idx, round(sum(CASE WHEN atk THEN n ELSE -n END), 6) AS s FROM (
 SELECT game_id, stint_idx, unnest(home_skaters) AS player_id, true AS atk FROM stints WHERE strength = '5v5' UNION ALL
 SELECT game_id, stint_idx, unnest(away_skaters), false FROM stints WHERE strength = '5v5') JOIN
 (SELECT shooter_id AS player_id, count(*) / 100.0::DOUBLE AS n FROM shots GROUP BY 1) USING (player_id) GROUP BY 1, 2""")
def j18(t):
    par = t.shots.groupBy(C("shooter_id").alias("player_id")).agg((F.count(F.lit(1)) / 100.0).alias("n"))
    st = t.stints.where("strength = '5v5'")
    slots = F.concat(
        F.transform("home_skaters", lambda p: F.struct(p.alias("player_id"), F.lit(1.0).alias("w"))),
        F.transform("away_skaters", lambda p: F.struct(p.alias("player_id"), F.lit(-1.0).alias("w"))))
    rows = st.select("game_id", "stint_idx", F.explode(slots).alias("s")).select("game_id", "stint_idx", "s.*")
    return rows.join(par, "player_id").groupBy("game_id", "stint_idx").agg(F.sum(C("n") * C("w")).alias("s"))


UNITS = "SELECT player_id, season, row_number() OVER (ORDER BY player_id, season) - 1 AS unit_id, lag(season) OVER (PARTITION BY player_id ORDER BY season) AS prev_season FROM (SELECT DISTINCT player_id, season FROM shifts)"


@query("J19_unit_lookup", f"SELECT e.game_id, e.event_idx, coalesce(u.unit_id, -1) AS unit_id FROM ev e LEFT JOIN ({UNITS}) u ON u.player_id = e.assist1_player_id AND u.season = e.season WHERE e.type = 'goal'")
def j19(t):
    u = P.player_season_units(t.shifts.select("player_id", "season").distinct())
    g = t.events.where("type = 'goal'").select(*KEY, "season", C("assist1_player_id").alias("player_id"))
    return g.join(u.select("player_id", "season", "unit_id"), ["player_id", "season"], "left").select(*KEY, F.coalesce("unit_id", F.lit(-1)).alias("unit_id"))


@query("J20_unseen_default", """SELECT r.player_id, round(coalesce(p.rate, d.mean, 0), 6) AS rate FROM (SELECT DISTINCT player_id, position FROM roster WHERE season = (SELECT max(season) FROM roster)) r
 LEFT JOIN (SELECT shooter_id AS player_id, avg(xg) AS rate FROM onice WHERE season = (SELECT min(season) FROM roster) AND xg IS NOT NULL GROUP BY 1) p USING (player_id)
 LEFT JOIN (SELECT position, avg(rate) AS mean FROM (SELECT shooter_id AS player_id, avg(xg) AS rate FROM onice WHERE season = (SELECT min(season) FROM roster) AND xg IS NOT NULL GROUP BY 1)
  JOIN (SELECT DISTINCT player_id, position FROM roster WHERE season = (SELECT min(season) FROM roster)) USING (player_id) GROUP BY 1) d USING (position)""")
def j20(t):
    """Rates of the first season given to the players of the last one, unseen players get their position's mean."""
    first, last = t.roster.agg(F.min("season"), F.max("season")).first()
    train = t.shots_onice.where((C("season") == first) & C("xg").isNotNull()).groupBy(C("shooter_id").alias("player_id")).agg(F.avg("xg").alias("rate"))
    pos = t.roster.where(C("season") == first).select("player_id", "position")
    mean = train.join(pos, "player_id").groupBy("position").agg(F.avg("rate").alias("mean"))
    target = t.roster.where(C("season") == last).select("player_id", "position")
    return P.with_default(target, train, mean, "rate").select("player_id", "rate")


@query("J21_shooter_counts", """SELECT st.game_id, st.stint_idx, array_to_string(list(CAST(s.shooter_id AS VARCHAR) || ':' || CAST(s.n AS VARCHAR) ORDER BY s.shooter_id) FILTER (s.n IS NOT NULL), ',') AS counts
 FROM stints st LEFT JOIN (SELECT game_id, stint_idx, shooter_id, count(*) AS n FROM onice GROUP BY 1, 2, 3) s USING (game_id, stint_idx) WHERE st.strength = '5v5' GROUP BY 1, 2""")
def j21(t):
    n = t.shots_onice.groupBy("game_id", "stint_idx", "shooter_id").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("game_id", "stint_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("shooter_id", "n")))).alias("m"))
    st = t.stints.where("strength = '5v5'").select("game_id", "stint_idx").join(m, ["game_id", "stint_idx"], "left")
    txt = F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return st.select("game_id", "stint_idx", F.array_join(txt, ",").alias("counts"))


@query("J22_venue_states", f"""SELECT g.game_id, s.venue_id, s.season, s.gap FROM ({GAMES_DIM}) g LEFT JOIN (SELECT *, season - lag(season) OVER (PARTITION BY venue_id ORDER BY season) AS gap FROM
 (SELECT venue_id, season, sum(count(*)) OVER (PARTITION BY venue_id) AS total FROM ({GAMES_DIM}) WHERE venue_id >= 0 GROUP BY 1, 2) WHERE total >= 20) s ON s.venue_id = g.venue_id AND s.season = g.season""")
def j22(t):
    g = D.games_dimension(t.headers, D.venues(t.headers)).select("game_id", "season", "venue_id")
    s = D.venue_states(g).select(C("venue_id").alias("v"), C("season").alias("s"), "gap")
    j = g.join(s, (C("venue_id") == C("v")) & (C("season") == C("s")), "left")
    return j.select("game_id", C("v").alias("venue_id"), C("s").alias("season"), "gap")


@query("J23_index_vs_detail", """SELECT DISTINCT 'index without detail' AS kind, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) UNION ALL
 SELECT DISTINCT 'detail without index', user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def j23(t):
    index = t.raw("customer").select(C("c_custkey").alias("id"))
    detail = t.raw("events").select(C("user_id").alias("id")).distinct()
    a = index.join(detail, "id", "left_anti").select(F.lit("index without detail").alias("kind"), "id")
    return a.unionByName(detail.join(index, "id", "left_anti").select(F.lit("detail without index").alias("kind"), "id"))


@query("J24_prediction_grid", """SELECT x, y, st, round(40 / (20 + sqrt((89 - x) ** 2 + y ** 2)), 6) AS v FROM (SELECT unnest(range(26, 90, 2)) AS x), (SELECT unnest(range(-42, 43, 2)) AS y),
 (SELECT DISTINCT shot_type AS st FROM shots WHERE shot_type IS NOT NULL)""")
def j24(t):
    from shiftgrain.operators.grids import prediction_grid

    kinds = t.shots.where("shot_type is not null").select(C("shot_type").alias("st")).distinct()
    return prediction_grid(kinds).select("x", "y", "st", (F.lit(40.0) / (20.0 + S.distance_to_net("x", "y"))).alias("v"))


# --- intervals ----------------------------------------------------------------------------------

@query("I1_merge_intervals", "SELECT game_id, player_id, start_g, end_g, period FROM shifts")
def i1(t):
    return t.shifts.select("game_id", "player_id", "start_g", "end_g", "period")


@query("I2_shift_numbers", "SELECT game_id, player_id, shift_number, duration_s FROM shifts")
def i2(t):
    return t.shifts.select("game_id", "player_id", "shift_number", "duration_s")


@query("I3_elementary_intervals", "SELECT game_id, stint_idx, start_g, end_g, duration_s FROM cuts")
def i3(t):
    return I.elementary_intervals(t.game_shifts)


@query("I4_active_sets", """SELECT game_id, stint_idx, array_to_string(home_skaters, ',') AS home_skaters, array_to_string(away_skaters, ',') AS away_skaters, home_goalie, away_goalie FROM people""")
def i4(t):
    return I.active_sets(t.presence).select("game_id", "stint_idx", F.array_join("home_skaters", ",").alias("home_skaters"), F.array_join("away_skaters", ",").alias("away_skaters"), "home_goalie", "away_goalie")


@query("I5_strength", "SELECT game_id, stint_idx, home_n, away_n, strength, overload FROM stints")
def i5(t):
    return t.stints.select("game_id", "stint_idx", "home_n", "away_n", "strength", "overload")


@query("I6_stint_measures", """SELECT game_id, stint_idx, round(home_xgf, 6) AS home_xgf, round(away_xgf, 6) AS away_xgf, home_corsi, away_corsi, home_fen, away_fen, home_sog, away_sog FROM stints
 WHERE home_corsi + away_corsi > 0""")
def i6(t):
    return I.stint_volume(t.placed_events)


@query("I7_stint_context", "SELECT game_id, stint_idx, home_lead, start_zone, end_zone, start_type FROM stints")
def i7(t):
    return t.stints.select("game_id", "stint_idx", "home_lead", "start_zone", "end_zone", "start_type")


@query("I8_shots_onice", "SELECT game_id, event_idx, stint_idx, strength, onice_match, goalie_id, round(xg, 6) AS xg, distance, angle, rebound, rush FROM onice")
def i8(t):
    return t.shots_onice.select("game_id", "event_idx", "stint_idx", "strength", "onice_match", "goalie_id", "xg", "distance", "angle", "rebound", "rush")


@query("I9_contiguity", """SELECT game_id, count(*) AS n, count(*) FILTER (nxt <> end_g) AS gaps, count(*) FILTER (stint_idx <> rn) AS misnumbered FROM
 (SELECT *, lead(start_g) OVER (PARTITION BY game_id ORDER BY stint_idx) AS nxt, row_number() OVER (PARTITION BY game_id ORDER BY start_g) - 1 AS rn FROM stints) GROUP BY 1""")
def i9(t):
    from shiftgrain.operators.checks import stint_order

    return stint_order(t.stints).groupBy("game_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(C("next_start") != C("end_g")).alias("gaps"), F.count_if(C("stint_idx") != C("position")).alias("misnumbered"))


@query("I10_personnel_change", """SELECT game_id, stint_idx, array_to_string(list_sort(list_filter(home_skaters, lambda x: NOT list_contains(p, x))), ',') AS came_on,
 array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(home_skaters, x))), ',') AS went_off FROM (SELECT *, coalesce(lag(home_skaters) OVER (PARTITION BY game_id ORDER BY stint_idx), []) AS p FROM stints)""")
def i10(t):
    d = I.personnel_change(t.stints, "home_skaters")
    return d.select("game_id", "stint_idx", F.array_join(F.array_sort("came_on"), ",").alias("came_on"), F.array_join(F.array_sort("went_off"), ",").alias("went_off"))


@query("I11_exposure", """SELECT player_id, season, strength, sum(duration_s)::BIGINT AS seconds FROM (
 SELECT unnest(home_skaters) AS player_id, season, CAST(home_n AS VARCHAR) || 'v' || CAST(away_n AS VARCHAR) AS strength, duration_s FROM stints UNION ALL
 SELECT unnest(away_skaters), season, CAST(away_n AS VARCHAR) || 'v' || CAST(home_n AS VARCHAR), duration_s FROM stints) GROUP BY 1, 2, 3""")
def i11(t):
    return I.exposure(t.stints)


# --- sets ---------------------------------------------------------------------------------------

@query("U1_union_seasons", "SELECT season, count(*) AS n, round(sum(duration_s), 0)::BIGINT AS secs FROM shifts GROUP BY 1")
def u1(t):
    odd = C("season") % 2 == 1
    allp = t.shifts.where(odd).unionByName(t.shifts.where(~odd), allowMissingColumns=True)
    return allp.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_s").alias("secs"))


@query("U2_intersect_games", "SELECT game_id FROM shifts INTERSECT SELECT game_id FROM shots")
def u2(t):
    return t.shift_rows.select("game_id").intersect(t.events.where(X.is_unblocked_shot()).select("game_id"))


@query("U3_difference", "SELECT game_id FROM headers EXCEPT SELECT game_id FROM shots")
def u3(t):
    return t.headers.select("game_id").subtract(t.events.where(X.is_unblocked_shot()).select("game_id"))


@query("U4_distinct_over_arrays", "SELECT DISTINCT unnest(list_concat(home_skaters, away_skaters)) AS player_id FROM stints WHERE strength = '5v5'")
def u4(t):
    return t.stints.where("strength = '5v5'").select(F.explode(F.concat("home_skaters", "away_skaters")).alias("player_id")).distinct()
