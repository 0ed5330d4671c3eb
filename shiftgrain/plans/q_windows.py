"""Window operators (W*), sorts and limits (O*), sources and sinks that read the tables (S*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S
from shiftgrain.operators import box as B
from shiftgrain.operators import dims as D
from shiftgrain.operators import eligibility as E
from shiftgrain.operators import pairs as P
from shiftgrain.operators import ranking as R
from shiftgrain.operators import shots as X
from shiftgrain.operators.segments import ordered_scan, recent_count
from shiftgrain.plans.catalog import query
from shiftgrain.plans.q_joins import GAMES_DIM
from shiftgrain.sources import landing as L

C = F.col
KEY = ["game_id", "event_idx"]


@query("W1_lag_in_game", "SELECT game_id, event_idx, lag(type) OVER w AS prev_type, lag(x) OVER w AS prev_x FROM ev WINDOW w AS (PARTITION BY game_id ORDER BY time_g, event_idx)")
def w1(t):
    return ordered_scan(t.events, ["game_id"], "time_g", ["event_idx"], previous={"prev_type": "type", "prev_x": "x"}).select(*KEY, "prev_type", "prev_x")


@query("W2_forward_fill", "SELECT game_id, event_idx, last_value(CASE WHEN type = 'faceoff' THEN zone END IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY time_g, event_idx ROWS UNBOUNDED PRECEDING) AS fo_zone FROM ev")
def w2(t):
    return ordered_scan(t.events, ["game_id"], "time_g", ["event_idx"], last_seen={"fo_zone": F.when(C("type") == "faceoff", C("zone"))}).select(*KEY, "fo_zone")


@query("W3_running_score", """SELECT game_id, event_idx, coalesce(sum(CASE WHEN type = 'goal' AND is_home THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS home_score,
 coalesce(sum(CASE WHEN type = 'goal' AND NOT is_home THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS away_score FROM ev WINDOW w AS (PARTITION BY game_id ORDER BY time_g, event_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w3(t):
    g = C("type") == "goal"
    return ordered_scan(t.events, ["game_id"], "time_g", ["event_idx"], running_before={
        "home_score": (g & C("is_home")).cast("long"), "away_score": (g & ~C("is_home")).cast("long")}).select(*KEY, "home_score", "away_score")


@query("W4_recent_attempts", """SELECT a.game_id, a.event_idx, (SELECT count(*) FROM ev b WHERE b.game_id = a.game_id AND b.is_home = a.is_home AND b.type IN ('shot-on-goal', 'missed-shot', 'blocked-shot', 'goal')
  AND b.time_g >= a.time_g - 15 AND (b.time_g, b.event_idx) < (a.time_g, a.event_idx)) AS n FROM ev a WHERE a.type IN ('shot-on-goal', 'missed-shot', 'blocked-shot', 'goal')""")
def w4(t):
    e = t.events.where(C("type").isin(*S.CORSI)).select(*KEY, "is_home", "time_g")
    return recent_count(e, ["game_id", "is_home"], "time_g", ["event_idx"], "n", 15).select(*KEY, "n")


@query("W5_percentile_in_group", """SELECT player_id, round_even(100 * r, 0) AS pct, round_even(100 * (1 - r), 0) AS rev FROM (SELECT shooter_id AS player_id,
 (rank() OVER (PARTITION BY position ORDER BY n) + (count(*) OVER (PARTITION BY position, n) - 1) / 2) / count(*) OVER (PARTITION BY position) AS r
 FROM (SELECT shooter_id, count(*) AS n FROM shots GROUP BY 1) JOIN (SELECT player_id AS shooter_id, arg_max(position, season) AS position FROM roster GROUP BY 1) USING (shooter_id))""")
def w5(t):
    n = t.shots.groupBy(C("shooter_id").alias("player_id")).agg(F.count(F.lit(1)).alias("n"))
    j = n.join(t.roster.groupBy("player_id").agg(F.max_by("position", "season").alias("position")), "player_id")
    r = R.tie_average_rank(j, ["position"], "n", "r")
    return r.select("player_id", F.bround(100 * C("r"), 0).alias("pct"), F.bround(100 * (1 - C("r")), 0).alias("rev"))


@query("W6_ordinal_percentile", """SELECT o_orderkey, CASE WHEN n > 1 THEN round_even((rn - 1) / (n - 1) * 100, 0) END AS pct FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn,
 count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""")
def w6(t):
    o = t.raw("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return R.ordinal_percentile(o, ["o_orderpriority"], "o_totalprice", "o_orderkey", "pct").select("o_orderkey", "pct")


@query("W7_first_in_group", "SELECT game_id, player_id, shift_number, shift_number = 1 AS is_first, count(*) OVER (PARTITION BY game_id, player_id) AS group_size FROM shifts")
def w7(t):
    w = Window.partitionBy("game_id", "player_id")
    return t.shifts.select("game_id", "player_id", "shift_number", (F.row_number().over(w.orderBy("start_g")) == 1).alias("is_first"), F.count(F.lit(1)).over(w).alias("group_size"))


@query("W8_ordinal_in_group", "SELECT game_id, start_g, row_number() OVER (PARTITION BY game_id ORDER BY start_g) - 1 AS pos FROM stints")
def w8(t):
    return t.stints.select("game_id", "start_g", (F.row_number().over(Window.partitionBy("game_id").orderBy("start_g")) - 1).alias("pos"))


@query("W9_top_k", "SELECT shooter_id, event_idx, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY shooter_id ORDER BY distance, event_idx) AS rn FROM shots) WHERE rn <= 3")
def w9(t):
    return R.top_k(t.shots.select("shooter_id", "event_idx", "distance"), ["shooter_id"], [F.asc("distance"), F.asc("event_idx")], 3).select("shooter_id", "event_idx", "rank")


@query("W10_gaps", "SELECT game_id, player_id, shift_number, lead(start_g) OVER (PARTITION BY game_id, player_id ORDER BY start_g) - end_g AS bench FROM shifts")
def w10(t):
    w = Window.partitionBy("game_id", "player_id").orderBy("start_g")
    return t.shifts.select("game_id", "player_id", "shift_number", (F.lead("start_g").over(w) - C("end_g")).alias("bench"))


@query("W11_latest_team", "SELECT player_id, arg_max(team, (game_date, game_id)) AS team FROM (SELECT DISTINCT player_id, team, game_id, game_date FROM shifts JOIN headers USING (game_id) WHERE team <> 'ZZZ') GROUP BY 1")
def w11(t):
    s = t.shifts.where("team <> 'ZZZ'").join(t.headers.select("game_id", "game_date"), "game_id")
    return s.groupBy("player_id").agg(F.max_by("team", F.struct("game_date", "game_id")).alias("team"))


EDGES = "SELECT player_id, season, lag(season) OVER (PARTITION BY player_id ORDER BY season) AS prev_season FROM (SELECT DISTINCT player_id, season FROM shifts)"


def _units(t):
    return P.player_season_units(t.shifts.select("player_id", "season").distinct())


@query("W12_season_edges", f"SELECT player_id, season, prev_season, season - prev_season AS gap FROM ({EDGES}) WHERE prev_season IS NOT NULL")
def w12(t):
    return _units(t).where("prev_season is not null").select("player_id", "season", "prev_season", "gap")


@query("W13_first_state", f"SELECT player_id, season, prev_season IS NULL AS first_state FROM ({EDGES})")
def w13(t):
    return _units(t).select("player_id", "season", "first_state")


@query("W14_last_state", "SELECT player_id, max(season) AS last_season, arg_max(n, season) AS last_n FROM (SELECT shooter_id AS player_id, season, count(*) AS n FROM shots GROUP BY 1, 2) GROUP BY 1")
def w14(t):
    s = t.shots.groupBy(C("shooter_id").alias("player_id"), "season").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("player_id").agg(F.max("season").alias("last_season"), F.max_by("n", "season").alias("last_n"))


@query("W15_every_nth", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) WHERE p % greatest(1, n // 60) = 0 AND p // greatest(1, n // 60) < 60")
def w15(t):
    return R.every_nth(t.raw("orders").select("o_orderkey"), ["o_orderkey"], 60)


# --- sorts and limits ---------------------------------------------------------------------------

@query("O1_game_order", "SELECT game_id, game_date::VARCHAR AS game_date FROM headers ORDER BY coalesce(game_date::VARCHAR, '') DESC, game_id DESC")
def o1(t):
    return t.headers.select("game_id", "game_date").orderBy(F.desc(F.coalesce(C("game_date").cast("string"), F.lit(""))), F.desc("game_id"))


IXG60 = "SELECT player_id, CASE WHEN n >= 12 THEN x * 3600.0 / secs END AS r FROM (SELECT shooter_id AS player_id, count(*) AS n, sum(xg) AS x FROM scored GROUP BY 1) JOIN (SELECT player_id, sum(duration_s) AS secs FROM shifts GROUP BY 1) USING (player_id)"


def _ixg60(t):
    sh = t.scored_shots.groupBy(C("shooter_id").alias("player_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("xg").alias("x"))
    ice = t.shifts.groupBy("player_id").agg(F.sum("duration_s").alias("secs"))
    return sh.join(ice, "player_id").withColumn("r", F.when(C("n") >= 12, S.per60("x", "secs")))


@query("O2_player_order", f"SELECT player_id, round(r, 6) AS r FROM ({IXG60}) ORDER BY r DESC NULLS LAST")
def o2(t):
    return _ixg60(t).select("player_id", "r").orderBy(F.desc_nulls_last("r"))


@query("O3_goalie_order", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') / nullif(count(*) FILTER (l_quantity > 45), 0) AS r FROM lineitem GROUP BY 1 ORDER BY r DESC NULLS LAST")
def o3(t):
    g = t.raw("lineitem").groupBy("l_suppkey").agg(F.count_if(C("l_returnflag") == "R").alias("a"), F.count_if(C("l_quantity") > 45).alias("b"))
    return g.select("l_suppkey", S.ratio("a", "b").alias("r")).orderBy(F.desc_nulls_last("r"))


BOARD = "SELECT shooter_id, count(*) AS n, sum(goal) - sum(xg) AS above FROM duels GROUP BY 1 HAVING count(*) >= 20"


@query("O4_leaderboards", f"""SELECT 'top' AS board, shooter_id, n, round(above, 6) AS above FROM (SELECT * FROM ({BOARD}) ORDER BY round(above, 6) DESC, shooter_id LIMIT 10) UNION ALL
 SELECT 'bottom', shooter_id, n, round(above, 6) FROM (SELECT * FROM ({BOARD}) ORDER BY round(above, 6), shooter_id LIMIT 10)""")
def o4(t):
    g = t.duels.groupBy("shooter_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("goal") - F.sum("xg"), 6).alias("above"))
    ok = C("n") >= 20
    top = R.leaderboard(g, ok, [F.desc("above"), F.asc("shooter_id")], 10).withColumn("board", F.lit("top"))
    return top.unionByName(R.leaderboard(g, ok, [F.asc("above"), F.asc("shooter_id")], 10).withColumn("board", F.lit("bottom")))


@query("O5_largest_gaps", "SELECT off_nation, round(sum(goal) - sum(xg), 6) AS gap FROM duels GROUP BY 1 ORDER BY abs(sum(goal) - sum(xg)) DESC, 1 LIMIT 5")
def o5(t):
    g = t.duels.groupBy("off_nation").agg((F.sum("goal") - F.sum("xg")).alias("gap"))
    return g.orderBy(F.desc(F.abs("gap")), "off_nation").limit(5)


@query("O6_multi_key_sort", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def o6(t):
    return t.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey")


PICKS = "SELECT shooter_id, count(*) AS n, sum(goal) AS g, round(sum(xg), 6) AS x FROM duels GROUP BY 1"


@query("O7_greedy_templates", f"""WITH a AS (SELECT * FROM ({PICKS}) ORDER BY n DESC, shooter_id LIMIT 1), b AS (SELECT * FROM ({PICKS}) WHERE shooter_id NOT IN (SELECT shooter_id FROM a) ORDER BY g DESC, shooter_id LIMIT 1),
 c AS (SELECT * FROM ({PICKS}) WHERE n >= 30 AND shooter_id NOT IN (SELECT shooter_id FROM a UNION ALL SELECT shooter_id FROM b) ORDER BY x DESC, shooter_id LIMIT 1)
 SELECT 'volume' AS label, shooter_id FROM a UNION ALL SELECT 'goals', shooter_id FROM b UNION ALL SELECT 'chances', shooter_id FROM c""")
def o7(t):
    g = t.duels.groupBy("shooter_id").agg(F.count(F.lit(1)).alias("n"), F.sum("goal").alias("g"), F.round(F.sum("xg"), 6).alias("x"))
    yes = F.lit(True)
    return R.greedy_distinct(g, "shooter_id", [
        ("volume", yes, [F.desc("n"), F.asc("shooter_id")]), ("goals", yes, [F.desc("g"), F.asc("shooter_id")]),
        ("chances", C("n") >= 30, [F.desc("x"), F.asc("shooter_id")])]).select("label", "shooter_id")


# --- sources ------------------------------------------------------------------------------------

@query("S1_projected_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01'")
def s1(t):
    return t.raw("lineitem").where(C("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_quantity")


@query("S2_season_load", "SELECT season, count(*) AS n, round(sum(xg), 4) AS xg FROM duels WHERE season IN (1996, 1997, 1998) GROUP BY 1")
def s2(t):
    return t.duels.where(C("season").isin(1996, 1997, 1998)).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("xg"), 4).alias("xg"))


@query("S4_roster_last_seen", "SELECT player_id, season, position, number, team FROM roster")
def s4(t):
    return t.roster.select("player_id", "season", "position", "number", "team")


@query("S6_report_cells", """SELECT page_id, len(regexp_extract_all(html, '<(?:h1|p)>')) AS cells, len(regexp_extract_all(html, '<h1>')) AS headers FROM pages""")
def s6(t):
    return L.count_cells(t.raw("pages"), "page_id", "html", r"<(?:h1|p)>", r"<h1>")


@query("S7_feed_fallback", """SELECT game_id, src, count(*) AS n FROM (SELECT game_id, 'a' AS src FROM shift_rows WHERE game_id % 3 <> 0 UNION ALL
 SELECT game_id, 'b' FROM shift_rows WHERE game_id NOT IN (SELECT game_id FROM shift_rows WHERE game_id % 3 <> 0)) GROUP BY 1, 2""")
def s7(t):
    first = t.shift_rows.where(C("game_id") % 3 != 0).withColumn("src", F.lit("a"))
    return L.with_fallback(first, t.shift_rows.withColumn("src", F.lit("b")), "game_id").groupBy("game_id", "src").agg(F.count(F.lit(1)).alias("n"))


@query("S13_landing_plan", """SELECT season, count(*) AS scheduled, count(*) FILTER (NOT final) AS pending, count(*) FILTER (final AND n IS NULL) AS missing, count(*) FILTER (final AND n < 100) AS stale, count(*) FILTER (final AND n >= 100) AS present
 FROM (SELECT season, game_id, game_id % 11 <> 0 AS final FROM headers) LEFT JOIN (SELECT game_id, count(*) AS n FROM ev WHERE game_id % 7 <> 0 GROUP BY 1) USING (game_id) GROUP BY 1""")
def s13(t):
    sched = t.headers.select("season", "game_id", F.when(C("game_id") % 11 != 0, "OFF").otherwise("FUT").alias("state"))
    have = t.events.where(C("game_id") % 7 != 0).groupBy("game_id").agg(F.count(F.lit(1)).alias("size"))
    return L.plan_counts(L.landing_plan(sched, have, 100))


@query("S14_schedule_union", "SELECT DISTINCT game_id, home_team, away_team FROM headers WHERE (game_id // 10000) % 100 = 2")
def s14(t):
    clubs = t.headers.select(F.explode(F.array("home_team", "away_team")).alias("club"), "game_id", "home_team", "away_team", "game_date")
    return L.schedule_union(clubs).select("game_id", "home_team", "away_team")


@query("S16_both_feeds", "SELECT game_id FROM ev WHERE type = 'goal' INTERSECT SELECT game_id FROM ev WHERE type = 'penalty'")
def s16(t):
    return L.in_both(t.events.where("type = 'goal'"), t.events.where("type = 'penalty'"), "game_id")


@query("S18_full_seasons", "SELECT season FROM ev GROUP BY 1 HAVING count(DISTINCT game_id) >= 24")
def s18(t):
    return L.full_seasons(t.events, 24)


@query("S10_game_documents", """SELECT game_id, home_team AS home, home_score, n AS n_stints, p AS n_players FROM scores JOIN (SELECT game_id, count(*) AS n FROM stints GROUP BY 1) USING (game_id)
 JOIN (SELECT game_id, count(*) AS p FROM gplayers GROUP BY 1) USING (game_id)""")
def s10(t):
    from shiftgrain.sources import documents as DOC

    idx = B.game_index(B.game_scores(t.headers, t.events), t.stints, t.shots_onice)
    docs = DOC.game_documents(idx, t.stints, B.game_players(t.shifts, t.events, t.shots_onice))
    j = lambda p: F.get_json_object("doc", p)
    return docs.select("game_id", j("$.home").alias("home"), j("$.totals.home_score").cast("long").alias("home_score"),
                       F.json_array_length(j("$.stints")).alias("n_stints"), F.json_array_length(j("$.players")).alias("n_players"))


@query("S11_season_merge", "SELECT season, game_id FROM headers ORDER BY game_date DESC, game_id DESC")
def s11(t):
    old = t.headers.where("season <= 2023").withColumn("v", F.lit(1))
    new = t.headers.where("season >= 2023").withColumn("v", F.lit(2))
    return L.replace_seasons(old, new).orderBy(F.desc("game_date"), F.desc("game_id")).select("season", "game_id")
