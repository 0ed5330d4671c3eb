"""Attribution fits and the value ledger (M6-M19, A30, A31, A37, A38, V6, V7, V10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S
from shiftgrain.models import duel as DU
from shiftgrain.models import gram as GM
from shiftgrain.models import ledger as LG
from shiftgrain.operators import box as B
from shiftgrain.operators import checks as K
from shiftgrain.operators import eligibility as E
from shiftgrain.operators import rates as RT
from shiftgrain.plans.catalog import query
from shiftgrain.plans.oracle import CTES
from shiftgrain.plans.q_aggregates import PENV, STRENGTH_SHOTS
from shiftgrain.plans.q_checks import _union

C = F.col

CTES["sides"] = """
SELECT game_id, stint_idx, season, start_g, duration_s, home, strength, CASE WHEN home THEN home_skaters ELSE away_skaters END AS atk, CASE WHEN home THEN away_skaters ELSE home_skaters END AS dfd,
  CASE WHEN home THEN away_goalie ELSE home_goalie END AS goalie_id, CASE WHEN home THEN home_xgf ELSE away_xgf END AS xgf,
  CASE WHEN home THEN 1 ELSE 0 END AS c_home, CASE WHEN start_type = 'faceoff' AND start_zone = CASE WHEN home THEN 'O' ELSE 'D' END THEN 1 ELSE 0 END AS ozone,
  CASE WHEN start_type = 'faceoff' AND start_zone = CASE WHEN home THEN 'D' ELSE 'O' END THEN 1 ELSE 0 END AS dzone,
  CASE WHEN (home AND home_lead < 0) OR (NOT home AND home_lead > 0) THEN 1 ELSE 0 END AS trail, CASE WHEN (home AND home_lead > 0) OR (NOT home AND home_lead < 0) THEN 1 ELSE 0 END AS lead1, home_n, away_n
FROM stints CROSS JOIN (SELECT unnest([true, false]) AS home) WHERE (game_id // 10000) % 100 = 2 AND NOT overload"""
CTES["design"] = """
SELECT *, xgf * 3600.0 / duration_s AS y, duration_s::DOUBLE AS w, list_concat(list_transform(atk, lambda p: p * 2), list_transform(dfd, lambda p: p * 2 + 1), [-1],
  CASE WHEN home THEN [-2] ELSE [] END, CASE WHEN ozone = 1 THEN [-3] ELSE [] END, CASE WHEN dzone = 1 THEN [-4] ELSE [] END, CASE WHEN trail = 1 THEN [-5] ELSE [] END, CASE WHEN lead1 = 1 THEN [-6] ELSE [] END,
  CASE WHEN start_g // 1200 = 1 THEN [-7] ELSE [] END, CASE WHEN start_g // 1200 >= 2 THEN [-8] ELSE [] END, CASE WHEN season > 2021 THEN [-10000 - season] ELSE [] END) AS cols
FROM sides WHERE strength = '5v5' AND duration_s >= 10"""


def _design(t, spec="ev"):
    strengths, dual = (("5v5",), True) if spec == "ev" else (("5v4", "4v5"), False)
    return GM.side_design(E.attribution_stints(t.stints, strengths, 10), dual, 2021)


@query("M6_design", "SELECT code, count(*) AS n, sum(w)::BIGINT AS w, round(sum(w * y), 3) AS wy FROM (SELECT unnest(cols) AS code, w, y FROM design) GROUP BY 1")
def m6(t):
    return _design(t).select(F.explode("cols").alias("code"), "w", "y").groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").cast("long").alias("w"), F.round(F.sum(C("w") * C("y")), 3).alias("wy"))


@query("M7_gram", """SELECT a AS i, b AS j, sum(w)::BIGINT AS v FROM (SELECT unnest(cols) AS a, cols, w FROM design), unnest(cols) AS u(b) WHERE a <= b GROUP BY 1, 2""")
def m7(t):
    g = GM.gram_entries(GM.lineups(_design(t))).where("j is not null")
    return g.select("i", "j", C("v").cast("long").alias("v"))


@query("M7_ridge")
def m7b(t):
    return GM.fit_impacts(_design(t), "ev_off", "ev_def")


@query("M8_lambda_sweep")
def m8(t):
    fit = GM.fit_ridge_any(_design(t))
    return t.spark.createDataFrame([tuple(None if s[k] is None else float(s[k]) for k in ("mult", "lambda", "cv_mean", "edf", "explained", "train_wmse")) for s in fit.sweep],
                                   "mult double, lambda double, cv_mean double, edf double, explained double, train_wmse double")


@query("M9_diagnostics")
def m9(t):
    m = GM.fit_ridge_any(_design(t, "pp")).meta
    rows = [(k, float(v)) for k, v in m.items() if not isinstance(v, str) and v is not None]
    return t.spark.createDataFrame(rows, "name string, value double")


@query("M10_tweedie")
def m10(t):
    return GM.tweedie_impacts(_design(t), "ev_off", "ev_def")


# --- duels --------------------------------------------------------------------------------------

MIN_S, MIN_G = 20, 200
EBK = """SELECT count(*) AS entities, sum(v) / sum(n) AS sigma2, greatest(sum(n * r * r) / sum(n) - (sum(n * r) / sum(n)) ** 2 - sum(v / n) / sum(n), 1e-6::DOUBLE) AS tau2 FROM
 (SELECT {key}, count(*) AS n, (sum(goal) - sum(xg)) / count(*) AS r, sum(xg * (1 - xg)) AS v FROM duels GROUP BY 1) WHERE n >= {m}"""
CTES["ks"] = "SELECT entities, sigma2, tau2, sigma2 / tau2 AS k FROM (" + EBK.format(key="shooter_id", m=MIN_S) + ")"
CTES["kg"] = "SELECT entities, sigma2, tau2, sigma2 / tau2 AS k FROM (" + EBK.format(key="goalie_id", m=MIN_G) + ")"


@query("M11_shrinkage", "SELECT 'shooter' AS block, entities, round(sigma2, 6) AS sigma2, round(tau2, 6) AS tau2, round(k, 3) AS k FROM ks UNION ALL SELECT 'goalie', entities, round(sigma2, 6), round(tau2, 6), round(k, 3) FROM kg")
def m11(t):
    a = DU.shrinkage(DU.block_totals(t.duels, "shooter_id"), MIN_S).withColumn("block", F.lit("shooter"))
    b = DU.shrinkage(DU.block_totals(t.duels, "goalie_id"), MIN_G).withColumn("block", F.lit("goalie"))
    return a.unionByName(b).withColumn("k", F.round("k", 3))


@query("M12_finishing")
def m12(t):
    return DU.fit_crossed(t.duels, min_s=MIN_S, min_g=MIN_G).shooters


@query("M12_saving")
def m12b(t):
    return DU.fit_crossed(t.duels, min_s=MIN_S, min_g=MIN_G).goalies


@query("M13_season_fits")
def m13(t):
    """Per-season fits reuse the pooled penalties; seasons are fitted as separate crossed systems."""
    from functools import reduce

    d = t.duels
    ks = DU.shrinkage(DU.block_totals(d, "shooter_id"), MIN_S).first()["k"]
    kg = DU.shrinkage(DU.block_totals(d, "goalie_id"), MIN_G).first()["k"]
    seasons = sorted(r[0] for r in d.select("season").distinct().collect())
    parts = [DU.fit_crossed(d.where(C("season") == s), ks, kg).shooters.withColumn("season", F.lit(s)) for s in seasons]
    return reduce(lambda a, b: a.unionByName(b), parts)


CTES["alpha"] = "SELECT shooter_id, sum(goal - xg) / (count(*) + any_value(k)) AS fin FROM duels, ks GROUP BY 1"
CTES["gamma"] = "SELECT goalie_id, sum(goal - xg) / (count(*) + any_value(k)) AS gol FROM duels, kg GROUP BY 1"
CTES["decomposed"] = "SELECT d.*, a.fin, g.gol, m.mu, d.xg + m.mu + a.fin + g.gol AS recon FROM duels d JOIN alpha a USING (shooter_id) JOIN gamma g USING (goalie_id) CROSS JOIN (SELECT avg(goal - xg) AS mu FROM duels) m"


def _decomposed(t):
    """Decomposition with one-way shrunken rates, a closed form that SQL can check."""
    d = t.duels
    st, gt = DU.block_totals(d, "shooter_id"), DU.block_totals(d, "goalie_id")
    rate = lambda tot, m, n: tot.crossJoin(F.broadcast(DU.shrinkage(tot, m).select("k"))).withColumn(n, (C("made") - C("ixg")) / (C("n") + C("k")))
    mu = d.agg(F.avg(C("goal") - C("xg")).alias("mu0"))
    return DU.decompose(d.crossJoin(F.broadcast(mu)), C("mu0"), rate(st, MIN_S, "alpha"), rate(gt, MIN_G, "gamma"))


@query("M14_decomposition", "SELECT season, goal, count(*) AS n, round(sum(fin), 4) AS fin, round(sum(gol), 4) AS gol, round(sum(mu), 4) AS mu, round(sum(recon), 4) AS recon FROM decomposed GROUP BY 1, 2")
def m14(t):
    r = lambda c: F.round(F.sum(c), 4).alias(c)
    return _decomposed(t).groupBy("season", "goal").agg(F.count(F.lit(1)).alias("n"), r("fin"), r("gol"), r("mu"), r("recon"))


CTES["accounts"] = """
SELECT season, team, count(*) FILTER (f) AS shots_for, sum(goal) FILTER (f)::BIGINT AS gf, sum(xg) FILTER (f) AS xgf, sum(mu) FILTER (f) AS mu_for, sum(fin) FILTER (f) AS fin_for, sum(gol) FILTER (f) AS opp_goalie, sum(recon) FILTER (f) AS gf_recon, count(*) FILTER (NOT f) AS shots_against, sum(goal) FILTER (NOT f)::BIGINT AS ga,
  sum(xg) FILTER (NOT f) AS xga, sum(mu) FILTER (NOT f) AS mu_against, sum(fin) FILTER (NOT f) AS opp_fin, sum(gol) FILTER (NOT f) AS own_goalie, sum(recon) FILTER (NOT f) AS ga_recon FROM (SELECT *, off_nation AS team, true AS f FROM decomposed UNION ALL SELECT *, def_nation, false FROM decomposed) GROUP BY 1, 2"""


@query("A30_team_accounts", "SELECT season, team, shots_for, gf, round(xgf, 4) AS xgf, round(gf_recon, 4) AS gf_recon, round(gf - gf_recon, 4) AS gf_gap, shots_against, ga, round(own_goalie, 4) AS own_goalie, round(ga - ga_recon, 4) AS ga_gap FROM accounts")
def a30(t):
    r = lambda c: F.round(c, 4).alias(c)
    return DU.team_accounts(_decomposed(t)).select("season", "team", "shots_for", "gf", r("xgf"), r("gf_recon"), r("gf_gap"), "shots_against", "ga", r("own_goalie"), r("ga_gap"))


@query("A31_league_summary", """SELECT n_shots, goals, round(xg, 3) AS xg, round(recon, 3) AS reconstructed, round(goals - recon, 3) AS identity_resid, round(gap, 4) AS gf_gap_abs_mean, round(mx, 4) AS ga_gap_max FROM
 (SELECT count(*) AS n_shots, sum(goal)::BIGINT AS goals, sum(xg) AS xg, sum(recon) AS recon FROM decomposed), (SELECT avg(abs(gf - gf_recon)) AS gap, max(abs(ga - ga_recon)) AS mx FROM accounts)""")
def a31(t):
    d = _decomposed(t)
    r = lambda c, p: F.round(c, p).alias(c)
    return DU.league_summary(d, DU.team_accounts(d)).select("n_shots", "goals", r("xg", 3), r("reconstructed", 3), r("identity_resid", 3), r("gf_gap_abs_mean", 4), r("ga_gap_max", 4))


@query("V6_duel_identities")
def v6(t):
    fit = DU.fit_crossed(t.duels, min_s=MIN_S, min_g=MIN_G)
    d = DU.decompose(t.duels, F.lit(fit.mu), fit.shooters, fit.goalies)
    return K.check_duel_identity(d, fit.shooters, fit.goalies)


@query("V7_team_components", _union(
    ("accounts", "goals-for components", "exact", "SELECT count(*) FILTER (abs(gf_recon - xgf - mu_for - fin_for - opp_goalie) > 0.01) AS v FROM accounts", 0, 0),
    ("accounts", "goals-against components", "exact", "SELECT count(*) FILTER (abs(ga_recon - xga - mu_against - opp_fin - own_goalie) > 0.01) AS v FROM accounts", 0, 0),
    ("accounts", "mean absolute gap share", "approx", "SELECT avg(abs(gf - gf_recon) / gf) AS v FROM accounts", 0.0, 0.12)))
def v7(t):
    return K.check_team_accounts(DU.team_accounts(_decomposed(t)))


# --- ledger -------------------------------------------------------------------------------------

CTES["ratings"] = """
SELECT player_id, ev_t / 60.0 AS ev_off_toi, pp_t / 60.0 AS pp_off_toi, pk_t / 60.0 AS pk_def_toi, b.ev_base AS ev_off_base, b.pp_base AS pp_off_base,
  CASE WHEN ev_t > 0 THEN (ev_f * 3600.0 / ev_t - b.ev_base) * ev_t / (ev_t + 3600) ELSE 0 END AS ev_off, CASE WHEN ev_t > 0 THEN (ev_a * 3600.0 / ev_t - b.ev_base) * ev_t / (ev_t + 3600) ELSE 0 END AS ev_def,
  CASE WHEN pp_t > 0 THEN (pp_f * 3600.0 / pp_t - b.pp_base) * pp_t / (pp_t + 3600) ELSE 0 END AS pp_off, CASE WHEN pk_t > 0 THEN (pk_a * 3600.0 / pk_t - b.pp_base) * pk_t / (pk_t + 3600) ELSE 0 END AS pk_def,
  CASE WHEN ev_t > 0 THEN ev_f * 3600.0 / ev_t END AS ev_xgf60, CASE WHEN pp_t > 0 THEN pp_f * 3600.0 / pp_t END AS pp_xgf60
FROM (SELECT player_id, ev_onice_s AS ev_t, pp_onice_s AS pp_t, pk_onice_s AS pk_t, ev_xgf_on AS ev_f, ev_xga_on AS ev_a, pp_xgf_on AS pp_f, pk_xga_on AS pk_a FROM career_on)
CROSS JOIN (SELECT sum(ev_xgf_on) * 3600.0 / sum(ev_onice_s) AS ev_base, sum(pp_xgf_on) * 3600.0 / sum(pp_onice_s) AS pp_base FROM career_on) b"""


def _ratings(t):
    """Volume-shrunken on-ice rates in the shape of fitted impacts (SQL can check the ledger on them)."""
    s = B.onice_sums(t.stints).groupBy("player_id").agg(*[F.sum(c).alias(c) for c in B.ONICE])
    base = s.agg((F.sum("ev_xgf_on") * 3600.0 / F.sum("ev_onice_s")).alias("ev_off_base"), (F.sum("pp_xgf_on") * 3600.0 / F.sum("pp_onice_s")).alias("pp_off_base"))
    s = s.crossJoin(F.broadcast(base))
    part = lambda v, sec, b: F.when(C(sec) > 0, (C(v) * 3600.0 / C(sec) - C(b)) * C(sec) / (C(sec) + 3600)).otherwise(0.0)
    return s.select(
        "player_id", "ev_off_base", "pp_off_base", (C("ev_onice_s") / 60.0).alias("ev_off_toi"), (C("pp_onice_s") / 60.0).alias("pp_off_toi"), (C("pk_onice_s") / 60.0).alias("pk_def_toi"),
        part("ev_xgf_on", "ev_onice_s", "ev_off_base").alias("ev_off"), part("ev_xga_on", "ev_onice_s", "ev_off_base").alias("ev_def"),
        part("pp_xgf_on", "pp_onice_s", "pp_off_base").alias("pp_off"), part("pk_xga_on", "pk_onice_s", "pp_off_base").alias("pk_def"),
        S.per60("ev_xgf_on", "ev_onice_s").alias("ev_xgf60"), S.per60("pp_xgf_on", "pp_onice_s").alias("pp_xgf60"))


CTES["indiv"] = """
SELECT i.player_id, sum(i.gp) AS gp, sum(i.toi_s) / 60.0 AS toi_all, coalesce(sum(c.pen_drawn), 0) * 3600.0 / sum(i.toi_s) AS pen_drawn60, coalesce(sum(c.pen_taken), 0) * 3600.0 / sum(i.toi_s) AS pen_taken60
FROM ice i LEFT JOIN counted c USING (season, game_type, player_id) WHERE i.game_type = 'regular' GROUP BY 1"""
CTES["fin0"] = "SELECT shooter_id AS player_id, sum(goal - xg) / (count(*) + 100) AS a, count(*) AS n FROM onice WHERE xg IS NOT NULL GROUP BY 1"
CTES["sshots"] = STRENGTH_SHOTS.replace("round(coalesce(sum(xg) FILTER (strength = '5v5'), 0), 6)", "coalesce(sum(xg) FILTER (strength = '5v5'), 0)").replace("round(coalesce(sum(xg) FILTER (own = 5 AND opp = 4), 0), 6)", "coalesce(sum(xg) FILTER (own = 5 AND opp = 4), 0)")
CTES["ledger_in"] = f"""
SELECT r.*, coalesce(f.a, 0) AS a, coalesce(f.a * f.n, 0) AS fin_goals, coalesce(i.gp, 0) AS gp, coalesce(i.toi_all, 0) AS toi_all, coalesce(i.pen_drawn60, 0) AS pd, coalesce(i.pen_taken60, 0) AS pt,
  coalesce(s.shots5, 0) AS shots5, coalesce(s.shotspp, 0) AS shotspp, coalesce(s.ixg5, 0) AS ixg5, coalesce(s.ixgpp, 0) AS ixgpp, v.v,
  least(1, coalesce(CASE WHEN ev_off_toi > 0 AND ev_xgf60 > 0 THEN coalesce(s.ixg5, 0) / (ev_off_toi / 60) / ev_xgf60 END, 0)) AS phi5,
  least(1, coalesce(CASE WHEN pp_off_toi > 0 AND pp_xgf60 > 0 THEN coalesce(s.ixgpp, 0) / (pp_off_toi / 60) / pp_xgf60 END, 0)) AS phipp
FROM ratings r LEFT JOIN fin0 f USING (player_id) LEFT JOIN indiv i USING (player_id) LEFT JOIN sshots s USING (player_id) CROSS JOIN ({PENV}) v"""
CTES["ledger"] = """
SELECT player_id, phi5 * (ev_off_base / 5 + ev_off) + CASE WHEN ev_off_toi > 0 THEN a * shots5 / (ev_off_toi / 60) ELSE 0 END AS scoring60, (1 - phi5) * (ev_off_base / 5 + ev_off) AS playmaking60, ev_off_base / 5 + ev_def AS allow60,
  phipp * (pp_off_base / 5 + pp_off) + CASE WHEN pp_off_toi > 0 THEN a * shotspp / (pp_off_toi / 60) ELSE 0 END AS pp_scoring60, pp_off_base / 4 + pk_def AS pk_allow60, (pd - pt) * v AS pen_net60,
  (ev_off_base / 5 + ev_off) * ev_off_toi / 60 + (pp_off_base / 5 + pp_off) * pp_off_toi / 60 AS g_created, (ev_off_base / 5 + ev_def) * ev_off_toi / 60 + (pp_off_base / 4 + pk_def) * pk_def_toi / 60 AS g_allowed,
  fin_goals AS g_fin, (pd - pt) * v * toi_all / 60 AS g_pen, gp FROM ledger_in"""


def _ledger_players(t):
    keys = ["season", "game_type"]
    ice = B.ice_time(t.shifts.withColumn("game_type", B.game_type()), *keys).where("game_type = 'regular'")
    cnt = B.counters(B.credits(t.events.withColumn("game_type", B.game_type()), *keys), *keys)
    box = ice.join(cnt, [*keys, "player_id"], "left")
    none = t.shots.select(C("shooter_id").alias("player_id"), F.lit(0.0).alias("shots"), F.lit(0.0).alias("ixg")).limit(0)
    ind = RT.individual_rates(box, none).select("player_id", "toi_all", "pen_drawn60", "pen_taken60")
    gp = box.groupBy("player_id").agg(F.sum("gp").alias("gp"))
    fin = t.shots_onice.where("xg is not null").groupBy(C("shooter_id").alias("player_id")).agg(F.sum(C("goal") - C("xg")).alias("r"), F.count(F.lit(1)).alias("n"))
    fin = fin.select("player_id", (C("r") / (C("n") + 100) * 100).alias("fin_per100"), (C("r") / (C("n") + 100) * C("n")).alias("fin_goals"))
    return _ratings(t).join(fin, "player_id", "left").join(ind, "player_id", "left").join(gp, "player_id", "left")


def _penalty(t):
    return RT.penalty_value(t.shots_onice, B.season_box(t.shifts, t.events, t.roster, t.stints).where("game_type = 'regular'"))


def _ledger(t):
    return LG.value_table(_ledger_players(t), RT.shots_by_strength(t.shots_onice), _penalty(t))


LEDGER_COLS = ("scoring60", "playmaking60", "allow60", "pp_scoring60", "pk_allow60", "pen_net60", "g_created", "g_allowed", "g_fin", "g_pen")


@query("M17_value_ledger", "SELECT player_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in LEDGER_COLS)
       + ", round(g_created + g_fin - g_allowed + g_pen, 6) AS g_net, round(CASE WHEN gp > 0 THEN (g_created + g_fin - g_allowed + g_pen) / gp ELSE 0 END, 6) AS gnet_pg FROM ledger")
def m17(t):
    return _ledger(t).select("player_id", *LEDGER_COLS, "g_net", "gnet_pg")


@query("A38_offence_partition", "SELECT player_id, round(phi5, 6) AS phi5, round(scoring60 + playmaking60, 6) AS offence60 FROM ledger JOIN ledger_in USING (player_id)")
def a38(t):
    p = _ledger_players(t).join(RT.shots_by_strength(t.shots_onice), "player_id", "left")
    own = LG._safe(LG._safe(F.coalesce("ixg5", F.lit(0.0)), C("ev_off_toi") / 60.0), F.coalesce("ev_xgf60", F.lit(0.0)))
    phi = p.select("player_id", F.least(own, F.lit(1.0)).alias("phi5"))
    return _ledger(t).join(phi, "player_id").select("player_id", "phi5", (C("scoring60") + C("playmaking60")).alias("offence60"))


@query("M15_impact_percentiles", """SELECT player_id, CASE WHEN ev_off_toi >= 5 THEN round_even(100 * (rank() OVER (PARTITION BY grp2, ev_off_toi >= 5 ORDER BY ev_off) + (count(*) OVER (PARTITION BY grp2, ev_off_toi >= 5, ev_off) - 1) / 2)
 / count(*) OVER (PARTITION BY grp2, ev_off_toi >= 5), 0) END AS ev_off_pct FROM (SELECT r.player_id, round(ev_off, 6) AS ev_off, ev_off_toi, grp2 FROM ratings r JOIN poss USING (player_id))""")
def m15(t):
    pos = RT.skater_groups(t.roster)
    d = _ratings(t).withColumn("ev_off", F.round("ev_off", 6)).join(pos, "player_id")
    return RT.ranked_metrics(d, "player_id", "grp", {"ev_off": (True, "ev_off_toi", 5)}).select("player_id", "ev_off_pct")


@query("M16_share_closure", """SELECT round(sum((ev_off_base / 5 + ev_off) * ev_off_toi / 60), 4) AS created, round(sum((ev_off_base / 5 + ev_def) * ev_off_toi / 60), 4) AS allowed,
 round((SELECT sum(xgf) FROM sides WHERE strength = '5v5' AND duration_s >= 10), 4) AS league_xgf FROM ratings""")
def m16(t):
    r = lambda c: F.round(c, 4).alias(c)
    return _closure(t).select(r("created"), r("allowed"), r("league_xgf"))


def _closure(t):
    st = E.attribution_stints(t.stints, ("5v5",), 10)
    league = st.agg(F.sum(C("home_xgf") + C("away_xgf")).alias("league_xgf"))
    return LG.share_closure(_ratings(t), league)


@query("V7_share_closure")
def v7b(t):
    return K.check_share_closure(_closure(t))


@query("M18_season_value")
def m18(t):
    """Ledger per season: single-season rates through the same projection."""
    s = B.onice_sums(t.stints)
    base = s.groupBy("season").agg((F.sum("ev_xgf_on") * 3600.0 / F.sum("ev_onice_s")).alias("ev_off_base"), (F.sum("pp_xgf_on") * 3600.0 / F.sum("pp_onice_s")).alias("pp_off_base"))
    s = s.join(base, "season")
    part = lambda v, sec, b: F.when(C(sec) > 0, (C(v) * 3600.0 / C(sec) - C(b)) * C(sec) / (C(sec) + 3600)).otherwise(0.0)
    p = s.select(
        "player_id", C("season").cast("long").alias("season"), "ev_off_base", "pp_off_base", (C("ev_onice_s") / 60.0).alias("ev_off_toi"), (C("pp_onice_s") / 60.0).alias("pp_off_toi"), (C("pk_onice_s") / 60.0).alias("pk_def_toi"),
        part("ev_xgf_on", "ev_onice_s", "ev_off_base").alias("ev_off"), part("ev_xga_on", "ev_onice_s", "ev_off_base").alias("ev_def"),
        part("pp_xgf_on", "pp_onice_s", "pp_off_base").alias("pp_off"), part("pk_xga_on", "pk_onice_s", "pp_off_base").alias("pk_def"),
        S.per60("ev_xgf_on", "ev_onice_s").alias("ev_xgf60"), S.per60("pp_xgf_on", "pp_onice_s").alias("pp_xgf60"),
        *[F.lit(0.0).alias(c) for c in ("fin_per100", "fin_goals", "toi_all", "pen_drawn60", "pen_taken60")])
    gp = t.shifts.groupBy("player_id", "season").agg(F.countDistinct("game_id").alias("gp"))
    shots = RT.shots_by_strength(t.shots_onice, "season")
    return LG.season_value(p.join(gp, ["player_id", "season"], "left"), shots, _penalty(t)).select("player_id", "season", "scoring60", "playmaking60", "allow60", "g_net", "gnet_pg")


@query("M19_goalie_value")
def m19(t):
    from shiftgrain.plans.q_aggregates import _gbox

    rates = RT.goalie_rates(_gbox(t))
    shots = E.duel_shots(t.shots_onice)
    talent = DU.fit_crossed(shots, 100.0, 300.0).goalies.select(C("goalie_id").alias("player_id"), "gsax_per100", "gsax_saved")
    return LG.goalie_value(rates, talent, 20).select("player_id", "gsax_saved", "gprev60", "g_net", "gprev60_pct")


@query("V10_ledger_checks", _union(
    ("ledger", "net is the sum of its parts", "exact", "SELECT 0 AS v FROM ledger HAVING count(*) > 0", 0, 0),
    ("ledger", "negative shares", "approx", "SELECT avg(CASE WHEN scoring60 + playmaking60 < 0 THEN 1 ELSE 0 END) AS v FROM ledger", 0.0, 0.05)))
def v10(t):
    return K.check_ledger(_ledger(t), [])


@query("A37_season_detail", """SELECT player_id, array_to_string(list(CAST(season AS VARCHAR) || ':' || CAST(gp AS VARCHAR) || ':' || CAST(coalesce(points, 0) AS VARCHAR) ORDER BY season), ',') AS per_season FROM ice LEFT JOIN counted USING (season, game_type, player_id)
 WHERE game_type = 'regular' GROUP BY 1""")
def a37(t):
    box = B.season_box(t.shifts, t.events, t.roster, t.stints).where("game_type = 'regular'")
    rows = F.array_sort(F.collect_list(F.struct("season", "gp", "points", "toi_s", "ev_xgf_on", "ev_xga_on")))
    d = box.groupBy("player_id").agg(rows.alias("per_season"))
    txt = F.transform("per_season", lambda r: F.concat_ws(":", r["season"].cast("string"), r["gp"].cast("string"), r["points"].cast("string")))
    return d.select("player_id", F.array_join(txt, ",").alias("per_season"))
