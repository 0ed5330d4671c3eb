"""Values, replacement, swap accounting and hold-out scoring (M27-M42) on closed-form skills.

The skills are volume-shrunken counts, so that every equation below can be checked in SQL; the same
functions take the states fitted by the count, quality and conversion models.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S
from shiftgrain.models import cards as CD
from shiftgrain.models import holdout as HO
from shiftgrain.models import rows as MR
from shiftgrain.models.scoring import quantiles
from shiftgrain.operators import box as B
from shiftgrain.operators import ranking as R
from shiftgrain.plans.catalog import query
from shiftgrain.plans.oracle import CTES

C = F.col
K = {"mu": 1.2, "mq": -2.6, "psi0": -1.3, "env": 1.1, "qc_F": -0.2, "qc_D": -0.3}
GATE, KAP = 200.0, 0.95
CTX = {"c_home": 0.05, "ozone": 0.2, "dzone": -0.15, "trail": 0.06, "lead": -0.04}

CTES["skills"] = """
SELECT r.player_id, r.is_d, 0.3 * (coalesce(n, 0) - 10) / (coalesce(n, 0) + 30) AS sh, 0.1 * (coalesce(a, 0) - 2) / (coalesce(a, 0) + 10) AS cr, -0.1 * coalesce(bl, 0) / (coalesce(bl, 0) + 20) AS df,
  0.1 * (coalesce(g, 0) - 1) / (coalesce(g, 0) + 5) AS qs, coalesce(toi, 0)::DOUBLE AS toi FROM (SELECT player_id, max(CASE WHEN position = 'D' THEN 1.0 ELSE 0.0 END)::DOUBLE AS is_d FROM roster GROUP BY 1) r
LEFT JOIN (SELECT player_id, count(*) FILTER (stat = 'icf') AS n, count(*) FILTER (stat IN ('a1', 'a2')) AS a, count(*) FILTER (stat = 'blocks') AS bl, count(*) FILTER (stat = 'g') AS g FROM credit_rows GROUP BY 1) USING (player_id)
LEFT JOIN (SELECT player_id, sum(duration_s) AS toi FROM side_stints WHERE strength = '5v5' GROUP BY 1) USING (player_id)"""
CTES["valued"] = """
SELECT *, 1.1 * exp(1.2 + sh) * (w0 * g0 + wf * gf + (1 - w0 - wf) * gd) AS scoring, 1.1 * 4 * exp(1.2) * (exp(cr) - 1) / (1 + exp(-(-2.6 + CASE WHEN is_d > 0 THEN -0.3 ELSE -0.2 END))) AS playmaking,
  1.1 * 5 * (exp(1.2) / (1 + exp(2.6)) - exp(1.2 + df) / (1 + exp(2.6 - df / 2))) AS defence FROM (SELECT *, 1 / (1 + exp(2.6 - qs)) AS g0, 1 / (1 + exp(2.8 - qs)) AS gf, 1 / (1 + exp(2.9 - qs)) AS gd, exp(df / 2) AS kq,
  exp(-1.3) / (exp(-1.3) + 4) AS w0, (1 - exp(-1.3) / (exp(-1.3) + 4)) * (CASE WHEN is_d > 0 THEN 3 ELSE 2 END) / 4 AS wf FROM skills)"""
CTES["above"] = f"""
SELECT v.*, scoring - b.s + {KAP} * (playmaking - b.p) + {KAP} * (defence - b.d) AS ga60 FROM valued v JOIN (SELECT is_d, sum(scoring * toi) / sum(toi) AS s, sum(playmaking * toi) / sum(toi) AS p, sum(defence * toi) / sum(toi) AS d
 FROM valued WHERE toi >= {GATE} GROUP BY 1) b USING (is_d)"""
CTES["ranked"] = f"""
SELECT *, CASE WHEN toi >= {GATE} AND count(*) OVER (PARTITION BY is_d, toi >= {GATE}) > 1 THEN round_even((row_number() OVER (PARTITION BY is_d, toi >= {GATE} ORDER BY ga60, player_id) - 1) / (count(*) OVER (PARTITION BY is_d, toi >= {GATE}) - 1) * 100, 0) END AS pct FROM above"""
_R = ("sh", "cr", "df", "g0", "gf", "gd", "kq")
CTES["repl"] = "SELECT is_d, " + ", ".join(
    f"CASE WHEN count(*) FILTER (toi >= {GATE} AND pct BETWEEN 8 AND 12) > 0 THEN sum({c} * toi) FILTER (toi >= {GATE} AND pct BETWEEN 8 AND 12) / sum(toi) FILTER (toi >= {GATE} AND pct BETWEEN 8 AND 12) ELSE sum({c} * toi) FILTER (toi >= {GATE}) / sum(toi) FILTER (toi >= {GATE}) END AS r_{c}"
    for c in _R) + " FROM ranked GROUP BY 1"


def skills(t):
    cnt = B.counters(B.credits(t.events)).select("player_id", C("icf").alias("n"), (C("a1") + C("a2")).alias("a"), C("blocks").alias("bl"), "g")
    toi = B.onice_sums(t.stints).groupBy("player_id").agg(F.sum("ev_onice_s").cast("double").alias("toi"))
    pos = t.roster.groupBy("player_id").agg(F.max((C("position") == "D").cast("double")).alias("is_d"))
    p = pos.join(cnt, "player_id", "left").join(toi, "player_id", "left").fillna(0)
    p = p.select("player_id", "is_d", "toi", (0.3 * (C("n") - 10) / (C("n") + 30)).alias("sh"), (0.1 * (C("a") - 2) / (C("a") + 10)).alias("cr"), (-0.1 * C("bl") / (C("bl") + 20)).alias("df"), (0.1 * (C("g") - 1) / (C("g") + 5)).alias("qs"))
    g = lambda m: S.sigmoid(C("qs") - m)
    return p.select("*", g(2.6).alias("g0"), g(2.8).alias("gF"), g(2.9).alias("gD"), F.exp(C("df") / 2).alias("kq"), (C("df") / 2).alias("qd"), F.lit(0.0).alias("cq"))


def valued(t):
    return CD.player_values(skills(t), K)


@query("M29_beta_marginal", "SELECT player_id, round(sum(w * pow(1 - x, 12 * (1 - q) - 1) / (1 + exp(-(0.9 * ln(x / (1 - x)) - 0.1)))) / sum(w * pow(1 - x, 12 * (1 - q) - 1)), 6) AS p FROM (SELECT player_id, q, w, least(greatest(pow(u, 1 / (12 * q)), 1e-6), 1 - 1e-6) AS x FROM (SELECT player_id, 1 / (1 + exp(2.6 - qs)) AS q FROM skills), (SELECT unnest(["
       + ", ".join(repr(float(0.5 * (u + 1))) + "::DOUBLE" for u in np.polynomial.legendre.leggauss(40)[0]) + "]) AS u, unnest([" + ", ".join(repr(float(0.5 * w)) + "::DOUBLE" for w in np.polynomial.legendre.leggauss(40)[1]) + "]) AS w)) GROUP BY 1")
def m29(t):
    return skills(t).select("player_id", CD.beta_marginal(C("g0"), 12.0, 0.9, -0.1).alias("p"))


@query("M30_player_values", "SELECT player_id, round(scoring, 6) AS scoring, round(playmaking, 6) AS playmaking, round(defence, 6) AS defence FROM valued")
def m30(t):
    return valued(t).select("player_id", "scoring", "playmaking", "defence")


@query("M32_goals_above", "SELECT player_id, round(ga60, 6) AS ga60, pct AS ga60_pct FROM ranked")
def m32(t):
    return CD.goals_above(valued(t), GATE, KAP).select("player_id", "ga60", "ga60_pct")


def _repl(t):
    return CD.archetypes(CD.goals_above(valued(t), GATE, KAP), ["sh", "cr", "df", "g0", "gF", "gD", "kq"], GATE)


@query("M31_archetypes", "SELECT is_d, " + ", ".join(f"round(r_{c}, 6) AS r_{c}" for c in ("sh", "cr", "df", "g0", "kq")) + " FROM repl")
def m31(t):
    return _repl(t).select("is_d", "r_sh", "r_cr", "r_df", "r_g0", "r_kq")


@query("M33_side_rows", """SELECT game_id, stint_idx, home, array_to_string(atk, ',') AS attackers, len(dfd) AS n_def, duration_s, c_home, ozone, dzone, trail, lead1 AS lead FROM sides
 WHERE len(atk) = 5 AND len(dfd) < 5 AND duration_s >= 1 AND strength IN ('5v4', '4v5', '5v3', '3v5')""")
def m33(t):
    r = MR.side_rows(t.stints, False)
    return r.select("game_id", "stint_idx", "home", F.array_join("attackers", ",").alias("attackers"), F.size("defenders").alias("n_def"), "duration_s", *MR.CONTEXT)


CTES["slots"] = """
SELECT s.game_id, s.stint_idx, s.home, s.season, s.duration_s, exp(1.2 + 0.05 * c_home + 0.2 * ozone - 0.15 * dzone + 0.06 * trail - 0.04 * lead1) AS cx, s.is_atk, k.*, r.r_sh, r.r_cr, r.r_df, r.r_g0, r.r_gf, r.r_gd, r.r_kq FROM
 (SELECT *, unnest(atk) AS pid, true AS is_atk FROM sides WHERE strength = '5v5' AND duration_s >= 1 UNION ALL SELECT *, unnest(dfd), false FROM sides WHERE strength = '5v5' AND duration_s >= 1) s
 JOIN valued k ON k.player_id = s.pid JOIN repl r ON r.is_d = k.is_d"""
CTES["slot2"] = """
SELECT *, sum(exp(cr)) FILTER (is_atk) OVER w - exp(cr) AS sk, sum(CASE WHEN is_d < 0.5 THEN exp(cr) ELSE 0 END) FILTER (is_atk) OVER w - CASE WHEN is_d < 0.5 THEN exp(cr) ELSE 0 END AS sf, sum(cr) FILTER (is_atk) OVER w AS cra,
 sum(df + ln(kq)) FILTER (NOT is_atk) OVER w AS guard FROM slots WINDOW w AS (PARTITION BY game_id, stint_idx, home)"""
CTES["slot3"] = """
SELECT *, exp(sh - cr) * (exp(-1.3) * g0 + sf * gf + (sk - sf) * gd) / (exp(-1.3) + sk) AS tk, exp(r_sh - r_cr) * (exp(-1.3) * r_g0 + sf * r_gf + (sk - sf) * r_gd) / (exp(-1.3) + sk) AS tr, cx * exp(cra + guard) * duration_s / 3600.0 AS env FROM slot2"""
CTES["slot4"] = "SELECT *, sum(tk) FILTER (is_atk) OVER (PARTITION BY game_id, stint_idx, home) AS tt FROM slot3"
CTES["gar"] = "SELECT *, env * tt AS e, CASE WHEN is_atk THEN env * tt - env * exp(r_cr - cr) * (tt - tk + tr) ELSE env * tt * (exp(r_df - df) * r_kq / kq - 1) END AS g FROM slot4"


def swap_slots(t):
    sk = skills(t).join(F.broadcast(_repl(t)), "is_d")
    zero = F.lit(0.0)
    sk = sk.withColumns({**{c: zero for c in ("slope0", "slopeF", "slopeD", "r_slope0", "r_slopeF", "r_slopeD", "r_cq")}, "psi0": F.lit(K["psi0"])})
    sides = MR.side_rows(t.stints, True).withColumn("gsave", zero)
    base = F.exp(K["mu"] + sum((v * C(c) for c, v in CTX.items()), F.lit(0.0)))
    h = t.headers.select("game_id", "home_team", "away_team")
    sides = sides.join(h, "game_id").withColumn("atk_team", F.when(C("home"), C("home_team")).otherwise(C("away_team"))).withColumn("def_team", F.when(C("home"), C("away_team")).otherwise(C("home_team")))
    return CD.swap_rows(sides, sk, base)


@query("M34_swap_accounting", "SELECT player_id, season, round(coalesce(sum(g) FILTER (is_atk), 0), 6) AS gar_atk, round(coalesce(sum(g) FILTER (NOT is_atk), 0), 6) AS gar_def, round(sum(g) / 6.0, 6) AS war FROM gar GROUP BY 1, 2")
def m34(t):
    return CD.swap_totals(swap_slots(t), "season")


@query("M35_team_audit", """SELECT team, round(sum(v), 4) AS net FROM (SELECT CASE WHEN home THEN home_team ELSE away_team END AS team, e AS v FROM (SELECT DISTINCT game_id, stint_idx, home, e FROM gar) JOIN headers USING (game_id)
 UNION ALL SELECT CASE WHEN home THEN away_team ELSE home_team END, -e FROM (SELECT DISTINCT game_id, stint_idx, home, e FROM gar) JOIN headers USING (game_id)) GROUP BY 1""")
def m35(t):
    return CD.team_net(swap_slots(t)).select("team", F.round("net", 4).alias("net"))


@query("M35_correlations")
def m35b(t):
    s = swap_slots(t)
    gar = s.groupBy(F.when(C("atk"), C("atk_team")).otherwise(C("def_team")).alias("team")).agg(F.sum("gar").alias("gar"))
    sc = B.game_scores(t.headers, t.events)
    d = C("home_score") - C("away_score")
    act = sc.select(F.explode(F.array(F.struct(C("home_team").alias("team"), d.alias("d")), F.struct(C("away_team").alias("team"), (-d).alias("d")))).alias("x")).select("x.*").groupBy("team").agg(F.sum("d").alias("diff"))
    return CD.audit(CD.team_net(s).join(gar, "team"), act)


CTES["season_states"] = """
SELECT c.player_id, c.season, 0.3 * (n - 3) / (n + 10) AS shoot, CASE WHEN r.position = 'D' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_d, datediff('day', birthdate, make_date(c.season + 1, 1, 1)) / 365.25 AS age,
 coalesce((datediff('day', birthdate, make_date(c.season + 1, 1, 1)) / 365.25 - 27) / 10, 0) AS z, n, s.secs FROM (SELECT player_id, season, count(*) FILTER (stat = 'icf') AS n FROM credit_rows GROUP BY 1, 2) c
 JOIN roster r USING (player_id, season) JOIN bios USING (player_id) JOIN (SELECT player_id, season, sum(duration_s) AS secs FROM shifts GROUP BY 1, 2) s USING (player_id, season)"""
CURVE = {"zF": -0.1, "z2F": -0.2, "zD": -0.05, "z2D": -0.15, "D": -0.3}


def season_states(t):
    cnt = B.counters(B.credits(t.events, "season"), "season").select("player_id", "season", C("icf").alias("n"))
    ice = t.shifts.groupBy("player_id", "season").agg(F.sum("duration_s").alias("secs"))
    j = cnt.join(t.roster.select("player_id", "season", "position"), ["player_id", "season"]).join(t.bios, "player_id").join(ice, ["player_id", "season"])
    age = S.midseason_age("season", "birthdate")
    return j.select("player_id", "season", "n", "secs", (0.3 * (C("n") - 3) / (C("n") + 10)).alias("shoot"), (C("position") == "D").cast("double").alias("is_d"), age.alias("age"), S.age_z(age).alias("z"))


@query("M27_effective", """SELECT player_id, season AS last_season, round(shoot + (1 - is_d) * (-0.1 * z2 - 0.2 * z2 * z2) + is_d * (-0.05 * z2 - 0.15 * z2 * z2 - 0.3), 6) AS shoot FROM (SELECT *, CASE WHEN age IS NOT NULL THEN z + ((SELECT max(season) + 1 FROM season_states) - season) / 10 ELSE z END AS z2,
 row_number() OVER (PARTITION BY player_id ORDER BY season DESC) AS rn FROM season_states) WHERE rn = 1""")
def m27(t):
    st = season_states(t)
    return CD.effective(st, {"shoot": CURVE}, target=last_season(st) + 1).select("player_id", "last_season", "shoot")


@query("M28_environment", """SELECT round(sum(dur * exp(e + 0.05 * c_home + 0.2 * ozone - 0.15 * dzone + 0.06 * trail - 0.04 * lead1)) / sum(dur), 6) AS env FROM (SELECT game_id, stint_idx, home, shooter_id, any_value(duration_s) AS dur, any_value(c_home) AS c_home, any_value(ozone) AS ozone,
 any_value(dzone) AS dzone, any_value(trail) AS trail, any_value(lead1) AS lead1, sum(CASE WHEN mate THEN cr ELSE df END) AS e FROM (SELECT *, unnest(mates) AS pid, true AS mate FROM count_rows UNION ALL SELECT *, unnest(dfd), false FROM count_rows) x JOIN skills k ON k.player_id = x.pid GROUP BY 1, 2, 3, 4)""")
def m28(t):
    return CD.environment(MR.count_rows(t.stints, t.shots_onice, True), skills(t), CTX)


@query("M36_trajectory", "SELECT player_id, count(*) AS seasons, round(sum(v), 6) AS total FROM (SELECT player_id, shoot + (1 - is_d) * (-0.1 * z - 0.2 * z * z) + is_d * (-0.05 * z - 0.15 * z * z - 0.3) AS v FROM season_states) GROUP BY 1")
def m36(t):
    st = season_states(t)
    ref = CD.block_curve(C("z"), C("is_d"), CURVE)
    tr = CD.trajectory(st.withColumn("value", C("shoot") + ref), ref)
    return tr.select("player_id", F.size("seasons").alias("seasons"), F.aggregate("seasons", F.lit(0.0), lambda a, x: a + x["value"]).alias("total"))


CTES["train_c"] = "SELECT player_id, 0.0::DOUBLE AS league, sum(shoot * secs) / sum(secs) AS pooled, arg_max(shoot, season) AS last FROM season_states WHERE season < (SELECT max(season) FROM season_states) GROUP BY 1"
CTES["hold"] = "SELECT t.player_id, t.n, t.secs / 3600.0 AS hours, coalesce(league, 0) AS league, coalesce(pooled, 0) AS pooled, coalesce(last, 0) AS last FROM season_states t LEFT JOIN train_c USING (player_id) WHERE t.season = (SELECT max(season) FROM season_states)"
_SC = """SELECT '{c}' AS candidate, count(*) AS n, round(sum(2 * (CASE WHEN n > 0 THEN n * ln(n / mu) ELSE 0 END - (n - mu))) / count(*) * 1000, 4) AS dev1000, round(sum(hours * abs(mu - n) / hours) / sum(hours), 6) AS mae FROM (SELECT *, exp(2.0 + {c}) * hours AS mu FROM hold)"""


def last_season(df) -> int:
    return df.agg(F.max("season")).first()[0] or 0


def _split(t):
    """(candidates fitted on every season before the last, rows of the last season)."""
    st = season_states(t)
    last = last_season(st)
    return HO.candidates(st.where(C("season") < last), "shoot", "secs"), st.where(C("season") == last)


@query("M37_holdout_scores", " UNION ALL ".join(_SC.format(c=c) for c in ("league", "pooled", "last")))
def m37(t):
    fit, held = _split(t)
    target = held.select("player_id", "n", (C("secs") / 3600.0).alias("hours"))
    s = HO.score_candidates(target, fit, ["league", "pooled", "last"], F.lit(2.0))
    return s.select("candidate", "n", F.round("dev1000", 4).alias("dev1000"), "mae")


@query("M38_calibration_slope")
def m38(t):
    fit, held = _split(t)
    rows = held.join(fit, "player_id").select("n", F.lit(2.0).alias("base"), C("pooled").alias("term"), F.log(C("secs") / 3600.0).alias("offset"))
    return t.spark.createDataFrame([("pooled", float(HO.calibration_slope(rows)))], "block string, slope double")


DRAWS = 2000
_TWIST = f"((h::BIGINT * h + h * {HO.TWIST} + draw) % {HO.PRIME})"
CTES["resampled"] = f"""
SELECT draw, pooled AS a, last AS b, n / secs AS y, secs * len([c FOR c IN {[float(x) for x in HO.POISSON]} IF c <= h / {HO.PRIME}.0]) AS w
FROM (SELECT * EXCLUDE h, {_TWIST} AS h FROM (SELECT * EXCLUDE h, {_TWIST} AS h FROM (
 SELECT player_id, pooled, last, n::DOUBLE AS n, secs, draw, (player_id % {HO.PRIME} * {HO.BY_ID} + draw * {HO.BY_DRAW} + {HO.SHIFT}) % {HO.PRIME} AS h
 FROM (SELECT * FROM season_states JOIN train_c USING (player_id) WHERE season = (SELECT max(season) FROM season_states)), (SELECT unnest(range({DRAWS}))::BIGINT AS draw))))"""
CTES["gains"] = """
SELECT draw, (say - sa * sy / s) / sqrt((saa - sa * sa / s) * (syy - sy * sy / s)) - (sby - sb * sy / s) / sqrt((sbb - sb * sb / s) * (syy - sy * sy / s)) AS gain
FROM (SELECT draw, sum(w) AS s, sum(w * a) AS sa, sum(w * b) AS sb, sum(w * y) AS sy, sum(w * a * a) AS saa, sum(w * b * b) AS sbb, sum(w * y * y) AS syy, sum(w * a * y) AS say, sum(w * b * y) AS sby FROM resampled GROUP BY 1)"""


@query("M39_paired_bootstrap", f"""SELECT *, CASE WHEN low > 0 AND p_better >= 0.95 AND own_corr > {HO.OWN} THEN 'PASS' ELSE 'FAIL' END AS verdict FROM
 (SELECT count(*) AS draws, avg((gain > 0)::INT::DOUBLE) AS p_better, avg(gain) AS mean_gain, quantile_cont(gain, 0.05) AS low, quantile_cont(gain, 0.95) AS high FROM gains),
 (SELECT (say / w - sa * sy / w / w) / sqrt((saa / w - sa * sa / w / w) * (syy / w - sy * sy / w / w)) AS own_corr FROM (SELECT sum(secs)::DOUBLE AS w, sum(secs * pooled) AS sa, sum(secs * (n / secs)) AS sy, sum(secs * pooled * pooled) AS saa,
  sum(secs * (n / secs) * (n / secs)) AS syy, sum(secs * pooled * (n / secs)) AS say FROM season_states JOIN train_c USING (player_id) WHERE season = (SELECT max(season) FROM season_states)))""")
def m39(t):
    fit, held = _split(t)
    p = held.join(fit, "player_id").select("player_id", "pooled", "last", (C("n") / C("secs")).alias("rate"), "secs")
    return HO.paired_bootstrap(p, "pooled", "last", "rate", "secs", draws=DRAWS)


@query("M40_count_check", """SELECT count(*) AS rows, sum(n)::BIGINT AS actual, round(sum(mu), 4) AS expected, round(avg(n * n), 6) AS n2, round(avg(mu + mu * mu), 6) AS poisson2, round(avg(mu + mu * mu * 1.5), 6) AS nb2, round(avg(CASE WHEN n = 0 THEN 1 ELSE 0 END), 6) AS zero,
 round(avg(exp(-mu)), 6) AS poisson_zero, round(avg(pow(2 / (2 + mu), 2)), 6) AS nb_zero FROM (SELECT n, exp(1.2 + sh) * duration_s / 3600.0 AS mu FROM count_rows JOIN skills ON player_id = shooter_id)""")
def m40(t):
    r = MR.count_rows(t.stints, t.shots_onice, True).join(skills(t).select(C("player_id").alias("shooter_id"), "sh"), "shooter_id")
    r = r.select(C("count").alias("n"), (F.exp(1.2 + C("sh")) * C("dur") / 3600.0).alias("mu"))
    return HO.count_check(r, 2.0).withColumn("expected", F.round("expected", 4))


@query("M41_aging_table", "SELECT 'shoot' AS block, age, pos, round(CASE WHEN pos = 'F' THEN -0.1 * z - 0.2 * z * z ELSE -0.05 * z - 0.15 * z * z - 0.3 END, 6) AS value FROM (SELECT age, (age - 27) / 10 AS z FROM (SELECT DISTINCT 18 + 2 * (season - 2021 + 4 * (day % 3)) AS age FROM feed0)), (SELECT unnest(['F', 'D']) AS pos)")
def m41(t):
    ages = t.feed.select((18 + 2 * (C("season") - 2021 + 4 * (C("day") % 3))).cast("int").alias("age")).distinct()
    return CD.aging_table(t.spark, {"shoot": CURVE}).join(ages, "age", "left_semi")


@query("M41_venue_effects", """SELECT raw_venue, round(ln(sum(n) / sum(m)), 6) AS effect, count(*) AS games FROM (SELECT game_id, count(*) AS n FROM shots GROUP BY 1) JOIN headers USING (game_id) CROSS JOIN (SELECT avg(n) AS m FROM (SELECT count(*) AS n FROM shots GROUP BY game_id)) WHERE raw_venue IS NOT NULL GROUP BY 1""")
def m41b(t):
    n = t.shots.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    m = n.agg(F.avg("n").alias("m"))
    j = n.join(t.headers, "game_id").where("raw_venue is not null").crossJoin(F.broadcast(m))
    return j.groupBy("raw_venue").agg(F.log(F.sum("n") / F.sum("m")).alias("effect"), F.count(F.lit(1)).alias("games"))


@query("M42_quantile_grid", "SELECT is_d, q, round(v, 6) AS v FROM (SELECT is_d, unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS q, unnest(quantile_cont(scoring, [0.1, 0.5, 0.9])) AS v FROM valued GROUP BY 1)")
def m42(t):
    v = valued(t)
    parts = [quantiles(v.where(C("is_d") == d), "scoring", [0.1, 0.5, 0.9]).withColumn("is_d", F.lit(d)) for d in (0.0, 1.0)]
    return parts[0].unionByName(parts[1])


@query("M42_templates", """WITH a AS (SELECT player_id FROM valued ORDER BY round(scoring, 9) DESC, player_id LIMIT 1), b AS (SELECT player_id FROM valued WHERE is_d = 1 AND player_id NOT IN (SELECT player_id FROM a) ORDER BY round(defence, 9) DESC, player_id LIMIT 1)
 SELECT 'scorer' AS label, player_id FROM a UNION ALL SELECT 'defender', player_id FROM b""")
def m42b(t):
    return R.greedy_distinct(valued(t), "player_id", [
        ("scorer", F.lit(True), [F.desc(F.round("scoring", 9)), F.asc("player_id")]),
        ("defender", C("is_d") == 1, [F.desc(F.round("defence", 9)), F.asc("player_id")])]).select("label", "player_id")
