"""Chance model queries (M1-M5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S
from shiftgrain.models.chance import input_signature, saved_fit
from shiftgrain.operators import shots as X
from shiftgrain.operators.grids import prediction_grid
from shiftgrain.plans.catalog import query
from shiftgrain.session import cut_lineage

C = F.col


@query("M1_features", """
SELECT e.game_id, e.event_idx, round(sqrt((89 - x * sgn) ** 2 + y ** 2), 6) AS distance, round(abs(degrees(atan2(y * sgn, 89 - x * sgn)) - degrees(atan2(prev_y * sgn, 89 - prev_x * sgn))), 6) AS angle_change, gap AS time_since_last,
 e.time_g - at_t AS time_since_shot, e.time_g - fo_t AS since_faceoff, coalesce(p.n, 0) AS attempts_15s, CASE WHEN is_home THEN hn - an ELSE an - hn END AS strength_diff, CASE WHEN is_home THEN hs - aws ELSE aws - hs END::BIGINT AS score_diff,
 CASE WHEN prev_home = is_home THEN 1 ELSE 0 END AS same_team_last, coalesce(shot_type, 'unknown') AS shot_type, coalesce(zone, 'O') AS zone, coalesce(prev_type, 'none') AS last_event_type
FROM ev_prev e JOIN xg USING (game_id, event_idx) JOIN (SELECT game_id, event_idx, last_value(CASE WHEN type = 'faceoff' THEN time_g END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS fo_t,
 last_value(CASE WHEN type IN ('shot-on-goal', 'missed-shot', 'blocked-shot', 'goal') THEN time_g END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at_t,
 coalesce(sum(CASE WHEN type = 'goal' AND is_home THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hs, coalesce(sum(CASE WHEN type = 'goal' AND NOT is_home THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS aws
 FROM ev WINDOW w AS (PARTITION BY game_id ORDER BY time_g, event_idx)) c USING (game_id, event_idx)
LEFT JOIN (SELECT a.game_id, a.event_idx, count(*) AS n FROM ev a JOIN ev b ON b.game_id = a.game_id AND b.is_home = a.is_home AND b.type IN ('shot-on-goal', 'missed-shot', 'blocked-shot', 'goal') AND b.time_g >= a.time_g - 15
 AND (b.time_g < a.time_g OR (b.time_g = a.time_g AND b.event_idx < a.event_idx)) WHERE a.type IN ('shot-on-goal', 'missed-shot', 'goal') GROUP BY 1, 2) p USING (game_id, event_idx)""")
def m1(t):
    f = X.chance_features(t.events, t.bios)
    return f.select("game_id", "event_idx", "distance", "angle_change", "time_since_last", "time_since_shot", "since_faceoff", "attempts_15s", "strength_diff", "score_diff", "same_team_last", "shot_type", "zone", "last_event_type")


def _fit(t):
    """The saved model and its out-of-fold scores; the first query that asks for an input fits and saves them."""
    return saved_fit(X.chance_features(t.events, t.bios), input_signature(t.spark, [f"{t.folder}/events.parquet"]))


_SHOTS = "SELECT game_id, event_idx, e.season, (type = 'goal')::INT AS goal FROM ev e JOIN xg USING (game_id, event_idx)"


@query("M2_chance_oof")
def m2(t):
    return _fit(t)[1].select("game_id", "event_idx", "raw")


@query("M2_oof_coverage", f"SELECT game_id, event_idx, goal, true AS valid FROM ({_SHOTS})")
def m2b(t):
    """Every modelled shot has exactly one out-of-fold value, a probability."""
    return _fit(t)[1].select("game_id", "event_idx", "goal", ((C("raw") > 0) & (C("raw") < 1) & C("xg").between(0, 1)).alias("valid"))


@query("M3_calibrated")
def m3(t):
    return _fit(t)[1].groupBy("season").agg(F.sum("xg").alias("xg"), F.sum("goal").alias("goals"), F.count(F.lit(1)).alias("n"))


@query("M3_closure", f"SELECT count(*) AS n, sum(goal) AS goals, sum(goal)::DOUBLE AS xg FROM ({_SHOTS})")
def m3b(t):
    """Calibrated out-of-fold values add up to the goals: the curve is a weighted mean in every flat piece."""
    s = _fit(t)[1].agg(F.count(F.lit(1)).alias("n"), F.sum("goal").alias("goals"), F.sum("xg").alias("xg"))
    return s.withColumn("xg", F.round("xg", 4))


@query("M4_frozen_scores")
def m4(t):
    model, _ = _fit(t)
    return model.transform(X.chance_features(t.events, t.bios)).select("game_id", "event_idx", "xg")


@query("M4_frozen_unseen", f"SELECT game_id, event_idx, true AS same, true AS tolerated FROM ({_SHOTS})")
def m4b(t):
    """Frozen scores do not depend on the other rows or their order, and a category nobody has seen gets a value."""
    model, _ = _fit(t)
    feats = cut_lineage(X.chance_features(t.events, t.bios))  # scored three times
    whole = model.transform(feats).select("game_id", "event_idx", C("xg").alias("a"))
    parts = model.transform(feats.repartition(7, "event_idx")).select("game_id", "event_idx", C("xg").alias("b"))
    new = model.transform(feats.withColumn("shot_type", F.lit("never seen"))).select("game_id", "event_idx", C("xg").alias("c"))
    both = whole.join(parts, ["game_id", "event_idx"]).join(new, ["game_id", "event_idx"])
    return both.select("game_id", "event_idx", (C("a") == C("b")).alias("same"), C("c").between(0, 1).alias("tolerated"))


@query("M5_importances")
def m5(t):
    model, _ = _fit(t)
    return t.spark.createDataFrame(model.importances(), "feature string, gain double").orderBy(F.desc("gain"), "feature").limit(15)


# The toggles of the surface and the context that they stand for.
SURFACE_TYPES = ("wrist", "snap", "slap", "tip-in", "backhand", "deflected")
SURFACE_STRENGTHS = (("PP", 5, 4), ("EV", 5, 5), ("PK", 4, 5))
SURFACE_BASE = {"since_faceoff": 25.0, "score_diff": 0.0, "period": 1.0, "time_g": 600.0, "is_home": 1.0, "same_team_last": 1.0, "last_behind_net": 0.0}


@query("M5_surface")
def m5b(t):
    """Predicted chance over the offensive zone for every shot type, rebound, rush and strength."""
    model, _ = _fit(t)
    pick = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    own = F.explode(F.array(*[F.struct(F.lit(n).alias("strength"), F.lit(a).alias("own"), F.lit(d).alias("opp")) for n, a, d in SURFACE_STRENGTHS]))
    toggles = t.spark.range(1).select(pick(SURFACE_TYPES).alias("shot_type")).select("*", pick((0, 1)).alias("rebound")).select("*", pick((0, 1)).alias("rush")).select("*", own.alias("s"))
    g = prediction_grid(toggles.select("shot_type", "rebound", "rush", "s.*"))
    by = lambda yes, no: F.when(C("rebound") == 1, F.lit(yes)).otherwise(no if isinstance(no, Column) else F.lit(no))
    g = g.withColumns({"distance": S.distance_to_net("x", "y"), "abs_angle": S.abs_angle("x", F.abs("y")), "x_adj": C("x").cast("double"), "abs_y": F.abs("y").cast("double")})
    g = g.withColumns({k: F.lit(v) for k, v in SURFACE_BASE.items()} | {"off_wing": F.lit(None).cast("double"), "zone": F.lit("O"), "last_event_type": by("shot-on-goal", "faceoff")})
    rushed = lambda yes, no: F.when(C("rush") == 1, F.lit(yes)).otherwise(F.lit(no))
    g = g.withColumns({
        "shooter_skaters": C("own"), "def_skaters": C("opp"), "strength_diff": C("own") - C("opp"),
        "time_since_last": by(2.5, rushed(1.5, 18.0)), "time_since_shot": by(2.5, 30.0), "attempts_15s": by(1.0, 0.0),
        "dist_from_last": by(18.0, rushed(60.0, 35.0)), "angle_change": by(35.0, 0.0), "last_dist_to_net": by(12.0, 40.0), "royal_road": by(1, 0),
    })
    g = g.withColumn("speed_from_last", C("dist_from_last") / C("time_since_last"))
    return model.transform(g).select("x", "y", "shot_type", "rebound", "rush", "strength", F.round("xg", 4).alias("xg"))
