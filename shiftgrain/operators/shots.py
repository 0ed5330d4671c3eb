"""Shot tables and pre-shot features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S
from shiftgrain.operators.segments import ordered_scan, recent_count

ORDER = ("event_idx",)


def with_previous(events: DataFrame) -> DataFrame:
    """Each event with the one before it in its game."""
    prev = {f"prev_{c}": c for c in ("type", "zone", "x", "y", "time_g", "is_home")}
    return ordered_scan(events, ["game_id"], "time_g", ORDER, previous=prev)


def is_unblocked_shot():
    """Regular season, before the shootout, with a place and a shooter."""
    return (
        F.col("type").isin(*S.FENWICK) & S.is_regular("game_id") & (F.col("period") < 5)
        & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("primary_player_id").isNotNull()
    )


def with_chance(events: DataFrame) -> DataFrame:
    """Add `xg` to the modelled shots of an event table: a fixed distance curve in place of a fit.

    It reads only the event's own columns, so it costs no join.
    """
    sign = S.attack_sign("is_home", "home_defending_side")
    dist = F.bround(S.distance_to_net(F.col("x") * sign, F.col("y") * sign), 1)
    away_g, away_n, home_n, home_g = (S.situation_digit("situation_code", i) for i in range(4))
    ok = is_unblocked_shot() & away_g.isNotNull() & home_g.isNotNull() & (away_n >= 3) & (home_n >= 3)
    ok = ok & (F.when(F.col("is_home"), away_g).otherwise(home_g) == 1)
    return events.withColumn("xg", F.when(ok, 0.04 + 5.0 / (20.0 + dist)))


def unblocked_shots(events: DataFrame, *carry: str) -> DataFrame:
    """Regular-season unblocked shots before the shootout, with geometry and context flags."""
    ev = with_previous(events).withColumn("gap", F.col("time_g") - F.col("prev_time_g"))
    s = ev.where(is_unblocked_shot())
    sign = S.attack_sign("is_home", "home_defending_side")
    x, y = F.col("x") * sign, F.col("y") * sign
    return s.select(
        "game_id", "event_idx", "season", "time_g", "period", "is_home", "home_team", "away_team",
        F.col("primary_player_id").alias("shooter_id"),
        (F.col("type") == "goal").cast("int").alias("goal"),
        F.col("type").alias("event"), "x", "y", "shot_type",
        F.bround(S.distance_to_net(x, y), 1).alias("distance"),
        F.bround(S.abs_angle(x, y), 1).alias("angle"),
        S.rebound("prev_type", "gap").alias("rebound"),
        S.rush("prev_zone", "gap").alias("rush"),
        *S.situation("situation_code"),
        *carry,
    ).withColumn("home_n", F.col("home_skaters_n")).withColumn("away_n", F.col("away_skaters_n")).withColumn(
        "empty_net",
        S.flag(F.when(F.col("is_home"), F.col("away_goalie_in")).otherwise(F.col("home_goalie_in")) == 0),
    )


def modelled(shots: DataFrame) -> DataFrame:
    """Goalie in net, all four code digits known, at least three skaters a side."""
    def_goalie = F.when(F.col("is_home"), F.col("away_goalie_in")).otherwise(F.col("home_goalie_in"))
    known = F.col("away_goalie_in").isNotNull() & F.col("home_goalie_in").isNotNull()
    return shots.where(
        known & (def_goalie == 1) & (F.col("home_skaters_n") >= 3) & (F.col("away_skaters_n") >= 3)
    )


def chance_features(events: DataFrame, hands: DataFrame) -> DataFrame:
    """One feature row per modelled shot: geometry, what came before it, manpower and score."""
    t, typ = F.col("time_g"), F.col("type")
    attempt = typ.isin(*S.CORSI)
    prev = {f"prev_{c}": c for c in ("type", "zone", "x", "y", "time_g", "is_home")}
    ev = ordered_scan(
        events, ["game_id"], "time_g", ORDER,
        previous=prev,
        last_seen={"faceoff_t": F.when(typ == "faceoff", t)},
        seen_before={"attempt_t": F.when(attempt, t)},
        running_before={
            "home_score": (typ.eqNullSafe("goal") & F.col("is_home")).cast("long"),
            "away_score": (typ.eqNullSafe("goal") & ~F.col("is_home")).cast("long"),
        },
    )
    pressure = recent_count(
        events.where(attempt).select("game_id", "is_home", "time_g", "event_idx"),
        ["game_id", "is_home"], "time_g", ORDER, "attempts_15s", 15,
    ).select("game_id", "event_idx", "attempts_15s")
    df = ev.where(is_unblocked_shot()).select("*", *S.situation("situation_code"))
    df = modelled(df).join(pressure, ["game_id", "event_idx"], "left")
    df = df.join(hands.select(F.col("player_id").alias("primary_player_id"), "hand"), "primary_player_id", "left")
    home = F.col("is_home")
    sign = S.attack_sign("is_home", "home_defending_side")
    df = (
        df.withColumn("x_adj", F.col("x") * sign).withColumn("y_adj", F.col("y") * sign)
        .withColumn("px", F.col("prev_x") * sign).withColumn("py", F.col("prev_y") * sign)
        .withColumn("gap", t - F.col("prev_time_g"))
    )
    dist_last = F.sqrt((F.col("x_adj") - F.col("px")) ** 2 + (F.col("y_adj") - F.col("py")) ** 2)
    own = F.when(home, F.col("home_skaters_n")).otherwise(F.col("away_skaters_n"))
    opp = F.when(home, F.col("away_skaters_n")).otherwise(F.col("home_skaters_n"))
    lead = F.col("home_score") - F.col("away_score")
    return df.select(
        "game_id", "event_idx", "season",
        F.col("primary_player_id").alias("shooter_id"),
        (typ == "goal").cast("int").alias("goal"),
        S.distance_to_net("x_adj", "y_adj").alias("distance"),
        S.abs_angle("x_adj", "y_adj").alias("abs_angle"),
        "x_adj", F.abs("y_adj").alias("abs_y"),
        F.col("gap").alias("time_since_last"),
        (t - F.col("attempt_t")).alias("time_since_shot"),
        dist_last.alias("dist_from_last"),
        S.speed(dist_last, "gap").alias("speed_from_last"),
        F.abs(S.signed_angle("x_adj", "y_adj") - S.signed_angle("px", "py")).alias("angle_change"),
        S.distance_to_net("px", "py").alias("last_dist_to_net"),
        (t - F.col("faceoff_t")).alias("since_faceoff"),
        F.coalesce("attempts_15s", F.lit(0)).alias("attempts_15s"),
        (own - opp).alias("strength_diff"), own.alias("shooter_skaters"), opp.alias("def_skaters"),
        F.when(home, lead).otherwise(-lead).alias("score_diff"),
        "period", "time_g", home.cast("int").alias("is_home"),
        S.rebound("prev_type", "gap").alias("rebound"),
        S.rush("prev_zone", "gap").alias("rush"),
        S.flag(F.col("prev_is_home") == home).alias("same_team_last"),
        S.cross_slot("py", "y_adj", "gap").alias("royal_road"),
        S.flag(F.col("px") > S.GOAL_X).alias("last_behind_net"),
        S.off_wing("hand", "y_adj").alias("off_wing"),
        F.coalesce("shot_type", F.lit("unknown")).alias("shot_type"),
        F.coalesce("zone", F.lit("O")).alias("zone"),
        F.coalesce("prev_type", F.lit("none")).alias("last_event_type"),
    )
