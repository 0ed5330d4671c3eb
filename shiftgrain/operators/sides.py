"""One row per attacking side of a stint, oriented to the attackers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S


def attacking_context(home) -> list[Column]:
    """The five context flags of a stint side: home, ozone, dzone, trail, lead."""
    h = F.col(home) if isinstance(home, str) else home
    zone = F.when(h, F.col("start_zone")).otherwise(S.flip_zone("start_zone"))
    off = F.col("start_type") == "faceoff"
    lead = F.when(h, F.col("home_lead")).otherwise(-F.col("home_lead"))
    return [
        h.cast("int").alias("c_home"),
        S.flag(off & (zone == "O")).alias("ozone"),
        S.flag(off & (zone == "D")).alias("dzone"),
        S.flag(lead < 0).alias("trail"),
        S.flag(lead > 0).alias("lead"),
    ]


def attacking_sides(stints: DataFrame, dual: bool) -> DataFrame:
    """Both sides of every stint (`dual`), or only the side with more skaters."""
    keys = ["game_id", "stint_idx", "season", "start_g", "duration_s"]
    rows = stints.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("home"))
    if not dual:
        more_home = F.col("home_n") > F.col("away_n")
        rows = rows.where((F.col("home_n") != F.col("away_n")) & (F.col("home") == more_home))
    pick = lambda a, b: F.when(F.col("home"), F.col(a)).otherwise(F.col(b))
    return rows.select(
        *keys, "home", "strength",
        pick("home_skaters", "away_skaters").alias("attackers"),
        pick("away_skaters", "home_skaters").alias("defenders"),
        pick("away_goalie", "home_goalie").alias("goalie_id"),
        pick("home_xgf", "away_xgf").alias("xgf"),
        pick("home_corsi", "away_corsi").alias("corsi"),
        pick("home_fen", "away_fen").alias("fen"),
        *attacking_context("home"),
    )
