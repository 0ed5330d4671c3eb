"""Row universes and eligibility gates shared by tables, rankings and fits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S

# Event kinds shown on a timeline, and the (own, opponent) skater counts that are priced.
TIMELINE_TYPES = (
    "goal", "shot-on-goal", "missed-shot", "blocked-shot", "penalty",
    "faceoff", "hit", "giveaway", "takeaway", "stoppage",
)
PRICED = ((5, 5), (5, 4))


def attribution_stints(stints: DataFrame, strengths: tuple[str, ...], min_seconds: int) -> DataFrame:
    return stints.where(
        S.is_regular("game_id") & F.col("strength").isin(*strengths) & ~F.col("overload")
        & (F.col("duration_s") >= min_seconds)
    )


def duel_shots(onice: DataFrame) -> DataFrame:
    """Shots with a shooter, a facing goalie and a chance value."""
    return onice.where("shooter_id is not null and goalie_id is not null and xg is not null")


def gate(df: DataFrame, rules: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Blank each metric where its volume column is below the threshold."""
    return df.withColumns({m: F.when(F.col(v) >= thr, F.col(m)) for m, (v, thr) in rules.items()})


def own_and_opponent() -> tuple[Column, Column]:
    """Shooter-relative skater counts of the manpower code."""
    h, a, home = F.col("sit_home_n"), F.col("sit_away_n"), F.col("is_home")
    return F.when(home, h).otherwise(a), F.when(home, a).otherwise(h)


def is_priced() -> Column:
    own, opp = own_and_opponent()
    hit = F.lit(False)
    for o, p in PRICED:
        hit = hit | ((own == o) & (opp == p))
    return hit
