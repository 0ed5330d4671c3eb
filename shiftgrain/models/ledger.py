"""Goals attributed: per-60 shares, actual-goal totals, season detail, goalie value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S

# Skaters sharing the baseline at even strength / on the power play, and short-handed.
EVEN_SKATERS, KILL_SKATERS = 5.0, 4.0


@dataclass(frozen=True)
class Situation:
    """The columns of one manpower situation and how many skaters share its baseline at either end.

    `shots` and `chances` are the player's own; a situation without them creates nothing.
    """

    base: str
    own: str
    own_minutes: str
    own_skaters: float
    against: str
    against_minutes: str
    against_skaters: float
    rate: str
    shots: str
    chances: str
    prefix: str
    allowed_as: str


SITUATIONS = (
    Situation("ev_off_base", "ev_off", "ev_off_toi", EVEN_SKATERS, "ev_def", "ev_off_toi", EVEN_SKATERS, "ev_xgf60", "shots5", "ixg5", "", "allow60"),
    Situation("pp_off_base", "pp_off", "pp_off_toi", EVEN_SKATERS, "pk_def", "pk_def_toi", KILL_SKATERS, "pp_xgf60", "shotspp", "ixgpp", "pp_", "pk_allow60"),
)


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _safe(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def _situation_columns(s: Situation) -> tuple[dict[str, Column], Column, Column]:
    """A situation's per-hour columns, and the goals created and allowed in it."""
    hours, hours_against = _or_zero(s.own_minutes) / 60.0, _or_zero(s.against_minutes) / 60.0
    created = _or_zero(s.base) / s.own_skaters + _or_zero(s.own)
    allowed = _or_zero(s.base) / s.against_skaters + _or_zero(s.against)
    # The part of the chances with the player on the ice that were the player's own shots.
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _safe(_safe(_or_zero(s.chances), hours), _or_zero(s.rate))))
    finishing = _safe(_or_zero("fin_per100") / 100.0 * _or_zero(s.shots), hours)
    rates = {f"{s.prefix}scoring60": share * created + finishing, f"{s.prefix}playmaking60": created - share * created, s.allowed_as: allowed}
    return rates, created * hours, allowed * hours_against


def value_table(players: DataFrame, shots: DataFrame, pen_v: DataFrame) -> DataFrame:
    """The value ledger, one row per player: each situation's shares, then totals, per game too.

    `pen_v` is the one-row penalty value, attached by a cross join with that single row. Missing
    inputs count as zero.
    """
    worth = F.broadcast(pen_v.select(F.col("v").alias("_v")))
    penalties = (_or_zero("pen_drawn60") - _or_zero("pen_taken60")) * F.col("_v")
    columns: dict[str, Column] = {"pen_net60": penalties, "g_fin": _or_zero("fin_goals"), "g_pen": penalties * _or_zero("toi_all") / 60.0}
    created, allowed = F.lit(0.0), F.lit(0.0)
    for s in SITUATIONS:
        rates, more, less = _situation_columns(s)
        columns |= rates
        created, allowed = created + more, allowed + less
    columns |= {"g_created": created, "g_allowed": allowed, "_games": _or_zero("gp")}
    table = players.join(shots, "player_id", "left").crossJoin(worth).select(*players.columns, *(e.alias(n) for n, e in columns.items()))
    table = table.withColumn("g_net", F.col("g_created") + F.col("g_fin") - F.col("g_allowed") + F.col("g_pen"))
    per_game = {f"g{k}_pg": _safe(F.col(c), F.col("_games")) for k, c in (("create", "g_created"), ("allow", "g_allowed"), ("net", "g_net"))}
    return table.withColumns(per_game).drop("_games")


def season_value(players: DataFrame, shots: DataFrame, pen_v: DataFrame) -> DataFrame:
    """The ledger per (player, season): the same projection on single-season inputs."""
    keyed = players.withColumn("_ps", F.struct("player_id", "season"))
    s = shots.withColumn("_ps", F.struct("player_id", "season")).drop("player_id", "season")
    a = keyed.drop("player_id", "season").withColumnRenamed("_ps", "player_id")
    out = value_table(a, s.withColumnRenamed("_ps", "player_id"), pen_v)
    return out.select("player_id.player_id", "player_id.season", *[c for c in out.columns if c != "player_id"])


def goalie_value(rates: DataFrame, talent: DataFrame, min_faced: int) -> DataFrame:
    """A goalie's goals prevented are his shrunken goals saved; ranked among enough shots faced."""
    from shiftgrain.operators.ranking import percentile

    g = rates.join(talent, "player_id", "left").withColumn("gprev60", S.per60("gsax_saved", "toi_s"))
    g = g.withColumn("g_net", F.col("gsax_saved")).withColumn("_g", F.lit(0))
    g = g.withColumn("_e", F.when(F.col("sa") >= min_faced, F.col("gprev60")))
    return percentile(g, ["_g"], "_e", "gprev60_pct").drop("_g", "_e")


def share_closure(players: DataFrame, league: DataFrame) -> DataFrame:
    """Created and allowed goals of every player beside the league's total chance value."""
    b5 = F.col("ev_off_toi") / 60.0
    s = players.agg(
        F.sum((F.col("ev_off_base") / EVEN_SKATERS + F.col("ev_off")) * b5).alias("created"),
        F.sum((F.col("ev_off_base") / EVEN_SKATERS + F.col("ev_def")) * b5).alias("allowed"),
    )
    return s.crossJoin(league)
