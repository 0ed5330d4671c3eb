"""Career pooling, rates, ranked metrics, shooting splits and team summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S
from shiftgrain.operators.box import ONICE
from shiftgrain.operators.eligibility import is_priced, own_and_opponent
from shiftgrain.operators.ranking import percentile


def weighted_mean(value: str, weight: str) -> Column:
    v = F.col(value)
    return F.sum(v * F.col(weight)) / F.sum(F.when(v.isNotNull(), F.col(weight)))


def career(box: DataFrame, sums: list[str]) -> DataFrame:
    """Additive sums over seasons, the latest season's team, and every team."""
    return box.groupBy("player_id").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.max_by("team", "season").alias("team"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("teams")))).alias("teams"),
    )


def onice_rates(sums: DataFrame) -> DataFrame:
    """Career on-ice rates and shares per player."""
    s = sums.groupBy("player_id").agg(*[F.sum(c).alias(c) for c in ONICE])
    return s.select(
        "player_id", "ev_onice_s",
        S.per60("ev_xgf_on", "ev_onice_s").alias("ev_xgf60"), S.per60("ev_xga_on", "ev_onice_s").alias("ev_xga60"),
        S.share("ev_xgf_on", "ev_xga_on").alias("ev_xgshare"),
        S.per60("ev_cf_on", "ev_onice_s").alias("ev_cf60"), S.per60("ev_ca_on", "ev_onice_s").alias("ev_ca60"),
        S.share("ev_cf_on", "ev_ca_on").alias("ev_cfshare"),
        S.per60("pp_xgf_on", "pp_onice_s").alias("pp_xgf60"), S.per60("pk_xga_on", "pk_onice_s").alias("pk_xga60"),
        (F.col("ev_oz_starts") + F.col("ev_dz_starts")).alias("n_zs"), S.share("ev_oz_starts", "ev_dz_starts").alias("ozs"),
    )


def ranked_metrics(df: DataFrame, entity: str, group: str, metrics: Mapping[str, tuple[bool, str, float]]) -> DataFrame:
    """Add `<metric>_pct` for every metric: its percentile among eligible rows of the group.

    All metrics are stacked into one long table and ranked together, so the number of shuffles does
    not grow with the number of metrics.
    """
    cells = [
        F.struct(F.lit(m).alias("metric"), F.when(F.col(vol) >= thr, F.col(m)).cast("double").alias("value"), F.lit(up).alias("up"))
        for m, (up, vol, thr) in metrics.items()
    ]
    long = df.select(F.col(entity), F.col(group), F.explode(F.array(*cells)).alias("c")).select(entity, group, "c.*").where("value is not null")
    pct = percentile(long, [group, "metric"], "value", "pct", higher=F.col("up"))
    wide = pct.groupBy(entity).agg(*[F.max(F.when(F.col("metric") == m, F.col("pct"))).alias(f"{m}_pct") for m in metrics])
    return df.join(wide, entity, "left")


def individual_rates(box: DataFrame, shots: DataFrame) -> DataFrame:
    """A player's own shooting, production and penalties per 60 of all his ice time."""
    s = box.groupBy("player_id").agg(
        F.sum("toi_s").alias("secs"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("g", "a1", "a2", "pen_drawn", "pen_taken", "fo_won", "fo_lost")],
    )
    s = s.join(shots, "player_id", "left").fillna(0, ["shots", "ixg"])
    per = {
        "shots60": F.col("shots"), "ixg60": F.col("ixg"), "g60": F.col("g"), "a60": F.col("a1") + F.col("a2"),
        "a1_60": F.col("a1"), "pen_drawn60": F.col("pen_drawn"), "pen_taken60": F.col("pen_taken"),
    }
    s = s.withColumns({n: S.per60(e, "secs") for n, e in per.items()})
    return (
        s.withColumn("xg_per_shot", S.ratio("ixg", "shots")).withColumn("fo_win", S.share("fo_won", "fo_lost"))
        .withColumn("toi_all", F.col("secs") / 60.0).withColumn("c_fo", F.col("fo_won") + F.col("fo_lost"))
    )


def goalie_rates(box: DataFrame) -> DataFrame:
    """Career rates per goalie from season lines."""
    cols = ("toi_s", "starts", "qs", "sa", "xga", "ga", "sog_against", "saves", "gsax", "hd_sog", "hd_ga")
    g = box.groupBy("player_id").agg(*[F.sum(c).alias(c) for c in cols])
    return (
        g.withColumn("sv_pct", S.ratio("saves", "sog_against")).withColumn("gaa", S.per60("ga", "toi_s"))
        .withColumn("gsax60", S.per60("gsax", "toi_s")).withColumn("sa60", S.per60("sog_against", "toi_s"))
        .withColumn("hd_sv_pct", S.ratio(F.col("hd_sog") - F.col("hd_ga"), "hd_sog")).withColumn("qs_pct", S.ratio("qs", "starts"))
    )


def _shooter_strength() -> tuple[Column, Column]:
    return S.strength_side("strength", "is_home"), S.strength_side("strength", ~F.col("is_home"))


def shots_by_strength(onice: DataFrame, *keys: str) -> DataFrame:
    """Own shots and chance value at 5v5 and on the power play, seen from the shooter's side."""
    own, opp = _shooter_strength()
    five, pp = F.col("strength") == "5v5", (own == 5) & (opp == 4)
    s = onice.where("shooter_id is not null and xg is not null")
    return s.groupBy(F.col("shooter_id").alias("player_id"), *keys).agg(
        F.count_if(five).alias("shots5"), F.count_if(pp).alias("shotspp"),
        F.coalesce(F.sum(F.when(five, F.col("xg"))), F.lit(0.0)).alias("ixg5"),
        F.coalesce(F.sum(F.when(pp, F.col("xg"))), F.lit(0.0)).alias("ixgpp"),
    )


def penalty_value(onice: DataFrame, box: DataFrame) -> DataFrame:
    """Net goals per drawn penalty: (power-play goals - shorthanded goals) / drawn. One row."""
    own, opp = _shooter_strength()
    goals = onice.where("goal = 1").agg(
        F.count_if((own == 5) & (opp == 4)).alias("pp"), F.count_if((own == 4) & (opp == 5)).alias("sh")
    )
    drawn = box.agg(F.sum("pen_drawn").alias("n"))
    return goals.crossJoin(drawn).select(S.ratio(F.col("pp") - F.col("sh"), "n", 0.0).alias("v"))


def unpriced_goals(onice: DataFrame, last_season: int) -> DataFrame:
    """Goals in situations the ledger does not price: window, last season, and its detail map."""
    own, opp = own_and_opponent()
    g = onice.where("goal = 1 and sit_home_n is not null and sit_away_n is not null").where(~is_priced())
    rows = g.select(F.col("shooter_id").alias("player_id"), "season", S.strength_label(own, opp).alias("label"))
    per = rows.groupBy("player_id", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("season") == last_season).alias("m"))
    entry = F.when(F.col("m") > 0, F.struct("label", F.col("m").alias("n")))
    return per.groupBy("player_id").agg(
        F.sum("n").alias("up_window"), F.sum("m").alias("up_last"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("detail"),
    )


def skater_groups(roster: DataFrame) -> DataFrame:
    """(player_id, grp): D or F by the position of a skater's last season, one row a player."""
    last = roster.groupBy("player_id").agg(F.max_by("position", "season").alias("position")).where("position <> 'G'")
    return last.select("player_id", F.when(F.col("position") == "D", "D").otherwise("F").alias("grp"))


def team_index(shifts: DataFrame, games: DataFrame) -> DataFrame:
    a = shifts.select("team", "player_id").distinct().groupBy("team").agg(F.count(F.lit(1)).alias("players"))
    g = games.select(F.explode(F.array("home_team", "away_team")).alias("team"), "game_id").distinct()
    b = g.groupBy("team").agg(F.count(F.lit(1)).alias("games"))
    return a.join(b, "team", "full").fillna(0)
