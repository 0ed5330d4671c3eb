"""Nested documents: logs, maps, strict JSON, index files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftgrain.functions import scalars as S


def newest_first(*order: str) -> Column:
    """A collected array of `row` structs sorted by the leading fields, newest first."""
    return F.sort_array(F.collect_list(F.struct(*order)), asc=False)


def nested_game_logs(log: DataFrame) -> DataFrame:
    """player -> array of game lines, most recent first. A player has one line per game he played."""
    line = ["game_date", "game_id", "season", "team", "opp", "home", "gf", "ga", "result", "toi_s", "g", "a", "p", "sog", "pen"]
    return log.groupBy("player_id").agg(newest_first(*line).alias("games"))


def team_season_map(log: DataFrame) -> DataFrame:
    """player -> team -> season -> totals; seasons are text, as JSON keys are."""
    per = log.groupBy("player_id", "team", "season").agg(
        F.count(F.lit(1)).alias("gp"), *[F.sum(c).alias(c) for c in ("g", "a", "p", "toi_s")]
    )
    line = F.struct("gp", "g", "a", "p", "toi_s")
    inner = per.groupBy("player_id", "team").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("season").cast("string").alias("k"), line.alias("v"))))).alias("m")
    )
    return inner.groupBy("player_id").agg(F.map_from_entries(F.collect_list(F.struct("team", "m"))).alias("by_team"))


def season_map(box: DataFrame, fields: list[str]) -> DataFrame:
    entry = F.struct(F.col("season").cast("string").alias("k"), F.struct(*fields).alias("v"))
    return box.groupBy("player_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_season"))


def strict(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every double, also inside structs and arrays."""

    def fix(c: Column, dt: T.DataType) -> Column:
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            return S.clean_double(c)
        if isinstance(dt, T.StructType):
            parts = [fix(c.getField(f.name), f.dataType).alias(f.name) for f in dt.fields]
            return F.when(c.isNotNull(), F.struct(*parts))
        if isinstance(dt, T.ArrayType):
            return F.transform(c, lambda x: fix(x, dt.elementType))
        if isinstance(dt, T.MapType):
            return F.transform_values(c, lambda k, v: fix(v, dt.valueType))
        return c

    return df.select(*[fix(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, doc): one strict JSON text per row."""
    s = strict(df)
    return s.select(F.col(key), F.to_json(F.struct(*s.columns)).alias("doc"))


def game_documents(index: DataFrame, stints: DataFrame, players: DataFrame) -> DataFrame:
    """One document per game: totals, player lines by ice time, stints in order.

    A game holds a few hundred stints and some forty players; both arrays are part of the document.
    """
    st = stints.groupBy("game_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "stint_idx", F.col("start_g").alias("start"), F.col("end_g").alias("end"), S.clock_label("start_g").alias("clock_start"),
            "duration_s", "strength", "overload", "home_skaters", "away_skaters", "home_goalie", "away_goalie",
            F.bround("home_xgf", 4).alias("home_xgf"), F.bround("away_xgf", 4).alias("away_xgf"),
        ))).alias("stints")
    )
    pl = players.groupBy("game_id").agg(
        F.sort_array(F.collect_list(F.struct("toi_s", F.col("player_id").alias("id"), "team", "shifts", "g", "a1", "a2", "pts", "shots", F.bround("xg", 3).alias("xg"))), asc=False).alias("players")
    )
    head = index.select(
        "game_id", F.col("game_date").cast("string").alias("date"), F.col("home_team").alias("home"), F.col("away_team").alias("away"),
        F.struct(F.bround("home_xgf", 3).alias("home_xgf"), F.bround("away_xgf", 3).alias("away_xgf"), "home_score", "away_score").alias("totals"),
    )
    return as_json(head.join(pl, "game_id", "left").join(st, "game_id", "left"), "game_id")


def timeline(events: DataFrame, onice: DataFrame) -> DataFrame:
    """Timeline rows: kept events in their stint with the first shot at the same shooter and second."""
    first = onice.groupBy("game_id", F.col("shooter_id").alias("primary_player_id"), "time_g").agg(
        F.min_by(F.struct("xg", "onice_match", "distance", "angle", "rebound", "rush"), "event_idx").alias("shot")
    )
    e = events.withColumn("_k", F.when(F.col("type").isin(*S.FENWICK), F.col("primary_player_id")))
    f = first.withColumnsRenamed({"primary_player_id": "_k"})
    return e.join(f, ["game_id", "_k", "time_g"], "left").drop("_k").withColumn("clock", S.clock_label("time_g"))
