"""Raw feeds written as documents, read back as VARIANT values and flattened (S3, S5, S6, S8, S9)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.plans.catalog import query
from shiftgrain.session import checkpoint_dir
from shiftgrain.sources import landing as L
from shiftgrain.sources import rendering as R
from shiftgrain.sources import variants as V

C = F.col


def _landed(t, docs: DataFrame, key: str) -> DataFrame:
    """`docs` (key, value) written a line a document, one key in fifty once more cut off in the middle, and read back."""
    path = f"{checkpoint_dir(t.spark)}/feeds/{uuid.uuid4().hex}"
    torn = docs.where(C(key) % 50 == 0).select(F.expr("substring(value, 1, length(value) - 2)").alias("value"))
    docs.select("value").union(torn).write.text(path)
    return V.read_documents(t.spark, path)


_EVENT = "game_id, event_idx, season, period, time_g, type, team, is_home, x, y, zone, situation_code, home_defending_side, primary_player_id, secondary_player_id, assist1_player_id, assist2_player_id, shot_type, detail_key"


@query("S3_nested_events", f"SELECT {_EVENT} FROM (SELECT * REPLACE (nullif(primary_player_id, 0) AS primary_player_id, nullif(secondary_player_id, 0) AS secondary_player_id) FROM ev)")
def s3(t):
    """Event rows through nested documents; what is torn is left to the other channel. A role id of 0 is no player."""
    return V.events(_landed(t, R.game_documents(t.events), "game_id")).select(*_EVENT.split(", "))


@query("S3_unreadable", "SELECT sum((game_id % 50 = 0)::INT * pages)::BIGINT AS torn, sum(pages)::BIGINT AS documents FROM (SELECT game_id, least(ceil(count(*) / 1000.0), count(*)) AS pages FROM ev GROUP BY 1)")
def s3b(t):
    """Documents that cannot be read, and those that can."""
    docs = _landed(t, R.game_documents(t.events), "game_id")
    return V.unreadable(docs).agg(F.count(F.lit(1)).alias("torn")).crossJoin(docs.where("doc is not null").agg(F.count(F.lit(1)).alias("documents")))


@query("S5_shift_charts", "SELECT game_id, season, player_id, team, period, start_g, end_g, count(*) AS n FROM shift_rows GROUP BY ALL")
def s5(t):
    got = V.shifts(_landed(t, R.shift_documents(t.shift_rows), "game_id"))
    return got.groupBy("game_id", "season", "player_id", "team", "period", "start_g", "end_g").agg(F.count(F.lit(1)).alias("n"))


@query("S6_report_shifts", "SELECT game_id, team, period, player_id, start_g, end_g, count(*) AS n FROM shift_rows WHERE period <= 4 GROUP BY ALL")
def s6b(t):
    """Shift rows through time-on-ice reports, sweaters resolved by game; the fifth period is a shootout there."""
    rows = t.shift_rows.withColumn("number", (C("player_id") % 98 + 1).cast("int"))
    path = f"{checkpoint_dir(t.spark)}/feeds/{uuid.uuid4().hex}"
    R.reports(rows, V.HEADING, V.ENTRY).write.parquet(path)
    got = V.report_shifts(t.spark.read.parquet(path), rows.select("game_id", "team", "number", "player_id").distinct())
    return got.groupBy("game_id", "team", "period", "player_id", "start_g", "end_g").agg(F.count(F.lit(1)).alias("n"))


@query("S8_player_bios", "SELECT player_id, 'Player #' || player_id AS name, birthdate::VARCHAR AS birthdate, hand FROM bios")
def s8(t):
    return V.players(_landed(t, R.player_documents(t.bios), "player_id")).select("player_id", "name", C("birthdate").cast("string").alias("birthdate"), "hand")


@query("S9_season_overwrite", "SELECT season, count(*) AS n, sum(CASE WHEN season = 2023 THEN 2 ELSE 1 END)::BIGINT AS versions, 1 AS copies FROM ev GROUP BY 1")
def s9(t):
    """A season table written twice, then one season once more: only that season changes, nothing doubles."""
    path = f"{checkpoint_dir(t.spark)}/feeds/{uuid.uuid4().hex}"
    for _ in range(2):
        L.write_season_table(t.events.withColumn("v", F.lit(1)), path)
    L.write_season_table(t.events.where("season = 2023").withColumn("v", F.lit(2)), path)
    got = t.spark.read.parquet(path).groupBy("season", "game_id", "event_idx").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("c"))
    return got.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("versions"), F.max("c").alias("copies"))
