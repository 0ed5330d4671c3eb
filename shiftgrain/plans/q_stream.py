"""Incremental landing over the supplied event table (ST1-ST3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shiftgrain.models.chance import input_signature, saved_fit
from shiftgrain.operators.shots import chance_features
from shiftgrain.plans.catalog import query
from shiftgrain.session import checkpoint_dir
from shiftgrain.sources.landing import write_season_table
from shiftgrain.streaming import incremental as ST

C = F.col


_DELIVERED = """SELECT season, game_id, event_id, event_type, CASE WHEN game_id % 3 = 0 THEN 3 ELSE 2 END AS version, CASE WHEN game_id % 3 = 0 THEN 2 * value ELSE value END AS value
 FROM feed WHERE NOT (game_id % 3 = 0 AND event_id % 10 = 7)"""


def _landed(t):
    """Three deliveries of every game drained as a stream into a season table.

    Version 2 of all games comes first; then, late, version 1 with other values; then version 3 of
    every third game, doubled and without some of its events.
    """
    base = f"{checkpoint_dir(t.spark)}/landing/{uuid.uuid4().hex}"
    rows = t.feed.select("season", "game_id", "event_id", "event_type", "value")
    third = rows.where("game_id % 3 = 0 AND event_id % 10 <> 7").withColumn("value", C("value") * 2)
    for version, part in ((2, rows), (1, rows.withColumn("value", C("value") + 1000)), (3, third)):
        part.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(f"{base}/inbox")
    schema = t.spark.read.parquet(f"{base}/inbox").schema
    files = max(1, len(t.spark.read.parquet(f"{base}/inbox").inputFiles()) // 6)
    ST.start_landing(ST.delivery_stream(t.spark, f"{base}/inbox", schema, files), f"{base}/table", f"{base}/progress").awaitTermination()
    return t.spark.read.parquet(f"{base}/table")


@query("ST1_incremental_landing", f"SELECT season, event_type, count(*) AS n, round(sum(value), 4) AS value FROM ({_DELIVERED}) GROUP BY 1, 2")
def st1(t):
    """What has landed after all deliveries, by season and type."""
    return _landed(t).groupBy("season", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("ST2_late_games", f"SELECT game_id, version, count(*) AS n, round(sum(value), 4) AS value FROM ({_DELIVERED}) GROUP BY 1, 2")
def st2b(t):
    """Only the newest version of every game remains, although the oldest arrives after it."""
    return _landed(t).groupBy("game_id", "version").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("ST2_latest_version", "SELECT user_id, event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1, 2")
def st2(t):
    e = t.raw("events").select("user_id", "event_type", "ts", "event_id")
    d = ST.latest(e, ["user_id", "event_type"], "ts")
    return d.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event_id")


def _scored_landing(t):
    """Land every season of events and score each with the saved model, the way a landing batch does."""
    base = f"{checkpoint_dir(t.spark)}/landing/{uuid.uuid4().hex}"
    write_season_table(t.events, f"{base}/events")
    model, _ = saved_fit(chance_features(t.events, t.bios), input_signature(t.spark, [f"{t.folder}/events.parquet"]))
    seasons = sorted(r[0] for r in t.spark.read.parquet(f"{base}/events").select("season").distinct().collect())
    ST.score_seasons(f"{base}/events", f"{base}/xg", t.bios, model, seasons)
    return t.spark.read.parquet(f"{base}/xg")


@query("ST3_frozen_stream_scores")
def st3(t):
    return _scored_landing(t).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("xg").alias("xg"))


@query("ST3_scored_shots", "SELECT e.season, count(*) AS n, true AS valid FROM ev e JOIN xg USING (game_id, event_idx) GROUP BY 1")
def st3b(t):
    """Each modelled shot of each landed season is scored once."""
    s = _scored_landing(t).groupBy("season").agg(F.count_distinct("game_id", "event_idx").alias("n"), F.count(F.lit(1)).alias("m"), F.min("xg").alias("low"), F.max("xg").alias("high"))
    return s.select("season", "n", ((C("n") == C("m")) & (C("low") >= 0) & (C("high") <= 1)).alias("valid"))
