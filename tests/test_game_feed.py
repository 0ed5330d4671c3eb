"""The game key keeps rinks, nights and years apart whatever the number of users."""

import datetime as dt

from pyspark.sql import functions as F

from shiftgrain.sources import game_feed


def test_rinks_and_years_stay_apart(spark, tmp_path):
    rows = [(k, dt.datetime(year, 3, day, 10, 0, 5), u, "click", 1.0, '{"k": 7}') for k, (year, day, u) in enumerate((y, d, u) for y in (2024, 2025) for d in (1, 2) for u in range(0, 12000, 25))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    feed = game_feed.feed(spark, str(tmp_path))
    games = feed.groupBy("game_id").agg(F.countDistinct(F.floor(F.col("user_id") / 50)).alias("rinks"), F.countDistinct("game_date").alias("nights"), F.countDistinct("home_team").alias("homes"), F.first("season").alias("season"))
    assert games.count() == 240 * 4
    assert games.where("rinks > 1 or nights > 1 or homes > 1").count() == 0
    assert games.where("(game_id div 1000000) % 10000 <> season").count() == 0
    assert feed.select("home_team").distinct().count() == 480
