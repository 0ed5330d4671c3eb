"""The supplied tables read as a game feed.

`events` becomes play-by-play and shift rows, `lineitem` becomes shooter-goalie duels. All columns
are plain expressions over the scan, so column pruning and filters reach the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _team(group: Column, parity: Column) -> Column:
    return F.format_string("T%03d", (group * 2 + parity).cast("long"))


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """One row per source event with game, season, clock, side and roles worked out.

    A day is a game night; 50 users in a row share a rink. Eight days make a season, counted on from
    2024 over the years, and the last day of each is a play-off night (game-type digits 03). A game's
    id is rink, four digits of season, two of type and four of the night in its season.
    """
    src = table(spark, folder, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    group = F.floor(F.col("user_id") / 50)
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    base = src.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.to_date("ts").alias("game_date"),
        day.alias("day"),
        group.cast("long").alias("grp"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (2021 + F.floor(day / 8)).cast("long").alias("season"),
        F.floor(second / 16).cast("int").alias("time_g"),
    )
    traded = (F.col("user_id") % 10 == 3) & (F.col("season") >= 2023)
    parity = (F.col("user_id") + F.when(traded, 1).otherwise(0)) % 2
    base = base.withColumn("parity", parity).withColumn(
        "game_id",
        (F.col("grp") * 10000 + F.col("season")) * 1000000
        + F.when(F.col("day") % 8 == 7, 30000).otherwise(20000)
        + F.col("day") % 8,
    )
    k, et = F.col("k"), F.col("event_type")
    kind = (
        F.when((et == "purchase") & (k < 30), "goal")
        .when((et == "purchase") & (k < 50), "hit")
        .when((et == "purchase") & (k < 65), "giveaway")
        .when((et == "purchase") & (k < 80), "takeaway")
        .when(et == "purchase", "penalty")
        .when(et == "click", "shot-on-goal")
        .when(et == "view", "missed-shot")
        .when(et == "error", "blocked-shot")
        .when(k >= 90, "stoppage")
        .otherwise("faceoff")
    )
    flip = F.col("day") % 2
    return base.select(
        "*",
        kind.alias("type"),
        (F.floor(F.col("time_g") / 1200) + 1).cast("int").alias("period"),
        ((F.col("parity") + F.col("day")) % 2 == 0).alias("user_home"),
        _team(F.col("grp"), F.col("parity")).alias("user_team"),
        _team(F.col("grp"), flip).alias("home_team"),
        _team(F.col("grp"), 1 - flip).alias("away_team"),
    )


def _mate(shift: Column) -> Column:
    """Another user of the same rink."""
    return F.floor(F.col("user_id") / 50) * 50 + (F.col("user_id") % 50 + shift) % 50


def play_by_play(f: DataFrame) -> DataFrame:
    """Event table: owner side, coordinates, manpower code and the role ids of each event."""
    k, eid, t = F.col("k"), F.col("event_id"), F.col("type")
    is_block = t == "blocked-shot"
    owner_home = F.when(is_block, ~F.col("user_home")).otherwise(F.col("user_home"))
    m = eid % 11
    code = (
        F.when(m == 0, "1451").when(m == 1, "1541").when(m == 2, "0651").when(m == 3, "1560")
        .when(m == 4, "551").when(m == 6, "15A1").when(m == 7, "15510").when(m != 5, "1551")
    )
    st = k % 6
    shot_type = (
        F.when(st == 0, "wrist").when(st == 1, "snap").when(st == 2, "slap")
        .when(st == 3, "tip-in").when(st == 4, "backhand")
    )
    is_shot = t.isin("goal", "shot-on-goal", "missed-shot", "blocked-shot")
    assist1 = F.when((t == "goal") & (k % 5 != 0), _mate(2 + (k % 7) * 2))
    assist2 = F.when((t == "goal") & (k % 5 != 0) & (k % 3 != 0), _mate(4 + (k % 11) * 2))
    return f.select(
        "game_id",
        eid.alias("event_idx"),
        "season",
        "game_date",
        "period",
        "time_g",
        "type",
        F.when(owner_home, F.col("home_team")).otherwise(F.col("away_team")).alias("team"),
        owner_home.alias("is_home"),
        F.when(k != 0, ((eid * 37 + k * 13) % 199 - 99)).cast("int").alias("x"),
        F.when(k != 0, ((eid * 53 + k * 7) % 85 - 42)).cast("int").alias("y"),
        F.when(k % 20 != 19, F.element_at(F.array(F.lit("O"), F.lit("D"), F.lit("N")), (eid % 3 + 1).cast("int"))).alias("zone"),
        code.alias("situation_code"),
        F.when((F.col("period") + F.col("day")) % 2 == 0, "left").otherwise("right").alias("home_defending_side"),
        F.when(t != "stoppage", F.col("user_id")).alias("primary_player_id"),
        F.when(t.isin("blocked-shot", "faceoff", "penalty"), _mate(1 + (k % 5) * 2)).alias("secondary_player_id"),
        assist1.alias("assist1_player_id"),
        assist2.alias("assist2_player_id"),
        F.when(is_shot, shot_type).alias("shot_type"),
        F.when(t == "penalty", F.concat(F.lit("pen-"), (k % 4).cast("string"))).alias("detail_key"),
        "home_team",
        "away_team",
    )


def shift_rows(f: DataFrame) -> DataFrame:
    """Raw, still overlapping presence intervals. A few rows carry a foreign team code."""
    foreign = (F.col("user_id") % 25 == 7) & (F.col("day") % 5 == 0)
    return f.select(
        "game_id",
        "season",
        F.col("user_id").alias("player_id"),
        F.when(foreign, "ZZZ").otherwise(F.col("user_team")).alias("team"),
        "period",
        F.col("time_g").alias("start_g"),
        (F.col("time_g") + F.greatest(F.lit(1), F.ceil(F.col("value") * 11).cast("int"))).alias("end_g"),
    )


def roster_rows(f: DataFrame) -> DataFrame:
    """Roster appearances; the same player and season repeats once per event."""
    p = F.col("user_id")
    pos = (
        F.when(p % 17 == 0, "G").when(p % 3 == 1, "D").when(p % 3 == 2, "C")
        .when(p % 2 == 0, "L").otherwise("R")
    )
    return f.select(
        p.alias("player_id"),
        "season",
        "game_id",
        F.concat(F.lit("Player #"), p.cast("string")).alias("player_name"),
        pos.alias("position"),
        (p % 98 + 1).alias("number"),
        F.col("user_team").alias("team"),
    )


def bios(f: DataFrame) -> DataFrame:
    """Birthdate and stick hand per player, some unknown."""
    p = F.col("user_id")
    return f.select(p.alias("player_id")).distinct().select(
        "player_id",
        F.when(F.col("player_id") % 13 != 0, F.date_sub(F.lit("2004-06-30").cast("date"), ((F.col("player_id") * 97) % 6200).cast("int"))).alias("birthdate"),
        F.when(F.col("player_id") % 11 == 0, None).when(F.col("player_id") % 3 == 0, "R").otherwise("L").alias("hand"),
    )


def game_headers(f: DataFrame) -> DataFrame:
    """Game-level facts: date, teams and the venue name as printed that season."""
    v = (F.col("grp") * 3 + F.when(F.col("season") >= 2023, 1).otherwise(0)) % 25 + 1
    return f.select(
        "game_id",
        "season",
        "game_date",
        "home_team",
        "away_team",
        F.when(F.col("game_id") % 29 != 0, F.concat(F.lit("Brand#"), v.cast("string"))).alias("raw_venue"),
    ).distinct()


def duels(spark: SparkSession, folder: str) -> DataFrame:
    """Shooter-goalie duels from `lineitem` joined to its order's customer."""
    li = table(spark, folder, "lineitem")
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("shooter_id"),
        F.col("l_suppkey").alias("goalie_id"),
        (0.02 + 3 * F.col("l_discount")).alias("xg"),
        (F.col("l_returnflag") == "R").cast("int").alias("goal"),
        (F.col("l_linestatus") == "O").alias("is_home"),
        F.year("l_shipdate").cast("long").alias("season"),
        F.col("l_returnflag").alias("shot_type"),
        (F.col("o_custkey") % 25).alias("off_nation"),
        (F.col("l_suppkey") % 25).alias("def_nation"),
    )
