"""Raw feeds, landing plans, season tables: reading, choosing, merging, writing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftgrain.functions import scalars as S

# Schedule states of a finished game.
FINAL_STATES = ("OFF", "FINAL")

_ID, _TXT, _INT = T.LongType(), T.StringType(), T.IntegerType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_NAME = _struct(default=_TXT)
_TEAM = _struct(id=_ID, abbrev=_TXT, score=_INT)
_ROLES = (
    "scoringPlayerId", "shootingPlayerId", "hittingPlayerId", "committedByPlayerId", "winningPlayerId",
    "losingPlayerId", "blockingPlayerId", "drawnByPlayerId", "playerId", "assist1PlayerId", "assist2PlayerId",
)
_DETAILS = T.StructType(
    [T.StructField(n, _ID, True) for n in ("eventOwnerTeamId", *_ROLES)]
    + [T.StructField(n, _INT, True) for n in ("xCoord", "yCoord")]
    + [T.StructField(n, _TXT, True) for n in ("zoneCode", "shotType", "descKey")]
)
PLAY = _struct(
    eventId=_ID, sortOrder=_ID, typeDescKey=_TXT, timeInPeriod=_TXT, situationCode=_TXT, homeTeamDefendingSide=_TXT,
    periodDescriptor=_struct(number=_INT, periodType=_TXT), details=_DETAILS,
)
SPOT = _struct(playerId=_ID, teamId=_ID, firstName=_NAME, lastName=_NAME, positionCode=_TXT, sweaterNumber=_INT)
GAME_SCHEMA = _struct(
    id=_ID, gameDate=_TXT, gameType=_INT, homeTeam=_TEAM, awayTeam=_TEAM, venue=_NAME,
    plays=T.ArrayType(PLAY), rosterSpots=T.ArrayType(SPOT),
)
SHIFT = _struct(
    gameId=_ID, playerId=_ID, firstName=_TXT, lastName=_TXT, teamAbbrev=_TXT, teamId=_ID, period=_INT,
    startTime=_TXT, endTime=_TXT, duration=_TXT,
)
SHIFT_SCHEMA = _struct(data=T.ArrayType(SHIFT))
PLAYER = _struct(
    playerId=_ID, firstName=_NAME, lastName=_NAME, birthDate=_TXT, shootsCatches=_TXT, heightInInches=_INT,
    weightInPounds=_INT, draftDetails=_struct(year=_INT, overallPick=_INT),
)


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Nested game files, one JSON document per file, with a fixed schema (no inference pass)."""
    return spark.read.schema(GAME_SCHEMA).json(path, multiLine=True)


def _abbrev(team_id):
    return F.when(team_id == F.col("homeTeam.id"), F.col("homeTeam.abbrev")).when(team_id == F.col("awayTeam.id"), F.col("awayTeam.abbrev"))


def game_events(games: DataFrame, *extra: Column) -> DataFrame:
    """One row per play with its owner, place and role ids; plays without a clock are dropped."""
    return play_rows(games.select("id", "homeTeam", "awayTeam", F.explode("plays").alias("p")), *extra)


def play_rows(p: DataFrame, *extra: Column) -> DataFrame:
    """Event rows of (id, homeTeam, awayTeam, p), a play a row."""
    p = p.where("p.periodDescriptor.number is not null and p.timeInPeriod <> ''")
    d = "p.details."
    return p.select(
        F.col("id").alias("game_id"),
        F.coalesce("p.sortOrder", "p.eventId").alias("event_idx"),
        S.season_of_id("id").cast("long").alias("season"),
        F.col("p.periodDescriptor.number").alias("period"),
        F.col("p.periodDescriptor.periodType").alias("period_type"),
        S.game_seconds("p.periodDescriptor.number", "p.timeInPeriod").alias("time_g"),
        F.col("p.typeDescKey").alias("type"),
        _abbrev(F.col(d + "eventOwnerTeamId")).alias("team"),
        F.coalesce(F.col(d + "eventOwnerTeamId") == F.col("homeTeam.id"), F.lit(False)).alias("is_home"),
        F.col(d + "xCoord").alias("x"), F.col(d + "yCoord").alias("y"), F.col(d + "zoneCode").alias("zone"),
        F.col("p.situationCode").alias("situation_code"),
        F.col("p.homeTeamDefendingSide").alias("home_defending_side"),
        S.first_role(*[d + r for r in ("scoringPlayerId", "shootingPlayerId", "hittingPlayerId", "committedByPlayerId", "winningPlayerId", "playerId")]).alias("primary_player_id"),
        S.first_role(*[d + r for r in ("blockingPlayerId", "losingPlayerId", "drawnByPlayerId")]).alias("secondary_player_id"),
        F.col(d + "assist1PlayerId").alias("assist1_player_id"), F.col(d + "assist2PlayerId").alias("assist2_player_id"),
        F.col(d + "shotType").alias("shot_type"), F.col(d + "descKey").alias("detail_key"),
        F.col("homeTeam.abbrev").alias("home_team"), F.col("awayTeam.abbrev").alias("away_team"), *extra,
    )


def game_roster(games: DataFrame) -> DataFrame:
    """One row per (player, season): the spot of the last game seen."""
    r = games.select("id", "homeTeam", "awayTeam", F.explode("rosterSpots").alias("r"))
    r = r.select(
        F.col("r.playerId").alias("player_id"), S.season_of_id("id").cast("long").alias("season"), "id",
        S.full_name("r.firstName.default", "r.lastName.default").alias("player_name"),
        F.col("r.positionCode").alias("position"), F.col("r.sweaterNumber").alias("number"), _abbrev(F.col("r.teamId")).alias("team"),
    )
    spot = F.struct("player_name", "position", "number", "team")
    return r.groupBy("player_id", "season").agg(F.max_by(spot, "id").alias("s")).select("player_id", "season", "s.*")


def game_header_rows(games: DataFrame) -> DataFrame:
    return games.select(
        F.col("id").alias("game_id"), F.col("gameDate").try_cast("date").alias("game_date"), S.season_of_id("id").cast("long").alias("season"),
        F.col("gameType").alias("game_type"), F.col("homeTeam.abbrev").alias("home_team"), F.col("awayTeam.abbrev").alias("away_team"),
        F.coalesce("venue.default", "homeTeam.abbrev").alias("raw_venue"),
    )


def read_shifts(spark: SparkSession, path: str) -> DataFrame:
    """Shift chart files to interval rows; rows without a clock or with no length are dropped."""
    return shift_entries(spark.read.schema(SHIFT_SCHEMA).json(path, multiLine=True).select(F.explode("data").alias("d")).select("d.*"))


def shift_entries(s: DataFrame) -> DataFrame:
    """Interval rows of shift chart entries."""
    s = s.where("duration <> '' and startTime <> '' and endTime <> ''")
    return s.select(
        F.col("gameId").alias("game_id"), S.season_of_id("gameId").cast("long").alias("season"), F.col("playerId").alias("player_id"),
        S.full_name("firstName", "lastName").alias("player_name"), F.col("teamAbbrev").alias("team"), "period",
        S.game_seconds("period", "startTime").alias("start_g"), S.game_seconds("period", "endTime").alias("end_g"),
    ).where("end_g > start_g")


def first_bios(p: DataFrame, order: Column) -> DataFrame:
    """One bio row a player, the first by `order`."""
    bios = p.select(
        F.col("playerId").alias("player_id"), S.full_name("firstName.default", "lastName.default").alias("name"),
        F.col("birthDate").try_cast("date").alias("birthdate"), F.when(F.col("shootsCatches").isin("L", "R"), F.col("shootsCatches")).alias("hand"),
        F.col("heightInInches").alias("height_in"), F.col("weightInPounds").alias("weight_lb"),
        F.col("draftDetails.year").alias("draft_year"), F.col("draftDetails.overallPick").alias("draft_overall"), order.alias("_order"),
    )
    rest = [c for c in bios.columns if c not in ("player_id", "_order")]
    first = bios.groupBy("player_id").agg(F.min_by(F.struct(*rest), "_order").alias("bio"))
    return first.select("player_id", "bio.*")


def count_cells(pages: DataFrame, key: str, html: str, cell: str, header: str) -> DataFrame:
    """Cells and header cells per page, counted inside the scan."""
    return pages.select(key, F.regexp_count(html, F.lit(cell)).alias("cells"), F.regexp_count(html, F.lit(header)).alias("headers"))


def with_fallback(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Rows of the primary feed, and of the secondary feed only where the primary has none."""
    have = primary.select(key).distinct()
    return primary.unionByName(secondary.join(have, key, "left_anti"))


# --- landing plans ------------------------------------------------------------------------------


def schedule_union(club_schedules: DataFrame) -> DataFrame:
    """All clubs' schedules, one row per regular-season game."""
    return club_schedules.where(S.is_regular("game_id")).drop("club").dropDuplicates(["game_id"])


def landing_plan(schedule: DataFrame, inventory: DataFrame, stub_size: int) -> DataFrame:
    """Classify scheduled games: pending, missing, stale (landed as a stub) or present."""
    j = schedule.join(inventory.select("game_id", "size"), "game_id", "left")
    final = F.col("state").isin(*FINAL_STATES)
    status = F.when(~final, "pending").when(F.col("size").isNull(), "missing").when(F.col("size") < stub_size, "stale").otherwise("present")
    return j.withColumn("status", status)


def plan_counts(plan: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return plan.groupBy("season").agg(F.count(F.lit(1)).alias("scheduled"), n("pending"), n("missing"), n("stale"), n("present"))


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def full_seasons(df: DataFrame, min_games: int = 200) -> DataFrame:
    games = df.select("season", "game_id").distinct().groupBy("season").agg(F.count(F.lit(1)).alias("_n"))
    return games.where(F.col("_n") >= min_games).select("season")


# --- season tables ------------------------------------------------------------------------------


def write_season_table(df: DataFrame, path: str) -> None:
    """Replace exactly the seasons present in `df`; a rerun leaves the table unchanged.

    Rows are rebalanced by season first: a season becomes files of the advisory size, however many
    tasks made its rows, and a big season is split instead of written by one task.
    """
    df.hint("rebalance", F.col("season")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)


def replace_seasons(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows of the seasons that `new` does not carry, plus all of `new`."""
    return old.join(new.select("season").distinct(), "season", "left_anti").unionByName(new, allowMissingColumns=True)


def append_history(spark: SparkSession, record: dict, path: str) -> None:
    """Append one run record to a JSON-lines history."""
    import json

    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").write.mode("append").text(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """(key, doc) rows as JSON lines."""
    docs.select("doc").write.mode("overwrite").text(path)


def _newest(spark: SparkSession, path: str, newest: bool):
    """Latest or earliest file time under `path`; None when nothing is there."""
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException:
        return None
    pick = F.max if newest else F.min
    return files.where("length > 0").agg(pick("modificationTime")).first()[0]


def is_stale(spark: SparkSession, inputs: list[str], output: str) -> bool:
    """True when the output is missing or any input file is newer than its oldest file."""
    made = _newest(spark, output, newest=False)
    if made is None:
        return True
    seen = [_newest(spark, p, newest=True) for p in inputs]
    return any(s is not None and s > made for s in seen)


def read_or_build(spark: SparkSession, inputs: list[str], output: str, columns: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table when it is fresh and has every wanted column, else rebuild and store it."""
    if not is_stale(spark, inputs, output):
        have = spark.read.parquet(output)
        if set(columns) <= set(have.columns):
            return have
    build().write.mode("overwrite").parquet(output)
    return spark.read.parquet(output)
