"""Incremental landing: new or repaired games arrive as files, touched seasons are rewritten.

A game is replaced as a whole, and which version counts is decided by state, not by arrival: a keyed
state holds the newest version seen of every (game, part), so a late delivery of an older version is
dropped in the stream, whenever it comes. There is no watermark, as a repair may come years later. The
rows of a game are dealt to PARTS keys, so one busy game is no single task, and a key serves many games,
so small games share its calls to the store; a part that has not seen the newest version yet is settled by the upsert, which compares versions of whole games. Every batch is
idempotent, so a replay after a failure gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shiftgrain.models.chance import ChanceModel
from shiftgrain.operators.shots import chance_features
from shiftgrain.session import cut_lineage
from shiftgrain.sources import landing as L

#: Groups that games are dealt to, and parts that the rows of one game are dealt to. A key of the state is a part of a group.
GROUPS, PARTS = 32, 8


class NewestVersion(StatefulProcessor):
    """Passes on the rows of a game whose version is not older than the newest that the key has seen of it.

    A key holds the versions of all its games in one value, read and written once a batch, so the calls
    to the store follow the keys and not the games.
    """

    def __init__(self, version: str, names: list[str]):
        self.version, self.names = version, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "games array<string>, versions array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        games, versions = self.held.get() if self.held.exists() else ([], [])
        before = dict(zip(games, versions))
        newest = dict(before)
        for frame in rows:
            for game, top in frame.groupby("state_game")[self.version].max().items():
                newest[game] = max(newest.get(game, int(top)), int(top))
            yield frame.loc[frame[self.version] >= frame["state_game"].map(newest), self.names]
        if newest != before:
            self.held.update((list(newest), list(newest.values())))

    def close(self) -> None:
        pass


def newest_in_stream(stream: DataFrame, game: str, version: str) -> DataFrame:
    """The stream without rows of a version older than one that its game's part has already brought. Null versions count as -1."""
    rows = stream.withColumn(version, F.coalesce(F.col(version).cast("long"), F.lit(-1).cast("long")))
    # the mark keeps a null game apart from every name
    named = rows.withColumn("state_game", F.coalesce(F.concat(F.lit("="), F.col(game).cast("string")), F.lit("")))
    dealt = named.withColumns({"_group": F.pmod(F.xxhash64(game), F.lit(GROUPS)), "_part": F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS))})
    newest = NewestVersion(version, named.columns)
    return dealt.groupBy("_group", "_part").transformWithStateInPandas(newest, named.schema, "Append", "None").drop("state_game")


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key; the whole row breaks ties so a replay picks the same one.

    The aggregate combines inside each task first, so a key repeated very often stays cheap.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    picked = df.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(version), F.xxhash64(*rest))).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def newest_games(df: DataFrame, game: str, version: str) -> DataFrame:
    """All rows of the newest version of each game."""
    best = df.groupBy(game).agg(F.max(version).alias("_v"))
    return df.join(best, game).where(F.col(version) == F.col("_v")).drop("_v")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def upsert_games(batch: DataFrame, path: str, game: str = "game_id", version: str = "version") -> list[int]:
    """Merge a batch of game rows into a season-partitioned table and rewrite only its seasons.

    Older versions never replace newer ones. The merged seasons are materialised before the old
    files are overwritten. Returns the touched seasons (a handful of integers).
    """
    spark = batch.sparkSession
    # written first: a batch read twice would run the stream's state twice
    new = newest_games(cut_lineage(batch), game, version)
    seasons = sorted(r[0] for r in new.select("season").distinct().collect())
    if not seasons:
        return []
    old = _stored(spark, path)
    both = new if old is None else old.where(F.col("season").isin(*seasons)).unionByName(new, allowMissingColumns=True)
    L.write_season_table(cut_lineage(newest_games(both, game, version).dropDuplicates()), path)
    return seasons


def start_landing(stream: DataFrame, table: str, checkpoint: str, after: Callable[[list[int]], None] | None = None, game: str = "game_id", version: str = "version"):
    """Drain what has arrived, drop late deliveries of older versions, upsert the rest, then call `after` with the touched seasons."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def step(batch: DataFrame, _: int) -> None:
        seasons = upsert_games(batch, table, game, version)
        if seasons and after is not None:
            after(seasons)

    return newest_in_stream(stream, game, version).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def game_file_stream(spark: SparkSession, inbox: str) -> DataFrame:
    """New game files as event rows; the file's time is the version of its game."""
    raw = spark.readStream.schema(L.GAME_SCHEMA).option("multiLine", True).json(inbox).select("*", F.col("_metadata.file_modification_time").alias("version"))
    return _events_with_version(raw)


def _events_with_version(raw: DataFrame) -> DataFrame:
    keep = raw.select("id", "homeTeam", "awayTeam", "plays", "version")
    # the version travels inside each play so that flattening needs no join
    marked = keep.withColumn("plays", F.transform("plays", lambda p: p.withField("version", F.col("version"))))
    return L.game_events(marked, F.col("p.version").alias("version"))


def score_seasons(events_table: str, xg_table: str, hands: DataFrame, model: ChanceModel, seasons: list[int]) -> None:
    """Score the touched seasons with the frozen model; features are recomputed from whole games."""
    spark = hands.sparkSession
    ev = spark.read.parquet(events_table).where(F.col("season").isin(*seasons))
    xg = model.transform(chance_features(ev, hands)).select("game_id", "event_idx", F.col("season").cast("int").alias("season"), "xg")
    L.write_season_table(xg, xg_table)


def delivery_stream(spark: SparkSession, inbox: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """Delivered tables of one schema as a stream, at most `files` files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(inbox)
