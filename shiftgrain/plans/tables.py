"""The derived tables of the engine, built from one folder of input tables.

Most tables are lazy plans. Five stage tables (events, merged shifts, game clock, stints, shots with
on-ice sets) feed many others, so they are written once per application as parquet under the shared
checkpoint folder and read back: later plans start from a short scan with column pruning, and a lost
executor re-reads files instead of replaying the whole chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S
from shiftgrain.operators import intervals as I
from shiftgrain.operators import shots as X
from shiftgrain.session import checkpoint_dir
from shiftgrain.sources import game_feed as G

_WRITTEN: set[str] = set()


def forget_stages() -> None:
    """Recompute the stage tables on next use (after the inputs changed)."""
    _WRITTEN.clear()


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        run = hashlib.md5(self.folder.encode()).hexdigest()[:12]
        path = f"{checkpoint_dir(self.spark)}/stages/{self.spark.sparkContext.applicationId}/{run}/{name}"
        if path not in _WRITTEN:
            build().write.mode("overwrite").parquet(path)
            _WRITTEN.add(path)
        return self.spark.read.parquet(path)

    def raw(self, name: str) -> DataFrame:
        return G.table(self.spark, self.folder, name)

    @cached_property
    def feed(self) -> DataFrame:
        return G.feed(self.spark, self.folder)

    @cached_property
    def events(self) -> DataFrame:
        return G.play_by_play(self.feed)

    @cached_property
    def filed_events(self) -> DataFrame:
        """The event table written once, for the tables below: its expressions over the raw rows cost far
        more than a scan. Dealt evenly, because the files of the input decide how many tasks read it."""
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return self._stage("events", lambda: self.events.repartition(parts, "event_idx"))

    @cached_property
    def shift_rows(self) -> DataFrame:
        return G.shift_rows(self.feed)

    @cached_property
    def headers(self) -> DataFrame:
        return G.game_headers(self.feed)

    @cached_property
    def roster(self) -> DataFrame:
        """One row per (player, season); the last game seen wins."""
        r = G.roster_rows(self.feed)
        cols = F.struct("player_name", "position", "number", "team")
        return r.groupBy("player_id", "season").agg(F.max_by(cols, "game_id").alias("r")).select("player_id", "season", "r.*")

    @cached_property
    def bios(self) -> DataFrame:
        return G.bios(self.feed)

    @cached_property
    def shifts(self) -> DataFrame:
        """Merged shifts with the team first seen for the player in the game."""
        return I.merge_intervals(self.shift_rows, ["game_id", "season", "player_id", "team"])

    @cached_property
    def scored_events(self) -> DataFrame:
        return X.with_chance(self.filed_events)

    @cached_property
    def shots(self) -> DataFrame:
        return X.unblocked_shots(self.events)

    @cached_property
    def xg(self) -> DataFrame:
        return self.scored_events.where("xg is not null").select("game_id", "event_idx", "xg")

    @cached_property
    def scored_shots(self) -> DataFrame:
        """Shots with their chance value and, for goals, the assist ids."""
        return X.unblocked_shots(self.scored_events, "xg", "assist1_player_id", "assist2_player_id")

    @cached_property
    def usable_games(self) -> DataFrame:
        """Games that have a shot and whose home team took a shift."""
        with_shot = self.filed_events.where(X.is_unblocked_shot()).select("game_id").distinct()
        rows = self.shift_rows.join(self.headers.select("game_id", "home_team"), "game_id")
        home_seen = rows.where("team = home_team").select("game_id").distinct()
        return self.headers.join(with_shot, "game_id", "left_semi").join(home_seen, "game_id", "left_semi")

    @cached_property
    def game_shifts(self) -> DataFrame:
        """Merged shifts of the two teams of every usable game."""


        def build() -> DataFrame:
            known = I.keep_known_teams(self.shift_rows, self.usable_games)
            return I.merge_intervals(known, ["game_id", "season", "player_id", "team", "home_team"])

        return self._stage("game_shifts", build)

    @cached_property
    def clock(self) -> DataFrame:
        return self._stage("clock", lambda: I.context_clock(self.game_shifts, self.filed_events))

    @cached_property
    def sided_shifts(self) -> DataFrame:
        """Shifts of usable games with the player's side and whether he keeps goal."""
        goalies = self.roster.where("position = 'G'").select("player_id").distinct().withColumn("g", F.lit(True))
        s = self.game_shifts.join(goalies, "player_id", "left")
        return s.select(
            "game_id", "player_id", "start_g", "end_g",
            (F.col("team") == F.col("home_team")).alias("is_home"), F.coalesce("g", F.lit(False)).alias("is_goalie"),
        )

    @cached_property
    def presence(self) -> DataFrame:
        return I.presence(self.sided_shifts, self.clock)

    @cached_property
    def placed_events(self) -> DataFrame:
        return I.attach_stint(self.scored_events, self.clock, "shot")

    @cached_property
    def placed_shots(self) -> DataFrame:
        return I.attach_stint(self.scored_shots, self.clock, "shot")

    @cached_property
    def stints(self) -> DataFrame:
        def build() -> DataFrame:
            volume = I.stint_volume(self.placed_events)
            return I.build_stints(I.stint_context(self.clock), I.staffed(self.sided_shifts, self.clock), volume)

        return self._stage("stints", build)

    @cached_property
    def shots_onice(self) -> DataFrame:
        """Each placed shot with the personnel of its stint and the on-ice match class."""

        def build() -> DataFrame:
            st = self.stints.select(
                "game_id", "stint_idx", "strength", "home_skaters", "away_skaters", "home_goalie", "away_goalie",
                F.col("home_n").alias("st_home_n"), F.col("away_n").alias("st_away_n"),
            )
            sh = self.placed_shots.where("stint_idx is not null")
            sh = sh.withColumnsRenamed({"home_n": "sit_home_n", "away_n": "sit_away_n"})
            return sh.join(st, ["game_id", "stint_idx"]).select(
                "*", S.onice_match("st_home_n", "st_away_n", "sit_home_n", "sit_away_n").alias("onice_match"),
                S.facing_goalie("is_home", "home_goalie", "away_goalie").alias("goalie_id"),
            )

        return self._stage("shots_onice", build)

    @cached_property
    def duels(self) -> DataFrame:
        return G.duels(self.spark, self.folder)
