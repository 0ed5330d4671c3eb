"""Readers, season tables, landing and checks on temporary folders."""

import json

from pyspark.sql import functions as F

from shiftgrain.operators import checks as K
from shiftgrain.sources import documents as DOC
from shiftgrain.sources import landing as L
from shiftgrain.streaming import incremental as ST

GAME = {
    "id": 2024020001, "gameDate": "2024-10-04", "gameType": 2, "homeTeam": {"id": 1, "abbrev": "AAA", "score": 1}, "awayTeam": {"id": 2, "abbrev": "BBB", "score": 0}, "venue": {"default": "Old Hall"},
    "rosterSpots": [{"playerId": 10, "teamId": 1, "firstName": {"default": "Al"}, "lastName": {"default": "Ox"}, "positionCode": "C", "sweaterNumber": 9}],
    "plays": [
        {"sortOrder": 5, "typeDescKey": "goal", "timeInPeriod": "01:05", "situationCode": "1551", "homeTeamDefendingSide": "left", "periodDescriptor": {"number": 2, "periodType": "REG"}, "details": {"eventOwnerTeamId": 1, "scoringPlayerId": 10, "xCoord": 60, "yCoord": 3}},
        {"sortOrder": 6, "typeDescKey": "stoppage", "timeInPeriod": "", "periodDescriptor": {"number": 2}},
    ],
}


def test_game_json(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(GAME))
    g = L.read_games(spark, str(tmp_path))
    e = L.game_events(g).collect()
    assert len(e) == 1 and (e[0].time_g, e[0].primary_player_id, e[0].is_home, e[0].team) == (1265, 10, True, "AAA")
    r = L.game_roster(g).first()
    assert (r.player_id, r.season, r.player_name, r.team) == (10, 2024, "Al Ox", "AAA")


def test_season_overwrite_is_idempotent_and_partial(spark, tmp_path):
    p = str(tmp_path / "t")
    L.write_season_table(spark.createDataFrame([(1, 2023), (2, 2024)], "v int, season int"), p)
    for _ in range(2):
        L.write_season_table(spark.createDataFrame([(9, 2024)], "v int, season int"), p)
    assert sorted((r.v, r.season) for r in spark.read.parquet(p).collect()) == [(9, 2024), (1, 2023)] or sorted(r.v for r in spark.read.parquet(p).collect()) == [1, 9]


def test_season_files_do_not_grow_with_tasks(spark, tmp_path):
    L.write_season_table(spark.range(4000).repartition(40).selectExpr("id", "CAST(2020 + id % 4 AS int) AS season"), str(tmp_path / "t"))
    files = list((tmp_path / "t").glob("season=*/*.parquet"))
    assert len(files) <= 8 and spark.read.parquet(str(tmp_path / "t")).count() == 4000


def test_read_or_build_reuses_fresh_table(spark, tmp_path):
    src, out, calls = tmp_path / "in", str(tmp_path / "out"), []
    spark.range(3).write.parquet(str(src))

    def build():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "x")

    for _ in range(2):
        assert L.read_or_build(spark, [str(src)], out, ["x"], build).count() == 5
    assert len(calls) == 1


def test_late_version_replaces_earlier(spark, tmp_path):
    p, sch = str(tmp_path / "t"), "game_id long, v string, season int, version int"
    ST.upsert_games(spark.createDataFrame([(1, "old", 2024, 1), (2, "keep", 2023, 1)], sch), p)
    ST.upsert_games(spark.createDataFrame([(1, "new", 2024, 3)], sch), p)
    ST.upsert_games(spark.createDataFrame([(1, "stale", 2024, 2)], sch), p)
    assert sorted((r.game_id, r.v) for r in spark.read.parquet(p).collect()) == [(1, "new"), (2, "keep")]


def test_strict_json(spark):
    df = spark.createDataFrame([(1, float("nan"), [float("inf"), 2.0])], "k int, a double, b array<double>")
    doc = json.loads(DOC.as_json(df, "k").first().doc)
    assert "a" not in doc and doc["b"] == [None, 2.0]


def test_checks_pass_clean_and_fail_perturbed(spark):
    rows = [(1, 0, 0, 10, 10, [1], [2], 1, 1, "1v1", False), (1, 1, 10, 25, 15, [1], [2], 1, 1, "1v1", False)]
    sch = "game_id long, stint_idx int, start_g int, end_g int, duration_s int, home_skaters array<bigint>, away_skaters array<bigint>, home_n int, away_n int, strength string, overload boolean"
    ok = {r.name: r.status for r in K.check_stints(spark.createDataFrame(rows, sch)).collect()}
    assert set(ok.values()) == {"pass"}
    bad = [rows[0], (1, 1, 12, 25, 15, [1], [2], 2, 1, "1v1", True)]
    st = {r.name: r.status for r in K.check_stints(spark.createDataFrame(bad, sch)).collect()}
    assert st["duration"] == st["no gap or overlap"] == st["counts match personnel"] == st["strength label"] == "fail"
    assert st["overload rate"] == "warn"
    assert {r.status for r in K.check_stints(spark.createDataFrame([], sch)).collect()} == {"skip"}
