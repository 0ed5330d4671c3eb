"""VARIANT feeds and time-on-ice reports on small documents, broken ones among them."""

import json

from shiftgrain.sources import rendering as R
from shiftgrain.sources import variants as V
from tests.test_sources import GAME


def lines(spark, *values):
    return V.parsed(spark.createDataFrame([(v, f"f{k}") for k, v in enumerate(values)], "value string, file string"))


def test_broken_documents_and_plays_cost_only_themselves(spark):
    bad_play = json.loads(json.dumps(GAME["plays"][0])) | {"sortOrder": "no number"}
    game = GAME | {"plays": [*GAME["plays"], bad_play, "text", None]}
    docs = lines(spark, json.dumps(game), "{broken", "", "[1, 2]", "17", json.dumps({"id": "x"}), json.dumps(GAME | {"plays": None}))
    (e,) = V.events(docs).collect()
    assert (e.game_id, e.event_idx, e.time_g, e.primary_player_id, e.is_home, e.team) == (2024020001, 5, 1265, 10, True, "AAA")
    assert V.plays(docs).where("item is null").count() == 2
    assert sorted(r.value for r in V.unreadable(docs).collect()) == ["17", "[1, 2]", "{broken"]
    assert [tuple(r) for r in V.spots(lines(spark, json.dumps(game))).collect()] == [(2024020001, "AAA", 9, 10)]
    assert V.events(lines(spark, "{")).count() == 0


def test_shift_entries_without_interval_go(spark):
    row = {"gameId": 2024020001, "playerId": 7, "firstName": "A", "lastName": "B", "teamAbbrev": "AAA", "period": 2, "startTime": "00:10", "endTime": "00:50", "duration": "00:40"}
    doc = {"data": [row, row | {"duration": ""}, row | {"endTime": None}, row | {"endTime": "00:10"}, row | {"period": "two"}]}
    assert [(r.player_id, r.start_g, r.end_g, r.player_name) for r in V.shifts(lines(spark, json.dumps(doc), "x")).collect()] == [(7, 1210, 1250, "A B")]


def test_first_readable_player_file_counts(spark, tmp_path):
    for name, text in (("a", "{broken"), ("b", json.dumps({"playerId": 7, "firstName": {"default": "A"}, "birthDate": "1999-01-02", "shootsCatches": "L"})), ("c", json.dumps({"playerId": 7})), ("d", json.dumps({"x": 1}))):
        (tmp_path / f"{name}.json").write_text(text)
    docs = V.read_documents(spark, str(tmp_path), whole_files=True)
    assert [(r.player_id, r.name, str(r.birthdate), r.hand) for r in V.players(docs).collect()] == [(7, "A", "1999-01-02", "L")]
    assert V.unreadable(docs).count() == 1


def td(kind, text, quote='"'):
    return f"<td align=center class={quote}{kind}{quote}>{text}</td>"


def test_report_rules(spark):
    entries = lambda *cells: "".join(td(V.ENTRY, c, "'" if k % 2 else '"') for k, c in enumerate(cells))
    html = (
        td("title", "99 NOBODY") + entries("1", "1", "00:00 / 0:00", "01:00 / 0:00", "01:00")  # no player is open yet
        + td(V.HEADING, " 9 <b>OX</b>, AL&amp;", "'") + entries("1", "1", "<i>00:10</i> / 19:50", "00:55 / 19:05", "00:45")
        + "<td class=spacer>skip</td>" + entries("2", "OT", "00:00 / 5:00", "&nbsp;", "00:30") + entries("3", "SO", "00:00 / 5:00", "00:30 / 4:30", "00:30")
        + entries("4", "2", "bad", "00:30 / 4:30", "00:30") + entries("5", "2", "00:30 / 1:00", "00:30 / 1:00", "00:00") + entries("6", "3", "00:05 / 1:00")
        + td(V.HEADING, "12 ELK, BO") + entries("1", "3", "00:00 / 20:00", "00:20 / 19:40", "00:20") + td(V.HEADING, "no number") + entries("1", "1", "00:00 / 0:00", "01:00 / 0:00", "01:00")
        + td(V.HEADING, "44 UNKNOWN, X") + entries("1", "1", "00:00 / 0:00", "01:00 / 0:00", "01:00")
    )
    pages = spark.createDataFrame([(1, "AAA", html), (2, "AAA", html), (3, "AAA", None), (3, "BBB", "")], "game_id long, team string, html string")
    sweaters = spark.createDataFrame([(1, "AAA", 9, 100), (1, "AAA", 12, 120), (2, "AAA", 9, 200), (1, "BBB", 9, 900)], "game_id long, team string, number int, player_id long")
    got = sorted((r.game_id, r.player_id, r.period, r.start_g, r.end_g) for r in V.report_shifts(pages, sweaters).collect())
    assert got == [(1, 100, 1, 10, 55), (1, 100, 4, 3600, 3630), (1, 120, 3, 2400, 2420), (2, 200, 1, 10, 55), (2, 200, 4, 3600, 3630)]
    headings = spark.createDataFrame([(html,)], "html string").select(V.report_entries("html").alias("e")).first()["e"]
    assert {(e.number, e.heading) for e in headings} == {(9, "OX, AL&"), (12, "ELK, BO"), (44, "UNKNOWN, X")}


def test_big_games_become_many_documents(spark, monkeypatch):
    monkeypatch.setattr(R, "PAGE", 10)
    rows = spark.range(95).selectExpr("2024020001 AS game_id", "id AS player_id", "'AAA' AS team", "1 AS period", "CAST(id AS int) AS start_g", "CAST(id + 5 AS int) AS end_g")
    docs = R.shift_documents(rows)
    assert 5 < docs.count() <= 10
    assert V.shifts(V.parsed(docs.withColumnRenamed("page", "file"))).count() == 95
