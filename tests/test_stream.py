"""Deliveries through keyed state: what arrives late and old is dropped, in any order of arrival."""

from types import SimpleNamespace

import pandas as pd
import pytest

from shiftgrain.streaming import incremental as ST

SCHEMA = "season int, game_id long, event_id long, v string, version long"


def deliveries():
    new = [(2024, g, e, f"new{g}.{e}", 3) for g in (1, 2) for e in range(40)]
    mid = [(2024 - g % 2, g, e, f"mid{g}.{e}", 2) for g in (1, 2, 3) for e in range(50)]
    old = [(2024 - g % 2, g, e, f"old{g}.{e}", 1) for g in (1, 2, 3, 4) for e in range(60)]
    return [new, mid, old]


def land(spark, tmp_path, order, parts=1):
    for k, rows in enumerate(order):
        spark.createDataFrame(rows, SCHEMA).coalesce(parts).write.mode("append").parquet(str(tmp_path / "inbox"))
        ST.start_landing(ST.delivery_stream(spark, str(tmp_path / "inbox"), spark.createDataFrame([], SCHEMA).schema), str(tmp_path / "t"), str(tmp_path / "p")).awaitTermination()
    return sorted((r.game_id, r.event_id, r.v, r.version) for r in spark.read.parquet(str(tmp_path / "t")).where("version is not null").collect())


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_newest_version_stays_whatever_comes_last(spark, tmp_path, order):
    """The three deliveries in several orders; a repaired game keeps its season here."""
    d = [[(2024, *r[1:]) for r in rows] for rows in deliveries()]
    got = land(spark, tmp_path, [d[k] for k in order])
    want = sorted([(g, e, f"new{g}.{e}", 3) for g in (1, 2) for e in range(40)] + [(3, e, f"mid3.{e}", 2) for e in range(50)] + [(4, e, f"old4.{e}", 1) for e in range(60)])
    assert got == want


def test_state_drops_old_rows_before_the_table(spark, tmp_path):
    """A delivery that is older than what its parts have seen reaches no batch."""
    sizes = []
    d = [[(2024, *r[1:]) for r in rows if r[1] == 1] for rows in deliveries()]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for rows in (d[0] * 40, d[2]):
        spark.createDataFrame([(s, g, e + 1000 * k, v, n) for k, (s, g, e, v, n) in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
        stream = ST.delivery_stream(spark, str(tmp_path / "inbox"), spark.createDataFrame([], SCHEMA).schema)
        ST.newest_in_stream(stream, "game_id", "version").writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
    assert [n for n in sizes if n] == [1600]


def test_upsert_of_a_repeated_batch_is_the_same_first_and_second(spark, tmp_path):
    rows = [(2024, 1, 1, "a", 1)] * 3 + [(2024, 1, 2, "b", 1)]
    for _ in range(2):
        ST.upsert_games(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_one_key_serves_many_games_in_one_call():
    """A batch reads and writes a key's state once, however many games it has; a null game is a game."""

    class Held:
        value, calls = None, []

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    held = Held()
    p = ST.NewestVersion("version", ["game", "version", "state_game"])
    p.init(SimpleNamespace(getValueState=lambda *a: held))
    frame = lambda rows: pd.DataFrame([(g, v, "" if g is None else f"={g}") for g, v in rows], columns=["game", "version", "state_game"])
    take = lambda rows: [list(zip(f["state_game"], f["version"])) for f in p.handleInputRows((0, 0), iter([frame(rows)]), None)]
    games = [(g, 2) for g in range(300)]
    assert len(take([*games, (None, 5)])[0]) == 301
    assert take([(0, 1), (1, 3), (7, 2), (None, 4), (None, 6), (400, 1)]) == [[("=1", 3), ("=7", 2), ("", 6), ("=400", 1)]]
    assert held.calls == ["update", "get", "update"]
