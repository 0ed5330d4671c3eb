"""Boosted trees over Spark against plain numpy, and the chance model on its real path."""

import numpy as np
import pytest

from shiftgrain.models import boosting as B
from shiftgrain.models import chance as CH


def shots(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        f = {c: float(rng.integers(0, 8)) for c in CH.NUMERIC}
        f["distance"] = float(rng.random() * 60)
        f["off_wing"] = None if rng.random() < 0.3 else float(rng.integers(0, 2))
        kind = str(rng.choice(["wrist", "slap", "tip-in"]))
        p = B.sigmoid(1.0 - f["distance"] / 12 + (1.5 if kind == "tip-in" else 0) + (0.8 if f["off_wing"] is None else 0))
        rows.append((int(k // 10), k % 10, 2021 + k % 3, int(rng.random() < p), *[f[c] for c in CH.NUMERIC], kind, "O", "none" if k % 4 else None))
    return rows


SCHEMA = "game_id long, event_idx long, season int, goal int, " + ", ".join(f"{c} double" for c in CH.NUMERIC) + ", shot_type string, zone string, last_event_type string"


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(shots(), SCHEMA).repartition(4)


def brute_split(rows, grad, curv, categorical, f):
    """The best gain of a cut of feature f, missing values on either side, or of any set of categories."""
    score = lambda m: grad[m].sum() ** 2 / (curv[m].sum() + B.PENALTY)
    whole, best = score(np.ones(len(rows), bool)), -np.inf
    levels = np.unique(rows[:, f])
    sets = [set(levels[[i for i in range(len(levels)) if code >> i & 1]]) for code in range(1, 2 ** len(levels) - 1)] if categorical else [
        set(levels[(levels <= c) & (levels > 0)]) | ({0} if zero else set()) for c in levels for zero in (0, 1)
    ]
    for left in sets:
        m = np.isin(rows[:, f], list(left))
        if curv[m].sum() >= B.MIN_CURVATURE and curv[~m].sum() >= B.MIN_CURVATURE:
            best = max(best, score(m) + score(~m) - whole)
    return best


def test_splits_equal_an_exhaustive_search():
    rng = np.random.default_rng(5)
    for _ in range(10):
        bins = np.c_[rng.integers(0, 9, (200, 2)), rng.integers(0, 6, (200, 1))].astype(np.uint8)
        label, raw = rng.integers(0, 2, 200).astype(np.uint8), rng.standard_normal(200)
        p = B.sigmoid(raw)
        sums = B._histogram(bins, label, raw, np.zeros(200, np.int64), [0], 3)
        want = [brute_split(bins, p - label, p * (1 - p), f == 2, f) for f in range(3)]
        (found,) = B.best_splits(sums, 1, np.ones(3, bool))
        assert abs(found[2] - max(want)) < 1e-9 and found[0] == int(np.argmax(want))
        for f in range(3):
            (one,) = B.best_splits(sums, 1, np.arange(3) == f)
            assert abs((one[2] if one else -np.inf) - want[f]) < 1e-9 or (one is None and want[f] <= 1e-9)


def grown(features, rounds=6, depth=3):
    data = CH.with_fold(features, 3)
    binning = B.Binning.of(data, CH.NUMERIC, CH.CATEGORICAL)
    rows = data.selectExpr("*", "goal AS label", "xxhash64(game_id, event_idx) AS key")
    model = B.Boosting(rows, binning, [0, 1, 2], depth, 0.3)
    return model, model.grow(rounds, 50)


def test_tasks_levels_and_rewrites_change_nothing(features, monkeypatch):
    first, best = grown(features)
    monkeypatch.setattr(B, "TASK_ROWS", 400)
    monkeypatch.setattr(B, "FAN", 1)
    monkeypatch.setattr(B, "WRITE_EVERY", 2)
    second, again = grown(features)
    assert best == again and second.tasks > 1
    for a, b in zip(first.members, second.members):
        assert np.allclose(a.losses, b.losses) and len(a.trees) == len(b.trees) == 6
        for x, y in zip(a.trees, b.trees):
            assert (x.feature == y.feature).all() and (x.left == y.left).all() and np.allclose(x.value, y.value)


def test_growth_stops_after_patience_and_keeps_the_best_prefix(features, monkeypatch):
    model, _ = grown(features, rounds=2)
    curve = [9.0, 5, 4, 6, 3, 7, 8, 9, 9, 9, 9, 9]

    def turn(self, k, last):
        for m in self.members[:-1]:
            if m.growing:
                m.losses.append(curve[k])
        return [B.Tree(1) if m.growing else None for m in self.members]

    for m in model.members:
        m.trees, m.losses, m.growing = [], [], True
    monkeypatch.setattr(B.Boosting, "_round", turn)
    assert model.grow(11, 3) == 4
    assert [m.best for m in model.members[:-1]] == [4, 4, 4] and len(model.members[0].losses) == 8


def test_chance_model_learns_calibrates_and_comes_back_from_disk(spark, features, tmp_path):
    model, oof = CH.ChanceModel.fit(features, trees=25, depth=4, step=0.3, patience=8)
    rows = oof.collect()
    goals = sum(r["goal"] for r in rows)
    assert len(rows) == 1500 and abs(sum(r["xg"] for r in rows) - goals) < 1e-6
    rate = goals / len(rows)
    loss = lambda p: -np.mean([np.log(max(q, 1e-9)) if r["goal"] else np.log(max(1 - q, 1e-9)) for q, r in zip(p, rows)])
    assert loss([r["raw"] for r in rows]) < loss([rate] * len(rows)) - 0.05
    assert all(1 <= k <= 25 for k in model.rounds) and len(model.trees) == max(1, round(sum(model.rounds) / 5))
    assert model.importances()[0][0] in ("distance", "shot_type") and abs(sum(v for _, v in model.importances()) - 1) < 1e-9
    model.save(spark, str(tmp_path / "m"))
    again = CH.ChanceModel.load(spark, str(tmp_path / "m"))
    score = lambda m, df: {(r["game_id"], r["event_idx"]): r["xg"] for r in m.transform(df).collect()}
    want = score(model, features)
    assert score(again, features.repartition(3)) == want
    odd = score(again, features.selectExpr("* EXCEPT (shot_type, distance)", "'new' AS shot_type", "CAST(NULL AS double) AS distance"))
    assert odd.keys() == want.keys() and all(0 <= v <= 1 for v in odd.values())


def test_saved_fit_is_fitted_once(spark, features, monkeypatch):
    calls = []
    real = CH.ChanceModel.fit.__func__

    def fit(cls, *a, **kw):
        calls.append(1)
        return real(cls, *a, **kw)

    monkeypatch.setattr(CH.ChanceModel, "fit", classmethod(fit))
    size = {"trees": 2, "depth": 2, "step": 0.3}
    first = CH.saved_fit(features, "test-once", **size)
    second = CH.saved_fit(features, "test-once", **size)
    assert calls == [1] and first[0].curve == second[0].curve and second[1].count() == 1500


def test_signature_follows_the_files(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a"))
    one = CH.input_signature(spark, [str(tmp_path / "a")])
    assert one == CH.input_signature(spark, [str(tmp_path / "a")])
    spark.range(6).write.mode("overwrite").parquet(str(tmp_path / "a"))
    assert one != CH.input_signature(spark, [str(tmp_path / "a")])


def test_fit_of_one_class_and_missing_columns(spark):
    rows = [(k // 3, k % 3, 2021, 0, *[None] * len(CH.NUMERIC), None, None, None) for k in range(30)]
    model, oof = CH.ChanceModel.fit(spark.createDataFrame(rows, SCHEMA), trees=3, depth=2)
    assert all(r["xg"] < 1e-3 for r in oof.collect()) and model.importances() == []


def test_only_splits_reach_the_driver(features, monkeypatch):
    """What a pass sends to the driver has the size of splits, not of the sums of bins."""
    sent = []
    monkeypatch.setattr(B, "FAN", 2)
    model, _ = grown(features, 1)
    collect = type(model.blocks).collect

    def counted(df):
        rows = collect(df)
        sent.extend(len(r["body"]) for r in rows if "body" in r)
        return rows

    monkeypatch.setattr(type(model.blocks), "collect", counted)
    model._round(1, last=False)
    assert sent and max(sent) <= 8 * (8 + B.BINS)


def test_a_round_brings_scores_up_to_date_once_for_all_its_passes(features):
    model, _ = grown(features, 3)
    assert model._stored is None and [len(p) for p in model._pending] == [3] * 4
    model._round(3, last=False)
    assert model._stored.is_cached and not any(model._late)
    opened, rows = B._opened(len(model.binning.names), [[] for _ in model.members]), 0
    for block in model._stored.collect():
        bins, label, _, _, raw = opened(block)
        rows += len(label)
        for k, m in enumerate(model.members):
            assert np.allclose(raw[:, k], model.base + sum(t.predict(bins) for t in m.trees))
    assert rows == 1500


def test_nodes_do_not_depend_on_the_layout_of_bins():
    rng = np.random.default_rng(2)
    bins, tree = rng.integers(0, B.BINS, (300, 5)).astype(np.uint8), B.Tree(4)
    for node in (0, 1, 2, 4, 5, 9):
        tree.feature[node], tree.left[node] = rng.integers(0, 5), rng.random(B.BINS) < 0.5
    want = []
    for row in bins:
        node = 0
        for _ in range(4):
            f = tree.feature[node]
            node = node if f < 0 else 2 * node + (1 if tree.left[node, row[f]] else 2)
        want.append(node)
    some = np.arange(0, 300, 7)
    wide = np.repeat(bins, 2, 0)[::2]
    for b in (bins, np.asfortranarray(bins), wide, wide.T.copy().T):
        assert tree.nodes(b).tolist() == want and tree.nodes(b, None, some).tolist() == [want[k] for k in some]
    assert tree.nodes(bins[:1]).tolist() == want[:1] and tree.nodes(bins[:0]).tolist() == []
