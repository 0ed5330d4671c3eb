"""Registered fits and streams do the whole job: all seasons, full size, and a sign of convergence."""

from types import SimpleNamespace

import numpy as np

from shiftgrain.models import blockfit as BF
from shiftgrain.models import chance as CH
from shiftgrain.models import gram as GM
from shiftgrain.plans import q_chance, q_models, q_rows, q_stream
from shiftgrain.sources.landing import write_season_table


def test_stream_scores_every_landed_season(spark, monkeypatch):
    """ST3 takes the fit of default size and scores each season of the landed table."""
    events = spark.createDataFrame([(1, 2021), (2, 2022), (3, 2023), (4, 2024), (5, 2026)], "game_id long, season int")
    asked = {}

    def fit(features, name, **kw):
        asked["size"] = kw
        return None, None

    def score(table, out, bios, model, seasons):
        asked["seasons"] = seasons
        write_season_table(spark.read.parquet(table).selectExpr("game_id", "season", "0.1D AS xg"), out)

    monkeypatch.setattr(q_stream, "saved_fit", fit)
    monkeypatch.setattr(q_stream, "input_signature", lambda *a: "x")
    monkeypatch.setattr(q_stream, "chance_features", lambda e, b: e)
    monkeypatch.setattr(q_stream.ST, "score_seasons", score)
    got = {r["season"]: r["n"] for r in q_stream.st3(SimpleNamespace(spark=spark, folder="", events=events, bios=None)).collect()}
    assert asked == {"size": {}, "seasons": [2021, 2022, 2023, 2024, 2026]} and got == dict.fromkeys(asked["seasons"], 1)


def test_minimiser_says_whether_it_converged():
    def bowl(x):
        h = np.array([1.0, 50.0, 400.0])
        return float(np.sum(np.cosh(x) * h)), np.sinh(x) * h, np.ones(3)

    start = np.array([3.0, -2.0, 1.0])
    assert BF.minimise(bowl, start, max_iter=2)[1]["converged"] is False
    assert BF.minimise(bowl, start)[1]["converged"] is True


def test_assist_anchor_and_tweedie_run_in_full(spark, monkeypatch):
    """M22 sets no step limit and reports convergence; M10 tries the whole penalty grid."""
    asked = {}

    def count_fit(t, **kw):
        asked["count"] = kw
        return SimpleNamespace(info={"psi0": 0.1, "q": 0.2, "iterations": 3, "converged": False})

    def tweedie(rows, mults, **kw):
        asked["mults"] = mults

    monkeypatch.setattr(q_rows, "count_fit", count_fit)
    got = q_rows.m22(SimpleNamespace(spark=spark))
    assert asked["count"] == {} and {r["converged"] for r in got.collect()} == {False}
    monkeypatch.setattr(q_models, "_design", lambda t: None)
    for name in ("lineups", "role_minutes", "impact_table"):
        monkeypatch.setattr(q_models.GM, name, lambda *a: None)
    monkeypatch.setattr(q_models.GM, "fit_tweedie", tweedie)
    q_models.m10(SimpleNamespace(spark=spark))
    assert tuple(asked["mults"]) == q_models.GM.LAMBDA_MULTS


def test_influence_of_dependent_free_columns():
    B = np.array([[4.0, 2.0, 2.0], [2.0, 2.0, 2.0], [2.0, 2.0, 2.0]])
    found = GM.Influence.of(B, B + np.diag([1.0, 0.0, 0.0]))
    assert np.isfinite(found.parameters) and np.isfinite(found.spread).all()


def test_chance_fit_is_registered_at_full_size(monkeypatch):
    asked = {}
    monkeypatch.setattr(q_chance.X, "chance_features", lambda e, b: None)
    monkeypatch.setattr(q_chance, "input_signature", lambda *a: "x")
    monkeypatch.setattr(q_chance, "saved_fit", lambda features, name, **kw: asked.update(kw))
    q_chance._fit(SimpleNamespace(spark=None, folder="", events=None, bios=None))
    assert asked == {} and (CH.TREES, CH.DEPTH, CH.STEP, CH.FOLDS, CH.PATIENCE) == (4000, 6, 0.04, 5, 50)
