"""The ridge by blocks against the dense one, on players that fall into groups of their own."""

import numpy as np
from pyspark.sql import functions as F

from shiftgrain.models import blocks as BL
from shiftgrain.models import gram as GM


def apart(spark, n=300, seed=5):
    """Three groups of players that share only the intercept and a covariate; one row has no player at all."""
    rng = np.random.default_rng(seed)
    rows = [(0, [-1], 1.0, 20.0)]
    for i in range(n):
        pl = rng.choice(7, 4, replace=False) + 50 * (i % 3)
        cols = sorted([int(pl[0]) * 2, int(pl[1]) * 2, int(pl[2]) * 2 + 1, int(pl[3]) * 2 + 1, -1] + ([-2] if rng.random() < 0.5 else []))
        rows.append((i % 7, cols, float(rng.exponential(2.0)) if rng.random() > 0.3 else 0.0, float(rng.integers(10, 60))))
    return spark.createDataFrame(rows, "game_id long, cols array<bigint>, y double, w double").withColumn("fold", (F.col("game_id") % 3).cast("int"))


def test_blocks_are_what_line_ups_connect(spark):
    rows = spark.createDataFrame([([-1, 2, 8],), ([8, 11],), ([11, 30],), ([-1, 4, 6],), ([40],), ([-1],)], "cols array<bigint>")
    got = {r.code: r.block for r in BL.player_blocks(rows).collect()}
    assert got == {2: 2, 8: 2, 11: 2, 30: 2, 4: 4, 6: 4, 40: 40}


def test_ridge_by_blocks_equals_the_dense_one(spark):
    rows = GM.lineups(apart(spark))
    dense = GM.fit_ridge(rows, mults=(0.1, 1.0, 10.0), folds=3)
    fit = GM.fit_ridge_by_blocks(rows, mults=(0.1, 1.0, 10.0), folds=3)
    for a, b in zip(dense.sweep, fit.sweep):
        assert all(abs(a[k] - b[k]) < 1e-7 * max(1.0, abs(a[k])) for k in a)
    for k, v in dense.meta.items():
        assert v == fit.meta[k] if isinstance(v, (str, bool)) else abs(v - fit.meta[k]) < 1e-6 * max(1.0, abs(v)), k
    got = {r.code: r for r in fit.coef.collect()}
    players = [k for k, c in enumerate(dense.codes) if c >= 0]
    assert len(got) == len(players)
    for k in players:
        r = got[int(dense.codes[k])]
        assert abs(r.b - dense.beta[k]) < 1e-8 and abs(r.s - dense.se[k]) < 1e-8


def test_sweep_and_impacts_beyond_the_driver_limit(spark):
    """Above the limit the sweep was an error and standard errors were null."""
    d = apart(spark).withColumn("fold", F.col("fold").cast("int"))
    a, b = (GM.fit_ridge_any(d, (0.1, 1.0), limit=x).sweep for x in (100, 5))
    assert all(abs(x[k] - y[k]) < 1e-7 for x, y in zip(a, b) for k in x)
    a, b = (GM.fit_impacts(d, "off", "def", (0.1, 1.0), limit=x).toPandas().set_index("player_id").sort_index() for x in (100, 5))
    assert np.allclose(a, b[a.columns], atol=1e-7, equal_nan=True) and b["off_se"].notna().any()
    assert GM.fit_ridge_by_blocks(GM.lineups(d), (1.0,), most=5) is None


def test_tweedie_by_blocks_equals_the_dense_one(spark):
    """Above the limit the Tweedie fit was an error; both end within the tolerance of the same optimum."""
    rows = GM.lineups(apart(spark, n=120))
    dense = GM.fit_tweedie(rows, mults=(0.1, 1.0), folds=3, tol=1e-9)
    fit = GM.fit_tweedie_by_blocks(rows, mults=(0.1, 1.0), folds=3, tol=1e-9)
    for a, b in zip(dense.sweep, fit.sweep):
        assert all(abs(a[k] - b[k]) < 1e-5 * max(1.0, abs(a[k])) for k in a if k != "iters")
    for k in ("lambda", "edf", "dispersion", "baseline_xgf60", "n_obs", "n_params"):
        assert abs(dense.meta[k] - fit.meta[k]) < 1e-5 * max(1.0, abs(dense.meta[k])), k
    got = {r.code: r for r in fit.coef.collect()}
    for k, c in enumerate(dense.codes):
        if c >= 0:
            assert abs(got[int(c)].b - dense.beta[k]) < 1e-4 and abs(got[int(c)].s - dense.se[k]) < 1e-4
    assert GM.fit_tweedie_by_blocks(rows, (1.0,), most=5) is None
