"""The bootstrap gate against plain numpy."""

import numpy as np

from shiftgrain.models import holdout as HO


def test_weights_are_poisson_and_depend_on_player_and_draw():
    w = HO.resample_weights(np.arange(400), 500)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    assert abs((w == 0).mean() - np.exp(-1)) < 0.01 and w.max() >= 6
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.02 and abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.02
    assert (HO.resample_weights(np.array([7]), 500) == w[7]).all()


def frame(spark, seed, n=120, noise=0.2):
    rng = np.random.default_rng(seed)
    y = rng.normal(0, 1, n)
    rows = [(k, float(v + rng.normal(0, noise)), float(v + rng.normal(0, 3)), float(v), float(1 + k % 5)) for k, v in enumerate(y)]
    return spark.createDataFrame([*rows, (1000, None, 1.0, 1.0, 1.0)], "player_id long, a double, b double, y double, w double"), np.array(rows)


def test_gate_equals_numpy_in_any_number_of_tasks(spark):
    df, rows = frame(spark, 1)
    ids, a, b, y, w = rows.T
    gains = []
    for draw in HO.resample_weights(ids.astype(int), 300).T:
        v = draw * w
        corr = lambda x: np.cov(x, y, aweights=v)[0, 1] / np.sqrt(np.cov(x, aweights=v) * np.cov(y, aweights=v))
        gains.append(corr(a) - corr(b))
    for parts in (1, 6):
        (got,) = HO.paired_bootstrap(df.repartition(parts), "a", "b", "y", "w", 300).collect()
        assert got.draws == 300 and abs(got.mean_gain - np.mean(gains)) < 1e-9 and got.p_better == np.mean(np.array(gains) > 0)
        assert abs(got.low - np.percentile(gains, 5)) < 1e-9 and abs(got.high - np.percentile(gains, 95)) < 1e-9
        assert got.verdict == "PASS" and got.own_corr > 0.9


def test_a_worse_candidate_fails(spark):
    df, _ = frame(spark, 2)
    assert HO.paired_bootstrap(df, "b", "a", "y", "w", 200).first().verdict == "FAIL"
    assert HO.paired_bootstrap(df.limit(0), "a", "b", "y", "w", 50).first().draws == 0
