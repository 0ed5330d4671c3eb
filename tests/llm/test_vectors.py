"""Whitening and centroid clustering against plain numpy and Python."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from shiftgrain.llm import centroid_clusters as C
from shiftgrain.llm import partials as P
from shiftgrain.llm import whitening as W


@pytest.mark.parametrize("m", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["random", "equal", "steep", "twofold", "close"])
def test_eigen_by_polar_splits(m, kind):
    rng = np.random.default_rng(m)
    spectrum = {
        "random": rng.random(m) * 100, "equal": np.ones(m), "steep": np.logspace(0, -14, m),
        "twofold": np.r_[np.zeros(m // 2), np.ones(m - m // 2)], "close": 1 + 1e-13 * rng.random(m),
    }[kind]
    q = np.linalg.qr(rng.standard_normal((m, m)))[0]
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    values, vectors = W.eigen(a)
    size = max(1.0, np.abs(a).sum())
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * size
    assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * size


def test_polar_factor_is_the_sign_of_the_spectrum():
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((6, 6)))[0]
    for spectrum in ([5, 1, 1e-9, -1e-9, -1, -5], [3, 3, 3, 3, 3, 3]):
        sign = (q * np.sign(spectrum)) @ q.T
        assert np.abs(W.polar((q * np.array(spectrum)) @ q.T) - sign).max() < 1e-6


def vectors(n, dims, seed, scale=0.2):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, dims)) * np.linspace(2, 0.2, dims) * scale).astype(np.float32)
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    bad = [(900, None), (901, []), (902, [None] + [0.0] * (dims - 1)), (903, [math.nan] * dims), (904, [math.inf] * dims), (905, [1.0] * (dims - 1))]
    return rows + [(None, rows[0][1]), (5, rows[5][1]), (5, rows[6][1])] + bad, bad


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, x int, `far.v` string")


@pytest.mark.parametrize("fan", [32, 2])
def test_whitening_equals_numpy(spark, monkeypatch, fan):
    monkeypatch.setattr(P, "FAN", fan)
    rows, bad = vectors(300, 12, 4)
    kept = [r for r in rows if r not in bad and not (r[1] and any(math.isnan(v) for v in r[1]))]
    x = np.array([[math.floor(64 * np.float64(v)) + 1_000_000 for v in r[1]] for r in kept])
    n, z = len(x), x - x.mean(0)
    values, comps = np.linalg.eigh(np.cov(x.T, bias=True))
    values, comps = values[::-1], comps[:, ::-1]
    want = z @ comps / np.sqrt(values)
    got = W.whitened_components(frame(spark, rows).repartition(7), "vec_id", "embedding", 9).collect()
    assert len(got) == n * 9 and {r["n"] for r in got} == {n}
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() < 1e-10
    sums = [int(s) for s in x.sum(0)]
    deviation = {}
    for (i, _), row in zip(kept, x.tolist()):
        deviation.setdefault(i, []).append(sum((n * v - s) ** 2 for v, s in zip(row, sums)))
    by_id = {}
    for r in got:
        assert int(r["deviation"]) in deviation[r["vec_id"]]
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12
        by_id.setdefault((r["vec_id"], r["component"]), []).append(r["whitened"])
    for c in range(9):
        sign = None
        for k, (i, _) in enumerate(kept):
            if i in (None, 5) or i == 0:
                continue
            v = by_id[i, c + 1][0]
            sign = sign or (1 if v * want[k, c] > 0 else -1)
            assert abs(v - sign * want[k, c]) < 1e-9


def test_deviations_beyond_a_word_are_exact():
    x = np.array([[1 << 40, 5], [-(1 << 40), 6], [7, 8]], np.int64)
    sums = [int(s) for s in x.sum(0)]
    model = W.Whitening(3, sums, np.empty(0), np.empty((2, 0)), 0.0)
    assert model.deviations(x) == [sum((3 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert model.deviations(x[2:] % 100) == [sum((3 * int(v) - s) ** 2 for v, s in zip(x[2], sums))]


def test_whitening_without_variance_or_rows(spark):
    assert W.whitened_components(frame(spark, [(1, None)]), "vec_id", "embedding").collect() == []
    assert W.whitened_components(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])]), "vec_id", "embedding").collect() == []
    got = W.whitened_components(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 2.0]), (3, [1e30, math.inf]), (4, [1.0, 2.0, 3.0])]), "vec_id", "embedding").collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), int(r["deviation"])) for r in got) == [(1, 1, 1.0, 4096), (2, 1, 1.0, 4096)]
    huge = W.whitened_components(frame(spark, [(1, [1e30]), (2, [-1e30])]), "vec_id", "embedding").collect()
    assert [round(abs(r["whitened"]), 6) for r in huge] == [1.0, 1.0]


def naive_clusters(rows, count, rounds, seed, dims):
    kept = [(i, [max(-C.EDGE, min(C.EDGE, math.floor(256 * np.float64(v)))) for v in x]) for i, x in rows
            if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    name = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    centers = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:count]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    assign = lambda: [min((far(v, c), k) for k, c in enumerate(centers)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for k in range(len(centers)):
            mine = [v for (_, v), (_, c) in zip(kept, at) if c == k]
            if mine:
                centers[k] = [math.floor(Fraction(sum(x), len(mine))) for x in zip(*mine)]
    return [(i, c, d) for (i, _), (d, c) in zip(kept, assign())], centers


@pytest.mark.parametrize("count,rounds", [(7, 3), (400, 2), (1, 1), (40, 5)])
def test_clusters_equal_plain_python(spark, monkeypatch, count, rounds):
    monkeypatch.setattr(P, "FAN", 2)
    monkeypatch.setattr(C, "ROWS", 13)
    rows, _ = vectors(120, 6, count)
    rows += [(2000 + k, [0.0] * 6) for k in range(30)]
    want, centers = naive_clusters(rows, count, rounds, 2, 6)
    df, found = C.cluster(frame(spark, rows).repartition(5), "vec_id", "embedding", count, rounds, 2, 6)
    got = df.collect()
    assert found.tolist() == centers
    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in got], key=repr) == sorted(want, key=repr)
    assert {int(r["inertia"]) for r in got} == {sum(d for _, _, d in want)}
    for r in got:
        assert int(r["cluster_inertia"]) == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centers[r["cluster"]])).encode()).hexdigest()


def test_pivot_bounds_rule_out_centers():
    rng = np.random.default_rng(3)
    centers = rng.integers(-4000, 4000, (40, 4))
    v = centers[rng.integers(0, 40, 500)] + rng.integers(-40, 40, (500, 4))
    pivots = C.far_apart(centers, 8)
    roots = lambda x: np.sqrt(C.squared(x, pivots))
    cluster, far, computed = C.nearest(v, roots(v), centers, roots(centers))
    assert (cluster == C.squared(v, centers).argmin(1)).all() and (far == C.squared(v, centers).min(1)).all()
    assert computed < 500 * 40 / 4


def test_clusters_of_nothing(spark):
    df, centers = C.cluster(frame(spark, [(1, None), (2, [1.0])]), "vec_id", "embedding")
    assert df.collect() == [] and len(centers) == 0
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    huge, _ = C.cluster(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0])]), "vec_id", "embedding", 1, 1, 2, 2)
    assert sum(int(r["distance"]) for r in huge.collect()) == int(huge.first()["inertia"])
