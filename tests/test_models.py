"""Fits against dense numpy solutions and brute-force counterfactuals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiftgrain.models import blockfit as BF
from shiftgrain.models import cards as CD
from shiftgrain.models import duel as DU
from shiftgrain.models import gram as GM


def design(spark, n=240, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        pl = rng.choice(8, 4, replace=False)
        cols = sorted([int(pl[0]) * 2, int(pl[1]) * 2, int(pl[2]) * 2 + 1, int(pl[3]) * 2 + 1, -1] + ([-2] if i % 2 else []))
        rows.append((i % 6, cols, float(rng.exponential(2.0)) if rng.random() > 0.3 else 0.0, float(rng.integers(10, 60))))
    df = spark.createDataFrame(rows, "game_id long, cols array<bigint>, y double, w double").withColumn("fold", F.col("game_id") % 3)
    codes = sorted({c for r in rows for c in r[1]})
    X = np.array([[1.0 if c in r[1] else 0.0 for c in codes] for r in rows])
    y, w = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    return df, np.array(codes), X, y, w * n / w.sum(), np.array([r[0] % 3 for r in rows])


def test_ridge_equals_direct_solution(spark):
    df, codes, X, y, w, fold = design(spark)
    fit = GM.fit_ridge(GM.lineups(df), mults=(0.1, 1.0), folds=3)
    pen = (codes >= 0) * fit.meta["lambda"]
    B = X.T @ (X * w[:, None])
    beta = np.linalg.solve(B + np.diag(pen), X.T @ (w * y))
    assert np.allclose(fit.beta, beta, atol=1e-8)
    for s in fit.sweep:
        errs = []
        for k in range(3):
            tr, va = fold != k, fold == k
            b = np.linalg.solve(X[tr].T @ (X[tr] * w[tr, None]) + np.diag((codes >= 0) * s["lambda"]), X[tr].T @ (w[tr] * y[tr]))
            errs.append(np.average((y[va] - X[va] @ b) ** 2, weights=w[va]))
        assert abs(s["cv_mean"] - np.mean(errs)) < 1e-8
        A = B + np.diag((codes >= 0) * s["lambda"])
        assert abs(s["edf"] - np.trace(np.linalg.solve(A, B))) < 1e-6


def test_ridge_on_spark_equals_driver(spark):
    df, codes, *_ = design(spark, n=60)
    rows = GM.lineups(df)
    fit = GM.fit_ridge(rows, mults=(1.0,), folds=3)
    g = GM.gram_entries(rows).withColumn("v", F.col("v") * (60 / float(rows.agg(F.sum("w")).first()[0])))
    pen = spark.createDataFrame([(int(c), float((c >= 0) * fit.meta["lambda"])) for c in codes], "i bigint, pen double")
    x = GM.solve_on_spark(g.where("j is not null"), g.where("j is null"), pen, tol=1e-7, max_iter=25)
    got = {r.i: r.x for r in x.collect()}
    assert max(abs(got[int(c)] - b) for c, b in zip(codes, fit.beta)) < 1e-3


def test_impacts_beyond_the_driver_limit_equal_those_below(spark):
    """The same penalty, an exact median of curvatures, on either side of the limit; an unsettled system is an error."""
    df = design(spark, n=60)[0].withColumn("fold", F.lit(0))
    small, large = (
        GM.fit_impacts(df, "off", "def", mults=(1.0,), limit=n).toPandas().set_index("player_id").sort_index() for n in (100, 5))
    for c in ("off", "def", "off_base", "off_toi", "def_toi"):
        assert np.allclose(small[c], large[c], atol=1e-6, equal_nan=True)
    g = GM.gram_entries(GM.lineups(df))
    pen = g.where("i = j").selectExpr("i", "1D AS pen")
    with pytest.raises(RuntimeError, match="no solution within 1 passes"):
        GM.solve_on_spark(g.where("j is not null"), g.where("j is null"), pen, max_iter=1)


def test_tweedie_stationary(spark):
    df, codes, X, y, w, _ = design(spark)
    fit = GM.fit_tweedie(GM.lineups(df), mults=(1.0,), folds=3)
    b = fit.meta["log_beta"]
    mu = np.exp(X @ b)
    grad = X.T @ (w * (mu**0.5 - y * mu**-0.5)) + (codes >= 0) * fit.meta["lambda"] * b
    assert np.max(np.abs(grad)) < 1e-2


def duel_shots(spark):
    rng = np.random.default_rng(3)
    n = 1500
    s, g, xg = rng.integers(0, 25, n), rng.integers(100, 106, n), rng.uniform(0.02, 0.3, n)
    goal = (rng.random(n) < xg).astype(int)
    return spark.createDataFrame(pd.DataFrame({"shooter_id": s, "goalie_id": g, "xg": xg, "goal": goal}))


def test_crossed_fit_solvers_agree_and_close(spark):
    shots = duel_shots(spark)
    a = DU.fit_crossed(shots, 30.0, 90.0)
    b = DU.fit_crossed(shots, 30.0, 90.0, limit=10)
    assert (a.meta["solver"], b.meta["solver"]) == ("normal equations", "reduced")
    x, y = (f.shooters.toPandas().set_index("shooter_id").alpha for f in (a, b))
    assert (x - y).abs().max() < 1e-7 and abs(a.mu - b.mu) < 1e-8
    d = DU.decompose(shots, F.lit(a.mu), a.shooters, a.goalies).agg(F.sum("goal") - F.sum("recon")).first()[0]
    assert abs(d) < 1e-6


def test_count_fit_gradient(spark):
    """The quasi-Newton fit ends where the penalised likelihood is flat."""
    rng = np.random.default_rng(9)
    n, units = 400, 12
    slots = np.array([rng.choice(units, 10, replace=False) for _ in range(n)])
    cols = {f"s{i}": slots[:, i] for i in range(10)}
    pdf = pd.DataFrame({**cols, "count": rng.poisson(0.6, n), "offset": np.zeros(n), "dur": np.full(n, 3600), "venue": np.full(n, -1), "home": rng.integers(0, 2, n).astype(float)})
    u = spark.createDataFrame([(i, i // 2, 2021 + i % 2, None if i % 2 == 0 else 1) for i in range(units)], "ix int, player_id long, season int, gap int")
    fit = BF.fit_counts(spark.createDataFrame(pdf), None, u, ["home"], tol=1e-10)
    mu = np.exp(fit.theta[0] + fit.theta[1] * pdf.home + fit.block("shoot")[slots[:, 0]] + fit.block("create")[slots[:, 1:5]].sum(1) + fit.block("def")[slots[:, 5:]].sum(1))
    assert abs(float((mu - pdf["count"]).sum())) < 0.05


def test_swap_with_itself_is_zero_and_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    P = 12
    sk = pd.DataFrame({"player_id": range(P), "is_d": (np.arange(P) % 3 == 0).astype(float)})
    names = ["sh", "cr", "df", "g0", "gF", "gD", "kq", "cq", "slope0", "slopeF", "slopeD"]
    for c in names:
        base = rng.normal(0, 0.1, P)
        sk[c] = {"g": 0.08 + base / 10, "k": 1 + base, "s": base, "c": base, "d": base}[c[0]] if not c.startswith("slope") else 0.05
        sk[f"r_{c}"] = sk[c].mean()
    sk["psi0"] = -1.3
    sides = [(1, i, True, int(rng.integers(20, 60)), 0.1, [int(x) for x in p[:5]], [int(x) for x in p[5:10]]) for i, p in enumerate(rng.permuted(np.tile(np.arange(P), (6, 1)), axis=1))]
    sdf = spark.createDataFrame(sides, "game_id long, stint_idx int, home boolean, duration_s int, gsave double, attackers array<bigint>, defenders array<bigint>")
    s = sk.set_index("player_id")

    def expected(A, B, dur, gs, who):
        tot = 0.0
        for k in A:
            mates = [m for m in A if m != k]
            e = {m: np.exp(who(m, "cr")) for m in mates}
            Z = np.exp(-1.3) + sum(s_cr for s_cr in e.values())
            SF = sum(v for m, v in e.items() if s.is_d[m] < 0.5)
            SD = sum(e.values()) - SF
            mix = lambda a, b, c: (np.exp(-1.3) * who(k, a) + SF * who(k, b) + SD * who(k, c)) / Z
            lift = sum(who(m, "cq") for m in mates)
            tot += np.exp(who(k, "sh") - who(k, "cr")) * (mix("g0", "gF", "gD") + mix("slope0", "slopeF", "slopeD") * lift) * np.exp((1 - who(k, "g0")) * gs)
        env = np.exp(sum(who(k, "cr") for k in A) + sum(who(d, "df") + np.log(who(d, "kq")) for d in B))
        return env * tot * dur / 3600.0

    slots = CD.swap_rows(sdf, spark.createDataFrame(sk), F.lit(1.0)).toPandas()
    for gid, i, home, dur, gs, A, B in sides:
        e = expected(A, B, dur, gs, lambda p, c: s.at[p, c])
        assert abs(slots[slots.stint_idx == i].E.iloc[0] - e) < 1e-10
        d = B[0]
        swap = expected(A, B, dur, gs, lambda p, c: s.at[p, f"r_{c}"] if p == d and c in ("df", "kq") else s.at[p, c])
        got = slots[(slots.stint_idx == i) & (slots.player_id == d)].gar.iloc[0]
        assert abs(got - (swap - e)) < 1e-10
    same = sk.assign(**{f"r_{c}": sk[c] for c in names})
    z = CD.swap_totals(CD.swap_rows(sdf, spark.createDataFrame(same), F.lit(1.0))).toPandas()
    assert z[["gar_atk", "gar_def"]].abs().max().max() < 1e-12


def test_beta_marginal_against_draws(spark):
    rng = np.random.default_rng(0)
    for q, s in ((0.07, 15.0), (0.2, 6.0)):
        x = np.clip(rng.beta(s * q, s * (1 - q), 400_000), 1e-9, 1 - 1e-9)
        want = float(np.mean(1 / (1 + np.exp(-(0.9 * np.log(x / (1 - x)) - 0.1)))))
        got = spark.range(1).select(CD.beta_marginal(q, s, 0.9, -0.1)).first()[0]
        assert abs(got - want) < 2e-3


def test_the_crossed_fit_reads_its_shots_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = [(s, g, 0.05 + 0.01 * (k % 7), int((s * g + k) % 9 == 0)) for s in range(1, 31) for g in range(100, 115) for k in range(3)]
    plain = spark.createDataFrame(rows, "shooter_id long, goalie_id long, xg double, goal int")
    fit = DU.fit_crossed(plain.mapInPandas(count, plain.schema), 30.0, 90.0, limit=10)
    assert fit.meta["solver"] == "alternating" and fit.meta["n_shots"] == len(rows)
    exact = DU.fit_crossed(plain, 30.0, 90.0)
    for mine, theirs, key, value in ((fit.shooters, exact.shooters, "shooter_id", "alpha"), (fit.goalies, exact.goalies, "goalie_id", "gamma")):
        want = {r[key]: (r["ixg"] if key == "shooter_id" else r["xga"], r[value]) for r in theirs.collect()}
        for r in mine.collect():
            assert (r["ixg"] if key == "shooter_id" else r["xga"], r[value]) == pytest.approx(want[r[key]], abs=1e-7)
    assert read.value == len(rows)
