"""The ridge of `gram` for any number of players, exact, by blocks of players who share line-ups.

Players that no chain of line-ups connects meet in the normal equations only through the few shared
covariates. The columns of such a block are decomposed in one task; what a block adds to the system of
the shared columns is summed over the tasks for every fold and penalty at once, that small system is
solved on the driver, and the blocks are finished by back substitution. Nothing that grows with the
number of players reaches the driver. A block has at most `MAX_BLOCK` columns; the caller asks first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.session import cut_lineage

MAX_BLOCK = 2000
# Points tried in one pass of the search for an extreme eigenvalue, passes, and the span searched below.
POINTS, PASSES, SPAN = 32, 8, 1e-14


def player_blocks(rows: DataFrame, codes: str = "cols") -> DataFrame:
    """(code, block): the smallest player column that line-ups connect with each player column.

    Labels take the least of their neighbours' and then that label's own, until none changes.
    """
    own = F.filter(codes, lambda c: c >= 0)
    pairs = rows.select(F.array_min(own).alias("a"), F.explode(own).alias("b")).distinct()
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(both.groupBy(F.col("a").alias("code")).agg(F.min("b").alias("block")))
    while True:
        near = both.join(label.withColumnRenamed("code", "b"), "b").groupBy("a").agg(F.min("block").alias("near"))
        new = near.join(label.select(F.col("code").alias("near"), F.col("block").alias("least")), "near")
        new = cut_lineage(new.select(F.col("a").alias("code"), F.least("near", "least").alias("block")))
        moved = new.join(label.withColumnRenamed("block", "was"), "code").where("block <> was").limit(1).count()
        label = new
        if not moved:
            return label


def largest_block(blocks: DataFrame) -> int:
    return blocks.groupBy("block").count().agg(F.max("count")).first()[0] or 0


@dataclass
class Shared:
    """Sums of the shared columns per fold: Gram matrix D, right-hand side d; and the folds' totals."""

    codes: np.ndarray
    D: np.ndarray
    d: np.ndarray
    n: np.ndarray
    w: np.ndarray
    wyy: np.ndarray


@dataclass
class Block:
    """Gram matrix, its part with the shared columns and right-hand side of one block, per fold."""

    codes: np.ndarray
    B: np.ndarray
    C: np.ndarray
    c: np.ndarray

    @classmethod
    def of(cls, part: pd.DataFrame, shared: np.ndarray, folds: int, scale: float, target: int) -> Block:
        k, i, j, v = (part[n].to_numpy() for n in ("fold", "i", "j", "v"))
        v = v * scale
        codes = np.unique(np.concatenate([i[i >= 0], j[j >= 0]]))
        B, C, c = np.zeros((folds, len(codes), len(codes))), np.zeros((folds, len(codes), len(shared))), np.zeros((folds, len(codes)))
        m = (i >= 0) & (j >= 0)
        a, b = np.searchsorted(codes, i[m]), np.searchsorted(codes, j[m])
        B[k[m], a, b] = v[m]
        B[k[m], b, a] = v[m]
        m = j == target
        c[k[m], np.searchsorted(codes, i[m])] = v[m]
        m = (i < 0) & (j >= 0)
        C[k[m], np.searchsorted(codes, j[m]), np.searchsorted(shared, i[m])] = v[m]
        return cls(codes, B, C, c)

    def training(self, fold: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of all folds but one, or of all."""
        keep = [k for k in range(len(self.B)) if k != fold]
        return self.B[keep].sum(0), self.C[keep].sum(0), self.c[keep].sum(0)

    def test(self, fold: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.training(None) if fold is None else (self.B[fold], self.C[fold], self.c[fold])


def _each_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one block after another, from batches sorted by block."""
    rest = []
    for b in batches:
        while len(b):
            if rest and b["block"].iloc[0] != rest[0]["block"].iloc[0]:
                yield pd.concat(rest)
                rest = []
            more = np.searchsorted(b["block"].to_numpy(), b["block"].iloc[0], side="right")
            rest.append(b.iloc[:more])
            b = b.iloc[more:]
    if rest:
        yield pd.concat(rest)


def _added_up(table: DataFrame, size: int, of_block: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sum of a vector of `size` numbers over all blocks, added up inside tasks first."""

    def run(batches):
        total = np.zeros(size)
        for part in _each_block(batches):
            total += of_block(part)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"ix": at, "v": total[at]})

    got = table.mapInPandas(run, "ix long, v double").groupBy("ix").agg(F.sum("v").alias("v")).toArrow().to_pandas()
    out = np.zeros(size)
    out[got["ix"].to_numpy()] = got["v"].to_numpy()
    return out


#: What a block adds for one training set and penalty, by name: dimensions in shared columns.
PIECES = {"UWU": 2, "UWu": 1, "trace": 0, "EE": 2, "EBE": 2, "EBa": 1, "aBa": 0, "CE": 2, "Ca": 1, "cE": 1, "ca": 0}


def _pieces(block: Block, fold: int | None, lams: Sequence[float]) -> np.ndarray:
    """All of `PIECES` for each penalty. With the system's shared part x, a block's solution is a - E x."""
    B, C, c = block.training(fold)
    Bt, Ct, ct = block.test(fold)
    value, Q = np.linalg.eigh(B)
    U, u = Q.T @ C, Q.T @ c
    out = []
    for lam in lams:
        W = 1.0 / (np.maximum(value, 0.0) + lam)
        E, a = Q @ (U * W[:, None]), Q @ (u * W)
        BE, Ba = Bt @ E, Bt @ a
        out += [U.T @ (U * W[:, None]), U.T @ (u * W), W.sum(), E.T @ E, E.T @ BE, E.T @ Ba, a @ Ba, Ct.T @ E, Ct.T @ a, ct @ E, ct @ a]
    return np.concatenate([np.ravel(x) for x in out])


def fit_by_blocks(rows: DataFrame, cells: DataFrame, blocks: DataFrame, mults: Sequence[float], folds: int, target: int, intercept: int) -> tuple[DataFrame, dict, list[dict]]:
    """(coefficients and errors (code, b, s) of the players, meta, sweep), equal to those of `gram.fit_ridge`.

    `cells`: (fold, i, j, v) of the upper triangles, j null for the right-hand side.
    """
    from shiftgrain.models.gram import solve_system

    spark = rows.sparkSession
    cells = cut_lineage(cells.withColumn("j", F.coalesce("j", F.lit(target).cast("long"))))
    s = rows.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("wyy").alias("wyy")).toArrow().to_pandas()
    n, w, wyy = (np.zeros(folds) for _ in range(3))
    for q, arr in (("n", n), ("w", w), ("wyy", wyy)):
        arr[s["fold"].to_numpy()] = s[q].to_numpy()
    sc = n.sum() / w.sum()
    top = cells.where("i < 0 and j < 0").toArrow().to_pandas()
    shared = np.unique(top["i"].to_numpy())
    Q = len(shared)
    D, d = np.zeros((folds, Q, Q)), np.zeros((folds, Q))
    k, i, j, v = (top[c].to_numpy() for c in ("fold", "i", "j", "v"))
    at = np.searchsorted(shared, i)
    m = j == target
    d[k[m], at[m]] = v[m] * sc
    to = np.searchsorted(shared, j[~m])
    D[k[~m], at[~m], to] = v[~m] * sc
    D[k[~m], to, at[~m]] = v[~m] * sc

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = cells.where("i >= 0 or j >= 0").withColumn("code", F.when(F.col("j") >= 0, F.col("j")).otherwise(F.col("i")))
    dealt = cut_lineage(own.join(blocks, "code").select("block", "fold", "i", "j", "v").repartition(parts, "block").sortWithinPartitions("block"))
    curv = cells.where("i = j and i >= 0").groupBy("i").agg((F.sum("v") * sc).alias("v"))
    anchor = float(curv.where("v > 0").agg(F.percentile("v", 0.5)).first()[0])
    lams = [anchor * m for m in mults]
    live = [x for x in range(folds) if n[x] > 0]
    sets = [*(live if len(live) > 1 else []), None]
    each = sum(Q**p for p in PIECES.values())

    def all_pieces(part):
        b = Block.of(part, shared, folds, sc, target)
        return np.concatenate([_pieces(b, f, lams) for f in sets])

    sums = _added_up(dealt, len(sets) * len(lams) * each, all_pieces).reshape(len(sets), len(lams), each)

    def solve(x: int, y: int) -> tuple[np.ndarray, dict, np.ndarray, float]:
        """The shared part of a solution, the pieces by name, the reduced system and the squared error on the test rows."""
        f, at, got = sets[x], 0, {}
        for name, p in PIECES.items():
            got[name] = sums[x, y, at : at + Q**p].reshape((Q,) * p) if p else float(sums[x, y, at])
            at += Q**p
        keep = [t for t in range(folds) if t != f]
        Dt, dt = (D.sum(0), d.sum(0)) if f is None else (D[f], d[f])
        S = D[keep].sum(0) - got["UWU"]
        b = solve_system(S, d[keep].sum(0) - got["UWu"])
        inner = got["ca"] - got["cE"] @ b + dt @ b
        quad = got["aBa"] - 2 * got["EBa"] @ b + b @ got["EBE"] @ b + 2 * (got["Ca"] @ b - b @ got["CE"] @ b) + b @ Dt @ b
        return b, got, S, float((wyy.sum() if f is None else wyy[f]) * sc - 2 * inner + quad)

    p = curv.count() + Q
    whole_wyy, wsum = wyy.sum() * sc, w.sum() * sc
    null = float(whole_wyy - (d.sum(0) @ (shared == intercept)) ** 2 / wsum)
    sweep = []
    for y, (mult, lam) in enumerate(zip(mults, lams)):
        cv = [solve(x, y)[3] / (w[f] * sc) for x, f in enumerate(sets) if f is not None]
        _, got, S, sse = solve(len(sets) - 1, y)
        edf = float(p - lam * (got["trace"] + np.trace(solve_system(S, got["EE"]))))
        sweep.append({"mult": mult, "lambda": lam, "cv_mean": float(np.mean(cv)) if cv else None, "edf": edf,
                      "explained": 1 - sse / null if null > 0 else None, "train_wmse": sse / wsum})
    scored = [x for x in range(len(mults)) if sweep[x]["cv_mean"] is not None]
    best = min(scored, key=lambda x: sweep[x]["cv_mean"]) if scored else len(sweep) // 2
    lam, edf = lams[best], sweep[best]["edf"]
    beta, got, S, sse = solve(len(sets) - 1, best)
    disp = sse / max(float(n.sum()) - edf, 1.0)
    inverse, EE = solve_system(S, np.eye(Q)), got["EE"]

    def finish(batches):
        for part in _each_block(batches):
            block = Block.of(part, shared, folds, sc, target)
            B, C, c = block.training(None)
            value, V = np.linalg.eigh(B)
            W = 1.0 / (np.maximum(value, 0.0) + lam)
            E, a = V @ ((V.T @ C) * W[:, None]), V @ ((V.T @ c) * W)
            EI = E @ inverse
            diag = ((V * V) @ W) + (EI * E).sum(1)
            AE = V @ ((V.T @ E) * W[:, None])
            square = ((V * V) @ (W * W)) + 2 * ((AE @ inverse) * E).sum(1) + ((EI @ EE) * EI).sum(1)
            spread = np.maximum(diag - lam * square, 0.0)
            yield pd.DataFrame({"code": block.codes, "b": a - E @ beta, "s": np.sqrt(disp * spread)})

    coef = cut_lineage(dealt.mapInPandas(finish, "code long, b double, s double"))
    low, high = extreme_eigenvalues(dealt, D.sum(0), lam, shared, folds, sc, target)
    meta = {
        "lambda": lam, "lambda_mult": mults[best], "lambda_pinned": mults[best] in (mults[0], mults[-1]),
        "median_player_curvature": anchor, "edf": edf, "dispersion": disp, "n_obs": int(n.sum()), "n_params": p,
        "baseline_xgf60": float(beta[shared == intercept][0]), "explained_deviance": sweep[best]["explained"],
        "cond_number": float(high / max(low, 1e-12)), "family": "gaussian",
    }
    return coef, meta, sweep


def extreme_eigenvalues(dealt: DataFrame, D: np.ndarray, lam: float, shared: np.ndarray, folds: int, scale: float, target: int) -> tuple[float, float]:
    """Smallest and largest eigenvalue of the penalised system.

    Blocks are decomposed once. By Sylvester's law no eigenvalue lies below x if x is below all of the
    blocks' and the shared part of the system less x, with the blocks eliminated, is positive; and
    likewise above. Each pass tries POINTS places of both searches.
    """
    Q = len(shared)

    def spectra(batches):
        for part in _each_block(batches):
            block = Block.of(part, shared, folds, scale, target)
            B, C, _ = block.training(None)
            value, V = np.linalg.eigh(B)
            yield pd.DataFrame({"block": int(part["block"].iloc[0]), "value": np.maximum(value, 0.0) + lam, **{f"u{x}": (V.T @ C)[:, x] for x in range(Q)}})

    names = [f"u{x}" for x in range(Q)]
    kept = cut_lineage(dealt.mapInPandas(spectra, "block long, value double, " + ", ".join(f"{x} double" for x in names)))
    least, most, size = kept.agg(F.min("value"), F.max("value"), F.sum(sum((F.col(x) * F.col(x) for x in names), F.lit(0.0)))).first()
    own = np.linalg.eigvalsh(D)
    below, above = [least * SPAN, min(least, max(own[0], least * SPAN))], [max(most, own[-1]), max(most, own[-1]) + size**0.5]
    for _ in range(PASSES):
        points = np.r_[np.geomspace(*below, POINTS), np.geomspace(*above, POINTS)]

        def eliminated(part, points=points):
            U, value = part[names].to_numpy(), part["value"].to_numpy()
            gap = value[:, None] - points[None, :]
            with np.errstate(divide="ignore"):
                return np.einsum("pq,pr,px->xqr", U, U, 1.0 / np.where(gap == 0, np.finfo(float).tiny ** 0.5, gap)).ravel()

        sums = _added_up(kept, len(points) * Q * Q, eliminated).reshape(len(points), Q, Q)
        ends = [np.linalg.eigvalsh(D - x * np.eye(Q) - s)[[0, -1]] for x, s in zip(points, sums)]
        under = [x < least and e[0] > 0 for x, e in zip(points[:POINTS], ends)]
        over = [x > most and e[1] < 0 for x, e in zip(points[POINTS:], ends[POINTS:])]
        first = under.index(False) if False in under else POINTS
        below = [points[max(first - 1, 0)], points[min(first, POINTS - 1)]]
        first = over.index(True) if True in over else POINTS
        above = [points[POINTS + max(first - 1, 0)], points[POINTS + min(first, POINTS - 1)]]
        if below[1] <= below[0] * (1 + 1e-9) and above[1] <= above[0] * (1 + 1e-9):
            break
    return float(below[1]), float(above[1])


#: Rows of a block that are spread out as a dense matrix at a time.
CHUNK = 4096


class TweedieBlocks:
    """Newton passes of the log-link Tweedie ridge, all training sets at once.

    Each player column's state is a row: the accepted coefficient of every training set, and the next
    one as a - E x, with x the shared part that the driver solves once a pass's sums are in. A pass
    reads a block's line-ups beside its states; only the sums of the shared columns reach the driver.
    """

    def __init__(self, rows: DataFrame, blocks: DataFrame, shared: np.ndarray, folds: int, sets: Sequence[int], scale: float, power: float):
        self.shared, self.folds, self.sets, self.scale, self.power = shared, folds, list(sets), scale, power
        Q, T = len(shared), len(self.sets)
        parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        own = F.coalesce(F.array_min(F.filter("cols", lambda c: c >= 0)), F.lit(-1).cast("long"))
        placed = rows.withColumn("code", own).join(blocks, "code", "left").withColumn("block", F.coalesce("block", F.lit(-1).cast("long")))
        self.rows = placed.select("block", "fold", "cols", "w", "wy", "wyp").repartition(parts, "block").persist()
        zero = F.array_repeat(F.lit(0.0), T * (2 + Q))
        self.start = cut_lineage(blocks.select("block", "code", zero.alias("vec")))

    def pass_over(self, state: DataFrame, kept: np.ndarray, x: np.ndarray, step: np.ndarray, lam: float, observed: bool, report: tuple | None = None):
        """(new states, sums by name) at the coefficients `step` of the way to the proposed ones; with `report`
        (inverse of the whole's shared system, sum of E'E) the table (code, beta, spread) of the whole instead."""
        shared, folds, sets, sc, power = self.shared, self.folds, self.sets, self.scale, self.power
        Q, T = len(shared), len(sets)
        top = kept + step[:, None] * (x - kept)

        def run(key, lines, states):
            codes = states["code"].to_numpy()
            by = np.argsort(codes)
            codes = codes[by]
            P = len(codes)
            old = np.array(states["vec"].tolist(), float).reshape(P, T * (2 + Q))[by]
            was, a, E = old[:, :T], old[:, T : 2 * T], old[:, 2 * T :].reshape(P, T, Q)
            now = was + step * (a - np.einsum("ptq,tq->pt", E, x) - was)
            beta = np.concatenate([now, top.T])
            names = np.concatenate([codes, shared])
            at = np.argsort(names)
            gram, right, dev, out = np.zeros((T, P + Q, P + Q)), np.zeros((T, P + Q)), np.zeros(T), np.zeros(T)
            for begin in range(0, len(lines), CHUNK):
                part = lines.iloc[begin : begin + CHUNK]
                cols = part["cols"].tolist()
                X = np.zeros((len(part), P + Q))
                X[np.repeat(np.arange(len(part)), [len(c) for c in cols]), at[np.searchsorted(names, np.concatenate(cols), sorter=at)]] = 1.0
                fold, w, wy, wyp = (part[n].to_numpy()[:, None] for n in ("fold", "w", "wy", "wyp"))
                train = fold != np.array(sets)[None, :]
                eta = np.clip(X @ beta, -30.0, 30.0)
                mu = np.exp(eta)
                fisher, pull = w * mu ** (2 - power), wy * mu ** (1 - power)
                gw = (2 - power) * fisher + (power - 1) * pull if observed else fisher
                gz = gw * eta + pull - fisher
                m = np.maximum(mu, 1e-9)
                unit = 2.0 * (wyp / ((1 - power) * (2 - power)) - wy * m ** (1 - power) / (1 - power) + w * m ** (2 - power) / (2 - power))
                dev += (unit * train).sum(0) * sc
                out += (unit * ~train).sum(0)
                right += (X.T @ (gz * train)).T * sc
                for t in range(T):
                    gram[t] += X.T @ (X * (gw[:, t] * train[:, t])[:, None]) * sc
            C = gram[:, :P, P:]
            A = gram[:, :P, :P] + lam * np.eye(P)
            solved = np.linalg.solve(A, np.concatenate([C, right[:, :P, None]], axis=2)) if P else np.zeros((T, 0, Q + 1))
            E, a = solved[:, :, :Q], solved[:, :, Q]
            if report is not None:
                inverse, EE = report
                R, e = np.linalg.inv(A[-1]) if P else np.zeros((0, 0)), E[-1]
                diag = np.diag(R) + ((e @ inverse) * e).sum(1)
                square = (R * R).sum(1) + 2 * ((R @ e @ inverse) * e).sum(1) + ((e @ inverse @ EE @ inverse) * e).sum(1)
                return pd.DataFrame({"block": key[0], "code": codes, "vec": pd.Series(np.stack([now[:, -1], np.maximum(diag - lam * square, 0.0)], axis=1).tolist(), dtype=object)})
            S, s = gram[:, P:, P:] - np.einsum("tpq,tpr->tqr", C, E), right[:, P:] - np.einsum("tpq,tp->tq", C, a)
            trace = 0.0 if observed or not P else np.trace(np.linalg.inv(A[-1]))
            sums = np.concatenate([S.ravel(), s.ravel(), dev, out, (now * now).sum(0), [trace], (E[-1].T @ E[-1]).ravel()])
            vec = np.concatenate([now, a.T, E.transpose(1, 0, 2).reshape(P, T * Q)], axis=1)
            return pd.DataFrame({"block": key[0], "code": np.append(codes.astype(object), None), "vec": pd.Series([*vec.tolist(), sums.tolist()], dtype=object)})

        met = self.rows.groupBy("block").cogroup(state.groupBy("block")).applyInPandas(run, "block long, code long, vec array<double>")
        if report is not None:
            return met.select("code", F.col("vec")[0].alias("beta"), F.col("vec")[1].alias("spread"))
        met = cut_lineage(met)
        added = met.where("code is null").select(F.posexplode("vec").alias("ix", "v")).groupBy("ix").agg(F.sum("v").alias("v")).toArrow().to_pandas()
        flat = np.zeros(T * Q * Q + T * Q + 3 * T + 1 + Q * Q)
        flat[added["ix"].to_numpy()] = added["v"].to_numpy()
        cuts = np.cumsum([T * Q * Q, T * Q, T, T, T, 1])
        S, s, dev, out, square, trace, EE = np.split(flat, cuts)
        return met.where("code is not null"), {"S": S.reshape(T, Q, Q), "s": s.reshape(T, Q), "dev": dev, "out": out, "square": square, "trace": float(trace[0]), "EE": EE.reshape(Q, Q)}


def tweedie_by_blocks(rows: DataFrame, blocks: DataFrame, mults: Sequence[float], power: float, folds: int, max_iter: int, tol: float, intercept: int) -> tuple[DataFrame, dict, list[dict]]:
    """(coefficients and errors (code, b, s) of the players, meta, sweep), equal to those of `gram.fit_tweedie`."""
    from shiftgrain.models.gram import solve_system

    s = rows.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("wy").alias("wy")).toArrow().to_pandas()
    w = np.zeros(folds)
    w[s["fold"].to_numpy()] = s["w"].to_numpy()
    n, sc = s["n"].sum(), s["n"].sum() / s["w"].sum()
    column = rows.select(F.explode("cols").alias("code"), "w").groupBy("code").agg(F.sum("w").alias("w"))
    shared = np.array(sorted(r["code"] for r in column.where("code < 0").collect()), dtype=np.int64)
    players = column.where("code >= 0")
    anchor = float(players.where("w > 0").agg(F.percentile("w", 0.5)).first()[0]) * sc
    Q, p = len(shared), players.count() + len(shared)
    live = sorted(s["fold"].tolist())
    sets = [*(live if len(live) > 1 else []), folds]
    T, icol = len(sets), int(np.flatnonzero(shared == intercept)[0])
    ybar = rows.where(F.array_contains("cols", F.lit(intercept).cast("long"))).agg(F.sum("wy")).first()[0] / s["w"].sum()
    work = TweedieBlocks(rows, blocks, shared, folds, sets, sc, power)
    kept = np.zeros((T, Q))
    kept[:, icol] = np.log(max(ybar, 1e-3))
    state, sweep, fits = work.start, [], []
    for mult in mults:
        lam, last = anchor * mult, np.full(T, np.inf)
        x, step, it = kept, np.zeros(T), 0
        for it in range(1, max_iter + 1):
            new, got = work.pass_over(state, kept, x, step, lam, True)
            goal = got["dev"] + lam * got["square"]
            worse = goal > last + tol * np.abs(last)
            if worse.any():
                step = np.where(worse, step / 2, step)
                continue
            done = np.all(np.abs(last - goal) <= tol * (np.abs(goal) + tol))
            state, kept, last = new, kept + step[:, None] * (x - kept), goal
            x, step = np.stack([solve_system(got["S"][t], got["s"][t]) for t in range(T)]), np.ones(T)
            if done:
                break
        state, got = work.pass_over(state, kept, kept, np.zeros(T), lam, False)
        edf = float(p - lam * (got["trace"] + np.trace(solve_system(got["S"][-1], got["EE"]))))
        cv = float(np.mean([got["out"][t] / w[k] for t, k in enumerate(sets[:-1])])) if T > 1 else None
        sweep.append({"mult": mult, "lambda": lam, "cv_mean": cv, "edf": edf, "iters": it, "deviance": float(got["dev"][-1])})
        fits.append((state, kept, solve_system(got["S"][-1], np.eye(Q)), got["EE"]))
    order = [i for i, f in enumerate(sweep) if f["cv_mean"] is not None] or [len(sweep) // 2]
    best = min(order, key=lambda i: sweep[i]["cv_mean"] if sweep[i]["cv_mean"] is not None else 0.0)
    state, kept, inverse, EE = fits[best]
    disp = sweep[best]["deviance"] / max(n - sweep[best]["edf"], 1.0)
    base = float(np.exp(kept[-1, icol]))
    told = work.pass_over(state, kept, kept, np.zeros(T), sweep[best]["lambda"], False, (inverse, EE))
    rate = base * F.exp("beta")
    coef = cut_lineage(told.select("code", (rate - base).alias("b"), (rate * F.sqrt(disp * F.col("spread"))).alias("s")))
    work.rows.unpersist()
    meta = {"family": "tweedie", "lambda": sweep[best]["lambda"], "lambda_mult": sweep[best]["mult"], "edf": sweep[best]["edf"],
            "dispersion": disp, "baseline_xgf60": base, "iters": sweep[best]["iters"], "n_obs": int(n), "n_params": p}
    return coef, meta, sweep
