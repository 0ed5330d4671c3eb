"""Hold-out scoring: candidates, calibration slope, paired bootstrap, count checks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrain.models.scoring import poisson_deviance, weighted_errors
from shiftgrain.session import cut_lineage


def candidates(states: DataFrame, value: str, weight: str) -> DataFrame:
    """Per player: league (zero), time-weighted mean over seasons, last state."""
    return states.groupBy("player_id").agg(
        F.lit(0.0).alias("league"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("pooled"), F.max_by(value, "season").alias("last"),
    )


def score_candidates(target: DataFrame, fitted: DataFrame, names: list[str], base: Column) -> DataFrame:
    """Deviance per 1000 rows, weighted correlation and weighted error of each candidate.

    `target`: player_id, n (count), hours. Players unseen in training get zero.
    """
    j = target.join(fitted, "player_id", "left").fillna(0.0, names)
    out = []
    for c in names:
        mu = F.exp(base + F.col(c)) * F.col("hours")
        d = j.withColumn("mu", mu)
        dev = d.agg((F.sum(poisson_deviance(F.col("n"), F.col("mu"))) / F.count(F.lit(1)) * 1000).alias("dev1000"))
        err = weighted_errors(d.withColumn("p", F.col("mu") / F.col("hours")).withColumn("a", F.col("n") / F.col("hours")), "p", "a", "hours")
        out.append(dev.crossJoin(err).withColumn("candidate", F.lit(c)))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


#: Values of the slope tried in one pass.
TRIALS = 33


def calibration_slope(rows: DataFrame, tol: float = 1e-9) -> float:
    """The factor g that makes n ~ Poisson(exp(base + g term + offset)) most likely.

    The likelihood's slope falls in g, so its zero lies between two trial values. A pass over the rows
    takes the slope at TRIALS values at once and keeps the interval where the sign changes; an
    interval without a change is widened first. Raises if the slope has one sign everywhere.
    """
    data = cut_lineage(rows.select("n", "base", "term", "offset"))

    def slopes(values: list[float]) -> list[float]:
        rest = lambda g: F.col("n") - F.exp(F.col("base") + F.lit(g) * F.col("term") + F.col("offset"))
        return [x or 0.0 for x in data.agg(*(F.sum(F.col("term") * rest(g)).alias(f"s{k}") for k, g in enumerate(values))).first()]

    low, high = -1.0, 3.0
    while True:
        width = (high - low) / (TRIALS - 1)
        values = [low + k * width for k in range(TRIALS)]
        at = slopes(values)
        if at[0] < 0 or at[-1] > 0:
            low, high = low - (at[0] < 0) * 2 * (high - low), high + (at[-1] > 0) * 2 * (high - low)
            if high - low > 1e3:
                raise ValueError("the likelihood has no maximum in the slope")
            continue
        k = max((k for k in range(TRIALS) if at[k] >= 0), default=0)
        if at[k] == 0 or k == TRIALS - 1:
            return values[k]
        low, high = values[k], values[k + 1]
        if high - low <= tol:
            # The slope is as good as straight here: its zero by proportion.
            return low + (high - low) * at[k] / (at[k] - at[k + 1])


#: Correlation with the target that a candidate needs by itself to pass the gate (fixed value).
OWN = 0.15
#: Modulus and factors of the resampling hash; every product fits into a long, in any engine.
PRIME, BY_ID, BY_DRAW, SHIFT, TWIST = 2147483647, 48271, 69621, 12345, 39373
#: Chances of at most 0, 1, 2, ... of a Poisson count of mean 1, to the last place of a double.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def resample_weights(ids: np.ndarray, draws: int) -> np.ndarray:
    """Poisson(1) counts (id, draw), by inversion of a hash that any engine can compute."""
    draw = np.arange(draws, dtype=np.int64)
    h = (ids.astype(np.int64)[:, None] % PRIME * BY_ID + draw[None, :] * BY_DRAW + SHIFT) % PRIME
    for _ in range(2):
        h = (h * h + h * TWIST + draw[None, :]) % PRIME
    return np.searchsorted(POISSON, h / PRIME, "right")


def resampled_moments(players: DataFrame, a: str, b: str, actual: str, weight: str, draws: int) -> DataFrame:
    """(draw, nine weighted moments): every task adds up all draws of its players and sends one row a draw.

    Players weigh `weight` times a Poisson(1) count of their own in each draw. Rows with a null in any
    of the columns take no part.
    """
    names = ["s", "sa", "sb", "sy", "saa", "sbb", "syy", "say", "sby"]

    def run(batches):
        total = np.zeros((draws, len(names)))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x, z, y, w = (part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "y", "w"))
                one = np.ones(len(x))
                moments = np.stack([one, x, z, y, x * x, z * z, y * y, x * y, z * y], axis=1) * w[:, None]
                total += resample_weights(part.column("player_id").to_numpy(), draws).T.astype(float) @ moments
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], ["draw", *names])

    rows = players.select("player_id", *[F.col(c).cast("double").alias(n) for c, n in ((a, "a"), (b, "b"), (actual, "y"), (weight, "w"))]).dropna()
    partial = rows.mapInArrow(run, "draw long, " + ", ".join(f"{n} double" for n in names))
    return partial.groupBy("draw").agg(*[F.sum(n).alias(n) for n in names])


def paired_bootstrap(players: DataFrame, a: str, b: str, actual: str, weight: str, draws: int = 2000) -> DataFrame:
    """One row: how often candidate `a` correlates better with the target than `b`, its gain with a 90 % interval, the verdict.

    It passes when the gain's lower end is above zero, it wins in 95 % of the draws, and its own
    correlation with the target over all players exceeds OWN. Draws without a correlation do not count.
    """
    c = F.col

    def corr(k: str) -> Column:
        cov = c(f"s{k}y") - c(f"s{k}") * c("sy") / c("s")
        spread = (c(f"s{k}{k}") - c(f"s{k}") ** 2 / c("s")) * (c("syy") - c("sy") ** 2 / c("s"))
        return F.when(spread > 0, cov / F.sqrt(spread))

    moments = resampled_moments(players, a, b, actual, weight, draws).where("s > 0")
    gains = moments.select((corr("a") - corr("b")).alias("gain")).where("gain is not null")
    out = gains.agg(
        F.count(F.lit(1)).alias("draws"), F.avg((c("gain") > 0).cast("double")).alias("p_better"), F.avg("gain").alias("mean_gain"),
        F.percentile("gain", F.lit(0.05)).alias("low"), F.percentile("gain", F.lit(0.95)).alias("high"),
    )
    own = weighted_errors(players.dropna(subset=[a, b, actual, weight]), a, actual, weight).select(c("corr").alias("own_corr"))
    good = (c("low") > 0) & (c("p_better") >= 0.95) & (c("own_corr") > OWN)
    return out.crossJoin(F.broadcast(own)).withColumn("verdict", F.when(good, "PASS").otherwise("FAIL"))


def count_check(rows: DataFrame, r: float) -> DataFrame:
    """Expected against actual counts: totals, mean variance, zero share, for both count laws."""
    mu, n = F.col("mu"), F.col("n")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(n).alias("actual"), F.sum(mu).alias("expected"),
        F.avg(n * n).alias("n2"), (F.avg(mu + mu * mu)).alias("poisson2"), F.avg(mu + mu * mu * (1 + 1 / r)).alias("nb2"),
        F.avg((n == 0).cast("double")).alias("zero"), F.avg(F.exp(-mu)).alias("poisson_zero"), F.avg(F.pow(r / (r + mu), F.lit(r))).alias("nb_zero"),
    )
