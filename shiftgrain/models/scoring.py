"""Scores of probabilities and rates: reliability, AUC, losses, quantiles, weighted error and correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrain.operators.ranking import positions, tie_average_rank


def reliability(df: DataFrame, p: str, y: str, width: float, bins: int) -> DataFrame:
    b = F.least(F.floor(F.col(p) / width), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def binary_scores(df: DataFrame, p: str, y: str) -> DataFrame:
    """Brier, log loss, totals and the exact AUC from tie-averaged ranks, in one row."""
    d = df.select(F.col(p).alias("p"), F.col(y).alias("y"), F.lit(0).alias("g"))
    ranked = tie_average_rank(d, ["g"], "p", "r")
    ll = -F.avg(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p")))
    s = ranked.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), ll.alias("log_loss"),
        F.sum("p").alias("total_p"), F.sum("y").alias("total_y"), F.sum(F.when(F.col("y") == 1, F.col("r"))).alias("_pos"),
    )
    pos, n = F.col("total_y"), F.col("n")
    auc = (F.col("_pos") * n - pos * (pos + 1) / 2) / (pos * (n - pos))
    return s.withColumn("auc", auc).drop("_pos")


def quantiles(df: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles from sliced ranks of the distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.lit(0).alias("g"), F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("_cnt"))
    pos = positions(counts, ["g"], "x", "_cnt")
    h = (F.col("_n") - 1) * F.col("q")
    upto = F.col("_below") + F.col("_cnt")
    holds = lambda at: (at >= F.col("_below")) & (at < upto)
    hit = pos.select("*", F.explode(F.array(*[F.lit(q) for q in qs])).alias("q"))
    hit = hit.where(holds(F.floor(h)) | holds(F.ceil(h)))
    lo, hi = F.max(F.when(holds(F.floor(h)), F.col("x"))), F.max(F.when(holds(F.ceil(h)), F.col("x")))
    frac = F.max(h - F.floor(h))
    return hit.groupBy("q").agg((lo + frac * (hi - lo)).alias("v"))


def poisson_deviance(count: Column, mu: Column) -> Column:
    safe = F.greatest(mu, F.lit(1e-12))
    return 2 * (F.when(count > 0, count * F.log(count / safe)).otherwise(0.0) - (count - safe))


def weighted_errors(df: DataFrame, pred: str, actual: str, weight: str) -> DataFrame:
    """Weighted Pearson correlation and weighted mean absolute error in one aggregate."""
    p, a, w = F.col(pred), F.col(actual), F.col(weight)
    s = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * p).alias("p"), F.sum(w * a).alias("a"),
        F.sum(w * p * p).alias("pp"), F.sum(w * a * a).alias("aa"), F.sum(w * p * a).alias("pa"), F.sum(w * F.abs(p - a)).alias("e"),
    )
    cov = F.col("pa") / F.col("w") - F.col("p") * F.col("a") / F.col("w") ** 2
    vp = F.col("pp") / F.col("w") - (F.col("p") / F.col("w")) ** 2
    va = F.col("aa") / F.col("w") - (F.col("a") / F.col("w")) ** 2
    return s.select("n", (cov / F.sqrt(vp * va)).alias("corr"), (F.col("e") / F.col("w")).alias("mae"))
