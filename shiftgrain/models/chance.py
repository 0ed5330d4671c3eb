"""Chance model: scored shots from boosted trees, recalibrated, frozen on disk, and curve look-ups."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrain.models.boosting import Binning, Boosting, Tree, sigmoid
from shiftgrain.session import checkpoint_dir, cut_lineage

# The features of a chance, numeric then categorical, and the number of folds.
NUMERIC = (
    "distance", "abs_angle", "x_adj", "abs_y", "time_since_last", "time_since_shot", "dist_from_last", "speed_from_last",
    "angle_change", "last_dist_to_net", "since_faceoff", "attempts_15s", "strength_diff", "shooter_skaters", "def_skaters",
    "score_diff", "period", "time_g", "is_home", "rebound", "rush", "same_team_last", "royal_road", "last_behind_net", "off_wing",
)
CATEGORICAL = ("shot_type", "zone", "last_event_type")
FOLDS = 5
#: Size of the fit: most trees, their depth and rate, and how many trees may follow the best one on held-out games.
TREES, DEPTH, STEP, PATIENCE = 4000, 6, 0.04, 50
#: Places that raw scores are rounded to, so that a million points at most decide the curve.
PLACES = 6


def piecewise(v, points: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation through `points`, flat beyond both ends (a fitted isotonic curve)."""
    c = F.col(v) if isinstance(v, str) else v
    out = F.when(c <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(c < x1, y0 + (c - x0) / (x1 - x0) * (y1 - y0))
    return F.when(c.isNotNull(), out.otherwise(F.lit(points[-1][1])))


def with_fold(features: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Folds grouped by game."""
    return features.withColumn("fold", F.pmod(F.xxhash64("game_id"), F.lit(folds)).cast("int"))


def _scores(df: DataFrame, binning: Binning, base: float, trees: dict[int | None, list[Tree]], curve: tuple[list[float], list[float]] | None, fold_col: str | None = None) -> DataFrame:
    """`df` with `raw` and, with a curve, `xg`; with `fold_col` each row is scored by the trees of its fold."""
    names = df.columns
    plain = df.select(*names, *[F.col(c).cast("double").alias(f"_f_{c}") for c in binning.numeric], *[F.col(c).cast("string").alias(f"_f_{c}") for c in binning.categorical])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binning.matrix(pa.RecordBatch.from_arrays([batch.column(f"_f_{c}") for c in binning.names], list(binning.names)))
            fold = batch.column(fold_col).to_numpy(zero_copy_only=False) if fold_col else None
            total = np.full(batch.num_rows, base)
            for key, own in trees.items():
                rows = np.flatnonzero(fold == key) if fold_col else slice(None)
                mine, some = bins[rows], total[rows]
                for tree in own:
                    some += tree.predict(mine)
                total[rows] = some
            raw = np.round(sigmoid(total), PLACES)
            out = [*(batch.column(c) for c in names), pa.array(raw)]
            if curve is not None:
                out.append(pa.array(np.interp(raw, *curve)))
            yield pa.RecordBatch.from_arrays(out, [*names, "raw", "xg"][: len(out)])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return plain.mapInArrow(run, f"{kinds}, raw double" + (", xg double" if curve is not None else ""))


def monotone_curve(scored: DataFrame) -> tuple[list[float], list[float]]:
    """(scores, rates): the isotonic fit of `goal` on `raw`, from one weighted point for each rounded score."""
    points = scored.groupBy("raw").agg(F.avg("goal").alias("rate"), F.count(F.lit(1)).cast("double").alias("weight"))
    fit = IsotonicRegression(featuresCol="raw", labelCol="rate", weightCol="weight").fit(cut_lineage(points))
    return [float(v) for v in fit.boundaries], [float(v) for v in fit.predictions]


class ChanceModel:
    """Trees over all rows with the isotonic curve of the out-of-fold scores; `rounds` are the folds' best counts."""

    def __init__(self, binning: Binning, base: float, trees: list[Tree], curve: tuple[list[float], list[float]], rounds: list[int]):
        self.binning, self.base, self.trees, self.curve, self.rounds = binning, base, trees, curve, rounds

    @classmethod
    def fit(
        cls, features: DataFrame, trees: int = TREES, depth: int = DEPTH, step: float = STEP, folds: int = FOLDS, patience: int = PATIENCE, seed: int = 7
    ) -> tuple[ChanceModel, DataFrame]:
        """The model and every row's out-of-fold `raw` and calibrated `xg`.

        All folds and the final model grow together. A fold's rows are scored by the best prefix of the
        model that saw none of its games; the count of trees that is best on a fold is found on that
        same fold, as the engine this follows does. The final model has the mean number of trees.
        """
        data = cut_lineage(with_fold(features, folds))
        binning = Binning.of(data, NUMERIC, CATEGORICAL)
        rows = data.withColumn("label", F.col("goal").cast("int")).withColumn("key", F.xxhash64("game_id", "event_idx"))
        present = sorted(r["fold"] for r in data.select("fold").distinct().collect())
        grown = Boosting(rows, binning, present, depth, step, seed)
        mean = grown.grow(trees, patience)
        by_fold = {m.fold: m.trees[: m.best] for m in grown.members[:-1]}
        oof = cut_lineage(_scores(data, binning, grown.base, by_fold, None, "fold").select("game_id", "event_idx", "season", "goal", "raw"))
        curve = monotone_curve(oof)
        model = cls(binning, grown.base, grown.members[-1].trees[:mean], curve, [m.best for m in grown.members[:-1]])
        return model, oof.withColumn("xg", _curve_column(F.col("raw"), curve))

    def transform(self, features: DataFrame) -> DataFrame:
        """Frozen scoring in one pass: the same row always gets the same value; unseen categories count as missing."""
        return _scores(features, self.binning, self.base, {None: self.trees}, self.curve)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row a part: the bins, every tree, and last the curve."""
        head = {"numeric": self.binning.numeric, "categorical": self.binning.categorical, "cuts": self.binning.cuts, "levels": self.binning.levels, "base": self.base}
        parts = [("head", head), *(("tree", t.packed()) for t in self.trees), ("curve", {"curve": self.curve, "rounds": self.rounds})]
        rows = [(k, len(parts), kind, json.dumps(body)) for k, (kind, body) in enumerate(parts)]
        spark.createDataFrame(rows, "place int, parts int, kind string, body string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ChanceModel:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["place"])
        if not rows or len(rows) != rows[0]["parts"]:
            raise ValueError(f"{path} is no whole model")
        bodies = [json.loads(r["body"]) for r in rows]
        head, last = bodies[0], bodies[-1]
        binning = Binning(tuple(head["numeric"]), tuple(head["categorical"]), head["cuts"], head["levels"])
        return cls(binning, head["base"], [Tree.unpacked(b) for b in bodies[1:-1]], tuple(last["curve"]), last["rounds"])

    def importances(self) -> list[tuple[str, float]]:
        """Mean gain of a feature's splits as a share of all features' mean gains, from the largest."""
        gains: dict[str, list[float]] = {}
        for tree in self.trees:
            for node in np.flatnonzero(tree.feature >= 0):
                gains.setdefault(self.binning.names[tree.feature[node]], []).append(float(tree.gain[node]))
        means = {name: sum(v) / len(v) for name, v in gains.items()}
        whole = sum(means.values()) or 1.0
        return sorted(((name, v / whole) for name, v in means.items()), key=lambda t: (-t[1], t[0]))


def _curve_column(raw: Column, curve: tuple[list[float], list[float]]) -> Column:
    """The curve at a column, by the two knots around it; knots are found by bisection of a literal array."""
    xs, ys = curve

    @F.pandas_udf("double")
    def at(v):
        import pandas as pd

        return pd.Series(np.interp(v.to_numpy(), xs, ys))

    return at(raw)


def input_signature(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of the files' names, sizes and times, so that a changed input is another input."""
    from hashlib import md5

    seen = []
    for path in paths:
        meta = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        seen += sorted(tuple(map(str, r)) for r in meta.collect())
    return md5(repr(seen).encode()).hexdigest()


def saved_fit(features: DataFrame, name: str, **size) -> tuple[ChanceModel, DataFrame]:
    """The model and out-of-fold scores kept under `name` below the checkpoint folder; fitted and saved when they are not there."""
    spark = features.sparkSession
    base = f"{checkpoint_dir(spark)}/chance/{name}"
    try:
        return ChanceModel.load(spark, f"{base}/model"), spark.read.parquet(f"{base}/oof")
    except Exception as absent:  # noqa: BLE001  a missing path is an AnalysisException, a torn one a ValueError
        if not (isinstance(absent, ValueError) or "PATH_NOT_FOUND" in str(absent) or "UNABLE_TO_INFER_SCHEMA" in str(absent)):
            raise
    model, oof = ChanceModel.fit(features, **size)
    oof.write.mode("overwrite").parquet(f"{base}/oof")
    model.save(spark, f"{base}/model")
    return ChanceModel.load(spark, f"{base}/model"), spark.read.parquet(f"{base}/oof")
