"""Binned grids, their separable blur, and prediction grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S

# The rink grid's origin, cell size and number of cells along x and y (to x = 100, y = 44.5), the
# shots that an entity needs for a grid, and the blur's width in cells.
X_LO, Y_LO, CELL, N_X, N_Y = 25.0, -42.5, 3.0, 25, 29
SHOOTER_SHOTS, GOALIE_SHOTS, SIGMA = 25, 100, 1.1


def shot_grid(shots: DataFrame, entity: str, min_shots: int) -> DataFrame:
    """Shots, goals and chance value per cell of each entity with enough shots on the grid.

    Both ends are folded onto the attacking net. The volume gate is a grouped total joined back, so
    a busy entity is never gathered in one place.
    """
    fold = F.when(F.col("x") >= 0, 1).otherwise(-1)
    ix = S.grid_cell(F.col("x") * fold, X_LO, CELL, N_X)
    iy = S.grid_cell(F.col("y") * fold, Y_LO, CELL, N_Y)
    s = shots.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), ix.alias("ix"), iy.alias("iy"), "goal", "xg")
    cells = s.where("ix is not null and iy is not null").groupBy("entity", "ix", "iy").agg(
        F.count(F.lit(1)).alias("s"), F.sum("goal").alias("g"), F.coalesce(F.sum("xg"), F.lit(0.0)).alias("xg")
    )
    big = cells.groupBy("entity").agg(F.sum("s").alias("_n")).where(F.col("_n") >= min_shots).select("entity")
    return cells.join(big, "entity", "left_semi")


def blur(cells: DataFrame, measures: list[str], sigma: float = SIGMA) -> DataFrame:
    """Separable Gaussian blur, zero-padded at the borders: along x, then along y; rows of cells that it reaches.

    One shuffle by entity makes dense grids of N_X * N_Y numbers a measure, and both passes run inside them.
    """
    r = max(1, round(3 * sigma))
    w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    taps = [(d, v / sum(w)) for d, v in zip(range(-r, r + 1), w)]
    own = F.map_from_entries(F.collect_list(F.struct((F.col("iy") * N_X + F.col("ix")).alias("c"), F.struct(*[F.col(m).cast("double").alias(m) for m in measures]).alias("v"))))
    grids = cells.groupBy("entity").agg(own.alias("own"))
    every = F.sequence(F.lit(0), F.lit(N_X * N_Y - 1))

    def dense(m: str) -> Column:
        return F.transform(every, lambda c: F.coalesce(F.try_element_at("own", c)[m], F.lit(0.0)))

    def smoothed(m: str, along_x: bool) -> Column:
        step, n = (1, N_X) if along_x else (N_X, N_Y)

        def cell(c: Column) -> Column:
            at = c % N_X if along_x else F.floor(c / N_X)
            return sum((F.when((at + d).between(0, n - 1), F.get(m, c + d * step) * v).otherwise(0.0) for d, v in taps), F.lit(0.0))

        return F.transform(every, cell)

    grids = grids.withColumns({m: dense(m) for m in measures})
    for along_x in (True, False):
        grids = grids.withColumns({m: smoothed(m, along_x) for m in measures})
    long = grids.select("entity", F.posexplode(F.arrays_zip(*measures)).alias("c", "v"))
    reached = long.where(" OR ".join(f"v.`{m}` <> 0" for m in measures))
    return reached.select("entity", (F.col("c") % N_X).alias("ix"), F.floor(F.col("c") / N_X).cast("int").alias("iy"), *[F.col("v")[m].alias(m) for m in measures])


def grid_rows(cells: DataFrame, measure: str) -> DataFrame:
    """Long cells to one `array<array<double>>` per entity, zero where a cell is empty."""
    by_cell = F.map_from_entries(F.collect_list(F.struct((F.col("iy") * N_X + F.col("ix")).alias("c"), F.col(measure).alias("v"))))
    m = cells.groupBy("entity").agg(by_cell.alias("m"))

    def cell(i: Column, j: Column) -> Column:
        return F.coalesce(F.element_at("m", i * N_X + j), F.lit(0.0))

    grid = F.transform(F.sequence(F.lit(0), F.lit(N_Y - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(N_X - 1)), lambda j: cell(i, j)))
    return m.select("entity", grid.alias(measure))


def prediction_grid(toggles: DataFrame) -> DataFrame:
    """Every offensive-zone grid point crossed with the few values of a toggle (32 x 43 points each)."""
    xs, ys = F.sequence(F.lit(26), F.lit(88), F.lit(2)), F.sequence(F.lit(-42), F.lit(42), F.lit(2))
    return toggles.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))
