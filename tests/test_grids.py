"""Shot grids and their blur against plain numpy; the grid's fixed values."""

import numpy as np

from shiftgrain.operators import grids as GR


def test_grid_covers_the_offensive_half():
    """25 cells of 3 feet from x = 25 to 100, 29 from y = -42.5; wide blur of three cells to each side."""
    assert (GR.X_LO, GR.Y_LO, GR.CELL, GR.N_X, GR.N_Y) == (25.0, -42.5, 3.0, 25, 29)
    assert (GR.SHOOTER_SHOTS, GR.GOALIE_SHOTS, GR.SIGMA) == (25, 100, 1.1)


def test_every_offensive_half_shot_is_counted(spark):
    rows = [(1, x, y, 0, 0.1) for x in [*range(25, 100), *range(-99, -24)] for y in (-42, -7, 0, 41)]
    rows += [(1, x, y, 0, 0.1) for x, y in ((24, 0), (100, 0), (30, -43), (None, 1))] + [(2, 30, 0, 1, None), (None, 30, 0, 0, 0.1)]
    cells = GR.shot_grid(spark.createDataFrame(rows, "who long, x int, y int, goal int, xg double"), "who", 1).collect()
    assert sum(r["s"] for r in cells if r["entity"] == 1) == 150 * 4
    assert {(r["ix"], r["iy"], r["s"], r["g"], r["xg"]) for r in cells if r["entity"] == 2} == {(1, 14, 1, 1, 0.0)}
    assert {r["entity"] for r in cells} == {1, 2} and max(r["ix"] for r in cells) == 24


def test_blur_equals_a_convolution(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    radius = round(3 * GR.SIGMA)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / GR.SIGMA) ** 2)
    k /= k.sum()
    for who in (1, 2):
        grid = np.zeros((GR.N_Y, GR.N_X))
        for _ in range(6):
            iy, ix = int(rng.integers(GR.N_Y)), int(rng.integers(GR.N_X))
            grid[iy, ix] = float(rng.integers(1, 9))
        rows += [(who, int(ix), int(iy), int(grid[iy, ix])) for iy, ix in zip(*np.nonzero(grid))]
        rowwise = np.apply_along_axis(lambda m: np.convolve(m, k, mode="same"), 1, grid)
        want[who] = np.apply_along_axis(lambda m: np.convolve(m, k, mode="same"), 0, rowwise)
    got = {1: np.zeros((GR.N_Y, GR.N_X)), 2: np.zeros((GR.N_Y, GR.N_X))}
    for r in GR.blur(spark.createDataFrame(rows, "entity long, ix long, iy long, s long"), ["s"]).collect():
        got[r["entity"]][r["iy"], r["ix"]] = r["s"]
    assert all(np.abs(got[w] - want[w]).max() < 1e-12 and ((got[w] > 0) == (want[w] > 0)).all() for w in want)
