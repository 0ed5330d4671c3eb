"""Sliced ranks equal pandas ranks, also when every group is cut into small slices."""

import random

import numpy as np
import pandas as pd
import pytest

from shiftgrain.models.scoring import quantiles
from shiftgrain.operators import ranking as R


@pytest.mark.parametrize("rows", [3, 40, 100_000])
def test_percentile_with_ties(spark, rows):
    rng = random.Random(1)
    pdf = pd.DataFrame({"g": [rng.choice("FD") for _ in range(200)], "v": [float(rng.randint(0, 20)) for _ in range(200)], "id": range(200)})
    got = R.tie_average_rank(spark.createDataFrame(pdf), ["g"], "v", "r", rows).toPandas().set_index("id").r.sort_index()
    want = pdf.set_index("id").groupby("g").v.rank(pct=True)
    assert np.allclose(got, want)


@pytest.mark.parametrize("rows", [3, 40, 100_000])
def test_ordinal_and_every_nth(spark, rows):
    pdf = pd.DataFrame({"id": range(101), "v": [float(i % 7) for i in range(101)]})
    df = spark.createDataFrame(pdf)
    got = R.ordinal(df, [], ["v", "id"], "pos", "n", rows).toPandas().sort_values("pos")
    want = pdf.sort_values(["v", "id"]).id.tolist()
    assert got.id.tolist() == want and set(got.n) == {101}
    assert sorted(r.id for r in R.every_nth(df, ["id"], 10, rows).collect()) == list(range(0, 100, 10))


def test_quantiles_match_numpy(spark):
    v = [float(x) for x in np.random.default_rng(2).normal(size=333)]
    got = {r.q: r.v for r in quantiles(spark.createDataFrame([(x,) for x in v], "x double"), "x", [0.05, 0.5, 0.95]).collect()}
    for q, x in got.items():
        assert abs(x - np.quantile(v, q)) < 1e-12


def test_slices_follow_the_size_of_the_group(spark):
    df = spark.range(20000).selectExpr("id", "IF(id < 19000, 'big', 'small') AS g")
    got = R._sliced(df, ["g"], "id", 500).groupBy("g").agg({"_slice": "max"}).collect()
    most = {r["g"]: r["max(_slice)"] for r in got}
    assert 20 <= most["big"] <= 60 and most["small"] <= 8
    assert R._sliced(df, ["g"], "id", 100_000).where("_slice > 0").isEmpty()
    per = R._sliced(df, ["g"], "id", 500).groupBy("g", "_slice").count().agg({"count": "max"}).first()[0]
    assert per < 19000 / 5
    inside = R._sliced(df, ["g"], "id", 500).groupBy("g", "_slice").agg({"id": "max"}).withColumnRenamed("max(id)", "top").orderBy("g", "_slice").collect()
    assert [r["top"] for r in inside] == sorted(r["top"] for r in inside)


def test_a_player_who_changes_position_has_one_group(spark):
    from shiftgrain.operators.rates import skater_groups

    roster = spark.createDataFrame([(1, 2021, "D"), (1, 2023, "C"), (2, 2022, "G"), (3, 2021, "L"), (3, 2022, "D")], "player_id long, season long, position string")
    assert sorted(tuple(r) for r in skater_groups(roster).collect()) == [(1, "F"), (3, "D")]
