"""Skills to goals: value equations, replacement archetypes, swap accounting, projections."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S
from shiftgrain.operators.ranking import ordinal_percentile

# Mates of a shooter, defenders by bucket, replacement band, goals per win.
MATES, DEFENDERS_EV, DEFENDERS_PK, BAND, GOALS_PER_WIN, EPS = 4, 5, 4, (8.0, 12.0), 6.0, 1e-9
NODES = 40


def beta_marginal(q, s, a, b, fin=0.0, nodes: int = NODES) -> Column:
    """Mean of sigmoid(a logit(x) + b + fin) over x ~ Beta(s q, s (1 - q)), as one expression.

    With u = x ** (s q) the density's singularity at zero vanishes; what is left is integrated on
    fixed Gauss-Legendre nodes held as a literal array.
    """
    q, s, a, b, fin = (x if isinstance(x, Column) else F.lit(float(x)) for x in (q, s, a, b, fin))
    x, w = np.polynomial.legendre.leggauss(nodes)
    grid = F.array(*[F.struct(F.lit(float(0.5 * (u + 1))).alias("u"), F.lit(float(0.5 * v)).alias("w")) for u, v in zip(x, w)])
    al, be = s * q, s * (1 - q)

    def add(acc: Column, n: Column) -> Column:
        xx = F.least(F.greatest(F.pow(n["u"], 1 / al), F.lit(1e-6)), F.lit(1 - 1e-6))
        d = n["w"] * F.pow(1 - xx, be - 1)
        return F.struct((acc["n"] + d * S.sigmoid(a * F.log(xx / (1 - xx)) + b + fin)).alias("n"), (acc["d"] + d).alias("d"))

    return F.aggregate(grid, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d")), add, lambda r: r["n"] / r["d"])


def creator_mix(psi0, is_d, even: bool = True) -> tuple[Column, Column, Column]:
    """Weights of an unassisted, a forward-created and a defender-created shot."""
    p0 = F.exp(psi0 if isinstance(psi0, Column) else F.lit(float(psi0)))
    w0 = p0 / (p0 + 4.0)
    fwd = F.when(F.col(is_d) > 0, 3.0 if even else 4.0).otherwise(2.0 if even else 3.0)
    wf = (1 - w0) * fwd / 4.0
    return w0, wf, 1 - w0 - wf


def player_values(p: DataFrame, c: Mapping[str, float], even: bool = True) -> DataFrame:
    """Scoring, playmaking and defence per 60 from skills and creator-class goals per shot.

    `p`: is_d, sh, cr, df, g0, gF, gD, qd, cq. `c`: mu (log rate), mq (quality intercept), psi0, env,
    qc_F and qc_D.
    """
    col = F.col
    w0, wf, wd = creator_mix(c["psi0"], "is_d", even)
    n_def = DEFENDERS_EV if even else DEFENDERS_PK
    rate, env = F.exp(F.lit(c["mu"])), c["env"]
    qc = c["mq"] + F.when(col("is_d") > 0, c["qc_D"]).otherwise(c["qc_F"])
    made = MATES * rate * ((F.exp("cr") - 1) * S.sigmoid(qc) + F.exp("cr") * (S.sigmoid(qc + col("cq")) - S.sigmoid(qc)))
    return p.select(
        "*",
        (env * F.exp(c["mu"] + col("sh")) * (w0 * col("g0") + wf * col("gF") + wd * col("gD"))).alias("scoring"),
        (env * made).alias("playmaking"),
        (env * n_def * (rate * S.sigmoid(F.lit(c["mq"])) - F.exp(c["mu"] + col("df")) * S.sigmoid(c["mq"] + col("qd")))).alias("defence"),
    )


def conversion_per_chance(a: float, b: float, mq: float) -> float:
    """League goals per unit of chance value at the average shot."""
    q = 1 / (1 + np.exp(-mq))
    return float(1 / (1 + np.exp(-(a * np.log(q / (1 - q)) + b))) / q)


def weighted_mean(v: str, w: str, cond: Column) -> Column:
    ww = F.when(cond, F.col(w))
    return F.sum(F.col(v) * ww) / F.greatest(F.sum(ww), F.lit(EPS))


def goals_above(p: DataFrame, gate: float, kap: float) -> DataFrame:
    """Goals above the position's weighted mean per 60, and its percentile within position."""
    ok = F.col("toi") >= gate
    base = p.groupBy("is_d").agg(*[weighted_mean(v, "toi", ok).alias(f"b_{v}") for v in ("scoring", "playmaking", "defence")])
    d = p.join(F.broadcast(base), "is_d")
    ga = (F.col("scoring") - F.col("b_scoring")) + kap * (F.col("playmaking") - F.col("b_playmaking")) + kap * (F.col("defence") - F.col("b_defence"))
    d = d.withColumn("ga60", ga).withColumn("_e", F.when(ok, F.col("ga60"))).drop("b_scoring", "b_playmaking", "b_defence")
    return ordinal_percentile(d, ["is_d"], "_e", "player_id", "ga60_pct").drop("_e")


def archetypes(p: DataFrame, cols: list[str], gate: float, band: tuple[float, float] = BAND) -> DataFrame:
    """Replacement level per position: weighted means over the percentile band, else over all eligible."""
    ok = F.col("toi") >= gate
    inside = ok & F.col("ga60_pct").between(*band)
    hit = F.count_if(inside) > 0
    return p.groupBy("is_d").agg(*[F.when(hit, weighted_mean(c, "toi", inside)).otherwise(weighted_mean(c, "toi", ok)).alias(f"r_{c}") for c in cols])


SKILLS = ("sh", "cr", "g0", "gF", "gD")


def swap_rows(sides: DataFrame, skills: DataFrame, base: Column) -> DataFrame:
    """Slots of every side row with the row's totals.

    `sides`: key columns, attackers, defenders, duration_s, gsave (log-odds of the facing goalie).
    `skills`: player_id, is_d, sh, cr, df, g0, gF, gD, kq, cq, slope0, slopeF, slopeD (change of goals per shot with cq) and their replacement r_*.
    A side has five attackers and at most five defenders, so the row window holds ten rows.
    """
    key = ["game_id", "stint_idx", "home"]
    slot = lambda role: lambda p: F.struct(p.alias("player_id"), F.lit(role).alias("atk"))
    rows = sides.select(*key, "duration_s", "gsave", base.alias("_cx"), *[c for c in ("season", "atk_team", "def_team") if c in sides.columns],
                        F.explode(F.concat(F.transform("attackers", slot(True)), F.transform("defenders", slot(False)))).alias("s"))
    rows = rows.select("*", "s.player_id", "s.atk").drop("s").join(skills, "player_id")
    w = Window.partitionBy(*key)
    a, col = F.col("atk"), F.col
    tot = lambda e: F.sum(F.when(a, e)).over(w)
    ecr = F.exp("cr")
    fwd = F.when(col("is_d") < 0.5, ecr).otherwise(0.0)
    p0 = F.exp(col("psi0"))
    rows = rows.withColumn("_mates", tot(ecr) - ecr).withColumn("_mates_f", tot(fwd) - fwd).withColumn("_mates_d", col("_mates") - col("_mates_f")).withColumn("_norm", p0 + col("_mates"))
    rows = rows.withColumn("_delta", tot(col("cq")) - col("cq"))
    mix = lambda x, y, z: (p0 * col(x) + col("_mates_f") * col(y) + col("_mates_d") * col(z)) / col("_norm")
    tilt = lambda g: F.exp((1 - col(g)) * col("gsave"))
    lead = F.exp(col("sh") - col("cr")) * tilt("g0")
    rows = rows.withColumn("_term", lead * (mix("g0", "gF", "gD") + mix("slope0", "slopeF", "slopeD") * col("_delta"))).withColumn("_sens", lead * mix("slope0", "slopeF", "slopeD"))
    rows = rows.withColumn("_total", tot(col("_term"))).withColumn("_sens_total", tot(col("_sens"))).withColumn("_cr", tot(col("cr")))
    guard = F.sum(F.when(~a, col("df") + F.log(F.greatest("kq", F.lit(EPS))))).over(w)
    rows = rows.withColumn("_env", col("_cx") * F.exp(col("_cr") + F.coalesce(guard, F.lit(0.0))) * col("duration_s") / 3600.0)
    rows = rows.withColumn("E", col("_env") * col("_total"))
    swap_t = F.exp(col("r_sh") - col("r_cr")) * (mix("r_g0", "r_gF", "r_gD") + mix("r_slope0", "r_slopeF", "r_slopeD") * col("_delta")) * tilt("r_g0")
    cross = (col("r_cq") - col("cq")) * (col("_sens_total") - col("_sens"))
    swapped = col("_env") * F.exp(col("r_cr") - col("cr")) * (col("_total") - col("_term") + swap_t + cross)
    ratio = F.exp(col("r_df") - col("df")) * F.greatest("r_kq", F.lit(EPS)) / F.greatest("kq", F.lit(EPS))
    rows = rows.withColumn("gar", F.when(a, col("E") - swapped).otherwise(col("E") * (ratio - 1)))
    return rows.drop("_mates", "_mates_f", "_mates_d", "_norm", "_delta", "_term", "_sens", "_total", "_sens_total", "_cr", "_env", "_cx")


def swap_totals(slots: DataFrame, *keys: str) -> DataFrame:
    """Goals above replacement per player, attack and defence apart, and wins."""
    g = lambda c: F.coalesce(F.sum(F.when(c, F.col("gar"))), F.lit(0.0))
    out = slots.groupBy("player_id", *keys).agg(g(F.col("atk")).alias("gar_atk"), g(~F.col("atk")).alias("gar_def"))
    return out.withColumn("war", (F.col("gar_atk") + F.col("gar_def")) / GOALS_PER_WIN)


def team_net(slots: DataFrame) -> DataFrame:
    """Expected goals for less against per team; each side row counts once."""
    one = slots.groupBy("game_id", "stint_idx", "home").agg(F.first("E").alias("E"), F.first("atk_team").alias("a"), F.first("def_team").alias("d"))
    both = one.select(F.explode(F.array(F.struct(F.col("a").alias("team"), F.col("E").alias("v")), F.struct(F.col("d").alias("team"), (-F.col("E")).alias("v")))).alias("x")).select("x.*")
    return both.groupBy("team").agg(F.sum("v").alias("net"))


def audit(team: DataFrame, actual: DataFrame) -> DataFrame:
    """Model net, sum of individual swaps and actual goal difference side by side, with correlations."""
    j = team.join(actual, "team")
    return j.agg(F.count(F.lit(1)).alias("teams"), F.corr("net", "diff").alias("corr_net"), F.corr("gar", "diff").alias("corr_gar"), (F.sum("gar") / F.greatest(F.sum(F.abs("net")), F.lit(EPS))).alias("synergy"))


def block_curve(z: Column, is_d: Column, coef: Mapping[str, float]) -> Column:
    """Position-split quadratic age curve plus the defenders' offset."""
    c = lambda k: F.lit(float(coef.get(k, 0.0)))
    return (1 - is_d) * (c("zF") * z + c("z2F") * z * z) + is_d * (c("zD") * z + c("z2D") * z * z + c("D"))


def effective(states: DataFrame, blocks: Mapping[str, Mapping[str, float]], target: int | None = None) -> DataFrame:
    """A player's last state plus curve; with `target` the age moves on while the state stays."""
    last = states.groupBy("player_id").agg(F.max("season").alias("last_season"), F.max_by(F.struct("is_d", "z", "age", *blocks), "season").alias("s")).select("player_id", "last_season", "s.*")
    z = F.col("z")
    if target is not None:
        z = F.when(F.col("age").isNotNull(), z + (F.lit(target) - F.col("last_season")) / S.AGE_SCALE).otherwise(z)
    return last.select("player_id", "last_season", "is_d", *[(F.col(b) + block_curve(z, F.col("is_d"), c)).alias(b) for b, c in blocks.items()])


def environment(rows: DataFrame, params: DataFrame, ctx: Mapping[str, float]) -> DataFrame:
    """Time-weighted mean of exp(mates' creation + defenders' states + context) over count rows."""
    slot = lambda role: lambda p: F.struct(p.alias("player_id"), F.lit(role).alias("mate"))
    key = ["game_id", "stint_idx", "home", "shooter_id"]
    s = rows.select(*key, "dur", *ctx, F.explode(F.concat(F.transform("mates", slot(True)), F.transform("defenders", slot(False)))).alias("s")).select("*", "s.*")
    s = s.join(params.select("player_id", "cr", "df"), "player_id")
    eta = s.groupBy(*key).agg(F.first("dur").alias("dur"), (F.sum(F.when(F.col("mate"), F.col("cr")).otherwise(F.col("df")))).alias("e"), *[F.first(c).alias(c) for c in ctx])
    total = F.col("e")
    for n, v in ctx.items():
        total = total + v * F.col(n)
    return eta.agg((F.sum(F.col("dur") * F.exp(total)) / F.sum("dur")).alias("env"))


def aging_table(spark, curves: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Curve values at ages 18 to 40 per block and position."""
    cells = [(b, age, pos) for b in curves for age in range(18, 41, 2) for pos in ("F", "D")]
    t = spark.createDataFrame(cells, "block string, age int, pos string")
    z, d = (F.col("age") - S.AGE_PEAK) / S.AGE_SCALE, (F.col("pos") == "D").cast("double")
    v = F.lit(None).cast("double")
    for b, c in curves.items():
        v = F.when(F.col("block") == b, block_curve(z, d, c)).otherwise(v)
    return t.withColumn("value", v)


def trajectory(values: DataFrame, reference: Column) -> DataFrame:
    """Season values per player in order, each beside the average player's value at that age."""
    line = F.struct("season", "value", reference.alias("league"))
    return values.groupBy("player_id").agg(F.array_sort(F.collect_list(line)).alias("seasons"))
