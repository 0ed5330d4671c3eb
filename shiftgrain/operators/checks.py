"""Invariant checks: every check is one aggregate over a table, reported as one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S

COLUMNS = ("stage", "name", "kind", "status", "observed", "low", "high")


def report(df: DataFrame, stage: str, rules: list[tuple[str, str, Column, float | None, float | None]]) -> DataFrame:
    """Evaluate all `rules` (name, exact|approx, aggregate, low, high) in one pass over `df`.

    An aggregate over no rows is null and gives status `skip`; outside [low, high] an exact rule
    gives `fail` and an approximate one `warn`.
    """
    one = df.agg(*[r[2].cast("double").alias(f"v{i}") for i, r in enumerate(rules)])
    cells = [
        F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.col(f"v{i}").alias("observed"),
                 F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high"))
        for i, (n, k, _, lo, hi) in enumerate(rules)
    ]
    rows = one.select(F.explode(F.array(*cells)).alias("c")).select(F.lit(stage).alias("stage"), "c.*")
    out = F.coalesce(F.col("observed") < F.col("low"), F.lit(False)) | F.coalesce(F.col("observed") > F.col("high"), F.lit(False))
    bad = F.when(F.col("kind") == "exact", "fail").otherwise("warn")
    status = F.when(F.col("observed").isNull(), "skip").when(out, bad).otherwise("pass")
    return rows.withColumn("status", status).select(*COLUMNS)


def combine(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def violations(cond: Column) -> Column:
    return F.count_if(cond)


def none_of(name: str, cond: Column):
    return (name, "exact", F.when(F.count(F.lit(1)) > 0, violations(cond)), 0, 0)


def stint_order(stints: DataFrame) -> DataFrame:
    """Stints with the next start and their position; a game has at most one stint per second."""
    w = Window.partitionBy("game_id").orderBy("start_g")
    return stints.withColumn("next_start", F.lead("start_g").over(w)).withColumn("position", F.row_number().over(w) - 1)


def check_shifts(shifts: DataFrame) -> DataFrame:
    w = Window.partitionBy("game_id", "player_id").orderBy("start_g", "end_g")
    s = shifts.withColumn("_next", F.lead("start_g").over(w))
    return report(s, "shifts", [
        none_of("duration is end minus start and positive", (F.col("duration_s") != F.col("end_g") - F.col("start_g")) | (F.col("duration_s") <= 0)),
        none_of("no overlap per player", F.col("_next") < F.col("end_g")),
    ])


def check_unique_shots(shots: DataFrame) -> DataFrame:
    n = shots.groupBy("game_id", "event_idx").agg(F.count(F.lit(1)).alias("n"))
    return report(n, "shots", [none_of("unique (game, event)", F.col("n") > 1)])


def check_stints(stints: DataFrame) -> DataFrame:
    s = stint_order(stints)
    label = S.strength_label("home_n", "away_n")
    return report(s, "stints", [
        none_of("duration", (F.col("duration_s") != F.col("end_g") - F.col("start_g")) | (F.col("duration_s") <= 0)),
        none_of("no gap or overlap", F.col("next_start") != F.col("end_g")),
        none_of("index follows time", F.col("stint_idx") != F.col("position")),
        none_of("counts match personnel", (F.col("home_n") != F.size("home_skaters")) | (F.col("away_n") != F.size("away_skaters"))),
        none_of("strength label", F.col("strength") != label),
        ("overload rate", "approx", F.avg(F.col("overload").cast("int")), 0.0, 0.001),
    ])


def check_shot_sums(stints: DataFrame, onice: DataFrame) -> DataFrame:
    a = stints.groupBy("game_id").agg(F.sum(F.col("home_xgf") + F.col("away_xgf")).alias("stint_xg"), F.max("stint_idx").alias("last"))
    b = onice.groupBy("game_id").agg(
        F.coalesce(F.sum("xg"), F.lit(0.0)).alias("shot_xg"), F.max("stint_idx").alias("hi"), F.min("stint_idx").alias("lo"),
        F.count_if(~F.col("goal").isin(0, 1)).alias("bad_goal"),
    )
    j = a.join(b, "game_id", "left")
    return report(j, "shots_onice", [
        none_of("stint sums equal shot sums", F.abs(F.col("stint_xg") - F.coalesce("shot_xg", F.lit(0.0))) > 0.02),
        none_of("stint index in range", (F.col("hi") > F.col("last")) | (F.col("lo") < 0)),
        none_of("goal is 0 or 1", F.col("bad_goal") > 0),
    ])


def check_onice(onice: DataFrame) -> DataFrame:
    near = F.col("onice_match").isin("exact", "within1").cast("int")
    sit = S.strength_label("sit_home_n", "sit_away_n")
    goal = F.col("goal") == 1
    return report(onice, "onice", [
        ("match share", "approx", F.avg(near), 0.97, 1.0),
        ("goal strength mismatch", "approx", F.avg(F.when(goal, (F.col("strength") != sit).cast("int"))), 0.0, 0.03),
    ])


def check_calibration(shots: DataFrame) -> DataFrame:
    per = shots.where("xg is not null").groupBy("season").agg(F.sum("xg").alias("x"), F.sum("goal").alias("g"))
    return report(per, "chance", [
        ("season calibration worst", "approx", F.max(F.abs(F.col("x") / F.col("g") - 1)), 0.0, 0.04),
        ("pooled calibration", "approx", F.sum("x") / F.sum("g") - 1, -0.005, 0.005),
    ])


def check_duel_identity(decomposed: DataFrame, fin: DataFrame, gol: DataFrame) -> DataFrame:
    """League identity of the duel decomposition and the magnitude bands of its tables."""
    a = report(decomposed, "duels", [
        ("league identity", "exact", F.abs(F.sum(F.col("goal") - F.col("recon"))), 0.0, 0.5),
        ("intercept is small", "approx", F.abs(F.max("mu")), 0.0, 0.02),
    ])
    b = report(fin, "finishing", [
        none_of("goals are rate times shots", F.abs(F.col("fin_goals") - F.col("alpha") * F.col("shots")) > 0.01),
        ("largest rate per 100", "approx", F.max(F.abs(F.col("alpha") * 100)), 0.0, 10.0),
    ])
    c = report(gol, "saving", [none_of("saved is minus rate times shots", F.abs(F.col("gsax_saved") + F.col("gamma") * F.col("sa")) > 0.01)])
    return combine(a, b, c)


def check_team_accounts(team: DataFrame) -> DataFrame:
    return report(team, "accounts", [
        none_of("goals-for components", F.abs(F.col("gf_recon") - F.col("xgf") - F.col("mu_for") - F.col("fin_for") - F.col("opp_goalie")) > 0.01),
        none_of("goals-against components", F.abs(F.col("ga_recon") - F.col("xga") - F.col("mu_against") - F.col("opp_fin") - F.col("own_goalie")) > 0.01),
        ("mean absolute gap share", "approx", F.avg(F.abs(F.col("gf_gap")) / F.col("gf")), 0.0, 0.12),
    ])


def check_share_closure(shares: DataFrame) -> DataFrame:
    """Created and allowed shares summed over players against the league total."""
    return report(shares, "shares", [
        ("created over league", "approx", F.sum("created") / F.max("league_xgf") - 1, -0.05, 0.05),
        ("allowed over league", "approx", F.sum("allowed") / F.max("league_xgf") - 1, -0.05, 0.05),
    ])


def check_log_against_box(log: DataFrame, box: DataFrame) -> DataFrame:
    a = log.where(S.is_regular("game_id")).groupBy("player_id", "season").agg(F.sum("g").alias("g1"), F.sum("sog").alias("s1"), F.sum("toi_s").alias("t1"))
    b = box.where("game_type = 'regular'").select("player_id", "season", "g", "sog", "toi_s")
    j = a.join(b, ["player_id", "season"])
    return report(j, "gamelog", [
        none_of("goals", F.col("g1") != F.col("g")), none_of("shots on goal", F.col("s1") != F.col("sog")),
        none_of("ice time", F.col("t1") != F.col("toi_s")),
    ])


def check_goalies(box: DataFrame) -> DataFrame:
    parts = F.col("ld_sa") + F.col("md_sa") + F.col("hd_sa")
    return report(box, "goalies", [
        none_of("saves", F.col("saves") != F.col("sog_against") - F.col("ga")),
        none_of("goals saved above expected", F.abs(F.col("gsax") - (F.col("xga") - F.col("ga"))) > 1e-6),
        none_of("danger split closes", parts != F.col("sa")),
    ])


def check_ledger(ledger: DataFrame, percentiles: list[str]) -> DataFrame:
    net = F.col("g_created") + F.col("g_fin") - F.col("g_allowed") + F.col("g_pen")
    pct = [none_of(f"{p} in range", (F.col(p) < 0) | (F.col(p) > 100)) for p in percentiles]
    return report(ledger, "ledger", [
        none_of("net is the sum of its parts", F.abs(F.col("g_net") - net) > 0.3),
        ("negative shares", "approx", F.avg((F.col("scoring60") + F.col("playmaking60") < 0).cast("int")), 0.0, 0.05),
        *pct,
    ])


def check_documents(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Sampled game documents: totals, parseable JSON without NaN, present for every index row."""
    j = index.join(docs, "game_id", "left")
    return report(j, "documents", [
        none_of("document present", F.col("doc").isNull()),
        none_of("no NaN or Infinity", F.col("doc").rlike(r":(NaN|-?Infinity)")),
        none_of("totals equal stint sums", F.abs(F.get_json_object("doc", "$.totals.home_xgf").cast("double") - F.col("home_xgf")) > 0.01),
    ])


def health(onice: DataFrame, stints: DataFrame, after_last: DataFrame) -> DataFrame:
    """Season quality rates: match classes, illegal stints, shots after the last stint."""
    m = F.col("onice_match")
    a = onice.groupBy("season").agg(
        F.count(F.lit(1)).alias("shots"), F.count_if(m == "exact").alias("exact"),
        F.count_if(m == "within1").alias("within1"), F.count_if(m == "large").alias("large"),
    )
    b = stints.groupBy(F.col("season").cast("long").alias("season")).agg(F.count(F.lit(1)).alias("stints"), F.count_if("overload").alias("illegal"), F.countDistinct("game_id").alias("games"))
    return a.join(b, "season").join(after_last, "season", "left").fillna(0, ["after_last"])
