"""Interval algebra: merge, cut into stints, active sets, point attribution.

Clocks are whole seconds, so every window over a game reads at most one row per second of play:
rows are reduced to (game, second) before any window, and facts are joined back on both columns.
A game with very many rows is therefore still spread over its seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S

#: Stints that are staffed together.
SPAN = 32


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str = "start_g", end: str = "end_g", label: str = "period"
) -> DataFrame:
    """Join overlapping intervals per key. Touching ones stay apart; the first label is kept.

    Also numbers the islands 1..n and adds their duration. Intervals sharing a start always merge,
    so they are reduced to one row per start (map-side) before the ordered pass.
    """
    keys = list(keys)
    one = df.groupBy(*keys, start).agg(
        F.max(end).alias("_far"), F.min(F.struct(F.col(end), F.col(label))).getField(label).alias(label)
    )
    w = Window.partitionBy(*keys).orderBy(start)
    reach = F.max("_far").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0)
    island = one.withColumn("_new", opened).withColumn("shift_number", F.sum("_new").over(w).cast("int"))
    out = island.groupBy(*keys, "shift_number").agg(
        F.min(start).alias(start),
        F.max("_far").alias(end),
        F.min_by(label, start).alias(label),
    )
    return out.withColumn("duration_s", (F.col(end) - F.col(start)).cast("int"))


def keep_known_teams(shifts: DataFrame, games: DataFrame) -> DataFrame:
    """Drop rows of teams that do not play in the game (no-op while the away team is unknown)."""
    g = games.select("game_id", "home_team", "away_team")
    ok = F.col("away_team").isNull() | F.col("team").isin(F.col("home_team"), F.col("away_team"))
    return shifts.join(g, "game_id").where(ok)


def game_clock(shifts: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """One row per (game, second) at which a shift edge or a point falls.

    `edge` numbers the edges from 0; `stint_shot` is the stint under (t0, t1], `stint_other` the one
    under [t0, t1) with the last edge inclusive. Both are null before the first stint and after the
    last one.
    """
    e = F.array("start_g", "end_g")
    edges = shifts.select("game_id", F.explode(e).alias("t"), F.lit(1).alias("_edge"))
    both = edges
    if points is not None:
        both = edges.unionByName(points.select("game_id", F.col("time_g").alias("t"), F.lit(0).alias("_edge")))
    grid = both.groupBy("game_id", "t").agg(F.max("_edge").alias("_edge"))
    return number_clock(grid)


def number_clock(grid: DataFrame) -> DataFrame:
    """Number the edges of a (game_id, t, _edge) grid and place every second in its stint."""
    game = Window.partitionBy("game_id")
    w = game.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = grid.withColumn("_le", F.sum("_edge").over(w) - 1).withColumn("_n", F.sum("_edge").over(game) - 1)
    lt = F.col("_le") - F.col("_edge")
    le = F.col("_le")
    ends_last = (F.col("_edge") == 1) & (le == F.col("_n"))
    return g.select(
        *[c for c in grid.columns if c != "_edge"],
        F.when(F.col("_edge") == 1, le).cast("int").alias("edge"),
        F.when((lt >= 0) & (lt < F.col("_n")), lt).cast("int").alias("stint_shot"),
        F.when((le >= 0) & (le < F.col("_n")), le).when(ends_last & (le > 0), F.col("_n") - 1).cast("int").alias("stint_other"),
        (le >= F.col("_n")).alias("at_or_after_end"),
        F.col("_n"),
    ).where("_n >= 1").drop("_n")


def attach_stint(points: DataFrame, clock: DataFrame, rule: str = "shot", clamp_tail: bool = False) -> DataFrame:
    """Points with the stint they belong to, by an equality join on (game, second).

    `clamp_tail` files points after the last edge under the last stint, as a timeline does.
    """
    col = "stint_shot" if rule == "shot" else "stint_other"
    c = clock.select("game_id", F.col("t").alias("time_g"), F.col(col).alias("stint_idx"), "at_or_after_end")
    out = points.join(c, ["game_id", "time_g"], "left")
    if clamp_tail:
        last = clock.groupBy("game_id").agg((F.max("edge") - 1).alias("_last"))
        out = out.join(last, "game_id", "left").withColumn(
            "stint_idx", F.coalesce("stint_idx", F.when(F.col("at_or_after_end"), F.col("_last")))
        ).drop("_last")
    return out.drop("at_or_after_end")


def elementary_intervals(shifts: DataFrame) -> DataFrame:
    """Consecutive pairs of distinct edges: (game_id, stint_idx, start_g, end_g, duration_s)."""
    edges = game_clock(shifts).select("game_id", "t", "edge")
    return cut_edges(edges)


def cut_edges(edges: DataFrame, *context: str) -> DataFrame:
    w = Window.partitionBy("game_id").orderBy("t")
    return (
        edges.withColumn("end_g", F.lead("t").over(w))
        .where("end_g is not null")
        .select(
            "game_id",
            F.col("edge").alias("stint_idx"),
            F.col("t").alias("start_g"),
            "end_g",
            (F.col("end_g") - F.col("t")).cast("int").alias("duration_s"),
            *context,
        )
    )


def presence(shifts: DataFrame, clock: DataFrame) -> DataFrame:
    """One row per (game, stint, player) the player's shifts cover, by two equality joins on edges."""
    edges = clock.where("edge is not null").select("game_id", "t", "edge")
    a = edges.select("game_id", F.col("t").alias("start_g"), F.col("edge").alias("_i"))
    b = edges.select("game_id", F.col("t").alias("end_g"), F.col("edge").alias("_j"))
    s = shifts.join(a, ["game_id", "start_g"]).join(b, ["game_id", "end_g"])
    return s.select("*", F.explode(F.sequence("_i", F.col("_j") - 1)).alias("stint_idx")).drop("_i", "_j")


def active_sets(present: DataFrame) -> DataFrame:
    """Personnel per stint from presence rows carrying `is_home` and `is_goalie`."""

    def skaters(home: bool) -> Column:
        side = (F.col("is_home") == home) & ~F.col("is_goalie")
        return F.array_sort(F.collect_set(F.when(side, F.col("player_id"))))

    def goalie(home: bool) -> Column:
        return F.max(F.when((F.col("is_home") == home) & F.col("is_goalie"), F.col("player_id")))

    return present.groupBy("game_id", "stint_idx").agg(
        skaters(True).alias("home_skaters"),
        skaters(False).alias("away_skaters"),
        goalie(True).alias("home_goalie"),
        goalie(False).alias("away_goalie"),
    )


def staffed(shifts: DataFrame, clock: DataFrame) -> DataFrame:
    """`active_sets` of the `presence` of these shifts, without a row for every player of every stint.

    A shift is filed under the groups of SPAN stints that it touches, and a group works out its stints.
    """
    edges = clock.where("edge is not null").select("game_id", "t", "edge")
    a = edges.select("game_id", F.col("t").alias("start_g"), F.col("edge").alias("_i"))
    b = edges.select("game_id", F.col("t").alias("end_g"), F.col("edge").alias("_j"))
    s = shifts.join(a, ["game_id", "start_g"]).join(b, ["game_id", "end_g"]).where("_i < _j")
    group = F.explode(F.sequence(F.floor(F.col("_i") / SPAN), F.floor((F.col("_j") - 1) / SPAN))).alias("_g")
    s = s.select("game_id", "_i", "_j", group, F.struct("player_id", "is_home", "is_goalie", "_i", "_j").alias("_p"))
    s = s.groupBy("game_id", "_g").agg(F.collect_list("_p").alias("_p"), F.min("_i").alias("_i"), F.max("_j").alias("_j"))
    first, last = F.greatest(F.col("_g") * SPAN, "_i").cast("int"), (F.least((F.col("_g") + 1) * SPAN, "_j") - 1).cast("int")
    s = s.select("game_id", F.explode(F.sequence(first, last)).alias("stint_idx"), "_p")
    on = F.filter("_p", lambda p: (p["_i"] <= F.col("stint_idx")) & (F.col("stint_idx") < p["_j"]))
    s = s.select("game_id", "stint_idx", on.alias("_p")).where(F.size("_p") > 0)

    def people(home: bool, goalie: bool) -> Column:
        side = F.filter("_p", lambda p: (p["is_home"] == home) & (p["is_goalie"] == goalie))
        return F.array_compact(F.transform(side, lambda p: p["player_id"]))

    return s.select(
        "game_id", "stint_idx",
        F.array_sort(F.array_distinct(people(True, False))).alias("home_skaters"),
        F.array_sort(F.array_distinct(people(False, False))).alias("away_skaters"),
        F.array_max(people(True, True)).alias("home_goalie"),
        F.array_max(people(False, True)).alias("away_goalie"),
    )


def event_seconds(events: DataFrame) -> DataFrame:
    """Events reduced to one context row per (game, second): goals by side and the last faceoff."""
    fo = F.col("type") == "faceoff"
    zone = F.when(F.col("is_home"), F.col("zone")).otherwise(S.flip_zone("zone"))
    known = fo & F.col("zone").isin("O", "D", "N")
    goal = (F.col("type") == "goal") & (F.col("period") < 5)
    return events.groupBy("game_id", F.col("time_g").alias("t")).agg(
        F.sum(F.when(goal, F.when(F.col("is_home"), 1).otherwise(-1)).otherwise(0)).alias("_diff"),
        F.max_by(F.when(known, zone), F.when(known, F.col("event_idx"))).alias("_fo_zone"),
        F.max(F.when(fo, 1).otherwise(0)).alias("_fo"),
    )


def context_clock(shifts: DataFrame, events: DataFrame) -> DataFrame:
    """The game clock with score lead and faceoff context at every edge or event second."""
    e = F.array("start_g", "end_g")
    none = F.lit(None)
    edges = shifts.select(
        "game_id", F.explode(e).alias("t"), F.lit(1).alias("_edge"), F.lit(0).cast("long").alias("_diff"),
        none.cast("string").alias("_fo_zone"), F.lit(0).alias("_fo"),
    )
    pts = event_seconds(events).withColumn("_edge", F.lit(0))
    grid = edges.unionByName(pts).groupBy("game_id", "t").agg(
        F.max("_edge").alias("_edge"), F.sum("_diff").alias("_diff"),
        F.max("_fo_zone").alias("fo_zone"), F.max("_fo").alias("_fo"),
    )
    w = Window.partitionBy("game_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = grid.withColumn("home_lead", F.sum("_diff").over(w)).drop("_diff")
    return number_clock(grid)


def stint_context(clock: DataFrame) -> DataFrame:
    """Stints with lead at the start, zone at both ends and how play started."""
    edges = clock.where("edge is not null").select("game_id", "t", "edge", "home_lead", "fo_zone", "_fo")
    w = Window.partitionBy("game_id").orderBy("t")
    edges = edges.withColumn("end_zone", F.lead("fo_zone").over(w))
    return cut_edges(
        edges,
        F.col("home_lead").cast("int").alias("home_lead"),
        F.col("fo_zone").alias("start_zone"),
        "end_zone",
        F.when(F.col("_fo") == 1, "faceoff").otherwise("fly").alias("start_type"),
    )


def stint_volume(events: DataFrame) -> DataFrame:
    """Point measures summed onto stints by shooting side, from events with stint_idx and xg.

    A blocked shot is owned by the blocking team, so its shooter is the other side.
    """
    side = F.when(F.col("type") == "blocked-shot", ~F.col("is_home")).otherwise(F.col("is_home"))
    rows = events.where(F.col("stint_idx").isNotNull() & F.col("type").isin(*S.CORSI)).select(
        "game_id", "stint_idx", side.alias("home"), F.col("xg").alias("xgf"), F.lit(1).alias("corsi"),
        F.col("type").isin(*S.FENWICK).cast("int").alias("fen"), F.col("type").isin(*S.SOG).cast("int").alias("sog"),
    )
    out = []
    for m in ("xgf", "corsi", "fen", "sog"):
        for s, home in (("home", True), ("away", False)):
            v = F.when(F.col("home") == home, F.col(m))
            out.append(F.coalesce(F.sum(v), F.lit(0)).alias(f"{s}_{m}"))
    return rows.groupBy("game_id", "stint_idx").agg(*out)


def build_stints(context: DataFrame, people: DataFrame, volume: DataFrame) -> DataFrame:
    """The stint table: interval, personnel, counts, strength, measures and context."""
    key = ["game_id", "stint_idx"]
    zero = {f"{s}_{m}": 0 for s in ("home", "away") for m in ("xgf", "corsi", "fen", "sog")}
    empty = F.array().cast("array<bigint>")
    out = (
        context.join(people, key, "left").join(volume, key, "left").fillna(zero)
        .withColumn("home_skaters", F.coalesce("home_skaters", empty))
        .withColumn("away_skaters", F.coalesce("away_skaters", empty))
    )
    return (
        out.withColumn("home_n", F.size("home_skaters"))
        .withColumn("away_n", F.size("away_skaters"))
        .withColumn("strength", S.strength_label("home_n", "away_n"))
        .withColumn("overload", (F.col("home_n") > 6) | (F.col("away_n") > 6))
        .withColumn("season", S.season_of_id("game_id"))
    )


def personnel_change(stints: DataFrame, col: str) -> DataFrame:
    """Who came on and went off compared with the stint before."""
    w = Window.partitionBy("game_id").orderBy("stint_idx")
    prev = F.lag(col).over(w)
    cur = F.col(col)
    none = F.array().cast("array<bigint>")
    return stints.withColumn("came_on", F.array_except(cur, F.coalesce(prev, none))).withColumn(
        "went_off", F.array_except(F.coalesce(prev, none), cur)
    )


def exposure(stints: DataFrame) -> DataFrame:
    """Seconds per player, season and strength seen from his own side ("5v4" is his power play)."""
    sides = stints.select(
        "season", "duration_s",
        F.explode(
            F.array(
                F.struct(F.col("home_skaters").alias("ids"), F.col("home_n").alias("own"), F.col("away_n").alias("opp")),
                F.struct(F.col("away_skaters").alias("ids"), F.col("away_n").alias("own"), F.col("home_n").alias("opp")),
            )
        ).alias("s"),
    )
    rows = sides.select("season", "duration_s", F.explode("s.ids").alias("player_id"), S.strength_label("s.own", "s.opp").alias("strength"))
    return rows.groupBy("player_id", "season", "strength").agg(F.sum("duration_s").alias("seconds"))
