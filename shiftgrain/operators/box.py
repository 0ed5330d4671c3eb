"""Box scores, game logs and goalie lines as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S

# The counters of a box line, in the order they are published.
STATS = (
    "g", "a1", "a2", "sog", "icf", "blocks", "hits", "takeaways", "giveaways",
    "fo_won", "fo_lost", "pen_taken", "pen_drawn", "so_g", "so_att",
)
# Fixed values: (event kind, role column) -> counters, in flow play and in the shootout.
FLOW_CREDITS = (
    ("goal", "primary_player_id", ("g", "sog", "icf")),
    ("goal", "assist1_player_id", ("a1",)),
    ("goal", "assist2_player_id", ("a2",)),
    ("shot-on-goal", "primary_player_id", ("sog", "icf")),
    ("missed-shot", "primary_player_id", ("icf",)),
    ("blocked-shot", "secondary_player_id", ("blocks",)),
    ("blocked-shot", "primary_player_id", ("icf",)),
    ("hit", "primary_player_id", ("hits",)),
    ("faceoff", "primary_player_id", ("fo_won",)),
    ("faceoff", "secondary_player_id", ("fo_lost",)),
    ("penalty", "primary_player_id", ("pen_taken",)),
    ("penalty", "secondary_player_id", ("pen_drawn",)),
    ("giveaway", "primary_player_id", ("giveaways",)),
    ("takeaway", "primary_player_id", ("takeaways",)),
)
SHOOTOUT_CREDITS = (
    ("goal", "primary_player_id", ("so_g", "so_att")),
    ("shot-on-goal", "primary_player_id", ("so_att",)),
    ("missed-shot", "primary_player_id", ("so_att",)),
)


def credits(events: DataFrame, *carry: str) -> DataFrame:
    """One row per (event, credited player, counter): a single explode over the event scan."""
    rules = []
    for so, table in ((False, FLOW_CREDITS), (True, SHOOTOUT_CREDITS)):
        for kind, role, stats in table:
            hit = (F.col("type") == kind) & ((F.col("period") >= 5) == so)
            for st in stats:
                rules.append(F.when(hit, F.struct(F.col(role).alias("player_id"), F.lit(st).alias("stat"))))
    rows = events.select(*carry, F.explode(F.array_compact(F.array(*rules))).alias("c"))
    return rows.select(*carry, "c.player_id", "c.stat").where("player_id is not null")


def counters(credit_rows: DataFrame, *keys: str) -> DataFrame:
    """Counters per player (and `keys`), with points."""
    agg = [F.count_if(F.col("stat") == s).alias(s) for s in STATS]
    return credit_rows.groupBy(*keys, "player_id").agg(*agg).withColumn("points", F.col("g") + F.col("a1") + F.col("a2"))


def game_type(game_id: str = "game_id") -> Column:
    return F.when(S.is_regular(game_id), "regular").otherwise("playoff")


def ice_time(shifts: DataFrame, *keys: str) -> DataFrame:
    """Games, seconds, primary team (most games, then name) and team list per player."""
    per_team = shifts.groupBy(*keys, "player_id", "team", "game_id").agg(F.sum("duration_s").alias("s"))
    per_team = per_team.groupBy(*keys, "player_id", "team").agg(F.count(F.lit(1)).alias("games"), F.sum("s").alias("s"))
    order = F.struct((-F.col("games")).alias("neg"), F.col("team"))
    out = per_team.groupBy(*keys, "player_id").agg(
        F.sum("games").alias("gp"), F.sum("s").alias("toi_s"),
        F.transform(F.array_sort(F.collect_list(order)), lambda r: r["team"]).alias("teams"),
    )
    return out.withColumn("team", F.element_at("teams", 1))


ONICE = (
    "ev_xgf_on", "ev_xga_on", "ev_cf_on", "ev_ca_on", "ev_onice_s", "pp_xgf_on", "pp_onice_s",
    "pk_xga_on", "pk_onice_s", "ev_oz_starts", "ev_dz_starts",
)


def onice_sums(stints: DataFrame) -> DataFrame:
    """Sums over every qualifying stint a player was on the ice, by strength, from his own side."""
    st = stints.where(S.is_regular("game_id") & ~F.col("overload") & (F.col("duration_s") >= 10))

    def side(own: str, opp: str, zone: Column) -> Column:
        return F.struct(
            F.col(f"{own}_skaters").alias("ids"), F.col(f"{own}_n").alias("n"), F.col(f"{opp}_n").alias("m"),
            F.col(f"{own}_xgf").alias("xgf"), F.col(f"{opp}_xgf").alias("xga"),
            F.col(f"{own}_corsi").alias("cf"), F.col(f"{opp}_corsi").alias("ca"), zone.alias("zone"),
        )

    sides = F.array(side("home", "away", F.col("start_zone")), side("away", "home", S.flip_zone("start_zone")))
    rows = st.select("season", "duration_s", "strength", F.explode(sides).alias("s")).select(
        "season", "duration_s", "strength", "s.*"
    ).select("*", F.explode("ids").alias("player_id"))
    ev = F.col("strength") == "5v5"
    pp, pk = ~ev & (F.col("n") > F.col("m")), ~ev & (F.col("n") < F.col("m"))

    def total(cond: Column, v) -> Column:
        return F.sum(F.when(cond, v).otherwise(0))

    d = F.col("duration_s")
    return rows.groupBy("player_id", "season").agg(
        total(ev, F.col("xgf")).alias("ev_xgf_on"), total(ev, F.col("xga")).alias("ev_xga_on"),
        total(ev, F.col("cf")).alias("ev_cf_on"), total(ev, F.col("ca")).alias("ev_ca_on"),
        total(ev, d).alias("ev_onice_s"),
        total(pp, F.col("xgf")).alias("pp_xgf_on"), total(pp, d).alias("pp_onice_s"),
        total(pk, F.col("xga")).alias("pk_xga_on"), total(pk, d).alias("pk_onice_s"),
        total(ev & (F.col("zone") == "O"), 1).alias("ev_oz_starts"),
        total(ev & (F.col("zone") == "D"), 1).alias("ev_dz_starts"),
    )


def season_box(shifts: DataFrame, events: DataFrame, roster: DataFrame, stints: DataFrame) -> DataFrame:
    """Box table per (player, season, game type); on-ice sums only on regular-season rows."""
    keys = ["season", "game_type"]
    ice = ice_time(shifts.withColumn("game_type", game_type()), *keys)
    cnt = counters(credits(events.withColumn("game_type", game_type()), *keys), *keys)
    ox = onice_sums(stints).withColumn("game_type", F.lit("regular"))
    names = roster.select("player_id", "season", F.col("player_name").alias("name"), F.col("position").alias("pos"))
    out = ice.join(cnt, [*keys, "player_id"], "left").join(names, ["player_id", "season"], "left")
    out = out.join(ox, [*keys, "player_id"], "left").fillna(0, [*STATS, "points", *ONICE])
    return out.withColumn("toi_min", F.bround(F.col("toi_s") / 60.0, 1))


def game_scores(headers: DataFrame, events: DataFrame) -> DataFrame:
    """Header plus goals of regulation and overtime and whether overtime was reached."""
    goal = (F.col("type") == "goal") & (F.col("period") < 5)
    g = events.groupBy("game_id").agg(
        F.count_if(goal & F.col("is_home")).alias("home_score"),
        F.count_if(goal & ~F.col("is_home")).alias("away_score"),
        F.bool_or(F.col("period") >= 4).alias("ot"),
    )
    return headers.join(g, "game_id", "left").fillna({"home_score": 0, "away_score": 0, "ot": False})


GAME_COUNTS = ("g", "a1", "a2", "sog", "pen")


def game_counts(events: DataFrame) -> DataFrame:
    """Goals, assists, shots on goal and penalties per (game, player), shootout left out."""
    goal, t = F.col("type") == "goal", F.col("type")
    p = F.col("primary_player_id")
    who = [
        F.when(goal, F.struct(p.alias("player_id"), F.lit("g").alias("k"))),
        F.when(goal, F.struct(F.col("assist1_player_id").alias("player_id"), F.lit("a1").alias("k"))),
        F.when(goal, F.struct(F.col("assist2_player_id").alias("player_id"), F.lit("a2").alias("k"))),
        F.when(t.isin(*S.SOG), F.struct(p.alias("player_id"), F.lit("sog").alias("k"))),
        F.when(t == "penalty", F.struct(p.alias("player_id"), F.lit("pen").alias("k"))),
    ]
    rows = events.where("period < 5").select("game_id", F.explode(F.array_compact(F.array(*who))).alias("c"))
    rows = rows.select("game_id", "c.player_id", "c.k").where("player_id is not null")
    return rows.groupBy("game_id", "player_id").agg(*[F.count_if(F.col("k") == k).alias(k) for k in GAME_COUNTS])


def side_of_game(base: DataFrame, scores: DataFrame) -> DataFrame:
    """Opponent, goals for and against and result seen from `team`."""
    out = base.join(scores.select("game_id", "game_date", "home_team", "away_team", "home_score", "away_score", "ot"), "game_id")
    home = F.col("team") == F.col("home_team")
    return (
        out.withColumn("home", home)
        .withColumn("opp", F.when(home, F.col("away_team")).otherwise(F.col("home_team")))
        .withColumn("gf", F.when(home, F.col("home_score")).otherwise(F.col("away_score")))
        .withColumn("ga", F.when(home, F.col("away_score")).otherwise(F.col("home_score")))
        .withColumn("result", S.game_result("gf", "ga", "ot"))
        .drop("home_team", "away_team", "home_score", "away_score", "ot")
    )


def game_log(shifts: DataFrame, events: DataFrame, scores: DataFrame) -> DataFrame:
    base = shifts.groupBy("game_id", "season", "player_id").agg(
        F.min_by("team", F.struct("start_g", "team")).alias("team"), F.sum("duration_s").alias("toi_s")
    )
    df = base.join(game_counts(events), ["game_id", "player_id"], "left").fillna(0, list(GAME_COUNTS))
    df = df.withColumn("a", F.col("a1") + F.col("a2")).withColumn("p", F.col("g") + F.col("a"))
    return side_of_game(df, scores)


def goalie_lines(onice: DataFrame) -> DataFrame:
    """Shots faced per (game, goalie) over the modelled regular-season set."""
    s = onice.where(S.is_regular("game_id") & F.col("goalie_id").isNotNull() & F.col("xg").isNotNull())
    return (
        s.groupBy("game_id", F.col("goalie_id").alias("player_id"))
        .agg(
            F.count(F.lit(1)).alias("sa"), F.sum("xg").alias("xga"), F.sum("goal").alias("ga"),
            F.count_if(F.col("event").isin(*S.SOG)).alias("sog_against"),
        )
        .withColumn("saves", F.col("sog_against") - F.col("ga"))
        .withColumn("gsax", F.col("xga") - F.col("ga"))
    )


def goalie_games(shifts: DataFrame, goalies: DataFrame) -> DataFrame:
    """Goalie-games with starter and sole-goalie flags; the window reads the goalies of one side."""
    s = shifts.where(S.is_regular("game_id")).join(goalies, "player_id", "left_semi")
    base = s.groupBy("game_id", "season", "player_id").agg(
        F.min_by("team", F.struct("start_g", "team")).alias("team"),
        F.sum("duration_s").alias("toi_s"), F.min("start_g").alias("first_start"),
    )
    side = Window.partitionBy("game_id", "team")
    first = F.row_number().over(side.orderBy("first_start", "player_id"))
    return base.withColumn("started", first == 1).withColumn("sole_goalie", F.count(F.lit(1)).over(side) == 1)


def goalie_game_log(shifts: DataFrame, goalies: DataFrame, onice: DataFrame, scores: DataFrame) -> DataFrame:
    df = goalie_games(shifts, goalies).join(goalie_lines(onice), ["game_id", "player_id"], "left")
    df = df.fillna(0, ["sa", "xga", "ga", "sog_against", "saves", "gsax"]).withColumnRenamed("ga", "goals_in")
    df = side_of_game(df, scores)
    return (
        df.withColumn("shutout", F.col("started") & F.col("sole_goalie") & (F.col("ga") == 0))
        .withColumn("decision", F.when(F.col("started"), F.col("result")))
        .withColumn("qs", S.quality_start("started", "saves", "sog_against", "goals_in"))
        .withColumn("rbs", S.really_bad_start("started", "saves", "sog_against"))
        .drop("gf", "ga", "result").withColumnRenamed("goals_in", "ga")
    )


def facing_shots(onice: DataFrame) -> DataFrame:
    """Modelled regular-season shots with danger bucket and manpower seen by the goalie's team."""
    home = F.col("is_home")
    own = F.when(home, F.col("sit_away_n")).otherwise(F.col("sit_home_n"))
    opp = F.when(home, F.col("sit_home_n")).otherwise(F.col("sit_away_n"))
    s = onice.where(S.is_regular("game_id") & F.col("goalie_id").isNotNull() & F.col("xg").isNotNull())
    return s.select(
        "season", F.col("goalie_id").alias("player_id"), "xg", "goal", "shot_type",
        F.col("event").isin(*S.SOG).alias("is_sog"), S.danger_bucket("xg").alias("bucket"),
        S.situation_bucket(own, opp).alias("sit"),
    )


def split_wide(df: DataFrame, keys: list[str], level: str, levels: tuple[str, ...]) -> DataFrame:
    """Shot sums per entity and level, one column group per level, zero where nothing happened."""
    agg = []
    for lv in levels:
        at = F.col(level) == lv
        agg += [
            F.count_if(at).alias(f"{lv}_sa"),
            F.coalesce(F.sum(F.when(at, F.col("xg"))), F.lit(0.0)).alias(f"{lv}_xga"),
            F.coalesce(F.sum(F.when(at, F.col("goal"))), F.lit(0)).alias(f"{lv}_ga"),
            F.count_if(at & F.col("is_sog")).alias(f"{lv}_sog"),
        ]
    return df.groupBy(*keys).agg(*agg)


DANGER = ("ld", "md", "hd")
SITUATIONS = ("ev", "pk", "pp")


def goalie_box(log: DataFrame, faced: DataFrame) -> DataFrame:
    """Season line per goalie: games from the log, shot totals and splits from the shots faced."""
    keys = ["player_id", "season"]
    n = lambda c: F.count_if(F.col(c)).alias
    games = log.groupBy(*keys).agg(
        F.countDistinct("game_id").alias("gp"), n("started")("starts"), n("shutout")("shutouts"),
        n("qs")("qs"), n("rbs")("rbs"), F.sum("toi_s").alias("toi_s"),
    )
    teams = log.groupBy(*keys, "team").agg(F.count(F.lit(1)).alias("games"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("games")).alias("neg"), F.col("team"))))
    teams = teams.groupBy(*keys).agg(F.transform(order, lambda r: r["team"]).alias("teams"))
    sog = F.col("is_sog")
    shots = faced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sa"), F.sum("xg").alias("xga"), F.sum("goal").alias("ga"),
        F.count_if(sog).alias("sog_against"), F.sum(F.when(sog, F.col("xg"))).alias("xga_sog"),
    )
    shots = shots.withColumn("saves", F.col("sog_against") - F.col("ga")).withColumn("gsax", F.col("xga") - F.col("ga"))
    out = games.join(teams, keys, "left").join(shots, keys, "left")
    out = out.join(split_wide(faced, keys, "bucket", DANGER), keys, "left").join(split_wide(faced, keys, "sit", SITUATIONS), keys, "left")
    return out.withColumn("team", F.element_at("teams", 1)).fillna(0)


def shot_type_split(faced: DataFrame) -> DataFrame:
    return faced.where("shot_type is not null").groupBy("player_id", "season", "shot_type").agg(
        F.count(F.lit(1)).alias("sa"), F.sum("xg").alias("xga"), F.sum("goal").alias("ga"), F.count_if("is_sog").alias("sog")
    )


def game_players(shifts: DataFrame, events: DataFrame, onice: DataFrame) -> DataFrame:
    """Per-game player lines: shifts, ice time, scoring, shots and chance value."""
    ice = shifts.groupBy("game_id", "player_id").agg(
        F.min_by("team", F.struct("start_g", "team")).alias("team"),
        F.count(F.lit(1)).alias("shifts"), F.sum("duration_s").alias("toi_s"),
    )
    goal = events.where("type = 'goal'")
    role = F.array(
        F.struct(F.col("primary_player_id").alias("player_id"), F.lit("g").alias("k")),
        F.struct(F.col("assist1_player_id").alias("player_id"), F.lit("a1").alias("k")),
        F.struct(F.col("assist2_player_id").alias("player_id"), F.lit("a2").alias("k")),
    )
    pts = goal.select("game_id", F.explode(role).alias("c")).select("game_id", "c.*").where("player_id is not null")
    pts = pts.groupBy("game_id", "player_id").agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("g", "a1", "a2")])
    sh = onice.groupBy("game_id", F.col("shooter_id").alias("player_id")).agg(F.count(F.lit(1)).alias("shots"), F.sum("xg").alias("xg"))
    out = ice.join(pts, ["game_id", "player_id"], "left").join(sh, ["game_id", "player_id"], "left")
    return out.fillna(0, ["g", "a1", "a2", "shots", "xg"]).withColumn("pts", F.col("g") + F.col("a1") + F.col("a2"))


def game_index(scores: DataFrame, stints: DataFrame, onice: DataFrame) -> DataFrame:
    """One index row per game with stint and shot counts and on-ice quality rates."""
    st = stints.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("n_stints"), F.sum("home_xgf").alias("home_xgf"), F.sum("away_xgf").alias("away_xgf"),
        F.count_if("overload").alias("overload_stints"),
    )
    m = F.col("onice_match")
    sh = onice.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("n_shots"), F.avg((m == "exact").cast("double")).alias("match_exact"),
        F.count_if(m == "large").alias("large_mismatch"), F.count_if("is_home").alias("home_shots"),
    )
    return scores.join(st, "game_id").join(sh, "game_id", "left").fillna(0, ["n_shots", "large_mismatch", "home_shots"])
