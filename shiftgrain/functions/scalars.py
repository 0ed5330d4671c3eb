"""Scalar functions as Column expressions. Nothing here is a UDF; everything stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clock, rink and rule constants every result depends on.
PERIOD_SECONDS = 1200
GOAL_X = 89.0
REBOUND_S = 3
RUSH_S = 4
CROSS_SLOT_S = 4
FENWICK = ("shot-on-goal", "missed-shot", "goal")
CORSI = ("shot-on-goal", "missed-shot", "blocked-shot", "goal")
SOG = ("shot-on-goal", "goal")
MD_THRESH = 0.05
HD_THRESH = 0.15
AGE_PEAK = 27.0
AGE_SCALE = 10.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- clocks, seasons, ids -----------------------------------------------------------------------


def clock_seconds(mmss) -> Column:
    """"MM:SS" to seconds; anything else gives null."""
    c = _c(mmss)
    ok = c.rlike(r"^\d+:\d{2}$")
    parts = F.split(c, ":")
    return F.when(ok, parts[0].try_cast("int") * 60 + parts[1].try_cast("int"))


def game_seconds(period, mmss) -> Column:
    return (_c(period) - 1) * PERIOD_SECONDS + clock_seconds(mmss)


def period_of(game_s) -> Column:
    return (F.floor(_c(game_s) / PERIOD_SECONDS) + 1).cast("int")


def clock_label(game_s) -> Column:
    """Seconds since the start of the game to "P2 05:30"."""
    s = _c(game_s).cast("long")
    within = s % PERIOD_SECONDS
    return F.format_string(
        "P%d %02d:%02d", F.floor(s / PERIOD_SECONDS) + 1, F.floor(within / 60), within % 60
    )


def season_of_id(game_id) -> Column:
    """The four digits above the game type and number; more leading digits may name a rink."""
    return (F.floor(_c(game_id) / 1000000) % 10000).cast("int")


def season_of_date(d) -> Column:
    """September opens a season; earlier months belong to the previous start year."""
    c = _c(d)
    return F.year(c) - F.when(F.month(c) < 9, 1).otherwise(0)


def season_label(season) -> Column:
    s = _c(season).cast("int")
    return F.format_string("%d-%02d", s, (s + 1) % 100)


def season_pair(season) -> Column:
    s = _c(season).cast("int")
    return F.format_string("%d%d", s, s + 1)


def id_tail(game_id) -> Column:
    return F.substring(_c(game_id).cast("string"), -6, 6)


def is_regular(game_id) -> Column:
    return F.floor(_c(game_id) / 10000) % 100 == 2


# --- manpower -----------------------------------------------------------------------------------


def situation_digit(code, i: int) -> Column:
    """Digit `i` of a 4-digit code, left-padded with zeros; null when longer or not a digit."""
    c = _c(code)
    return F.when(F.length(c) <= 4, F.substring(F.lpad(c, 4, "0"), i + 1, 1).try_cast("int"))


def situation(code) -> list[Column]:
    names = ("away_goalie_in", "away_skaters_n", "home_skaters_n", "home_goalie_in")
    return [situation_digit(code, i).alias(n) for i, n in enumerate(names)]


def strength_label(home_n, away_n) -> Column:
    return F.concat_ws("v", _c(home_n).cast("string"), _c(away_n).cast("string"))


def strength_side(strength, want_home) -> Column:
    """The home (or away) number of an "HvA" label."""
    parts = F.split(_c(strength), "v")
    return F.when(_c(want_home), parts[0]).otherwise(parts[1]).try_cast("int")


def facing_goalie(is_home, home_goalie, away_goalie) -> Column:
    return F.when(_c(is_home), _c(away_goalie)).otherwise(_c(home_goalie))


def danger_bucket(xg) -> Column:
    x = _c(xg)
    return F.when(x < MD_THRESH, "ld").when(x < HD_THRESH, "md").otherwise("hd")


def situation_bucket(own_n, opp_n) -> Column:
    own, opp = _c(own_n), _c(opp_n)
    return (
        F.when(own.isNull() | opp.isNull() | (own == opp), "ev")
        .when(own < opp, "pk")
        .otherwise("pp")
    )


def onice_match(home_n, away_n, sit_home, sit_away) -> Column:
    dh, da = F.abs(_c(home_n) - _c(sit_home)), F.abs(_c(away_n) - _c(sit_away))
    return (
        F.when(dh.isNull() | da.isNull(), "large")
        .when((dh == 0) & (da == 0), "exact")
        .when((dh <= 1) & (da <= 1), "within1")
        .otherwise("large")
    )


def flip_zone(zone) -> Column:
    z = _c(zone)
    return F.when(z == "O", "D").when(z == "D", "O").when(z == "N", "N")


# --- shot geometry ------------------------------------------------------------------------------


def attack_sign(is_home, home_defending_side) -> Column:
    """+1 where the shooting side attacks towards positive x: the product of a sign for the ends and one for the side."""
    ends = F.coalesce((_c(home_defending_side) == "right").cast("int"), F.lit(0))
    side = F.coalesce((~_c(is_home)).cast("int"), F.lit(1))
    return (1 - 2 * ends).cast("double") * (1 - 2 * side)


def distance_to_net(x_adj, y_adj) -> Column:
    dx = F.lit(GOAL_X) - _c(x_adj)
    return F.sqrt(dx * dx + _c(y_adj) * _c(y_adj))


def signed_angle(x_adj, y_adj) -> Column:
    return F.degrees(F.atan2(_c(y_adj).cast("double"), F.lit(GOAL_X) - _c(x_adj)))


def abs_angle(x_adj, y_adj) -> Column:
    return F.degrees(F.atan2(F.abs(_c(y_adj)).cast("double"), F.lit(GOAL_X) - _c(x_adj)))


def flag(cond: Column) -> Column:
    """1 when true, 0 when false or unknown."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def rebound(prev_type, gap_s) -> Column:
    return flag(_c(prev_type).isin(*FENWICK) & (_c(gap_s) <= REBOUND_S))


def rush(prev_zone, gap_s) -> Column:
    return flag(_c(prev_zone).isin("N", "D") & (_c(gap_s) <= RUSH_S))


def cross_slot(prev_y, y, gap_s) -> Column:
    return flag(
        (F.signum(_c(prev_y)) != F.signum(_c(y)))
        & (F.abs(_c(prev_y)) > 3)
        & (F.abs(_c(y)) > 3)
        & (_c(gap_s) <= CROSS_SLOT_S)
    )


def speed(dist, gap_s) -> Column:
    """Distance over time; zero when no time passed, null when there is no previous event."""
    gap = _c(gap_s)
    return F.when(gap > 0, _c(dist) / gap).otherwise(F.lit(0.0))


def off_wing(hand, y_adj) -> Column:
    right = (_c(y_adj) < 0).cast("int")
    return F.when(_c(hand) == "L", right).when(_c(hand) == "R", 1 - right)


# --- rates, rounding, names ---------------------------------------------------------------------


def per60(value, seconds) -> Column:
    return F.when(_c(seconds) > 0, _c(value) * 3600.0 / _c(seconds))


def share(a, b) -> Column:
    tot = _c(a) + _c(b)
    return F.when(tot > 0, _c(a) / tot)


def ratio(num, den, empty=None) -> Column:
    r = F.when(_c(den) > 0, _c(num) / _c(den))
    return r if empty is None else F.coalesce(r, F.lit(empty))


def half_even(x, places: int = 0) -> Column:
    return F.bround(_c(x), places)


def clean_double(x) -> Column:
    """NaN and infinities become null, so that sums skip them and documents stay valid JSON."""
    c = _c(x).cast("double")
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(~bad, c)


def full_name(first, last) -> Column:
    return F.nullif(F.concat_ws(" ", F.nullif(_c(first), F.lit("")), F.nullif(_c(last), F.lit(""))), F.lit(""))


def first_role(*ids) -> Column:
    """First usable id; zero counts as missing."""
    return F.coalesce(*[F.nullif(_c(i), F.lit(0)) for i in ids])


def game_result(gf, ga, overtime) -> Column:
    f, a = _c(gf), _c(ga)
    return (
        F.when(f > a, "W")
        .when((f < a) & _c(overtime), "OTL")
        .when(f < a, "L")
        .when(f == a, "T")
    )


def quality_start(started, saves, sog, ga) -> Column:
    sv = F.when(_c(sog) > 0, _c(saves) / _c(sog))
    return F.coalesce(_c(started) & ((sv >= 0.917) | ((_c(sog) < 20) & (_c(ga) <= 2) & sv.isNotNull())), F.lit(False))


def really_bad_start(started, saves, sog) -> Column:
    sv = F.when(_c(sog) > 0, _c(saves) / _c(sog))
    return F.coalesce(_c(started) & (sv < 0.850), F.lit(False))


def midseason_age(season, birthdate) -> Column:
    return F.datediff(F.make_date(_c(season) + 1, F.lit(1), F.lit(1)), _c(birthdate)) / 365.25


def age_z(age) -> Column:
    return F.coalesce((_c(age) - AGE_PEAK) / AGE_SCALE, F.lit(0.0))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def logit(p, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def grid_cell(v, lo: float, width: float, n: int) -> Column:
    """Cell number on a regular grid, null outside it."""
    i = F.floor((_c(v) - lo) / width).cast("int")
    return F.when((i >= 0) & (i < n), i)
