"""ANSI SQL twins of the derived tables, written independently (range joins instead of rewrites).

`with_tables(sql)` prefixes a statement with the common table expressions it mentions, so each
oracle is one self-contained statement over the raw tables.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["feed0"] = """
SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS game_date,
  CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, user_id // 50 AS grp,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CAST(2021 + datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 8 AS BIGINT) AS season,
  CAST((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 16 AS INTEGER) AS time_g
FROM events"""

CTES["feed"] = """
SELECT f.*,
  (grp * 10000 + season) * 1000000 + CASE WHEN day % 8 = 7 THEN 30000 ELSE 20000 END + day % 8 AS game_id,
  (user_id + CASE WHEN user_id % 10 = 3 AND season >= 2023 THEN 1 ELSE 0 END) % 2 AS parity,
  CASE WHEN event_type = 'purchase' AND k < 30 THEN 'goal'
    WHEN event_type = 'purchase' AND k < 50 THEN 'hit'
    WHEN event_type = 'purchase' AND k < 65 THEN 'giveaway'
    WHEN event_type = 'purchase' AND k < 80 THEN 'takeaway'
    WHEN event_type = 'purchase' THEN 'penalty'
    WHEN event_type = 'click' THEN 'shot-on-goal'
    WHEN event_type = 'view' THEN 'missed-shot'
    WHEN event_type = 'error' THEN 'blocked-shot'
    WHEN k >= 90 THEN 'stoppage' ELSE 'faceoff' END AS type,
  time_g // 1200 + 1 AS period,
  printf('T%03d', grp * 2 + day % 2) AS home_team,
  printf('T%03d', grp * 2 + 1 - day % 2) AS away_team
FROM feed0 f"""

CTES["feed2"] = """
SELECT *, (parity + day) % 2 = 0 AS user_home,
  printf('T%03d', grp * 2 + parity) AS user_team,
  CASE WHEN type = 'blocked-shot' THEN (parity + day) % 2 <> 0 ELSE (parity + day) % 2 = 0 END AS is_home
FROM feed"""

CTES["ev"] = """
SELECT game_id, event_id AS event_idx, season, game_date, period, time_g, type,
  CASE WHEN is_home THEN home_team ELSE away_team END AS team, is_home,
  CASE WHEN k <> 0 THEN (event_id * 37 + k * 13) % 199 - 99 END AS x,
  CASE WHEN k <> 0 THEN (event_id * 53 + k * 7) % 85 - 42 END AS y,
  CASE WHEN k % 20 <> 19 THEN CASE event_id % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'D' ELSE 'N' END END AS zone,
  CASE event_id % 11 WHEN 0 THEN '1451' WHEN 1 THEN '1541' WHEN 2 THEN '0651' WHEN 3 THEN '1560'
    WHEN 4 THEN '551' WHEN 5 THEN NULL WHEN 6 THEN '15A1' WHEN 7 THEN '15510' ELSE '1551' END AS situation_code,
  CASE WHEN (period + day) % 2 = 0 THEN 'left' ELSE 'right' END AS home_defending_side,
  CASE WHEN type <> 'stoppage' THEN user_id END AS primary_player_id,
  CASE WHEN type IN ('blocked-shot', 'faceoff', 'penalty') THEN (user_id // 50) * 50 + (user_id % 50 + 1 + (k % 5) * 2) % 50 END AS secondary_player_id,
  CASE WHEN type = 'goal' AND k % 5 <> 0 THEN (user_id // 50) * 50 + (user_id % 50 + 2 + (k % 7) * 2) % 50 END AS assist1_player_id,
  CASE WHEN type = 'goal' AND k % 5 <> 0 AND k % 3 <> 0 THEN (user_id // 50) * 50 + (user_id % 50 + 4 + (k % 11) * 2) % 50 END AS assist2_player_id,
  CASE WHEN type IN ('goal', 'shot-on-goal', 'missed-shot', 'blocked-shot') THEN
    CASE k % 6 WHEN 0 THEN 'wrist' WHEN 1 THEN 'snap' WHEN 2 THEN 'slap' WHEN 3 THEN 'tip-in' WHEN 4 THEN 'backhand' END END AS shot_type,
  CASE WHEN type = 'penalty' THEN 'pen-' || CAST(k % 4 AS VARCHAR) END AS detail_key,
  home_team, away_team
FROM feed2"""

CTES["shift_rows"] = """
SELECT game_id, season, user_id AS player_id,
  CASE WHEN user_id % 25 = 7 AND day % 5 = 0 THEN 'ZZZ' ELSE user_team END AS team, period,
  time_g AS start_g, time_g + greatest(1, CAST(ceil(value * 11) AS INTEGER)) AS end_g
FROM feed2"""

CTES["roster"] = """
SELECT player_id, season, 'Player #' || CAST(player_id AS VARCHAR) AS player_name,
  CASE WHEN player_id % 17 = 0 THEN 'G' WHEN player_id % 3 = 1 THEN 'D' WHEN player_id % 3 = 2 THEN 'C'
    WHEN player_id % 2 = 0 THEN 'L' ELSE 'R' END AS position,
  player_id % 98 + 1 AS number, team
FROM (SELECT user_id AS player_id, season, arg_max(user_team, game_id) AS team FROM feed2 GROUP BY 1, 2)"""

CTES["goalie_ids"] = "SELECT DISTINCT player_id FROM roster WHERE position = 'G'"

CTES["bios"] = """
SELECT player_id,
  CASE WHEN player_id % 13 <> 0 THEN DATE '2004-06-30' - CAST((player_id * 97) % 6200 AS INTEGER) END AS birthdate,
  CASE WHEN player_id % 11 = 0 THEN NULL WHEN player_id % 3 = 0 THEN 'R' ELSE 'L' END AS hand
FROM (SELECT DISTINCT user_id AS player_id FROM events)"""

CTES["headers"] = """
SELECT DISTINCT game_id, season, game_date, home_team, away_team,
  CASE WHEN game_id % 29 <> 0 THEN 'Brand#' || CAST((grp * 3 + CASE WHEN season >= 2023 THEN 1 ELSE 0 END) % 25 + 1 AS VARCHAR) END AS raw_venue
FROM feed"""

CTES["shift_islands"] = """
SELECT *, sum(opened) OVER (PARTITION BY game_id, player_id ORDER BY start_g, end_g, period ROWS UNBOUNDED PRECEDING) AS shift_number
FROM (SELECT *, CASE WHEN start_g < max(end_g) OVER (PARTITION BY game_id, player_id ORDER BY start_g, end_g, period
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opened FROM shift_rows)"""

CTES["shifts"] = """
SELECT game_id, season, player_id, team, CAST(shift_number AS INTEGER) AS shift_number,
  min(start_g) AS start_g, max(end_g) AS end_g,
  first(period ORDER BY start_g, end_g, period) AS period, max(end_g) - min(start_g) AS duration_s
FROM shift_islands GROUP BY game_id, season, player_id, team, shift_number"""

CTES["ev_prev"] = """
SELECT *, lag(type) OVER w AS prev_type, lag(zone) OVER w AS prev_zone, lag(x) OVER w AS prev_x,
  lag(y) OVER w AS prev_y, lag(is_home) OVER w AS prev_home, time_g - lag(time_g) OVER w AS gap,
  TRY_CAST(substr(code4, 1, 1) AS INTEGER) AS ag, TRY_CAST(substr(code4, 2, 1) AS INTEGER) AS an,
  TRY_CAST(substr(code4, 3, 1) AS INTEGER) AS hn, TRY_CAST(substr(code4, 4, 1) AS INTEGER) AS hg,
  CASE WHEN is_home THEN 1 ELSE -1 END * CASE WHEN home_defending_side = 'right' THEN -1 ELSE 1 END AS sgn
FROM (SELECT *, CASE WHEN length(situation_code) <= 4 THEN lpad(situation_code, 4, '0') END AS code4 FROM ev)
WINDOW w AS (PARTITION BY game_id ORDER BY time_g, event_idx)"""

CTES["shots"] = """
SELECT game_id, event_idx, season, time_g, period, is_home, home_team, away_team, primary_player_id AS shooter_id,
  CASE WHEN type = 'goal' THEN 1 ELSE 0 END AS goal, type AS event, x, y, shot_type,
  round_even(sqrt((89 - x * sgn) * (89 - x * sgn) + y * y), 1) AS distance,
  round_even(degrees(atan2(abs(y), 89 - x * sgn)), 1) AS angle,
  CASE WHEN prev_type IN ('shot-on-goal', 'missed-shot', 'goal') AND gap <= 3 THEN 1 ELSE 0 END AS rebound,
  CASE WHEN prev_zone IN ('N', 'D') AND gap <= 4 THEN 1 ELSE 0 END AS rush,
  ag, an, hn, hg, hn AS home_n, an AS away_n,
  CASE WHEN (CASE WHEN is_home THEN ag ELSE hg END) = 0 THEN 1 ELSE 0 END AS empty_net
FROM ev_prev
WHERE type IN ('shot-on-goal', 'missed-shot', 'goal') AND (game_id // 10000) % 100 = 2 AND period < 5
  AND x IS NOT NULL AND y IS NOT NULL AND primary_player_id IS NOT NULL"""

CTES["xg"] = """
SELECT game_id, event_idx, 0.04 + CAST(5 AS DOUBLE) / (20 + distance) AS xg FROM shots
WHERE ag IS NOT NULL AND hg IS NOT NULL AND hn >= 3 AND an >= 3 AND CASE WHEN is_home THEN ag ELSE hg END = 1"""

CTES["game_shifts"] = """
SELECT s.*, h.home_team, h.away_team, s.team = h.home_team AS is_home FROM shifts s JOIN headers h USING (game_id)
WHERE s.team IN (h.home_team, h.away_team)
  AND game_id IN (SELECT game_id FROM shots)
  AND game_id IN (SELECT s2.game_id FROM shifts s2 JOIN headers h2 USING (game_id) WHERE s2.team = h2.home_team)"""

CTES["edges"] = """
SELECT game_id, t, row_number() OVER (PARTITION BY game_id ORDER BY t) - 1 AS edge
FROM (SELECT game_id, start_g AS t FROM game_shifts UNION SELECT game_id, end_g FROM game_shifts)"""

CTES["cuts"] = """
SELECT game_id, edge AS stint_idx, t AS start_g, nt AS end_g, nt - t AS duration_s
FROM (SELECT *, lead(t) OVER (PARTITION BY game_id ORDER BY t) AS nt FROM edges) WHERE nt IS NOT NULL"""

CTES["present"] = """
SELECT DISTINCT c.game_id, c.stint_idx, s.player_id, s.is_home, g.player_id IS NOT NULL AS is_goalie
FROM cuts c JOIN game_shifts s ON s.game_id = c.game_id AND s.start_g <= c.start_g AND s.end_g >= c.end_g
LEFT JOIN goalie_ids g ON g.player_id = s.player_id"""

CTES["people"] = """
SELECT game_id, stint_idx,
  coalesce(list(player_id ORDER BY player_id) FILTER (is_home AND NOT is_goalie), []) AS home_skaters,
  coalesce(list(player_id ORDER BY player_id) FILTER (NOT is_home AND NOT is_goalie), []) AS away_skaters,
  max(player_id) FILTER (is_home AND is_goalie) AS home_goalie,
  max(player_id) FILTER (NOT is_home AND is_goalie) AS away_goalie
FROM present GROUP BY 1, 2"""

CTES["fo_last"] = """
SELECT game_id, time_g AS t, arg_max(CASE WHEN is_home OR zone = 'N' THEN zone WHEN zone = 'O' THEN 'D' ELSE 'O' END, event_idx) AS z
FROM ev WHERE type = 'faceoff' AND zone IS NOT NULL GROUP BY 1, 2"""

CTES["goal_times"] = "SELECT game_id, time_g, is_home FROM ev WHERE type = 'goal' AND period < 5"

CTES["lead_at"] = """
SELECT c.game_id, c.stint_idx, CAST(coalesce(sum(CASE WHEN g.is_home THEN 1 WHEN NOT g.is_home THEN -1 END), 0) AS INTEGER) AS home_lead
FROM cuts c LEFT JOIN goal_times g ON g.game_id = c.game_id AND g.time_g <= c.start_g GROUP BY 1, 2"""

CTES["vol"] = """
SELECT c.game_id, c.stint_idx,
  count(*) FILTER (sh) AS home_corsi, count(*) FILTER (NOT sh) AS away_corsi,
  count(*) FILTER (sh AND type <> 'blocked-shot') AS home_fen, count(*) FILTER (NOT sh AND type <> 'blocked-shot') AS away_fen,
  count(*) FILTER (sh AND type IN ('shot-on-goal', 'goal')) AS home_sog, count(*) FILTER (NOT sh AND type IN ('shot-on-goal', 'goal')) AS away_sog
FROM cuts c JOIN (SELECT *, CASE WHEN type = 'blocked-shot' THEN NOT is_home ELSE is_home END AS sh FROM ev
  WHERE type IN ('shot-on-goal', 'missed-shot', 'blocked-shot', 'goal')) e
  ON e.game_id = c.game_id AND e.time_g > c.start_g AND e.time_g <= c.end_g GROUP BY 1, 2"""

CTES["scored"] = """
SELECT s.*, x.xg, a.assist1_player_id, a.assist2_player_id FROM shots s LEFT JOIN xg x USING (game_id, event_idx)
LEFT JOIN (SELECT game_id, event_idx, assist1_player_id, assist2_player_id FROM ev WHERE type = 'goal') a USING (game_id, event_idx)"""

CTES["placed"] = """
SELECT s.*, c.stint_idx FROM scored s JOIN cuts c ON s.game_id = c.game_id AND s.time_g > c.start_g AND s.time_g <= c.end_g"""

CTES["xgf"] = """
SELECT game_id, stint_idx, coalesce(sum(xg) FILTER (is_home), 0) AS home_xgf, coalesce(sum(xg) FILTER (NOT is_home), 0) AS away_xgf
FROM placed GROUP BY 1, 2"""

CTES["stints"] = """
SELECT c.*, (c.game_id // 1000000) % 10000 AS season, l.home_lead, fs.z AS start_zone, fe.z AS end_zone,
  CASE WHEN fa.game_id IS NOT NULL THEN 'faceoff' ELSE 'fly' END AS start_type,
  coalesce(p.home_skaters, []) AS home_skaters, coalesce(p.away_skaters, []) AS away_skaters, p.home_goalie, p.away_goalie,
  coalesce(len(p.home_skaters), 0) AS home_n, coalesce(len(p.away_skaters), 0) AS away_n,
  CAST(coalesce(len(p.home_skaters), 0) AS VARCHAR) || 'v' || CAST(coalesce(len(p.away_skaters), 0) AS VARCHAR) AS strength,
  coalesce(len(p.home_skaters), 0) > 6 OR coalesce(len(p.away_skaters), 0) > 6 AS overload,
  coalesce(x.home_xgf, 0) AS home_xgf, coalesce(x.away_xgf, 0) AS away_xgf,
  coalesce(v.home_corsi, 0) AS home_corsi, coalesce(v.away_corsi, 0) AS away_corsi, coalesce(v.home_fen, 0) AS home_fen,
  coalesce(v.away_fen, 0) AS away_fen, coalesce(v.home_sog, 0) AS home_sog, coalesce(v.away_sog, 0) AS away_sog
FROM cuts c JOIN lead_at l USING (game_id, stint_idx)
LEFT JOIN people p USING (game_id, stint_idx) LEFT JOIN xgf x USING (game_id, stint_idx) LEFT JOIN vol v USING (game_id, stint_idx)
LEFT JOIN fo_last fs ON fs.game_id = c.game_id AND fs.t = c.start_g
LEFT JOIN fo_last fe ON fe.game_id = c.game_id AND fe.t = c.end_g
LEFT JOIN (SELECT DISTINCT game_id, time_g AS t FROM ev WHERE type = 'faceoff') fa ON fa.game_id = c.game_id AND fa.t = c.start_g"""

CTES["onice"] = """
SELECT p.*, p.home_n AS sit_home_n, p.away_n AS sit_away_n, st.strength, st.home_skaters, st.away_skaters, st.home_goalie, st.away_goalie,
  st.home_n AS st_home_n, st.away_n AS st_away_n,
  CASE WHEN p.is_home THEN st.away_goalie ELSE st.home_goalie END AS goalie_id,
  CASE WHEN p.home_n IS NULL OR p.away_n IS NULL THEN 'large'
    WHEN st.home_n = p.home_n AND st.away_n = p.away_n THEN 'exact'
    WHEN abs(st.home_n - p.home_n) <= 1 AND abs(st.away_n - p.away_n) <= 1 THEN 'within1' ELSE 'large' END AS onice_match
FROM placed p JOIN stints st USING (game_id, stint_idx)"""

CTES["duels"] = """
SELECT o_custkey AS shooter_id, l_suppkey AS goalie_id, 0.02 + 3 * l_discount AS xg, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS goal,
  l_linestatus = 'O' AS is_home, CAST(year(l_shipdate) AS BIGINT) AS season, l_returnflag AS shot_type,
  o_custkey % 25 AS off_nation, l_suppkey % 25 AS def_nation
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

_WORD = re.compile(r"\b[a-z_][a-z0-9_]*\b")


def _mentioned(sql: str) -> list[str]:
    words = set(_WORD.findall(re.sub(r"'[^']*'", "''", sql)))
    return [n for n in CTES if n in words]


def with_tables(sql: str) -> str:
    """Prefix `sql` with every table expression it needs, in dependency order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in _mentioned(CTES[name]):
            if dep != name:
                visit(dep)
        done.append(name)

    for n in _mentioned(sql):
        visit(n)
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in done)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if head else body
    return f"WITH {head}\n{body}" if head else body
