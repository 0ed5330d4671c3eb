"""Table rows written as raw feed documents, the other direction of `variants`: for round trips and hand-over.

A document holds PAGE rows of a game at most, so a game with a third of all rows becomes many
documents instead of one group that no task can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 1000


def _paged(rows: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """`rows` with `page`, a number below rows of the key / PAGE, dealt by hash."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PAGE).cast("int").alias("_pages"))
    return rows.join(sizes, keys).withColumn("page", F.pmod(by, F.col("_pages"))).drop("_pages")


def clock(game_s, period) -> Column:
    """Game seconds as "MM:SS" of their period."""
    s = F.col(game_s) - (F.col(period) - 1) * 1200
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)).cast("int"))


def _team_id(abbrev) -> Column:
    return F.xxhash64(abbrev)


def game_documents(events: DataFrame) -> DataFrame:
    """(game_id, page, value): event rows as nested game documents."""
    roles = F.struct(
        _team_id(F.col("team")).alias("eventOwnerTeamId"), F.col("primary_player_id").alias("playerId"), F.col("secondary_player_id").alias("blockingPlayerId"),
        F.col("assist1_player_id").alias("assist1PlayerId"), F.col("assist2_player_id").alias("assist2PlayerId"),
        F.col("x").alias("xCoord"), F.col("y").alias("yCoord"), F.col("zone").alias("zoneCode"), F.col("shot_type").alias("shotType"), F.col("detail_key").alias("descKey"),
    )
    play = F.struct(
        F.col("event_idx").alias("sortOrder"), F.col("type").alias("typeDescKey"), clock("time_g", "period").alias("timeInPeriod"), F.col("situation_code").alias("situationCode"),
        F.col("home_defending_side").alias("homeTeamDefendingSide"), F.struct(F.col("period").alias("number"), F.lit("REG").alias("periodType")).alias("periodDescriptor"), roles.alias("details"),
    )
    paged = _paged(events, ["game_id"], F.xxhash64("event_idx")).groupBy("game_id", "page", "home_team", "away_team").agg(F.collect_list(play).alias("plays"))
    side = lambda c: F.struct(_team_id(F.col(c)).alias("id"), F.col(c).alias("abbrev"))
    return paged.select("game_id", "page", F.to_json(F.struct(F.col("game_id").alias("id"), side("home_team").alias("homeTeam"), side("away_team").alias("awayTeam"), "plays")).alias("value"))


def shift_documents(rows: DataFrame) -> DataFrame:
    """(game_id, page, value): intervals as shift chart documents."""
    entry = F.struct(
        F.col("game_id").alias("gameId"), F.col("player_id").alias("playerId"), F.lit("Player").alias("firstName"), F.concat(F.lit("#"), "player_id").alias("lastName"), F.col("team").alias("teamAbbrev"),
        F.col("period"), clock("start_g", "period").alias("startTime"), clock("end_g", "period").alias("endTime"), F.lit("00:01").alias("duration"),
    )
    paged = _paged(rows, ["game_id"], F.xxhash64("player_id", "start_g", "end_g")).groupBy("game_id", "page").agg(F.collect_list(entry).alias("data"))
    return paged.select("game_id", "page", F.to_json(F.struct("data")).alias("value"))


def player_documents(bios: DataFrame) -> DataFrame:
    """(player_id, value): a bio document a player."""
    name = lambda x: F.struct(x.alias("default"))
    body = F.struct(
        F.col("player_id").alias("playerId"), name(F.lit("Player")).alias("firstName"), name(F.concat(F.lit("#"), F.col("player_id").cast("string"))).alias("lastName"),
        F.col("birthdate").cast("string").alias("birthDate"), F.col("hand").alias("shootsCatches"),
    )
    return bios.select("player_id", F.to_json(body).alias("value"))


def reports(rows: DataFrame, heading: str, entry: str) -> DataFrame:
    """(game_id, team, page, html): intervals (with `number`) as time-on-ice reports, both quotes and nested tags in turn.

    Every third entry leaves out its end and states its length.
    """
    period = F.when(F.col("period") == 4, "OT").when(F.col("period") > 4, "SO").otherwise(F.col("period").cast("string"))
    s = F.col("end_g") - F.col("start_g")
    length = F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)).cast("int"))
    td = lambda k, v, q="'": F.concat(F.lit(f"<td align=center class={q}{k}{q}>"), v, F.lit("</td>"))
    end = F.when(F.pmod(F.xxhash64("player_id", "start_g"), F.lit(3)) == 0, F.lit("&nbsp;")).otherwise(F.concat(clock("end_g", "period"), F.lit(" / 0:00")))
    cells = F.concat(td(entry, F.lit("1")), td(entry, period, '"'), td(entry, F.concat(F.lit("<b>"), clock("start_g", "period"), F.lit("</b> / 20:00"))), td(entry, end, '"'), td(entry, length))
    paged = _paged(rows, ["game_id", "team"], F.xxhash64("player_id", "start_g", "end_g"))
    mine = paged.groupBy("game_id", "team", "page", "player_id", "number").agg(F.array_join(F.collect_list(F.concat(F.lit("<tr>"), cells, F.lit("<td class=spacer>x</td></tr>"))), "\n").alias("rows"))
    head = F.concat(F.lit(f'<tr><td class="{heading}" colspan=8>'), F.col("number").cast("string"), F.lit(" <i>NAME</i>, A&amp;B</td></tr>\n"))
    return mine.groupBy("game_id", "team", "page").agg(F.concat(F.lit("<html><table>"), F.array_join(F.collect_list(F.concat(head, "rows")), "\n"), F.lit("</table></html>")).alias("html"))
