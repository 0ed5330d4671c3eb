"""Feed documents as VARIANT values: parsed once, read by path, with a channel for what cannot be read.

A document that is no JSON object, a play, shift or spot that is none, or a field without its type
never stops a batch: the document goes to `unreadable`, the element has no `item`, the field is null,
and everything else is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrain.functions import scalars as S
from shiftgrain.sources import landing as L

_TEAMS = "id bigint, homeTeam struct<id: bigint, abbrev: string, score: int>, awayTeam struct<id: bigint, abbrev: string, score: int>"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """`lines` with `doc`, the VARIANT of `column`; null where it is no JSON object."""
    doc = F.try_parse_json(F.col(f"`{column}`"))
    return lines.withColumn("doc", F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc))


def read_documents(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """(value, file, doc): a document a line, or a document a file."""
    return parsed(spark.read.text(path, wholetext=whole_files).select("value", F.col("_metadata.file_path").alias("file")))


def unreadable(docs: DataFrame) -> DataFrame:
    """Lines that hold no document; empty lines are no documents and no fault."""
    return docs.where("doc is null and trim(value) <> ''").drop("doc")


def _parts(docs: DataFrame, path: str, kind: str, *keep: str) -> DataFrame:
    """(keep..., raw VARIANT, item): each element of an array of the documents, `item` null where it is no object."""
    rows = docs.where("doc is not null").select(*keep, F.explode(F.try_variant_get("doc", path, "array<variant>")).alias("raw"))
    return rows.withColumn("item", F.try_variant_get("raw", "$", kind))


def _teams(docs: DataFrame) -> DataFrame:
    get = lambda path, kind: F.try_variant_get("doc", path, kind)
    team = lambda side: F.struct(get(f"$.{side}.id", "bigint").alias("id"), get(f"$.{side}.abbrev", "string").alias("abbrev"))
    return docs.select(get("$.id", "bigint").alias("id"), team("homeTeam").alias("homeTeam"), team("awayTeam").alias("awayTeam"), "doc")


def plays(docs: DataFrame) -> DataFrame:
    """(id, homeTeam, awayTeam, raw, item): every play of every readable game document."""
    return _parts(_teams(docs), "$.plays", L.PLAY.simpleString(), "id", "homeTeam", "awayTeam")


def events(docs: DataFrame) -> DataFrame:
    """Event rows of game documents, as `landing.game_events` has them; plays without a number of their own are left out."""
    numbered = plays(docs).where(F.coalesce("item.sortOrder", "item.eventId").isNotNull())
    return L.play_rows(numbered.withColumnRenamed("item", "p"))


def spots(docs: DataFrame) -> DataFrame:
    """(game_id, team, number, player_id): who wears which sweater in which game."""
    r = _parts(_teams(docs), "$.rosterSpots", L.SPOT.simpleString(), "id", "homeTeam", "awayTeam").where("item is not null")
    abbrev = F.when(F.col("item.teamId") == F.col("homeTeam.id"), F.col("homeTeam.abbrev")).when(F.col("item.teamId") == F.col("awayTeam.id"), F.col("awayTeam.abbrev"))
    return r.select(F.col("id").alias("game_id"), abbrev.alias("team"), F.col("item.sweaterNumber").alias("number"), F.col("item.playerId").alias("player_id")).distinct()


def shifts(docs: DataFrame) -> DataFrame:
    """Interval rows of shift documents; rows without a clock, of no length or that cannot be read are dropped."""
    return L.shift_entries(_parts(docs, "$.data", L.SHIFT.simpleString()).where("item is not null").select("item.*"))


def players(docs: DataFrame) -> DataFrame:
    """One bio row a player; of a repeated player the document that is first by file, then by text, counts."""
    rows = docs.where("doc is not null").select("file", "value", F.try_variant_get("doc", "$", L.PLAYER.simpleString()).alias("p"))
    bios = rows.where("p.playerId is not null").select("file", "value", "p.*")
    return L.first_bios(bios, F.struct("file", "value"))


# --- time-on-ice reports --------------------------------------------------------------------------

# The classes of a report's cells and the periods that count; a shootout and later overtimes do not.
HEADING, ENTRY = "playerHeading + border", "lborder + bborder"
PERIODS = {"1": 1, "2": 2, "3": 3, "OT": 4}
_CELL = r"(?is)<td\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</td\s*>"
_CLASS = r"(?is)(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"


def report_entries(html) -> F.Column:
    """array<struct<number, heading, period, start, end, length>> of one report's page.

    Cells are told by their class, whatever tags stand inside them and either quote around it. One
    fold over the cells carries the open player and the cells seen since: five make a shift.
    """
    h = F.col(html) if isinstance(html, str) else html
    attrs, inner = (F.regexp_extract_all(h, F.lit(_CELL), F.lit(k)) for k in (1, 2))
    kind = lambda a: F.regexp_replace(F.concat(*[F.coalesce(F.regexp_extract(a, _CLASS, k), F.lit("")) for k in (1, 2, 3)]), r"\s+", " ")
    text = lambda x: F.trim(F.regexp_replace(F.replace(F.replace(F.regexp_replace(x, r"<[^>]*>", ""), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")), r"[\s ]+", " "))
    cells = F.transform(F.arrays_zip(attrs.alias("a"), inner.alias("v")), lambda c: F.struct(kind(c["a"]).alias("k"), text(c["v"]).alias("v")))
    cells = F.filter(cells, lambda c: c["k"].isin(HEADING, ENTRY))
    entry = "struct<number:int,heading:string,period:string,start:string,end:string,length:string>"
    state = f"struct<number:int,heading:string,buf:array<string>,out:array<{entry}>>"
    empty = F.struct(F.lit(None).cast("int").alias("number"), F.lit("").alias("heading"), F.array().cast("array<string>").alias("buf"), F.array().cast(f"array<{entry}>").alias("out"))

    def step(s, c):
        number = F.regexp_extract(c["v"], r"^(\d+)\s+(.*)$", 1).try_cast("int")
        opened = F.struct(number.alias("number"), F.regexp_extract(c["v"], r"^(\d+)\s+(.*)$", 2).alias("heading"), F.array().cast("array<string>").alias("buf"), s["out"].alias("out"))
        buf = F.concat(s["buf"], F.array(c["v"]))
        row = F.struct(s["number"].alias("number"), s["heading"].alias("heading"), *[F.get(buf, k).alias(n) for k, n in ((1, "period"), (2, "start"), (3, "end"), (4, "length"))])
        full = F.size(buf) == 5
        added = F.struct(
            s["number"].alias("number"), s["heading"].alias("heading"), F.when(full, F.array().cast("array<string>")).otherwise(buf).alias("buf"),
            F.when(full, F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"),
        )
        return F.when(c["k"] == HEADING, opened).when(s["number"].isNull(), s).otherwise(added).cast(state)

    return F.aggregate(cells, empty.cast(state), step, lambda s: s["out"])


def report_shifts(pages: DataFrame, sweaters: DataFrame) -> DataFrame:
    """Reports (game_id, team, html) to shift rows, sweaters resolved by `sweaters` (game_id, team, number, player_id).

    Periods other than PERIODS are skipped; a missing end is start plus length; rows without a start
    or of no length are dropped, and so are sweaters that the game does not know.
    """
    e = pages.select("game_id", "team", F.explode(report_entries("html")).alias("e")).select("game_id", "team", "e.*")
    period = F.create_map(*[F.lit(v) for pair in PERIODS.items() for v in pair])
    elapsed = lambda c: S.clock_seconds(F.trim(F.element_at(F.split(c, "/"), 1)))
    e = e.withColumn("p", F.try_element_at(period, F.trim("period"))).where("p is not null")
    start = S.game_seconds("p", F.trim(F.element_at(F.split("start", "/"), 1)))
    end = F.coalesce(S.game_seconds("p", F.trim(F.element_at(F.split("end", "/"), 1))), start + elapsed("length"))
    e = e.select("game_id", "team", "number", F.col("p").alias("period"), start.cast("int").alias("start_g"), end.cast("int").alias("end_g")).where("end_g > start_g")
    return e.join(sweaters.select("game_id", "team", "number", "player_id"), ["game_id", "team", "number"]).drop("number")
