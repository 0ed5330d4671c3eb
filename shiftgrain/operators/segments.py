"""Ordered scans over a key whose rows may not fit one task.

A window over a whole key puts every row of that key in one task. Here a key is cut into time
segments, the window runs inside a segment, and what crosses a border (previous row, last seen
value, running total) travels through one summary row per segment. The only window over the whole
key reads those summaries, whose number is the length of the clock over the segment width, however
many rows the key has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_S = 60


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    order: Sequence[str],
    *,
    previous: Mapping[str, str] | None = None,
    last_seen: Mapping[str, Column] | None = None,
    seen_before: Mapping[str, Column] | None = None,
    running_before: Mapping[str, Column] | None = None,
    width: int = SEGMENT_S,
) -> DataFrame:
    """Add ordered-scan columns per `keys`, ordered by (`time`, *`order`).

    previous        new column <- column of the previous row
    last_seen       new column <- last non-null value of the expression up to and including the row
    seen_before     the same, strictly before the row
    running_before  sum of the expression over the rows strictly before the row
    """
    previous, last_seen = dict(previous or {}), dict(last_seen or {})
    seen_before, running_before = dict(seen_before or {}), dict(running_before or {})
    keys, ordering = list(keys), [time, *order]
    seg_keys = keys + ["_seg"]
    df = df.withColumn("_seg", F.floor(F.col(time) / width).cast("long"))
    for n, e in {**last_seen, **seen_before}.items():
        df = df.withColumn(f"_v_{n}", e)
    for n, e in running_before.items():
        df = df.withColumn(f"_s_{n}", F.coalesce(e, F.lit(0)))

    rank = F.struct(*ordering)
    tails = []
    if previous:
        row = F.struct(*[F.col(c).alias(n) for n, c in previous.items()])
        df = df.withColumn("_row", row)
        tails.append(F.max_by("_row", rank).alias("_t_row"))
    for n in [*last_seen, *seen_before]:
        seen = F.col(f"_v_{n}").isNotNull()
        tails.append(F.max_by(F.when(seen, F.col(f"_v_{n}")), F.when(seen, rank)).alias(f"_t_{n}"))
    for n in running_before:
        tails.append(F.sum(f"_s_{n}").alias(f"_t_{n}"))

    over_keys = Window.partitionBy(*keys).orderBy("_seg")
    earlier = over_keys.rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(*seg_keys).agg(*tails)
    carried = [F.col(c) for c in seg_keys]
    if previous:
        carried.append(F.lag("_t_row").over(over_keys).alias("_c_row"))
    for n in [*last_seen, *seen_before]:
        carried.append(F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}"))
    for n in running_before:
        carried.append(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}"))
    carry = carry.select(*carried)

    inside = Window.partitionBy(*seg_keys).orderBy(*ordering)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = [F.col(c) for c in df.columns]
    if previous:
        local.append(F.lag("_row").over(inside).alias("_l_row"))
    for n in last_seen:
        local.append(F.last(f"_v_{n}", ignorenulls=True).over(upto).alias(f"_l_{n}"))
    for n in seen_before:
        local.append(F.last(f"_v_{n}", ignorenulls=True).over(before).alias(f"_l_{n}"))
    for n in running_before:
        local.append(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_l_{n}"))
    joined = df.select(*local).join(carry, seg_keys, "left")

    keep = [c for c in df.columns if not c.startswith("_")]
    out = [F.col(c) for c in keep]
    if previous:
        both = F.coalesce("_l_row", "_c_row")
        out += [both[n].alias(n) for n in previous]
    out += [F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in [*last_seen, *seen_before]]
    out += [(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in running_before]
    return joined.select(*out)


def recent_count(
    df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], name: str, span: int
) -> DataFrame:
    """Rows of the same key within `span` before each row, itself and later same-instant rows excluded.

    Counts are first reduced to one row per key and instant; the range window reads only those.
    """
    keys = list(keys)
    per_instant = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(time).rangeBetween(-span, -1)
    earlier = per_instant.select(*keys, time, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inst = Window.partitionBy(*keys, time).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(inst) - 1)
        .join(earlier, [*keys, time])
        .withColumn(name, (F.col("_before") + F.col("_rn")).cast("long"))
        .drop("_rn", "_before")
    )
