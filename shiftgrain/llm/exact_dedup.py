"""Exact deduplication against a minimal perfect hash over the digests already seen.

The history's distinct digests are cut into shards by their leading bytes. A task builds a minimal
perfect hash over its shard; each slot holds a full digest, the id of the row that stays and the
group's size. Later rows, pre-aggregated by digest, are dealt out to the same shards and probed;
a slot counts only when all its 32 bytes agree. Digests that are no members group by themselves.

Rows move as (id, 32 bytes). A text copied into a third of all rows is reduced to one row per map
task before any shuffle; the final join back to the rows is an equality join that adaptive
execution may split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.llm.common import shuffle_partitions, stage, texts
from shiftgrain.llm.perfect_hash import build, probe

#: Distinct digests of a shard, so that one task holds about 10 MB.
SHARD_DIGESTS = 100_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest binary): SHA-256 of the whole text in UTF-8; a null text counts as empty."""
    t = texts(docs, id_col, text_col)
    return t.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest id (null only if all are) and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("size"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int"))


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), 4)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard of `history` (digest, winner, size): the hash and its slots."""

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        words = _words(rows["digest"])
        levels, slots = build(words)
        order = np.argsort(slots)
        winner = rows["winner"].astype("Int64")
        return pd.DataFrame(
            {
                "shard": [int(rows["shard"].iloc[0])],
                "lengths": [[len(x) for x in levels]],
                "bits": [b"".join(np.packbits(x).tobytes() for x in levels)],
                "digests": [words[order].tobytes()],
                "winners": [winner.fillna(0).to_numpy(np.int64)[order].tobytes()],
                "unnamed": [winner.isna().to_numpy()[order].tobytes()],
                "sizes": [rows["size"].to_numpy(np.int64)[order].tobytes()],
            }
        )

    return _sharded(history, shards).groupBy("shard").applyInPandas(
        shard, "shard int, lengths array<long>, bits binary, digests binary, winners binary, unnamed binary, sizes binary"
    )


def _load(row) -> tuple[list[np.ndarray], np.ndarray, pd.array, np.ndarray]:
    levels, at = [], 0
    for n in row["lengths"]:
        packed = np.frombuffer(row["bits"], np.uint8, (n + 7) // 8, at)
        levels.append(np.unpackbits(packed, count=n).astype(bool))
        at += len(packed)
    winners = pd.arrays.IntegerArray(np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["unnamed"], bool).copy())
    return levels, np.frombuffer(row["digests"], np.uint64).reshape(-1, 4), winners, np.frombuffer(row["sizes"], np.int64).copy()


def resolve(index: DataFrame, arrivals: DataFrame, shards: int) -> DataFrame:
    """All groups (digest, keep_id, group_size, historical) of the history and of `arrivals` (digest, winner, size).

    An arrival whose digest sits in its slot joins that group, whose historical winner stays; the
    other arrivals stand as groups of their own.
    """

    def shard(slots: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        lone = np.ones(len(rows), bool)
        if len(slots):
            levels, held, winners, sizes = _load(slots.iloc[0])
            if len(rows):
                words = _words(rows["digest"])
                at = probe(levels, words)
                member = at >= 0
                member[member] = (held[at[member]] == words[member]).all(axis=1)
                np.add.at(sizes, at[member], rows["size"].to_numpy(np.int64)[member])
                lone = ~member
            raw = held.tobytes()
            parts.append(pd.DataFrame({"digest": [raw[k : k + 32] for k in range(0, len(raw), 32)], "keep_id": winners, "group_size": sizes, "historical": True}))
        if lone.any():
            rest = rows[lone]
            parts.append(pd.DataFrame({"digest": rest["digest"], "keep_id": rest["winner"].astype("Int64"), "group_size": rest["size"], "historical": False}))
        return pd.concat(parts, ignore_index=True)

    return index.groupBy("shard").cogroup(_sharded(arrivals, shards).groupBy("shard")).applyInPandas(
        shard, "digest binary, keep_id long, group_size long, historical boolean"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, historical.

    Of equal texts the row with the largest id stays. Rows in the upper half of the id range are
    the history: no arrival can win against them, so their winners are final when the rest is
    probed. `historical` says whether the row's text is in that index.

    Null text: empty. Null id: an arrival that loses to any id; texts that occur only under null
    ids have keep_id null and are kept. Rows equal in id and text are one document: all of them
    carry the same result. An empty table gives an empty result.
    """
    rows = stage(digests(docs, id_col, text_col))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    middle = low + (high - low) // 2 if low is not None else 0
    late = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    shards = max(shuffle_partitions(docs.sparkSession), -(-n // SHARD_DIGESTS))
    groups = resolve(build_index(grouped(rows.where(late)), shards), grouped(rows.where(~late)), shards)
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "historical"
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; rows equal in id and text leave one."""
    found = stage(exact_dedup(docs, id_col, text_col))
    key = [F.col(f"`{id_col}`").cast("long").alias("_id"), F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256).alias("_sha")]
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *key)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_gone_sha")).distinct()
    stay = tagged.join(gone, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_sha") == F.col("_gone_sha")), "left_anti")
    repeated = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not repeated.isEmpty():
        stay = stay.dropDuplicates(["_id", "_sha"])
    return stay.select("_row.*")
