"""Exact top-k inner products by vector-approximation files.

Vectors lie in blocks. Each block keeps, beside the exact integers, a quantised copy: a small cell
number per component and the least and largest value of every cell. A query block first reads only
the cells of a data block: they bound each inner product from above and below. The k-th best lower
bound rules out most vectors; the exact integers of the others are read in order of their bound
until the k-th exact score beats every bound that is left.

Tiles (query block x data block) have a fixed size, so memory does not depend on the tables. Work
and traffic are those of a stated query set against all rows; each tile sends on k rows a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftgrain.llm.common import stage

DATA_ROWS, QUERY_ROWS = 8192, 1024
CELLS = 32
#: Vectors whose exact scores are read at a time.
STRIDE = 1024

_BLOCK = "tile int, dim int, n int, ids binary, values binary, cells binary, low binary, high binary"


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(vec_id long, v array<long>): floor(scale * x) of each component, one row per id.

    Rows with a null id, a null vector, or a null or non-finite component take no part. Of rows
    that repeat an id the smallest vector counts. Scores must fit into a long.
    """
    return (
        rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
        .select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


def _blocks(vectors: DataFrame, tiles: int) -> DataFrame:
    """Vectors of equal length packed into `tiles` blocks with their approximation."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.array(rows["v"].tolist(), np.int64).reshape(len(rows), -1)
        low, high, cells = cell_bounds(values)
        return pd.DataFrame(
            {
                "tile": [int(rows["tile"].iloc[0])], "dim": [values.shape[1]], "n": [len(values)],
                "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "values": [values.tobytes()],
                "cells": [cells.tobytes()], "low": [low.tobytes()], "high": [high.tobytes()],
            }
        )

    tile = F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")
    return vectors.withColumn("tile", tile).withColumn("dim", F.size("v")).groupBy("tile", "dim").applyInPandas(pack, _BLOCK)


def cell_bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and largest value of each (component, cell), and the cell of each entry.

    Cells hold about equally many vectors; a cell without members has no meaning and is never read.
    """
    n, d = values.shape
    cells = np.empty((n, d), np.uint8)
    low, high = np.zeros((d, CELLS), np.int64), np.zeros((d, CELLS), np.int64)
    for k in range(d):
        cuts = np.unique(np.quantile(values[:, k], np.arange(1, CELLS) / CELLS, method="lower"))
        at = np.searchsorted(cuts, values[:, k], side="left")
        cells[:, k] = at
        order = np.argsort(values[:, k], kind="stable")
        first = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
        low[k, at[order][first]] = values[order[first], k]
        high[k, at[order][first]] = values[order[np.r_[first[1:], n] - 1], k]
    return low, high, cells


def tile_topk(q_ids, q, ids, values, low, high, cells, k: int):
    """(row of q, id, score) of the k best of this tile for each query, its own id left out."""
    d = values.shape[1]
    at = np.arange(d)
    lower, upper = low[at, cells], high[at, cells]
    peak = d * float(np.abs(q).max(initial=0)) * float(np.abs(values).max(initial=0))
    kind = np.float32 if peak < 2**23 else np.float64
    slack = 0.0 if peak < 2**52 else peak * 1e-12
    plus, minus = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    lower, upper = lower.astype(kind).T, upper.astype(kind).T
    above = plus @ upper + minus @ lower
    below = plus @ lower + minus @ upper
    own = q_ids[:, None] == ids[None, :]
    above[own] = -np.inf
    below[own] = -np.inf
    n = len(ids)
    floor = np.partition(below, n - k, axis=1)[:, n - k] - 2 * slack if n > k else np.full(len(q), -np.inf)
    out = []
    for row in range(len(q)):
        near = np.flatnonzero((above[row] + slack >= floor[row]) & np.isfinite(above[row]))
        near = near[np.argsort(-above[row, near], kind="stable")]
        best_id, best = np.empty(0, np.int64), np.empty(0, np.int64)
        for start in range(0, len(near), STRIDE):
            part = near[start : start + STRIDE]
            if len(best) == k and above[row, part[0]] + slack < best[-1]:
                break
            best_id, best = np.r_[best_id, ids[part]], np.r_[best, values[part] @ q[row]]
            first = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[first], best[first]
        out.append((np.full(len(best), row), best_id, best))
    return tuple(np.concatenate(x) for x in zip(*out))


def topk_inner(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k largest inner products of each query.

    `vectors` and `queries` are (vec_id, v array<long>) with distinct ids. A query does not meet the
    row of its own id; ties go to the smaller id; only vectors of the query's length are compared.
    Fewer than k candidates give fewer rows; empty tables give none.
    """
    vectors, queries = stage(vectors), stage(queries)
    tiles = max(1, -(-vectors.count() // DATA_ROWS))
    q_tiles = max(1, -(-queries.count() // QUERY_ROWS))
    data = _blocks(vectors, tiles).withColumn("q_tile", F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1))))
    ask = _blocks(queries, q_tiles).withColumnRenamed("tile", "q_tile").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        a, b = left.iloc[0], right.iloc[0]
        grid = lambda r, name, kind, shape: np.frombuffer(r[name], kind).reshape(shape)
        q_ids, ids = np.frombuffer(b["ids"], np.int64), np.frombuffer(a["ids"], np.int64)
        d, n = int(a["dim"]), int(a["n"])
        row, vec, score = tile_topk(
            q_ids, grid(b, "values", np.int64, (int(b["n"]), d)), ids, grid(a, "values", np.int64, (n, d)),
            grid(a, "low", np.int64, (d, CELLS)), grid(a, "high", np.int64, (d, CELLS)), grid(a, "cells", np.uint8, (n, d)), k,
        )
        return pd.DataFrame({"query_id": q_ids[row], "vec_id": vec, "score": score})

    key = ["tile", "q_tile", "dim"]
    found = data.groupBy(*key).cogroup(ask.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
