"""Exact deduplication and top-k search against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from shiftgrain.llm import exact_dedup as E
from shiftgrain.llm import perfect_hash as H
from shiftgrain.llm import vector_topk as V


def test_hash_is_minimal_perfect():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 1000):
        words = np.unique(rng.integers(0, 1 << 62, (n, 4)).astype(np.uint64), axis=0)
        levels, slots = H.build(words)
        assert sorted(slots.tolist()) == list(range(len(words)))
        assert (H.probe(levels, words) == slots).all()
        others = rng.integers(0, 1 << 62, (50, 4)).astype(np.uint64)
        assert ((H.probe(levels, others) >= -1) & (H.probe(levels, others) < n)).all()


def duplicates(seed):
    rng = random.Random(seed)
    pool = ["", "a", "a ", "é", "long " * 5000, "x\ny"] + ["t%d" % k for k in range(20)]
    rows = [(k, rng.choice(pool)) for k in range(100)] + [(200, None), (201, ""), (None, "a"), (None, "null ids only"), (None, "null ids only"), (7, "another"), (7, "another")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_a_dictionary(spark, monkeypatch, seed):
    monkeypatch.setattr(E, "SHARD_DIGESTS", 7)
    rows = duplicates(seed)
    docs = spark.createDataFrame([(i, t, "d", 1) for i, t in rows], "doc_id long, text string, digest string, size int")
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r)[:5] for r in E.exact_dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    stay = E.distinct_documents(docs)
    assert stay.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in stay.collect()), key=repr) == sorted({(k, t or "") for (i, k, _, kept, _), (_, t) in zip(want, rows) if kept}, key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert E.exact_dedup(docs).count() == 0 and E.distinct_documents(docs).count() == 0


def vectors(seed, n=160, d=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.2, (n, d)).astype(np.float32).astype(float)
    base[10:40] = base[10]  # ties
    rows = [(k, base[k].tolist()) for k in range(n)]
    return rows + [(1000, None), (1020, [0.1, None, 0.2, 0.3, 0.4]), (1040, [math.nan] * d), (1060, [math.inf] * d), (None, base[3].tolist()), (1080, [0.5, 0.25]), (1100, [-0.5, 0.25]), rows[5], (20, [9.0] * d)]


@pytest.mark.parametrize("seed,k", [(1, 20), (2, 3), (3, 500)])
def test_topk_equals_all_products(spark, monkeypatch, seed, k):
    monkeypatch.setattr(V, "DATA_ROWS", 30)
    monkeypatch.setattr(V, "QUERY_ROWS", 4)
    monkeypatch.setattr(V, "STRIDE", 7)
    rows = vectors(seed)
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, tile int")
    least = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * x) for x in v]
            least[i] = min(w, least.get(i, w))
    want = []
    for q, a in least.items():
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in least.items() if i != q and len(a) == len(b))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    found = V.integer_vectors(table, "vec_id", "embedding")
    got = V.topk_inner(found, found.where("vec_id % 20 = 0"), k)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert V.topk_inner(found.limit(0), found.limit(0), k).count() == 0


def test_bounds_hold_for_large_values():
    rng = np.random.default_rng(5)
    values = rng.integers(-(10**8), 10**8, (200, 6))
    low, high, cells = V.cell_bounds(values)
    at = np.arange(6)
    assert (low[at, cells] <= values).all() and (values <= high[at, cells]).all()
    row, vec, score = V.tile_topk(np.array([-1]), values[:1], np.arange(200), values, low, high, cells, 5)
    assert score.tolist() == sorted((values @ values[0]).tolist(), reverse=True)[:5] and (row == 0).all()
