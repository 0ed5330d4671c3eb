"""The n-gram join against all pairs, with its blocks made small enough to be cut."""

import random
import re

import numpy as np
import pytest

from shiftgrain.llm import ngram_join as J
from shiftgrain.llm.count_tree import CountTree, count_vector, similar
from shiftgrain.llm.words import shingle_sets, utf8, word_hashes


def words_of(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", folded) if w]


def shingles_of(text, width=5):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def brute(rows):
    sets = [shingles_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]) and both:
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = top(k)
        if i is not None and (least.get(r) is None or i < least[r]):
            least[r] = i
    return sorted(((i, len(s), least.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            w = words_of(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        elif kind < 0.7:
            texts.append(" ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 40))] + passage))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))))
    texts += [None, "", " \n\t ", "One two", "one  TWO", "a b c d e", "x" * 3000, "é É", "lone word " * 4000]
    rows = [(k * 3 % 1009, t) for k, t in enumerate(texts)]
    return rows + [(None, texts[0]), (None, "only here without an id " * 3), rows[1], (rows[2][0], texts[5])]


@pytest.mark.parametrize("seed,small", [(1, False), (2, True), (3, True)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(J, "BUCKET", 120)
        monkeypatch.setattr(J, "MEMBERS", 5 if seed == 2 else 40)
        monkeypatch.setattr(J, "CENTRAL", 2)
        monkeypatch.setattr(J, "COMMON", 7)
        monkeypatch.setattr(J, "BROADCAST_ROWS", 3)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, cid string")
    got = sorted((tuple(r)[:3] for r in J.near_duplicates(docs).collect()), key=repr)
    assert got == brute(rows)


def test_no_links_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in J.near_duplicates(docs).collect()) == [(1, 1, 1), (2, 1, 2), (3, 0, 3)]
    assert J.near_duplicates(docs.limit(0)).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(150):
        if sets and rng.random() < 0.6:
            s = sets[rng.integers(len(sets))].copy()
            s[: rng.integers(0, 1 + len(s) // 6)] = rng.integers(0, 2**63, 1)
            sets.append(np.unique(s))
        else:
            sets.append(np.unique(rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)))
    sizes = np.array([len(s) for s in sets])
    tree = CountTree(np.stack([count_vector(s) for s in sets]), sizes)
    labels = np.arange(len(sets))
    found = {tuple(sorted(p)) for i, j, _ in tree.candidates(labels) for p in zip(i.tolist(), j.tolist())}
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert want <= found and len(want) > 20
    assert all(similar(sets[a], sets[b]) == ((a, b) in want) for a, b in found)


def test_word_and_shingle_hashes_follow_the_definition():
    import pyarrow as pa

    texts = [t for _, t in corpus(9, 60)]
    data, offsets = utf8(pa.array(texts))
    hashes, first = word_hashes(data, offsets)
    seen = {}
    for k, t in enumerate(texts):
        own = hashes[first[k] : first[k + 1]].tolist()
        assert len(own) == len(words_of(t))
        for w, h in zip(words_of(t), own):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [len(s) for s in shingle_sets(data, offsets)] == [len(shingles_of(t)) for t in texts]


def test_fine_bounds_are_multiset_overlaps_and_lose_nothing():
    import pandas as pd

    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, 400).astype(np.uint64) >> np.uint64(rng.integers(0, 50))) for _ in range(12)]
    sets += [np.unique(np.r_[sets[k][: 9 * len(sets[k]) // 10], rng.integers(0, 2**63, 3).astype(np.uint64)]) for k in range(12)]
    rows = pd.DataFrame({"n": [len(s) for s in sets], "fine": [np.sort(s.astype(np.uint16)).tobytes() for s in sets]})
    fine = J.Fine(rows)
    i, j = (x.astype(np.int64) for x in np.triu_indices(len(sets), 1))
    a, b, bound = fine.keep(i, j)
    kept = dict(zip(zip(a.tolist(), b.tolist()), bound.tolist()))
    for x, y in zip(i.tolist(), j.tolist()):
        values = np.unique(np.r_[fine.bits[x], fine.bits[y]])
        overlap = sum(min(int((fine.bits[x] == v).sum()), int((fine.bits[y] == v).sum())) for v in values)
        assert kept.get((x, y), overlap) == overlap
        assert (x, y) in kept or 9 * overlap < 4 * (len(sets[x]) + len(sets[y]))
        assert (x, y) in kept or not similar(sets[x], sets[y])
    assert len(kept) < len(i) and not fine.seen.any()
    assert all(len(x) == 0 for x in fine.keep(i[:0], j[:0]))


def test_names_with_dots_and_clashes_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4), (3, None, 5, 6)], "doc_id long, text string, `a.b` int, _row int")
    kept = J.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d e f", 1, 2), (3, None, 5, 6)]


def test_narrowed_hashes_still_join_every_pair_that_can_be_similar(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    passage = rng.integers(0, 10**6, 30)  # thirty hashes that all classes of a kind have are one entry a class
    kept, size = {}, {}
    for c in range(60):
        own = rng.integers(0, 10**6, 12)
        kept[c] = {int(t) for t in (np.r_[passage, own[:3]] if c % 2 else np.r_[own, rng.choice(passage, 8)])}
        if c > 40:
            kept[c] = {t for t in kept[c - 2] if rng.random() < 0.9} | {int(own[0])}
        size[c] = int(rng.integers(30, 100))
    root = {c: c - c % 3 for c in kept}
    fewest = lambda n: max(1, n * 4 // 5 // 10)
    rooted = spark.createDataFrame([(t, c, root[c]) for c, own in kept.items() for t in own], "token long, cid long, root long")
    sizes = spark.createDataFrame(list(size.items()), "cid long, n long")
    found = J._narrowed(rooted, sizes, F.greatest(F.lit(1), F.floor(F.floor(F.col("n") * J.NUM / J.DEN) / 10))).collect()
    at = {}
    for r in found:
        at.setdefault(r["token"], set()).add(r["cid"])
        assert r["root"] == root[r["cid"]] and r["low"] == min(x["root"] for x in found if x["token"] == r["token"])
    joined = {(a, b) for own in at.values() for a in own for b in own}
    asked = {(a, b) for a in kept for b in kept if root[a] != root[b] and len(kept[a] & kept[b]) >= max(fewest(size[a]), fewest(size[b]))}
    assert asked <= joined and len(asked) > 500
    assert len(found) < 0.8 * len([1 for c, own in kept.items() for t in own if len({root[x] for x, o in kept.items() if t in o}) > 1])
