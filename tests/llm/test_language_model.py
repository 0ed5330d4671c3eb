"""Automaton scores against counts in dictionaries, with blocks made small."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shiftgrain.llm import language_model as M
from tests.llm.test_near import words_of


def brute(rows, order, strength):
    read = lambda t: ["<s>", *words_of(t), "</s>"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    grams = Counter()
    for i, t in rows:
        if not held(i):
            w = read(t)
            for k in range(1, order + 1):
                for e in range(k, len(w) + 1):
                    grams[tuple(w[e - k : e])] += 1
    single = {g: c for g, c in grams.items() if len(g) == 1 and g != ("<s>",)}
    n, v = sum(single.values()), len(single)
    out = []
    for i, t in rows:
        w = read(t)
        base = score = 0.0
        known = 0
        for e in range(1, len(w)):
            c = single.get((w[e],), 0)
            known += c > 0
            p = (c + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                if e - k + 1 < 0:
                    break
                h = tuple(w[e - k + 1 : e])
                p = (grams[(*h, w[e])] + strength * p) / (grams[h] + strength)
            score += math.log10(p)
        out.append((i, held(i), len(w) - 1, known, n, base, score))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["of", "the", "é", "Word", "x,"] + ["v%d" % k for k in range(40)]
    rows = [(k, " ".join(rng.choices(vocabulary, [9, 9, 4, 4, 4] + [1] * 40, k=rng.randint(0, 60)))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "once " * 3000), (n + 4, rows[0][1]), (None, "no id here"), rows[1]]
    return rows


@pytest.mark.parametrize("order,block", [(1, 1 << 20), (2, 700), (3, 700), (4, 1 << 20)])
def test_scores_equal_dictionaries(spark, monkeypatch, order, block):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "BUCKET", 300)
    monkeypatch.setattr(M, "STRETCH", 17)
    rows = corpus(order)
    docs = spark.createDataFrame([(i, t, 1.0, 0) for i, t in rows], "doc_id long, text string, score double, block int")
    got = sorted((tuple(r) for r in M.score_documents(docs, order).collect()), key=repr)
    want = sorted(brute(rows, order, M.STRENGTH), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_probabilities_of_a_state_sum_to_one():
    rows = [r for r in corpus(5, 30) if r[0] is not None]
    vocabulary = sorted({w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in words_of(t)})
    for context in ("of", "v3"):
        reading = M.Reading(pa.array([f"{context} {w}" for w in [*vocabulary, "unseen-word"]] + [context]), 2)
        grams = Counter()
        for i, t in rows:
            if zlib.crc32(str(i).encode()) % 5 != 1:
                own = M.Reading(pa.array([t]), 2)
                for k in (0, 1):
                    grams.update(own.grams[k][own.valid[k]].tolist())
        counts = [np.array([grams[g] if ok else 0 for g, ok in zip(reading.grams[k].tolist(), reading.valid[k])]) for k in (0, 1)]
        single = {g: c for g, c in grams.items() if g in {*M.Reading(pa.array([t for _, t in rows]), 1).grams[0].tolist()} and g != int(M.START)}
        _, score = M.traverse(reading, counts, sum(single.values()), len(single), M.STRENGTH)
        after = [score[b + 2] for b in reading.begin[:-1]] + [score[reading.begin[-1] + 2]]
        assert abs(sum(10**s for s in after) - 1) < 1e-9


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(k, "a b") for k in range(60)], "doc_id long, text string")
    held = docs.where("crc32(cast(doc_id as string)) % 5 = 1")
    assert M.score_documents(docs.limit(0)).count() == 0
    assert {(r["train_tokens"], r["score"]) for r in M.score_documents(held).collect()} == {(0, 0.0)}


def test_packed_hashes_come_back():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (M.unpack_sorted(M.pack_sorted(x)) == x).all() and len(M.unpack_sorted(b"")) == 0


def test_states_fail_to_the_longest_shorter_context():
    reading = M.Reading(pa.array(["a b c a b d", "b d a b", "", "x"]), 3)
    train = np.array([True, True, True, False])
    counts = []
    for (_, own, entry), valid in zip(reading.table(train), reading.valid):
        full = np.zeros(len(valid), np.int64)
        full[valid] = own[entry]
        counts.append(full)
    auto = M.Automaton(reading, counts, 12, 5, 2.0)
    a, b, c, d = (auto.token[k] for k in (1, 2, 3, 6))
    state = np.zeros(1, np.int64)
    for token in (a, b):
        state, _ = auto.step(state, np.array([token]))
    ab = int(state[0])
    only_b, _ = auto.step(np.zeros(1, np.int64), np.array([b]))
    assert ab and auto.failure[ab] == only_b[0] and auto.failure[only_b[0]] == 0
    known, _ = auto.step(state, np.array([d]))  # "a b d" is known: the state is "b d"
    assert auto.failure[known[0]] == auto.first[d]
    lost, cost = auto.step(known, np.array([c]))  # neither "b d c" nor "d c" is
    assert lost[0] == auto.first[c]
    assert np.isclose(cost[0], auto.failure_cost[known[0]] + auto.failure_cost[auto.first[d]] + auto.base[c])
    unseen, _ = auto.step(state, auto.token[-2:-1])
    assert unseen[0] == 0
