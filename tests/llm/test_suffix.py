"""Suffix-array deduplication against the definition, with blocks and hot hashes made small."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from shiftgrain.llm import suffix_dedup as S


def brute(rows):
    """By definition: every window of SPAN bytes, and the least place it starts in."""
    least = {}
    texts = [(S.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for place, raw in texts:
        for k in range(len(raw) - S.SPAN + 1):
            w = raw[k : k + S.SPAN]
            least[w] = min(place, least.get(w, S.LAST))
    out = []
    for (i, _), (place, raw) in zip(rows, texts):
        gone = bytearray(len(raw))
        for k in range(len(raw) - S.SPAN + 1):
            if least[raw[k : k + S.SPAN]] < place:
                gone[k : k + S.SPAN] = b"\1" * S.SPAN
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ti", "on", "er", "é", "ß", "th", "an"]) for _ in range(rng.randint(1, 3)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.randint(5, 40)) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.4:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("xyz é")
            texts.append("".join(t))
        elif kind < 0.7:
            texts.append(prose(rng.randint(0, 20)) + rng.choice(["", " "]) + rng.choice(passages) + rng.choice(["", " "]) + prose(rng.randint(0, 20)))
        else:
            texts.append(prose(rng.randint(0, 60)))
    base = prose(40)
    for cut in range(46, 56):  # overlaps around the limit
        texts.append(prose(3) + base[10 : 10 + cut] + prose(2))
    texts += [base, None, "", "short", "a" * 49, "a" * 50, "a" * 51, "a" * 400, "ab" * 300, "ab" * 150 + "ba" * 90, "abc " * 60, "é" * 100, "xé" * 40]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [(None, texts[3]), (None, base + " more"), (None, base + " other"), rows[4], (rows[5][0], base)]


@pytest.mark.parametrize("seed,small", [(1, False), (2, True), (3, True)])
def test_removed_bytes_equal_the_definition(spark, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(S, "HOT", 3)
        monkeypatch.setattr(S, "BLOCK", 2000)
        monkeypatch.setattr(S, "ENTRIES", 50)
        monkeypatch.setattr(S, "_STEP", 128)
        monkeypatch.setattr(S, "BROADCAST_ROWS", 2)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, b"k") for i, t in rows], "doc_id long, text string, key long, spans binary")
    got = sorted(map(tuple, S.remove_repeats(docs).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("entries", [1, 40, 10**6])
def test_marks_in_pieces(monkeypatch, entries):
    monkeypatch.setattr(S, "ENTRIES", entries)
    rng = np.random.default_rng(3)
    n = 400
    context = rng.integers(0, 2, (n, S.CONTEXT)).astype(np.uint8)
    context[rng.random(n) < 0.7] = context[0]
    flip = rng.random(n) < 0.5
    context[flip, rng.integers(0, S.CONTEXT, flip.sum())] = 7
    token, place = rng.integers(0, 5, n), rng.integers(0, 60, n)
    context[:, S.LEFT] = 100 + token  # equal windows have equal owners at equal places
    low = rng.integers(0, S.GRAMS, n)
    high = np.minimum(S.GRAMS - 1, low + rng.integers(0, S.GRAMS, n))
    column = np.arange(S.CONTEXT)
    context[(column < (S.LEFT - high)[:, None]) | (column >= (S.LEFT - low + S.SPAN)[:, None])] = 0
    got = S.previous_matches(context, token, place, low.astype(np.uint8), high.astype(np.uint8))
    seen = {}
    for k in range(n):
        for b in range(low[k], high[k] + 1):
            w = (token[k], b, context[k, S.LEFT - b : S.LEFT - b + S.SPAN].tobytes())
            seen[w] = min(place[k], seen.get(w, 10**9))
    for k in range(n):
        want = sum(1 << b for b in range(low[k], high[k] + 1) if seen[token[k], b, context[k, S.LEFT - b : S.LEFT - b + S.SPAN].tobytes()] < place[k])
        assert got[k] == want


def test_texts_keep_their_columns_and_whole_characters(spark):
    rows = corpus(7, 40)
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key long")
    got = S.without_repeats(docs)
    assert got.columns == docs.columns
    cut = {r["key"]: r["text"] for r in got.collect()}
    assert cut.keys() == set(range(len(rows)))
    same = [k for k, (i, t) in enumerate(rows) if t is not None and len(t.encode()) < S.SPAN]
    assert all(cut[k] == rows[k][1] for k in same) and all("�" not in (t or "") for t in cut.values())


def test_empty_table_and_no_repeats(spark):
    docs = spark.createDataFrame([(1, "one text " * 3), (2, None), (3, "quite another text that is long enough to have a window of its own")], "doc_id long, text string")
    assert S.remove_repeats(docs.limit(0)).count() == 0
    assert {r["n_removed"] for r in S.remove_repeats(docs).collect()} == {0}


def test_longest_previous_factors_against_all_pairs():
    rng = np.random.default_rng(5)
    stems = rng.integers(97, 99, (12, S.SPAN), dtype=np.uint8)
    rows = stems[rng.integers(0, 12, 400)]
    rows[:200, S.SPAN - 1] = rng.integers(97, 99, 200)
    place = rng.integers(0, 60, 400)
    order = np.lexsort((place, *rows.T[::-1]))
    rows, place = rows[order], place[order]
    lcp = S.common_prefixes(rows)

    def shared(a, b):
        other = np.flatnonzero(rows[a] != rows[b])
        return int(other[0]) if len(other) else S.SPAN

    want = np.array([max((shared(i, j) for j in range(400) if place[j] < place[i]), default=0) for i in range(400)])
    got = S.longest_previous_factors(place, lcp)
    assert ((got >= S.SPAN) == (want >= S.SPAN)).all() and (got <= want).all() and 0 < (got >= S.SPAN).sum() < 400
    at, prefix = S.previous_smaller(place, lcp)
    for i in np.flatnonzero(prefix >= S.SPAN):
        assert place[at[i]] < place[i] and (place[at[i] + 1 : i] >= place[i]).all()
    for odd in (np.zeros(0, int), np.zeros(1, int)):
        assert len(S.longest_previous_factors(odd, np.zeros(len(odd), int))) == len(odd)


def test_a_block_is_worked_on_in_little_memory():
    """Contexts of a whole block, were all of them shared: what its windows take, by the allocations of numpy."""
    rng = np.random.default_rng(3)
    size = 5_000
    texts = ["".join(map(chr, rng.integers(97, 123, size))) for _ in range(S.BLOCK // size)]
    n = len(texts)
    block = pa.table({"block": pa.array(np.zeros(n, np.int64)), "key": pa.array(np.arange(n)), "place": pa.array(np.arange(n)), "text": pa.array(texts)})
    sent = S._send_hashes(1)(block)
    tokens = sent.column("tokens")[0].as_py()
    answers = pa.table({"block": pa.array([0], pa.int64()), "tokens": pa.array([tokens], pa.binary()), "hot": pa.array([np.zeros(len(tokens) // 6, bool).tobytes()], pa.binary())})
    tracemalloc.start()
    asked = S._send_contexts(1)(block, answers)
    first = tracemalloc.get_traced_memory()[1]
    asked = asked.filter(pc.greater_equal(asked.column("bucket"), 0))
    tracemalloc.reset_peak()
    S._meet_contexts(asked)
    second = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(first, second) < 300 << 20
