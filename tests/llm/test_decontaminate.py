"""Benchmark windows against plain Python, in one set and in many."""

import random
import re

import pytest

from shiftgrain.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def naive(docs, items, width=10):
    """(doc_id, n_words, hit words as a sorted list, items) of each document."""
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, ids = WORD.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found is not None:
                    hit |= set(range(k, k + n))
                    ids |= {str(x) for x in found if x is not None}
        out.append((doc, len(w), sorted(hit), sorted(ids)))
    return out


def tables(seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "c3", "é", "ÀB", "日本", "zz", "Q" * 300]
    blanks = [" ", "  ", "\n", "-", "...", "\x00", "\x7f"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice(blanks) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 25, 40]))) for k in range(12)]
    items += [(None, text(12)), (3, text(15)), (50, ""), (51, None), (52, "!!"), (10, items[2][1]), (9, items[2][1])]
    docs = []
    for k in range(40):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(items)[1] or "", text(rng.randint(0, 5))]
        docs.append((k, ", ".join(parts)))
    docs += [(100, None), (101, ""), (102, "- ! -"), (None, items[0][1]), (7, items[4][1]), (7, items[4][1]), (103, text(20000) + " " + (items[5][1] or ""))]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "x", 1, [2]) for d, t in docs], "doc_id long, text string, `text.b` string, marks int, ranges array<int>"),
        spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, bytes string"),
    )


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("pairs,size", [(10**6, 10**9), (30, 10**9), (10**6, 2000)])
def test_ranges_equal_plain_python(spark, seed, pairs, size):
    docs, items = tables(seed)
    got = D.find_benchmark(*frames(spark, docs, items), pairs=pairs, size=size).collect()
    flat = [(r["doc_id"], r["n_words"], [k for x in r["ranges"] for k in range(x["a"], x["b"])], sorted(r["items"])) for r in got]
    assert sorted(flat, key=repr) == sorted(naive(docs, items), key=repr)
    assert all(r["n_hit"] == sum(x["b"] - x["a"] for x in r["ranges"]) for r in got)
    assert any(r["n_hit"] for r in got) and any(r["n_words"] and not r["n_hit"] for r in got)


@pytest.mark.parametrize("pairs", [10**6, 30])
def test_spans_are_cut_out_and_documents_dropped(spark, monkeypatch, pairs):
    monkeypatch.setattr(D.window_sets, "__defaults__", (pairs, 10**9))
    docs, items = tables(3)
    left, right = frames(spark, docs, items)
    hit = {(d, repr(t)): h for (d, t), (_, _, h, _) in zip(docs, naive(docs, items))}
    kept = D.clean(left, right)
    assert kept.columns == left.columns
    want = []
    for doc, text in docs:
        if text is not None:
            spans = [m.span() for m in WORD.finditer(lower(text))]
            runs = []
            for k in hit[doc, repr(text)]:
                if runs and runs[-1][1] == k:
                    runs[-1][1] = k + 1
                else:
                    runs.append([k, k + 1])
            for a, b in reversed(runs):
                text = text[: spans[a][0]] + text[spans[b - 1][1] :]
        want.append((doc, text))
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr) == sorted(want, key=repr)
    stay = D.clean(left, right, whole=True)
    assert stay.columns == left.columns
    assert sorted([(r["doc_id"], r["text"]) for r in stay.collect()], key=repr) == sorted([(d, t) for d, t in docs if not hit[d, repr(t)]], key=repr)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b"), (2, None)], [(1, "a")])
    assert D.find_benchmark(docs.limit(0), items).collect() == []
    assert [(r["n_hit"], r["ranges"], r["items"]) for r in D.find_benchmark(docs, items.limit(0)).collect()] == [(0, [], [])] * 2
    assert D.clean(docs, items.limit(0)).count() == 2 and D.clean(docs.limit(0), items).count() == 0
