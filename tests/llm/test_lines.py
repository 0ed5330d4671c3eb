"""Line deduplication against all pairs of lines."""

import hashlib
import random

import pytest

from shiftgrain.llm import line_dedup as D
from tests.llm.test_near import words_of


def brute(rows):
    lines = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            lines.append(((D.LAST if i is None else i, k), frozenset(words_of(line))))
    lines = [x for x in lines if x[1]]
    gone = {p for p, s in lines for q, r in lines if q < p and 5 * len(s & r) >= 4 * len(s | r)}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        removed = [k for k in range(len(parts)) if (D.LAST if i is None else i, k) in gone]
        kept = "\n".join(x for k, x in enumerate(parts) if k not in removed)
        out.append((i, len(parts), len(removed), removed, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=70):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "É"] * 5 + ["v%d" % k for k in range(40)]
    lines = []

    def line():
        kind = rng.random()
        if lines and kind < 0.5:
            w = rng.choice(lines).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            return " ".join(w)
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))

    texts = []
    for _ in range(n):
        own = [line() for _ in range(rng.randint(1, 5))]
        lines.extend(own)
        texts.append("\n".join(own))
    texts += [None, "", "\n", "\n\nThe  OF\n", "the of\r\nof the", "x" * 2000, "word " * 3000 + "\nword"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts)) + [(None, texts[1])]


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_lines_equal_all_pairs(spark, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(D, "BUCKET", 50)
        monkeypatch.setattr(D, "NAMES", 10)
        monkeypatch.setattr(D, "HOT", 20)
        monkeypatch.setattr(D, "SLICE", 400)
        monkeypatch.setattr(D, "WANTED_BITS", 1 << 10)
        monkeypatch.setattr(D, "COMMON", 5)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, line long, cid string")
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["removed"], r["kept_sha256"]) for r in D.dedup_lines(docs).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert D.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stages_that_hold_whole_texts_begin_with_an_emptied_worker(monkeypatch):
    """Workers serve job after job: what an earlier one left must not add to what a slice of texts needs."""
    freed = []
    monkeypatch.setattr(D, "free_worker", lambda: freed.append(1))
    monkeypatch.setattr(D, "stage", lambda df: df)

    class Table:
        def mapInArrow(self, run, kinds):
            list(run(iter([])))
            return self

    D.line_rows(Table(), 1)
    assert freed == [1]
