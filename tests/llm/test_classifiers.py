"""Held-out accuracy of the two classifiers, and their defined results at the edges."""

import random
import zlib

import pytest

from shiftgrain.llm import quality as Q
from shiftgrain.llm import toxicity as T

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def outcomes(scored, labels, column):
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", column).collect()
    return {(p, y): sum(1 for r in rows if tuple(r) == (p, y)) for p in (0, 1) for y in (0, 1)}


def test_quality_on_held_out_documents(tables):
    docs, labels = tables
    n = outcomes(Q.quality(docs, labels), labels, "quality")
    assert n[1, 1] / (n[1, 1] + n[0, 1]) > 0.99 and n[0, 0] / (n[0, 0] + n[1, 0]) > 0.95


def test_toxic_words_are_found_and_clean_documents_left_alone(tables):
    docs, labels = tables
    n = outcomes(T.toxicity(docs, labels), labels, "toxic")
    assert n[1, 0] <= 2 and n[1, 1] / (n[1, 1] + n[0, 1]) > 0.8
    telling = "lower(text) rlike '(^|[^a-z])(idiot|moron|scum)([^a-z]|$)'"
    hits = T.toxicity(docs, labels).join(docs.where(telling).select("doc_id"), "doc_id")
    assert hits.where("predicted = 1").count() >= 0.95 * hits.count() > 0


def test_toxic_documents_are_found_in_every_language(tables):
    docs, labels = tables
    rows = T.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and toxic = 1").collect()
    found = {}
    for r in rows:
        found.setdefault(r["lang"], []).append(r["predicted"])
    print("held-out toxic documents found:", {k: (sum(v), len(v)) for k, v in found.items()})
    assert set(found) == {"de", "en", "es", "fr"} and all(sum(v) >= 0.6 * len(v) for v in found.values())


@pytest.mark.parametrize("score,column", [(T.toxicity, "toxic"), (Q.quality, "quality")])
def test_edges(spark, score, column):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["vile", "good", "tree", "of"]) for _ in range(12)), 0.5) for k in range(40)]
    rows += [(100, None, 0.1), (101, "", 0.1), (102, "word " * 20000, 0.1), (None, "no id", 0.1), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int("vile" in rows[k][1])) for k in range(30)] + [(31, None), (None, 1), (5000, 1), (2, 0), (2, 0)], f"doc_id long, {column} int")
    got = score(docs, labels).collect()
    assert len(got) == len(rows)
    folds, rest = (5, 0) if column == "toxic" else (4, 2)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= (0.5 if column == "toxic" else 0.7))
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == rest)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[100] == by[101]
    assert score(docs.limit(0), labels).count() == 0
    assert score(docs, labels.limit(0)).count() == len(rows)
    assert sorted(map(tuple, score(docs.repartition(3), labels).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_filter_keeps_all_columns(spark, tables):
    docs, labels = tables
    some = docs.limit(200).withColumnRenamed("lang", "c1")
    kept = Q.good_documents(some, Q.fit(docs, labels))
    assert kept.columns == some.columns and 100 < kept.count() < 200
