"""The pipeline's stages, each against brute force on what the one before kept."""

import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from shiftgrain.llm import suffix_dedup as S
from shiftgrain.llm.common import stage
from tests.llm import test_near, test_suffix


def test_stages_on_the_smallest_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for _, step in corpus_pipeline.STAGES:
        tables.append(stage(step(spark, tables[-1], folder)))
        if len(tables) < 6:
            assert tables[-1].columns == columns and tables[-1].schema == docs.schema
    rows = [sorted((r["doc_id"], r["text"]) for r in t.collect()) for t in tables[:5]]
    assert set(rows[1]) <= set(rows[0])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {i for i, _ in rows[1]}
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in kept for i in good]) > 0.95
    last = {}
    for i, t in rows[1]:
        last[t] = max(i, last.get(t, -1))
    assert rows[2] == sorted((i, t) for t, i in last.items())
    component = {i: c for i, _, c in test_near.brute(rows[2])}
    assert rows[3] == [(i, t) for i, t in rows[2] if component[i] == i]
    cut = {i: (size, gone) for i, size, gone, _, _ in test_suffix.brute(rows[3])}
    for i, t in rows[4]:
        size, gone = cut[i]
        assert 0 <= size - gone - len(t.encode()) <= 6 * (gone > 0) * (1 + gone // S.SPAN)
    saved = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    saved.encode_special_tokens = True
    want = sum(len(saved.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows[4])
    assert sum(r["length"] for r in tables[5].collect()) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, tables[5].collect()))


def written(spark, folder, rows, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, cid int, `a.b` string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(["tree", "river", "stone", "cloud", "amber", "window", "garden", "letter"]) + str(rng.randrange(40)) for _ in range(n))


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Null ids, null, empty, repeated and long texts, equal and near copies, clashing and dotted column names."""
    near = prose(1).split()
    near[40] = "changed"
    texts = [(1, prose(1)), (2, " ".join(near)), (3, prose(3)), (4, prose(3)), (5, None), (6, ""), (None, prose(7)), (None, None), (8, prose(8)), (8, prose(8)), (9, "word " * 30000)]
    rows = [(i, t, "en", "s", len(t or ""), "r", 7, "x") for i, t in texts]
    folder = written(spark, tmp_path, rows, [(1, 1, 0), (3, 1, 0), (None, 1, 0), (8, None, 0)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, docs, folder)
        assert kept.columns == docs.columns
        docs = corpus_pipeline.stage(kept)
    left = sorted((r["doc_id"] for r in docs.collect()), key=repr)
    assert {1, 4, 8, 9} <= set(left) and not {2, 3} & set(left) and left.count(8) >= 1
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p["doc_id"] for p in pieces} == set(left)
    assert all(p["length"] <= 1024 for p in pieces)


def test_empty_tables_and_no_labels(spark, tmp_path):
    folder = written(spark, tmp_path / "a", [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []
    folder = written(spark, tmp_path / "b", [(1, prose(1), "en", "s", 1, "r", 1, "x")], [])
    assert {p["doc_id"] for p in corpus_pipeline.run(spark, folder).collect()} == {1}


def test_quality_gives_back_what_packing_left_in_a_worker(spark):
    """A worker serves one stage after another; remembered words of the last run must not add to the first stage's memory."""
    import pandas as pd
    import public_tokenizers

    from shiftgrain.llm import byte_bpe, common, quality

    path = public_tokenizers.path("byte_bpe_50k.json")
    byte_bpe.encoder_for(byte_bpe.file_tokenizer, path, public_tokenizers.PATTERN, "<u4")
    assert byte_bpe._ENCODERS and byte_bpe.file_tokenizer.cache_info().currsize
    common.free_worker()
    assert not byte_bpe._ENCODERS and not byte_bpe.file_tokenizer.cache_info().currsize
    docs = spark.createDataFrame([(k, f"good words {k} and more " * 9, k) for k in range(600)], "doc_id long, text string, other long")
    model = quality.fit(docs, spark.createDataFrame([(k, int(k % 2)) for k in range(40)], "doc_id long, quality int"))
    kept = quality.good_documents(docs, model, -1.0).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert kept.equals(docs.toPandas().sort_values("doc_id").reset_index(drop=True)) and isinstance(kept, pd.DataFrame)
