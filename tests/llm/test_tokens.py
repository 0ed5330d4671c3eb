"""Byte-level BPE and packing against the plain libraries and by their invariants."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from shiftgrain.llm import byte_bpe as B
from shiftgrain.llm import packing as K

RANKS, SAVED = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  two  blanks ", "\n\n a\tb\r\n", "the THE the, the.", "naïve façade — 漢字 😀👍🏽", "<|endoftext|>", "it's we'll 12 345²", "x" * 5000,
    "a " * 3000, "line one.\nLine two.\n\n  Line three", "  　 x", "é" * 700, "word " * 1023,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, 1, "clash") for k, t in enumerate(TEXTS)] + [(None, "no id", 2, "c"), (3, "  two  blanks ", 1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.ranks_of(RANKS), special_tokens={})


def test_random_texts_encode_as_the_libraries_do(plain):
    saved = Tokenizer.from_file(SAVED)
    saved.encode_special_tokens = True
    ours, theirs = B.Encoder(B.rank_tokenizer(RANKS, P.PATTERN), P.PATTERN), B.Encoder(B.file_tokenizer(SAVED, P.PATTERN), P.PATTERN)
    back = B.Decoder(B.rank_tokenizer(RANKS, P.PATTERN))
    rng = random.Random(5)
    alphabet = [" ", "  ", "a", "ab", "é", "\n", "\t", "1", "²", "'s", "!", ".", "漢", "😀", "ñ", "​", "\x85", "　", "ʰ", "ß", "the", " of"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16)))
        want = plain.encode_ordinary(text)
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == want
        assert np.frombuffer(theirs.encode(text), "<u4").tolist() == saved.encode(text, add_special_tokens=False).ids
        assert back.decode(np.array(want)) == text.encode()


def test_memory_generations_do_not_change_ids(plain, monkeypatch):
    monkeypatch.setattr(B, "MEMORY", 3)
    ours = B.Encoder(B.rank_tokenizer(RANKS, P.PATTERN), P.PATTERN)
    for _ in range(2):
        text = "one two, three. four five one two, \n three"
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == plain.encode_ordinary(text)


def test_a_million_words_later_a_word_is_remembered(plain, monkeypatch):
    """The younger words alone may be a million, so what was met that long ago is not spelt again."""
    ours, spelt = B.Encoder(B.rank_tokenizer(RANKS, P.PATTERN), P.PATTERN), []
    monkeypatch.setattr(ours, "_letters", lambda word: spelt.append(word) or b"")
    letters = str.maketrans("0123456789", "abcdefghij")
    words = [str(k).translate(letters) for k in range(1_050_000)]
    for a in range(0, len(words), 50_000):
        ours.encode(" " + " ".join(words[a : a + 50_000]))
    ours.encode(" " + " ".join(words[:50_000]))
    assert len(spelt) == len(words)


def test_letters_and_marks_need_no_splitting(plain):
    ours = B.Encoder(B.rank_tokenizer(RANKS, P.PATTERN), P.PATTERN)

    def refuse(text):
        raise AssertionError(f"split: {text}")

    ours.split = refuse
    text = "one two, three. naïve?! é, ümlaut; one two\" word' end..."
    assert np.frombuffer(ours.encode(text), "<u4").tolist() == plain.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a  b", "a b ", " ", "a \n", "a \x85b c", "a \u200bb a  a", "a \u3000", "  a", "a b  \t", "\n a", "a,  b, a,\x1f b"])
def test_blanks_that_begin_no_match(plain, text):
    ours = B.Encoder(B.rank_tokenizer(RANKS, P.PATTERN), P.PATTERN)
    for _ in range(2):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == plain.encode_ordinary(text)


def test_rows_bring_no_offsets_unless_shards_are_many(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "lorem ipsum, " * (k % 41)) for k in range(400)], "doc_id long, text string").repartition(5, "doc_id")
    few = K.pack(rows, SAVED, P.PATTERN, 64)
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(K, "BROADCAST_SHARDS", 0)
    many = K.pack(rows, SAVED, P.PATTERN, 64)
    assert "Join" in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_digests_of_ids_and_bytes(docs, plain):
    got = B.round_trip_digests(docs, RANKS, P.PATTERN).collect()
    want = []
    for r in docs.collect():
        ids = np.array(plain.encode_ordinary(r["text"] or ""), "<u4")
        want.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_spans_and_cut_characters(docs):
    coded = B.encode_documents(docs, RANKS, P.PATTERN)
    for r in coded.where("doc_id = 6").collect():
        text = TEXTS[6]
        assert r["starts"][0] == 0 and r["ends"][-1] == len(text)
        assert all(a < b for a, b in zip(r["starts"], r["ends"]))
    for r in B.decode_documents(coded, RANKS, P.PATTERN).where("doc_id is not null").collect():
        assert bytes(r["raw"]).decode() == r["text"] == (TEXTS[r["doc_id"]] or "")
    back, ours = B.Decoder(B.rank_tokenizer(RANKS, P.PATTERN)), B.Encoder(B.rank_tokenizer(RANKS, P.PATTERN), P.PATTERN)
    ids = np.frombuffer(ours.encode("漢字😀👍🏽é"), "<u4")
    for a in range(len(ids)):
        for b in range(a, len(ids) + 1):
            text, before, after = back.decode_text(ids[a:b])
            raw = back.decode(ids[a:b])
            assert "�" not in text and text.encode() == raw[before : len(raw) - after]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert B.round_trip_digests(none, RANKS, P.PATTERN).count() == 0
    assert K.pack(none, SAVED, P.PATTERN).count() == 0


@pytest.mark.parametrize("window", [64, 1024])
def test_pieces_cover_every_id_once_without_padding(spark, docs, window):
    more = spark.createDataFrame([(100 + k, "lorem ipsum " * (k % 37 + 1)) for k in range(300)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(more).where("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = K.pack(table, SAVED, P.PATTERN, window, with_ids=True).collect()
    saved = Tokenizer.from_file(SAVED)
    saved.encode_special_tokens = True
    want = {r["doc_id"]: saved.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in table.collect()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and len(p["ids"]) == p["length"]
    assert by_doc.keys() == want.keys()
    for doc, own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        assert sum((p["ids"] for p in own), []) == want[doc]
        assert {p["doc_tokens"] for p in own} == {len(want[doc])}
        assert [p["start"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
    short = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
        size = sum(p["length"] for p in own)
        assert size & (size - 1) == 0 and size <= window
        short += size < window
    assert short <= window.bit_length()


def test_plan_follows_the_histogram():
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(1, 64, 5000), minlength=64)
    combos = K.combinations(np.flatnonzero(histogram), 64)
    assert (combos.sum(axis=1) == 64).all() and len(np.unique(combos, axis=0)) == len(combos)
    x = K.non_negative_least_squares(combos, np.r_[histogram, 0].astype(float))
    a = np.zeros((65, len(combos)))
    for k in range(3):
        np.add.at(a, (combos[:, k], np.arange(len(combos))), 1)
    a[0] = 0
    assert (x >= 0).all()
    gap = a @ x - np.r_[histogram, 0]
    assert (a.T @ gap > -2).all() and np.abs((a.T @ gap) * x).max() < 0.05 * histogram.max() ** 2  # optimality
    plan = K.make_plan(histogram, 64)
    assert plan.used @ np.arange(64) > 0.9 * (histogram @ np.arange(64)) and plan.used @ np.arange(64) % 64 == 0
