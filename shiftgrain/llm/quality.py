"""Quality by voting of the nearest labelled neighbours in a latent semantic space.

A document's terms are the shapes of its words (capitals, other letters, digits and marks, runs as
one), pairs of neighbouring shapes, words that repeat their predecessor, and the words themselves.
Their log counts weighted by rarity are projected on the leading singular vectors of a labelled
sample. Exact cosines of every document with every labelled vector are taken block by block; the
NEIGHBOURS most similar labels vote with their similarity.

The labelled sample is bounded (PER_CLASS for each label); it, the vocabulary and the projection are
all that is broadcast. Scoring has no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.llm.common import free_worker, is_fold, slices, stage, texts
from shiftgrain.llm.perfect_hash import mix
from shiftgrain.llm.words import BASE, BYTE_WORDS, utf8, word_hashes, word_spans

#: Labelled documents of each class, by order of a hash of the id; terms; dimensions; voters; documents of a block.
PER_CLASS, TERMS, DIMENSIONS, NEIGHBOURS, BLOCK = 2000, 2048, 64, 15, 256

#: Classes of bytes: capitals, other letters, digits; bytes past ASCII are passed over; marks stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B] = 0x41
_CLASS[0x61:0x7B] = 0x61
_CLASS[0x30:0x3A] = 0x30
_CLASS[0x80:] = 0
_KINDS = mix(np.arange(4, dtype=np.uint64))


def shape_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: its classes with runs as one, at most the first eight."""
    starts, ends, _ = word_spans(data, offsets)
    classes = _CLASS[data]
    keep = classes != 0
    position = np.flatnonzero(keep)
    own = classes[position]
    word = np.searchsorted(starts, position, side="right") - 1
    inside = (word >= 0) & (position < ends[np.maximum(word, 0)])
    own, word = own[inside], word[inside]
    fresh = np.r_[True, (own[1:] != own[:-1]) | (word[1:] != word[:-1])] if len(own) else np.zeros(0, bool)
    own, word = own[fresh], word[fresh]
    begin = np.searchsorted(word, np.arange(len(starts)))
    size = np.minimum(np.diff(np.r_[begin, len(word)]), 8)
    h = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(8):
            has = size > k
            h[has] = h[has] * BASE + BYTE_WORDS[own[begin[has] + k]]
        return mix(h + _KINDS[0])


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of all terms of a batch of texts, by document and term."""
    data, offsets = utf8(column)
    words, first = word_hashes(data, offsets)
    shapes = shape_hashes(data, offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    same = row[1:] == row[:-1]
    with np.errstate(over="ignore"):
        pairs = mix(shapes[:-1] * BASE + shapes[1:] + _KINDS[1])[same]
        echo = row[1:][same & (words[1:] == words[:-1])]
        terms = np.r_[shapes, pairs, np.full(len(echo), _KINDS[2]), words ^ _KINDS[3]]
    owner = np.r_[row, row[1:][same], echo, row]
    by = np.lexsort((terms, owner))
    owner, terms = owner[by], terms[by]
    begin = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1])]) if len(owner) else np.zeros(0, np.int64)
    return owner[begin], terms[begin], np.diff(np.r_[begin, len(owner)])


class Space:
    """Vocabulary, rarity and projection of a sample of documents."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]]):
        """`docs`: (terms, counts) of each sampled document."""
        terms, df = np.unique(np.concatenate([t for t, _ in docs]), return_counts=True)
        best = np.lexsort((terms, -df))[:TERMS]
        best = np.sort(best[df[best] >= 2]) if (df >= 2).any() else np.sort(best)
        self.terms = terms[best]
        self.rarity = np.log((1 + len(docs)) / (1 + df[best])).astype(np.float32) + np.float32(1)
        self.axes = np.eye(len(self.terms), dtype=np.float32)[:, :DIMENSIONS]
        row = np.repeat(np.arange(len(docs)), [len(t) for t, _ in docs])
        matrix = self.weigh(row, np.concatenate([t for t, _ in docs]), np.concatenate([c for _, c in docs]), len(docs))
        value, vector = np.linalg.eigh(matrix.T.astype(np.float64) @ matrix)
        self.axes = np.ascontiguousarray(vector[:, ::-1][:, :DIMENSIONS], np.float32)
        self.vectors = self.project(matrix)

    def weigh(self, row, term, count, n: int) -> np.ndarray:
        """Unit rows of log counts times rarity."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        out = np.zeros((n, len(self.terms)), np.float32)
        out[row[hit], at[hit]] = (1 + np.log(count[hit])) * self.rarity[at[hit]]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def project(self, matrix: np.ndarray) -> np.ndarray:
        low = matrix @ self.axes
        return low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12)


def vote(vectors: np.ndarray, space: Space, label: np.ndarray, weight: np.ndarray, prior: float) -> np.ndarray:
    """Similarity-weighted mean label of the nearest neighbours; the prior where none is similar."""
    cosine = vectors @ space.vectors.T
    k = min(NEIGHBOURS, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    force = np.maximum(np.take_along_axis(cosine, near, 1), 0) * weight[near]
    total = force.sum(axis=1)
    return np.where(total > 0, (force * label[near]).sum(axis=1) / np.maximum(total, 1e-12), prior)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """(space, labels, weights, prior) of a sample of `labels` (id, label), or None without any.

    Up to PER_CLASS documents of each label; a class that was cut weighs as much as it has labels.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").distinct()
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    cut = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for c in (0, 1)]
    chosen = texts(docs, id_col, text_col).join(F.broadcast(cut[0].union(cut[1])), "doc_id")  # at most 2 PER_CLASS ids

    def run(batches):
        free_worker()
        for batch in slices(batches, BLOCK):
            row, term, count = term_counts(batch.column("text"))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            parts = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([term[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([count[a:b].astype(np.int64).tobytes() for a, b in parts], pa.binary())],
                names=["doc_id", "label", "terms", "counts"],
            )

    found = stage(chosen.mapInArrow(run, "doc_id long, label int, terms binary, counts binary"))
    # A document of many words has many rare terms; only terms that several documents share can serve.
    rows = sorted(found.toLocalIterator(), key=lambda r: (r["doc_id"], r["label"], r["terms"]))
    if not rows:
        return None
    label = np.array([r["label"] for r in rows], np.float32)
    space = Space([(np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in rows])
    sampled = np.array([(label == c).sum() for c in (0, 1)])
    weight = np.array([total.get(c, 0) / max(1, sampled[c]) for c in (0, 1)], np.float32)
    return space, label, weight[label.astype(int)], total.get(1, 0) / max(1, sum(total.values()))


def _scores(column: pa.Array, model) -> np.ndarray:
    score = np.full(len(column), 0.5)
    if model is not None:
        space, label, weight, prior = model
        for a in range(0, len(column), BLOCK):
            part = column.slice(a, BLOCK)
            score[a : a + BLOCK] = vote(space.project(space.weigh(*term_counts(part), len(part))), space, label, weight, prior)
    return score


def score_texts(docs: DataFrame, model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every whole text; without a model the score is 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS x DIMENSIONS and 2 PER_CLASS x DIMENSIONS numbers

    def run(batches):
        free_worker()
        for batch in batches:
            score = _scores(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Learns labels only where crc32 of the id modulo `folds` is not `held_out`; a null id is never held
    out and its label never learnt. Null and empty texts, and texts without a known term, get the
    share of good labels. Null labels are left out; repeated rows are scored alike; an empty table
    gives no rows.
    """
    model = fit(docs, labels.where(~is_fold(F.col("doc_id"), folds, held_out)))
    return score_texts(docs, model).select("doc_id", is_fold(F.col("doc_id"), folds, held_out).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, with all their columns.

    Null and empty texts score the share of good labels. Without a model (no labelled document) nothing
    can be judged and every row stays.
    """
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{k}" for k in range(len(docs.columns))]
    where = docs.columns.index(text_col)

    def run(batches):
        free_worker()
        for batch in slices(batches, BLOCK):
            yield batch.filter(pa.array(_scores(batch.column(where), shared.value) >= threshold))

    plain = docs.toDF(*names).withColumn(names[where], F.col(names[where]).cast("string"))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
