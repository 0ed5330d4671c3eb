"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; any documents, whatever they are, the unlabelled ones.
With the class prior p, the risk of a scorer f is p R+(P) + max(0, R-(U) - p R-(P)): the negatives'
risk is the unlabelled risk less the positives' share, kept from falling below zero, where training
takes the opposite step (Kiryo, Niu, du Plessis and Sugiyama 2017). Members of an ensemble train in
numpy on bootstrap samples, one task each; scoring reads every word of every text.

The samples are bounded (POSITIVES, UNLABELLED), so the model is a few thousand numbers whatever the
table's size. Scoring has no shuffle.

Features are words and word prefixes by number of occurrences, so a class that is spread over many
inflected words is seen in every language. The features that differ most between the classes are
ranked and the penalty weighs them; there is no fixed limit of significance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.llm.common import is_fold, stage, texts
from shiftgrain.llm.words import prefix_hashes, utf8, word_hashes

#: Bounds of the training samples, by order of a hash of the id.
POSITIVES, UNLABELLED = 3000, 6000
MEMBERS = 3
#: Features of a member, the bytes of the word prefixes (inflected words share them), and up to how many
#: occurrences of a token count.
VOCABULARY, PREFIXES, LEVELS = 1024, (4, 5, 6, 7), 3
EPOCHS, RATE, PENALTY = 400, 0.05, 1e-3

#: ASCII marks count as white space, so a word is the same with any punctuation.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and every word prefix of PREFIXES bytes."""
    data, offsets = utf8(column)
    plain = _PLAIN[data]
    hashes, first = word_hashes(plain, offsets)
    text, stems = prefix_hashes(plain, offsets, PREFIXES)
    return np.r_[np.repeat(np.arange(len(offsets) - 1), np.diff(first)), text], np.r_[hashes, stems]


def _features(tokens: np.ndarray) -> np.ndarray:
    """Sorted distinct features of a text: token h is h at its first occurrence, h + 1 at its second, up to LEVELS."""
    once, n = np.unique(tokens, return_counts=True)
    with np.errstate(over="ignore"):
        return np.sort(np.concatenate([once[n > k] + np.uint64(k) for k in range(LEVELS)]))


def _known(row: np.ndarray, found: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those (row, found) whose hash is one of the sorted `terms`, as (row, place)."""
    if not len(terms):
        return row[:0], np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
    hit = terms[at] == found
    return row[hit], at[hit]


def _presence(sets: list[np.ndarray], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of each term present in a document."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return _known(row, np.concatenate([*sets, np.zeros(0, np.uint64)]), terms)


def choose_terms(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """The VOCABULARY features whose shares among positives and negatives differ most, sorted.

    The negatives' share is the unlabelled share less the positives' part in it.
    """
    terms, df = np.unique(np.concatenate(positive), return_counts=True)
    terms = terms[df >= 2]
    share_p = df[df >= 2] / len(positive)
    share_u = np.bincount(_presence(unlabelled, terms)[1], minlength=len(terms)) / len(unlabelled)
    share_n = np.clip((share_u - prior * share_p) / (1 - prior), 0, 1)
    spread = lambda s, n: (s * (1 - s) + 1 / n) / n
    z = np.abs(share_p - share_n) / np.sqrt(spread(share_p, len(positive)) + spread(share_n, len(unlabelled)))
    best = np.argsort(-z, kind="stable")[:VOCABULARY]
    return np.sort(terms[best])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(terms, weights, bias) that minimise the non-negative risk with logistic losses."""
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return np.zeros(0, np.uint64), np.zeros(0), bias
    terms = choose_terms(positive, unlabelled, prior)
    (rp, cp), (ru, cu) = _presence(positive, terms), _presence(unlabelled, terms)
    n, m, k = len(positive), len(unlabelled), len(terms)
    w = np.r_[np.zeros(k), bias]
    first, second = np.zeros(k + 1), np.zeros(k + 1)

    def slope(row, col, g, size):
        return np.r_[np.bincount(col, g[row], k), g.sum()] / size

    for step in range(1, EPOCHS + 1):
        fp = np.bincount(rp, w[cp], n) + w[-1]
        fu = np.bincount(ru, w[cu], m) + w[-1]
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up, uu = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        of_negative = slope(ru, cu, uu, m) - prior * slope(rp, cp, up, n)
        g = prior * slope(rp, cp, up - 1, n) + of_negative if negative >= 0 else -of_negative
        g[:-1] += PENALTY * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return terms, w[:-1], float(w[-1])


def _word_sets(batches):
    for batch in batches:
        text, tokens = _tokens(batch.column("text"))
        tokens = tokens[np.argsort(text, kind="stable")]
        first = np.r_[0, np.cumsum(np.bincount(text, minlength=batch.num_rows))]
        sets = [_features(tokens[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(sets, pa.binary())], names=["positive", "words"])


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[tuple[np.ndarray, np.ndarray, float]], float]:
    """(members, prior) from `labels` (id, label): all its labels may be learnt.

    Without a given prior it is the mean label, kept inside (0, 1). Equal texts count once among the
    positives. Without positives every member is the prior alone.
    """
    own = texts(docs, id_col, text_col)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label is not null")
    rate, n = known.agg(F.avg("label"), F.count(F.lit(1))).first()
    prior = float(np.clip(prior if prior is not None else rate or 0.0, 0.5 / (n + 1), 1 - 0.5 / (n + 1))) if n else prior or 0.5
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = known.where("label = 1").select("doc_id").distinct().orderBy(*order).limit(POSITIVES).withColumn("positive", F.lit(True))
    any_ = own.where("doc_id is not null").select("doc_id").orderBy(*order).limit(UNLABELLED).distinct().withColumn("positive", F.lit(False))
    chosen = own.join(F.broadcast(toxic.unionByName(any_)), "doc_id")  # at most POSITIVES + UNLABELLED ids
    once = chosen.select("positive", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["positive", "text"])
    sample = stage(once.mapInArrow(_word_sets, "positive boolean, words binary"))

    def member(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["member"].iloc[0])
        rng = np.random.default_rng(number)
        rows = rows.sort_values("words", ignore_index=True)  # the same sample whatever the order of arrival
        sets = [np.frombuffer(x, np.uint64) for x in rows["words"]]
        flag = rows["positive"].to_numpy(bool)
        p, u = [s for s, f in zip(sets, flag) if f], [s for s, f in zip(sets, flag) if not f]
        if number:
            p, u = ([x[k] for k in rng.integers(0, len(x), len(x))] for x in (p, u))
        terms, weights, bias = train(p, u, prior)
        return pd.DataFrame({"member": [number], "terms": [terms.tobytes()], "weights": [weights.tobytes()], "bias": [bias]})

    dealt = sample.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1))))
    found = dealt.groupBy("member").applyInPandas(member, "member int, terms binary, weights binary, bias double").orderBy("member").collect()
    members = [(np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["weights"]), r["bias"]) for r in found]
    return members or [(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))], prior


def score_texts(docs: DataFrame, members: list[tuple[np.ndarray, np.ndarray, float]], threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted): the members' mean probability for every whole text."""
    terms = np.unique(np.concatenate([t for t, _, _ in members]))
    weights = np.zeros((len(members), len(terms)))
    for k, (t, w, _) in enumerate(members):
        weights[k, np.searchsorted(terms, t)] = w
    with np.errstate(over="ignore"):
        tokens = np.unique(np.concatenate([terms - np.uint64(k) for k in range(LEVELS)]))
    model = docs.sparkSession.sparkContext.broadcast((tokens, terms, weights, [b for _, _, b in members]))  # at most MEMBERS x VOCABULARY terms

    def run(batches):
        tokens, terms, weights, bias = model.value
        for batch in batches:
            n = batch.num_rows
            row, at = _known(*_tokens(batch.column("text")), tokens)
            pair, times = np.unique(row * max(len(tokens), 1) + at, return_counts=True)
            f = np.tile(np.array(bias)[:, None], n)
            for k in range(LEVELS if len(terms) else 0):
                more = pair[times > k]
                with np.errstate(over="ignore"):
                    row, at = _known(more // len(tokens), tokens[more % len(tokens)] + np.uint64(k), terms)
                f += [np.bincount(row, w[at], n) for w in weights]
            total = (1 / (1 + np.exp(-np.clip(f, -500, 500)))).sum(0)
            score = total / len(bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Learns labels only where crc32 of the id modulo `folds` is not `held_out`; a null id is never held
    out and its label never learnt. Null and empty texts get the score of a text without any known
    word. Null labels are left out; repeated rows are scored alike; an empty table gives no rows, and
    without toxic labels every score is the prior.
    """
    members, _ = fit(docs, labels.where(~is_fold(F.col("doc_id"), folds, held_out)))
    return score_texts(docs, members).select("doc_id", is_fold(F.col("doc_id"), folds, held_out).alias("held_out"), "score", "predicted")
