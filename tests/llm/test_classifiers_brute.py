"""The classifiers' arithmetic against dictionaries and loops."""

import math

import numpy as np
import pyarrow as pa
import pytest

from shiftgrain.llm import quality as Q
from shiftgrain.llm import toxicity as T


def word_sets(rng, n, telling):
    """Feature sets: common words 1-30, some of them telling for the class."""
    return [np.unique(np.r_[rng.choice(30, 8) + 1, rng.choice(telling, 2)]).astype(np.uint64) for _ in range(n)]


def naive_terms(positive, unlabelled, prior, most):
    share = lambda sets, t: sum(t in set(s.tolist()) for s in sets) / len(sets)
    found = {}
    for t in sorted({t for s in positive for t in s.tolist()}):
        if sum(t in set(s.tolist()) for s in positive) >= 2:
            p, u = share(positive, t), share(unlabelled, t)
            q = min(max((u - prior * p) / (1 - prior), 0), 1)
            spread = lambda s, n: (s * (1 - s) + 1 / n) / n
            found[t] = abs(p - q) / math.sqrt(spread(p, len(positive)) + spread(q, len(unlabelled)))
    return sorted(sorted(found, key=lambda t: (-found[t], t))[:most])


def naive_train(positive, unlabelled, prior, terms, epochs):
    """Adam steps on the non-negative risk, a document and a word at a time; also how often the step was reversed."""
    weights = {t: 0.0 for t in terms} | {"bias": math.log(prior / (1 - prior))}
    first, second, reversed_steps = dict.fromkeys(weights, 0.0), dict.fromkeys(weights, 0.0), 0
    score = lambda s: weights["bias"] + sum(weights[t] for t in s.tolist() if t in weights)
    for step in range(1, epochs + 1):
        softplus = lambda v: math.log1p(math.exp(-abs(v))) + max(v, 0)
        sig = lambda v: 1 / (1 + math.exp(-v))
        negative = sum(softplus(score(s)) for s in unlabelled) / len(unlabelled) - prior * sum(softplus(score(s)) for s in positive) / len(positive)
        up, down = dict.fromkeys(weights, 0.0), dict.fromkeys(weights, 0.0)
        for sets, sign, size in ((unlabelled, 1.0, len(unlabelled)), (positive, -prior, len(positive))):
            for s in sets:
                p = sig(score(s))
                for t in ["bias", *(t for t in s.tolist() if t in weights)]:
                    down[t] += sign * p / size
                    if sets is positive:
                        up[t] += prior * (p - 1) / size
        reversed_steps += negative < 0
        for t in weights:
            g = up[t] + down[t] if negative >= 0 else -down[t]
            if t != "bias":
                g += T.PENALTY * weights[t]
            first[t] = 0.9 * first[t] + 0.1 * g
            second[t] = 0.999 * second[t] + 0.001 * g * g
        for t in weights:
            weights[t] -= T.RATE * (first[t] / (1 - 0.9**step)) / (math.sqrt(second[t] / (1 - 0.999**step)) + 1e-8)
    return weights, reversed_steps


@pytest.mark.parametrize("prior,epochs", [(0.05, 25), (0.95, 60)])
def test_training_equals_a_dictionary_version(monkeypatch, prior, epochs):
    monkeypatch.setattr(T, "EPOCHS", epochs)
    monkeypatch.setattr(T, "VOCABULARY", 12)
    rng = np.random.default_rng(7)
    positive = word_sets(rng, 25, np.array([41, 42, 43, 44]))
    unlabelled = word_sets(rng, 60, np.array([51, 52, 53])) + word_sets(rng, 12, np.array([41, 42, 43, 44]))
    terms, weights, bias = T.train(positive, unlabelled, prior)
    want = naive_terms(positive, unlabelled, prior, 12)
    assert terms.tolist() == want and (prior > 0.5 or {41, 42} <= set(want))
    naive, reversed_steps = naive_train(positive, unlabelled, prior, want, epochs)
    assert abs(bias - naive["bias"]) < 1e-6 and np.allclose(weights, [naive[t] for t in want], atol=1e-6)
    assert (reversed_steps > 0) == (prior > 0.5)  # only an overstated prior drives the negatives' risk below zero


def test_votes_equal_all_cosines():
    rng = np.random.default_rng(5)
    vocabulary = ["tree", "House", "12", "water,", "run!", "blue", "A1", "(so)", "x" * 30, "é", "and", "THE"]
    text = lambda: " ".join(rng.choice(vocabulary, rng.integers(20, 60)))
    sample, asked = [text() for _ in range(60)], [text() for _ in range(40)] + ["", "unknown-only zzzz"]
    rows = [Q.term_counts(pa.array([s])) for s in sample]
    space = Q.Space([(t, c) for _, t, c in rows])
    label = np.array([k % 3 == 0 for k in range(60)], np.float32)
    weight = np.where(label == 1, 2.0, 0.5).astype(np.float32)
    got = Q._scores(pa.array(asked), (space, label, weight, 0.37))

    def place(s):
        """A text's unit vector in the space, term by term."""
        _, terms, counts = Q.term_counts(pa.array([s]))
        known = {int(t): k for k, t in enumerate(space.terms)}
        whole = {known[int(t)]: (1 + math.log(c)) * float(space.rarity[known[int(t)]]) for t, c in zip(terms, counts) if int(t) in known}
        length = math.sqrt(sum(v * v for v in whole.values())) or 1.0
        low = [sum(v / length * float(space.axes[k, d]) for k, v in whole.items()) for d in range(space.axes.shape[1])]
        size = math.sqrt(sum(v * v for v in low))
        return [v / size if size > 1e-9 else 0.0 for v in low]

    known, checked = [place(s) for s in sample], 0
    for s, score in zip(asked, got):
        near = sorted(((sum(x * y for x, y in zip(place(s), v)), k) for k, v in enumerate(known)), reverse=True)
        if near[Q.NEIGHBOURS - 1][0] - near[Q.NEIGHBOURS][0] < 1e-5 and near[0][0] > 0:
            continue
        votes = [(max(c, 0.0) * float(weight[k]), float(label[k])) for c, k in near[: Q.NEIGHBOURS]]
        total = sum(f for f, _ in votes)
        assert abs(score - (sum(f * y for f, y in votes) / total if total > 1e-6 else 0.37)) < 1e-4
        checked += 1
    assert checked > 20 and abs(got[-2] - 0.37) < 1e-6
