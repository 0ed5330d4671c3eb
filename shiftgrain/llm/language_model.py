"""Language model scores by a weighted backoff automaton whose counts stay distributed.

States are the contexts seen in training, an arc leads from a context over each word seen after it,
and a failure arc leads to the context without its first word. With c(h w) and c(h) from training
and a strength s, the arc of w costs log10((c(h w) + s p(w | shorter h)) / (c(h) + s)) and the failure
arc log10(s / (c(h) + s)); the last state knows single tokens, (c + 0.5) / (N + 0.5 (V + 1)). The
probabilities of a state sum to one. A text is read once from left to right with its state carried.

The automaton of a large corpus fits nowhere, and a block of documents needs only the part that its
own texts can reach. Blocks send the hashes of their n-grams with their training counts to buckets by
hash; a bucket adds the counts up and answers each block where the sum differs from what the block
has itself. So an n-gram of one block costs its hash once, and one that all blocks have costs one
entry a block. Both passes over the blocks read the same shuffled texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.llm.common import is_fold, shuffle_partitions, texts
from shiftgrain.llm.perfect_hash import mix
from shiftgrain.llm.words import BASE, utf8, word_hashes

#: Bytes of text in a block, and n-grams of a bucket.
BLOCK, BUCKET = 8 << 20, 2_000_000
#: Tokens of a text that are read one after another; a longer text is read in several stretches at once.
STRETCH = 256
#: The weight of the shorter context, in tokens.
STRENGTH = 500.0
START, END = mix(np.array([0x53, 0x45], np.uint64))


class Reading:
    """The n-grams of a block: `grams[k - 1]` and `valid[k - 1]` for order k, by position.

    A text's positions are a start, its words and an end.
    """

    def __init__(self, column: pa.Array, order: int):
        words, first = word_hashes(*utf8(column))
        size = np.diff(first) + 2
        self.begin = np.cumsum(size) - size
        self.size = size
        token = np.empty(int(size.sum()), np.uint64)
        inner = np.ones(len(token), bool)
        inner[self.begin] = inner[self.begin + size - 1] = False
        token[self.begin], token[self.begin + size - 1] = START, END
        token[inner] = words
        at = np.arange(len(token)) - np.repeat(self.begin, size)
        self.grams, self.valid = [token], [np.ones(len(token), bool)]
        self._numbered = {}
        with np.errstate(over="ignore"):
            for k in range(2, order + 1):
                longer = token.copy()
                longer[1:] = mix(self.grams[-1][:-1] * BASE + token[1:] + np.uint64(k))
                self.grams.append(longer)
                self.valid.append(at >= k - 1)

    def numbered(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of order k ascending, and the entry of each valid position."""
        if k not in self._numbered:
            self._numbered[k] = np.unique(self.grams[k - 1][self.valid[k - 1]], return_inverse=True)
        return self._numbered[k]

    def table(self, train: np.ndarray):
        """Per order: distinct hashes ascending, their training counts here, and each valid position's entry."""
        learn = np.repeat(train, self.size)
        out = []
        for k, valid in enumerate(self.valid, 1):
            key, entry = self.numbered(k)
            out.append((key, np.bincount(entry[learn[valid]], minlength=len(key)), entry))
        return out


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending hashes as the byte planes of their differences: the upper planes are almost all zero."""
    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _counts(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _cuts(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where ascending hashes pass from one bucket to the next; buckets are ranges of equal width."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.r_[0, np.searchsorted(key, edges), len(key)]


def _send(order: int, buckets: int):
    def run(block: pa.Table) -> pa.Table:
        reading = Reading(block.column("text"), order)
        tables = reading.table(block.column("train").to_numpy(zero_copy_only=False))
        (one, one_count, _), longer = tables[0], tables[1:]
        more = np.concatenate([k for k, _, _ in longer] or [np.zeros(0, np.uint64)])
        more_count = np.concatenate([c for _, c, _ in longer] or [np.zeros(0, np.int64)])
        by = np.argsort(more, kind="stable")
        more, more_count = more[by], more_count[by]
        a, b = _cuts(one, buckets), _cuts(more, buckets)
        block_id = block.column("block")[0].as_py()
        # Every block writes to every bucket, so that each bucket's totals reach every block.
        return pa.table(
            {
                "bucket": pa.array(np.arange(buckets)),
                "block": pa.array([block_id] * buckets, pa.int64()),
                "one": pa.array([pack_sorted(one[a[k] : a[k + 1]]) for k in range(buckets)], pa.binary()),
                "one_count": pa.array([_counts(one_count[a[k] : a[k + 1]]) for k in range(buckets)], pa.binary()),
                "more": pa.array([pack_sorted(more[b[k] : b[k + 1]]) for k in range(buckets)], pa.binary()),
                "more_count": pa.array([_counts(more_count[b[k] : b[k + 1]]) for k in range(buckets)], pa.binary()),
            }
        )

    return run


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]):
    """(hashes, counts) over all blocks, and per block the entries whose total differs from its own."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    by = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]]) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(count[by], begin) if len(begin) else np.zeros(0, np.int64)
    back = np.empty(len(key), np.int64)
    back[by] = np.repeat(total, np.diff(np.r_[begin, len(key)]))
    differ = back != count
    answers, at = [], 0
    for k in keys:
        own = slice(at, at + len(k))
        answers.append((k[differ[own]], back[own][differ[own]]))
        at += len(k)
    return key[by][begin], total, answers


def _meet(rows: pa.Table) -> pa.Table:
    read = lambda name, f: [f(x) for x in rows.column(name).to_pylist()]
    key, total, one = _totals(read("one", unpack_sorted), read("one_count", _from_counts))
    _, _, more = _totals(read("more", unpack_sorted), read("more_count", _from_counts))
    total = total[key != START]
    n, v = int(total.sum()), int((total > 0).sum())
    return pa.table(
        {
            "block": rows.column("block"),
            "tokens": pa.array([n] * len(rows), pa.int64()),
            "types": pa.array([v] * len(rows), pa.int64()),
            "one": pa.array([pack_sorted(k) for k, _ in one], pa.binary()),
            "one_count": pa.array([_counts(c) for _, c in one], pa.binary()),
            "more": pa.array([pack_sorted(k) for k, _ in more], pa.binary()),
            "more_count": pa.array([_counts(c) for _, c in more], pa.binary()),
        }
    )


class Automaton:
    """States, arcs and failure arcs that the texts of a reading can reach.

    State 0 is the empty context and has an arc for every token. Every n-gram below the full order
    that training holds is a state. Its failure arc drops the first word; an arc over a word ends in
    the longest context that is left. Arcs lie in one array ordered by (state, token).
    """

    def __init__(self, reading: Reading, counts: list[np.ndarray], n: int, v: int, strength: float):
        """`counts[k - 1]` is the training count of the order-k n-gram ending at each position."""
        order, end = len(counts), np.int64(1) << 62
        self.depth = order - 1
        key, entry = reading.numbered(1)
        self.token, self.types = entry, max(len(key), 1)
        single = np.zeros(len(key), np.int64)
        single[entry] = counts[0]
        self.base = np.log10((single + 0.5) / (n + 0.5 * (v + 1)))
        self.first = np.zeros(len(key), np.int64)  # the state that each token's arc of state 0 ends in
        self.failure, self.failure_cost = [np.zeros(1, np.int64)], [np.zeros(1)]
        arcs, costs, targets = [], [], []
        state_at = np.zeros(len(entry), np.int64)  # by position: the state of the order below
        cost_at, total_at = self.base[entry], np.where(reading.valid[0], counts[0], 0)
        states = 1
        for k in range(1, order + 1):
            valid = np.flatnonzero(reading.valid[k - 1])
            key, entry = reading.numbered(k)
            place = np.zeros(len(key), np.int64)
            place[entry] = valid  # one position of each n-gram
            seen = counts[k - 1][place] > 0
            place = place[seen]
            # Arcs of order k leave the context before the word; training that holds the n-gram holds it too.
            if k > 1:
                cost = np.log10((counts[k - 1][place] + strength * 10.0 ** cost_at[place]) / (total_at[place - 1] + strength))
                arcs.append(state_at[place - 1] * self.types + self.token[place])
                costs.append(cost)
            if k < order:
                own = np.zeros(len(key), np.int64)
                own[seen] = states + np.arange(len(place))
                states += len(place)
                self.failure.append(state_at[place] if k > 1 else np.zeros(len(place), np.int64))
                self.failure_cost.append(np.log10(strength / (counts[k - 1][place] + strength)))
                if k == 1:
                    self.first = own
            if k > 1:
                targets.append(own[seen] if k < order else state_at[place])
                filled = np.zeros(len(key))
                filled[seen] = cost
                cost_at = np.zeros(len(state_at))
                cost_at[valid] = filled[entry]
            if k < order:
                state_at = np.zeros(len(state_at), np.int64)
                state_at[valid] = own[entry]
                total_at = np.where(reading.valid[k - 1], counts[k - 1], 0)
        self.failure, self.failure_cost = np.concatenate(self.failure), np.concatenate(self.failure_cost)
        by = np.argsort(np.concatenate([*arcs, np.zeros(0, np.int64)]), kind="stable")
        self.arcs = np.r_[np.concatenate([*arcs, np.zeros(0, np.int64)])[by], end]  # a last one that no search passes
        self.cost = np.r_[np.concatenate([*costs, np.zeros(0)])[by], 0.0]
        self.target = np.r_[np.concatenate([*targets, np.zeros(0, np.int64)])[by], 0]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one token in every state: the states after it, and the log10 probabilities on the way."""
        state, cost, after = state.copy(), np.zeros(len(state)), self.first[token]
        at_root = np.ones(len(state), bool)
        live = np.flatnonzero(state)
        while len(live):
            wanted = state[live] * self.types + token[live]
            arc = np.searchsorted(self.arcs, wanted)
            hit = self.arcs[arc] == wanted
            there, arc, failed = live[hit], arc[hit], live[~hit]
            cost[there] += self.cost[arc]
            after[there] = self.target[arc]
            at_root[there] = False
            cost[failed] += self.failure_cost[state[failed]]
            state[failed] = self.failure[state[failed]]
            live = failed[state[failed] != 0]
        cost[at_root] += self.base[token[at_root]]
        return after, cost


def traverse(reading: Reading, counts: list[np.ndarray], n: int, v: int, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """(base, score): log10 probability of the token at each position, starts left at 0.

    All texts are read together from left to right, each carrying its state. A long text is read in
    stretches of STRETCH tokens: a state knows the last `order` - 1 tokens at most, so a stretch that
    reads as many before its first one starts it in the state that the whole text has there.
    """
    automaton = Automaton(reading, counts, n, v, strength)
    base = automaton.base[automaton.token]
    base[reading.begin] = 0
    score = np.zeros(len(base))
    pieces = -(-(reading.size - 1) // STRETCH)
    within = 1 + STRETCH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    begin, size = np.repeat(reading.begin, pieces), np.repeat(reading.size, pieces)
    start = begin + np.maximum(within - max(automaton.depth, 1), 0)
    length = begin + np.minimum(within + STRETCH, size) - start
    by = np.argsort(-length, kind="stable")
    start, length, first = start[by], length[by], (begin + within)[by]
    state = np.zeros(len(start), np.int64)
    for t in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -t))
        at = start[:live] + t
        state, cost = automaton.step(state[:live], automaton.token[at])
        counted = at >= first[:live]
        score[at[counted]] = cost[counted]
    return base, score


def _score(order: int, strength: float):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(block):
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64()), "train": pa.array([], pa.bool_())})
        reading = Reading(block.column("text"), order)
        read = lambda name, f: np.concatenate([f(x) for x in answers.column(name).to_pylist()])
        known = {"one": (read("one", unpack_sorted), read("one_count", _from_counts)), "more": (read("more", unpack_sorted), read("more_count", _from_counts))}
        n, v = sum(answers.column("tokens").to_pylist()), sum(answers.column("types").to_pylist())
        counts = []
        for k, (key, own, entry) in enumerate(reading.table(block.column("train").to_numpy(zero_copy_only=False))):
            hashes, total = known["one" if k == 0 else "more"]
            at = np.minimum(np.searchsorted(key, hashes), len(key) - 1)
            hit = key[at] == hashes
            own[at[hit]] = total[hit]
            full = np.zeros(len(reading.grams[0]), np.int64)
            full[reading.valid[k]] = own[entry]
            counts.append(full)
        base, score = traverse(reading, counts, n, v, strength)
        seen = counts[0] > 0
        seen[reading.begin] = False
        sums = lambda x: np.add.reduceat(x, reading.begin)
        return pa.table(
            {
                "doc_id": block.column("doc_id"),
                "n_tokens": pa.array(reading.size - 1),
                "n_known": pa.array(sums(seen.astype(np.int64))),
                "train_tokens": pa.array(np.full(len(reading.size), n, np.int64)),
                "base_score": pa.array(sums(base)),
                "score": pa.array(sums(score)),
                "train": block.column("train"),
            }
        )

    return run


def score_documents(docs: DataFrame, order: int = 2, strength: float = STRENGTH, folds: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose id's crc32 modulo `folds` is not `held_out`, those without an id among
    them. Tokens are the words (A-Z lower-cased, ASCII white space between) and one end. A null text
    counts as empty: its only token is the end. Repeated rows count and are scored each; without
    training rows every token has probability one; an empty table gives no rows.
    """
    own = texts(docs, id_col, text_col)
    size, n = own.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    spark = docs.sparkSession
    blocks = max(shuffle_partitions(spark), -(-((size or 0) + n) // BLOCK))
    # A word has about six bytes, and each n-gram of a block is one entry.
    buckets = max(shuffle_partitions(spark), -(-((size or 0) // 6 + n) * (order - 1) // BUCKET))
    held = is_fold(F.col("doc_id"), folds, held_out)
    text = F.coalesce("text", F.lit(""))
    dealt = own.select(F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).alias("block"), "doc_id", (~held).alias("train"), text.alias("text"))
    packed = "one binary, one_count binary, more binary, more_count binary"
    sent = dealt.groupBy("block").applyInArrow(_send(order, buckets), f"bucket long, block long, {packed}")
    answers = sent.groupBy("bucket").applyInArrow(_meet, f"block long, tokens long, types long, {packed}")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(order, strength), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, train boolean"
    )
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
