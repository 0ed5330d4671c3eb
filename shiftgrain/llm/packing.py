"""Packing token sequences into windows with a plan found by non-negative least squares.

A document is its ids and one closing id. Whole windows are cut off its front; what is left, of
length 1 to window - 1, is packed. The histogram of these lengths has window - 1 entries however
large the table is. Pairs and triples of lengths that fill a window exactly are the columns of a
non-negative least squares problem whose right-hand side is the histogram; its solution, rounded
down and topped up, says how often each combination is used. Every remainder learns its number
among those of its length from per-shard counts, and from that number alone its window and offset.
Remainders beyond the plan form one stream in order of length and number, cut at each window; the
stream's last, incomplete window is cut into powers of two, which need no padding.

Texts are encoded once and their ids written as a stage table; no ids are shuffled.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftgrain.llm.byte_bpe import encoder_for, file_tokenizer
from shiftgrain.llm.common import stage, texts, trim_worker

#: Leading numbers of sequence ids: whole windows by shard, planned windows, the stream.
_WHOLE, _PLAN, _STREAM = 1 << 60, 2 << 60, 3 << 60
#: Shards whose offsets are broadcast (8 bytes for each shard and length); beyond it they are joined by a shuffle.
BROADCAST_SHARDS = 4096
STEPS = 400


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of two or three of the given lengths, descending, that sum to `window`; 0 pads a pair."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    a, b = a.ravel(), b.ravel()
    keep = (a >= b) & (a + b <= window)
    a, b = a[keep], b[keep]
    c = window - a - b
    keep = (c <= b) & ((c == 0) | have[c])
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def non_negative_least_squares(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that about minimises |A x - histogram|, column c of A counting the lengths of combination c.

    Accelerated projected gradient steps; A is never formed. Length 0 has no weight.
    """
    if not len(combos):
        return np.zeros(0)
    size = len(histogram)
    weight = np.ones(size)
    weight[0] = 0

    def total(x):
        return sum(np.bincount(combos[:, k], x, size) for k in range(3)) * weight

    def slope(r):
        return sum((r * weight)[combos[:, k]] for k in range(3))

    probe = np.ones(len(combos))
    for _ in range(20):
        probe = slope(total(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    rate = 1 / (1.02 * norm)
    x = y = np.zeros(len(combos))
    pace = 1.0
    for _ in range(steps):
        ahead = np.maximum(y - rate * slope(total(y) - histogram), 0)
        if (ahead - x) @ (y - ahead) > 0:
            pace = 1.0  # momentum points uphill: start it anew
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y = ahead + (pace - 1) / faster * (ahead - x)
        x, pace = ahead, faster
    return x


@dataclass
class Plan:
    """Where the number of a remainder among those of its length puts it."""

    window: int
    #: For each length, the bounds of its intervals of numbers, and each interval's first window and offset.
    bounds: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    #: For each length, the count used by the plan and the stream position of its first remainder beyond.
    used: np.ndarray
    base: np.ndarray
    stream: int


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    """The plan for `histogram[length]` remainders, length 0 to window - 1."""
    left = np.r_[histogram, 0].astype(np.int64)
    left[0] = 0
    combos = combinations(np.flatnonzero(left), window)
    wanted = np.floor(non_negative_least_squares(combos, left.astype(float))).astype(np.int64)
    order = np.argsort(-wanted, kind="stable")
    counts = np.zeros(len(combos), np.int64)
    for only_wanted in (True, False):
        for c in order:
            need = combos[c][combos[c] > 0]
            if (left[need] <= 0).any():
                continue
            each = np.bincount(need)
            room = int(min(left[v] // each[v] for v in set(need.tolist())))
            take = min(room, int(wanted[c])) if only_wanted else room
            if take > 0:
                counts[c] += take
                for v in need:
                    left[v] -= take
    bounds, first, offset = {}, {}, {}
    used = np.r_[histogram, 0].astype(np.int64) - left
    used[0] = 0
    parts: dict[int, list[tuple[int, int, int]]] = {}
    window_at = 0
    for c in np.flatnonzero(counts):
        at = 0
        for v in combos[c][combos[c] > 0].tolist():
            parts.setdefault(v, []).append((int(counts[c]), window_at, at))
            at += v
        window_at += int(counts[c])
    for v, rows in parts.items():
        n, w, o = (np.array(x, np.int64) for x in zip(*rows))
        bounds[v], first[v], offset[v] = np.cumsum(n), w, o
    tokens = left[:window] * np.arange(window)
    return Plan(window, bounds, first, offset, used[:window], np.cumsum(tokens) - tokens, int(tokens.sum()))


def tail_cuts(stream: int, window: int) -> np.ndarray:
    """Starts of the stream's last pieces: its incomplete window, cut into powers of two."""
    left, at, cuts = stream % window, stream - stream % window, []
    for power in range(window.bit_length() - 1, -1, -1):
        if left >> power & 1:
            cuts.append(at)
            at += 1 << power
    return np.array(cuts, np.int64)


def place(plan: Plan, length: int, number: int, cuts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start in the remainder, length, sequence id, offset) of the pieces of one remainder."""
    if number < plan.used[length]:
        k = int(np.searchsorted(plan.bounds[length], number, side="right"))
        nth = number - (int(plan.bounds[length][k - 1]) if k else 0)
        return [(0, length, _PLAN + int(plan.first[length][k]) + nth, int(plan.offset[length][k]))]
    at = int(plan.base[length]) + (number - int(plan.used[length])) * length
    end, start, out = at + length, 0, []
    whole = plan.stream - plan.stream % plan.window
    while at < end:
        if at < whole:
            sequence, origin = at // plan.window, at - at % plan.window
            stop = min(end, origin + plan.window)
        else:
            k = int(np.searchsorted(cuts, at, side="right")) - 1
            sequence, origin = whole // plan.window + k, int(cuts[k])
            stop = min(end, int(cuts[k + 1]) if k + 1 < len(cuts) else plan.stream)
        out.append((start, stop - at, _STREAM + sequence, at - origin))
        start, at = start + stop - at, stop
    return out


def encode_shards(docs: DataFrame, path: str, pattern: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Stage table (shard, doc_id, n, rest, nth, whole, ids binary of unsigned 16- or 32-bit integers).

    `rest` is the remainder's length, `nth` its number among those of its shard, `whole` the number of
    full windows before the document's in its shard.
    """

    def run(batches):
        trim_worker()  # remembered words stay: they outlive a task
        tokenizer = file_tokenizer(path, pattern)
        kind = "<u2" if tokenizer.get_vocab_size() < 1 << 16 else "<u4"
        encoder, width = encoder_for(file_tokenizer, path, pattern, kind), np.dtype(kind).itemsize
        end = np.array([end_id], kind).tobytes()
        shard = TaskContext.get().partitionId()
        seen, whole = np.zeros(window, np.int64), 0
        for batch in batches:
            n, rest, nth, front, ids = [], [], [], [], []
            for t in batch.column("text"):
                code = encoder.encode(t.as_py() or "") + end
                size = len(code) // width
                r = size % window
                n.append(size), rest.append(r), nth.append(int(seen[r])), front.append(whole), ids.append(code)
                seen[r] += 1
                whole += size // window
            numbers = [pa.array(x, pa.int64()) for x in (n, rest, nth, front)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), shard, np.int64)), batch.column("doc_id"), *numbers, pa.array(ids, pa.binary()), pa.array([width] * len(n), pa.int32())],
                names=["shard", "doc_id", "n", "rest", "nth", "whole", "ids", "width"],
            )

    return stage(texts(docs, id_col, text_col).mapInArrow(run, "shard long, doc_id long, n long, rest long, nth long, whole long, ids binary, width int"))


def pack(docs: DataFrame, path: str, pattern: str, window: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every id lies in one piece; a sequence's pieces leave no gap and it holds at most `window` ids:
    exactly `window`, or a power of two for at most log2(window) sequences of the whole table.
    `ids_crc32` is over little-endian unsigned 32-bit ids. A null text counts as empty, so its
    document is the closing id alone; null and repeated doc_ids pass through, each row a document of
    its own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    coded = encode_shards(docs, path, pattern, window, end_id, id_col, text_col)
    counts = stage(coded.where("rest > 0").groupBy("rest", "shard").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(window, np.int64)
    for row in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # at most window - 1 rows
        histogram[row["rest"]] = row["n"]
    plan = make_plan(histogram, window)
    cuts = tail_cuts(plan.stream, window)

    before = F.sum("n").over(Window.partitionBy("rest").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        counts.select("shard", F.struct("rest", F.coalesce(before, F.lit(0)).alias("before")).alias("entry"))
        .groupBy("shard")
        .agg(F.collect_list("entry").alias("entries"))  # at most window - 1 entries
        .select("shard", "entries.rest", "entries.before")
        .select("shard", F.col("rest").alias("rests"), "before")
    )
    known = None  # shard to its offsets by length; None: every row brings those of its shard
    if counts.select("shard").distinct().count() <= BROADCAST_SHARDS:
        by_shard = {}
        for row in offsets.toLocalIterator():
            by_shard[row["shard"]] = line = np.zeros(window, np.int64)
            line[row["rests"]] = row["before"]
        known = spark.sparkContext.broadcast(by_shard)
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        nothing = np.zeros(window, np.int64)
        base, loaded = nothing, None
        for batch in batches:
            out = []
            brought = itertools.repeat((None, None)) if known else zip(batch.column("rests"), batch.column("before"))
            for shard, doc, n, rest, nth, whole, ids, width, (rests, before) in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n", "rest", "nth", "whole", "ids", "width")), brought):
                if shard != loaded:
                    base = known.value.get(shard, nothing) if known else np.zeros(window, np.int64)
                    if not known and rests.is_valid:
                        base[rests.values.to_numpy()] = before.values.to_numpy()
                    loaded = shard
                code = np.frombuffer(ids, f"<u{width}").astype("<u4")
                pieces = [(k * window, window, _WHOLE + (shard << 36) + whole + k, 0) for k in range(n // window)]
                if rest:
                    pieces += [(n - rest + s, size, q, o) for s, size, q, o in place(plan, rest, int(base[rest]) + nth, cuts)]
                for start, size, sequence, offset in pieces:
                    part = code[start : start + size]
                    row = (doc, start, size, zlib.crc32(part), n, sequence, offset)
                    out.append((*row, part.astype(np.int32)) if with_ids else row)
            columns = list(zip(*out)) or [()] * (8 if with_ids else 7)
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[7:]]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in fields.split(", ")])

    return (coded if known else coded.join(offsets, "shard", "left")).mapInArrow(run, fields)
