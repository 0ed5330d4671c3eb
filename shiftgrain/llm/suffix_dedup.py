"""Suffix-array deduplication: remove what repeats SPAN bytes of an earlier document.

The longest previous factor of a suffix is its longest match with a suffix of an earlier document.
In suffix order the best such match sits at the nearest entry of an earlier document on either side,
and it reaches SPAN exactly if a run of entries with common prefixes of SPAN bytes holds one. Windows
of SPAN bytes are therefore all that has to be sorted, and only those that can repeat:

1. Each window is owned by the first of its least GRAM-byte hashes, which its content alone decides,
   so equal windows have owners of equal hash at equal places. Blocks of documents send the distinct
   owner hashes they have with the number of documents; hashes of one document are forgotten.
2. Blocks send the bytes around the owners that are left, each different context once, to buckets by
   hash. A bucket sorts the windows of its contexts as suffixes, takes the common prefixes of
   neighbours, finds the previous and next smaller documents and from them the longest previous
   factor of each entry, and marks those where it reaches SPAN. Bytes are compared, not hashes.
3. Marks go back to the blocks, become spans, and are cut out of the whole texts.

Exact copies of an earlier document are recognised by digest and take no part in 1 and 2. A hash in
very many documents is dealt out window by window, so a passage in a third of all rows spreads over
all buckets; what a block sends is one entry for each different content. Everything moves packed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.llm.common import shuffle_partitions, stage
from shiftgrain.llm.perfect_hash import mix
from shiftgrain.llm.words import BASE, BYTE_WORDS, powers, utf8

SPAN, GRAM = 50, 16
#: Grams of a window, and the bytes of a context: the owner is at LEFT.
GRAMS = SPAN - GRAM + 1
LEFT = GRAMS - 1
CONTEXT = LEFT + SPAN
#: Bytes of text in a block.
BLOCK = 6 << 20
#: Documents from which on a hash is dealt out window by window.
HOT = 50_000
#: Entries sorted at a time.
ENTRIES = 250_000
#: Span tables up to this size are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 500_000
#: The order of rows without an id: after all others.
LAST = (1 << 63) - 1
_STEP = 1 << 18


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    h, n, width = BYTE_WORDS[data], len(data), 1
    power = powers(GRAM)
    with np.errstate(over="ignore"):
        while width < GRAM:  # GRAM is a power of two
            n -= width
            h = h[:n] * power[width] + h[width : width + n]
            width *= 2
        return mix(h)


def owners(data: np.ndarray, offsets: np.ndarray):
    """(position, hash, first window, last window, text) of each owner in the concatenated texts."""
    n = len(data)
    edge = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= SPAN
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - SPAN + 1, -1)
    valid = np.cumsum(edge)[:n] > 0
    parts = []
    for start in range(0, n, _STEP):
        piece = data[start : start + _STEP + SPAN - 1]
        if len(piece) < SPAN:
            break
        h = gram_hashes(piece)
        # The low bits hold the position, so the least value is the first of the least hashes.
        low = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= GRAMS:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < GRAMS:
            low = np.minimum(low[: len(low) - (GRAMS - width)], low[GRAMS - width :])
        at = (low & np.uint64(0xFFFFF)).astype(np.int64)
        window = np.flatnonzero(valid[start : start + len(at)])
        if not len(window):
            continue
        own = at[window]
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)])
        last = np.r_[first[1:], len(window)] - 1
        parts.append((own[first] + start, h[own[first]], window[first] + start, window[last] + start))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    position, h, first, last = (np.concatenate(x) for x in zip(*parts))
    return position, h >> np.uint64(16), first, last, np.searchsorted(offsets, first, side="right") - 1


def six_bytes(x: np.ndarray) -> bytes:
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.int64).ravel()


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, kinds.items())})


def _split(bucket: np.ndarray):
    """(bucket, rows of it) for each bucket that occurs."""
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[by]) != 0]) if len(by) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.r_[cuts[1:], len(by)]):
        yield int(bucket[by[a]]), by[a:b]


def contexts(data: np.ndarray, position: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """CONTEXT bytes around each owner, zero outside the windows it owns."""
    column = np.arange(CONTEXT)
    out = np.empty((len(position), CONTEXT), np.uint8)
    for a in range(0, len(position), 20_000):
        p, lo, hi = position[a : a + 20_000, None], first[a : a + 20_000, None], last[a : a + 20_000, None]
        at = p - LEFT + column
        out[a : a + 20_000] = np.where((at >= lo) & (at < hi + SPAN), data[np.clip(at, 0, len(data) - 1)], 0)
    return out


def row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            h = h * BASE + BYTE_WORDS[rows[:, k]]
    return mix(h)


def single_windows(context, token, low, high):
    """One row per owned window: the row it comes from, the window's context, its place before the owner, a bucket word."""
    size = (high - low + 1).astype(np.int64)
    source = np.repeat(np.arange(len(low)), size)
    back = np.arange(len(source)) - np.repeat(np.cumsum(size) - size, size) + low[source]
    column = np.arange(CONTEXT)
    start = (LEFT - back)[:, None]
    rows = np.where((column >= start) & (column < start + SPAN), context[source], 0)
    return source, rows, back, row_hashes(rows) ^ token[source].astype(np.uint64)


def previous_matches(context: np.ndarray, token: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each context the bits of its windows (bit b: the window b bytes before the owner) that an earlier document has.

    Windows low..high of a context are its own. Rows are grouped by token; equal windows share it.
    """
    marks = np.zeros(len(token), np.int64)
    owned = (np.int64(1) << (high.astype(np.int64) + 1)) - (np.int64(1) << low.astype(np.int64))
    h = row_hashes(context) ^ mix((low.astype(np.uint64) << np.uint64(8)) + high.astype(np.uint64))
    by = np.lexsort((place, h, token))
    t, x = token[by], h[by]
    head = np.r_[True, (t[1:] != t[:-1]) | (x[1:] != x[:-1])]
    # A row that differs from its head in spite of equal hashes stands alone.
    leader = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
    for a in range(0, len(by), 100_000):
        odd = (context[by[a : a + 100_000]] != context[leader[a : a + 100_000]]).any(axis=1)
        head[a : a + 100_000] |= odd
        leader[a : a + 100_000][odd] = by[a : a + 100_000][odd]
    heads = by[head]
    group = np.r_[True, token[heads][1:] != token[heads][:-1]]
    begin = np.flatnonzero(group)
    members = np.diff(np.r_[begin, len(heads)])
    open_heads = heads[np.repeat(members > 1, members)]  # tokens with different contexts
    size = (high[open_heads] - low[open_heads] + 1).astype(np.int64)
    room = np.cumsum(size)
    a = 0
    while a < len(open_heads):
        b = max(a + 1, int(np.searchsorted(room, (room[a - 1] if a else 0) + ENTRIES)))
        while b < len(open_heads) and token[open_heads[b]] == token[open_heads[b - 1]]:
            b += 1
        _suffix_runs(context, place, low, open_heads[a:b], size[a:b], marks)
        a = b
    # A later document with the same context has all of it; the same document's repeats share its marks.
    marks[by] = np.where(place[by] > place[leader], owned[by], marks[leader])
    return marks


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before it (0 for the first), up to SPAN."""
    lcp = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 100_000):
        b = min(a + 100_000, len(rows))
        other = rows[a:b, :SPAN] != rows[a - 1 : b - 1, :SPAN]
        lcp[a:b] = np.where(other.any(axis=1), other.argmax(axis=1), SPAN)
    return lcp


def previous_smaller(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest entry before each one whose place is smaller, and the prefix shared with it.

    All entries still open move on together along the pointers found so far. One whose shared prefix has
    fallen below SPAN stops where it is: a match that short removes nothing.
    """
    at = np.arange(len(place)) - 1
    shared = lcp.copy()
    live = np.flatnonzero(shared >= SPAN)  # the first entry shares nothing
    live = live[place[at[live]] >= place[live]]
    while len(live):
        step = at[live]
        onward, least = at[step], np.minimum(shared[live], shared[step])
        at[live], shared[live] = onward, least
        live = live[least >= SPAN]
        live = live[place[at[live]] >= place[live]]
    return at, np.where(place[at] < place, shared, 0)


def longest_previous_factors(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For entries in suffix order the longest prefix, if SPAN bytes, shared with one of a smaller place.

    The best match sits at the previous or at the next smaller position. Values below SPAN are lower bounds,
    as the search for them stops early.
    """
    _, left = previous_smaller(place, lcp)
    _, right = previous_smaller(place[::-1], np.r_[0, lcp[:0:-1]])
    return np.maximum(left, right[::-1])


def _suffix_runs(context, place, low, heads, size, marks) -> None:
    """Sort the windows of `heads` as suffixes cut at SPAN; mark those whose longest previous factor is SPAN."""
    source = np.repeat(heads, size)
    back = np.arange(len(source)) - np.repeat(np.cumsum(size) - size, size) + low[source]
    window = np.empty((len(source), 56), np.uint8)
    window[:, SPAN:] = 0
    for a in range(0, len(source), 100_000):
        at = (LEFT - back[a : a + 100_000])[:, None] + np.arange(SPAN)
        window[a : a + 100_000, :SPAN] = context[source[a : a + 100_000, None], at]
    words = window.view(">u8").astype(np.uint64)
    # Equal suffixes stand by place, so that pointers double their reach at every step.
    order = np.lexsort((place[source], *(words[:, k] for k in range(6, -1, -1))))
    factor = longest_previous_factors(place[source[order]], common_prefixes(window[order]))
    hit = order[factor >= SPAN]
    np.bitwise_or.at(marks, source[hit], np.int64(1) << back[hit].astype(np.int64))


def _send_hashes(buckets: int):
    def run(block: pa.Table) -> pa.Table:
        data, offsets = utf8(block.column("text"))
        _, token, _, _, text = owners(data, offsets)
        by = np.argsort(token, kind="stable")
        t, d = token[by], text[by]
        fresh = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, bool)
        pair = fresh | np.r_[True, d[1:] != d[:-1]] if len(t) else fresh
        begin = np.flatnonzero(fresh)
        count = np.add.reduceat(pair.astype(np.uint32), begin) if len(begin) else np.zeros(0, np.uint32)
        t = t[begin]
        block_id = block.column("block")[0].as_py()
        rows = [(b, block_id, six_bytes(t[own]), count[own].astype("<u4").tobytes()) for b, own in _split((t % np.uint64(buckets)).astype(np.int64))]
        return _table(rows, bucket=pa.int64(), block=pa.int64(), tokens=pa.binary(), counts=pa.binary())

    return run


def _meet_hashes(hot_from: int):
    def run(rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_pylist()
        tokens = [from_six(x) for x in rows.column("tokens").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("counts").to_pylist()]).astype(np.int64)
        origin = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
        token = np.concatenate(tokens)
        by = np.argsort(token, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(token[by]) != 0])
        total = np.add.reduceat(counts[by], begin)
        total = np.repeat(total, np.diff(np.r_[begin, len(by)]))
        keep = total >= 2
        own, token, hot = origin[by][keep], token[by][keep], total[keep] > hot_from
        out = [(blocks[k], six_bytes(token[at]), hot[at].tobytes()) for k, at in _split(own)]
        return _table(out, block=pa.int64(), tokens=pa.binary(), hot=pa.binary())

    return run


def _send_contexts(buckets: int):
    kinds = {"bucket": pa.int64(), "block": pa.int64(), "tokens": pa.binary(), "docs": pa.binary(), "places": pa.binary(), "keys": pa.binary(), "at": pa.binary(), "low": pa.binary(), "high": pa.binary(), "content": pa.binary(), "marks": pa.binary()}

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(block) or not len(answers):
            return _table([], **kinds)
        block_id = block.column("block")[0].as_py()
        places, keys = block.column("place").to_numpy(), block.column("key").to_numpy()
        data, offsets = utf8(block.column("text"))
        position, token, first, last, text = owners(data, offsets)
        token = token.view(np.int64)
        known = np.concatenate([from_six(x) for x in answers.column("tokens").to_pylist()])
        hot = np.concatenate([np.frombuffer(x, bool) for x in answers.column("hot").to_pylist()])
        by = np.argsort(known)
        known, hot = known[by], hot[by]
        at = np.minimum(np.searchsorted(known, token), len(known) - 1)
        shared = known[at] == token
        position, token, first, last, text, hot = (x[shared] for x in (position, token, first, last, text, hot[at]))
        context = contexts(data, position, first, last)
        low, high = (position - last).astype(np.uint8), (position - first).astype(np.uint8)
        start = position - offsets[text]
        bucket = (token % buckets).astype(np.int64)
        if hot.any():
            source, rows, back, word = single_windows(context[hot], token[hot], low[hot], high[hot])
            cold, source = np.flatnonzero(~hot), np.flatnonzero(hot)[source]
            pick = np.r_[cold, source]
            context = np.concatenate([context[cold], rows])
            low, high = np.r_[low[cold], back].astype(np.uint8), np.r_[high[cold], back].astype(np.uint8)
            bucket = np.r_[bucket[cold], (word % np.uint64(buckets)).astype(np.int64)]
            token, text, start = token[pick], text[pick], start[pick]
        # Each different context once, with its earliest document; the later ones are marked here.
        h = row_hashes(context) ^ mix((low.astype(np.uint64) << np.uint64(8)) + high)
        by = np.lexsort((places[text], h, token))
        head = np.r_[True, (token[by][1:] != token[by][:-1]) | (h[by][1:] != h[by][:-1])]
        leader = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
        covered = np.zeros(len(by), bool)
        covered[by] = (places[text[by]] > places[text[leader]]) & (context[by] == context[leader]).all(axis=1)
        rows = []
        if covered.any():
            done = np.flatnonzero(covered)
            marks = (np.int64(1) << (high[done].astype(np.int64) + 1)) - (np.int64(1) << low[done].astype(np.int64))
            rows.append((-1, block_id, None, None, None, keys[text[done]].tobytes(), start[done].astype("<u4").tobytes(), None, None, None, marks.tobytes()))
        sent = np.flatnonzero(~covered)
        column = np.arange(CONTEXT)
        for b, own in _split(bucket[sent]):
            own = sent[own]
            used, local = np.unique(text[own], return_inverse=True)
            content = context[own]
            inside = (column >= LEFT - high[own].astype(np.int64)[:, None]) & (column < LEFT - low[own].astype(np.int64)[:, None] + SPAN)
            rows.append((b, block_id, six_bytes(token[own]), local.astype("<u4").tobytes(), places[used].tobytes(), keys[used].tobytes(), start[own].astype("<u4").tobytes(), low[own].tobytes(), high[own].tobytes(), content[inside].tobytes(), None))
        return _table(rows, **kinds)

    return run


def _meet_contexts(rows: pa.Table) -> pa.Table:
    """(block, keys, at, marks) of the marked owners of a bucket."""
    parts = {c: rows.column(c).to_pylist() for c in ("block", "tokens", "docs", "places", "keys", "at", "low", "high", "content", "marks")}
    if rows.column("bucket")[0].as_py() < 0:  # marked by the block itself
        return pa.table({c: rows.column(c) for c in ("block", "keys", "at", "marks")})
    token = np.concatenate([from_six(x) for x in parts["tokens"]])
    docs = [np.frombuffer(x, "<u4") for x in parts["docs"]]
    place = np.concatenate([np.frombuffer(x, np.int64)[d] for x, d in zip(parts["places"], docs)])
    key = np.concatenate([np.frombuffer(x, np.int64)[d] for x, d in zip(parts["keys"], docs)])
    at = np.concatenate([np.frombuffer(x, "<u4") for x in parts["at"]])
    low, high = (np.frombuffer(b"".join(parts[c]), np.uint8) for c in ("low", "high"))
    content = np.frombuffer(b"".join(parts["content"]), np.uint8)
    column = np.arange(CONTEXT)
    context = np.zeros((len(token), CONTEXT), np.uint8)
    used = 0
    for a in range(0, len(token), 100_000):
        lo, hi = low[a : a + 100_000].astype(np.int64)[:, None], high[a : a + 100_000].astype(np.int64)[:, None]
        inside = (column >= LEFT - hi) & (column < LEFT - lo + SPAN)
        n = int(inside.sum())
        context[a : a + 100_000][inside] = content[used : used + n]
        used += n
    marks = previous_matches(context, token, place, low, high)
    block = np.repeat(np.array(parts["block"], np.int64), [len(d) for d in docs])
    hit = np.flatnonzero(marks)
    out = [(b, key[hit[own]].tobytes(), at[hit[own]].astype("<u4").tobytes(), marks[hit[own]].tobytes()) for b, own in _split(block[hit])]
    return _table(out, block=pa.int64(), keys=pa.binary(), at=pa.binary(), marks=pa.binary())


def _join_spans(rows: pa.Table) -> pa.Table:
    """(key, spans): starts and ends of the bytes that the marks of a document cover, as one array of longs."""
    key, at, marks = (np.concatenate([np.frombuffer(x, t) for x in rows.column(c).to_pylist()]) for c, t in (("keys", np.int64), ("at", "<u4"), ("marks", np.int64)))
    keys, starts = [], []
    for b in range(GRAMS):
        has = (marks >> b) & 1 == 1
        keys.append(key[has])
        starts.append(at[has].astype(np.int64) - b)
    key, start = np.concatenate(keys), np.concatenate(starts)
    by = np.lexsort((start, key))
    key, start = key[by], start[by]
    gap = np.r_[True, (key[1:] != key[:-1]) | (start[1:] > start[:-1] + SPAN)]
    first = np.flatnonzero(gap)
    last = np.r_[first[1:], len(key)] - 1
    owner, low, high = key[first], start[first], start[last] + SPAN
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    out = [(int(owner[a]), np.stack([low[a:b], high[a:b]], axis=1).tobytes()) for a, b in zip(cuts, np.r_[cuts[1:], len(owner)])]
    return _table(out, key=pa.int64(), spans=pa.binary())


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """Stage table (key, spans binary, whole boolean) of the rows of `keyed` (key, place, digest, text) that lose bytes.

    `spans` holds pairs of longs (start, end), maximal and ascending; `whole` marks exact copies of an
    earlier document.
    """
    spark = keyed.sparkSession
    able = keyed.where(F.octet_length("text") >= SPAN)
    least = able.groupBy("digest").agg(F.min("place").alias("least"))
    copies = stage(able.select("key", "place", "digest").join(least, "digest").where("place > least").select("key").distinct())
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rest = able.join(F.broadcast(copies) if few else copies, "key", "left_anti")
    size = able.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(shuffle_partitions(spark), -(-size // BLOCK))
    dealt = rest.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "key", "place", "text")

    hashes = dealt.groupBy("block").applyInArrow(_send_hashes(blocks), "bucket long, block long, tokens binary, counts binary")
    answers = hashes.groupBy("bucket").applyInArrow(_meet_hashes(HOT), "block long, tokens binary, hot binary")
    asked = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _send_contexts(blocks),
        "bucket long, block long, tokens binary, docs binary, places binary, keys binary, at binary, low binary, high binary, content binary, marks binary",
    )
    bucket = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.col("block"))  # a block's own marks stay apart
    marks = asked.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_meet_contexts, "block long, keys binary, at binary, marks binary")
    spans = marks.groupBy("block").applyInArrow(_join_spans, "key long, spans binary")
    return stage(spans.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("spans", F.lit(None).cast("binary")).withColumn("whole", F.lit(True))))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(LAST))).withColumn("digest", F.unhex(F.sha2("text", 256)))
    return rows.withColumn("key", F.xxhash64("place", "digest"))


def _with_spans(keyed: DataFrame) -> DataFrame:
    spans = repeated_spans(keyed.select("key", "place", "digest", "text"))
    size, n = spans.agg(F.sum(F.length("spans")), F.count(F.lit(1))).first()
    return keyed.join(F.broadcast(spans) if (size or 0) <= BROADCAST_BYTES and n <= BROADCAST_ROWS else spans, "key", "left")


def _cut(raw: bytes, spans: bytes | None, whole: bool | None) -> tuple[list[bytes], int, int]:
    """The bytes that stay, how many go and in how many runs."""
    if whole:
        return [], len(raw), 1
    pairs = np.frombuffer(spans or b"", np.int64).reshape(-1, 2).tolist()
    kept, at = [], 0
    for start, end in pairs:
        kept.append(raw[at:start])
        at = end
    kept.append(raw[at:])
    return kept, sum(e - s for s, e in pairs), len(pairs)


def _cut_text(text: str | None, spans: bytes | None, whole: bool | None) -> str | None:
    if text is None or (spans is None and not whole):
        return text
    return b"".join(_cut(text.encode(), spans, whole)[0]).decode("utf-8", "ignore")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of SPAN bytes that covers it also starts in a document of smaller id;
    strings are judged on the input. A null text counts as empty; texts under SPAN bytes lose nothing.
    Rows without an id come after all others and never take from each other. Rows that repeat an id
    do not take from each other either. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for raw, spans, whole in zip(batch.column("text").cast(pa.binary()), batch.column("spans").to_pylist(), batch.column("whole").to_pylist()):
                raw = raw.as_py()
                kept, removed, n = _cut(raw, spans, whole)
                digest = hashlib.sha256()
                for part in kept:
                    digest.update(part)
                rows.append((len(raw), removed, n, digest.hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _with_spans(_keyed(docs, id_col, text_col).drop("row"))
    return found.select("doc_id", "text", "spans", "whole").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with the repeated bytes cut out of their text; all columns stay, rows left empty too.

    A character of which only some bytes go is left out as a whole.
    """
    found = _with_spans(_keyed(docs, id_col, text_col))
    names = [f"c{k}" for k in range(len(docs.columns))]  # the input may use any names
    where = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            changed = [
                _cut_text(t, spans, whole)
                for t, spans, whole in zip(batch.column(f"c{where}").to_pylist(), batch.column("spans").to_pylist(), batch.column("whole").to_pylist())
            ]
            columns = [pa.array(changed, pa.string()) if k == where else batch.column(n) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = docs.toDF(*names).withColumn(names[where], F.col(names[where]).cast("string")).schema
    flat = found.select(*(F.col(f"row.`{c}`").cast(schema[n].dataType).alias(n) for n, c in zip(names, docs.columns)), "spans", "whole")
    cut = flat.mapInArrow(run, schema)
    return cut.toDF(*docs.columns)
