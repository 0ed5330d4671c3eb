"""Line deduplication by an exact set-similarity join.

A line's tokens are its distinct words, ordered by rarity. Two lines of Jaccard similarity 4/5 share
a token among the first n - ceil(4n/5) + 1 of each, their sizes differ by at most a quarter, the
tokens from the shared one on must suffice for the overlap, and 128-bit parity maps of their tokens
differ in no more bits than the sets may differ in tokens. Lines of one token set are one class.

1. Texts are read once. A slice of them is written as its classes, whose words are codes in the
   slice's own dictionary, with the place of every line and the counts of frequent words.
2. Prefix tokens go packed to buckets, with size, position, map and first place of their class. In a
   bucket every class proposes its earliest partner that passes the filters, so a family of m near
   copies proposes m pairs, not their square. A token of very many lines is cut into pairs of parts.
3. Sets verify the pairs. A class that failed but had further partners proposes all of them, in the
   buckets that said so; the open tokens stay a table, joined by bucket.
4. A line goes if an earlier line, in order of document and line, has the same set or a verified one.

Where only some classes or tokens are wanted, slices leave out most others by a bit map of fixed
size; a join with the table decides. The words whose counts order the tokens are the COMMON most
frequent ones; all others come first, by hash. That order decides how much is compared, never what is found.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.llm.common import free_worker, shuffle_partitions, stage
from shiftgrain.llm.perfect_hash import mix
from shiftgrain.llm.words import utf8, word_hashes

NUM, DEN = 4, 5
#: Words whose frequency is known to the order, and the share of a slice's lines that makes a word frequent.
COMMON, COMMON_SHARE, COMMON_LEAST = 200_000, 5e-5, 4
#: Prefix tokens of a bucket; pairs examined at a time; documents whose line lists are broadcast.
BUCKET, PAIRS, NAMES = 400_000, 500_000, 250_000
#: Bytes of text in a slice; one longer text is a slice of its own.
SLICE = 4 << 20
#: Lines of a word from which on its postings are cut into pairs of parts.
HOT = 1_000_000
#: Bits of the maps that tell a slice what is wanted.
WANTED_BITS = 1 << 24
#: The order of rows without an id: after all others.
LAST = (1 << 63) - 1
_LOW = np.uint64(0xFFFFFFFF)


def text_slices(batches, size: int):
    """Arrow batches of at most `size` bytes of text, or one row."""
    for batch in batches:
        _, offsets = utf8(batch.column("text"))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


class Lines:
    """The lines of a batch of texts and the distinct words of each, as codes in a sorted dictionary."""

    def __init__(self, column: pa.Array, seed: int):
        data, offsets = utf8(column)
        breaks = np.flatnonzero(data == 0x0A) + 1
        # Each text begins a line, and so does each break in the text that holds it.
        texts = np.arange(len(offsets) - 1)
        own = np.searchsorted(offsets, breaks - 1, side="right") - 1
        order = np.argsort(np.r_[2 * texts, 2 * own + 1], kind="stable")
        self.text, edges = np.r_[texts, own][order], np.r_[offsets[:-1], breaks][order]
        begin = np.searchsorted(self.text, np.arange(len(offsets) - 1))
        self.number = np.arange(len(edges)) - begin[self.text] if len(edges) else edges
        hashes, first = word_hashes(data, np.r_[edges, len(data)])
        line = np.repeat(np.arange(len(edges), dtype=np.uint64), np.diff(first))
        self.dictionary, code = np.unique(hashes, return_inverse=True)
        key = np.sort((line << np.uint64(32)) | code.astype(np.uint64))
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        self.line, self.code = (key >> np.uint64(32)).astype(np.int64), (key & _LOW).astype(np.int64)
        self.size = np.bincount(self.line, minlength=len(edges))
        self.cid, self.check = np.zeros(len(edges), np.int64), np.zeros(len(edges), np.int64)
        has = np.flatnonzero(self.size)
        if len(has):
            starts = np.r_[0, np.cumsum(self.size[has])[:-1]]
            with np.errstate(over="ignore"):
                one = np.add.reduceat(mix(self.dictionary + np.uint64(seed))[self.code], starts)
                two = np.add.reduceat(mix(self.dictionary ^ np.uint64(0xA0761D6478BD642F))[self.code], starts)
                self.cid[has], self.check[has] = mix(one).view(np.int64), mix(two + self.size[has].astype(np.uint64)).view(np.int64)


#: Arrays of a slice's classes: the words of all, class after class, are dictionary[code].
_SLICE = {"dictionary": np.uint64, "code": np.uint32, "sizes": np.uint32, "cids": np.int64, "places": np.int64, "numbers": np.uint32}


def line_rows(docs: DataFrame, seed: int) -> DataFrame:
    """Stage table of three kinds of rows.

    0: (place, line, cid, check, n) of every line with words; 1: (cid, check) as a frequent word of a
    slice and its lines; 2: the arrays of _SLICE, packed, for the classes of a slice with their first places.
    """
    names = ["kind", "place", "line", "cid", "check", "n", *_SLICE]

    def run(batches):
        free_worker()
        for batch in text_slices(batches, SLICE):
            lines = Lines(batch.column("text"), seed)
            place = batch.column("place").to_numpy()[lines.text]
            has = np.flatnonzero(lines.size)
            if not len(has):
                continue
            seen = np.bincount(lines.code, minlength=len(lines.dictionary))
            often = seen >= max(COMMON_LEAST, COMMON_SHARE * len(has))
            word, seen = lines.dictionary[often].view(np.int64), seen[often]
            by = has[np.lexsort((lines.number[has], place[has]))]
            _, first = np.unique(lines.cid[by], return_index=True)
            chosen = np.sort(by[first])
            inside = np.zeros(len(lines.size), bool)
            inside[chosen] = True
            arrays = (lines.dictionary, lines.code[inside[lines.line]], lines.size[chosen], lines.cid[chosen], place[chosen], lines.number[chosen])
            packed = [_planes(x.astype(t)) for x, t in zip(arrays, _SLICE.values())]
            n, k = len(has), len(word)
            none, rest = np.zeros(k + 1, np.int64), np.zeros(1, np.int64)
            columns = (
                np.repeat([0, 1, 2], [n, k, 1]),
                np.r_[place[has], none],
                np.r_[lines.number[has], none],
                np.r_[lines.cid[has], word, rest],
                np.r_[lines.check[has], seen, rest],
                np.r_[lines.size[has], none],
            )
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c.astype(np.int64)) for c in columns), *(pa.array([None] * (n + k) + [x], pa.binary()) for x in packed)], names=names
            )

    kinds = "kind long, place long, line long, cid long, check long, n long, " + ", ".join(f"{c} binary" for c in _SLICE)
    return stage(docs.mapInArrow(run, kinds))


def slices_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 2").select(*_SLICE)


def _unpacked(batches):
    """The arrays of each slice, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: _from_planes(batch.column(c)[k].as_py(), t) for c, t in _SLICE.items()}


def prefixes(s: dict[str, np.ndarray], common: np.ndarray, seen: np.ndarray):
    """(class, token, position, lines of the token) of the prefix tokens of a slice's classes, rarest first."""
    rank = np.zeros(len(s["dictionary"]), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s["dictionary"]), len(common) - 1)
        rank = np.where(common[at] == s["dictionary"], seen[at], 0)
    order = np.lexsort((s["dictionary"], rank))
    turn = np.empty(len(order), np.uint64)
    turn[order] = np.arange(len(order), dtype=np.uint64)
    size = s["sizes"].astype(np.int64)
    key = np.sort((np.repeat(np.arange(len(size), dtype=np.uint64), size) << np.uint64(32)) | turn[s["code"]])
    owner, word = (key >> np.uint64(32)).astype(np.int64), order[(key & _LOW).astype(np.int64)]
    position = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
    n = size[owner]
    keep = position < n - (NUM * n + DEN - 1) // DEN + 1
    return owner[keep], s["dictionary"][word[keep]], position[keep], rank[word[keep]]


def parity_maps(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits a class, each the parity of the words that fall on it: sets that differ in d words differ in at most d bits."""
    place = s["dictionary"] >> np.uint64(57)
    bit = np.uint64(1) << (place & np.uint64(63))
    size = s["sizes"].astype(np.int64)
    starts = np.cumsum(size) - size
    return tuple(np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0))[s["code"]], starts) for half in (place < 64, place >= 64))


def class_keys(cid: np.ndarray, place: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A number for a class at its first place."""
    return cid ^ (place << 20) ^ line.astype(np.int64)


def wanted_map(rows: DataFrame, column: str):
    """Broadcast bit map of the low bits of `column`: what is not in it is not in `rows`. At most WANTED_BITS bits."""
    low = F.col(column).bitwiseAND(F.lit(WANTED_BITS - 1))
    words = rows.select(low.alias("low")).selectExpr("shiftright(low, 6) AS at", "shiftleft(1L, CAST(low & 63 AS INT)) AS bit")
    out = np.zeros(WANTED_BITS // 64, np.int64)
    for r in words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["at"]] = r["bits"]
    return rows.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def in_map(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    low = x.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


#: A token is known by its low 32 bits inside a bucket: others that share them only add comparisons.
_POSTING = {"token": np.uint32, "cid": np.int64, "low": np.uint64, "high": np.uint64, "place": np.int64, "line": np.uint32, "n": np.uint32, "position": np.uint32}


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _dealt(token: np.ndarray, cid: np.ndarray, lines: np.ndarray, buckets: int, hot: int):
    """(posting, bucket): one bucket a posting; of a hot token, one for each other part of its classes."""
    parts = 1 + lines // hot
    at = np.repeat(np.arange(len(token)), parts)
    other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    p = parts[at]
    part = (mix(cid[at].view(np.uint64)) % p.astype(np.uint64)).astype(np.int64)
    pair = np.minimum(part, other) * p + np.maximum(part, other)
    with np.errstate(over="ignore"):
        return at, (mix(token[at] + mix(pair.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def postings(slices: DataFrame, order, buckets: int, only=None) -> DataFrame:
    """Packed prefix tokens by bucket; `only` is a broadcast map of the tokens wanted, or None."""

    def run(batches):
        free_worker()
        common, seen = order.value
        for s in _unpacked(batches):
            owner, token, position, lines = prefixes(s, common, seen)
            if only is not None:
                keep = in_map(only.value, token)
                owner, token, position, lines = owner[keep], token[keep], position[keep], lines[keep]
            at, bucket = _dealt(token, s["cids"][owner], lines, buckets, HOT)
            by = np.argsort(bucket, kind="stable")
            at, bucket = at[by], bucket[by]
            own = owner[at]
            low, high = parity_maps(s)
            fields = {"token": token[at], "cid": s["cids"][own], "low": low[own], "high": high[own], "place": s["places"][own], "line": s["numbers"][own], "n": s["sizes"][own], "position": position[at]}
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            rows = [(int(bucket[a]), *(_planes(fields[c][a:b].astype(t)) for c, t in _POSTING.items())) for a, b in zip(first, np.r_[first[1:], len(bucket)])]
            columns = list(zip(*rows)) or [()] * (1 + len(_POSTING))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", *_POSTING])

    return slices.mapInArrow(run, "bucket long, " + ", ".join(f"{c} binary" for c in _POSTING))


def _passes(p: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of postings of one token and fitting sizes can be similar: map and position filters."""
    both = p["n"][i] + p["n"][j]
    least = -(-NUM * both // (NUM + DEN))
    differ = np.bitwise_count(p["low"][i] ^ p["low"][j]) + np.bitwise_count(p["high"][i] ^ p["high"][j])
    keep = np.flatnonzero(differ <= both - 2 * least)
    i, j, least = i[keep], j[keep], least[keep]
    at, other = p["position"][i], p["position"][j]
    after = np.minimum(p["n"][i] - at, p["n"][j] - other)  # the shared token and all behind it
    return keep[np.minimum(at, other) + after >= least]


def _pairs(p: dict[str, np.ndarray]):
    """(i, j) of postings of one token whose sizes fit and that pass, PAIRS examined at a time.

    Postings are in order of token and size, so the partners of one lie in a run before it.
    """
    group = np.cumsum(np.r_[False, p["token"][1:] != p["token"][:-1]]) << 32
    n = p["n"].astype(np.int64)
    low = np.searchsorted(group + n, group + -(-NUM * n // DEN))
    many = np.arange(len(n)) - low
    total = np.cumsum(many)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
        i = np.repeat(np.arange(a, b), many[a:b])
        j = np.arange(len(i)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b]) + low[i]
        keep = _passes(p, i, j)
        if len(keep):
            yield i[keep], j[keep]
        a = b


def earliest_partners(p: dict[str, np.ndarray]):
    """(later, earlier, more): each posting with the partner of earliest place; `more` says that others pass too."""
    size = len(p["turn"])
    best, count = np.full(size, size, np.int64), np.zeros(size, np.int64)
    for i, j in _pairs(p):
        swap = p["turn"][i] < p["turn"][j]
        later, earlier = np.where(swap, j, i), np.where(swap, i, j)
        np.minimum.at(best, later, p["turn"][earlier])
        np.add.at(count, later, 1)
    # Places of one token differ, but a place occurs with several tokens: turns number postings, not places.
    at = np.empty(size, np.int64)
    at[p["turn"]] = np.arange(size)
    later = np.flatnonzero(count)
    return later, at[best[later]], count[later] > 1


def all_partners(p: dict[str, np.ndarray], asking: np.ndarray):
    """(later, earlier): the postings `asking` with every partner that passes."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in _pairs(p):
        swap = p["turn"][i] < p["turn"][j]
        later, earlier = np.where(swap, j, i), np.where(swap, i, j)
        keep = asking[later]
        out.append((later[keep], earlier[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _bucket_postings(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """The postings of a bucket by token and size, each class of a token once, with its turn by first place."""
    p = {c: np.concatenate([_from_planes(x, t) for x in rows[c]]) for c, t in _POSTING.items()}
    by = np.lexsort((p["cid"], p["line"], p["place"]))
    with np.errstate(over="ignore"):
        _, first = np.unique(mix(p["token"][by].astype(np.uint64) + mix(p["cid"][by].view(np.uint64))), return_index=True)
    turn = np.sort(first)
    by = by[turn]
    order = np.lexsort((p["n"][by], p["token"][by]))
    p = {c: x[by[order]] for c, x in p.items()}
    return p | {"n": p["n"].astype(np.int32), "position": p["position"].astype(np.int32), "turn": order, "key": class_keys(p["cid"], p["place"], p["line"])}


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """Each class with its earliest partner of each token."""
    p = _bucket_postings(rows)
    i, j, more = earliest_partners(p)
    found = pd.DataFrame({"bucket": rows["bucket"].iloc[0], "cid": p["cid"][i], "a": p["key"][i], "b": p["key"][j], "token": p["token"][i].astype(np.int64), "more": more})
    # One row of a pair, and every token that has more for its class.
    return found[~found.duplicated(["a", "b"]) | found["more"]]


def _meet_again(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """All partners of the classes and tokens asked for."""
    if not len(rows) or not len(asked):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("cid", "a", "b")})
    p = _bucket_postings(rows)
    asking = pd.MultiIndex.from_arrays([p["token"].astype(np.int64), p["cid"]]).isin(pd.MultiIndex.from_frame(asked[["token", "cid"]]))
    i, j = all_partners(p, asking)
    return pd.DataFrame({"cid": p["cid"][i], "a": p["key"][i], "b": p["key"][j]}).drop_duplicates()


def similar_classes(pairs: DataFrame, slices: DataFrame) -> DataFrame:
    """Stage table (cid): classes of the pairs (cid, a, b) whose sets are similar."""
    wanted = wanted_map(pairs.select("a").union(pairs.select("b")), "a")

    def words(batches):
        free_worker()
        for s in _unpacked(batches):
            key = class_keys(s["cids"], s["places"], s["numbers"])
            ends = np.cumsum(s["sizes"].astype(np.int64))
            # Six bytes tell words apart: two of one pair's words agree in them by chance once in 10^11 pairs.
            short = np.sort(s["dictionary"] << np.uint64(16))
            by = np.argsort(s["dictionary"] << np.uint64(16))
            turn = np.empty(len(by), np.int64)
            turn[by] = np.arange(len(by))
            take = np.flatnonzero(in_map(wanted.value, key))
            sets = []
            for k in take.tolist():
                low = short[np.sort(turn[s["code"][ends[k] - s["sizes"][k] : ends[k]]])]
                sets.append(low.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(key[take]), pa.array(sets, pa.binary())], names=["key", "words"])

    def same(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                both = np.concatenate([_six(x), _six(y)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(DEN * shared >= NUM * (len(both) - shared))
            yield batch.select(["cid"]).filter(pa.array(keep, pa.bool_()))

    sets = slices.mapInArrow(words, "key long, words binary")
    left, right = sets.select(F.col("key").alias("a"), F.col("words").alias("left")), sets.select(F.col("key").alias("b"), F.col("words").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("cid", "left", "right")
    return stage(joined.mapInArrow(same, "cid long").distinct())


def _six(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def repeated_classes(rows: DataFrame) -> DataFrame:
    """Table (cid): classes whose first line is similar to an earlier line."""
    spark = rows.sparkSession
    most = rows.where("kind = 1").groupBy("cid").agg(F.sum("check").alias("seen")).orderBy(F.desc("seen"), "cid").limit(COMMON).collect()
    common, seen = np.array([r["cid"] for r in most], np.int64).view(np.uint64), np.array([r["seen"] for r in most], np.int64)
    by = np.argsort(common)
    order = spark.sparkContext.broadcast((common[by], seen[by]))
    prefix = F.col("n") - F.floor((NUM * F.col("n") + DEN - 1) / DEN) + 1
    size = rows.where("kind = 0").groupBy("cid").agg(F.first("n").alias("n")).agg(F.sum(prefix)).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-size // BUCKET))
    slices = slices_of(rows)
    found = stage(postings(slices, order, buckets).groupBy("bucket").applyInPandas(_meet, "bucket long, cid long, a long, b long, token long, more boolean"))
    # The partner that most tokens propose decides for nearly all; classes that fail try their others.
    votes = found.groupBy("cid", "a", "b").agg(F.count(F.lit(1)).alias("votes"))
    first = stage(votes.groupBy("cid", "a").agg(F.min(F.struct(-F.col("votes"), "b"))["b"].alias("b")))
    done = similar_classes(first, slices)
    tried = stage(found.select("cid", "a", "b").distinct().join(done, "cid", "left_anti").join(first, ["cid", "a", "b"], "left_anti"))
    done = stage(done.union(similar_classes(tried, slices)))
    left = stage(found.where("more").select("bucket", "token", "cid").join(done, "cid", "left_anti"))
    if left.isEmpty():
        return done
    again = postings(slices, order, buckets, wanted_map(left, "token")).groupBy("bucket").cogroup(left.groupBy("bucket")).applyInPandas(_meet_again, "cid long, a long, b long")
    rest = stage(again.distinct().join(found.select("cid", "a", "b"), ["cid", "a", "b"], "left_anti"))
    return done.union(similar_classes(rest, slices))


def _dropped(keyed: DataFrame) -> DataFrame:
    """(place, lines array<long>): the lines of each document that go."""
    docs = keyed.select("place", "text")
    for seed in itertools.count(1):
        rows = line_rows(docs, seed)
        lines = rows.where("kind = 0").select("cid", "check", "place", "line")
        if lines.groupBy("cid").agg((F.min("check") != F.max("check")).alias("clash")).where("clash").isEmpty():
            break
    done = repeated_classes(rows).withColumn("again", F.lit(True))
    lines = lines.drop("check")
    first = lines.groupBy("cid").agg(F.min(F.struct("place", "line")).alias("first")).join(done, "cid", "left")
    gone = lines.join(first, "cid").where(F.col("again") | (F.struct("place", "line") > F.col("first")))
    return stage(gone.groupBy("place").agg(F.collect_set("line").alias("lines")))  # at most a document's lines


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_removed, removed (ascending line numbers), kept_sha256, kept_text.

    Lines end at each line feed. A line goes if an earlier line, by (id, line number), has word sets of
    Jaccard similarity 4/5 or more with it, judged on the input; A-Z count as a-z. Lines without words
    stay. A null or empty text is one line without words. Rows without an id come last, as one
    document; so do rows that repeat an id: a line number that goes in one of them goes in all.
    An empty table gives no rows.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    keyed = own.withColumn("place", F.coalesce("doc_id", F.lit(LAST)))
    gone = _dropped(keyed)

    def run(batches):
        free_worker()
        for batch in text_slices(batches, SLICE):
            rows = []
            for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist()):
                parts, drop = text.split("\n"), set(lines or ())
                removed = sorted(k for k in drop if k < len(parts))
                kept = "\n".join(x for k, x in enumerate(parts) if k not in drop)
                rows.append((len(parts), len(removed), removed, hashlib.sha256(kept.encode()).hexdigest(), kept))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "n_lines", "n_removed", "removed", "kept_sha256", "kept_text"])

    few = gone.limit(NAMES + 1).count() <= NAMES
    return keyed.join(F.broadcast(gone) if few else gone, "place", "left").select("doc_id", "text", "lines").mapInArrow(
        run, "doc_id long, n_lines long, n_removed long, removed array<long>, kept_sha256 string, kept_text string"
    )
