"""N-gram Jaccard join: near-duplicate documents by word shingles, exact at its threshold.

Documents of one shingle set are one class, named by the set's 64-bit fingerprint (a second
fingerprint finds clashes, and then another seed is taken). Two sets of Jaccard similarity 4/5 share
k of the first n - ceil(4n/5) + k hashes of each in any fixed order of all hashes. The order here
is by hash with common hashes last; it decides only how much is compared, never what is found.

1. Prefix hashes go packed to buckets; those of one class only are forgotten. A class that keeps
   fewer than k of them, k for the smallest partner it could have, links with nothing.
2. Classes that remain meet in blocks by their least shared hash, in two orders. In a block all are
   compared with the most central classes, then a count-vector R-tree proposes the other pairs,
   exact sets verify them, and pairs already connected are skipped: a group of m near copies costs
   about m comparisons. Large blocks are cut into parts that all hold the central classes.
3. Of the hashes at which groups still meet, each class keeps the rarest that a similar class must
   have one of. Groups that these connect form a family. In a family the tree again proposes pairs
   of different groups, the likeliest partner of each class first, and whatever then still stands
   apart is compared completely. Links and groups give the components.

Step 3 makes the result complete whatever step 2 missed; only it can meet many pairs, and only of
classes whose count vectors allow the similarity and that nothing has connected before.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftgrain.llm.common import free_worker, shuffle_partitions, stage, texts
from shiftgrain.llm.components import components
from shiftgrain.llm.count_tree import CountTree, count_vector, similar
from shiftgrain.llm.perfect_hash import mix
from shiftgrain.llm.words import shingle_sets, utf8

NUM, DEN = 4, 5
#: Hashes of a bucket or sub-block: what a task sorts or holds at a time.
BUCKET = 1_500_000
#: Common hashes kept for the order. A bound on a broadcast; the rest count as rare.
COMMON = 200_000
#: A hash is common where it is in this share of a batch's different sets, and in so many at least.
COMMON_SHARE, COMMON_LEAST = 0.002, 8
#: Central classes of a block that every part of it holds.
CENTRAL = 16
#: Classes of a family up to which it is one block, and of a part of larger ones.
MEMBERS = 4096
#: Class names that are broadcast to find their texts; more of them go through a shuffled join.
BROADCAST_ROWS = 300_000


def fingerprints(hashes: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent 64-bit names of a set, as signed integers."""
    with np.errstate(over="ignore"):
        first = mix(hashes + np.uint64(seed)).sum(dtype=np.uint64)
        second = mix(hashes ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
        both = mix(np.array([first, second + np.uint64(len(hashes))], np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


def _sets(batch: pa.RecordBatch, width: int, seed: int):
    sets = shingle_sets(*utf8(batch.column("text")), width)
    return sets, [fingerprints(s, seed) for s in sets]


def class_rows(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """Stage table: a row (doc_id, text_key, cid, check, n) per document and (hash, seen) per common hash of a batch."""

    def run(batches):
        free_worker()
        for batch in batches:
            sets, names = _sets(batch, width, seed)
            different = list({c: s for (c, _), s in zip(names, sets)}.values())
            found, seen = np.unique(np.concatenate([*different, np.zeros(0, np.uint64)]), return_counts=True)
            common = seen >= max(COMMON_LEAST, COMMON_SHARE * len(different))
            found, seen = found[common].view(np.int64), seen[common].astype(np.int64)
            n, k = len(sets), len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([True] * n + [False] * k),
                    pa.concat_arrays([batch.column("doc_id"), pa.nulls(k, pa.int64())]),
                    pa.concat_arrays([batch.column("text_key"), pa.nulls(k, pa.int64())]),
                    pa.array(np.r_[np.array([c for c, _ in names], np.int64), found]),
                    pa.array(np.r_[np.array([c for _, c in names], np.int64), seen]),
                    pa.array(np.r_[np.array([len(s) for s in sets], np.int64), np.zeros(k, np.int64)]),
                ],
                names=["is_doc", "doc_id", "text_key", "cid", "check", "n"],
            )

    keyed = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return stage(keyed.mapInArrow(run, "is_doc boolean, doc_id long, text_key long, cid long, check long, n long"))


def least_shared(n):
    """The hashes that a set of n shares, inside both prefixes, with any similar set of n or more."""
    return max(1, n // 10)


def prefix_size(n):
    return n - (NUM * n + DEN - 1) // DEN + least_shared(n)


def prefix(hashes: np.ndarray, common: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The first hashes of a sorted set in the order: rare ones by value, then common ones by count and value."""
    size = prefix_size(len(hashes))
    if not len(common):
        return hashes[:size]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    known = common[at] == hashes
    if not known.any():
        return hashes[:size]
    rare = hashes[~known][:size]
    last = np.lexsort((hashes[known], seen[at[known]]))[: size - len(rare)]
    return np.r_[rare, hashes[known][last]]


def shared_prefixes(docs: DataFrame, width: int, seed: int, common: np.ndarray, seen: np.ndarray, buckets: int) -> DataFrame:
    """Stage table (token, cid): prefix hashes, to 48 bits, that belong to at least two classes."""
    order = docs.sparkSession.sparkContext.broadcast((common, seen))

    def send(batches):
        free_worker()
        common, seen = order.value
        sent: set[int] = set()
        for batch in batches:
            sets, names = _sets(batch, width, seed)
            cids, prefixes = [], []
            for (cid, _), s in zip(names, sets):
                if len(s) and cid not in sent:
                    sent.add(cid)
                    cids.append(cid)
                    prefixes.append(prefix(s, common, seen))
            if not cids:
                continue
            owner = np.repeat(np.arange(len(cids), dtype=np.uint32), [len(p) for p in prefixes])
            token = np.concatenate(prefixes) >> np.uint64(16)
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cuts)):
                own = by[cuts[k] : cuts[k + 1]]
                used, local = np.unique(owner[own], return_inverse=True)
                # Six bytes of each hash, and each class name once.
                rows.append((int(k), token[own].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes(), np.array(cids, np.int64)[used].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "tokens", "owners", "cids"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        tokens, cids = [], []
        for t, o, c in zip(rows["tokens"], rows["owners"], rows["cids"]):
            six = np.frombuffer(t, np.uint8).reshape(-1, 6)
            wide = np.zeros((len(six), 8), np.uint8)
            wide[:, :6] = six
            tokens.append(wide.view(np.int64).ravel())
            cids.append(np.frombuffer(c, np.int64)[np.frombuffer(o, np.uint16 if len(o) == 2 * len(six) else np.uint32)])
        token, cid = np.concatenate(tokens), np.concatenate(cids)
        by = np.lexsort((cid, token))
        token, cid = token[by], cid[by]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])]
        token, cid = token[fresh], cid[fresh]
        same = token[1:] == token[:-1]
        shared = np.r_[same, False] | np.r_[False, same]
        return pd.DataFrame({"token": token[shared], "cid": cid[shared]})

    packed = docs.mapInArrow(send, "bucket int, tokens binary, owners binary, cids binary")
    return stage(packed.groupBy("bucket").applyInPandas(meet, "token long, cid long"))


def block_plan(keys: DataFrame) -> DataFrame:
    """Stage table (cid, key, part, rank, bucket) of `keys` (cid, n, kept, key, key2): each class in two blocks.

    A block of more than BUCKET hashes is cut into parts by class; its most central classes, those
    that share most of their prefix, are in every part. `rank` orders a block's central classes.
    """
    spark = keys.sparkSession
    both = keys.select("cid", "n", "kept", "key").union(keys.select("cid", "n", "kept", "key2"))
    sizes = both.groupBy("key").agg(F.ceil(F.sum("n") / BUCKET).cast("int").alias("cuts"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = max(shuffle_partitions(spark), -(-2 * (keys.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    order = Window.partitionBy("key").orderBy(F.desc(F.col("kept") / F.col("n")), "cid")
    inside = both.join(sizes, "key")
    central = inside.select("key", "cid", "cuts", F.row_number().over(order).alias("rank")).where(F.col("rank") <= CENTRAL)
    central = central.select("cid", "key", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"), "rank")
    rest = inside.join(central.select("key", "cid").distinct(), ["key", "cid"], "left_anti")
    rest = rest.select("cid", "key", F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int").alias("part"), F.lit(CENTRAL + 1).alias("rank"))
    return stage(central.union(rest).withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets))))


def class_sets(docs: DataFrame, wanted: DataFrame, width: int, seed: int) -> DataFrame:
    """Stage table (cid, n, hashes binary, fine binary) of the classes `wanted` (cid, doc).

    `fine` has the low 16 bits of every hash, sorted: two bytes a hash bound an overlap from above
    almost as well as eight. A repeated document repeats its class.
    """
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = wanted.select("cid", F.col("doc").alias("_doc"))

    def run(batches):
        free_worker()
        for batch in batches:
            sets, names = _sets(batch, width, seed)
            keep = pa.array([c == w for (c, _), w in zip(names, batch.column("cid").to_pylist())], pa.bool_())
            out = [batch.column("cid"), pa.array([len(s) for s in sets], pa.int64())]
            out += [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([np.sort(s.astype(np.uint16)).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["cid", "n", "hashes", "fine"]).filter(keep)

    own = docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("_doc")))
    return stage(own.select("text", "cid").mapInArrow(run, "cid long, n long, hashes binary, fine binary"))


class Fine:
    """Upper bounds of the overlap of classes from the low 16 bits of their hashes."""

    def __init__(self, rows: pd.DataFrame):
        self.bits = [np.frombuffer(f, np.uint16) for f in rows["fine"]]
        self.n = rows["n"].to_numpy(np.int64)
        self.seen = np.zeros(1 << 16, np.int32)

    @property
    def points(self) -> np.ndarray:
        return np.stack([count_vector(b) for b in self.bits])

    def keep(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs whose bound allows the similarity, and their bounds."""
        bound = np.zeros(len(i), np.int64)
        by = np.argsort(i, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(i[by])) + 1) if len(i) else ():
            left, times = np.unique(self.bits[i[own[0]]], return_counts=True)
            self.seen[left] = times
            for k in own.tolist():
                right = self.bits[j[k]]
                # A repeated value counts as often as it stands in both: its r-th copy needs r copies on the left.
                first = np.flatnonzero(np.r_[True, right[1:] != right[:-1]])
                copy = np.arange(len(right)) - np.repeat(first, np.diff(np.r_[first, len(right)]))
                bound[k] = (self.seen[right] > copy).sum()
            self.seen[left] = 0
        fits = (NUM + DEN) * bound >= NUM * (self.n[i] + self.n[j])
        return i[fits], j[fits], bound[fits]


def _join_labels(labels: np.ndarray, x: int, y: int) -> None:
    low, high = sorted((labels[x], labels[y]))
    labels[labels == high] = low


def _block_links(rows: pd.DataFrame) -> np.ndarray:
    """For each row the position of its group's first row, groups being connected by verified links."""
    labels = np.arange(len(rows))
    if len(rows) > 1:
        sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
        for x in np.flatnonzero(rows["rank"].to_numpy() <= CENTRAL).tolist():
            for y in np.flatnonzero(labels != labels[x]).tolist():
                if labels[x] != labels[y] and similar(sets[x], sets[y], NUM, DEN):
                    _join_labels(labels, x, y)
        tree = CountTree(np.stack([count_vector(h) for h in sets]), rows["n"].to_numpy(np.int64), NUM, DEN)
        for i, j, _ in tree.candidates(labels):
            for x, y in zip(i.tolist(), j.tolist()):
                if labels[x] != labels[y] and similar(sets[x], sets[y], NUM, DEN):
                    _join_labels(labels, x, y)
    return labels


def block_links(sets: DataFrame, plan: DataFrame) -> DataFrame:
    """Stage table (a, b): each class and the first class of its group in a block, where they differ."""
    few = plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)]
        for _, block in rows.groupby(["key", "part"], sort=False):
            block = block.drop_duplicates("cid")
            cids = block["cid"].to_numpy(np.int64)
            out.append(np.stack([cids, cids[_block_links(block)]], axis=1))
        links = np.concatenate(out)
        links = links[links[:, 0] != links[:, 1]]
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    dealt = sets.join(F.broadcast(plan) if few else plan, "cid").select("bucket", "key", "part", "rank", "cid", "n", "hashes")
    return stage(dealt.groupBy("bucket").applyInPandas(run, "a long, b long"))


def _family_pairs(members: DataFrame, buckets: int, best_only: bool) -> DataFrame:
    """(a, b): pairs of classes of one family and different groups whose count vectors allow the similarity.

    `members` is (family, root, cid, n, fine). With `best_only`, each member outside the family's
    largest group proposes only its likeliest partner.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)]
        for _, block in rows.groupby("family", sort=False):
            block = block.drop_duplicates("cid")
            cids, root = block["cid"].to_numpy(np.int64), block["root"].to_numpy(np.int64)
            names, group = np.unique(root, return_inverse=True)
            inner = group == np.bincount(group).argmax()
            best, partner = np.full(len(cids), -1), np.zeros(len(cids), np.int64)
            fine = Fine(block)
            for i, j, _ in CountTree(fine.points, fine.n, NUM, DEN).candidates(root):
                i, j, overlap = fine.keep(i, j)
                if not len(i):
                    continue
                if not best_only:
                    out.append(np.stack([cids[i], cids[j]], axis=1))
                    continue
                for x, y in ((i, j), (j, i)):
                    by = np.lexsort((-overlap, x))
                    first = by[np.r_[True, x[by][1:] != x[by][:-1]]]
                    better = first[(overlap[first] > best[x[first]]) & ~inner[x[first]]]
                    best[x[better]], partner[x[better]] = overlap[better], y[better]
            if best_only:
                found = np.flatnonzero(best >= 0)
                out.append(np.stack([cids[found], cids[partner[found]]], axis=1))
        links = np.sort(np.concatenate(out), axis=1)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    dealt = members.withColumn("bucket", F.pmod(F.xxhash64("family"), F.lit(buckets))).select("bucket", "family", "root", "cid", "n", "fine")
    return dealt.groupBy("bucket").applyInPandas(run, "a long, b long").distinct()


def _candidates(members: DataFrame, buckets: int) -> DataFrame:
    """(a, b): class pairs of one token whose roots differ and whose count vectors allow the similarity.

    `members` is (token, size, cid, root, n, fine), `size` the token's number of classes. Tokens of
    more than MEMBERS classes are cut into parts, and each pair of parts is a block.
    """
    cuts = F.ceil(F.col("size") / MEMBERS).cast("int")
    cut = members.withColumn("cuts", cuts).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cut = cut.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("token", "low", "high"), F.lit(buckets)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (_, low, high), block in rows.groupby(["token", "low", "high"], sort=False):
            if len(block) < 2:
                continue
            cids = block["cid"].to_numpy(np.int64)
            part = block["part"].to_numpy()
            fine = Fine(block)
            for i, j, _ in CountTree(fine.points, fine.n, NUM, DEN).candidates(block["root"].to_numpy(np.int64)):
                if low != high:  # pairs inside a part belong to the part's own block
                    across = part[i] != part[j]
                    i, j = i[across], j[across]
                i, j, _ = fine.keep(i, j)
                a.append(np.minimum(cids[i], cids[j]))
                b.append(np.maximum(cids[i], cids[j]))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return cut.select("bucket", "token", "low", "high", "part", "cid", "root", "n", "fine").groupBy("bucket").applyInPandas(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches):
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), NUM, DEN) for x, y in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def class_roots(docs: DataFrame, rows: DataFrame, width: int, seed: int) -> DataFrame | None:
    """(cid, label) of the classes that a link joins to another; None where no two classes can be similar."""
    spark = docs.sparkSession
    most = rows.where("not is_doc").groupBy("cid").agg(F.sum("check").alias("seen")).orderBy(F.desc("seen"), "cid").limit(COMMON).collect()
    common = np.array([r["cid"] for r in most], np.int64).view(np.uint64)
    seen = np.array([r["seen"] for r in most], np.int64)
    by = np.argsort(common)
    classes = rows.where("is_doc and n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"))
    total = classes.agg(F.sum(F.col("n") - F.floor((NUM * F.col("n") + DEN - 1) / DEN) + 1)).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-total // BUCKET))
    shared = shared_prefixes(docs, width, seed, common[by], seen[by], buckets)

    fewest = F.greatest(F.lit(1), F.floor(F.floor(F.col("n") * NUM / DEN) / 10))
    own = shared.groupBy("cid").agg(F.min("token").alias("key"), F.min(F.xxhash64("token")).alias("key2"), F.count(F.lit(1)).alias("kept"))
    keys = stage(own.join(classes, "cid").where(F.col("kept") >= fewest))
    if keys.isEmpty():
        return None
    shared = stage(shared.join(keys.select("cid"), "cid", "left_semi"))
    sets = class_sets(docs, keys.select("cid", "doc"), width, seed)
    links = block_links(sets, block_plan(keys))
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda df: df)
    roots = stage(_relabelled(keys.select("cid", F.col("cid").alias("root")), components(links)))
    for best_only in (True, False):
        rooted = shared.join(hint(roots), "cid")
        opened = stage(_narrowed(rooted, hint(keys.select("cid", "n")), fewest))
        if opened.isEmpty():
            break
        # A family: groups that such hashes connect. Every pair of them that can link is inside one.
        families = components(opened.select(F.col("root").alias("a"), F.col("low").alias("b")).distinct()).select(F.col("node").alias("root"), F.col("label").alias("family"))
        asked = opened.select("cid", "root").distinct().join(families, "root")
        vectors = sets.select("cid", "n", "fine")
        entries = opened.groupBy("root").agg(F.count(F.lit(1)).alias("entries")).join(families, "root").groupBy("family").agg(F.sum("entries").alias("entries"))
        sizes = stage(asked.groupBy("family").agg(F.count(F.lit(1)).alias("size")).join(entries, "family"))
        named = asked.join(sizes, "family").join(vectors, "cid")
        proposed = _family_pairs(named.where(F.col("size") <= MEMBERS), buckets, best_only)
        # Larger families are compared in pairs of parts, or hash by hash where that copies fewer rows.
        copies = F.col("size") * F.ceil(F.col("size") / MEMBERS)
        if not best_only and not sizes.where(F.col("size") > MEMBERS).isEmpty():
            parts = named.where((F.col("size") > MEMBERS) & (copies <= F.col("entries"))).withColumnRenamed("family", "token")
            proposed = proposed.union(_candidates(parts, buckets))
            rest = families.join(sizes.where((F.col("size") > MEMBERS) & (copies > F.col("entries"))).select("family"), "family").select("root")
            if not rest.isEmpty():
                many = opened.select("token", "cid", "root").join(rest, "root")
                size = many.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
                proposed = proposed.union(_candidates(many.join(size, "token").join(vectors, "cid"), buckets))
            proposed = proposed.distinct()
        found = stage(_verified(stage(proposed), sets))
        if not found.isEmpty():
            ends = found.join(hint(roots.select(F.col("cid").alias("a"), F.col("root").alias("x"))), "a").join(hint(roots.select(F.col("cid").alias("b"), F.col("root").alias("y"))), "b")
            roots = stage(_relabelled(roots, components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())))
    return roots.select("cid", F.col("root").alias("label"))


def _narrowed(rooted: DataFrame, sizes: DataFrame, fewest) -> DataFrame:
    """(token, cid, root, low): the fewest hashes at which classes of different groups that are similar must meet.

    `rooted` is (token, cid, root), `sizes` (cid, n). Similar classes share `fewest` hashes at least, so
    of a class's hashes at which groups meet, rarest first, those after the last `fewest` - 1 are not
    needed. Hashes of the same classes are one `token`, and `low` is its least root.
    """
    met = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cid")).alias("lot")).where("low <> high")
    order = Window.partitionBy("cid").orderBy(F.desc("size"), F.desc("lot"), F.desc("token"))
    placed = rooted.join(met.select("token", "size", "lot"), "token").join(sizes, "cid").withColumn("place", F.row_number().over(order))
    few = placed.where(F.col("place") >= fewest).select(F.col("lot").alias("token"), "cid", "root").distinct()
    few = stage(few)
    met = few.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return few.join(met.select("token", "low"), "token")


def _relabelled(roots: DataFrame, labels: DataFrame) -> DataFrame:
    """`roots` (cid, root) with each root replaced by its label (node, label), where it has one."""
    return roots.join(labels, F.col("root") == F.col("node"), "left").select("cid", F.coalesce("label", "root").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, cid (its shingle set's name), text_key, stays.

    Words are maximal runs of other characters than ASCII white space, A-Z lower-cased. A document's
    set holds the distinct shingles of `width` words; with fewer words, the whole sequence as one.
    Documents link when 5 |A and B| >= 4 |A or B|; component_id is the smallest id reachable by
    links, null only where all ids reachable are null. A null text, an empty one or one without
    words has no shingles, links with nothing and is its own component. Repeated rows, and rows that
    repeat an id with another text, are documents of their own. An empty table gives no rows.
    `stays` marks the row of smallest id in its component (then of smallest text_key, the xxhash64 of
    its text; rows equal in both stay together).
    """
    own = texts(docs, id_col, text_col)
    for seed in itertools.count(1):
        rows = class_rows(own, width, seed)
        clash = rows.where("is_doc").groupBy("cid").agg((F.min("check") != F.max("check")).alias("clash"))
        if clash.where("clash").isEmpty():
            break
    found = rows.where("is_doc").select("doc_id", "text_key", "n", "cid", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key").alias("place"))
    labels = class_roots(own, rows, width, seed)
    named = found.where("n > 0")
    if labels is not None:
        named = named.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    else:
        named = named.withColumn("label", F.col("cid"))
    least = named.groupBy("label").agg(F.min("place").alias("least"))
    linked = named.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), "cid", "text_key", (F.col("place") == F.col("least")).alias("stays"))
    alone = found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "cid", "text_key", F.lit(True).alias("stays"))
    return linked.union(alone)


def one_of_each_group(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one document of each component."""
    gone = stage(near_duplicates(docs, width, id_col, text_col).where(~F.col("stays")).select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key")).distinct())
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    key = [F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("_key")]
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *key)
    same = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_key") == F.col("_gone_key"))
    return tagged.join(F.broadcast(gone) if few else gone, same, "left_anti").select("_row.*")
