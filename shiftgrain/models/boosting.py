"""Boosted trees grown on Spark by histograms, all folds and the final model in one pass a level.

Rows are binned once and lie in blocks of byte columns, written under the checkpoint folder. A pass
over the blocks adds up, for every member (a fold's model, or the model of all rows) and every open
node, the gradient and curvature of each bin; the sums of a node meet in one task, which chooses its
split, and only splits reach the driver. The first pass of a round also gives the held-out loss of every fold's trees so far, so each fold keeps growing one model until its best
prefix is `patience` trees back. A round begins by bringing the scores up to date in blocks that Spark
stores for its passes; every few rounds they are written anew, in turn to two tables. A block lies in memory feature by feature and member by member, as it is counted; only the features
that a round may split on are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.session import checkpoint_dir

#: Bins of a feature; bin 0 holds missing values and categories that the fit has not seen.
BINS = 64
#: Rows of one file, rows of one block, nodes whose splits one task chooses, and rounds between two writes of the scores.
TASK_ROWS, BLOCK_ROWS, FAN, WRITE_EVERY = 50_000, 50_000, 32, 8
#: Row groups of the blocks' files: each block is one, so any number of tasks can share a file.
ROW_GROUPS = {"parquet.block.size": str(1 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1"}
#: Smallest curvature of a leaf, penalty of its value, shares of rows and features that a tree sees.
MIN_CURVATURE, PENALTY, ROW_SHARE, FEATURE_SHARE = 5.0, 1.0, 0.8, 0.8
#: Gains this close, as a share, are equal, so the order in which sums arrive chooses no split.
TIE = 1e-9

_BLOCK, _SUMS = "bins binary, label binary, fold binary, key binary, raw binary", "part long, body binary"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Binning:
    """Cut points of numeric features and the categories of the others, in the order of the columns."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    cuts: dict[str, list[float]]
    levels: dict[str, list[str]]

    @classmethod
    def of(cls, rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Binning:
        """Cuts at about equal counts; a categorical column keeps its BINS - 1 most frequent values."""
        asked = [k / (BINS - 1) for k in range(1, BINS - 1)]
        found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), asked, 10_000).alias(c) for c in numeric]).head()
        cuts = {c: sorted({float(v) for v in found[c] or [] if v == v}) for c in numeric}
        kept = {}
        for c in categorical:
            top = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(BINS - 1)
            kept[c] = sorted(r["v"] for r in top.collect())
        return cls(tuple(numeric), tuple(categorical), cuts, kept)

    @property
    def names(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    @property
    def used(self) -> np.ndarray:
        """Which (feature, bin) pairs can hold a row at all."""
        most = [len(self.cuts[c]) + 2 for c in self.numeric] + [len(self.levels[c]) + 1 for c in self.categorical]
        return np.arange(BINS) < np.array(most)[:, None]

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """The bin of every row and feature; a feature's bins lie together."""
        out = np.zeros((len(self.names), batch.num_rows), np.uint8).T
        for k, c in enumerate(self.numeric):
            v = batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[:, k] = np.where(np.isnan(v), 0, 1 + np.searchsorted(np.array(self.cuts[c]), v, "left"))
        for k, c in enumerate(self.categorical, len(self.numeric)):
            at = pc.index_in(batch.column(c).cast(pa.string()), pa.array(self.levels[c], pa.string()))
            out[:, k] = pc.fill_null(at, -1).to_numpy(zero_copy_only=False) + 1
        return out


class Tree:
    """A tree in heap order: feature of each inner node (-1 at a leaf), the bins that go left, values, gains."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.full(size, -1, np.int16)
        self.left = np.zeros((size, BINS), bool)
        self.value = np.zeros(size)
        self.gain = np.zeros(size)

    def nodes(self, bins: np.ndarray, depth: int | None = None, rows: np.ndarray | None = None) -> np.ndarray:
        """The node that each row, or each of `rows`, is in after `depth` levels."""
        if not (bins.flags.c_contiguous or bins.flags.f_contiguous):
            bins = np.ascontiguousarray(bins)
        by_row, by_feature = bins.strides
        flat = bins.ravel("K")
        row = np.arange(len(bins)) if rows is None else rows
        row, at = row if by_row == 1 else row * by_row, np.zeros(len(row), np.int64)
        # Where a row of a node goes by its bin: a leaf's rows stay.
        node = np.arange(len(self.feature))
        to = np.where((self.feature < 0)[:, None], node[:, None], 2 * node[:, None] + 2 - self.left).ravel()
        first = np.maximum(self.feature, 0).astype(np.int64) * by_feature
        for _ in range(self.depth if depth is None else depth):
            at = to.take(at * BINS + flat.take(first.take(at) + row))
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]

    def packed(self) -> dict:
        used = np.flatnonzero(self.feature >= 0)
        return {
            "depth": self.depth, "node": used.tolist(), "feature": self.feature[used].tolist(), "left": [np.flatnonzero(x).tolist() for x in self.left[used]],
            "value": self.value.tolist(), "gain": self.gain[used].tolist(),
        }

    @classmethod
    def unpacked(cls, d: dict) -> Tree:
        out = cls(d["depth"])
        for node, feature, left, gain in zip(d["node"], d["feature"], d["left"], d["gain"]):
            out.feature[node], out.gain[node] = feature, gain
            out.left[node, left] = True
        out.value = np.array(d["value"])
        return out


def best_splits(sums: np.ndarray, categorical: int, allowed: np.ndarray) -> list[tuple[int, np.ndarray, float, np.ndarray] | None]:
    """For each node of `sums` (node, feature, bin, [gradient, curvature]): (feature, bins to the left, gain, both sides' sums).

    The last `categorical` features are ordered by their bins' means, so a split is a set of categories;
    others are cut by value, with missing values on the better side.
    """
    nodes, features, bins, _ = sums.shape
    first = np.broadcast_to(np.arange(bins), (nodes, features, bins))
    last = np.broadcast_to(np.r_[np.arange(1, bins), 0], (nodes, features, bins)).copy()
    if categorical:
        own = sums[:, -categorical:]
        order = np.argsort(own[..., 0] / (own[..., 1] + PENALTY), axis=2, kind="stable")
        first, last = first.copy(), last
        first[:, -categorical:] = order
        last[:, -categorical:] = order
    whole = sums.sum(2)[:, :1]
    score = lambda x: x[..., 0] ** 2 / (x[..., 1] + PENALTY)
    best = None
    for order in (first, last):
        left = np.cumsum(np.take_along_axis(sums, order[..., None], 2), 2)[:, :, :-1]
        right = whole[:, :, None] - left
        gain = score(left) + score(right) - score(whole)[:, :, None]
        gain[(left[..., 1] < MIN_CURVATURE) | (right[..., 1] < MIN_CURVATURE)] = -np.inf
        gain[:, ~allowed] = -np.inf
        flat = gain.reshape(nodes, -1)
        most = flat.max(1, keepdims=True)
        at = (flat >= np.where(np.isfinite(most), most - TIE * (1 + np.abs(most)), most)).argmax(1)
        f, cut = at // (bins - 1), at % (bins - 1)
        top = gain[np.arange(nodes), f, cut]
        found = [(int(f[n]), order[n, f[n], : cut[n] + 1], float(top[n]), np.stack([left[n, f[n], cut[n]], right[n, f[n], cut[n]]])) for n in range(nodes)]
        best = found if best is None else [y if y[2] > (x[2] + TIE * (1 + abs(x[2])) if np.isfinite(x[2]) else x[2]) else x for x, y in zip(best, found)]
    return [x if x[2] > 1e-9 else None for x in best]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


@dataclass
class Member:
    """A model while it grows: `fold` is held out (None for the model of all rows)."""

    fold: int | None
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    growing: bool = True

    @property
    def best(self) -> int:
        """Trees of the prefix of least held-out loss; `losses[k]` belongs to k trees."""
        return max(1, int(np.argmin(self.losses[1:])) + 1) if len(self.losses) > 1 else 1


class Boosting:
    """Grows one model for each fold and one of all rows over the same blocks."""

    def __init__(self, rows: DataFrame, binning: Binning, folds: Sequence[int], depth: int, step: float, seed: int = 7):
        """`rows` has the features, `label` 0 or 1, `fold` and a long `key` that decides a tree's sample."""
        self.binning, self.depth, self.step, self.seed = binning, depth, step, seed
        self.members = [Member(k) for k in folds] + [Member(None)]
        self.spark = rows.sparkSession
        n, mean = rows.agg(F.count(F.lit(1)), F.avg("label")).head()
        p = min(max(mean, 1e-6), 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        self.tasks = max(1, -(-n // TASK_ROWS))
        self._paths = [f"{checkpoint_dir(self.spark)}/boosting/{uuid.uuid4().hex}/{side}" for side in "ab"]
        #: Trees whose scores are not in the table yet, and those of them that are not in the stored blocks.
        self._pending: list[list[Tree]] = [[] for _ in self.members]
        self._late: list[list[Tree]] = [[] for _ in self.members]
        self._read: DataFrame | None = None
        self._stored: RDD | None = None
        base, members = self.base, len(self.members)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = []

            def block() -> pa.RecordBatch:
                parts = [np.concatenate(p) for p in zip(*held)]
                raw = np.full((len(parts[1]), members), base)
                return _block([p.tobytes("F") for p in (*parts, raw)])

            for batch in batches:
                if batch.num_rows:
                    column = lambda c, kind: batch.column(c).to_numpy(zero_copy_only=False).astype(kind)
                    held.append([binning.matrix(batch), column("label", np.uint8), column("fold", np.int16), column("key", np.int64)])
                if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                    yield block()
                    held = []
            if held:
                yield block()

        needed = rows.select(*[F.col(c).cast("double") for c in binning.numeric], *binning.categorical, "label", "fold", "key")
        needed.coalesce(self.tasks).mapInArrow(pack, _BLOCK).write.options(**ROW_GROUPS).parquet(self._paths[0])

    @property
    def blocks(self) -> DataFrame:
        """The table of the scores written last; its files are listed once."""
        if self._read is None:
            self._read = self.spark.read.schema(_BLOCK).parquet(self._paths[0])
        return self._read

    def _open(self) -> None:
        """Blocks with the scores of all trees so far, stored when the next pass has made them; lost ones come from the table again."""
        old, late = self._stored, self._pending if self._stored is None else self._late
        if old is not None and not any(late):
            return
        blocks = self.blocks.rdd if old is None else old
        if any(late):
            opened = _opened(len(self.binning.names), late)
            blocks = blocks.map(lambda block: (*block[:-1], opened(block)[-1].tobytes("F")))
        self._stored, self._late = blocks.persist(StorageLevel.MEMORY_AND_DISK), [[] for _ in self.members]

    @staticmethod
    def _release(blocks: RDD | None) -> None:
        if blocks is not None:
            blocks.unpersist()

    def _pass(self, kernel: Callable[..., dict], nodes: int, allowed: np.ndarray) -> tuple[dict[int, np.ndarray], dict[tuple[int, int], tuple]]:
        """One pass over all blocks: sums of losses by member, and the whole and the best split by (member, node).

        `kernel(bins, label, fold, key, raw)` gives a block's sums: losses under (member, -1), and under
        (member, node) the sums of the bins of one of `nodes` nodes, of the `allowed` features only. A
        node's sums of all tasks meet in one task.
        """
        opened, chosen = _opened(len(self.binning.names), [[] for _ in self.members]), np.flatnonzero(allowed)
        used, size, every = self.binning.used[chosen], 2 ** (self.depth + 1), np.ones(len(chosen), bool)
        categorical = int(allowed[len(self.binning.numeric):].sum())

        def local(blocks: Iterator[tuple[bytes, ...]]) -> Iterator[tuple[int, bytes]]:
            out: dict[int, np.ndarray] = {}
            for block in blocks:
                for (member, node), own in kernel(*opened(block)).items():
                    part, own = member * size + node + 1, own if node < 0 else own[used]
                    out[part] = out[part] + own if part in out else own
            return ((part, own.tobytes()) for part, own in out.items())

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, sums = {}, _added(batches)
            parts = [part for part in sums if part % size]
            out |= {part: own for part, own in sums.items() if part % size == 0}
            for start in range(0, len(parts), FAN):
                some = parts[start : start + FAN]
                grids = np.zeros((len(some), *used.shape, 2))
                grids[:, used] = np.stack([sums[part].reshape(-1, 2) for part in some])
                for part, grid, best in zip(some, grids, best_splits(grids, categorical, every)):
                    whole = grid[0].sum(0)
                    if best is None:
                        out[part] = whole
                    else:
                        feature, left, gain, sides = best
                        out[part] = np.concatenate([whole, [chosen[feature], gain], sides.ravel(), left])
            if out:
                yield _partial(out)

        parts = max(1, -(-nodes // FAN))
        sums = self.spark.createDataFrame(self._stored.mapPartitions(local), _SUMS, verifySchema=False)
        found = sums.repartition(parts, "part").mapInArrow(choose, _SUMS)
        losses, splits = {}, {}
        for r in found.collect():
            (member, node), own = divmod(r["part"], size), np.frombuffer(r["body"])
            if node == 0:
                losses[member] = own
            else:
                best = (int(own[2]), own[8:].astype(int), float(own[3]), own[4:8].reshape(2, 2)) if len(own) > 2 else None
                splits[member, node - 1] = own[:2], best
        return losses, splits

    def _write_scores(self) -> None:
        """Scores with all trees so far, written to the other of the two tables."""
        opened = _opened(len(self.binning.names), self._pending)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = tuple(row.values())
                    yield _block([*block[:-1], opened(block)[-1].tobytes("F")])

        self.blocks.mapInArrow(run, _BLOCK).write.mode("overwrite").options(**ROW_GROUPS).parquet(self._paths[1])
        self._paths.reverse()
        self._release(self._stored)
        self._read = self._stored = None
        self._pending, self._late = [[] for _ in self.members], [[] for _ in self.members]

    def grow(self, most: int, patience: int) -> int:
        """Grow until every fold's best prefix is `patience` trees back, or `most` trees; the mean of the best counts."""
        for turn in range(most + 1):
            grown = self._round(turn, last=turn == most)
            for m in self.members[:-1]:
                if m.growing and (turn == most or turn - m.best >= patience and turn > 0):
                    m.growing = False
            if not any(m.growing for m in self.members[:-1]):
                break
            for m, tree, *waiting in zip(self.members, grown, self._pending, self._late):
                if tree is not None:
                    m.trees.append(tree)
                    for trees in waiting:
                        trees.append(tree)
            if (turn + 1) % WRITE_EVERY == 0:
                self._write_scores()
        self._release(self._stored)
        self._stored = None
        return max(1, round(sum(m.best for m in self.members[:-1]) / (len(self.members) - 1)))

    def _round(self, turn: int, last: bool) -> list[Tree | None]:
        """One tree for each growing member; also notes the held-out loss of the trees before it."""
        rng = np.random.default_rng((self.seed, turn))
        features = len(self.binning.names)
        allowed = np.zeros(features, bool)
        allowed[rng.permutation(features)[: max(1, round(FEATURE_SHARE * features))]] = True
        salt, growing = int(rng.integers(1 << 62)), [k for k, m in enumerate(self.members) if m.growing]
        trees = {k: Tree(self.depth) for k in growing}
        opened = {k: [0] for k in growing}
        folds, before = [m.fold for m in self.members], self._stored
        self._open()
        for level in range(self.depth):
            slots = {k: x for k, x in opened.items() if x}
            if not slots:
                break
            judged = [k for k in growing if folds[k] is not None] if level == 0 else []
            deep, chosen = {k: trees[k] for k in slots}, np.flatnonzero(allowed)

            def kernel(bins, label, fold, key, raw, slots=slots, judged=judged, deep=deep, level=level, chosen=chosen):
                out = {}
                for k in judged:
                    out[k, -1] = _losses(label, fold, raw, [(k, folds[k])])
                if last:
                    return out
                own = bins.T[chosen].T
                seen = (_mix(key.view(np.uint64) ^ np.uint64(salt)) >> np.uint64(11)) * 2.0**-53 < ROW_SHARE
                for k, nodes in slots.items():
                    rows = np.flatnonzero(seen & (fold != folds[k])) if folds[k] is not None else np.flatnonzero(seen)
                    grids = _histogram(own, label, raw[:, k], deep[k].nodes(bins, level, rows), nodes, len(chosen), rows)
                    out |= {(k, node): grid for node, grid in zip(nodes, grids)}
                return out

            losses, splits = self._pass(kernel, sum(map(len, slots.values())), allowed)
            if before is not self._stored:
                self._release(before)
                before = self._stored
            for k in judged:
                total, count = losses[k]
                self.members[k].losses.append(float(total / max(count, 1)))
            if last:
                return [None] * len(self.members)
            for k, nodes in slots.items():
                opened[k] = self._split(trees[k], {node: splits[k, node] for node in nodes}, level)
        return [trees.get(k) for k in range(len(self.members))]

    def _split(self, tree: Tree, found: dict[int, tuple], level: int) -> list[int]:
        value = lambda s: float(-self.step * s[0] / (s[1] + PENALTY))
        deeper = []
        for node, (whole, best) in found.items():
            if level == 0:
                tree.value[0] = value(whole)
            if best is not None:
                feature, left, gain, sides = best
                tree.feature[node], tree.gain[node] = feature, gain
                tree.left[node, left] = True
                for child, side in zip((2 * node + 1, 2 * node + 2), sides):
                    tree.value[child] = value(side)
                    deeper.append(child)
        return deeper


def _block(parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["bins", "label", "fold", "key", "raw"])


def _partial(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "body"])


def _added(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            own = np.frombuffer(r["body"])
            sums[r["part"]] = sums[r["part"]] + own if r["part"] in sums else own
    return sums


def _opened(features: int, pending: list[list[Tree]]):
    """A function from a block's columns to its arrays, scores brought up to date with trees not yet in them."""

    def run(block: Sequence[bytes]):
        bins, label, fold, key, raw = block
        label = np.frombuffer(label, np.uint8)
        bins = np.frombuffer(bins, np.uint8).reshape(features, len(label)).T
        raw = np.frombuffer(raw).reshape(len(pending), len(label)).T
        if any(pending):
            raw = raw.copy("K")
        for k, trees in enumerate(pending):
            for tree in trees:
                raw[:, k] += tree.predict(bins)
        return bins, label, np.frombuffer(fold, np.int16), np.frombuffer(key, np.int64), raw

    return run


def _losses(label: np.ndarray, fold: np.ndarray, raw: np.ndarray, judged: list[tuple[int, int]]) -> np.ndarray:
    """Sum of log losses and number of rows of each held-out fold under its own model."""
    out = []
    for k, held in judged:
        mine = fold == held
        out += [float(np.logaddexp(0, np.where(label[mine] == 1, -raw[mine, k], raw[mine, k])).sum()), float(mine.sum())]
    return np.array(out)


def _histogram(bins: np.ndarray, label: np.ndarray, raw: np.ndarray, at: np.ndarray, nodes: list[int], features: int, rows: np.ndarray | None = None) -> np.ndarray:
    """(node, feature, bin, [gradient, curvature]) sums of the rows, or of those of `rows`, that lie in `nodes`; `at` is the node of each."""
    slot = np.full(max(int(at.max(initial=0)), max(nodes)) + 1, -1)
    slot[nodes] = np.arange(len(nodes))
    own = slot[at]
    inside = np.flatnonzero(own >= 0)
    own, rows = own[inside], inside if rows is None else rows[inside]
    p = sigmoid(raw[rows])
    gradient, curvature = p - label[rows], np.maximum(p * (1 - p), 1e-16)
    out, base = np.empty((len(nodes), features, BINS, 2)), own * BINS
    for f in range(features):
        cell = base + bins[:, f].take(rows)
        out[:, f, :, 0] = np.bincount(cell, gradient, len(nodes) * BINS).reshape(len(nodes), BINS)
        out[:, f, :, 1] = np.bincount(cell, curvature, len(nodes) * BINS).reshape(len(nodes), BINS)
    return out
