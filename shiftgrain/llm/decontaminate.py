"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned by every training text.

Items of a benchmark become windows of consecutive words (runs of digits, ASCII letters and
characters beyond ASCII, A-Z lower-cased); an item of fewer words is one window. The distinct
(window, item) pairs are hashed into sets of a bounded size, so a benchmark that is too large for one
broadcast is scanned as several, and what they find is joined by the text's digest. A text is read
once a set: rolling hashes of its words are looked up in a bit table, then in the set, and each hit is
verified word by word. Hits give word ranges, byte spans, and the items they come from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.llm.common import stage
from shiftgrain.llm.perfect_hash import mix
from shiftgrain.llm.words import BASE, BYTE_WORDS, powers, utf8

WIDTH = 10
#: What one broadcast set may hold: pairs of window and item, and bytes of their windows.
PAIRS, BYTES = 400_000, 64 << 20
#: Text bytes worked on at a time (a longer text alone).
CHUNK = 2 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20

_FOUND = "array<struct<a:int,b:int,start:long,end:long>>"


class Words:
    """The normalised words of some texts: lower-cased bytes, words one byte apart, and where they lie."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = _WORD[data]
        left = np.zeros(len(data), bool)
        left[1:] = solid[:-1]
        left[offsets[:-1][offsets[:-1] < len(data)]] = False
        self.start = np.flatnonzero(solid & ~left)
        right = np.zeros(len(data), bool)
        right[:-1] = solid[1:]
        ends = offsets[1:] - 1
        right[ends[ends >= 0]] = False
        self.end = np.flatnonzero(solid & ~right) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        size = self.end - self.start
        #: Place of each word among the bytes of all words, each followed by one blank.
        self.place = np.cumsum(size + 1) - (size + 1)
        self.size = size
        self.bytes = np.full(int((size + 1).sum()), 0x20, np.uint8)
        self.bytes[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = _FOLD[data[solid]]

    def window(self, word: int, width: int) -> bytes:
        last = word + width - 1
        return self.bytes[self.place[word] : self.place[last] + self.size[last]].tobytes()

    def hashes(self) -> np.ndarray:
        """One hash a word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        out = np.empty(len(self.start), np.uint64)
        table, a = powers(256), 0
        bounds = np.append(self.place, len(self.bytes))
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.place, self.place[a] + (1 << 20))))
            low, high = bounds[a], bounds[b]
            own = self.place[a:b] - low
            spread = self.size[a:b] + 1
            if spread.max() > len(table):
                table = powers(int(spread.max()))
            at = np.arange(high - low) - np.repeat(own, spread)
            with np.errstate(over="ignore"):
                out[a:b] = mix(np.add.reduceat(BYTE_WORDS[self.bytes[low:high]] * table[at], own))
            a = b
        return out

    def rolled(self, widest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each width: the words at which a window of that width starts inside a text, and its hash."""
        words = self.hashes()
        room = self.first[1:][self.text] - np.arange(len(words))
        joined = np.zeros(len(words), np.uint64)
        with np.errstate(over="ignore"):
            for width in range(1, widest + 1):
                if width > len(words):
                    return
                joined = joined[: len(words) - width + 1] * BASE + words[width - 1 :]
                at = np.flatnonzero(room[: len(joined)] >= width)
                yield width, at, mix(joined[at] + np.uint64(width))


class WindowSet:
    """Windows of a benchmark by width: a bit table, sorted hashes, the windows and their items."""

    def __init__(self, rows: list[tuple[bytes, int, str | None]]):
        self.widths: dict[int, tuple] = {}
        self.items = sorted({r[2] for r in rows if r[2] is not None})
        number = {x: k for k, x in enumerate(self.items)}
        by_width: dict[int, dict[bytes, list[int]]] = {}
        for window, width, item in rows:
            own = by_width.setdefault(width, {}).setdefault(window, [])
            if item is not None:
                own.append(number[item])
        for width, windows in by_width.items():
            texts = list(windows)
            data = np.frombuffer(b"".join(texts), np.uint8)
            words = Words(data, np.cumsum([0, *map(len, texts)]))
            hashes = next(h for w, at, h in words.rolled(width) if w == width)
            order = np.argsort(hashes, kind="stable")
            bits = max(10, min(26, (16 * len(texts)).bit_length()))
            table = np.zeros(1 << bits, bool)
            table[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.widths[width] = (bits, table, hashes[order], [texts[k] for k in order], [np.array(windows[texts[k]], np.int64) for k in order])
        self.widest = max(by_width, default=0)

    def hits(self, words: Words) -> Iterator[tuple[int, int, np.ndarray]]:
        """(word, width, items) of every verified occurrence."""
        for width, at, hashes in words.rolled(self.widest):
            if width not in self.widths:
                continue
            bits, table, known, windows, items = self.widths[width]
            near = np.flatnonzero(table[(hashes >> np.uint64(64 - bits)).astype(np.int64)])
            low = np.searchsorted(known, hashes[near], "left")
            high = np.searchsorted(known, hashes[near], "right")
            for k in np.flatnonzero(high > low):
                word = int(at[near[k]])
                text = words.window(word, width)
                for c in range(low[k], high[k]):
                    if windows[c] == text:
                        yield word, width, items[c]


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about CHUNK bytes of text, one row at least."""
    for batch in batches:
        sizes = utf8(batch.column(column))[1]
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + CHUNK, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(window binary, words int, item string, bytes long): the distinct windows of every item; no words give none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            words = Words(data, offsets)
            ids = batch.column("item").to_pylist()
            rows: dict[tuple, None] = {}
            for k, item in enumerate(ids):
                a, b = int(words.first[k]), int(words.first[k + 1])
                wide = min(width, b - a)
                if wide:
                    rows.update(dict.fromkeys((words.window(w, wide), wide, item) for w in range(a, b - wide + 1)))
            if rows:
                window, wide, item = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(window, pa.binary()), pa.array(wide, pa.int32()), pa.array(item, pa.string())], ["window", "words", "item"])

    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.mapInArrow(cut, "window binary, words int, item string").distinct()
    return stage(found.withColumn("bytes", F.octet_length("window").cast("long")))


def window_sets(windows: DataFrame, pairs: int = PAIRS, size: int = BYTES) -> Iterator[Broadcast]:
    """The windows as broadcast sets of a bounded size, dealt by hash; one set if the benchmark fits."""
    n, total = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).head()
    parts = max(1, -(-n // pairs), -(-total // size))
    part = F.pmod(F.xxhash64("window", "item"), F.lit(parts))
    for k in range(parts):
        mine = windows.where(part == k) if parts > 1 else windows
        rows = [(bytes(r["window"]), r["words"], r["item"]) for r in mine.select("window", "words", "item").toLocalIterator()]
        yield windows.sparkSession.sparkContext.broadcast(WindowSet(rows))


def _scan(docs: DataFrame, own: Broadcast) -> DataFrame:
    """`docs` (..., text) with n_words, ranges and items instead of the text, every other column kept."""
    names = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = own.value
        for batch in _chunks(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            words = Words(data, offsets)
            steps = np.zeros(len(words.start) + 1, np.int64)
            whose: list[set[int]] = [set() for _ in range(batch.num_rows)]
            for word, width, items in known.hits(words):
                steps[word] += 1
                steps[word + width] -= 1
                whose[words.text[word]].update(items.tolist())
            inside = np.cumsum(steps)[:-1] > 0
            left = np.zeros(len(inside), bool)
            left[1:] = inside[:-1] & (words.text[1:] == words.text[:-1])
            right = np.zeros(len(inside), bool)
            right[:-1] = inside[1:] & (words.text[1:] == words.text[:-1])
            a, b = np.flatnonzero(inside & ~left), np.flatnonzero(inside & ~right)
            text = words.text[a]
            ranges = pa.StructArray.from_arrays(
                [
                    pa.array((a - words.first[text]).astype(np.int32)), pa.array((b + 1 - words.first[text]).astype(np.int32)),
                    pa.array(words.start[a] - offsets[text]), pa.array(words.end[b] - offsets[text]),
                ],
                ["a", "b", "start", "end"],
            )
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)), ranges)
            items = pa.array([[known.items[k] for k in sorted(x)] for x in whose], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(np.diff(words.first)), lists, items], [*names, "n_words", "ranges", "items"]
            )

    return docs.mapInArrow(run, f"{kinds}, n_words long, ranges {_FOUND}, items array<string>")


def _merged(ranges) -> F.Column:
    """Overlapping and touching word ranges as one."""
    both = lambda last, x: F.struct(
        last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")
    )
    add = lambda done, x: F.when(
        F.get(done, F.size(done) - 1)["b"] >= x["a"],
        F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both(F.get(done, F.size(done) - 1), x))),
    ).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(ranges), F.array().cast(_FOUND), add)


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, pairs: int = PAIRS, size: int = BYTES
) -> DataFrame:
    """(doc_id, n_words, n_hit, ranges, items) of every document, rows that repeat included.

    `ranges` are runs of hit words as word numbers [a, b) and bytes [start, end) of the text; `items`
    the distinct ids, as strings, of items with a window in the text. Null and empty texts have no
    words; items of a null id mark words but are no item of the list. An empty benchmark marks nothing.
    `pairs` and `size` bound one broadcast; every bound gives the same rows.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets = list(window_sets(benchmark_windows(benchmark, text_col=text_col, width=width), pairs, size))
    found = _scan(texts, sets[0])
    if len(sets) > 1:
        digest = F.sha2(F.coalesce("text", F.lit("")), 256)
        keyed = texts.select(digest.alias("digest"), "text")
        others = [_scan(keyed, s).where(F.size("ranges") > 0) for s in sets]
        hits = others[0]
        for other in others[1:]:
            hits = hits.unionByName(other)
        once = hits.dropDuplicates(["digest", "ranges", "items"]).groupBy("digest").agg(
            _merged(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        base = _scan(texts.withColumn("digest", digest), sets[0]).select("doc_id", "digest", "n_words")
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
        found = base.join(once, "digest", "left").select("doc_id", "n_words", none("ranges", _FOUND), none("items", "array<string>"))
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "ranges", "items")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", whole: bool = False, width: int = WIDTH) -> DataFrame:
    """`docs` without benchmark text, all columns kept: hit spans are cut out, or with `whole` hit documents go.

    The text keeps everything outside the spans; null texts stay null. Each row is judged by its own text.
    """
    names = docs.columns
    mine = f"c{names.index(text_col)}"
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.array().cast(_FOUND).alias("marks"))
    for own in window_sets(benchmark_windows(benchmark, text_col=text_col, width=width)):
        rows = _scan(rows.withColumn("text", F.col(mine).cast("string")), own)
        rows = rows.withColumn("marks", _merged(F.concat("marks", "ranges"))).drop("n_words", "ranges", "items")
    if whole:
        return rows.where(F.size("marks") == 0).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
    text = F.col(mine).cast("string")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform("marks", lambda x: F.array(x["start"], x["end"]))), F.array(F.octet_length(text).cast("long")))
    raw, edge = F.to_binary(text, F.lit("utf-8")), lambda k: F.get("edges", k).cast("int")
    piece = lambda k: F.substring(raw, edge(2 * k) + 1, edge(2 * k + 1) - edge(2 * k))
    left = F.aggregate(F.sequence(F.lit(0), F.size("marks")), F.lit(b""), lambda done, k: F.concat(done, piece(k)))
    rows = rows.withColumn("edges", edges).withColumn("left", F.when(F.size("marks") > 0, F.decode(left, "utf-8")).otherwise(text))
    return rows.select(*[F.col("left" if f"c{k}" == mine else f"c{k}").alias(c) for k, c in enumerate(names)])
