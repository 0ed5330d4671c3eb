"""Whole-array text primitives in numpy: UTF-8 bytes of an Arrow column, words, shingles, their hashes.

Hashes are sums of per-byte random words times powers of an odd base modulo 2^64, scrambled at the
end. Equal strings have equal hashes; different strings of a corpus collide with a probability of
about 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shiftgrain.llm.perfect_hash import mix

#: Bytes hashed at a time.
CHUNK = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
BASE = np.uint64(0x9E3779B97F4A7C55)
with np.errstate(over="ignore"):
    #: A random word for each byte; the folded table maps white space to nothing and A-Z to a-z.
    BYTE_WORDS = mix(np.arange(1, 257, dtype=np.uint64))
    _FOLDED_WORDS = np.where(_WHITE, np.uint64(0), BYTE_WORDS[_FOLD])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; text k is bytes[offsets[k]:offsets[k + 1]], null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, places, content = column.buffers()
    if not len(column) or content is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts, and where each text's words begin."""
    solid = ~_WHITE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid
    before[offsets] = False
    after = before[1:].copy()
    after[:-1] = solid[1:]
    ends_of_texts = offsets[1:] - 1
    if len(after):
        after[-1] = False
        after[ends_of_texts[ends_of_texts >= 0]] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, A-Z lower-cased; first[k]..first[k + 1] are those of text k)."""
    starts, ends, first = word_spans(data, offsets)
    out = np.empty(len(starts), np.uint64)
    a = 0
    table = powers(256)
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK)))
        low, high = starts[a], ends[b - 1]
        own = starts[a:b] - low
        spread = np.diff(own, append=high - low)
        if spread.max() > len(table):
            table = powers(int(spread.max()))
        place = np.arange(high - low) - np.repeat(own, spread)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(_FOLDED_WORDS[data[low:high]] * table[place], own)
            out[a:b] = mix(sums + (ends[a:b] - starts[a:b]).astype(np.uint64))
        a = b
    return out, first


def prefix_hashes(data: np.ndarray, offsets: np.ndarray, widths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the first w bytes of every word longer than w bytes, for each w of `widths`, A-Z lower-cased."""
    starts, ends, first = word_spans(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    table, whose, out = powers(max(widths)), [], []
    for w in widths:
        long = ends - starts > w
        at, total = starts[long], np.zeros(int(long.sum()), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(w):
                total += _FOLDED_WORDS[data[at + k]] * table[k]
            out.append(mix(total + np.uint64(w << 32)))
        whose.append(text[long])
    return np.concatenate(whose), np.concatenate(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a shorter text is one shingle, no words give none."""
    words, first = word_hashes(data, offsets)
    n = np.diff(first)
    joined = np.zeros(max(0, len(words) - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            joined = joined * BASE + words[k : k + len(joined)]
        joined = mix(joined)
        out = []
        for k in range(len(n)):
            if n[k] >= width:
                out.append(np.unique(joined[first[k] : first[k + 1] - width + 1]))
            elif n[k]:
                short = np.uint64(n[k])
                for w in words[first[k] : first[k + 1]]:
                    short = short * BASE + w
                out.append(mix(np.array([short ^ np.uint64(0x5851F42D4C957F2D)])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
