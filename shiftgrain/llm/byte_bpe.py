"""Byte-level BPE with the tokenizers library over Arrow batches, and its exact inverse.

A rank file becomes a BPE model: each byte has a printable character, each token is spelt in those
characters, and every split of a token into two tokens is a merge of that token's rank. Texts are
cut at blanks that always begin a new match of the splitting pattern (a blank before a character
that is no white space), so a word's ids are computed once and then remembered. Decoding looks up
the bytes of each id; a window of ids may cut a character, which `decode_text` repairs at its edges.

Encoding has no shuffle. A task holds one Arrow batch and two generations of remembered words.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import string
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from shiftgrain.llm.common import kept_in_worker, texts

#: Words that a generation of the memory holds; the older of two generations is dropped.
MEMORY = 1_000_000
#: White space as any of the libraries at hand sees it: a superset only makes units longer.
_SPACE = r"\s᠎​﻿"
_SPACES = frozenset(c for c in map(chr, range(0x10000)) if re.match(f"[{_SPACE}]", c))
_CUT = re.compile(f" (?=[^{_SPACE}])")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or one from 256 upwards."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_CHARACTERS = byte_characters()
_TO_CHARACTERS = dict(enumerate(_CHARACTERS))
_TO_BYTE = {c: b for b, c in enumerate(_CHARACTERS)}


#: The character of a blank, and the counts of ids below which they have a packer of their own.
_BLANK, _SHORT = _CHARACTERS[0x20], 32


def spell(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHARACTERS)


def unspell(token: str) -> bytes:
    return bytes(_TO_BYTE[c] for c in token)


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def model_of(ranks: dict[bytes, int]) -> models.BPE:
    """The BPE model that joins the pair of lowest rank first and takes a whole match that is a token."""
    merges = []
    for token, rank in ranks.items():
        pairs = ((token[:k], token[k:]) for k in range(1, len(token)))
        merges += sorted((rank, ranks[a], ranks[b], a, b) for a, b in pairs if a in ranks and b in ranks)
    merges.sort(key=lambda m: m[0])
    return models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=[(spell(m[3]), spell(m[4])) for m in merges], ignore_merges=True)


@functools.lru_cache(maxsize=4)
def rank_tokenizer(path: str, pattern: str) -> Tokenizer:
    tokenizer = Tokenizer(model_of(ranks_of(path)))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


@functools.lru_cache(maxsize=4)
def file_tokenizer(path: str, pattern: str) -> Tokenizer:
    """A saved byte-level tokenizer that splits by `pattern`; the strings of its special tokens are ordinary text."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class Encoder:
    """Whole texts to ids, packed as little-endian integers of `kind`."""

    def __init__(self, tokenizer: Tokenizer, pattern: str, kind: str = "<u4"):
        self.tokenizer, self.kind, self.split = tokenizer, kind, regex.compile(pattern).findall
        self.tokenize = tokenizer.model.tokenize
        code = {"<u2": "H", "<u4": "I"}[kind]
        self.pack = [struct.Struct(f"<{n}{code}").pack for n in range(_SHORT)]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _spelt(self, match: str) -> bytes:
        """The ids of one match of the pattern, in printable characters: the model alone, no splitting."""
        ids = [t.id for t in self.tokenize(match)]
        return self.pack[len(ids)](*ids) if len(ids) < _SHORT else np.asarray(ids, self.kind).tobytes()

    def _match(self, match: str) -> bytes:
        return self._spelt(spell(match.encode()))

    def _letters(self, word: str) -> bytes:
        """The ids of a blank and letters, which spell themselves if they are ASCII."""
        return self._spelt(_BLANK + word) if word.isascii() else self._match(" " + word)

    def _recall(self, unit: str) -> bytes | None:
        found = self.young.get(unit)
        return self.old.get(unit) if found is None else found

    def _keep(self, unit: str, found: bytes) -> bytes:
        if len(unit) < 64:
            if len(self.young) >= MEMORY:
                self.old, self.young = self.young, {}
            self.young[unit] = found
        return found

    def _word(self, word: str) -> bytes:
        """The ids of a blank and letters."""
        found = self._recall(word)
        return self._keep(word, self._letters(word)) if found is None else found

    def _bare(self, match: str) -> bytes:
        """The ids of a match that has no blank and letters; remembered under a key no unit can have."""
        found = self._recall(" " + match)
        return self._keep(" " + match, self._match(match)) if found is None else found

    def _unit(self, unit: str) -> bytes | None:
        """The ids of a blank and `unit`, which is not in the younger memory; None if the blank need not begin a match."""
        found = self.old.get(unit)
        if found is None:
            if unit.isascii():
                if not unit or unit[0] in _SPACES:
                    return None
            elif unit[0] in _SPACES:
                return None
            elif max(unit) >= "ɐ":  # past the Latin blocks, where libraries may follow different Unicode versions
                return self._keep(unit, self._ids(" " + unit))
            if unit.isalpha():
                found = self._letters(unit)
            elif (word := unit.rstrip(string.punctuation)).isalpha():  # letters, then marks that end the unit: two matches
                found = self._word(word) + self._bare(unit[len(word):])
            else:
                found = b"".join([self._word(m[1:]) if m[0] == " " and m[1:].isalpha() else self._bare(m) for m in self.split(" " + unit)])
        return self._keep(unit, found)

    def _units(self, units: list[str]) -> bytes | None:
        """The ids of units with a blank before each but the first; None if some blank need not begin a match."""
        rest = units[1:]
        found = list(map(self.young.get, rest))
        k = 0
        for _ in range(found.count(None)):
            k = found.index(None, k)
            ids = self.young.get(rest[k]) or self._unit(rest[k])
            if ids is None:
                return None
            found[k] = ids
        head = self._ids(units[0]) if units[0] else b""
        return head + b"".join(found)

    def encode(self, text: str) -> bytes:
        found = self._units(text.split(" "))
        return self._units(_CUT.split(text)) if found is None else found


class Decoder:
    """Ids back to bytes."""

    def __init__(self, tokenizer: Tokenizer):
        size = tokenizer.get_vocab_size(with_added_tokens=False)
        self.table = [unspell(tokenizer.id_to_token(k)) for k in range(size)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def decode_text(self, ids: np.ndarray) -> tuple[str, int, int]:
        """The whole characters of a window of ids, and the bytes of cut characters before and after them."""
        raw = self.decode(ids)
        start = 0
        while start < min(3, len(raw)) and raw[start] & 0xC0 == 0x80:
            start += 1
        stop = len(raw)
        for back in range(1, min(4, stop - start) + 1):
            lead = raw[stop - back]
            if lead & 0xC0 != 0x80:
                need = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                stop -= back if need > back else 0
                break
        return raw[start:stop].decode("utf-8", "replace"), start, len(raw) - stop

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character that each id touches in the text it came from."""
        raw = np.frombuffer(self.decode(ids), np.uint8)
        ends = np.cumsum([len(self.table[k]) for k in ids.tolist()], dtype=np.int64)
        starts = ends - np.diff(ends, prepend=0)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        return (character[starts], character[ends - 1] + 1) if len(ids) else (starts, ends)


#: One encoder and decoder per worker process and vocabulary, so that remembered words outlive a task.
_ENCODERS: dict[tuple, Encoder] = {}


@functools.lru_cache(maxsize=4)
def _decoder(path: str, pattern: str) -> Decoder:
    return Decoder(rank_tokenizer(path, pattern))


kept_in_worker(_ENCODERS.clear, _decoder.cache_clear, rank_tokenizer.cache_clear, file_tokenizer.cache_clear)


def encoder_for(make: Callable[..., Tokenizer], path: str, pattern: str, kind: str) -> Encoder:
    key = (make.__name__, path, pattern, kind)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(make(path, pattern), pattern, kind)
    return _ENCODERS[key]


def _batches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield batch.column("doc_id"), (x.as_py() or "" for x in batch.column("text"))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, starts array<int>, ends array<int>): ids and the characters each touches.

    A null text counts as empty and has no ids; ids, nulls among them, and repeated rows pass through.
    """

    def run(batches):
        encoder = encoder_for(rank_tokenizer, path, pattern, "<u4")
        for ids, rows in _batches(batches):
            codes = [np.frombuffer(encoder.encode(t), "<u4").astype(np.int32) for t in rows]
            spans = [_decoder(path, pattern).spans(c) for c in codes]
            arrays = [pa.array([x.astype(np.int32) for x in col], pa.list_(pa.int32())) for col in (codes, [s[0] for s in spans], [s[1] for s in spans])]
            yield pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", "ids", "starts", "ends"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, raw binary, text string) of rows (doc_id, ids array<int>); null ids decode to nothing.

    `text` has the whole characters of `raw`: pieces of a character cut at either end are left out.
    """

    def run(batches):
        decoder = _decoder(path, pattern)
        for batch in batches:
            ids = [np.asarray(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            raw, text = [decoder.decode(x) for x in ids], [decoder.decode_text(x)[0] for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary()), pa.array(text, pa.string())], names=["doc_id", "raw", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass over the rows.

    The ids are digested as little-endian unsigned 32-bit integers, then decoded and digested as bytes.
    """

    def run(batches):
        encoder = encoder_for(rank_tokenizer, path, pattern, "<u4")
        decoder = _decoder(path, pattern)
        for ids, rows in _batches(batches):
            n, coded, decoded = [], [], []
            for t in rows:
                code = encoder.encode(t)
                n.append(len(code) // 4)
                coded.append(hashlib.sha256(code).hexdigest())
                decoded.append(hashlib.sha256(decoder.decode(np.frombuffer(code, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
