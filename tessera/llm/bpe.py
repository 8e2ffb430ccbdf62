"""BPE encoding and decoding of whole texts with a given vocabulary.

A word's symbols form a doubly linked list; a priority queue holds (merge rank,
position) of adjacent pairs. Popping an entry whose pair has meanwhile changed
is recognised by its rank and skipped. Texts are brought to the vocabulary's
normal form (NFC, lower case), cut into letters, single numerals and runs of
other symbols, and white space is dropped, as the tokenizer file declares.

Results: ``ids`` is a binary of little-endian unsigned 32-bit integers.
A null text encodes as no ids and decodes as the empty text, as does an empty
or blank one. Nothing is truncated. Repeated rows are encoded alike; an empty
table gives an empty one. Other columns are kept, but columns named like the
outputs are replaced.
"""

from __future__ import annotations

import array
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import parts, release

#: Runs of text remembered by a worker in each of two generations, which bounds its memory for any corpus.
CACHE_WORDS = 100_000
CACHE_WORD_CHARS = 64


push, pop = heapq.heappush, heapq.heappop


def pack(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the others take code points from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a tokenizer file of kind BPE with a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for s, i in [*vocab.items(), *self.added.items()]:
            self.strings[i] = s
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        self.merges: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = rank << 32
            self.made.append(vocab[a + b])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        # The same cut for text of Latin-1 letters only, where the standard module agrees and is faster.
        self.find_latin = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|[\x1c-\x1f_])+").findall
        self.not_latin = re.compile(r"[^\x00-\x84\x86-\xb1\xb4-\xb8\xba-\xbb\xbf-\xff]").search
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split if self.added else None
        self.control = re.compile(r"[\x1c-\x1f]").search
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        data = word.encode()
        n = len(data)
        sym = list(map(self.inner.__getitem__, data))
        sym[-1] = self.last[data[-1]]
        if n == 1:
            return sym
        get, made = self.merges.get, self.made
        # An entry is rank << 32 | position of the pair's left symbol; merges hold rank << 32.
        queue = [r | i for i, r in enumerate(map(get, zip(sym, sym[1:], strict=False))) if r is not None]
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            item = pop(queue)
            i = item & 0xFFFFFFFF
            j = after[i]
            if j >= n or get((sym[i], sym[j])) != item - i:
                continue  # stale: one of the two was merged since (a merged-away symbol is None, in no pair)
            sym[i] = made[item >> 32]
            sym[j] = None
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (r := get((sym[i], sym[j]))) is not None:
                    push(queue, r | i)
            j = before[i]
            if j >= 0 and (r := get((sym[j], sym[i]))) is not None:
                push(queue, r | j)
        return [s for s in sym if s is not None]

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space, remembered if short. Two generations, so that frequent runs stay."""
        ids = self.old.get(chunk)
        if ids is None:
            words = (self.find if self.not_latin(chunk) else self.find_latin)(chunk)
            if len(words) == 1:
                ids = pack(self.merge(words[0]))
            else:
                ids = b"".join([self.cache.get(w) or self.old.get(w) or self.chunk(w) for w in words])
        if len(chunk) <= CACHE_WORD_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.old, self.cache = self.cache, {}
            self.cache[chunk] = ids
        return ids

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no special form at a word's end
        text = text.lower()
        # str.split() also cuts at four control characters, which are symbols of their own here.
        chunks = self.find(text) if self.control(text) else text.split()
        out = list(map(self.cache.get, chunks))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self.chunk(chunks[i])
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or "<" not in text:
            return self.plain(text)
        parts = self.cut(text)
        return b"".join(self.added[p].to_bytes(4, "little") if k % 2 else self.plain(p) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings in order with one space between, as for a tokenizer that declares no decoder."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The tokenizer of a file, one for each Python worker as long as a task needs it."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def unload() -> None:
    """The end of a task: a worker that waits holds neither vocabulary nor words."""
    _LOADED.clear()
    release()


def encode_column(text: Column, path: str) -> Column:
    """Binary column of token ids; path must exist on every executor."""

    @arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for a in parts(batches):
            yield pa.array([bpe.encode(x.as_py()) for x in a], pa.binary())
        del bpe
        unload()

    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    @arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for a in parts(batches):
            yield pa.array([bpe.decode(x.as_py() or b"") for x in a], pa.string())
        del bpe
        unload()

    return decode(ids)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with a binary column of ids; one pass in place, no shuffle."""
    return df.withColumn(out, encode_column(F.col(text), path))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    return df.withColumn(out, decode_column(F.col(ids), path))


def round_trip(df: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with ids and the text decoded from them, in one Python worker a core instead of one for each direction."""

    @arrow_udf("struct<ids binary, decoded string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for a in parts(batches):
            ids = [bpe.encode(x.as_py()) for x in a]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["ids", "decoded"])
            del ids
        del bpe
        unload()

    pair = df.withColumn("__both", both(F.col(text)))
    return pair.withColumn(out, F.col("__both.ids")).withColumn(decoded, F.col("__both.decoded")).drop("__both")


__all__ = ["WordBpe", "decode", "encode", "load", "round_trip"]
