"""Collocations: phrases of up to ``longest`` words that hold together better than any way to cut them.

Suffix-sigma. Words are counted first, by language; a phrase is only as frequent
as its words and its pairs of neighbouring words, so pieces are cut at words and
between pairs under ``least`` occurrences. What follows each word in its run, up
to ``longest`` words, is a suffix; equal suffixes of a task are sent once with
their number, packed by where they go. Suffixes are shuffled by language and first
word and sorted in reverse lexicographic order, so that all that share a prefix lie
together, and one stack of open prefixes counts every phrase while it passes over
them. First and rest of every cut of a phrase are then met in joins.

Where pieces may be cut is looked up in two bitmaps of at most ``max_bits`` bits
that every task gets: hashes of frequent words, and cells that pairs fall in often
enough, counted in blocks of cells. They let all frequent words and pairs through
and some others, which costs suffixes, not phrases: counts are compared at the
end. First words are dealt by hash into as many groups as hold LOAD words of text
each. Words with more than that, or than one in HEAVY of all, are dealt by their
first two words, which phrases share, and heavy pairs by the whole suffix; parts of
a phrase's count then meet in a sum. So a task has one group of bounded size in hand.

Only A-Z are lower-cased. ``[.,;:!?`` and line ends separate pieces, spaces and
tabs words; other characters belong to words. Null texts are empty; a null
language is ``und`` and counts with that label. Repeated rows count each; ids have
no part in it. Other columns are not read, whatever their names. Ties in score
and count go by the phrase in byte order. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Workspace, few, slices
from .neardup import mix

LONGEST, LEAST, RANKS = 5, 100, 2000
#: Bits for each frequent word, words of text for each cell that counts pairs, and the most bits of either filter.
BITS, WORDS_A_CELL, MAX_BITS = 32, 16, 1 << 29
#: Cells that are added up at a time; at most 65,536, so that two bytes name one.
BLOCK = 1 << 16
#: Pairs that a task holds before it counts them, and words that it takes in hand at a time.
PAIRS, TOGETHER = 4_000_000, 100_000
#: Distinct words or suffixes that a task holds before it gives them on.
HELD = 300_000
#: Occurrences of the suffixes that meet in a task's hands, about, and the most words and pairs that are dealt out for having more.
LOAD, HEAVY = 100_000, 1 << 16
UND = "und"

#: Between words: lower than anything in a word, so that sorted suffixes with a common prefix lie together.
TAB = "\t"
#: Characters of words below the tab, and what stands for them: ``!`` is in no word.
_LOW = [(chr(k), "!" + chr(65 + k)) for k in range(9)]
_LOW_BYTES = re.compile(rb"[\x00-\x08]")
_TABLE = bytearray(range(256))
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 46
_TABLE[9] = 32
#: Stands between pieces, and is in no word.
STOP, _APART = b".", b" . "


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, and a STOP after each piece, a few MB of the text at a time."""
    text = text.translate(_TABLE)
    if _LOW_BYTES.search(text):
        text = _LOW_BYTES.sub(lambda m: b"!" + bytes([65 + m[0][0]]), text)
    start = 0
    while start < len(text):
        end = text.find(STOP, start + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[start:end].replace(STOP, _APART).split() + [STOP]
        start = end


def runs_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words) of texts of one language put together, with a STOP after each piece."""
    held: dict[str, list[bytes]] = {}
    for batch in batches:
        for part in slices(batch, 1):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for words in words_of(text):
                    own = held.setdefault(lang, [])
                    own += words
                    if len(own) > TOGETHER:
                        yield lang, held.pop(lang)
            if len(held) > 100:
                yield from held.items()
                held = {}
    yield from held.items()


def plain(phrase: Column) -> Column:
    """The phrase with spaces between its words and its own characters."""
    out = F.translate(phrase, TAB, " ")
    marked = out
    for low, mark in _LOW:
        marked = F.replace(marked, F.lit(mark), F.lit(low))
    return F.when(F.contains(out, F.lit("!")), marked).otherwise(out)


class Held:
    """Counts by language, given on as batches whenever there are many."""

    def __init__(self, name: str):
        self.name, self.counts = name, {}

    def of(self, lang: str) -> Counter:
        return self.counts.setdefault(lang, Counter())

    def full(self) -> bool:
        return sum(map(len, self.counts.values())) > HELD

    def give(self) -> Iterator[pa.RecordBatch]:
        for lang, counts in self.counts.items():
            if counts:
                keys = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), keys, pa.array(list(counts.values()), pa.int64())], ["lang", self.name, "n"])
        self.counts = {}


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) by task; the number of all words has a null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = Held("word"), Counter()
        for lang, words in runs_of_texts(batches):
            counts = held.of(lang)
            counts.update(words)
            total[lang] += len(words) - counts.pop(STOP)
            if held.full():
                yield from held.give()
        yield from held.give()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([None] * len(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")


def cell(lang: str, word: bytes) -> int:
    """Spark's xxhash64(lang, word)."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang, 42))


def frequent_bits(words: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with a bit for each word's hash; bits is a power of two."""
    at = F.xxhash64("lang", "word").bitwiseAND(bits - 1) + 1
    found = words.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    out = np.zeros(bits // 8, np.uint8)
    for r in found.toLocalIterator():
        start = (r.bucket - 1) * 4096
        part = np.frombuffer(r.bitmap, np.uint8)[: len(out) - start]
        out[start : start + len(part)] = part
    return out


class Hashes(dict):
    """The hash of a frequent word of a language, or 0. filled is the words' bitmap."""

    def __init__(self, lang: str, filled: np.ndarray):
        self.lang, self.filled, self.mask = lang, filled, len(filled) * 8 - 1

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        h = cell(self.lang, word)
        self[word] = out = (h | 1) if word != STOP and self.filled[(h & self.mask) >> 3] >> (h & 7) & 1 else 0
        return out


def hashes_of(batches: Iterator[pa.RecordBatch], filled: np.ndarray) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, words, their hashes): 0 for a STOP or a word that is not frequent."""
    known: dict[str, Hashes] = {}
    for lang, words in runs_of_texts(batches):
        if len(known) > 100:
            known.clear()
        look = known.setdefault(lang, Hashes(lang, filled))
        yield lang, words, np.fromiter(map(look.__getitem__, words), np.uint64, len(words))


def pair_cells(h: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each two neighbours are both frequent, and the cell of their hash."""
    return (h[:-1] != 0) & (h[1:] != 0), mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) & np.uint64(cells - 1)


def frequent_pairs(ws: Workspace, docs: DataFrame, sent: Broadcast, cells: int, least: int, each: int) -> tuple[np.ndarray, dict[int, int]]:
    """A bitmap of the cells that pairs of neighbouring words fall in at least so often, and how often where it is over ``each``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            block = at // BLOCK
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            ends = [*first[1:].tolist(), len(at)]
            low, n = (at % BLOCK).astype(np.uint16), n.astype(np.uint32)
            out = [(int(block[i]), low[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(first.tolist(), ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "at", "n"])

        held, size = [], 0
        for _, _, h in hashes_of(batches, sent.value):
            near, at = pair_cells(h, cells)
            held.append(at[near])
            size += len(held[-1])
            if size > PAIRS:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None

        def bits() -> pa.RecordBatch:
            hot = np.flatnonzero(total > each)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary()), pa.array([hot + block * BLOCK]), pa.array([total[hot]])], ["block", "bits", "hot", "times"])

        for batch in batches:
            for to, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if to != block:
                    if block is not None:
                        yield bits()
                    block, total = to, np.zeros(BLOCK, np.int64)
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        if block is not None:
            yield bits()

    rows = docs.select("lang", "text").mapInArrow(count, "block int, at binary, n binary")
    found = ws.save(rows.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, bits binary, hot array<long>, times array<long>"), "pairs")
    out, often = np.zeros((cells // BLOCK, BLOCK // 8), np.uint8), {}
    for r in found.collect():  # cells / 8 bytes and HEAVY cells at most
        out[r.block] = np.frombuffer(r.bits, np.uint8)
        often |= dict(zip(r.hot, r.times, strict=True))
    return out.ravel(), often


def power(n: int, least: int, most: int) -> int:
    """A power of two from n on, within bounds that are powers of two."""
    return min(most, max(least, 1 << max(0, n - 1).bit_length()))


class Dealer:
    """Says where the suffixes of a language go: by first word, those of heavy words by pair, those of heavy pairs by themselves."""

    def __init__(self, lang: str, keys: int, each: int, heavy: dict[tuple[str, str], int], often: dict[int, int], cells: int):
        self.lang, self.keys, self.each, self.heavy, self.often, self.mask = lang, keys, each, heavy, often, cells - 1
        self.known: dict[bytes, int | None] = {}

    def place(self, suffix: bytes) -> tuple[int, bool]:
        """Key, and whether the count of a phrase may be in parts."""
        first, _, rest = suffix.partition(b"\t")
        if first not in self.known:
            if len(self.known) > HELD:
                self.known.clear()
            self.known[first] = None if (self.lang, first.decode()) in self.heavy else cell(self.lang, first) & (self.keys - 1)
        key = self.known[first]
        if key is not None:
            return key, False
        parts = -(-self.heavy[self.lang, first.decode()] // self.each)
        one, two = cell(self.lang, first), cell(self.lang, rest.partition(b"\t")[0])
        times = self.often.get(int(pair_cells(np.array([one | 1, two | 1], np.uint64), self.mask + 1)[1][0]), 0)
        key = xxhash.xxh3_64_intdigest(one.to_bytes(8), two % parts)
        if times:
            key = xxhash.xxh3_64_intdigest(one.to_bytes(8) + two.to_bytes(8), xxhash.xxh3_64_intdigest(suffix) % -(-times // self.each))
        return key >> 2 | 1 << 62, times > 0  # apart from the keys of other words


def suffixes(ws: Workspace, docs: DataFrame, words: DataFrame, total: int, longest: int, least: int, max_bits: int) -> DataFrame:
    """(lang, key, split, body, n): the suffixes of two words or more of a task and how often each is, within runs of frequent pairs of words, those of a key in one row."""
    context = docs.sparkSession.sparkContext
    each = max(LOAD, total // HEAVY)
    sent = context.broadcast(frequent_bits(words, power(BITS * words.count(), 1 << 15, max_bits)))
    cells = power(total // WORDS_A_CELL, BLOCK, max(BLOCK, max_bits))
    filled, often = frequent_pairs(ws, docs, sent, cells, least, each)
    heavy = {(r.lang, r.word): r.a for r in words.where(F.col("a") > each).collect()}  # HEAVY at most
    pairs = context.broadcast((filled, often, heavy))
    keys = power(total // LOAD, 256, 1 << 60)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tab = Held("suffix"), TAB.encode()
        filled, often, heavy = pairs.value
        for lang, words, h in hashes_of(batches, sent.value):
            near, at = pair_cells(h, cells)
            near &= filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
            stop = np.arange(len(h))
            stop[:-1][near] = len(h)
            stop = np.minimum.accumulate(stop[::-1])[::-1]  # the last word of each word's run
            size = np.minimum(longest, stop - np.arange(len(h)) + 1)
            start = np.flatnonzero(size > 1)
            held.of(lang).update([tab.join(words[i : i + n]) for i, n in zip(start.tolist(), size[start].tolist(), strict=True)])
            if held.full():
                yield from packed(held, heavy, often)
        yield from packed(held, heavy, often)

    def packed(held: Held, heavy: dict, often: dict) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.counts.items():
            dealer, groups = Dealer(lang, keys, each, heavy, often, cells), {}
            for suffix in counts:
                groups.setdefault(dealer.place(suffix), []).append(suffix)
            out = [(lang, key, split, b"\n".join(own), np.array([counts[x] for x in own]).tobytes()) for (key, split), own in groups.items()]
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 1000], strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["lang", "key", "split", "body", "n"])
        held.counts = {}

    return docs.select("lang", "text").mapInArrow(run, "lang string, key long, split boolean, body binary, n binary")


def prefixes(counts: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Every prefix of two words or more of some suffixes and how often it is: one stack over the suffixes in reverse order."""
    words: list[str] = []
    times: list[int] = []

    def close(depth: int) -> Iterator[tuple[str, int]]:
        while len(words) > depth:
            n = times.pop()
            if len(words) > 1:
                yield TAB.join(words), n
                times[-1] += n
            words.pop()

    for suffix in sorted(counts, reverse=True):
        new = suffix.split(TAB)
        depth = 0
        for a, b in zip(words, new, strict=False):
            if a != b:
                break
            depth += 1
        yield from close(depth)
        words += new[depth:]
        times += [0] * (len(new) - depth)
        times[-1] += counts[suffix]
    yield from close(0)


def prefix_counts(found: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a): every phrase at least so often, those of heavy pairs in parts."""
    at = ["lang", "key", "split"]
    rows = found.repartition(*at).sortWithinPartitions(*at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            out = [(at[0], phrase, n) for phrase, n in prefixes(counts) if n >= least or at[2]]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "a"])

        at, counts = None, Counter()
        for batch in batches:
            for lang, key, split, body, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, key, split) != at:
                    if counts:
                        yield counted()
                    at, counts = (lang, key, split), Counter()
                for suffix, times in zip(body.decode().split("\n"), np.frombuffer(n, np.int64).tolist(), strict=True):
                    counts[suffix] += times
        if counts:
            yield counted()

    return rows.mapInArrow(run, "lang string, phrase string, a long")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, percent: int = 100, ranks: int = RANKS, max_bits: int = MAX_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``ranks`` phrases of each language.

    Phrases whose words lie inside a longer one with at least ``percent`` of their occurrences are left out.
    """
    ws = Workspace(docs.sparkSession, "phrases")
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UND)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = word_counts(docs).groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("word").isNull() | (F.col("a") >= least))
    words = ws.save(words, "words")
    totals, words = words.where("word is null").select("lang", F.col("a").alias("n")), words.where("word is not null")
    total = totals.agg(F.sum("n")).first()[0] or 0
    found = ws.save(suffixes(ws, docs, words, total, longest, least, max_bits), "suffixes")
    counted = prefix_counts(found, least)
    candidates = ws.save(counted.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "candidates")
    ws.drop("suffixes")
    return ranked(ws, scored(ws, candidates, words, totals, percent), ranks)


def scored(ws: Workspace, candidates: DataFrame, words: DataFrame, totals: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of candidates that no longer one takes in."""
    known = candidates.union(words.select("lang", "word", "a"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), TAB)
    cuts = candidates.withColumn("w", F.split("phrase", TAB)).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("a").alias(count)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.join(few(totals), "lang")
    score = F.call_function("div", wide("a") * F.lit(1000).cast("decimal(4,0)") * F.col("n").cast("decimal(16,0)"), wide("l") * wide("r"))
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # occurrences only fall from a phrase to a longer one: one word more tells all
    inner = candidates.withColumn("w", F.split("phrase", TAB)).where("size(w) > 2")
    inner = inner.select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    return ws.save(left.select("lang", plain(F.col("phrase")).alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score"), "scored")


def ranked(ws: Workspace, rows: DataFrame, ranks: int) -> DataFrame:
    """The first ``ranks`` of each language: of parts first, so that no task sorts a language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = rows.count() // (50 * ranks) + 1
    in_part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= ranks)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= ranks)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
