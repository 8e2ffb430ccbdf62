"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set are the hashes (64 bits, of the xxhash of each word) of its
distinct runs of five words; a link that joins two groups is confirmed on the
words themselves.
Its sketch has ``t`` coordinates. In each of the first t rounds every element is
thrown into a hashed bin with a hashed value; in round t + b every element goes
to bin b. A bin keeps the least (round, value), and rounds end when no bin is
empty, so every coordinate is filled after 2 t rounds at the latest and the
share of equal coordinates is concentrated around the Jaccard similarity as for
independent permutations. Bands of coordinates give buckets of candidates; of
buckets with the same members one is kept.

Documents with equal sets are one class from the start, with a number of its
own and one text; only classes are compared further. The texts of a bucket's members meet in
one task, or for a large bucket in many, each with blocks of bounded size; full
sets are intersected there as 0/1 matrices, and only links that span what was
found leave the task. First a share of the buckets is compared inside blocks,
which costs one text a member and joins most of a large group. Buckets whose
members are then in one component are done. In the others every member outside
the largest component is compared with all members of other components, so each
pair of a bucket is compared or already connected, and components are those of
all links among candidates.

Of pairs at similarity 0.75, bands of 7 in 512 coordinates miss (1 - 0.75 ** 7)
** 73, 3 in 100,000; at 0.8 one in a hundred million. Below 0.75 narrower bands
keep that chance at the threshold (``band_width``).

Null and blank texts have no set and are linked with nothing; rows without an id
keep a null component and are kept. Rows that share an id but not their text
are documents of their own with one name; text_hash tells them apart.
Texts of any length are read whole. An empty table gives an empty one. Only id
and text are read: other columns, whatever their names, have no part in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, join_dealt, map_slices, release

WORDS, COORDINATES, BAND = 5, 512, 7
PERCENT = 75
#: One in so many buckets takes part in the first round.
FIRST_SHARE = 8
#: Texts and shingles of a block, about; a longer text is a block's only one.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 19
#: Columns of the 0/1 matrices that are multiplied at a time.
COLUMNS = 4096

#: Words whose hashes a worker remembers, and runs of words that a tile holds to confirm links.
HELD_WORDS, HELD_RUNS = 60_000, 60_000
#: Sets of so many runs at most are named by the runs.
FEW_RUNS = 64

_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, as far as a task has met them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in ASCII lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII case and ASCII white space


def runs_of(found: list[bytes], words: int) -> set[bytes]:
    """The distinct runs of so many words; of fewer words the whole."""
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words: of the hashes of their words, in order."""
    return hashed_runs(words_of(text), words)


def hashed_runs(found: list[bytes], words: int) -> np.ndarray:
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    runs = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        runs = mix(runs + np.uint64(_ODD)) ^ h[j : len(h) - k + 1 + j]
    return np.unique(mix(runs))


def set_key(found: list[bytes], hashes: np.ndarray, words: int) -> bytes | None:
    """Names a set: by its hashes, and where they are few by its runs of words themselves."""
    if not len(hashes):
        return None
    data = b"\n".join(sorted(runs_of(found, words))) if len(hashes) <= FEW_RUNS else hashes.tobytes()
    return hashlib.blake2b(data, digest_size=16, person=b"runs" if len(hashes) <= FEW_RUNS else b"hashes").digest()


def sketch(hashes: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t coordinates (a power of two), each a round and a value."""
    bin_bits = t.bit_length() - 1
    value_bits = 64 - 2 * bin_bits - 1
    at_bin, at_round = np.uint64(64 - bin_bits), np.uint64(value_bits)
    low = np.uint64((1 << 64 - bin_bits) - 1)
    out = np.zeros(t, np.uint64)
    filled = np.zeros(t, bool)
    step = max(1, 4 * t // len(hashes))
    at = np.arange(t, dtype=np.uint64)
    for first in range(0, 2 * t, step):
        rounds = np.arange(first, min(first + step, 2 * t), dtype=np.uint64)
        x = mix(hashes[None, :] + mix(rounds + np.uint64(1))[:, None])
        bins = x >> at_bin if first + step <= t else np.where(rounds[:, None] < t, x >> at_bin, rounds[:, None] - np.uint64(t))
        keys = np.sort(((bins << at_bin) | (rounds[:, None] << at_round) | (x & np.uint64((1 << value_bits) - 1))).ravel())
        i = np.searchsorted(keys, at << at_bin)
        hit = np.minimum(i, len(keys) - 1)
        new = (i < len(keys)) & (keys[hit] >> at_bin == at) & ~filled
        out[new] = keys[hit[new]] & low
        filled |= new
        if filled.all():
            return out
    return out


def band_width(percent: int) -> int:
    """BAND from PERCENT on; below it the widest band that misses no more at the threshold."""
    if percent >= PERCENT:
        return BAND

    def missed(share: float, width: int) -> float:
        return (1 - share**width) ** (COORDINATES // width)

    widths = [w for w in range(1, BAND + 1) if missed(percent / 100, w) <= missed(PERCENT / 100, BAND)]
    if not widths:
        raise ValueError(f"{COORDINATES} coordinates do not find pairs of {percent} percent")
    return max(widths)


def bands(coordinates: np.ndarray, width: int = BAND) -> np.ndarray:
    rows = coordinates[: len(coordinates) // width * width].reshape(-1, width)
    h = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(_ODD)
    for k in range(width):
        h = mix(h ^ rows[:, k]) + np.uint64(k)
    return h.view(np.int64)


def measured(docs: DataFrame, doc_id: str, text: str, words: int, width: int = BAND) -> DataFrame:
    """(doc_id, text_hash, key, n, bands): key names the set; a document without words has none. Copies near each other have their bands once."""

    def step():
        known: set[bytes] = set()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, sizes, found = [], [], []
            for x in batch.column(2):
                w = words_of(x.as_py())
                s = hashed_runs(w, words)
                sizes.append(len(s))
                key = set_key(w, s, words)
                keys.append(key)
                if key is None or key in known:
                    found.append(None)
                    continue
                if len(known) >= 100_000:
                    known.clear()
                known.add(key)
                found.append(bands(sketch(s), width))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_hash", "key", "n", "bands"])

        return run

    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")]
    return map_slices(docs, columns, step, "doc_id long, text_hash long, key binary, n long, bands array<long>")


def intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of one with each of two."""
    if len(one) * len(two) <= 4:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in two] for a in one], np.int64)
    row = np.repeat(np.arange(len(one) + len(two)), [len(s) for s in (*one, *two)])
    order = np.argsort(values := np.concatenate([*one, *two]), kind="stable")
    values, row = values[order], row[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    shared = ~(new & np.concatenate([new[1:], [True]]))  # what one set alone has cannot be in two
    row, column = row[shared], (np.cumsum(new[shared]) - 1)
    out = np.zeros((len(one), len(two)), np.float64)
    ends = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    for a, b in zip(ends, ends[1:], strict=False):
        m = np.zeros((len(one) + len(two), COLUMNS), np.float32)
        m[row[a:b], column[a:b] % COLUMNS] = 1
        out += m[: len(one)] @ m[len(one) :].T
    return out.astype(np.int64)


def joined(texts: list[str], place: np.ndarray, x: np.ndarray, y: np.ndarray, words: int, percent: int) -> list[int]:
    """The least place reachable from each place by the links (x, y) of texts. Each link that joins two is confirmed on the runs of words themselves."""
    root = list(range(int(place.max()) + 1))
    sets: dict[int, set[bytes]] = {}
    held = 0

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def runs(i: int) -> set[bytes]:
        nonlocal held
        if i not in sets:
            if held > HELD_RUNS:
                sets.clear()
                held = 0
            sets[i] = runs_of(words_of(texts[i]), words)
            held += len(sets[i])
        return sets[i]

    apart = len(root)
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = top(int(place[i])), top(int(place[j]))
        if a == b:
            continue
        one, two = runs(i), runs(j)
        both = len(one & two)
        if 100 * both >= percent * (len(one) + len(two) - both):
            root[max(a, b)] = min(a, b)
            apart -= 1
            if apart == 1:
                break
    return [top(i) for i in range(len(root))]


def linked(tiles: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): components joined by links between a text that asks and one that answers in a tile (bucket, i, j)."""
    at = ["bucket", "i", "j"]
    rows = tiles.join(texts, "rep").repartition(*at).sortWithinPartitions(*at).select(*at, "component", "asks", "answers", "text")

    def spanning(members: list[tuple[int, bool, bool, str]]) -> list[tuple[int, int]]:
        component, place = np.unique([m[0] for m in members], return_inverse=True)
        texts = [m[3] for m in members]
        sets = [shingles(t, words) for t in texts]
        size = np.array([len(s) for s in sets])
        one, two = (np.flatnonzero([m[k] for m in members]) for k in (1, 2))
        if not len(one) or not len(two):
            return []
        both = intersections([sets[i] for i in one], [sets[i] for i in two])
        close = 100 * both >= percent * (size[one, None] + size[None, two] - both)
        x, y = np.nonzero(close & (place[one, None] != place[None, two]))
        root = joined(texts, place, one[x], two[y], words, percent)
        return [(int(component[k]), int(component[r])) for k, r in enumerate(root) if k != r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, members, out = None, [], []
        for batch in batches:
            for bucket, i, j, *rest in zip(*(batch.column(k).to_pylist() for k in range(6)), batch.column(6), strict=True):
                if (bucket, i, j) != tile:
                    if len(members) > 1:
                        out += spanning(members)
                    tile, members = (bucket, i, j), []
                members.append((*rest[:3], rest[3].as_py()))
        if len(members) > 1:
            out += spanning(members)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        members.clear()
        _WORDS.clear()
        release()

    return rows.mapInArrow(run, "a long, b long")


def blocks(texts: Column, sizes: Column) -> Column:
    """Blocks for so many texts with so many shingles together."""
    return F.greatest(F.ceil(texts / BLOCK_TEXTS), F.ceil(sizes / BLOCK_SHINGLES)).cast("int")


def within_blocks(state: DataFrame) -> DataFrame:
    """Tiles of single blocks; the member of a bucket with the least hash is in all its blocks."""
    sizes = state.groupBy("bucket").agg(blocks(F.count("*"), F.sum("n")).alias("blocks"), F.min(F.struct(F.xxhash64("rep"), "rep")).alias("pivot"))
    rows = state.join(sizes, "bucket")
    own = F.array(F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("i", F.explode(F.when(F.col("rep") == F.col("pivot.rep"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
    return rows.select("bucket", "i", F.lit(0).alias("j"), "rep", "component", F.lit(True).alias("asks"), F.lit(True).alias("answers"))


def across_blocks(state: DataFrame) -> DataFrame:
    """Tiles in which each member outside its bucket's largest component meets all members; buckets of one component are left out."""
    parts = state.groupBy("bucket", "component").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    order = F.max(F.struct("texts", "n", "component"))
    sizes = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("texts").alias("texts"), F.sum("n").alias("all_n"), order.alias("m")).where("parts > 1")
    left = blocks(F.col("texts") - F.col("m.texts"), F.col("all_n") - F.col("m.n"))
    sizes = sizes.select("bucket", F.col("m.component").alias("largest"), left.alias("is"), blocks(F.col("texts"), F.col("all_n")).alias("js"))
    rows = state.join(sizes, "bucket").withColumn("asking", F.col("component") != F.col("largest"))
    mine = lambda n: F.pmod(F.xxhash64("rep", "bucket"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asked = F.transform(every("js"), lambda j: F.struct(mine("is").alias("i"), j.alias("j"), F.lit(True).alias("asks"), (j == mine("js")).alias("answers")))
    answering = F.transform(every("is"), lambda i: F.struct(i.alias("i"), mine("js").alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("answers")))
    tiles = F.when(F.col("asking"), F.concat(asked, F.filter(answering, lambda t: t["i"] != mine("is")))).otherwise(answering)
    return rows.select("bucket", "rep", "component", F.explode(tiles).alias("t")).select("bucket", "t.i", "t.j", "rep", "component", "t.asks", "t.answers")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of every row of docs."""
    ws = Workspace(docs.sparkSession, "neardup")
    rows = ws.save(measured(docs, doc_id, text, words, band_width(percent)), "measured")
    fit = F.col("key").isNotNull() & F.col("doc_id").isNotNull()
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    classes = rows.where(fit).groupBy("key").agg(one, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands", ignorenulls=True).alias("bands"))
    classes = ws.save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    # both the sizes of buckets and their members come from one exchange
    found = classes.select("rep", "n", F.explode("bands").alias("bucket")).repartition("bucket")
    sizes = found.groupBy("bucket").agg(F.count("*").alias("size"), *(F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"s{k}") for k in range(2))).where("size > 1")
    distinct = sizes.groupBy("size", "s0", "s1").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = ws.save(found.join(distinct, "bucket"), "members")
    labels = ws.save(members.select("rep", F.col("rep").alias("component")).distinct(), "labels")
    wanted = classes.join(labels.select("rep"), "rep").select("rep", "one.doc_id", "one.text_hash")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    texts = ws.save(texts.join(wanted, ["doc_id", "text_hash"]).select("rep", "text"), "texts")
    if texts.count() > labels.count():  # rows given twice
        texts = ws.save(texts.dropDuplicates(["rep"]), "texts-once")
    for name, share, tiles in (("first", FIRST_SHARE, within_blocks), ("second", 1, across_blocks)):
        state = members.where(F.pmod("bucket", F.lit(share)) == 0).join(labels, "rep")
        edges = ws.save(linked(tiles(state), texts, words, percent), f"edges-{name}")
        found = components(ws, edges, f"joined-{name}").select(F.col("id").alias("component"), F.col("component").alias("low"))
        labels = ws.save(labels.join(found, "component", "left").select("rep", F.coalesce("low", "component").alias("component")), f"labels-{name}")
    named = classes.select("key", "copies", "rep", F.col("one.doc_id").alias("first")).join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = ws.save(named.join(least, "component").select("key", "copies", "component_id"), "named")
    out = join_dealt(rows.where(fit).select("doc_id", "text_hash", "key", "n"), named, ["key"], "copies").select("doc_id", "text_hash", "n", "component_id")
    out = out.union(rows.where(~fit).select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")
