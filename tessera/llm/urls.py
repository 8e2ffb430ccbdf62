"""URL filtering by rules and lists that are held in Bloom filter cascades.

A cascade encodes a set of listed keys within a known universe. Level 0 is a
Bloom filter of the listed keys; level 1 one of the keys of the universe that
level 0 lets through wrongly; level 2 one of the listed keys that level 1 lets
through wrongly, and so on until nothing passes wrongly. A key's first failing
level then tells exactly whether it is listed, without a join.

The universe of a corpus are all keys that its URLs could match: every parent
domain of a host, of as many labels as a listed one has, with every prefix of
the path that has the length of some rule's path. It is read once to be counted
and once to find what the first levels of all sets let through; later levels
work on those few keys. A level of few keys is made of their hashes on the
driver, others by aggregating 64-bit words, which reach the driver in packed
batches. Their size is checked against ``max_bits`` before they are sent to
executors: the filters grow with the listed keys, not with the corpus.

A null URL, or one without ``://``, has an empty host and path; no rule with a
host fits it and it is allowed. A URL of any length, and a host of any number of
labels, takes memory in proportion to its length. A rule listed twice counts
once; if it is listed as allow and block, allow wins. Repeated rows are each
judged alike. An empty table gives an empty one. Other columns are kept; columns
named like the outputs are replaced.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Filters of all levels of a set together, or of a part of a longer list; 256 MB.
MAX_BITS = 1 << 31
#: The most bits that a listed key takes in all levels, however many keys there are to tell it from.
KEY_BITS = 64
#: Keys of a level up to which their hashes are fetched at once and the level is made of them without a job of its own.
FEW_KEYS = 10_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def labels_of(key: Column) -> Column:
    """Number of labels of a listed key's host."""
    return F.size(F.split(F.substring_index(key, "/", 1), r"\."))


def candidates(host: Column, path: Column, lengths: Sequence[int], most: int) -> Column:
    """Array of (key, n_host): each parent domain of the host of at most so many labels with the path's prefix of each length that the path has."""
    domains = F.array(*(F.substring_index(host, ".", -n) for n in range(1, most + 1)))
    # a host of fewer labels is its own longest domain
    domains = F.array_distinct(domains)
    usable = F.filter(F.array(*map(F.lit, lengths)), lambda n: F.char_length(path) >= n)
    return F.flatten(F.transform(domains, lambda d: F.transform(usable, lambda n: F.struct(F.concat(d, F.substring(path, F.lit(1), n)).alias("key"), F.char_length(d).alias("n_host")))))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(F.lit("second"), key)]


@dataclass
class Level:
    """A Bloom filter; level numbers give levels independent hash functions."""

    number: int
    bits: int
    probes: int
    words: np.ndarray

    def places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            seed = (h1 ^ np.uint64(0x9E3779B97F4A7C15 * (self.number + 1) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
            step = (h2 + np.uint64(self.number)) * np.uint64(0xC4CEB9FE1A85EC53) | np.uint64(1)
            for i in range(self.probes):
                x = seed + step * np.uint64(i)
                x ^= x >> np.uint64(33)
                yield x % np.uint64(self.bits)

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for at in self.places(h1, h2):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


@dataclass
class Cascade:
    levels: list[Level]

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe and listed keys."""
        inside = np.zeros(len(h1), bool)
        left = np.arange(len(h1))
        for level in self.levels:
            left = left[level.passes(h1[left], h2[left])]
            inside[left] = level.number % 2 == 0
            # those that fail an odd level keep True from the level before; those that fail an even one keep False
        return inside


def as_uint(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


Hashes = tuple[np.ndarray, np.ndarray]


def make_level(keys: DataFrame | Hashes, n: int, number: int, rate: float, max_bits: int) -> Level:
    """Filter of the keys (h1, h2); of a DataFrame each task gives the words it has set, which are combined by OR."""
    bits = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2)))
    if bits > max_bits:
        raise ValueError(f"a filter of {n} listed keys needs {bits} bits, over max_bits={max_bits}")
    level = Level(number, bits, max(1, round(bits / n * math.log(2))), np.zeros(0, np.uint64))

    def set_in(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate(list(level.places(h1, h2)))
        word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
        value = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(value, inverse, np.uint64(1) << (at & np.uint64(63)))
        return word.astype(np.int64), value

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, value = set_in(as_uint(b.column(0)), as_uint(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in b.columns], ["words", "bits"])

    words = np.zeros((bits + 63) // 64, np.uint64)
    if isinstance(keys, tuple):
        at, value = set_in(*keys)
        words[at] = value
    else:
        set_words = keys.select("h1", "h2").mapInArrow(places, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
        for at, value in set_words.mapInArrow(packed, "words binary, bits binary").toLocalIterator():
            words[np.frombuffer(at, np.int64)] = np.frombuffer(value, np.uint64)
    level.words = words
    return level


def passing(keys: DataFrame | Hashes, level: Level) -> DataFrame | Hashes:
    if isinstance(keys, tuple):
        found = level.passes(*keys)
        return keys[0][found], keys[1][found]

    @arrow_udf("boolean")
    def test(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(level.passes(as_uint(h1), as_uint(h2)))

    return keys.where(test("h1", "h2"))


def flags(cascade: Cascade | Level, keys: Column) -> Column:
    """Array of booleans for an array of (h1, h2)."""

    @arrow_udf("array<boolean>")
    def test(h1: pa.Array, h2: pa.Array) -> pa.Array:
        ask = cascade.listed if isinstance(cascade, Cascade) else cascade.passes
        found = ask(as_uint(h1.flatten()), as_uint(h2.flatten()))
        sizes = pc.list_value_length(h1).fill_null(0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(found))

    return test(F.transform(keys, lambda k: hashes(k["key"])[0]), F.transform(keys, lambda k: hashes(k["key"])[1]))


def by_name(rows: DataFrame) -> dict[str, tuple[int, DataFrame | Hashes]]:
    """Of a written table (name, h1, h2): how many rows each name has, and the rows, those of names with few of them fetched at once."""
    sizes = {r.name: r.n for r in rows.groupBy("name").agg(F.count("*").alias("n")).collect()}
    few, held = [], 0
    for name, n in sorted(sizes.items(), key=lambda x: x[1]):
        held += n
        few += [name] if held <= FEW_KEYS else []
    fetched: dict[str, list] = {name: [] for name in few}
    if few:
        for r in rows.where(F.col("name").isin(few)).select("name", "h1", "h2").collect():
            fetched[r.name].append((r.h1, r.h2))
    arrays = {name: np.array(v, np.int64).view(np.uint64) for name, v in fetched.items()}
    return {name: (n, (arrays[name][:, 0].copy(), arrays[name][:, 1].copy()) if name in arrays else rows.where(F.col("name") == name)) for name, n in sizes.items()}


def build(ws: Workspace, urls: DataFrame, keys: Column, sets: dict[str, DataFrame], max_bits: int = MAX_BITS) -> dict[str, Cascade]:
    """A cascade for each set of listed keys (a DataFrame with column key), exact over the candidate keys of all urls.

    All sets are written, counted and met with the urls together; a job for one
    set's level alone is needed only beyond FEW_KEYS keys.
    """
    named = [rows.select(F.lit(name).alias("name"), "key") for name, rows in sets.items()]
    h1, h2 = hashes(F.col("key"))
    listed = functools.reduce(DataFrame.union, named).where("key is not null").distinct().select("name", "key", h1.alias("h1"), h2.alias("h2"))
    listed = ws.save(listed, "listed")
    held = by_name(listed)
    out = {name: Cascade([]) for name in sets}
    if not held:
        return out
    universe = max(1, urls.select(F.explode(keys).alias("k")).agg(F.approx_count_distinct("k.key")).first()[0])
    first = {name: make_level(rows, n, 0, min(0.5, n * math.sqrt(0.5) / universe), max_bits) for name, (n, rows) in held.items()}
    tested = urls.withColumn("c", keys)
    for k, level in enumerate(first.values()):  # the first levels of all sets meet the urls in one scan
        tested = tested.withColumn(f"f{k}", flags(level, F.col("c")))

    def passing_keys(name: str, flag: str) -> Column:
        return F.transform(F.filter(F.arrays_zip("c", flag), lambda x: x[flag]), lambda x: F.struct(F.lit(name).alias("name"), x["c"]["key"].alias("key")))

    passed = [passing_keys(name, f"f{k}") for k, name in enumerate(first)]
    passed = tested.select(F.explode(F.concat(*passed)).alias("x")).select("x.*").distinct()
    wrong = passed.join(listed, ["name", "key"], "left_anti").select("name", h1.alias("h1"), h2.alias("h2"))
    passed_wrongly = by_name(ws.save(wrong, "wrong"))
    for name, level in first.items():
        n, inner = passed_wrongly.get(name, (0, None))
        outer, levels = held[name][1], [level]
        while n:
            if len(levels) > 60:
                raise RuntimeError("the cascade does not end")
            level = make_level(inner, n, len(levels), 0.5, max_bits - sum(x.bits for x in levels))
            levels.append(level)
            # what the new level lets through of the other side is encoded next
            inner, outer = passing(outer, level), inner
            if isinstance(inner, DataFrame):
                inner = ws.save(inner, f"{name}-{len(levels)}")
                n, inner = by_name(inner).get(name, (0, inner))
            else:
                n = len(inner[0])
        out[name] = Cascade(levels)
    return out


def judge(spark: SparkSession, df: DataFrame, rules: Sequence[tuple[str, str, str]], blocked: DataFrame | None = None, url: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """df with host, path, rule and verdict.

    rules are (action, host, path) with a path that is empty or starts with
    ``/``; the longest rule that fits decides, of two equally long ones that
    with the longer host. blocked has domains (column key) that are blocked with
    their subdomains where no rule fits. All other URLs are allowed.
    """
    ws = Workspace(spark, "urls")
    lengths = sorted({0, *(len(p) for _, _, p in rules)})
    parts = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    listed = {a: sorted({h + p for b, h, p in rules if a == b}) for a in ("allow", "block")}
    sets = {a: spark.createDataFrame([(k,) for k in v], "key string") for a, v in listed.items()}
    sets["domain"] = blocked if blocked is not None else spark.createDataFrame([], "key string")
    size, longest = sets["domain"].agg(F.count("*"), F.max(labels_of(F.col("key")))).first()
    longest = max([1, longest or 1, *(h.count(".") + 1 for _, h, _ in rules)])
    keys = candidates(F.col("host"), F.col("path"), lengths, longest)
    # a list too long for filters of max_bits is dealt by hash into several, each with a pass of its own
    many = max(1, -(-size * KEY_BITS // max_bits))
    dealt = F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(many))
    out, domains = parts.withColumn("__keys", keys), sets["domain"]
    for k in range(many):
        cascades = build(ws if not k else Workspace(spark, "urls"), parts.select("host", "path"), keys, (sets if not k else {}) | {"domain": domains.where(dealt == k)}, max_bits)
        before = out
        for name, cascade in cascades.items():
            out = out.withColumn("__now", flags(cascade, F.col("__keys")))
            both = F.zip_with(f"__{name}", "__now", lambda a, b: a | b) if f"__{name}" in before.columns else F.col("__now")
            out = out.withColumn(f"__{name}", both).drop("__now")
        out = ws.save(out, f"judged-{k}") if many > 1 else out

    def hits(action: str) -> Column:
        flag = f"__{action}"
        return F.transform(
            F.filter(F.arrays_zip("__keys", flag), lambda x: x[flag]),
            lambda x: F.struct(F.char_length(x["__keys"]["key"]).alias("n"), x["__keys"]["n_host"].alias("h"), F.lit(action == "allow").alias("allow"), x["__keys"]["key"].alias("key")),
        )

    best = F.array_max(F.concat(hits("allow"), hits("block")))
    # a domain is a candidate with an empty path prefix
    domain = F.exists(F.arrays_zip("__keys", "__domain"), lambda x: x["__domain"] & (F.char_length(x["__keys"]["key"]) == x["__keys"]["n_host"]))
    out = out.withColumn("__best", best).withColumn("rule", F.col("__best.key"))
    out = out.withColumn("verdict", F.when(F.when(F.col("__best").isNotNull(), ~F.col("__best.allow")).otherwise(domain), "block").otherwise("allow"))
    return out.drop("__keys", "__best", *(f"__{n}" for n in sets))
