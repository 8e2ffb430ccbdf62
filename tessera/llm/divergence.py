"""Audit of sources: how far each source's use of words lies from other sources' and from its language's.

Texts are cut by bytes: a lookup table over the concatenated UTF-8 of a slice of
texts marks letters, and a boundary is where a mark begins or ends or a text
does. Equal slices are grouped by xxhash and compared byte for byte with the
first of their group; where a hash names different bytes, that slice of texts is
grouped by the bytes themselves. A task gives counts for each language, source
and term of a slice, which meet once, by language and term: occurrences by
source, and in how many documents of the language the term is.

A language's kept terms are those in at least ``least_docs`` of its documents.
Smoothed shares are exact integers (``share``). For sums over all terms, terms
are dealt into blocks and a language's sources too; a task holds the terms of one
block and the sources of two as compressed sparse rows, takes each source's
shares against all rows of the tile at once and sums row by row (reduceat). No
task holds more than ``terms`` terms of 2 * ``sources`` sources, whatever the
numbers are; partial sums are added exactly.

Null texts, languages and sources count as ''. A source without terms has the
share of a term that does not occur; a language without kept terms gives sums of
0. Rows given twice count twice, and ids have no part in it. Other columns are not
read, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, few, map_slices

LEAST_DOCS, SMOOTHING, UNIT, RANKS = 30, 5, 1_000_000_000, 50
TERMS, SOURCES = 4096, 128

_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
LETTER = _UPPER | (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of texts that lie one after the other, text k from offsets[k] to offsets[k + 1]."""
    letter = LETTER[data]
    before, after = np.zeros_like(letter), np.zeros_like(letter)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct slices of data, and which of them each slice is."""
    raw = data.tobytes()
    spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(raw[a:b]) for a, b in spans), np.uint64, len(spans))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    same = size == size[first][group]
    if same.all():  # then bytes can be held against bytes
        ahead = (starts[first][group] - starts).astype(np.int32)
        here = np.flatnonzero(np.repeat(ahead != 0, size))
        at = np.arange(size.sum(), dtype=np.int32) + np.repeat((starts - np.cumsum(size) + size).astype(np.int32), size)
        at, there = at[here], (at + np.repeat(ahead, size))[here]
        same = data[at] == data[there]
    if same.all():
        return [raw[starts[i] : ends[i]] for i in first.tolist()], group
    names: dict[bytes, int] = {}
    group = np.fromiter((names.setdefault(raw[a:b], len(names)) for a, b in spans), np.int64, len(spans))
    return list(names), group


def counted(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs) of slices of texts: occurrences, and documents with one."""

    def step():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            body = column.buffers()[2]
            data = LOWER[np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]] if body is not None else np.zeros(0, np.uint8)
            offsets = offsets - offsets[0]
            starts, ends = boundaries(data, offsets)
            names, term = grouped(data, starts, ends)
            labels = pd.MultiIndex.from_arrays([batch.column(0).to_pandas(), batch.column(1).to_pandas()])
            of, labels = pd.factorize(labels)
            many = max(1, len(names))
            # (document, term), then (language and source, term)
            pair, n = np.unique((np.searchsorted(offsets, starts, "right") - 1) * many + term, return_counts=True)
            key, at = np.unique(of[pair // many] * many + pair % many, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, n)
            group, term = key // many, key % many
            word = pa.array(names, pa.binary()).take(pa.array(term)).cast(pa.string())
            own = [pa.array([x[k] for x in labels], pa.string()).take(pa.array(group)) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*own, word, pa.array(total), pa.array(np.bincount(at, minlength=len(key)))], ["lang", "source", "term", "n", "docs"])

        return run

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (lang, source, text)]
    return map_slices(docs, columns, step, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly."""
    wide = lambda c: c.cast("decimal(18,0)")
    parts = (wide(count + SMOOTHING) * F.lit(UNIT).cast("decimal(10,0)"), wide(F.greatest(total + SMOOTHING * terms, F.lit(1))))
    return 1 + F.call_function("div", *parts)


def distances(tile: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """(a, b, value) of the pairs of a tile: the sum over its terms of the differences of shares.

    tile has source, blank (share of a term that does not occur), side (0, 1, or 2 for both); rows has source, term and p.
    A term of the tile that no source of it has is left to the caller: value is lessened by the difference of the blanks for each term.
    """
    sources = tile["source"].to_numpy()
    blank, side = tile["blank"].to_numpy(np.int64), tile["side"].to_numpy()
    row = pd.Index(sources).get_indexer(rows["source"])
    column, terms = pd.factorize(rows["term"])
    order = np.lexsort((column, row))
    row, column, p = row[order], column[order], rows["p"].to_numpy(np.int64)[order]
    start = np.searchsorted(row, np.arange(len(sources) + 1))
    full = np.flatnonzero(np.diff(start))

    def by_row(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sources), np.int64)
        if len(full):
            out[full] = np.add.reduceat(values, start[full])
        return out

    found = []
    for i in range(len(sources)):
        mine = np.full(len(terms), blank[i], np.int64)
        mine[column[start[i] : start[i + 1]]] = p[start[i] : start[i + 1]]
        here, theirs = mine[column], np.repeat(blank, np.diff(start))
        # where a row has a term, its share counts and not its blank
        value = by_row(np.abs(here - p) - np.abs(here - theirs)) - len(terms) * np.abs(blank[i] - blank)
        ordered = np.sort(mine)
        below = np.concatenate([[0], np.cumsum(ordered)])
        k = np.searchsorted(ordered, blank)
        value += blank * (2 * k - len(terms)) + below[-1] - 2 * below[k]
        others = (sources > sources[i]) if side[i] == 2 else (side == 1) if side[i] == 0 else np.zeros(len(sources), bool)
        found.append(pd.DataFrame({"a": sources[i], "b": sources[others], "value": value[others]}))
    return pd.concat(found)


def pairs(ws: Workspace, groups: DataFrame, counts: DataFrame, terms: int, sources: int) -> DataFrame:
    """(lang, a, b, value) for every two sources of a language, a before b."""
    ceil = lambda n, d: F.greatest(F.lit(1), F.ceil(n / d)).cast("int")
    dealt = lambda c, n: F.pmod(F.xxhash64(F.lit("block"), c), n).cast("int")
    number = groups.groupBy("lang").agg(F.count("*").alias("__s"))
    own = groups.join(few(number), "lang").select("*", ceil(F.col("__s"), sources).alias("ss"), ceil(F.col("v"), terms).alias("ts"))
    own = own.withColumn("block", dealt("source", F.col("ss"))).withColumn("other", F.explode(F.expr("sequence(0, ss - 1)")))
    own = own.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    blank = share(F.lit(0), F.col("total"), F.col("v"))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("block") == F.col("i"), 0).otherwise(1)
    own = ws.save(own.select("lang", "source", "i", "j", "ts", "v", blank.alias("blank"), side.alias("side")), "tiles")
    rows = counts.join(few(own.select("lang", "source", "ts", "i", "j")), ["lang", "source"])
    rows = rows.select("lang", "source", "term", "p", "i", "j", dealt("term", F.col("ts")).alias("t"))
    rows = rows.select(*(F.col(c).alias(c) for c in rows.columns))  # other columns than those of own
    tiles = own.withColumn("t", F.explode(F.expr("sequence(0, ts - 1)")))
    at = ["lang", "i", "j", "t"]

    def run(tile: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = distances(tile, rows)
        if tile["t"].iloc[0] == 0:  # all terms of the language, once
            blank = dict(zip(tile["source"], tile["blank"].astype(int), strict=True))
            out["value"] += int(tile["v"].iloc[0]) * np.abs(out["a"].map(blank) - out["b"].map(blank)).astype(np.int64)
        return out.assign(lang=tile["lang"].iloc[0])[["lang", "a", "b", "value"]]

    found = tiles.groupBy(*at).cogroup(rows.groupBy(*at)).applyInPandas(run, "lang string, a string, b string, value long")
    found = found.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, ranks: int = RANKS, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to each other source, and the terms that a source uses most above its language."""
    ws = Workspace(docs.sparkSession, "divergence")
    # one exchange: sums by source and sums by language both lie with the term
    met = counted(docs, lang, source, text).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    met = met.select("*", F.sum("docs").over(term).alias("__docs"), F.sum("n").over(term).alias("together"), F.row_number().over(term.orderBy("source")).alias("__first"))
    counts = ws.save(met.where(F.col("__docs") >= least_docs).select("lang", "source", "term", "n", "together", "__first"), "counts")
    labels = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source")))).distinct()
    by_lang = counts.groupBy("lang").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("__first") == 1, 1).otherwise(0)).alias("v"))
    groups = labels.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(few(by_lang), "lang", "left").na.fill(0)
    groups = ws.save(groups, "groups")
    shared = counts.join(few(groups), ["lang", "source"])
    shared = shared.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("together"), F.col("all"), F.col("v")).alias("q"))
    found = ws.save(pairs(ws, groups, shared.select("lang", "source", "term", "p"), terms, sources), "pairs")
    both = found.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(found.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    above = shared.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    out = ranked(both).withColumn("part", F.lit("pair")).unionByName(ranked(above).where(F.col("rank") <= ranks).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
