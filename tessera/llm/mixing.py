"""Mixing sources to target weights along a time-varying curriculum.

Shares: sources in code point order, null last, have recurring weights and share
``budget`` times all words; a source's target is at most ``cap`` times its words
and what it cannot take is reshared by weight (the level at which weights times
level, cut at the caps, make the total; found by one pass over sorted sources).

Copies: a document is taken as often as its source's target holds the whole
source, and once more while the rest of the target lasts, in an order given by
the hash of its id; the last one is taken if at least half of it fits. Running
sums are split by the hash's first three digits, so that a source of any size
is summed by many tasks.

Curriculum: a source's weight over training time is piecewise linear with mean
one. Its integral times the target is the source's cumulative demand for
tokens; the position of a copy inverts that demand at the middle of the copy in
the source's stream. ``schedule`` gives a row per copy, range-sorted by position.

A null or empty text has size 0 and is never taken. Rows without an id come in
one place of the order. Repeated rows are each taken alike or, where the target
ends between them, one more often. An empty table gives an empty one. Other
columns are kept; columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

WEIGHTS = (3.0, 1.0, 2.0)
#: Knots (time, weight) of the schedules that sources take in turn: steady, fading, growing.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: So many sources at most are sent to every executor; more are joined.
BROADCAST_SOURCES = 10_000
DIGITS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, turn) of every source; sized has source and size."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = rows.withColumn("turn", F.row_number().over(order) - 1)
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") % len(weights) + 1))
    rows = rows.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    by_ratio = Window.orderBy("ratio", "turn")
    before, on = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("w").over(on))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("turn"), F.col("level")))).over(everything)["level"]
    rows = rows.withColumn("target", F.least("most", F.coalesce(level, F.lit(float("inf"))) * F.col("w")))
    return rows.select("source", "source_size", "target", "turn")


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, ...]]:
    """(start time, start weight, slope, demand before, demand after) of each piece, scaled to a demand of one in all."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        after = done + (t1 - t0) * (w0 + w1) / 2 / area
        out.append((t0, w0 / area, (w1 - w0) / (t1 - t0) / area, done, after))
        done = after
    return out


def position(turn: Column, share: Column, schedules: Sequence = SCHEDULES) -> Column:
    """Training time in 0..1 at which the source's cumulative demand has the given share."""
    out = None
    for k, knots in enumerate(schedules):
        pieces = segments(knots)
        value = None
        for t0, w0, slope, before, _ in pieces:
            d = share - before
            t = t0 + 2 * d / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * d, F.lit(0.0))))
            value = t if value is None else F.when(share < before, value).otherwise(t)
        here = turn % len(schedules) == k
        out = F.when(here, value) if out is None else out.when(here, value)
    return out


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, budget: float = 1.5, cap: float = 2.0, schedules: Sequence = SCHEDULES, measured: bool = False) -> DataFrame:
    """docs with size, source_size, target, copies, taken and positions (an array with the position of each copy).

    measured: docs has the column size already.
    """
    rows = docs if measured else docs.withColumn("size", size_of(F.col(text)))
    shares = targets(rows.select(F.col(source).alias("source"), "size"), weights, budget, cap).select(F.col("source").alias("__source"), "source_size", "target", F.col("turn").alias("__turn"))
    few = len(shares.limit(BROADCAST_SOURCES + 1).select("__turn").collect()) <= BROADCAST_SOURCES
    rows = rows.drop("source_size", "target", "copies", "taken", "positions").join(F.broadcast(shares) if few else shares, F.col(source).eqNullSafe(F.col("__source")))
    rows = rows.drop("__source").withColumn("__h", F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))).withColumn("__b", F.substring("__h", 1, DIGITS))
    parts = rows.groupBy("__turn", "__b").agg(F.sum("size").alias("__part"))
    so_far = Window.partitionBy("__turn").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__turn", "__b", F.coalesce(F.sum("__part").over(so_far), F.lit(0)).alias("__base"))
    rows = rows.join(parts, ["__turn", "__b"])
    inside = Window.partitionBy("__turn", "__b").orderBy("__h", F.col(doc_id)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.col("__base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rows = rows.withColumn("__whole", whole)
    extra = F.col("__before") + F.col("size") / 2 <= F.col("target") - F.col("__whole") * F.col("source_size")
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("__whole") + extra.cast("int")).otherwise(0))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size"))
    middle = F.col("__before") + F.col("size") / 2
    share = lambda j: F.least(F.lit(1.0), ((j - 1) * F.col("source_size") + middle) / F.col("target"))
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("positions", F.transform(copies, lambda j: position(F.col("__turn"), share(j), schedules)))
    return rows.drop("__turn", "__b", "__h", "__base", "__before", "__whole")


def schedule(planned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """A row for each copy, in training order: range-partitioned and sorted by position, then id."""
    return planned.withColumn("position", F.explode("positions")).orderBy("position", doc_id)
