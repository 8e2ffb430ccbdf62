"""Shared helpers: reading tables, written intermediate tables, Arrow batches of bounded size, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: UTF-8 bytes of text that a Python step takes in hand at a time, whatever Arrow's batches hold.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if its input has fewer splits than cores; large inputs stay where they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of about SLICE_BYTES of a text or binary column; a longer value is a run of its own."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield start, i - start
            start, held = i, 0
        held += int(n)
    if start < len(column):
        yield start, len(column) - start


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows by one text or binary column."""
    for start, n in cut(batch.column(column)):
        yield batch.slice(start, n)


def parts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Text or binary arrays in runs of values, so that what a function makes of them is given on before the next run is read."""
    for column in columns:
        for start, n in cut(column):
            yield column.slice(start, n)


def release() -> None:
    """Gives back what a task has freed: a worker that waits for its next task, or another kind of task, should hold no memory of the last."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_slices(df: DataFrame, columns: list, step: Callable, schema: str) -> DataFrame:
    """mapInArrow over the selected columns, of which the last is the long one; step makes a RecordBatch of each slice.

    step is made once a task by calling the given factory on the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = step()
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                out = f(part)
                if out.num_rows:
                    yield out
        del f
        release()

    return df.select(*columns).mapInArrow(run, schema)


#: Rows up to which a table of groups is sent to every task; more are joined.
FEW_ROWS = 10_000


def few(df: DataFrame) -> DataFrame:
    """df, to be sent to every task if it has at most FEW_ROWS rows, which are counted."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


#: A join sends fewer keys than this to every task, those that more than one in so many of its rows have.
HOT_KEYS = 2000
#: Rows of one key below which a join does not deal them out.
HOT_ROWS = 10_000


def join_dealt(rows: DataFrame, keyed: DataFrame, on: list[str], count: str) -> DataFrame:
    """Inner join of rows to keyed, which has one row for each key and in count how many rows meet it.

    The rows of a key with a large share of all are dealt by hash into parts of
    one size, each of which meets a copy of keyed's row, so that no task holds a
    key. keyed is read three times and should be a written table.
    """
    each = max(HOT_ROWS, (keyed.agg(F.sum(count)).first()[0] or 0) // HOT_KEYS)
    parts_of = F.ceil(F.col(count) / each).cast("int")
    hot = keyed.where(F.col(count) > each).select(*on, parts_of.alias("__parts"))
    dealt = rows.withColumn("__hash", F.xxhash64(*rows.columns)).join(F.broadcast(hot), on, "left")
    dealt = dealt.withColumn("__part", F.pmod("__hash", F.coalesce("__parts", F.lit(1))).cast("int")).drop("__hash", "__parts")
    last = F.when(F.col(count) > each, parts_of - 1).otherwise(0)
    return dealt.join(keyed.withColumn("__part", F.explode(F.sequence(F.lit(0), last))), [*on, "__part"]).drop("__part")


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id reachable.

    Labels start at an id's smallest neighbour or itself; every round takes the
    smallest label among neighbours and then that label's own label (pointer
    jump), so a chain of n links needs about log n rounds. Each round is
    written. Reductions are minima, so a centre with very many links is combined
    before it is shuffled, and its join is left to adaptive skew splitting.
    """
    both = ws.save(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), f"{name}-both")
    labels = ws.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    for k in range(1, 200):
        # edges between labels, so that whole groups move at once
        to = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(to, "id").select("id", "component", F.least("component", "near").alias("low"))
        hook = hooked.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("to"))
        new = hooked.join(hook, F.col("low") == F.col("root"), "left").select("id", F.least("low", F.coalesce("to", "low")).alias("new"), F.col("component").alias("old"))
        new = ws.save(new, f"{name}-{k}")
        changed = new.where("new <> old").limit(1).count()
        ws.drop(f"{name}-{k - 1}")
        labels = new.select("id", F.col("new").alias("component"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


__all__ = ["SLICE_BYTES", "WORD", "Workspace", "components", "few", "join_dealt", "map_slices", "parts", "release", "slices", "spread", "table"]
