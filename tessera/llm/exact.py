"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

Texts are normalised (runs of ASCII white space become one space) and named by
their SHA-256. The first pass counts how many rows fall in each of a filter's
cells, some ``bits`` cells a row; a row that is alone in its cell has no equal.
The second pass does so with other cells for the rows that are left. Only rows
that share a cell in both passes are shuffled by their name, grouped and given
the group's first id; all others pass straight through.

Filters are bitmaps of cells that more than one row hit, sent to every task. One
has at most ``max_bits`` bits: where the rows need more, names are dealt by hash
into slices, each with filters of its own, so the size of what is sent is bounded
and filters stay as selective for any number of rows. Only names, ids and counts
are ever shuffled, never texts. A group of any size is combined before its
shuffle, and its rows meet its first id in parts of bounded size.

Null texts count as empty, and empty texts are equal to each other. Rows without
an id take part: they are dropped for a row with an id, and stay (keep_id null)
where no equal row has one. Rows that share id and text are one document given
twice and stay or go together; those that only share an id are judged by their
texts. Other columns, whatever their names, have no part in it. An empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_dealt

SPACE = r"[\x20\x09-\x0D]+"
BITS, MAX_BITS = 16, 1 << 29
BITMAP = 1 << 15


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def shared_cells(rows: DataFrame, cell: Column) -> DataFrame:
    """(bucket, bitmap) of the cells that more than one row falls in."""
    twice = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap"))


def in_cells(rows: DataFrame, cell: Column, cells: DataFrame, out: str) -> DataFrame:
    """rows with whether their cell is in the bitmaps, which are sent to every task."""
    met = rows.withColumn("__bucket", F.bitmap_bucket_number(cell)).join(F.broadcast(cells), F.col("__bucket") == F.col("bucket"), "left")
    place = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (place % 8).cast("int")) % 2
    return met.withColumn(out, F.coalesce(bit == 1, F.lit(False))).drop("__bucket", "bucket", "bitmap")


def marked(ws: Workspace, rows: DataFrame, bits: int, max_bits: int) -> DataFrame:
    """rows (doc_id, sha) with maybe: whether some other row may have the same sha."""
    slices = max(1, -(-rows.count() * bits // max_bits))
    for k in range(slices):
        own = rows.where(F.pmod(F.xxhash64(F.lit("slice"), "sha"), F.lit(slices)) == k)
        for name in ("first", "second"):
            n = own.count() if name == "first" else own.where("first").count()
            cell = F.pmod(F.xxhash64(F.lit(name), "sha"), F.lit(max(BITMAP, n * bits))) + 1
            cells = ws.save(shared_cells(own if name == "first" else own.where("first"), cell), f"{name}-{k}")
            own = in_cells(own, cell, cells, name)
        done = ws.save(own.select("doc_id", "sha", (F.col("first") & F.col("second")).alias("maybe")), f"marked/{k}")
    return ws.spark.read.schema(done.schema).option("recursiveFileLookup", "true").parquet(f"{ws.path}/marked")


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs."""
    ws = Workspace(docs.sparkSession, "exact")
    named = ws.save(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("sha")), "named")
    rows = marked(ws, named, bits, max_bits)
    some = rows.where("maybe").select("doc_id", "sha")
    groups = ws.save(some.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    grouped = join_dealt(some, groups, ["sha"], "group_size").select("doc_id", "sha", "keep_id", "group_size")
    alone = rows.where("not maybe").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return alone.union(grouped).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, as they are."""
    gone = duplicates(docs, doc_id, text).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    same = (F.sha2(normalised(F.col(text)), 256) == F.col("__sha")) & F.col(doc_id).cast("long").eqNullSafe(F.col("__id"))
    return docs.join(gone, same, "left_anti")
