"""Removing repeated passages by overlapping windows of three lines.

Every run of three consecutive lines is hashed (128 bits). Windows that occur
more than once in the corpus keep their first occurrence, by document id and
position; later ones cover their three lines, and all covered lines of a
document go at once. Only hashes and positions are shuffled to find repeats;
windows of a frequent hash are counted before the shuffle and met in a join that
deals them into parts of bounded size.

Lines are what line feeds separate, compared exactly. A text of fewer than
three lines has no window and stays. Null texts stay null; empty ones stay
empty. Windows of blank lines are windows like others. Rows that share id and text
are one document given twice and treated alike; rows that share only their id are
documents of their own, in an order given by their texts; rows without an id stay
as they are, and their windows are not compared. An empty table gives an empty one.
Other columns are kept; columns named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_dealt

SIZE = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def text_key(text: str) -> Column:
    """What tells rows with one id apart."""
    return F.xxhash64(F.col(text))


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, start, h1, h2) of every window; start counts lines from 0."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), text_key(text).alias("key"), lines_of(F.col(text)).alias("lines"))
    rows = rows.where(F.size("lines") >= SIZE)
    starts = F.sequence(F.lit(1), F.size("lines") - (SIZE - 1))
    cut = F.transform(starts, lambda i: F.struct((i - 1).alias("start"), *(F.element_at("lines", i + k).alias(f"l{k}") for k in range(SIZE))))
    parts = [f"w.l{k}" for k in range(SIZE)]
    found = rows.select("id", "key", F.explode(cut).alias("w"))
    return found.select("id", "key", F.col("w.start").alias("start"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))


def later_occurrences(ws: Workspace, found: DataFrame) -> DataFrame:
    """(id, key, starts): the windows of each document that occurred earlier."""
    seen = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "start")).alias("first")).where("n > 1")
    late = join_dealt(found, ws.save(seen, "seen"), ["h1", "h2"], "n").where(F.struct("id", "key", "start") > F.col("first"))
    return late.groupBy("id", "key").agg(F.collect_set("start").alias("starts"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text that is left, n_lines and n_removed."""
    ws = Workspace(docs.sparkSession, "lines")
    late = later_occurrences(ws, windows(docs, doc_id, text)).toDF("__late_id", "__late_key", "__starts")
    out = docs.drop("n_lines", "n_removed").withColumn("__key", text_key(text)).withColumn("__lines", lines_of(F.col(text)))
    out = out.join(late, (F.col(doc_id) == F.col("__late_id")) & (F.col("__key") == F.col("__late_key")), "left")
    covered = F.flatten(F.transform("__starts", lambda s: F.sequence(s, s + (SIZE - 1))))
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("long"))
    out = out.withColumn("__left", F.when(F.col("__starts").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), covered)))
    kept = F.array_join(F.transform("__left", lambda i: F.get("__lines", i)), "\n")
    out = out.withColumn(text, F.when(F.col("__left").isNull(), F.col(text)).otherwise(kept))
    out = out.withColumn("n_removed", F.when(F.col("__left").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("__left")).cast("long"))
    return out.drop("__late_id", "__late_key", "__key", "__starts", "__lines", "__left")
