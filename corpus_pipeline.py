"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Language identification rejects documents without letters and those that no
learned language fits, and names the language of the others; line dedup removes
repeated passages and documents of which nothing is left; near-dedup keeps one
document of each group; mixing repeats and orders documents by the curriculum;
the last stage encodes what is left, decodes it again and keeps both.

Null texts, and empty ones and those without letters, go in the first stage.
Rows without an id are documents of their own, alike only to rows with the same
text. A row given twice stays once after near-dedup; a row that merely shares its
id with a removed one stays. Of equally near documents the one with the smallest
id stays, null ids last. Null languages are not learned from, and null sources
are one source, the last. Texts are read whole, of any length. Columns beyond
those of documents pass through all stages but the last, whatever their names.
An empty table gives an empty one.
"""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, lines, mixing, neardup
from tessera.llm.common import Workspace, table
from tessera.llm.queries import tokenizer_path


#: Characters that a text's phrases must have on average in the language that fits best, if it is written in letters that no learned text has.
LEAST_PHRASE = 1.5
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Georgian", "Hebrew", "Arabic", "Devanagari", "Bengali", "Tamil", "Thai", "Hangul", "Hiragana", "Katakana", "Han")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with lang the identified one. Learned from the labels of those not held out; where there are none, all with a letter stay as they are.

    A document is in none if most of its letters are of scripts that no learned text has, and its phrases are short.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    if not model.langs:
        return docs.where(langid.has_letter("text"))
    found = langid.predict(docs, model, lang="__lang", score="__score").where(F.col("__lang") != langid.UND)
    strange = [s for s in SCRIPTS if not any(regex.search(rf"\p{{{s}}}", t) for t in model.texts)]
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    foreign = F.regexp_count("text", F.lit("[" + "".join(rf"\p{{Is{s}}}" for s in strange) + "]")) if strange else F.lit(0)
    found = found.where((F.col("__score") >= 1 - 1 / LEAST_PHRASE) | (2 * foreign <= letters))
    return found.withColumn("lang", F.col("__lang")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated three-line windows; those of which no word is left go."""
    out = lines.dedup(docs)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, or any if there is none."""
    key = ["__row", "__text"]  # two hashes: one alone may be that of another row
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text")).withColumn("__text", F.xxhash64("text"))
    if rows.groupBy(*key).count().where("count > 1").limit(1).count():
        rows = Workspace(spark, "rows").save(rows.dropDuplicates(key), "rows")  # some rows are given twice
    found = neardup.near_duplicates(rows.select("__row", "text"), doc_id="__row").select(F.col("doc_id").alias("__row"), F.col("text_hash").alias("__text"), "component_id")
    found = Workspace(spark, "groups").save(found.join(rows.select(*key, F.col("doc_id").alias("id")), key), "groups")
    first = found.groupBy("component_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull(), "id", *key)).alias("m")).where("n > 1")
    gone = found.join(first, "component_id").where((F.col("__row") != F.col("m.__row")) | (F.col("__text") != F.col("m.__text"))).select(*key)
    return rows.join(gone, key, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, a row for each copy, in training order."""
    return mixing.schedule(mixing.plan(docs)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoded text, in training order."""
    return bpe.round_trip(docs, tokenizer_path(spark)).select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language_id", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("bpe", tokens)]

#: BPE and language identification have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.save(docs, name)
    return docs
