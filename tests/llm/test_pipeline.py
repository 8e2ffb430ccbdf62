"""The pipeline's stages against plain versions of their rules."""

import corpus_pipeline as pipeline
from test_dedup_operators import brute_groups, shingle_sets

from pyspark.sql import functions as F

from tessera.llm import bpe, langid, mixing
from tessera.llm.queries import tokenizer_path


def plain_lines(rows):
    seen, out = set(), []
    for i, text in sorted(rows):
        part = text.split("\n")
        gone = set()
        for k in range(len(part) - 2):
            w = tuple(part[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        left = "\n".join(x for k, x in enumerate(part) if k not in gone)
        if not gone or left.split():
            out.append((i, left))
    return out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, "en", "src0", 0), (900_002, "12 34", "en", "src0", 5), (900_003, "", None, None, 0)], docs.schema)
    docs = docs.union(extra)
    columns = docs.columns
    (_, language), (_, line), (_, near), (_, mix), (_, tokens) = pipeline.STAGES

    one = language(spark, docs, sf)
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == columns and kept == {r.doc_id for r in docs.collect() if r.doc_id < 900_000}
    two = line(spark, one, sf)
    assert two.columns == columns
    assert sorted((r.doc_id, r.text) for r in two.collect()) == sorted(plain_lines([(r.doc_id, r.text) for r in one.collect()]))
    three = near(spark, two, sf)
    rows = [(r.doc_id, r.text) for r in two.collect()]
    assert {r.doc_id for r in three.collect()} == {i for i, c in brute_groups(shingle_sets(rows)).items() if i == c} and three.columns == columns
    four = mix(spark, three, sf)
    copies = {r.doc_id: r.copies for r in mixing.plan(three).collect()}
    got = [r.doc_id for r in four.collect()]
    assert four.columns == columns and all(got.count(i) == n for i, n in copies.items())
    five = tokens(spark, four, sf).collect()
    b = bpe.load(tokenizer_path(spark))
    texts = {r.doc_id: r.text for r in three.collect()}
    assert [r.doc_id for r in five] == got and all(bytes(r.ids) == b.encode(texts[r.doc_id]) and r.decoded == b.decode(r.ids) for r in five)


def test_run_equals_its_stages(spark, sf):
    rows = pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"] and rows.count() > 0
    assert pipeline.ORACLE_SQL is None and langid.UND == "und"


def test_language_stage_without_labels_keeps_texts_with_letters(spark, sf):
    for label in (None, "en"):
        rows = [(1, "clean words", label, "s", 11), (2, None, label, "s", 0), (3, "12 34", label, "s", 5), (4, "longer words " * 500, label, "s", 6500)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        assert {r.doc_id for r in pipeline.language(spark, docs, sf).collect()} == {1, 4}


def test_language_stage_depends_on_its_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    foreign = spark.createDataFrame([(800_001, "Это предложение на русском языке, которого никто не учил", None, "s", 56), (800_002, "这是一个没有人学过的语言的句子" * 4, None, "s", 60)], docs.schema)
    docs = docs.union(foreign)
    got = {r.doc_id: r.lang for r in pipeline.language(spark, docs, sf).collect()}
    labels = {r.doc_id: r.lang for r in docs.collect()}
    # documents in no learned language go; the others carry the identified one
    assert set(labels) - set(got) == {800_001, 800_002}
    assert sum(got[i] == labels[i] for i in got) > 0.95 * len(got)
    french = docs.withColumn("lang", F.when(F.col("lang") == "fr", F.col("lang")))
    assert {r.lang for r in pipeline.language(spark, french, sf).collect()} == {"fr"}
    russian = "Это другое предложение на русском языке, и его текст учит модель узнавать язык; никто его не учил. "
    learned = docs.union(spark.createDataFrame([(800_010 + k, russian * (k + 1), "ru", "s", 99) for k in range(9)], docs.schema))
    found = {r.doc_id: r.lang for r in pipeline.language(spark, learned, sf).collect()}
    assert found[800_001] == "ru" and 800_002 not in found


def test_stages_of_hard_rows(spark, sf):
    """Nulls in any column, repeated rows and ids, ties, clashing columns and empty tables."""
    words = " ".join(f"word{k}" for k in range(40))
    other = " ".join(f"thing{k}" for k in range(40))
    rows = [(1, words, "en", "a", 300), (1, words, "en", "a", 300), (2, words, None, None, None), (None, words, "en", "a", 1), (None, words, "en", "a", 1), (None, None, None, None, None)]
    rows += [(3, other, "en", "a", 9), (4, other, "en", "b", 9), (3, words + " more", "de", "b", 9), (5, "", "en", "a", 0), (6, "12", None, "a", 2), (7, "x " * 60_000, "en", "c", 120_000)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id int, key string")
    one = pipeline.language(spark, docs, sf)
    assert sorted((r.doc_id or 0) for r in one.collect()) == [0, 0, 1, 1, 2, 3, 3, 4, 7] and one.columns == docs.columns
    near = pipeline.near_dedup(spark, docs, sf)
    got = sorted(((r.doc_id or 0), (r.text or "")[:6]) for r in near.collect())
    # of a repeated row one stays, of near-duplicates the first by id, and a row that shares an id with a removed one
    assert got == [(0, ""), (1, "word0 "), (3, "thing0"), (5, ""), (6, "12"), (7, "x x x ")] and near.columns == docs.columns
    for _, stage in pipeline.STAGES[1:4]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert pipeline.tokens(spark, docs, sf).count() == len(rows)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
