"""BPE, language identification, HTML, URLs: against the public library, held-out labels, pages and SQL."""

import hashlib
import html as entities
import math
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from conftest import comparable
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tessera.llm import bpe, common, html, langid, queries, urls

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


# --- BPE --------------------------------------------------------------------------------------------


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdeABCΣσςéÉÜßñ \t\n\x1c\x1f_'’stTllveRE01½²Ⅳ٣ª漢かİıǅ!?.,<|>\u0301\u2028\u00a0\x85🙂"), max_size=30))
def test_bpe_equals_the_library(text):
    b = bpe.load(PATH)
    for t in (text, text[:4] + "<|endoftext|>" + text[4:]):
        ids = b.encode(t)
        assert (np.frombuffer(ids, "<u4").tolist(), b.decode(ids)) == library(t)


def test_bpe_columns(spark, sf):
    long_text = "Word'll " * 30_000 + "x" * 50_000
    rows = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, " \n", "k"), (4, "Same 12!", "k"), (4, "Same 12!", "k"), (5, long_text, "k")], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(rows, PATH), PATH).orderBy("doc_id").collect()
    for r in got:
        assert (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) == library(r.text or "")
    pair = bpe.round_trip(rows, PATH).orderBy("doc_id").collect()
    assert [(r.ids, r.decoded) for r in pair] == [(r.ids, r.decoded) for r in got]
    assert bpe.round_trip(spark.createDataFrame([], EMPTY), PATH).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op4_bpe(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        ids, decoded = library(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


# --- language ---------------------------------------------------------------------------------------


def test_suffix_automaton_against_brute_force():
    text = "abracadabra banana bandana"
    root = langid.automaton(text)
    for probe in ("banabra", "zzz", "ana", "cadabrabanana", "", "a z a"):
        count, i = 0, 0
        while i < len(probe):
            n = 0
            while i + n < len(probe) and probe[i : i + n + 1] in text:
                n += 1
            i += max(n, 1)
            count += 1
        assert langid.phrases(root, probe) == count


def brute_prediction(texts, text):
    """The rules of cross-parsing, by searching the labelled texts."""
    text = regex.sub(r"[^\p{L}\p{M}]+", " ", (text or "").lower()).strip(" ")
    if not regex.search(r"\p{L}", text):
        return "und", 0.0
    cost = {}
    for lang, known in texts.items():
        count, i = 0, 0
        while i < len(text):
            n = 1
            while i + n < len(text) and text[i : i + n + 1] in known:
                n += 1
            i += n
            count += 1
        cost[lang] = count * math.log2(len(known)), lang, count
    _, lang, count = min(cost.values())
    return lang, 1 - count / len(text)


def test_prediction_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, train_chars=6000)
    texts = dict(zip(model.langs, model.texts, strict=True))
    assert len(texts) > 2 and all(3000 < len(t) <= 6000 + 150 * langid.PIECES + 2 for t in texts.values())
    whole = {regex.sub(r"[^\p{L}\p{M}]+", " ", (r.text or "").lower()).strip() for r in docs.collect()}
    assert all(any(piece in w for w in whole) for t in texts.values() for piece in t.split(langid.END))  # running text as it stands
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, " 1\u0301 "), (-3, "Übergrößen in der Straße"), (-4, "字" * 50)], "doc_id long, text string"))
    for r in langid.predict(rows, model).collect():
        lang, score = brute_prediction(texts, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-12


def test_language_on_held_out_documents(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and held
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    labelled = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "el perro y la casa", "es"), (3, None, "en"), (4, "orphan", None)], "doc_id long, text string, lang string")
    model = langid.fit(labelled)
    rows = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "12 345 !?", 9), (4, "the dog", 9), (4, "the dog", 9), (5, "casa " * 40_000, 9), (6, "x" * 200_000, 9)], "doc_id long, text string, score long")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(rows, model).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "es"] and got[6][0] in ("en", "es")
    none = langid.fit(labelled.where("false"))
    assert {r.lang_pred for r in langid.predict(rows, none).collect()} == {"und"}
    assert langid.predict(rows.where("false"), model).count() == 0


def test_labels_of_long_texts_are_learned(spark):
    late = "1234 " * 20_000 + "ovde je kuća i reka " * 3  # letters at the very end
    labelled = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "pies i kot mieszkają w domu nad rzeką. " * 200, "pl"), (3, late, "sr"), (4, "山水人家" * 3000, "zh"), (5, "12 34", "zz")], "doc_id long, text string, lang string")
    model = langid.fit(labelled)
    assert model.langs == ["en", "pl", "sr", "zh"] and all(len(t) <= 48_000 + 150 * langid.PIECES for t in model.texts)
    rows = spark.createDataFrame([(1, "pies mieszka nad rzeką"), (2, "reka i kuća"), (3, "人家山水"), (4, "the dog")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(rows, model).orderBy("doc_id").collect()] == ["pl", "sr", "zh", "en"]
    spread = "".join(chr(97 + k) * 3 + " " for k in range(26) for _ in range(500))  # 52,000 characters, a letter after the other
    seen = langid.fit(spark.createDataFrame([(1, spread, "x")], "doc_id long, text string, lang string")).texts[0]
    assert "aaa" in seen and "zzz" in seen and len(set(seen.split())) >= 12


# --- pages ------------------------------------------------------------------------------------------


def test_articles_of_all_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op1_html_extraction(spark, sf).collect():
        article = pages[r.page_id].split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


LONG = "the cat and the dog of the house in which they had been at work for a long time with all of that was there. " * 3


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        (f"<div class='sidebar'>{LONG}</div><p>{LONG}</p><p>Short.</p>", f"{LONG.strip()}\nShort."),
        (f"<article><p>A.</p><p>B &amp; &lt;c&gt; &eacute;&#33;</p></article><aside>{LONG}</aside>", "A.\nB & <c> é!"),
        (f"<article><header><h1>T</h1></header><p>x\n y<br>z</p><section class='comments'><p>{LONG}</p></section></article>", "T\nx y z"),
        (f"<nav><a href='/'>home</a></nav><p>{LONG}</p><div>two<br><br>parts</div><footer>{LONG}</footer><script>if (a<b) '</p>'</script>", f"{LONG.strip()}\ntwo\nparts"),
        (f"<article><p>one<p>two <b>bold<br></article><script>never closed <p>{LONG}", "one\ntwo bold"),
        (f"<body class='has-sidebar'><main><p>{LONG}</p><ul><li><a href=x>{LONG}</a></ul><form>{LONG}</form></main>", LONG.strip()),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
        ("<article><p>" + "the word " * 40_000 + "</p></article>", ("the word " * 40_000).strip()),
        ('<article><p title="a > b">x</p><!-- <p>no</p> --></article><p>after', "x"),
    ],
)
def test_pages_of_many_forms(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<article><p>Photo © Ann</p><p>{LONG}&copy; 2020 Bob</p></article><p>© 2021 site</p>", f"Photo © Ann\n{LONG}© 2020 Bob"),
        (f"<p>{LONG}© 2020 Bob</p><p>© 2021 site</p>", f"{LONG}© 2020 Bob"),
    ],
)
def test_copyright_signs(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<article><p>{LONG}</p><section id='related-work'><p>Others did it.</p></section><p>For <math><mi>x</mi></math> more.</p></article>", f"{LONG.strip()}\nOthers did it.\nFor x more."),
        ("<article><p><a href=x>Most of this is a link</a> so.</p><p>Short.</p></article>", "Most of this is a link so.\nShort."),
        (f"<article><p>{LONG}</p><div class='related-posts'><p>{LONG}</p></div><div class='promotion rules'>{LONG}</div><div id='comments-section'>{LONG}</div></article>", LONG.strip()),
        (f"<article><p>It's <a title=it's href='a>b'>five o'clock</a> &lt;now</p><p>{LONG}</p></article>", f"It's five o'clock <now\n{LONG.strip()}"),
        (f"<main><p>{LONG}</p></b></i></section></div><p>x < y and z</p></main>", f"{LONG.strip()}\nx < y and z"),
    ],
)
def test_blocks_inside_articles(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><article class=teaser>Short teaser.</article>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<div><p>{LONG}</p></div><article class=comment><p>{LONG}</p></article><article id='comment-7'>{LONG}</article>", LONG.strip()),
        (f"<article class='post has-comments'><p>{LONG}</p><article class='comment'><p>{LONG}</p></article></article>", LONG.strip()),
        (f"<div class='right-sidebar'><nav><a href=/>Home</a></nav><article><p>{LONG}</p></article><footer>{LONG}</footer></div>", LONG.strip()),
        (f"<div class='content-sidebar'><p>{LONG}</p><p>End.</p></div>", f"{LONG.strip()}\nEnd."),
        (f"<article><p>{LONG}</p><p><a href=x>All of this is a link</a></p><ul><li><a href=y>Menu entry</a></li></ul></article>", f"{LONG.strip()}\nAll of this is a link"),
        (f"<main><p>Short.</p></main><p>Tiny.</p>", "Short."),
    ],
)
def test_regions_are_chosen_by_their_text(page, text):
    assert html.main_text(page) == text


def test_pages_without_article(spark, sf):
    """Most of the given pages give the same text with their article's markup taken away, and none loses much of it."""
    pages = [r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    texts = [(html.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>")), html.main_text(r.html)) for r in pages]
    long = [(a, b) for a, b in texts if len(b) >= 400]
    assert sum(a == b for a, b in texts) >= 0.85 * len(texts) and all(len(a) >= 0.8 * len(b) for a, b in long)


@pytest.mark.parametrize("unit", ["<a ", "<script ", "<script>", "<a b=\"", "<a b='\"", "<!", "<!--", "</div>", "<div>", "<p title=\"x", "<", "&", "&#", "<b a=", "<p>©<a>", "<span></b>"])
def test_time_of_broken_pages(unit):
    took = []
    for size in (1 << 18, 1 << 20):
        start = time.perf_counter()
        html.main_text(unit * (size // len(unit)))
        took.append(time.perf_counter() - start)
    assert took[1] < 20 and took[1] < 12 * took[0] + 0.5


POLISH = "Dawno temu w małym domu nad rzeką mieszkała rodzina, która codziennie chodziła do lasu po drewno i grzyby. "
RUSSIAN = "Давным-давно в маленьком доме у реки жила семья, которая каждый день ходила в лес за дровами и грибами. "
CHINESE = "很久以前在河边的小屋里住着一家人他们每天都去森林里捡柴和采蘑菇回来以后大家围着火炉讲故事。" * 3


@pytest.mark.parametrize("prose", [POLISH, POLISH * 3, RUSSIAN, RUSSIAN * 3, CHINESE])
def test_pages_in_other_languages(prose):
    prose = prose.strip()
    links = f"<div><a href=x>{prose}</a></div>"
    assert html.main_text(f"<nav>{prose}</nav><div>{prose}</div>{links}<p>{prose}</p><p>1999</p><footer>{prose}</footer>") == f"{prose}\n{prose}\n1999"
    english = "The cookies of this site are there for you and for the work that we do with it."  # of no container that rules it out
    assert html.main_text(f"<div>{prose}</div><div>{prose}</div>" + f"<p>{english}</p>").startswith(f"{prose}\n{prose}")


def test_lists_beside_prose_are_left_out():
    names = "Alder Birch Cedar Maple Poplar Willow Juniper Hazel Rowan Linden Hawthorn Elder Spruce"
    assert html.main_text(f"<p>{LONG}</p><div>{names}</div>") == LONG.strip()


def test_waiting_workers_hold_no_tokenizer(spark):
    path = queries.tokenizer_path(spark)
    rows = spark.range(64).repartition(8).select(F.concat(F.lit("some words "), "id").alias("text"))
    assert bpe.round_trip(rows, path).select("ids").distinct().count() == 64

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(bpe._LOADED)], pa.int64())})

    assert [r.n for r in spark.range(64).repartition(8).mapInArrow(held, "n long").distinct().collect()] == [0]


def test_extract_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, "<p>" + LONG, "old"), (1, "<p>" + LONG, "old"), (2, None, None)], "page_id long, html string, text string")
    got = html.extract(rows).orderBy("page_id").collect()
    assert [r.text for r in got] == [LONG.strip(), LONG.strip(), ""] and html.extract(rows.where("false")).count() == 0


# --- URLs -------------------------------------------------------------------------------------------


def test_url_query_equals_sql(spark, sf, duck):
    assert comparable(queries.op2_url_filter(spark, sf).toPandas()) == comparable(duck.execute(queries.ORACLES["op2_url_filter"]).df())


def test_url_edges(spark):
    rules = [("block", "net", "/a"), ("allow", "x.net", "/a"), ("block", "x.net", "/ab"), ("block", "org", "")]
    given_ = [None, "", "no scheme", "http://X.NET/abc", "http://y.x.net/ac?q", "http://xx.net/a", "http://a.org", "http://org#f", "a://b://org/", "http://bad.com/", "http://sub.bad.com/x", "http://" + "l." * 300 + "net/" + "a" * 9000, "http://x.net?/a", "http://" + "l." * 50_000 + "net/a"]
    rows = spark.createDataFrame([(i, u, "old") for i, u in enumerate(given_)] + [(3, given_[3], "old")], "page_id long, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark, rows, rules, spark.createDataFrame([("bad.com",)], "key string")).collect()}
    assert [got[i] for i in range(3)] == [(None, "allow")] * 3
    assert got[3] == ("x.net/ab", "block") and got[4] == ("x.net/a", "allow") and got[5] == ("net/a", "block")
    assert got[6] == got[7] == ("org", "block") and got[8] == (None, "allow")
    assert got[9] == got[10] == (None, "block") and got[11] == got[13] == ("net/a", "block") and got[12] == (None, "allow")
    assert urls.judge(spark, rows.where("false"), rules).count() == 0


def test_url_query_follows_its_contract(spark, tmp_path):
    want = {
        "http://a.net/de/1": ("net/de/", "allow"),
        "http://Example.NET/de/7?q": ("net/de/", "allow"),
        "http://spam-farm.example.net/de/1": ("net/de/", "allow"),
        "http://x.example.net/de/81": ("example.net/de/8", "block"),
        "http://a.com/en/7": ("com/en/", "block"),
        "http://a.example.com/en/7": ("example.com/en/7", "allow"),
        "http://a.org/es/#x": ("org/es/", "block"),
        "http://spam-farm.example.net/fr/": (None, "block"),
        "http://a.net/de": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op2_url_filter(spark, str(tmp_path)).collect()
    assert {list(want)[r.page_id]: (r.rule, r.verdict) for r in got} == want and len(got) == len(want)


def test_lists_longer_than_a_filter_are_judged_in_parts(spark):
    listed = [f"d{k}.example.com" for k in range(0, 300, 3)]
    rows = [(k, f"http://{'x.' * (k % 3)}d{k}.example.com/p") for k in range(300)] + [(900, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    blocked = spark.createDataFrame([(d,) for d in listed], "key string")
    rules = [("allow", "d3.example.com", ""), ("block", "d4.example.com", "/p")]
    want = {k: "allow" if k == 3 else "block" if k in (4,) or k % 3 == 0 and k < 300 else "allow" for k, _ in rows}
    for bits in (urls.MAX_BITS, 2000):
        got = urls.judge(spark, df, rules, blocked, max_bits=bits)
        assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        assert {r.page_id: r.verdict for r in got.collect()} == want


def test_cascade_is_exact_over_its_universe(spark):
    from tessera.llm.common import Workspace

    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = rows.where("xxhash64(key) % 7 = 0")
    keys = F.array(F.struct("key", F.lit(0).alias("n_host")))
    cascade = urls.build(Workspace(spark, "t"), rows, keys, {"s": listed})["s"]
    assert len(cascade.levels) > 3
    h1, h2 = urls.hashes(F.col("key"))
    table = rows.select(h1.alias("a"), h2.alias("b"), (F.xxhash64("key") % 7 == 0).alias("want")).toPandas()
    got = cascade.listed(table.a.to_numpy().view(np.uint64), table.b.to_numpy().view(np.uint64))
    assert (got == table.want.to_numpy()).all()
    with pytest.raises(ValueError, match="max_bits"):
        urls.build(Workspace(spark, "t"), rows, keys, {"s": listed}, max_bits=1000)


def test_short_lists_take_few_jobs(spark, sf):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 64)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("short-lists", "op2")
        assert len(queries.op2_url_filter(spark, sf).collect()) == 50
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("short-lists")) < 30  # not one for each partition of a filter
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_levels_of_few_and_of_many_keys_are_alike(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://d"), "id", F.lit(".net/"), F.col("id") % 5).alias("url"))
    blocked = rows.where("page_id % 3 = 0").select(F.concat(F.lit("d"), "page_id", F.lit(".net")).alias("key"))
    rules = [("allow", f"d{k}.net", "/") for k in range(0, 60, 2)] + [("block", "d7.net", "")]
    for few in (urls.FEW_KEYS, 200, 0):
        monkeypatch.setattr(urls, "FEW_KEYS", few)
        got = {r.page_id: r.verdict for r in urls.judge(spark, rows, rules, blocked).collect()}
        assert got == {k: "block" if k == 7 or k % 3 == 0 and not (k < 60 and k % 2 == 0) else "allow" for k in range(3000)}


def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and [k for k in range(1, 11) if not any(n.startswith(f"op{k}_") for n in names)] == []


def test_parts_of_columns():
    values = [None, "", "a" * 3_000_000, "é" * 3_000_000, None, "b", "c" * 9_000_000, "d"]
    found = list(common.parts(iter([pa.array(values), pa.array([], pa.string()), pa.array(values[::-1])])))
    assert [x for a in found for x in a.to_pylist()] == values + values[::-1] and len(found) > 6
    assert all(len(a) == 1 or sum(len((x or "").encode()) for x in a.to_pylist()) <= common.SLICE_BYTES for a in found)
