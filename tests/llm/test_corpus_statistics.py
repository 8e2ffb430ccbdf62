"""Source divergence, exact duplicates and phrases: against plain versions of their rules and SQL."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import comparable
from pyspark.sql import functions as F

from tessera.llm import divergence, exact, phrases, queries
from tessera.llm.common import Workspace

rng = np.random.default_rng(5)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_exact_dedup", "op13_phrase_mining"])
def test_queries_equal_sql(spark, duck, sf, name):
    want = comparable(duck.execute(queries.ORACLES[name]).fetchdf())
    assert comparable(queries.QUERIES[name](spark, sf).toPandas()) == want and (want[1] or name == "op13_phrase_mining")


# --- exact duplicates -------------------------------------------------------------------------------


def plain_groups(rows):
    names = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t in rows]
    groups = defaultdict(list)
    for (i, _), s in zip(rows, names, strict=True):
        groups[s].append(i)
    first = {s: min((i for i in g if i is not None), default=None) for s, g in groups.items()}
    return Counter((i, first[s], len(groups[s]), i == first[s], s) for (i, _), s in zip(rows, names, strict=True))


def hard_rows():
    rows = [(1, None), (2, ""), (3, " "), (4, "\t\n "), (5, "a b"), (6, "a \n b"), (7, "a b"), (7, "a b"), (7, "a b"), (None, "a b"), (None, "alone"), (None, "alone"), (8, "\x00"), (9, "x " * 50_000), (10, "x\n" * 50_000)]
    return rows + [(100 + k, "many") for k in range(3000)] + [(9000 - k, f"text {k % 400}") for k in range(600)]


@pytest.mark.parametrize(("bits", "most"), [(16, 1 << 29), (1, 1 << 29), (16, 1 << 14)])
def test_exact_duplicates(spark, bits, most):
    rows = hard_rows()
    df = spark.createDataFrame([(i, t, 1, "k", True) for i, t in rows], "doc_id long, text string, keep_id int, sha string, maybe boolean").repartition(5)
    got = exact.duplicates(df, bits=bits, max_bits=most)
    assert Counter(tuple(r) for r in got.collect()) == plain_groups(rows)
    assert exact.duplicates(df.where("false")).count() == 0


def test_rows_alone_in_their_cell_do_not_shuffle(spark):
    rows = spark.createDataFrame([(k, f"text {k if k > 100 else k // 2}") for k in range(4000)], "doc_id long, text string")
    ws = Workspace(spark, "marked")
    named = ws.save(rows.select("doc_id", F.sha2("text", 256).alias("sha")), "named")
    maybe = {r.doc_id for r in exact.marked(ws, named, exact.BITS, exact.MAX_BITS).where("maybe").collect()}
    assert set(range(100)) <= maybe and len(maybe) < 200
    plan = exact.duplicates(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_kept_rows_have_their_columns(spark):
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(hard_rows()[:15])], "doc_id long, text string, group_size int")
    got = exact.keep_first(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id or 0), r.group_size) for r in got.collect()) == [(0, 10), (0, 11), (1, 0), (3, 2), (5, 4), (7, 6), (8, 12), (9, 13)]


# --- divergence -------------------------------------------------------------------------------------


def plain_audit(rows, least, ranks):
    uses, docs, labels = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        labels.add((lang, source))
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
        uses[lang, source] += found
        docs[lang].update(set(found))
    out = []
    for lang in {x for x, _ in labels}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in labels if x == lang)
        shares = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[t] for t in kept) + 5 * len(kept)) for t in kept}
        p = {s: shares(uses[lang, s]) for s in sources}
        q = shares(sum((uses[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if uses[lang, s][t] and p[s][t] > q[t])[:ranks]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(pair)]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(term)]
    return sorted(out)


def audit_rows():
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["É", "é", "naïve", "中文", "á"]
    rows = [(lang, f"s{k % n}", " ".join(rng.choice(vocabulary, 30)) + ("1Ab" if k % 7 else ".")) for lang, n in (("en", 7), ("fr", 1), ("de", 3)) for k in range(90)]
    rows += [(None, None, None), (None, "s1", "x"), ("en", None, "Wab waB"), ("en", "", ""), ("zz", "only", "rare words"), ("zz", "other", None), ("en", "hot", "the " * 40_000)]
    return rows + [("en", "s0", "same text here")] * 40


@pytest.mark.parametrize(("terms", "sources"), [(divergence.TERMS, divergence.SOURCES), (16, 2)])
def test_divergence(spark, terms, sources):
    rows = audit_rows()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, source string, text string, term int, p string").repartition(4)
    got = divergence.audit(df, least_docs=20, ranks=9, terms=terms, sources=sources)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, 20, 9)
    assert divergence.audit(df.where("false")).count() == 0


def test_slices_with_one_hash_are_told_apart(monkeypatch):
    words = ["a", "bb", "cc", "a", "bb", "é"]
    data = np.frombuffer("|".join(words).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    for digest in (divergence.xxhash.xxh3_64_intdigest, lambda b: 7, lambda b: len(b)):
        monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", digest)
        names, group = divergence.grouped(data, *divergence.boundaries(data, offsets))
        assert [names[g].decode() for g in group] == words and len(set(names)) == len(names)


def test_terms_end_with_their_text():
    data = "abcdé".encode()
    found = divergence.boundaries(np.frombuffer(data, np.uint8), np.array([0, 0, 2, 2, 6, 6]))
    assert [data[a:b].decode() for a, b in zip(*found, strict=True)] == ["ab", "cdé"]


# --- phrases ----------------------------------------------------------------------------------------


def plain_phrases(rows, least, longest, percent, ranks):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            f[lang or "und"].update(" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p.encode(): (p.split(" "), a) for p, a in counts.items() if a >= least and " " in p}
        longer = Counter()
        for w, a in candidates.values():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    inner = " ".join(w[i : i + k])
                    longer[inner] = max(longer[inner], a)
        found = []
        for p, (w, a) in candidates.items():
            cuts = []
            for k in range(1, len(w)):
                x, y = counts[" ".join(w[:k])], counts[" ".join(w[k:])]
                cuts.append((1000 * a * total[lang] // (x * y), k, x, y))
            score, _, x, y = min(cuts)
            if 100 * longer[p.decode()] < percent * a:
                found.append((-score, -a, p, x, y))
        out += [(lang, k + 1, p.decode(), -a, x, y, total[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(found)[:ranks])]
    return sorted(out)


def phrase_rows():
    vocabulary = [*"abcdefgh", "É", "é", "中", "x\x01", "x\x08y", "\x00", "\x1f", "x"]
    rows = [(("en", "fr", None, "und")[k % 4], "".join(str(w) + str(s) for w, s in zip(rng.choice(vocabulary, 60), rng.choice([" ", "  ", "\t", ", ", "! ", "\n", "\r\n", " ", "-"], 60, p=[0.6, 0.1, 0.1, *[1 / 30] * 6]), strict=True))) for k in range(160)]
    rows += [("en", "New York City is big. " * 300), ("en", None), (None, ""), ("de", "a a a a a a a a " * 200), ("en", "the b " * 20_000)]
    return rows + [("en", "one copied passage of some words, given often")] * 150


@pytest.mark.parametrize(("load", "bits"), [(phrases.LOAD, phrases.MAX_BITS), (5, 1 << 15)])
def test_phrases(spark, monkeypatch, load, bits):
    monkeypatch.setattr(phrases, "LOAD", load)
    monkeypatch.setattr(phrases, "HEAVY", 10**9)
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, a int, phrase string").repartition(6)
    for least, percent, ranks in ((12, 100, 2000), (5, 60, 40)):
        got = phrases.collocations(df, least=least, percent=percent, ranks=ranks, max_bits=bits)
        assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, least, 5, percent, ranks)
    assert phrases.collocations(df.where("false")).count() == 0


def test_ranks_by_parts(spark):
    rows = [("en", f"w{k}", 100 + k % 7, 1, 1, 1, k % 50) for k in range(3000)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    got = [r.phrase for r in phrases.ranked(Workspace(spark, "ranked"), df, 20).orderBy("rank").collect()]
    assert got == [r[1] for r in sorted(rows, key=lambda r: (-r[6], -r[2], r[1]))[:20]]


def test_word_hashes_equal_spark(spark):
    rows = [("en", "word"), ("und", "É!A"), ("", "a longer word than thirty-two bytes of text, to reach all of the rounds")]
    for r in spark.createDataFrame(rows, "lang string, word string").select("*", F.xxhash64("lang", "word").alias("h")).collect():
        assert phrases.cell(r.lang, r.word.encode()) == r.h % 2**64
