"""Media, near-duplicates, lines, mixing, repeated strings, vectors: against brute force and SQL."""

import hashlib
import io
import math
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import comparable
from pyspark.sql import functions as F

from tessera.llm import common, embeddings, lines, media, mixing, neardup, queries, substrings
from tessera.llm.common import Workspace, components

rng = np.random.default_rng(3)
VOCABULARY = ["w%d" % k for k in range(3000)]


def words(n):
    return " ".join(rng.choice(VOCABULARY, n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_shingles string")


def groups(links, ids):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# --- media ------------------------------------------------------------------------------------------


def test_cuts_are_local():
    data = rng.integers(0, 256, 60_000).astype(np.uint8).tobytes()
    ends = media.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= media.MOST and sizes[:-1].min() >= media.LEAST
    moved = {b - 100 for b in media.cuts(rng.integers(0, 256, 100).astype(np.uint8).tobytes() + data)}
    assert len(moved & set(ends)) > 0.8 * len(ends)


def expected(text):
    raw = (text or "").encode()
    padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])


def expected_media(text):
    """The stored form by the standard library's writer, and its features by plain sums."""
    raw = (text or "").encode()
    data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(data)
    x = [b - 128 for b in data]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    feature = f"mean={sum(x) / len(x):.4f};rms={math.sqrt(sum(v * v for v in x) / len(x)):.4f};crossings={crossings}"
    return len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest(), feature


def test_media_read_back(spark, sf):
    shared = "".join(map(chr, rng.integers(33, 126, 40_000)))
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, "\x00"), (5, shared), (6, "head" + shared), (7, shared + "tail é"), (8, shared * 3), *((20 + k, shared) for k in range(5))]
    got = media.chunked_media(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, *expected(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert Counter((r.doc_id, r.media_bytes, r.media_sha256, r.feature) for r in got) == Counter((i, *expected_media(t)) for i, t in rows)
    same = {(r.media_sha256, r.feature, r.media_bytes) for r in got if r.doc_id == 5 or (r.doc_id or 0) >= 20}
    assert len(same) == 1
    assert media.chunked_media(frame(spark, [])).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op3_media_chunks(spark, sf).collect():
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(texts[r.doc_id])


def test_shared_chunks_are_stored_once(spark):
    shared = "".join(map(chr, rng.integers(33, 126, 60_000)))
    rows = frame(spark, [(k, f"{k} " * 50 + shared) for k in range(6)])
    found = media.recipes(rows, "doc_id", "text")
    stored = media.store(media.payloads(rows, "text"), media.places(found))
    kept = stored.where("kind in ('own', 'export')").select("digest").distinct().count()
    assert kept < found.select(F.sum(F.size("digests"))).first()[0] / 3


def test_every_file_is_made_of_stored_chunks(spark, tmp_path, monkeypatch):
    shared = "".join(map(chr, rng.integers(33, 126, 30_000)))
    alone = [(k, f"{k} " + "".join(map(chr, rng.integers(33, 126, 9000)))) for k in range(4)]
    rows = frame(spark, [*alone, (10, shared), (11, shared), (12, "head" + shared), (13, None)])
    for few in (media.FEW_KEYS, 0):  # the filter made on the driver and by tasks
        monkeypatch.setattr(media, "FEW_KEYS", few)
        found = media.recipes(rows, "doc_id", "text")
        ws = common.Workspace(spark, "t")
        stored = ws.save(media.store(media.payloads(rows, "text"), media.places(found)), "store")
        whole = {bytes(r.key): r for r in stored.where("kind = 'whole'").collect()}
        for r in found.where("doc_id < 4 or doc_id = 13").collect():
            kept = whole[bytes(r.key)]
            assert list(kept.digests) == list(r.digests) == [media.digest(bytes(c)) for c in kept.bodies]
        assert len(whole) == 5 and stored.where("kind = 'want'").select("key").distinct().count() == 2
        # a stored chunk that changes is found out, also one of an entry without shared chunks
        spoiled = stored.withColumn("bodies", F.transform("bodies", lambda c: F.lit(b"x")))
        with pytest.raises(Exception, match="a chunk differs from its digest"):
            media.reconstruct(common.Workspace(spark, "t"), spoiled).collect()


# --- near-duplicates --------------------------------------------------------------------------------


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_groups(sets):
    ids = sorted(sets)
    links = []
    index = defaultdict(list)
    for i in ids:
        common = Counter(j for s in sets[i] for j in index[s])
        links += [(j, i) for j, n in common.items() if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n)]
        for s in sets[i]:
            index[s].append(i)
    return groups(links, ids)


def check_near(spark, rows):
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    sets = shingle_sets(rows)
    want = brute_groups(sets)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i), i


def test_near_duplicates_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_near(spark, rows)


def edited(text, n):
    w = text.split()
    for k in rng.integers(0, len(w), n):
        w[k] = rng.choice(VOCABULARY)
    return " ".join(w)


def test_groups_chains_and_edges(spark):
    base = words(200)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (7, base), (8, base.upper())]
    rows += [(100 + k, edited(base, int(rng.integers(1, 9)))) for k in range(60)]
    chain = words(300)
    for k in range(12):  # neighbours are close, ends are not
        rows.append((300 + k, chain))
        chain = " ".join(chain.split()[15:] + words(15).split())
    rows += [(400 + k, words(int(rng.integers(1, 30)))) for k in range(30)] + [(500, words(60_000))]
    rows.append((501, rows[-1][1] + " more"))
    check_near(spark, rows)
    many = neardup.near_duplicates(frame(spark, [(9, base), (9, base), (None, base), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in many) == [(0, 0, True), (0, 0, True), (9, 9, True), (9, 9, True)]
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_buckets_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 6)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 900)
    base = words(120)
    rows = [(k, edited(base, int(rng.integers(1, 12)))) for k in range(90)]  # many pairs lie about the threshold
    rows += [(200 + k, edited(rows[k][1], 2) + " " + words(900)) for k in range(4)]
    check_near(spark, rows)
    other = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, rep int, bucket int, component int, n int")
    assert sorted(neardup.near_duplicates(other).collect()) == sorted(neardup.near_duplicates(frame(spark, rows)).collect())


def thue_morse(a, b):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(1024))


def test_texts_with_no_word_in_common_are_not_linked(spark):
    rows = [(k, " ".join(thue_morse(*x) for x in ("ab", "cd", "ef", "gh", "ij")[:n])) for k, n in enumerate((1, 2, 5))]
    rows += [(10 + k, " ".join(thue_morse(*x) for x in ("ba", "dc", "fe", "hg", "ji")[:n])) for k, n in enumerate((1, 2, 5))]
    check_near(spark, rows)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    assert got == {i: plain_removed(rows)[i] for i, _ in rows}


def plain_removed(rows):
    seen = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    return {i: len({k for a in range(len(t) - 199) if seen[t[a : a + 200]] > 1 for k in range(a, a + 200)}) for i, t in rows}


def test_links_are_confirmed_on_words(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_WORDS", defaultdict(lambda: 7))  # every word has one hash
    texts = ["a b c d e f", "a b c d e f g", "h i j k l m"]
    found = [neardup.words_of(t) for t in texts]
    place = np.arange(3)
    assert neardup.joined(texts, place, np.array([0, 0, 1]), np.array([2, 1, 2]), 5, 60) == [0, 0, 2]
    keys = {neardup.set_key(f, neardup.hashed_runs(f, 5), 5) for f in found}
    assert len(keys) == 3


def test_rows_that_share_an_id_are_told_apart(spark):
    base, other = words(60), words(60)
    rows = [(1, base), (1, other), (1, other), (2, base + " more"), (3, other)] + [(9, base)] * 40
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False)] + [(9, 1, False)] * 40)


def test_many_equal_rows_without_an_id(spark):
    text = "".join(map(chr, rng.integers(97, 122, 900)))
    part = text[100:500]
    rows = [(None, text)] * 10_000 + [(1, "head " + part + " tail"), (2, "x" + text[300:600])]
    got = Counter((r.doc_id, r.n_removed, r.n_spans) for r in substrings.remove_repeats(frame(spark, rows).repartition(4)).collect())
    assert got == {(None, 900, 1): 10_000, (1, 400, 1): 1, (2, 300, 1): 1}


def test_intersections():
    for sizes in ((1, 1), (3, 5), (20, 30)):
        one, two = ([np.unique(rng.integers(0, 3000, int(rng.integers(1, 900))).astype(np.uint64)) for _ in range(n)] for n in sizes)
        assert (neardup.intersections(one, two) == [[len(set(a) & set(b)) for b in two] for a in one]).all()


def test_lower_thresholds_find_their_pairs(spark):
    g = np.random.default_rng(11)
    word = lambda: "".join(g.choice(list("abcdefghij"), 8))
    rows = []
    for k in range(40):  # two texts that share 240 of 240 + 2 * 110 shingles
        common = [word() for _ in range(244)]
        rows += [(2 * k + side, " ".join(common + [word() for _ in range(110)])) for side in (0, 1)]
    sets = shingle_sets(rows)
    assert all(0.5 <= len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) < 0.55 for k in range(40))
    got = neardup.near_duplicates(frame(spark, rows), percent=50).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}
    assert neardup.band_width(75) == neardup.band_width(90) == neardup.BAND
    with pytest.raises(ValueError):
        neardup.band_width(1)


def test_sketch_estimates_similarity():
    a = neardup.mix(np.arange(1, 1501, dtype=np.uint64))
    for share in (0.5, 0.75, 0.9):
        n = int(1500 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], neardup.mix(np.arange(10_000, 10_000 + 1500 - n, dtype=np.uint64))])
        same = np.mean([(neardup.sketch(neardup.mix(a + np.uint64(k))) == neardup.sketch(neardup.mix(b + np.uint64(k)))).mean() for k in range(20)])
        assert abs(same - share) < 0.05
    for n in (1, 2, 5, 127, 128, 5000):
        assert (neardup.sketch(a[:n]) > 0).all()


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(200, k) for k in range(201, 300)] + [(70, 70), (500, 499)]
    got = dict(map(tuple, components(Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long"), "c").collect()))
    links = [p for p in links if p[0] != p[1]]
    want = groups(links, {x for p in links for x in p})
    assert got == want


def test_joins_deal_out_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 90).cast("long").alias("k"), "id")
    keyed = rows.where("k % 3 = 1").groupBy("k").agg(F.count("*").alias("n"))
    got = common.join_dealt(rows, keyed, ["k"], "n")
    assert got.columns == ["k", "id", "n"]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, rows.join(keyed, "k").collect()))
    assert common.join_dealt(rows, keyed.where("false"), ["k"], "n").count() == 0


# --- lines and mixing -------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op3_media_chunks", "op6_near_dedup", "op7_line_dedup", "op8_mixing", "op9_substring_dedup", "op10_near_vectors"])
def test_query_equals_sql(spark, sf, duck, name):
    assert comparable(queries.QUERIES[name](spark, sf).toPandas()) == comparable(duck.execute(queries.ORACLES[name]).df())


def test_lines_edges(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "q\nq\nq\nq\nq"), (7, "\n\n\n\n"), (8, "\n\n\n\n"), (None, "a\nb\nc"), (9, "b\nc\nd\na\nb\nc"), (10, "\n".join(map(str, range(50_000))))]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup(frame(spark, rows)).collect()}
    assert got[1] == ("a\nb\nc\nd", 4, 0) and got[2] == ("x\ny", 5, 3) and got[3] == ("a\nb", 2, 0)
    assert got[4] == (None, 0, 0) and got[5] == ("", 1, 0) and got[6] == ("q", 5, 4) and got[7] == ("", 5, 4) and got[8] == ("", 5, 5)
    assert got[None] == ("a\nb\nc", 3, 0) and got[9] == ("", 6, 6) and got[10][1:] == (50_000, 0)
    assert lines.dedup(frame(spark, [])).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    one, two = "a\nb\nc\nd", "p\nq\nr"
    rows = [(1, one), (1, two), (1, two), (2, "x\n" + one), (3, one)]
    df = spark.createDataFrame([(i, t, 5, "k", 6, 7) for i, t in rows], "doc_id long, text string, starts int, lines string, id int, key int")
    got = lines.dedup(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert Counter((r.doc_id, r.text, r.n_removed, r.starts) for r in got.collect()) == Counter([(1, one, 0, 5), (1, two, 0, 5), (1, two, 0, 5), (2, "x", 4, 5), (3, "", 4, 5)])


def test_mixing_edges(spark):
    rows = [(k, words(int(rng.integers(1, 40))), ["a", "b", "c", None][k % 4]) for k in range(200)] + [(300, None, "a"), (301, "", "empty"), (None, "some words", "a"), (302, words(20_000), "b")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, target long")
    planned = mixing.plan(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    taken = defaultdict(int)
    for r in planned:
        assert r.size == len((r.text or "").split()) and r.taken <= 2 * r.size and len(r.positions) == r.copies and r.source_size == sizes[r.source]
        assert all(0 <= p <= 1 for p in r.positions) and sorted(r.positions) == r.positions
        taken[r.source] += r.taken
    target = {r.source: r.target for r in planned}
    biggest = defaultdict(int)
    for r in planned:
        biggest[r.source] = max(biggest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 1 for s in target) and target["empty"] == 0
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    order = [r.position for r in mixing.schedule(mixing.plan(docs)).collect()]
    assert order == sorted(order) and len(order) == sum(r.copies for r in planned)
    assert mixing.plan(docs.where("false")).count() == 0


def test_positions_follow_the_schedule(spark):
    shares = spark.range(1, 1000).select((F.col("id") / 1000).alias("u"))
    for turn, knots in enumerate(mixing.SCHEDULES):
        t = np.array([r[0] for r in shares.orderBy("u").select(mixing.position(F.lit(turn), F.col("u"))).collect()])
        x = np.linspace(0, 1, 20_001)
        y = np.interp(x, *zip(*knots))
        demand = np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2)])
        assert np.abs(np.interp(t, x, demand / demand[-1]) - np.arange(1, 1000) / 1000).max() < 1e-4


# --- repeated strings -------------------------------------------------------------------------------


def brute_substrings(rows, length):
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        mask = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = True
        kept = bytes(x for x, m in zip(b, mask) if not m)
        out.append((i, len(b), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def repeats(length):
    text = lambda n: "".join(rng.choice(list("abcd é"), n))
    core = text(3 * length)
    rows = [(1, None), (2, ""), (3, core[: length - 1]), (4, core), (5, text(50) + core[7:] + text(90)), (6, text(9) + core[:length] + text(5)), (7, "xyz" * length), (8, text(40 * length))]
    rows += [(9, core + text(20) + core), (10, rows[7][1]), (10, rows[7][1]), (None, core[5:]), (11, text(length) + "pq" * length), (12, "pq" * (length // 2 + 1))]
    rows += [(20 + k, text(int(rng.integers(0, 60))) + core[int(rng.integers(0, 30)) : 3 * length - int(rng.integers(0, 30))] + text(int(rng.integers(0, 60)))) for k in range(40)]
    return rows


@pytest.mark.parametrize("length,gram,most", [(200, 48, 20_000), (40, 12, 20_000), (40, 12, 2), (25, 25, 5)])
def test_repeats_against_brute_force(spark, length, gram, most):
    rows = repeats(length)
    got = substrings.remove_repeats(frame(spark, rows), length=length, gram=gram, most=most).collect()
    assert Counter(map(tuple, got)) == brute_substrings(rows, length)


def test_repeats_of_the_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op9_substring_dedup(spark, sf).collect())) == brute_substrings(rows, 200)
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


# --- vectors ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "cells"), [(50, 2), (8192, 256), (300, 20)])
def test_vectors_against_brute_force(spark, block, cells):
    rows = []
    for label in (1, 2):
        centres = rng.standard_normal((40, 64))
        for k in range(400):
            c = centres[k % 40] / np.linalg.norm(centres[k % 40])
            noise = rng.standard_normal(64)
            rows.append((len(rows), (c + noise / np.linalg.norm(noise) * rng.uniform(0, 0.25)).tolist(), label))
    rows += [(len(rows) + k, rows[0][1], 1) for k in range(30)] + [(5000, rows[0][1], None), (5001, None, 1), (5002, [0.0] * 64, 1), (5003, [float("nan")] * 64, 1), (5004, [float("inf")] + [0.0] * 63, 1), (5005, [1.0, 2.0], 1), (5006, [2.0, 4.0], 1), (5007, [None] + [1.0] * 63, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, rows[0][1], 1, "x")], "vec_id long, embedding array<double>, label long, kept string")
    got = {r.vec_id: r for r in embeddings.near_vectors(df, block=block, cell_rows=cells).collect()}
    links, found = 0, 0
    pairs = []
    usable = [(i, np.array(v), lab) for i, v, lab in rows if v and lab and None not in v and np.isfinite(v).all() and np.linalg.norm(v)]
    for x, (i, v, a) in enumerate(usable):
        for j, w, b in usable[x + 1 :]:
            if a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links += 2
                pairs.append((i, j))
    degree = Counter(x for p in pairs for x in p)
    for i, v, lab in rows:
        assert got[i].n_links == degree[i]
        found += got[i].n_links
    assert links > 0
    assert found == links
    want = groups(pairs, [r[0] for r in rows])
    assert all(got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in want)
    assert got[None].n_links == 0 and got[5001].component_id == 5001 and got[5005].n_links == 1
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_recall_on_the_embeddings(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    got = queries.op10_near_vectors(spark, sf).toPandas().set_index("vec_id")
    want = 0
    for _, g in rows.groupby("label"):
        v = np.array(g.embedding.tolist(), np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        m = v @ v.T >= 0.98
        np.fill_diagonal(m, False)
        want += m.sum()
        assert (got.loc[g.vec_id].n_links.to_numpy() <= m.sum(1)).all()
    assert got.n_links.sum() >= 0.9 * want


def test_components_of_any_size_and_vectors_of_many_lengths(spark):
    base = rng.standard_normal(8)
    sizes = [1e-200, 1.0, 1e200, 1e-310, 1e307]
    rows = [(k, (base * size).tolist(), 1) for k, size in enumerate(sizes)] + [(9, (-base).tolist(), 1)]
    rows += [(100 + 2 * d + k, [1.0 + 0.01 * k] + [0.5] * d, 2) for d in range(1, 40) for k in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (4, 0), 9: (0, 9)} | {100 + 2 * d + k: (1, 100 + 2 * d) for d in range(1, 40) for k in range(2)}


def test_no_task_sorts_all_vectors(spark):
    df = spark.createDataFrame([(k, rng.standard_normal(4).tolist(), 1) for k in range(300)], "vec_id long, embedding array<double>, label long")
    ws = Workspace(spark, "fit")
    classes = ws.save(df.select(F.col("vec_id").alias("class"), F.col("vec_id").alias("number"), F.lit(4).alias("dim"), F.col("embedding").alias("v")), "classes")
    model = embeddings.fit(classes, lambda sample: sample, 20)
    assert len(model.by[4]) == 20 and model[7].shape == (0, 7)


@pytest.mark.parametrize("shift", [0, 2])
def test_no_pair_just_above_the_threshold_is_lost(spark, shift):
    g = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(unit(g.standard_normal((1500, 64))) + shift * unit(g.standard_normal(64)))
    away = g.standard_normal(x.shape)
    away = unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    cosine = g.uniform(0.98001, 0.985, (len(x), 1))
    v = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * away])
    got = embeddings.near_vectors(spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()
    near = v @ v.T >= 0.98
    np.fill_diagonal(near, False)
    want = groups(list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)), list(range(len(v))))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (near[i].sum(), want[i]) for i in want}
