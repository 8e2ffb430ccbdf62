"""Removing every byte covered by a repeated string of a given length.

The strings are the windows of ``length`` bytes of the UTF-8 texts. Every window
has an anchor: the leftmost of its runs of ``gram`` bytes with the least hash.
Equal windows have equal anchors in equal places, so only windows under one
anchor hash need be compared. Consecutive windows with one anchor are one
stretch: its bytes are hashed as a whole.

1. Anchor hashes are counted. Those that occur once are dropped.
2. If a stretch occurs twice as a whole, all its windows are repeated.
3. The others differ somewhere from the stretches with their anchor hash; for
   them windows are compared one by one. One copy of each stretch under such a
   hash is sent, in bytes, to the task of its hash, where the hashes of all
   windows are sorted. Where more than ``most`` stretches share an anchor hash,
   their window hashes are dealt into as many parts by hash as keep each of one
   size, so that no task holds a group of unbounded size. Joins on anchor hashes
   deal the rows of frequent ones into parts likewise.
4. Covered positions of a document are merged and removed at once.

Equality of stretches and of windows rests on their 64-bit xxhash under a 64-bit
anchor hash (of a polynomial, which only says what is compared). A note on a stretch
counts only where the document's bytes there have the stretch's hash, so rows
whose ids collide do no harm.

A null or empty text, or one shorter than ``length``, has nothing to remove.
Texts of any length are read whole. Rows with the same id and text are separate
documents, which repeat each other; notes on them are kept once, so that work
grows with their number and not with its square. Rows without an id are treated like others.
An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_dealt, map_slices
from .neardup import mix

LENGTH, GRAM = 200, 48
MOST = 300
#: Row ids whose stretches a task remembers to have sent.
SENT = 100_000

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as a text has needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _ODD), ("down", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_POWERS = Powers()


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums of which two give the hash of the bytes between."""
    _POWERS.grow(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWERS.up[: len(data)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _POWERS.down[start] + (end - start).astype(np.uint64))


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxhash of the bytes between."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of so many values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def stretches(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, stretch hash, first window, number of windows) of the stretches of a text."""
    sums = prefix(data)
    n = len(data)
    at = np.arange(n - gram + 1)
    grams = between(sums, at, at + gram)
    least = least_in(grams, length - gram + 1)
    windows = len(least)
    change = np.zeros(windows, bool)
    change[0] = True
    # the anchor changes with its hash, or when it was the window's first run and the next window leaves it
    change[1:] = (least[1:] != least[:-1]) | (least[:-1] == grams[: windows - 1])
    start = np.flatnonzero(change)
    count = np.diff(np.append(start, windows))
    return least[start], digests(data.tobytes(), start, start + count - 1 + length), start, count


def row_id(doc_id: str, text: str) -> F.Column:
    return F.xxhash64(doc_id, text)


def anchors(docs: DataFrame, doc_id: str, text: str, length: int, gram: int) -> DataFrame:
    """(key, c, rid, place) of every stretch; place packs the first window and the number of windows."""

    def step():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: list[tuple] = []
            for rid, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer((x.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) >= length:
                    key, c, start, count = stretches(data, length, gram)
                    found.append((key, c, np.full(len(key), rid, np.int64), start << 16 | count))
            cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in cols], ["key", "c", "rid", "place"])

        return run

    return map_slices(docs, [row_id(doc_id, text).alias("rid"), F.col(text).alias("text")], step, "key long, c long, rid long, place long")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs removed, and what is left."""
    kept, at, gone = [], 0, 0
    for a, b in spans:
        kept.append(data[at:a])
        gone += b - a
        at = b
    kept.append(data[at:])
    return gone, len(spans), b"".join(kept)


def applied(docs: DataFrame, notes: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """Each text meets the notes on its stretches once.

    Rows of kind done (result), wait (document whose result waits for single
    windows, with its whole spans and text) and stretch (bytes to compare).
    """
    rows = docs.select(row_id(doc_id, text).alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(notes, "rid", "left").select("rid", "doc_id", "notes", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"kind string, rid long, doc_id {kind}, spans array<int>, body binary, key long, c long, n long, place long, stretches long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]

    def step():
        squeeze = zstandard.ZstdCompressor(level=3)
        sent: set[int] = set()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for rid, doc, found, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                data = (x or "").encode("utf-8", "surrogatepass")
                spans, waits = [], False
                if found:
                    place = np.array([f["place"] for f in found], np.int64)
                    start = place >> 16
                    end = start + (place & 0xFFFF) - 1 + length
                    fits = end <= len(data)
                    ok = np.zeros(len(place), bool)
                    ok[fits] = digests(data, start[fits], end[fits]).view(np.int64) == np.array([f["c"] for f in found], np.int64)[fits]
                    for f, a, b, good in zip(found, start.tolist(), end.tolist(), ok.tolist(), strict=True):
                        if not good:
                            continue
                        if f["whole"]:
                            spans.append((a, b))
                        if f["send"] and rid not in sent:
                            out.append(("stretch", rid, None, None, data[a:b], f["key"], f["c"], f["n"], f["place"], f["stretches"], None, None, None, None))
                        waits |= f["send"]
                if waits and rid not in sent:  # rows with this id and text wait likewise, but their stretches are known
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(rid)
                spans = merge(spans)
                if waits:
                    out.append(("wait", rid, doc, [x for s in spans for x in s], squeeze.compress(data), None, None, None, None, None, len(data), None, None, None))
                else:
                    gone, runs, kept = without(data, spans)
                    out.append(("done", rid, doc, None, None, None, None, None, None, None, len(data), gone, runs, hashlib.sha256(kept).hexdigest()))
            types = [pa.string(), pa.int64(), batch.schema.field(1).type, pa.list_(pa.int32()), pa.binary(), *[pa.int64()] * 8, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)

        return run

    return map_slices(rows, list(rows.columns), step, schema)


def window_hashes(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the body, window) of all windows of all bodies."""
    counts = np.array([len(b) for b in bodies], np.int64) - length + 1
    owner = np.repeat(np.arange(len(bodies)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(b[i : i + length]) for b, n in zip(bodies, counts.tolist(), strict=True) for i in range(n)), np.uint64, int(counts.sum())), owner, window


def spans_of(rid: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """(rid, a, b): runs of consecutive covered windows as byte spans; rows are in order."""
    if not len(rid):
        new = np.zeros(0, bool)
    else:
        new = np.ones(len(rid), bool)
        new[1:] = (rid[1:] != rid[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rid))[: len(first)] - 1
    return pa.RecordBatch.from_arrays([pa.array(rid[first]), pa.array(start[first].astype(np.int32)), pa.array((start[last] + length).astype(np.int32))], ["rid", "a", "b"])


def singles(sent: DataFrame, length: int) -> DataFrame:
    """(rid, a, b) of the repeated windows of stretches that occur once; sent has few stretches for each key."""
    rows = sent.repartition("key").sortWithinPartitions("key").select("key", "rid", "n", "place", "body")

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        keys, rid, n, place = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:4])
        h, owner, window = window_hashes([r[4] for r in rows], length)
        h = mix(h ^ mix(keys.view(np.uint64))[owner])
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        twice &= n[owner] == 1
        return spans_of(rid[owner[twice]], (place >> 16)[owner[twice]] + window[twice], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(col.to_pylist() for col in batch.columns), strict=True)
            if len(held) >= 4096:
                end = len(held)
                while end and held[end - 1][0] == held[-1][0]:
                    end -= 1  # the last key may go on in the next batch
                for part in parts(held[:end]):
                    yield compared(part)
                held = held[end:]
        for part in parts(held):
            yield compared(part)

    def parts(rows: list[tuple]) -> Iterator[list[tuple]]:
        """Runs of whole keys, of about 4096 rows."""
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or i - start >= 4096 and rows[i][0] != rows[i - 1][0]:
                yield rows[start:i]
                start = i

    return rows.mapInArrow(run, "rid long, a int, b int")


def in_parts(sent: DataFrame, length: int, per_part: int) -> DataFrame:
    """(rid, starts) of the same for keys with any number of stretches; starts packs the windows found.

    The window hashes of a key are dealt by hash into as many parts as it has
    per_part stretches, so a part stays of one size however many documents share
    a passage. Tasks hand a part its hashes in packed rows, not one by one.
    """
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                key, rid, n, place, stretches_, body = (col.slice(k, 1024) for col in batch.columns)
                if not len(body):
                    continue
                h, owner, window = window_hashes(body.to_pylist(), length)
                key, rid, n, place, group = (x.to_numpy(zero_copy_only=False) for x in (key, rid, n, place, stretches_))
                part = (h % ((group + per_part - 1) // per_part).astype(np.uint64)[owner]).astype(np.int32)
                order = np.lexsort((part, key[owner]))
                owner, h, part, start = owner[order], h[order], part[order], ((place >> 16)[owner] + window)[order]
                # a stretch that stands for several counts twice, under a row id of its own that is never reported
                many = n[owner] > 1
                first = np.flatnonzero(np.concatenate([[True], (key[owner][1:] != key[owner][:-1]) | (part[1:] != part[:-1])]))
                ends = np.append(first[1:], len(h))
                code = np.where(many, -1, start).astype(np.int32)
                out = [(key[owner[i]], part[i], h[i:j].tobytes(), rid[owner[i:j]].tobytes(), code[i:j].tobytes()) for i, j in zip(first, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "part", "h", "rids", "starts"])

    def match(table: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(table.column("h").to_pylist()), np.uint64)
        rid = np.frombuffer(b"".join(table.column("rids").to_pylist()), np.int64)
        start = np.frombuffer(b"".join(table.column("starts").to_pylist()), np.int32)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        # a hash met by a stretch that stands for several is repeated by itself; such stretches are not reported
        twice &= start >= 0
        at = np.flatnonzero(twice)
        at = at[np.lexsort((start[at], rid[at]))]
        first = np.flatnonzero(np.concatenate([[True], rid[at][1:] != rid[at][:-1]])) if len(at) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(at))[: len(first)]
        return pa.table({"rid": pa.array(rid[at[first]], pa.int64()), "starts": pa.array([start[at[i:j]].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary())})

    rows = sent.select("key", "rid", "n", "place", "stretches", "body").mapInArrow(pack, "key long, part int, h binary, rids binary, starts binary")
    return rows.groupBy("key", "part").applyInArrow(match, "rid long, starts binary")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs."""
    if length - gram + 1 > 0xFFFF:
        raise ValueError(f"strings of {length} bytes with anchors of {gram}")
    ws = Workspace(docs.sparkSession, "substrings")
    found = anchors(docs, doc_id, text, length, gram)
    keys = found.select("key", "c").groupBy("key").agg(F.count("*").alias("times"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("times > 1")
    keys = ws.save(keys.select("key", "times", (F.col("c1") != F.col("c2")).alias("mixed")), "keys")
    met = ws.save(join_dealt(found, keys, ["key"], "times").drop("times"), "met")
    per = met.where("mixed").groupBy("key", "c").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("one"))
    per = ws.save(per, "per")
    odd = per.groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("stretches")).where("least = 1").select("key", "stretches")
    send = ws.save(join_dealt(per, ws.save(odd, "odd"), ["key"], "stretches"), "send")
    # whole: places of stretches that occur twice; to send: one place of each stretch under a key with a lone one
    again = per.where("n > 1").select("key", "c", "n")
    whole = met.where("not mixed").select("rid", "key", "c", "place").union(join_dealt(met.where("mixed").select("rid", "key", "c", "place"), again, ["key", "c"], "n").select("rid", "key", "c", "place"))
    none = F.lit(0).cast("long")
    whole = whole.select("rid", F.struct("place", "c", "key", F.lit(True).alias("whole"), F.lit(False).alias("send"), none.alias("n"), none.alias("stretches")).alias("note"))
    asked = send.select(F.col("one.rid").alias("rid"), F.struct(F.col("one.place").alias("place"), "c", "key", F.lit(False).alias("whole"), F.lit(True).alias("send"), "n", "stretches").alias("note"))
    notes = whole.union(asked).groupBy("rid").agg(F.collect_set("note").alias("notes"))
    state = ws.save(applied(docs, notes, doc_id, text, length), "state")
    ws.drop("met")
    sent = state.where("kind = 'stretch'")
    more = singles(sent.where(F.col("stretches") <= most), length).groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("more"))
    hits = in_parts(sent.where(F.col("stretches") > most), length, most).groupBy("rid").agg(F.collect_list("starts").alias("hits"))
    waiting = state.where("kind = 'wait'").join(more, "rid", "left").join(hits, "rid", "left").select("doc_id", "n_bytes", "spans", "more", "hits", "body")
    kind = waiting.schema["doc_id"].dataType.simpleString()

    def step():
        expand = zstandard.ZstdDecompressor()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for n, spans, more, hits, body in zip(*(col.to_pylist() for col in batch.columns[1:]), strict=True):
                pairs = list(zip(spans[::2], spans[1::2], strict=True)) + [(m["a"], m["b"]) for m in more or []]
                pairs += [(a, a + length) for starts in hits or [] for a in np.frombuffer(starts, np.int32).tolist()]
                gone, runs, kept = without(expand.decompress(body), merge(pairs))
                out.append((n, gone, runs, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return run

    late = map_slices(waiting, list(waiting.columns), step, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return state.where("kind = 'done'").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").union(late)
