"""Media columns: payloads stored as content-defined chunks and read back verified.

A payload is kept as the 8-bit samples of a one-channel PCM file. The file's
samples are cut where a rolling gear hash of the last 64 bytes has zeros under a
mask (between ``least`` and ``most`` bytes), and chunks are named by digest.
Digests that occur in more than one place are counted first. Then texts are read
again and their chunks written: a chunk that occurs once in its entry's row, one
that others have too in a table of its own, once. Every entry's file is made of
chunks read from there by its ordered list of digests, its own and the shared
ones that a join on digests brings; digests of chunks and of the file are checked.

What moves: digests; the bodies of shared chunks, and all chunks of entries that
have some. Texts, and entries without shared chunks, are never shuffled. Which
digests are shared is told by a Bloom filter of at most ``MAX_BITS`` bits; a
chunk that it takes for shared by mistake is stored and found as those are, so
a full filter costs shuffling and no result.

A null text is the empty payload. Payloads are padded with zero bytes to a
positive multiple of 64, and texts of any length are stored whole. Rows without
an id or with a repeated one each get their result. An empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_dealt, map_slices
from .urls import FEW_KEYS, Level, make_level

BLOCK = 64
LEAST, MASK_BITS, MOST = 512, 11, 16_384
RATE = 8000
#: Bits of the filter of shared digests, 64 MB, and the share of other chunks that it takes for shared while it has room.
MAX_BITS, FALSE_RATE = 1 << 29, 0.01
RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
FIELDS = [x.split()[0] for x in RESULT.split(", ")]


def gear() -> np.ndarray:
    """A fixed random number for each byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


_GEAR = gear()


def cuts(data: bytes, least: int = LEAST, mask_bits: int = MASK_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    if n <= least:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in range(6):  # sums over the last 2, 4, .. 64 bytes, older ones shifted further
        step = 1 << k
        h[step:] += h[:-step] << np.uint64(step)
    places = (np.flatnonzero(h >> np.uint64(64 - mask_bits) == 0) + 1).tolist()
    out, start = [], 0
    for p in [*places, n]:
        while p - start > most:
            start += most
            out.append(start)
        if p - start >= least and p < n:
            out.append(p)
            start = p
    if start < n:
        out.append(n)
    return out


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def header(n: int) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def samples(media: bytes) -> bytes:
    """The payload of a stored file, by the sizes that its header declares."""
    magic, _, kind, fmt, size, code, channels, _, _, _, bits, name, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (magic, kind, fmt, size, code, channels, bits, name) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 8, b"data") or len(media) != 44 + n:
        raise ValueError("not a stored payload")
    return media[44 : 44 + n]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def split(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def read_back(n_bytes: int, digests: list[bytes], chunks: list[bytes]) -> tuple:
    """Result of an entry: its file from the ordered chunks, checked, and the features of its samples."""
    for d, c in zip(digests, chunks, strict=True):
        if digest(c) != d:
            raise ValueError("a chunk differs from its digest")
    body = b"".join(chunks)
    media = header(len(body)) + body
    data = samples(media)
    x = np.frombuffer(data, np.uint8).astype(np.float64) - 128.0
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    feature = f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings}"
    return n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature


def recipes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, digests, media_sha256) of every row; key names the payload."""

    def step():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, lists, media = [], [], []
            for x in batch.column(1):
                n, data = payload(x.as_py())
                keys.append(hashlib.sha256(n.to_bytes(8, "little") + data).digest())
                lists.append([digest(c) for c in split(data)])
                media.append(hashlib.sha256(header(len(data)) + data).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.binary())), pa.array(media)], ["doc_id", "key", "digests", "stored_sha256"])

        return run

    return map_slices(docs, [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")], step, "doc_id long, key binary, digests array<binary>, stored_sha256 string")


def payloads(docs: DataFrame, text: str) -> DataFrame:
    """The texts that are stored, one a row of docs."""
    return docs.select(F.col(text).alias("text"))


def places(found: DataFrame) -> DataFrame:
    """(digest, n) of the chunks that are in more than one place, and of all chunks of payloads given more than once."""
    return found.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")


def shared_filter(shared: DataFrame) -> Level | None:
    """Filter of the digests of a written table; their halves are its two hashes."""
    n = shared.count()
    if not n:
        return None
    rate = max(FALSE_RATE, 2.0 ** (-MAX_BITS * math.log(2) / n))
    if n <= FEW_KEYS:
        keys = halves([r.digest for r in shared.select("digest").collect()])
    else:
        keys = shared.select(*(F.conv(F.hex(F.substring("digest", at, 8)), 16, -10).cast("long").alias(f"h{k}") for k, at in ((1, 1), (2, 9))))
    return make_level(keys, n, 0, rate, MAX_BITS + 64)


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return h[:, 0].copy(), h[:, 1].copy()


def store(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """Stored chunks, in rows of kind whole (an entry with all its chunks in order), own and want (chunks of other entries, stored there and elsewhere), and export (those stored elsewhere)."""
    schema = "kind string, key binary, n_bytes long, idx int, digest binary, body binary, digests array<binary>, bodies array<binary>"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    level = shared_filter(shared)

    def step():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            entries = []
            for x in batch.column(0):
                n, data = payload(x.as_py())
                chunks = split(data)
                entries.append((hashlib.sha256(n.to_bytes(8, "little") + data).digest(), n, [digest(c) for c in chunks], chunks))
            names_of = [d for e in entries for d in e[2]]
            common = level.passes(*halves(names_of)) if level else np.zeros(len(names_of), bool)
            out: list[tuple] = []
            exported: set[bytes] = set()
            at = 0
            for key, n, digests, chunks in entries:
                elsewhere = common[at : at + len(digests)].tolist()
                at += len(digests)
                if not any(elsewhere):
                    out.append(("whole", key, n, None, None, None, digests, chunks))
                    continue
                for i, (d, c, away) in enumerate(zip(digests, chunks, elsewhere, strict=True)):
                    out.append(("want" if away else "own", key, n, i, d, None if away else c, None, None))
                    if away and d not in exported:
                        exported.add(d)
                        out.append(("export", None, None, None, d, c, None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        return run

    return map_slices(texts, ["text"], step, schema)


def reconstruct(ws: Workspace, stored: DataFrame) -> DataFrame:
    """(key, result) of all entries, from their stored chunks."""
    chunks = stored.where("kind = 'export'").groupBy("digest").agg(F.first("body").alias("body"), F.count("*").alias("n"))
    wants = stored.where("kind = 'want'").select("key", "n_bytes", "idx", "digest").distinct()  # of equal payloads once
    wants = ws.save(wants, "wants")
    chunks = ws.save(chunks.drop("n").join(wants.groupBy("digest").agg(F.count("*").alias("n")), "digest"), "shared-chunks")
    got = join_dealt(wants, chunks, ["digest"], "n").select("key", "n_bytes", "idx", "digest", "body")
    own = stored.where("kind = 'own'").select("key", "n_bytes", "idx", "digest", "body")
    lists = own.union(got).groupBy("key").agg(F.first("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("idx", "digest", "body"))).alias("chunks"))
    lists = lists.select("key", "n_bytes", F.col("chunks.digest").alias("digests"), F.col("chunks.body").alias("bodies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key.as_py(), *read_back(n.as_py(), digests.as_py(), bodies.as_py())) for key, n, digests, bodies in zip(*batch.columns, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out_column, t) for out_column, t in zip(zip(*out, strict=True), types, strict=True)], ["key", *FIELDS])

    types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    whole = stored.where("kind = 'whole'").select("key", "n_bytes", "digests", "bodies")
    return whole.union(lists).mapInArrow(run, f"key binary, {RESULT}")


def chunked_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the read-back result and n_chunks of every row; fails if a file read back differs from the one stored."""
    ws = Workspace(docs.sparkSession, "media")
    found = ws.save(recipes(docs, doc_id, text), "recipes")
    stored = ws.save(store(payloads(docs, text), ws.save(places(found), "shared")), "store")
    out = found.select("doc_id", "key", F.size("digests").alias("n_chunks"), "stored_sha256").join(reconstruct(ws, stored), "key", "left")
    same = F.coalesce(F.col("stored_sha256") == F.col("media_sha256"), F.lit(False))
    checked = F.when(same, F.col("media_sha256")).otherwise(F.raise_error(F.lit("a stored file was not read back whole")).cast("string"))
    return out.withColumn("media_sha256", checked).select("doc_id", *FIELDS, "n_chunks")
