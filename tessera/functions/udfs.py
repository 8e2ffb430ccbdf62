"""Codecs and encoders as Arrow functions of columns, and table functions for SQL.

``register(spark)`` makes all of them callable from SQL under their own names.
A codec column is null where its input is null or cannot be decoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.types import BinaryType, StringType

from tessera.errors import Limits, RasterError, guarded
from tessera.functions import codecs, fax
from tessera.sources import bmp, gif, readers, schemas, tiff


TYPES = {"binary": BinaryType(), "string": StringType()}


def rowwise(kind: str, f: Callable, failfast: bool = False):
    """Arrow function that applies f to each row's values; null in, null out."""
    out = {"binary": pa.binary(), "string": pa.string()}[kind]

    def run(batches: Iterator) -> Iterator[pa.Array]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            values = []
            for row in zip(*columns, strict=True):
                row = [x.as_py() for x in row]
                if any(x is None for x in row):
                    values.append(None)
                    continue
                value, error = guarded(f, *row)
                if error is not None and failfast:
                    raise error
                values.append(value)
            yield pa.array(values, out)

    return run


def one(f: Callable, kind: str = "binary", failfast: bool = False):
    run = rowwise(kind, f, failfast)

    @arrow_udf(TYPES[kind])
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    return column


def many(f: Callable, kind: str = "binary", failfast: bool = False):
    run = rowwise(kind, f, failfast)

    @arrow_udf(TYPES[kind])
    def column(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return run(batches)

    return column


gif_lzw_encode = one(lambda data: codecs.gif_lzw_encode(8, data))
gif_lzw_decode = many(lambda data, limit: codecs.gif_lzw_decode(8, data, limit)[0])
tiff_lzw_encode = one(codecs.tiff_lzw_encode)
tiff_lzw_decode = many(codecs.tiff_lzw_decode)
packbits_encode = one(codecs.packbits_encode)
packbits_decode = many(codecs.packbits_decode)
deflate = one(codecs.deflate)
inflate = many(codecs.inflate)
reverse_bits = one(codecs.reverse_bits)
fax_decode = many(fax.fax_decode)
fax_encode = many(lambda bits, width, height, scheme: fax.fax_encode(np.unpackbits(np.frombuffer(bits, np.uint8).reshape(height, -1), axis=1)[:, :width], scheme))


def rgba(data: bytes, width: int, height: int) -> np.ndarray:
    if len(data) != width * height * 4:
        raise RasterError("BadInput", "pixels do not fit the dimensions")
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)


bmp_encode = many(lambda data, width, height, fmt: bmp.encode(rgba(data, width, height), fmt), failfast=True)
bmp_encode_indexed = many(lambda index, width, height, palette, bits: bmp.encode_indexed(np.frombuffer(index, np.uint8).reshape(height, width), np.frombuffer(palette, np.uint8).reshape(-1, 3), bits), failfast=True)


def gif_encoder(options: gif.EncodeOptions):
    """Function of (RGBA, width, height) that writes a file of one image with the given options."""
    return many(lambda data, width, height: gif.encode(rgba(data, width, height), options), failfast=True)


gif_encode = many(lambda data, width, height: gif.encode(rgba(data, width, height)), failfast=True)
bmp_decode = one(lambda data: bmp.decode(data).rgba.tobytes())
gif_first_frame = one(lambda data: next(iter(gif.Decoder(data))).rgba.tobytes())
tiff_rgba = many(lambda data, page: tiff.Tiff(data).decode(page).to_rgba8_upright().tobytes())


def tiff_encode(samples: Column, width: Column, height: Column, pixel_format: str, options: tiff.EncodeOptions = tiff.EncodeOptions()) -> Column:
    """File of one page from packed little-endian samples."""
    channels, kind, _, _ = tiff.PIXEL_FORMATS[pixel_format]
    return many(lambda data, w, h: tiff.encode(np.frombuffer(data, f"<{kind}").reshape(h, w, channels).astype(kind), pixel_format, options), failfast=True)(samples, width, height)


def grey_rgba(samples: Column) -> Column:
    """Opaque RGBA of packed grey samples."""
    return one(lambda d: np.concatenate([np.repeat(np.frombuffer(d, np.uint8)[:, None], 3, 1), np.full((len(d), 1), 255, np.uint8)], 1).tobytes())(samples)


def encode_animations(frames: DataFrame, animation: str, options: gif.EncodeOptions = gif.EncodeOptions()) -> DataFrame:
    """(animation, content) from rows (animation, frame, width, height, delay_cs, rgba); frames in order of frame.

    The file is written frame after frame with its canvas as state, so each
    animation is one task's work.
    """
    kind = frames.schema[animation].dataType.simpleString()

    def write(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["frame"])
        content = gif.encode_frames([(rgba(r["rgba"], r["width"], r["height"]), r["delay_cs"]) for r in rows], options)
        return pa.table({animation: pa.array([rows[0][animation]], table.schema.field(animation).type), "content": pa.array([content], pa.binary())})

    return frames.select(animation, "frame", "width", "height", "delay_cs", "rgba").groupBy(animation).applyInArrow(write, f"{animation} {kind}, content binary")


def encode_pages(pages: DataFrame, document: str, pixel_format: str, options: tiff.EncodeOptions = tiff.EncodeOptions()) -> DataFrame:
    """(document, content) of files with several pages from rows (document, page, width, height, samples)."""
    kind = pages.schema[document].dataType.simpleString()
    channels, sample, _, _ = tiff.PIXEL_FORMATS[pixel_format]

    def write(table: pa.Table) -> pa.Table:
        e = tiff.Encoder(options)
        rows = sorted(table.to_pylist(), key=lambda r: r["page"])
        for r in rows:
            e.add_page(np.frombuffer(r["samples"], f"<{sample}").reshape(r["height"], r["width"], channels).astype(sample), pixel_format)
        return pa.table({document: pa.array([rows[0][document]], table.schema.field(document).type), "content": pa.array([e.finish()], pa.binary())})

    return pages.select(document, "page", "width", "height", "samples").groupBy(document).applyInArrow(write, f"{document} {kind}, content binary")


@udtf(returnType=schemas.FRAMES.replace("path string, ", ""))
class GifFrames:
    """Frames of an animation: SELECT f.* FROM files, LATERAL gif_frames(content) f."""

    def eval(self, content: bytes):
        for row in readers.frame_rows("", bytes(content), Limits(), "permissive"):
            yield tuple(row.get(c) if c != "error" else error(row) for c in schemas.names(schemas.FRAMES)[1:])


@udtf(returnType=schemas.PAGE_INFO.replace("path string, ", ""))
class TiffPages:
    """Fields of a file's pages."""

    def eval(self, content: bytes):
        for row in readers.page_rows("", bytes(content), Limits(), "permissive", False, None):
            yield tuple(row.get(c) if c != "error" else error(row) for c in schemas.names(schemas.PAGE_INFO)[1:])


@udtf(returnType="page int, tag int, type int, count bigint, ints array<bigint>, floats array<double>, raw binary")
class TiffTags:
    def eval(self, content: bytes):
        t, e = guarded(tiff.Tiff, bytes(content))
        for page in range(len(t.directories)) if e is None else ():
            for row in t.tags(page):
                yield page, *row


def error(row: dict):
    e = row.get("error")
    return (e["kind"], e["message"]) if e else None


COLUMNS = {
    "gif_lzw_encode": gif_lzw_encode, "gif_lzw_decode": gif_lzw_decode, "tiff_lzw_encode": tiff_lzw_encode, "tiff_lzw_decode": tiff_lzw_decode, "packbits_encode": packbits_encode, "packbits_decode": packbits_decode,
    "zlib_deflate": deflate, "zlib_inflate": inflate, "reverse_bits": reverse_bits, "fax_decode": fax_decode, "fax_encode": fax_encode, "bmp_encode": bmp_encode, "bmp_decode": bmp_decode, "gif_encode": gif_encode, "gif_first_frame": gif_first_frame, "tiff_rgba": tiff_rgba,
}
TABLES = {"gif_frames": GifFrames, "tiff_pages": TiffPages, "tiff_tags": TiffTags}


def register(spark: SparkSession) -> None:
    for name, f in COLUMNS.items():
        spark.udf.register(name, f)
    for name, f in TABLES.items():
        spark.udtf.register(name, f)


__all__ = ["encode_animations", "encode_pages", "register", "tiff_encode"]
