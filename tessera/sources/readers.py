"""Readers: files as rows of binaryFile, and tables of headers, frames, pages, tags and strips made from them.

Each table is one narrow step over the files, so a scan of headers never decodes
a pixel, and filters on path or length reach the file listing. A file that can't
be read gives a row with its error (mode permissive, which keeps what could be
read before it) or fails the query (mode failfast).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.errors import Limits, RasterError, guarded
from tessera.operators.pixels import magic
from tessera.sources import bmp as bmp_
from tessera.sources import gif as gif_
from tessera.sources import schemas as S
from tessera.sources import tiff as tiff_

#: Rows are given on after about so many bytes of pixels.
BATCH_BYTES = 32 << 20
#: Wanted strips or tiles up to which their places are broadcast (a few dozen bytes each).
BROADCAST_CHUNKS = 100_000


def files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content and format of files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).withColumn("format", magic(F.col("content")))


def error_row(path: str, e: RasterError, mode: str) -> dict:
    if mode == "failfast":
        raise RasterError(e.kind, f"{path}: {e.message}")
    return {"path": path, "error": {"kind": e.kind, "message": e.message}}


def batches(rows: Iterator[dict], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def table(source: DataFrame, schema: str, rows: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    """Rows that a function gives for each (path, content)."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ((path.as_py(), content.as_py() or b"") for batch in found for path, content in zip(batch.column(0), batch.column(1), strict=True))
        return batches((row for path, content in files for row in rows(path, content)), arrow)

    return source.select("path", "content").mapInArrow(run, schema)


def gif(source: DataFrame, limits: Limits = Limits(), mode: str = "permissive") -> DataFrame:
    """A row per animation: header, loop count, comments and colour profile."""

    def rows(path: str, data: bytes) -> Iterator[dict]:
        d, e = guarded(gif_.Decoder, data, limits)
        if d is None:
            yield error_row(path, e, mode)
            return
        found, e = guarded(lambda: sum(1 for _ in d))
        i = d.info
        palette = None if i.global_palette is None else [dict(zip("rgb", c, strict=True)) for c in i.global_palette.tolist()]
        out = {"path": path, "version": i.version, "width": i.width, "height": i.height, "global_palette": palette, "background_index": i.background_index, "aspect_ratio": i.aspect_ratio, "loop_count": d.loop_count, "comments": d.comments, "icc_profile": d.icc_profile}
        yield out | (error_row(path, e, mode) if e else {})

    return table(source, S.GIF, rows)


def gif_info(source: DataFrame, mode: str = "permissive") -> DataFrame:
    """Headers alone: version, dimensions and palette; no image is read."""

    def rows(path: str, data: bytes) -> Iterator[dict]:
        i, e = guarded(gif_.read_info, data)
        if e:
            yield error_row(path, e, mode)
            return
        palette = None if i.global_palette is None else [dict(zip("rgb", c, strict=True)) for c in i.global_palette.tolist()]
        yield {"path": path, "version": i.version, "width": i.width, "height": i.height, "global_palette": palette, "background_index": i.background_index, "aspect_ratio": i.aspect_ratio}

    keep = ["path", "version", "width", "height", "global_palette", "background_index", "aspect_ratio", "error"]
    return table(source, S.GIF, rows).select(*keep)


def frame_rows(path: str, data: bytes, limits: Limits, mode: str) -> Iterator[dict]:
    d, e = guarded(gif_.Decoder, data, limits)
    if d is None:
        yield error_row(path, e, mode)
        return
    it, k = iter(d), 0
    while True:
        f, e = guarded(next, it, None)
        if e:
            yield error_row(path, e, mode) | {"frame": k}
            return
        if f is None:
            return
        yield {"path": path, "frame": k, "delay_cs": f.delay_cs, "disposal": f.disposal, "left": f.left, "top": f.top, "w": f.width, "h": f.height, "interlaced": f.interlaced, "user_input": f.user_input, "incomplete": f.incomplete, "rgba": f.rgba.tobytes()}
        k += 1


def frames(source: DataFrame, limits: Limits = Limits(), mode: str = "permissive") -> DataFrame:
    """A row per composited frame, given as it is decoded."""
    return table(source, S.FRAMES, lambda p, d: frame_rows(p, d, limits, mode))


def bmp_fields(i: bmp_.BmpInfo) -> dict:
    out = asdict(i)
    return {k: list(out[k]) if k == "masks" else out[k] for k in S.names(S.BMP_INFO) if k in out}


def bmp_info(source: DataFrame, mode: str = "permissive") -> DataFrame:
    def rows(path: str, data: bytes) -> Iterator[dict]:
        i, e = guarded(bmp_.read_info, data)
        yield error_row(path, e, mode) if e else {"path": path} | bmp_fields(i)

    return table(source, S.BMP_INFO, rows)


def bmp(source: DataFrame, limits: Limits = Limits(), mode: str = "permissive") -> DataFrame:
    def rows(path: str, data: bytes) -> Iterator[dict]:
        i, e = guarded(bmp_.decode, data, limits)
        if e:
            yield error_row(path, e, mode)
        else:
            yield {"path": path, **bmp_fields(i.info), "has_alpha": i.has_alpha, "icc_profile": i.icc_profile, "rgba": i.rgba.tobytes()}

    return table(source, S.BMP, rows)


def page_rows(path: str, data: bytes, limits: Limits, mode: str, pixels: bool, wanted: int | range | None) -> Iterator[dict]:
    t, e = guarded(tiff_.Tiff, data, limits)
    if e:
        yield error_row(path, e, mode)
        return
    wanted = range(wanted, wanted + 1) if isinstance(wanted, int) else wanted or range(len(t.directories))
    for page in range(max(0, wanted.start), min(wanted.stop, len(t.directories))):
        info, e = guarded(t.info, page)
        row = {"path": path, "page": page}
        if e is None:
            row |= asdict(info)
            if pixels:
                image, e = guarded(t.decode, page)
                if e is None:
                    s = image.samples
                    row |= {"color": image.color, "sample_type": image.sample_type, "samples": s.astype(s.dtype.newbyteorder("<")).tobytes(), "premultiplied": image.premultiplied, "incomplete": image.incomplete}
        yield row if e is None else row | error_row(path, e, mode)


def page_info(source: DataFrame, limits: Limits = Limits(), mode: str = "permissive", page: int | None = None) -> DataFrame:
    """A row per page with its fields; no pixel is read."""
    return table(source, S.PAGE_INFO, lambda p, d: page_rows(p, d, limits, mode, False, page))


def pages(source: DataFrame, limits: Limits = Limits(), mode: str = "permissive", page: int | None = None) -> DataFrame:
    """A row per page with its samples; page decodes that one alone."""
    return table(source, S.PAGES, lambda p, d: page_rows(p, d, limits, mode, True, page))


def tags(source: DataFrame, limits: Limits = Limits(), mode: str = "permissive") -> DataFrame:
    def rows(path: str, data: bytes) -> Iterator[dict]:
        t, e = guarded(tiff_.Tiff, data, limits)
        if e:
            yield error_row(path, e, mode)
            return
        for page in range(len(t.directories)):
            found, e = guarded(lambda page=page: list(t.tags(page)))
            if e:
                yield error_row(path, e, mode) | {"page": page}
                continue
            for tag, kind, count, ints, floats, raw in found:
                yield {"path": path, "page": page, "tag": tag, "type": kind, "count": count, "ints": ints, "floats": floats, "raw": raw}

    return table(source, S.TAGS, rows)


def chunks(source: DataFrame, limits: Limits = Limits(), mode: str = "permissive") -> DataFrame:
    """A row per strip or tile: the unit for crops and for pages too large for one task."""

    def rows(path: str, data: bytes) -> Iterator[dict]:
        t, e = guarded(tiff_.Tiff, data, limits)
        if e:
            yield error_row(path, e, mode)
            return
        for page in range(len(t.directories)):
            it = t.chunks(page)
            while True:
                c, e = guarded(next, it, None)
                if e:
                    yield error_row(path, e, mode) | {"page": page}
                if c is None:
                    break
                yield {"path": path, "page": page, **asdict(c)}

    return table(source, S.CHUNKS, rows)


def chunk_pixels(source: DataFrame, wanted: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(path, page, idx, data, incomplete) of the wanted strips or tiles: 64-bit little-endian codes, row by row.

    wanted is a filtered table of chunks; a filter on x0 and y0 there decodes a crop alone.
    Up to BROADCAST_CHUNKS of them are sent to where the files are read, so that contents
    are not shuffled; beyond that each wanted file moves once.
    """
    wanted = wanted.where("error is null")
    asked = wanted.groupBy("path").agg(F.collect_set(F.struct("page", "idx")).alias("idxs"))
    few = wanted.limit(BROADCAST_CHUNKS + 1).count() <= BROADCAST_CHUNKS
    rows = source.select("path", "content").join(F.broadcast(asked) if few else asked, "path")
    schema = f"path string, page int, idx int, data binary, incomplete boolean, {S.ERROR}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, asked in zip(*batch.columns, strict=True):
                t = tiff_.Tiff(content.as_py(), limits)
                pages: dict[int, list[int]] = {}
                for r in asked.as_py():
                    pages.setdefault(r["page"], []).append(r["idx"])
                for page, idxs in sorted(pages.items()):
                    info = t.info(page)
                    for place in t.chunks(page, info, sorted(idxs)):
                        found, e = guarded(t.chunk_rows, page, info, place, info.bits_per_sample[0])
                        data = None if e else found[0].astype("<i8").tobytes()
                        yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "page": page, "idx": place.idx, "data": data, "incomplete": None if e else found[1], "error": {"kind": e.kind, "message": e.message} if e else None}], arrow)

    return rows.select("path", "content", "idxs").mapInArrow(run, schema)


__all__ = ["bmp", "bmp_info", "chunk_pixels", "chunks", "files", "frames", "gif", "gif_info", "page_info", "pages", "tags"]
