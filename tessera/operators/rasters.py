"""Aggregations, ordered operators and lookups over tables of pixels, frames, tags and strips.

A table of pixels has a row per sample: the columns that name its image, y, x and
values. Nothing here needs an image to fit in one task, except where a fold over
frames or a palette is the operator itself; those work on one image at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.colours import median_cut, nearest_by_grid
from tessera.operators.pixels import idiv, long, pack_rgb, unpack_rgb

MAX_PALETTE = 256
#: Entries of 16-bit indices, the most that a file's palette has.
BROADCAST_COLOURS = 1 << 16
#: Numbers that one row makes at a time where a page is cut into strips or tiles.
CHUNKS_AT_A_TIME = 1 << 16
#: Logarithm of the registers of a sketch of distinct colours.
SKETCH_BITS = 12
#: Samples that are moved between strips or tiles and blocks at a time; a larger block is a batch of its own.
BATCH_SAMPLES = 1 << 20
#: Samples of a row that are summed in one piece.
ROW_BLOCK = 1 << 16


# --- predictors and runs ----------------------------------------------------------------------------


def apply_predictor(pixels: DataFrame, row: Sequence[str], x: str, value: str, bits: int, out: str) -> DataFrame:
    w = Window.partitionBy(*row).orderBy(x)
    return pixels.withColumn(out, F.pmod(F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)), F.lit(1 << bits)).cast("long"))


def undo_predictor(pixels: DataFrame, row: Sequence[str], x: str, value: str, bits: int, out: str, block: int = ROW_BLOCK) -> DataFrame:
    """Running sums along each row, in blocks of a row: sums of blocks are added up and given back to where the block is summed."""
    at = idiv(F.col(x), block).alias("__block")
    sums = pixels.groupBy(*row, at).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*row).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"__row_{c}") for c in row), F.col("__block").alias("__of"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*row, "__block").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    rows = pixels.withColumn("__block", at).withColumn("__within", F.sum(value).over(inside))
    same = [F.col(c).eqNullSafe(F.col(f"__row_{c}")) for c in row] + [F.col("__block") == F.col("__of")]
    rows = rows.join(starts, same).withColumn(out, F.pmod(F.col("__start") + F.col("__within"), F.lit(1 << bits)).cast("long"))
    return rows.drop("__block", "__within", "__of", "__start", *(f"__row_{c}" for c in row))


def runs(pixels: DataFrame, row: Sequence[str], x: str, value: str) -> DataFrame:
    """(row columns, start, length, value) of the runs of equal values along each row."""
    w = Window.partitionBy(*row).orderBy(x)
    new = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    marked = pixels.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*row, "__run").agg(F.min(x).cast("long").alias("start"), F.count("*").alias("length"), F.first(value).alias("value")).drop("__run")


def expand_runs(found: DataFrame) -> DataFrame:
    """A row per sample again."""
    return found.withColumn("x", F.explode(F.expr("sequence(start, start + length - 1)"))).drop("start", "length")


# --- colours ----------------------------------------------------------------------------------------


def histogram(pixels: DataFrame, colours: Sequence[str], image: Sequence[str] = ()) -> DataFrame:
    return pixels.groupBy(*image, *colours).agg(F.least(F.count("*"), F.lit(0xFFFFFFFF)).alias("n"))


def distinct_colours(pixels: DataFrame, colours: Sequence[str], image: Sequence[str] = ()) -> DataFrame:
    return pixels.groupBy(*image).agg(F.countDistinct(*colours).alias("colours"))


def colour_sketches(pixels: DataFrame, colours: Sequence[str], image: Sequence[str]) -> DataFrame:
    """(image, sketch): what distinct colours of any number of images are told from, in a few kilobytes an image."""
    return pixels.groupBy(*image).agg(F.hll_sketch_agg(F.xxhash64(*colours), F.lit(SKETCH_BITS)).alias("sketch"))


def merged_colours(sketches: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, colours): distinct colours of the images of each group together, without reading pixels again.

    The standard error is 0.83 / 2 ** (SKETCH_BITS / 2) of the count, 1.3 %.
    """
    return sketches.groupBy(*group).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("colours"))


def exact_palette(counts: DataFrame, colour: str, image: Sequence[str], most: int = MAX_PALETTE, weight: str = "n") -> DataFrame:
    """(image, i, colour) ascending: the colours of an image of at most so many, else the median cut of its packed colours."""
    keyed = counts.withColumn("__all", F.lit(0))  # a key also where there are no image columns
    sized = keyed.join(keyed.groupBy(*image, "__all").agg(F.count("*").alias("__n")), [*image, "__all"])
    few, more = sized.where(F.col("__n") <= most), sized.where(F.col("__n") > most)
    w = Window.partitionBy(*image).orderBy(colour)
    ranked = few.withColumn("i", (F.row_number().over(w) - 1).cast("long")).select(*image, "i", colour)
    r, g, b = unpack_rgb(F.col(colour))
    cut = median_cut(more.select(*image, r.alias("r"), g.alias("g"), b.alias("b"), F.col(weight).alias("n")), image, most)
    return ranked.union(cut.select(*image, "i", pack_rgb(F.col("r"), F.col("g"), F.col("b")).cast(counts.schema[colour].dataType).alias(colour)))


def first_seen(pixels: DataFrame, image: Sequence[str], order: Sequence[str], colour: str) -> DataFrame:
    """(image, colour, i): colours numbered by first use."""
    first = pixels.groupBy(*image, colour).agg(F.min(F.struct(*order)).alias("__at"))
    w = Window.partitionBy(*image).orderBy("__at")
    return first.withColumn("i", (F.row_number().over(w) - 1).cast("long")).drop("__at")


def nearest(colours: DataFrame, channels: Sequence[str], palette: Sequence[Sequence[int]], out: str = "i") -> DataFrame:
    """Index of the closest entry of a palette, the first of equals; no join up to 256 entries, a grid beyond."""
    if not palette:
        raise ValueError("palette size")
    if len(palette) > MAX_PALETTE:
        entries = colours.sparkSession.createDataFrame([(i, *map(int, p)) for i, p in enumerate(palette)], ", ".join(["i long", *(f"{c} long" for c in channels)]))
        return nearest_by_grid(colours, channels, entries, out)
    entries = F.array(*(F.struct(*(F.lit(int(v)).alias(f"c{k}") for k, v in enumerate(p)), F.lit(i).cast("long").alias("i")) for i, p in enumerate(palette)))

    def distance(p: Column) -> Column:
        terms = [(long(F.col(c)) - p[f"c{k}"]) * (long(F.col(c)) - p[f"c{k}"]) for k, c in enumerate(channels)]
        return F.struct(sum(terms[1:], terms[0]).alias("d"), p["i"].alias("i"))

    return colours.withColumn(out, F.array_min(F.transform(entries, distance))["i"])


def map_colours(pixels: DataFrame, channels: Sequence[str], palette: Sequence[Sequence[int]], out: str = "i") -> DataFrame:
    """Nearest entries of all pixels: each distinct colour is matched once, then joined back."""
    return pixels.join(nearest(pixels.select(*channels).distinct(), channels, palette, out), list(channels))


def palette_lookup(pixels: DataFrame, index: str, local: DataFrame, common: DataFrame | None, image: Sequence[str], columns: Sequence[str], default: int | None = None) -> DataFrame:
    """Colours of indices from the image's own palette, else the common one, else the default.

    local has (image, i, columns). The common palette is sent to every task if it
    has at most BROADCAST_COLOURS rows, as those of files do, and joined otherwise.
    """
    own = local.select(*image, F.col("i").alias(index), *(F.col(c).alias(f"__own_{c}") for c in columns))
    out = pixels.join(own, [*image, index], "left")
    if common is not None:
        rest = common.select(F.col("i").alias(index), *(F.col(c).alias(f"__all_{c}") for c in columns))
        few = rest.limit(BROADCAST_COLOURS + 1).count() <= BROADCAST_COLOURS
        out = out.join(F.broadcast(rest) if few else rest, index, "left")
    for c in columns:
        options = [F.col(f"__own_{c}"), *([F.col(f"__all_{c}")] if common is not None else []), *([F.lit(default)] if default is not None else [])]
        out = out.withColumn(c, F.coalesce(*options))
    return out.drop(*(f"__{p}_{c}" for c in columns for p in ("own", "all")))


def weighted_mean(counts: DataFrame, colours: Sequence[str], weight: str, group: Sequence[str]) -> DataFrame:
    """Mean colour of each group, halves rounded up."""
    n = F.sum(weight)
    return counts.groupBy(*group).agg(*(idiv(F.sum(F.col(c) * F.col(weight)) + idiv(n, 2), n).alias(c) for c in colours))


# --- frames -----------------------------------------------------------------------------------------


def changed(pixels: DataFrame, animation: Sequence[str], frame: str, value: str) -> DataFrame:
    """Pixels that differ from the frame before; all pixels of first frames."""
    w = Window.partitionBy(*animation, "y", "x").orderBy(frame)
    return pixels.withColumn("__before", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("__before"))).drop("__before")


def bounding_box(pixels: DataFrame, group: Sequence[str]) -> DataFrame:
    """(left, top, right, bottom), the latter two exclusive."""
    return pixels.groupBy(*group).agg(F.min("x").cast("long").alias("left"), F.min("y").cast("long").alias("top"), (F.max("x") + 1).cast("long").alias("right"), (F.max("y") + 1).cast("long").alias("bottom"))


def viewer_frames(frames: DataFrame, animation: Sequence[str], order: Sequence[str], delay: str) -> DataFrame:
    """Frames that a viewer shows: images without delay merge into the next that has one; the last is shown."""
    w = Window.partitionBy(*animation).orderBy(*order)
    return frames.withColumn("__next", F.lead(F.lit(1)).over(w)).where((F.col(delay) > 0) | F.col("__next").isNull()).drop("__next")


def composite(frames: DataFrame, animation: str, width: int, height: int) -> DataFrame:
    """(animation, frame, y, x, value) of the visible pixels of patches drawn one after the other onto a canvas.

    frames has animation, frame, left, top, w, h, disposal (0 to 3) and index (binary of
    w * h values, 0 transparent). Each pixel is a scan of its own over the patches that
    cover it: what a patch leaves there is its value, nothing where it is cleared
    afterwards, and what was there where it is transparent or taken back; so what a
    frame is drawn on is the last thing left before it. Between patches a pixel stays.
    """
    order = Window.partitionBy(animation).orderBy("frame")
    numbered = frames.select(animation, "frame").withColumn("__k", F.row_number().over(order))
    numbered = numbered.join(numbered.groupBy(animation).agg(F.max("__k").alias("__last")), animation)
    rows = frames.where("w > 0 and h > 0").join(numbered, [animation, "frame"]).withColumn("__y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    line = F.hex(F.substring("index", (F.col("__y") * F.col("w") + 1).cast("int"), F.col("w").cast("int")))
    rows = rows.select(animation, "__k", "__last", "disposal", "left", (F.col("top") + F.col("__y")).cast("long").alias("y"), line.alias("__line")).where(F.col("y").between(0, height - 1))
    values = F.transform(F.sequence(F.lit(0), (F.length("__line") / 2).cast("int") - 1), lambda i: F.conv(F.substring(F.col("__line"), (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    px = rows.select(animation, "__k", "__last", "disposal", "left", "y", F.posexplode(values).alias("__x", "__v"))
    px = px.withColumn("x", (F.col("left") + F.col("__x")).cast("long")).where(F.col("x").between(0, width - 1))
    pixel = Window.partitionBy(animation, "y", "x").orderBy("__k")
    leaves = F.when(F.col("disposal") == 2, F.lit(0).cast("long")).when((F.col("disposal") != 3) & (F.col("__v") > 0), F.col("__v"))
    last = lambda end: F.coalesce(F.last(leaves, ignorenulls=True).over(pixel.rowsBetween(Window.unboundedPreceding, end)), F.lit(0).cast("long"))
    px = px.select(animation, "y", "x", "__k", "__last", "__v", last(-1).alias("__under"), last(0).alias("__after"), F.lead("__k").over(pixel).alias("__next"))
    shown = px.select(animation, "__k", "y", "x", F.when(F.col("__v") > 0, F.col("__v")).otherwise(F.col("__under")).alias("value"))
    until = F.coalesce(F.col("__next") - 1, F.col("__last"))
    stays = px.where((F.col("__after") > 0) & (until > F.col("__k"))).select(animation, F.explode(F.sequence(F.col("__k") + 1, until)).alias("__k"), "y", "x", F.col("__after").alias("value"))
    return shown.where("value > 0").union(stays).join(numbered.select(animation, "__k", "frame"), [animation, "__k"]).select(animation, "frame", "y", "x", "value")


def quality(pairs: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """(psnr, max_diff, mean_diff) of two values of each pixel."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    mse = F.avg(d * d)
    return pairs.groupBy(*group).agg(F.when(mse > 0, 10 * F.log10(255.0 * 255.0 / mse)).alias("psnr"), F.max(F.abs(d)).alias("max_diff"), F.avg(F.abs(d)).alias("mean_diff"))


def any_pixel(pixels: DataFrame, predicates: dict[str, Column], group: Sequence[str]) -> DataFrame:
    """Whether some pixel of each group meets each named predicate."""
    return pixels.groupBy(*group).agg(*(F.bool_or(p).alias(name) for name, p in predicates.items()))


# --- tags and strips --------------------------------------------------------------------------------


def page_fields(tags: DataFrame) -> DataFrame:
    """A row per page from the table of tags, with the defaults of the format."""
    one = lambda tag: F.max(F.when(F.col("tag") == tag, F.element_at("ints", 1)))
    rows = tags.where(F.size(F.coalesce("ints", F.array().cast("array<bigint>"))) > 0).groupBy("path", "page").agg(
        one(256).alias("width"), one(257).alias("height"), F.max(F.when(F.col("tag") == 258, F.col("ints"))).alias("bits_per_sample"), one(259).alias("compression"), one(262).alias("photometric"),
        one(277).alias("samples_per_pixel"), one(278).alias("rows_per_strip"), one(284).alias("planar"), one(317).alias("predictor"), one(274).alias("orientation"), one(322).alias("tile_w"), one(323).alias("tile_h"), one(339).alias("sample_format"),
    )
    defaults = {"compression": 1, "samples_per_pixel": 1, "planar": 1, "predictor": 1, "orientation": 1, "sample_format": 1}
    for c, v in defaults.items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v)).cast("long"))
    photometric = F.when(F.col("compression").isin(2, 3, 4), 0).when(F.col("samples_per_pixel") >= 3, 2).otherwise(1)
    rows = rows.withColumn("photometric", F.coalesce("photometric", photometric).cast("long"))
    rows = rows.withColumn("bits_per_sample", F.coalesce("bits_per_sample", F.array(F.lit(1).cast("long"))))
    return rows.withColumn("rows_per_strip", F.coalesce(F.least("rows_per_strip", "height"), F.col("height")))


def enumerate_chunks(pages: DataFrame) -> DataFrame:
    """A row per strip or tile (plane, idx, x0, y0, width, rows) of pages of any size: first runs of numbers are made, then their numbers."""
    tiled = F.col("tile_w").isNotNull() & F.col("tile_h").isNotNull()
    cw, ch = F.when(tiled, F.col("tile_w")).otherwise(F.col("width")), F.when(tiled, F.col("tile_h")).otherwise(F.col("rows_per_strip"))
    planes = F.when(F.col("planar") == 2, F.col("samples_per_pixel")).otherwise(F.lit(1)).cast("long")
    rows = pages.withColumn("__cw", long(cw)).withColumn("__ch", long(ch)).withColumn("__planes", planes)
    rows = rows.withColumn("__across", idiv(F.col("width") + F.col("__cw") - 1, F.col("__cw"))).withColumn("__down", idiv(F.col("height") + F.col("__ch") - 1, F.col("__ch")))
    per = F.col("__across") * F.col("__down")
    last = per * F.col("__planes") - 1
    rows = rows.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(CHUNKS_AT_A_TIME).cast("long"))))
    rows = rows.withColumn("idx", F.explode(F.sequence("__from", F.least(F.col("__from") + CHUNKS_AT_A_TIME - 1, last))))
    place = F.col("idx") % per
    rows = rows.withColumn("plane", idiv(F.col("idx"), per)).withColumn("x0", (place % F.col("__across")) * F.col("__cw")).withColumn("y0", idiv(place, F.col("__across")) * F.col("__ch"))
    rows = rows.withColumn("chunk_width", F.col("__cw")).withColumn("chunk_rows", F.when(tiled, F.col("__ch")).otherwise(F.least(F.col("__ch"), F.col("height") - F.col("y0"))))
    return rows.drop("__cw", "__ch", "__planes", "__across", "__down", "__from")


def locate_chunks(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """Offsets and sizes of strips or tiles; those without a place keep nulls.

    chunks are those of page_fields. A size that the file does not give is the stored size
    of uncompressed samples, and null of compressed ones, which then run to the end of the file.
    """
    listed = tags.where(F.col("tag").isin(273, 279, 324, 325)).select("path", "page", "tag", F.posexplode("ints").alias("idx", "value"))
    value = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("value"))).alias(f"__{tag}")
    places = listed.groupBy("path", "page", F.col("idx").cast("long").alias("idx")).agg(*map(value, (273, 279, 324, 325)))
    own = tags.where("tag = 324").select("path", "page", F.lit(True).alias("__own")).distinct()
    rows = chunks.join(places, ["path", "page", "idx"], "left").join(own, ["path", "page"], "left")
    tiled = F.col("tile_w").isNotNull() & F.col("tile_h").isNotNull() & F.col("__own").isNotNull()
    for out, t, strip in (("offset", "__324", "__273"), ("byte_count", "__325", "__279")):
        rows = rows.withColumn(out, F.when(tiled, F.col(t)).otherwise(F.col(strip)))
    channels = F.when(F.col("planar") == 2, 1).otherwise(F.col("samples_per_pixel"))
    stored = F.col("chunk_rows") * idiv(F.col("chunk_width") * channels * F.element_at("bits_per_sample", 1) + 7, 8)
    rows = rows.withColumn("byte_count", F.coalesce("byte_count", F.when(F.col("offset").isNotNull() & (F.col("compression") == 1), stored)))
    return rows.drop("__own", "__273", "__279", "__324", "__325")


def first_error(chunks: DataFrame, group: Sequence[str]) -> DataFrame:
    """The error of the first strip or tile that has one."""
    return chunks.where("error is not null").groupBy(*group).agg(F.min_by("error", "idx").alias("error"))


def progressions(start: np.ndarray, step: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + step and so on, count numbers of each, one after the other."""
    first = np.cumsum(count) - count
    if np.ndim(step) == 0 and step == 1:
        return np.repeat(start - first, count) + np.arange(count.sum())
    return np.repeat(start, count) + (np.arange(count.sum()) - np.repeat(first, count)) * np.repeat(step, count)


def stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of neighbours that hold at most so much together; a larger one is alone."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + most, "right")))
        yield start, end
        start = end


def begins(columns: Sequence[pa.Array]) -> np.ndarray:
    """Whether each row differs from the row before it; the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        if pa.types.is_nested(c.type):
            values = c.to_pylist()
            new[1:] |= np.fromiter((a != b for a, b in pairwise(values)), bool, max(len(values) - 1, 0))
        else:
            codes = c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
    return new


def flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each value, samples of all values one after the other) of a binary column without nulls, not copied."""
    offsets = np.frombuffer(column.buffers()[1], "<i8" if pa.types.is_large_binary(column.type) else "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if (offsets[1:] - offsets[:-1]).max(initial=0) == 0:
        return np.zeros(len(column), np.int64), np.empty(0, kind)
    return np.diff(offsets), np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def binaries(samples: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of samples that are cut at ends."""
    offsets = pa.array(np.concatenate([[0], ends]) * samples.itemsize, pa.int32())  # fails beyond what a column holds
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets.buffers()[1], pa.py_buffer(samples.view(np.uint8))])


def retile(chunks: DataFrame, block_w: int, block_h: int, group: Sequence[str] = ("path", "page"), sample_bytes: int = 8) -> DataFrame:
    """(group, bx, by, x0, y0, w, h, channels, samples) of pages in blocks of another size than their strips or tiles.

    chunks are those of enumerate_chunks with data (samples of sample_bytes, row by row).
    A piece is cut out of a chunk for each block that it reaches into and sent to that
    block, so no task holds more than a block's pieces, whatever a page's size; what is
    missing stays zero, and what lies beyond the page is cut off. Pieces of one block that
    a task has at hand together travel as one row, and samples are moved by their places,
    those of many pieces at once.
    """
    k = len(group)
    kinds = [f"{c} {chunks.schema[c].dataType.simpleString()}" for c in group]
    names = [*group, "bx", "by", "x0", "y0", "w", "h", "channels"]
    key = ", ".join([*kinds, *(f"{c} int" for c in names[k:])])
    rows = chunks.select(*group, *(long(F.col(c)).alias(c) for c in ("plane", "x0", "y0", "chunk_width", "chunk_rows", "width", "height", "samples_per_pixel")), "data")
    kind = np.dtype(f"V{sample_bytes}")

    def cut(batches):
        for batch in batches:
            if batch.columns[-1].null_count:  # a filter in the plan would make data twice where it is an expression
                batch = batch.filter(batch.columns[-1].is_valid())
            if not batch.num_rows:
                continue
            plane, x0, y0, cw, ch, width, height, channels = (c.to_numpy() for c in batch.columns[k:-1])
            page = np.cumsum(begins(batch.columns[:k])) if k else np.zeros(batch.num_rows, np.int64)
            sizes, data = flat(batch.columns[-1], kind)
            per = cw * ch * sample_bytes
            inner = sizes // np.maximum(per, 1)
            if ((per < 1) | (inner * per != sizes) | (inner != 1) & (inner != channels)).any():
                raise ValueError("samples of a strip or tile")
            data, sizes = data.view(kind), sizes // sample_bytes
            at = np.cumsum(sizes) - sizes
            right, bottom = np.minimum(x0 + cw, width), np.minimum(y0 + ch, height)
            inside = (right > x0) & (bottom > y0) & ((inner == channels) | (plane >= 0) & (plane < channels))
            across, down = (right - 1) // block_w - x0 // block_w + 1, (bottom - 1) // block_h - y0 // block_h + 1
            reached = np.where(inside, across * down, 0)
            for i, j in stretches(sizes, BATCH_SAMPLES):
                of = np.repeat(np.arange(i, j), reached[i:j])
                nth = progressions(np.zeros(j - i, np.int64), 1, reached[i:j])
                bx, by = x0[of] // block_w + nth % across[of], y0[of] // block_h + nth // across[of]
                order = np.lexsort((bx, by, page[of]))
                of, bx, by = of[order], bx[order], by[order]
                left, top = np.maximum(bx * block_w, x0[of]), np.maximum(by * block_h, y0[of])
                pw, ph = np.minimum((bx + 1) * block_w, right[of]) - left, np.minimum((by + 1) * block_h, bottom[of]) - top
                start = at[of] + ((top - y0[of]) * cw[of] + left - x0[of]) * inner[of]
                place = np.stack([plane[of], inner[of], left - bx * block_w, top - by * block_h, pw, ph], 1).astype(np.int32)
                for a, b in stretches(pw * ph * inner[of], BATCH_SAMPLES):
                    o, x, y = of[a:b], bx[a:b], by[a:b]
                    lines, n = progressions(start[a:b], cw[o] * inner[o], ph[a:b]), np.repeat(pw[a:b] * inner[o], ph[a:b])
                    out, done = np.empty(n.sum(), kind), 0
                    for c, d in stretches(n, BATCH_SAMPLES):
                        found = data[progressions(lines[c:d], 1, n[c:d])]
                        out[done : done + len(found)] = found
                        done += len(found)
                    new = np.ones(b - a, bool)
                    new[1:] = (np.diff(page[o]) != 0) | (np.diff(y) != 0) | (np.diff(x) != 0)
                    new = np.flatnonzero(new)
                    ends, f = np.append(new[1:], b - a), o[new]
                    block = [x[new], y[new], x[new] * block_w, y[new] * block_h, np.minimum(block_w, width[f] - x[new] * block_w), np.minimum(block_h, height[f] - y[new] * block_h), channels[f]]
                    places = pa.ListArray.from_arrays(pa.array(np.append(0, ends) * place.shape[1], pa.int32()), pa.array(place[a:b].ravel()))
                    values = binaries(out, np.cumsum(pw[a:b] * ph[a:b] * inner[o])[ends - 1])
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(f)) for c in batch.columns[:k]), *(pa.array(v, pa.int32()) for v in block), places, values], [*names, "places", "pieces"])

    def given(keys, samples, ends):
        return pa.RecordBatch.from_arrays([*keys, binaries(samples, ends)], [*names, "samples"])

    def join(batches):
        held, rest = None, None  # key and samples of the block that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.columns[: len(names)]
            count = batch.column(len(names)).value_lengths().to_numpy() // 6
            if held is not None:
                keys, count = [pa.concat_arrays(c) for c in zip(held, keys, strict=True)], np.append(0, count)
            block = np.flatnonzero(begins(keys))
            w, h, channels = (c.take(pa.array(block)).to_numpy().astype(np.int64) for c in keys[-3:])
            plane, inner, px, py, pw, ph = batch.column(len(names)).flatten().to_numpy().reshape(-1, 6).T.astype(np.int64)
            data = flat(batch.columns[-1], kind)[1].view(kind)
            until = np.append(0, np.cumsum(count))[np.append(block[1:], len(count))]  # pieces up to the end of each block
            sizes, done, p = w * h * channels, 0, 0
            for i, j in stretches(sizes, BATCH_SAMPLES):
                ends, q = np.cumsum(sizes[i:j]), until[j - 1]
                out = np.zeros(ends[-1], kind)
                if rest is not None:
                    out[: len(rest)], rest = rest, None
                of = np.repeat(np.arange(i, j), np.diff(until[i:j], prepend=p))
                apart = inner[p:q] < channels[of]
                start = (ends - sizes[i:j])[of - i] + (py[p:q] * w[of] + px[p:q]) * channels[of] + np.where(apart, plane[p:q], 0)
                lines, n = progressions(start, w[of] * channels[of], ph[p:q]), np.repeat(pw[p:q] * inner[p:q], ph[p:q])
                step = np.repeat(np.where(apart, channels[of], 1), ph[p:q])
                for c, d in stretches(n, BATCH_SAMPLES):
                    total = int(n[c:d].sum())
                    out[progressions(lines[c:d], step[c:d], n[c:d])] = data[done : done + total]
                    done += total
                p = q
                if j == len(block):  # its last block may go on
                    held, j = [c.take(pa.array(block[-1:])) for c in keys], j - 1
                    rest = out[len(out) - sizes[-1] :].copy()
                    out, ends = out[: len(out) - sizes[-1]], ends[:-1]
                if j > i:
                    yield given([c.take(pa.array(block[i:j])) for c in keys], out, ends)
        if held is not None:
            yield given(held, rest, np.array([len(rest)]))

    block = names[: k + 2]
    return rows.mapInArrow(cut, f"{key}, places array<int>, pieces binary").repartition(*block).sortWithinPartitions(*block).mapInArrow(join, f"{key}, samples binary")


def assemble(chunks: DataFrame, pages: DataFrame, group: Sequence[str] = ("path", "page")) -> DataFrame:
    """(group, samples) of planes put together from their strips or tiles; what is missing stays zero.

    chunks has the group, plane, x0, y0, width, rows and data (64-bit little-endian
    codes, row by row); pages has the group, width, height and channels. A page's
    pieces meet in one task, so pages that are too large for that stay as pieces.
    """
    pieces = chunks.where("data is not null").groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "plane", "width", "rows", "data"))).alias("pieces"))
    rows = pages.select(*group, "width", "height", "channels").join(pieces, list(group), "left")
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group), "samples binary"])

    def build(batches):
        for batch in batches:
            out = []
            for width, height, channels, pieces_ in zip(*batch.columns[len(group) :], strict=True):
                width, height, channels = width.as_py(), height.as_py(), channels.as_py()
                page = np.zeros((height, width, channels), "<i8")
                for p in pieces_.as_py() or []:
                    data = np.frombuffer(p["data"], "<i8").reshape(p["rows"], p["width"], -1)
                    h, w = min(p["rows"], height - p["y0"]), min(p["width"], width - p["x0"])
                    at = slice(p["plane"], p["plane"] + 1) if data.shape[2] < channels else slice(None)
                    page[p["y0"] : p["y0"] + h, p["x0"] : p["x0"] + w, at] = data[:h, :w]
                out.append(page.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(group)], pa.array(out, pa.binary())], [*group, "samples"])

    return rows.mapInArrow(build, schema)
