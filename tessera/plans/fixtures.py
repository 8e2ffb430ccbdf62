"""Queries over files whose bytes are put together here, by hand, from the driver's tables.

Each vector is an image of 8 x 8 samples. Headers are fixed bytes and pixels are
column expressions, so none of this package's encoders has a part in what its
decoders read; the SQL gives the pixels from the table alone.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fax, udfs
from tessera.operators import pixels as P
from tessera.operators import rasters as R
from tessera.plans.queries import PALETTE, query, raster, table
from tessera.sources import gif, readers, tiff

SIDE = 8


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, s) with 64 samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: P.float_to_u8(v.cast("double") + 0.5)).alias("s"))


def byte(v: Column) -> Column:
    return F.lpad(F.hex(v.cast("long")), 2, "0")


def word(v: Column, little: bool = True) -> Column:
    low, high = byte(v.bitwiseAND(255)), byte(P.idiv(v, 256))
    return F.concat(low, high) if little else F.concat(high, low)


def each(f: Callable[[Column], Column], start: int = 0, n: int = 64) -> Column:
    """f of so many samples, one after the other."""
    return F.array_join(F.transform(F.slice("s", start + 1, n), f), "")


def rows(f: Callable[[Column], Column], after: str = "", order=range(SIDE)) -> Column:
    return F.concat(*(F.concat(each(f, SIDE * y, SIDE), F.lit(after)) for y in order))


def nibbles(start: int, n: int) -> Column:
    return each(lambda v: F.hex(P.idiv(v, 16)), start, n)


def choose(by: Column, options: list[Column]) -> Column:
    out = F.when(by == 0, options[0])
    for k, c in enumerate(options[1:], 1):
        out = out.when(by == k, c)
    return out


def exploded(df: DataFrame, keys: list[str], data: str, names: list[str], side: int = SIDE) -> DataFrame:
    """A row per pixel of square images: keys (longs), y, x and the interleaved byte channels."""
    schema = ", ".join(f"{c} long" for c in [*keys, "y", "x", *names])

    def unpack(batches):
        for b in batches:
            for *key, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v = np.frombuffer(content, np.uint8).reshape(-1, len(names)).astype(np.int64)
                place = np.arange(len(v))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(v), k)) for k in key), pa.array(place // side), pa.array(place % side), *(pa.array(v[:, k]) for k in range(len(names)))], [*keys, "y", "x", *names])

    return df.select(*(F.col(k).cast("long").alias(k) for k in keys), data).mapInArrow(unpack, schema)


RGBA = list("rgba")
PX = "with $RASTER, px as (select y as vec_id, x // 8 as y, x % 8 as x, s from raster) "

# --- bitmaps ----------------------------------------------------------------------------------------


def bmp_head(size: int, bits: int, compression: int = 0, palette: list[tuple[int, int, int]] = (), masks: tuple[int, ...] = (), height: int = SIDE, offset: int | None = None) -> Column:
    if size == 12:
        head = struct.pack("<IHHHH", 12, SIDE, height, 1, bits)
    else:
        head = struct.pack("<IiiHHIIiiII", size, SIDE, height, 1, bits, compression, 0, 0, 0, len(palette), 0) + struct.pack(f"<{len(masks)}I", *masks)
        head = head.ljust(size, b"\0")
    head += b"".join(bytes([b, g, r, 0]) for r, g, b in palette)
    return F.lit((struct.pack("<2sIII", b"BM", 0, 0, 14 + len(head) if offset is None else offset) + head).hex())


DEEP = [(i, 255 - i, i // 2) for i in range(256)]
SIXTEEN = [(17 * i, 255 - 17 * i, i) for i in range(16)]
UP = range(SIDE - 1, -1, -1)


def bmp_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    bgr = lambda v: F.concat(byte(P.idiv(v, 2)), byte(255 - v), byte(v))
    bits = F.concat(*(F.concat(byte(sum((F.shiftleft(P.idiv(F.element_at("s", SIDE * y + x + 1), 128), 7 - x) for x in range(SIDE)), F.lit(0))), F.lit("000000")) for y in UP))
    run4 = F.concat(*(F.concat(*(F.concat(F.lit("02"), nibbles(SIDE * y + x, 2)) for x in range(0, SIDE, 2)), F.lit("0000")) for y in UP))
    packed = lambda v: word(F.shiftleft(P.idiv(v, 8), 11).bitwiseOR(F.shiftleft(P.idiv(v, 4), 5)).bitwiseOR(P.idiv(v, 8)))
    options = [
        F.concat(bmp_head(40, 24), rows(bgr, order=UP)),
        F.concat(bmp_head(40, 24, height=-SIDE), rows(bgr)),
        F.concat(bmp_head(40, 8, palette=DEEP), rows(byte, order=UP)),
        F.concat(bmp_head(40, 4, palette=SIXTEEN), *(nibbles(SIDE * y, SIDE) for y in UP)),
        F.concat(bmp_head(40, 1, palette=[(10, 20, 30), (200, 210, 220)]), bits),
        F.concat(bmp_head(40, 8, 1, DEEP), rows(lambda v: F.concat(F.lit("01"), byte(v)), "0000", UP), F.lit("0001")),
        F.concat(bmp_head(40, 4, 2, SIXTEEN), run4, F.lit("0001")),
        F.concat(bmp_head(52, 16, 3, masks=(0xF800, 0x7E0, 0x1F)), rows(packed, order=UP)),
        F.concat(bmp_head(108, 32, 3, masks=(0xFF0000, 0xFF00, 0xFF, 0xFF000000)), rows(lambda v: F.concat(bgr(v), byte(255 - P.idiv(v, 4))), order=UP)),
        F.concat(bmp_head(12, 24, offset=0), rows(bgr, order=UP)),
        F.concat(bmp_head(64, 24, 4), rows(lambda v: F.concat(F.lit("01"), bgr(v)), "0000", UP), F.lit("0001")),
    ]
    return images(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), F.unhex(choose(F.col("vec_id") % len(options), options)).alias("content"))


@query(PX + """select vec_id, y, x,
    (case when v in (3, 6) then s // 16 * 17 when v = 4 then case when s < 128 then 10 else 200 end when v = 7 then ((s // 8) * 255 + 15) // 31 else s end)::bigint as r,
    (case when v in (3, 6) then 255 - s // 16 * 17 when v = 4 then case when s < 128 then 20 else 210 end when v = 7 then ((s // 4) * 255 + 31) // 63 else 255 - s end)::bigint as g,
    (case when v in (3, 6) then s // 16 when v = 4 then case when s < 128 then 30 else 220 end when v = 7 then ((s // 8) * 255 + 15) // 31 else s // 2 end)::bigint as b,
    (case when v = 8 then 255 - s // 4 else 255 end)::bigint as a from (select *, vec_id % 11 as v from px)""")
def bmp_variants(spark, sf_dir):
    """Depths of 1 to 32 bits, run lengths, masks, four kinds of header, both row orders and an offset that cannot be right."""
    return exploded(readers.bmp(bmp_files(spark, sf_dir)).where("error is null").withColumn("vec_id", F.col("path").cast("long")), ["vec_id"], "rgba", RGBA)


@query("""select vec_id, v[1] as bits_per_pixel, v[2] as compression, v[3] as header, v[4]::bigint as palette_len, vec_id % 11 = 1 as top_down from (select vec_id,
    [['24', 'Rgb', 'Info', '0'], ['24', 'Rgb', 'Info', '0'], ['8', 'Rgb', 'Info', '256'], ['4', 'Rgb', 'Info', '16'], ['1', 'Rgb', 'Info', '2'], ['8', 'Rle8', 'Info', '256'], ['4', 'Rle4', 'Info', '16'],
     ['16', 'BitFields', 'V2', '0'], ['32', 'BitFields', 'V4', '0'], ['24', 'Rgb', 'Core', '0'], ['24', 'Rle24', 'Os2', '0']][vec_id % 11 + 1] as v from embeddings)""")
def bmp_headers(spark, sf_dir):
    found = readers.bmp_info(bmp_files(spark, sf_dir))
    return found.select(F.col("path").cast("long").alias("vec_id"), F.col("bits_per_pixel").cast("string").alias("bits_per_pixel"), "compression", "header", F.col("palette_len").cast("long").alias("palette_len"), "top_down")


# --- animations -------------------------------------------------------------------------------------

PATCH = 6


def gif_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animations of up to five frames of 6 x 6 pixels at changing places, some past the screen's edge; index 0 is transparent."""
    index = lambda v: byte(P.idiv(v, 64))
    plain = each(index, 0, PATCH * PATCH)
    woven = F.concat(*(each(index, PATCH * y, PATCH) for y in (0, 4, 2, 1, 3, 5)))
    key = F.col("vec_id")
    control = F.concat(F.lit("21f904"), byte(F.shiftleft(key % 4, 2) + 1), word(key % 7), F.lit("0000"))
    place = F.concat(F.lit("2c"), word(key % 4), word(P.idiv(key, 2) % 4), F.lit(struct.pack("<HH", PATCH, PATCH).hex()), F.when(key % 2 == 1, "40").otherwise("00"))
    # codes of eight bits: clear, 36 pixels, end
    data = F.concat(F.lit("072680"), F.when(key % 2 == 1, woven).otherwise(plain), F.lit("8100"))
    frames = images(spark, sf_dir).select(P.idiv(key, 5).alias("k"), "vec_id", F.concat(control, place, data).alias("frame"))
    head = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0x81, 2, 49) + bytes(v for i in range(4) for v in (50 * i, 50 * i + 1, 50 * i + 2))
    loop = F.concat(F.lit((b"\x21\xff\x0bNETSCAPE2.0\x03\x01").hex()), word(F.col("k") % 9), F.lit("00"), F.lit((b"\x21\xfe\x03abc\0").hex()))
    whole = frames.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "frame"))), lambda f: f["frame"]), "").alias("frames"))
    return whole.select(F.col("k").cast("string").alias("path"), F.unhex(F.concat(F.lit(head.hex()), loop, "frames", F.lit("3b"))).alias("content"))


@query("""with recursive $RASTER, grid as (select unnest(range(0, 64)) as p),
    cells as (select v.vec_id // 5 as k, row_number() over (partition by v.vec_id // 5, p order by v.vec_id) as n, p % 8 as x, p // 8 as y, v.vec_id % 4 as disposal, v.vec_id % 7 as delay,
            p % 8 - v.vec_id % 4 as px, p // 8 - v.vec_id // 2 % 4 as py, v.vec_id from embeddings v, grid),
    covered as (select c.*, px between 0 and 5 and py between 0 and 5 as inside, coalesce(r.s // 64, 0) as v from cells c left join raster r on r.y = c.vec_id and px between 0 and 5 and py between 0 and 5 and r.x = py * 6 + px),
    fold as (select k, n, x, y, delay, disposal, inside, 0::bigint as under, v as shown from covered where n = 1
        union all select c.k, c.n, c.x, c.y, c.delay, c.disposal, c.inside,
            case when f.inside and f.disposal = 2 then 0 when f.inside and f.disposal = 3 then f.under else f.shown end,
            case when c.v > 0 then c.v when f.inside and f.disposal = 2 then 0 when f.inside and f.disposal = 3 then f.under else f.shown end
        from fold f join covered c on c.k = f.k and c.x = f.x and c.y = f.y and c.n = f.n + 1)
    select k, n - 1 as frame, delay::bigint as delay_cs, y, x, shown * 50 as r, case when shown > 0 then shown * 50 + 1 else 0 end as g, case when shown > 0 then shown * 50 + 2 else 0 end as b, case when shown > 0 then 255 else 0 end::bigint as a from fold""")
def gif_animations(spark, sf_dir):
    """Delays, disposal, offsets, interlacing, transparency and clipping of frames drawn one over the other."""
    frames = readers.frames(gif_files(spark, sf_dir)).where("error is null").withColumn("k", F.col("path").cast("long"))
    return exploded(frames, ["k", "frame", "delay_cs"], "rgba", RGBA)


@query("""select vec_id // 5 as k, '89a' as version, 8::bigint as width, 8::bigint as height, 4::bigint as colours, 2::bigint as background_index, min(vec_id // 5 % 9)::bigint as loop_count, 'abc' as comment from embeddings group by vec_id // 5""")
def gif_headers(spark, sf_dir):
    found = readers.gif(gif_files(spark, sf_dir)).where("error is null")
    comment = F.element_at("comments", 1)
    return found.select(F.col("path").cast("long").alias("k"), F.regexp_extract(F.col("version").cast("string"), "8[79]a", 0).alias("version"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"),
        F.size("global_palette").cast("long").alias("colours"), F.col("background_index").cast("long").alias("background_index"), F.col("loop_count").cast("long").alias("loop_count"), comment.cast("string").alias("comment"))


@query("with $RASTER, palette(i, r, g, b) as (values " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE)) + """),
    d as (select raster.y as vec_id, x // 8 as y, x % 8 as x, p.r, p.g, p.b, (s - p.r) * (s - p.r) + (s - p.g) * (s - p.g) + (s - p.b) * (s - p.b) as d, i from raster, palette p)
    select vec_id, y, x, arg_min(r, d * 256 + i)::bigint as r, arg_min(g, d * 256 + i)::bigint as g, arg_min(b, d * 256 + i)::bigint as b, 255::bigint as a from d group by vec_id, y, x""")
def gif_fixed_palette(spark, sf_dir):
    """Grey images written with one palette for the file: each pixel is its nearest entry."""
    grey = images(spark, sf_dir).select("vec_id", udfs.grey_rgba(P.bytes_of(F.col("s"))).alias("rgba"))
    encode = udfs.gif_encoder(gif.EncodeOptions(palette=np.array(PALETTE, np.uint8)))
    files = grey.select("vec_id", encode("rgba", F.lit(SIDE), F.lit(SIDE)).alias("content"))
    return exploded(files.select("vec_id", udfs.gif_first_frame("content").alias("rgba")), ["vec_id"], "rgba", RGBA)


@query(PX + "select vec_id // 5 as k, (vec_id % 5)::bigint as frame, (vec_id % 5 * 3)::bigint as delay_cs, y, x, s as r, s as g, s as b, 255::bigint as a from px")
def gif_animation_roundtrip(spark, sf_dir):
    """Frames through the animation writer, which stores what changes between them."""
    key = F.col("vec_id")
    frames = images(spark, sf_dir).select(P.idiv(key, 5).alias("k"), (key % 5).cast("int").alias("frame"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), (key % 5 * 3).cast("int").alias("delay_cs"), udfs.grey_rgba(P.bytes_of(F.col("s"))).alias("rgba"))
    files = udfs.encode_animations(frames, "k").select(F.col("k").cast("string").alias("path"), "content")
    back = readers.frames(files).where("error is null").withColumn("k", F.col("path").cast("long"))
    return exploded(back, ["k", "frame", "delay_cs"], "rgba", RGBA)


# --- tagged images ----------------------------------------------------------------------------------

GREY = {256: (3, [SIDE]), 257: (3, [SIDE]), 258: (3, [8]), 259: (3, [1]), 262: (3, [1]), 277: (3, [1]), 278: (3, [SIDE])}


def tiff_head(tags: dict[int, tuple[int, list]], strips: list[int], big_endian: bool = False, big: bool = False, sizes: bool = True, tiled: bool = False) -> str:
    """Header and directory of a file whose strips or tiles, of the given sizes, follow in hexadecimal."""
    e, wide, inline = (">" if big_endian else "<"), ("Q" if big else "I"), (8 if big else 4)
    kind = 16 if big else 4
    places = {324 if tiled else 273: (kind, strips), 325 if tiled else 279: (kind, strips)}
    if not sizes:
        del places[279]
    full = sorted((tags | places).items())
    start = 16 if big else 8
    end = start + (8 if big else 2) + (20 if big else 12) * len(full) + inline
    packed = {t: struct.pack(f"{e}{len(v)}{tiff.FIELD[k][0]}", *v) for t, (k, v) in full}
    first = end + sum(len(p) for p in packed.values() if len(p) > inline)
    offsets = [first + sum(strips[:k]) for k in range(len(strips))]
    packed[324 if tiled else 273] = struct.pack(f"{e}{len(strips)}{wide}", *offsets)
    out = (b"MM" if big_endian else b"II") + (struct.pack(e + "HHHQ", 43, 8, 0, 16) if big else struct.pack(e + "HI", 42, 8)) + struct.pack(e + ("Q" if big else "H"), len(full))
    extra = b""
    for t, (k, v) in full:
        data = packed[t]
        if len(data) > inline:
            extra += data
            data = struct.pack(e + wide, end + len(extra) - len(data))
        out += struct.pack(e + "HH" + wide, t, k, len(v) // (2 if k in (5, 10) else 1)) + data.ljust(inline, b"\0")
    return (out + bytes(inline) + extra).hex()


def tiff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = lambda tags, strips=(64,), **how: F.lit(tiff_head(GREY | tags, list(strips), **how))
    listed = lambda values: F.array(*map(F.lit, values))
    reversed_ = listed([f"{int(f'{i:08b}'[::-1], 2):02x}" for i in range(256)])
    floats = listed([struct.pack("<f", i / 255).hex() for i in range(256)])
    at = lambda array, v: F.element_at(array, (v + 1).cast("int"))
    differences = F.concat(*(F.concat(byte(F.element_at("s", y + 1)), *(byte(F.pmod(F.element_at("s", y + x + 1) - F.element_at("s", y + x), F.lit(256))) for x in range(1, SIDE))) for y in range(0, 64, SIDE)))
    ramp = [257 * i for i in range(256)]
    plain = each(byte)
    options = [
        F.concat(head({278: (3, [4]), 282: (5, [300, 4]), 283: (5, [72, 1])}, (32, 32)), plain),
        F.concat(head({258: (3, [16])}, (128,), big_endian=True), each(lambda v: word(v * 257, little=False))),
        F.concat(head({}, big=True), plain),
        F.concat(head({322: (3, [16]), 323: (3, [16])}, (256,), tiled=True), rows(byte, "00" * 8), F.lit("00" * 128)),
        F.concat(head({258: (3, [8, 8, 8]), 262: (3, [2]), 277: (3, [3]), 284: (3, [2])}, (64, 64, 64)), plain, each(lambda v: byte(255 - v)), each(lambda v: byte(P.idiv(v, 2)))),
        F.concat(head({259: (3, [32773])}, (72,)), F.concat(*(F.concat(F.lit("07"), each(byte, y, SIDE)) for y in range(0, 64, SIDE)))),
        F.concat(head({262: (3, [3]), 320: (3, [*ramp, *ramp[::-1], *[0] * 256])}), plain),
        F.concat(head({258: (3, [4]), 262: (3, [0])}, (32,)), nibbles(0, 64)),
        F.concat(head({339: (3, [2])}), plain),
        F.concat(head({278: (3, [3])}, (24, 24, 16), sizes=False), plain),
        F.concat(head({317: (3, [2])}), differences),
        F.concat(head({274: (3, [3])}), plain),
        F.concat(head({258: (3, [32]), 339: (3, [3])}, (256,)), each(lambda v: at(floats, v))),
        F.concat(head({258: (3, [8] * 4), 262: (3, [5]), 277: (3, [4])}, (256,)), each(lambda v: F.concat(byte(v), byte(255 - v), byte(P.idiv(v, 2)), byte(P.idiv(v, 4))))),
        F.concat(head({266: (3, [2])}), each(lambda v: at(reversed_, v))),
        F.concat(head({258: (3, [8] * 3), 262: (3, [6]), 277: (3, [3]), 530: (3, [2, 2])}, (96,)), F.concat(*(F.concat(*(byte(F.element_at("s", SIDE * (y + j) + x + i + 1)) for j in (0, 1) for i in (0, 1)), F.lit("8080")) for y in range(0, SIDE, 2) for x in range(0, SIDE, 2)))),
        F.concat(head({258: (3, [8, 8]), 277: (3, [2]), 338: (3, [1])}, (128,)), each(lambda v: F.concat(byte(P.idiv(v, 2)), F.lit("80")))),
    ]
    return images(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), F.unhex(choose(F.col("vec_id") % len(options), options)).alias("content"))


@query(PX + """, c as (select *, vec_id % 17 as v from px),
    turned as (select vec_id, v, s, case when v = 11 then 7 - y else y end as y, case when v = 11 then 7 - x else x end as x from c),
    g as (select *, case when v = 7 then (15 - s // 16) * 17 when v = 8 then xor(s, 128) when v = 16 then least(255, (s // 2 * 255 + 64) // 128) else s end as k from turned)
    select vec_id, y, x, (case when v = 13 then (255 - s) * (255 - s // 4) // 255 else k end)::bigint as r, (case when v in (4, 6) then 255 - s when v = 13 then s * (255 - s // 4) // 255 else k end)::bigint as g,
        (case when v = 4 then s // 2 when v = 6 then 0 when v = 13 then (255 - s // 2) * (255 - s // 4) // 255 else k end)::bigint as b, (case when v = 16 then 128 else 255 end)::bigint as a from g""")
def tiff_variants(spark, sf_dir):
    """Strips, tiles, planes, both byte orders, long offsets, depths, palettes, signed and float samples, inks, components, orientation, no sizes."""
    shown = tiff_files(spark, sf_dir).select(F.col("path").cast("long").alias("vec_id"), udfs.tiff_rgba("content", F.lit(0)).alias("rgba"))
    return exploded(shown, ["vec_id"], "rgba", RGBA)


@query("""select vec_id, v = 1 as big_endian, v = 2 as big_tiff, case v when 4 then 'Rgb' when 6 then 'Palette' when 7 then 'WhiteIsZero' when 13 then 'Cmyk' when 15 then 'YCbCr' else 'BlackIsZero' end as photometric,
    case v when 5 then 'PackBits' else 'None' end as compression, case v when 4 then 'Planar' else 'Chunky' end as planar, case v when 8 then 'Int' when 12 then 'Float' else 'Uint' end as sample_format,
    (case v when 1 then 16 when 7 then 4 when 12 then 32 else 8 end)::bigint as bits, (case v when 11 then 3 else 1 end)::bigint as orientation, case when v = 0 then 75.0 end::double as x_res,
    case v when 4 then 'Rgb' when 6 then 'Rgb' when 13 then 'Cmyk' when 15 then 'Rgb' when 16 then 'GrayAlpha' else 'Gray' end as color, case v when 1 then 'U16' when 6 then 'U16' when 12 then 'F32' else 'U8' end as sample_type, v = 16 as premultiplied
    from (select vec_id, vec_id % 17 as v from embeddings)""")
def tiff_variant_pages(spark, sf_dir):
    found = readers.pages(tiff_files(spark, sf_dir)).where("error is null")
    return found.select(F.col("path").cast("long").alias("vec_id"), "big_endian", "big_tiff", "photometric", "compression", "planar", "sample_format", F.element_at("bits_per_sample", 1).cast("long").alias("bits"), F.col("orientation").cast("long").alias("orientation"), F.col("x_res").cast("double").alias("x_res"), "color", "sample_type", "premultiplied")


@query(PX + "select vec_id // 5 as k, (vec_id % 5)::bigint as page, y, x, s from px")
def tiff_pages_roundtrip(spark, sf_dir):
    """Files of several pages with long offsets, the high byte first, packed after differences."""
    key = F.col("vec_id")
    pages = images(spark, sf_dir).select(P.idiv(key, 5).alias("k"), (key % 5).cast("int").alias("page"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), P.bytes_of(F.col("s")).alias("samples"))
    files = udfs.encode_pages(pages, "k", "Gray8", tiff.EncodeOptions("Deflate", True, 9, 16, True, True)).select(F.col("k").cast("string").alias("path"), "content")
    return exploded(readers.pages(files).where("error is null").withColumn("k", F.col("path").cast("long")), ["k", "page"], "samples", ["s"])


@query("with $RASTER select y, x, case when s >= 128 then 1 else 0 end::bigint as s from raster")
def fax_rows(spark, sf_dir):
    """Rows coded run by run from the table of codes, by a join, and read as one-dimensional facsimile."""
    bits = raster(spark, sf_dir).select("y", "x", (F.col("s") >= 128).cast("long").alias("value"))
    codes = spark.createDataFrame([(c, n, fax.code_run(n, c)) for c in (0, 1) for n in range(65)], "value long, length long, code string")
    runs = R.runs(bits, ["y"], "x", "value").join(F.broadcast(codes), ["value", "length"])
    lead = F.when((F.col("start") == 0) & (F.col("value") == 1), fax.code_run(0, 0)).otherwise("")
    coded = runs.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("start", F.concat(lead, "code").alias("code")))).alias("c"))
    coded = coded.select("y", F.array_join(F.transform("c", lambda r: r["code"]), "").alias("b"))
    bytes_ = F.transform(F.sequence(F.lit(1), F.length("b"), F.lit(8)), lambda i: F.lpad(F.conv(F.rpad(F.substring(F.col("b"), i, F.lit(8)), 8, "0"), 2, 16), 2, "0"))
    back = coded.select("y", udfs.fax_decode(F.unhex(F.array_join(bytes_, "")), F.lit(64), F.lit(1), F.lit("mh")).alias("bits"))
    digits = F.split(F.lpad(F.conv(F.hex("bits"), 16, 2), 64, "0"), "")
    return back.select("y", F.posexplode(F.slice(digits, 1, 64)).alias("x", "d")).select("y", F.col("x").cast("long").alias("x"), F.col("d").cast("long").alias("s"))


# --- what is refused --------------------------------------------------------------------------------


def refused() -> list[tuple[str, str, bytes, str]]:
    """(name, format, content, kind of error)."""
    grey = lambda tags, strips=(64,), **how: bytes.fromhex(tiff_head(GREY | tags, list(strips), **how)) + bytes(64)
    none = {k: v for k, v in GREY.items() if k != 257}
    info = lambda bits, code, w=SIDE, h=SIDE, body=b"", size=40: b"BM" + struct.pack("<III", 0, 0, 54) + struct.pack("<IiiHHIIiiII", size, w, h, 1, bits, code, 0, 0, 0, 0, 0) + body
    return [
        ("gif cut in its header", "gif", b"GIF89a", "Truncated"),
        ("gif of another kind", "gif", b"GIF90a" + bytes(20), "Invalid"),
        ("gif screen too large", "gif", b"GIF89a\xff\xff\xff\xff\0\0\0\x3b", "LimitExceeded"),
        ("bmp negative width", "bmp", info(24, 0, -8, 8, bytes(192)), "Invalid"),
        ("bmp zero height", "bmp", info(24, 0, 8, 0, bytes(192)), "Invalid"),
        ("bmp jpeg inside", "bmp", info(24, 4, body=bytes(192)), "Unsupported"),
        ("bmp of 64 bits", "bmp", info(64, 0, body=bytes(600)), "Unsupported"),
        ("bmp of 5 bits", "bmp", info(5, 0, body=bytes(600)), "Invalid"),
        ("bmp without pixels", "bmp", info(24, 0), "Truncated"),
        ("bmp too large", "bmp", info(24, 0, 60_000, 60_000, bytes(9)), "LimitExceeded"),
        ("bmp run lengths top down", "bmp", info(8, 1, 8, -8, bytes(1100)), "Invalid"),
        ("bmp run lengths of another depth", "bmp", info(4, 1, body=bytes(200)), "Invalid"),
        ("tiff of another kind", "tiff", b"II\x29\0" + bytes(20), "Invalid"),
        ("tiff without a directory", "tiff", b"II*\0" + struct.pack("<I", 400), "Truncated"),
        ("tiff without height", "tiff", bytes.fromhex(tiff_head(none, [64])) + bytes(64), "Invalid"),
        ("tiff too large", "tiff", grey({256: (4, [100_000]), 257: (4, [100_000])}), "LimitExceeded"),
        ("tiff tiles too large", "tiff", grey({322: (4, [1 << 30]), 323: (4, [1 << 30])}, tiled=True), "LimitExceeded"),
        ("tiff mixed depths", "tiff", grey({258: (3, [8, 4, 8]), 277: (3, [3])}), "Unsupported"),
        ("tiff jpeg inside", "tiff", grey({259: (3, [7])}), "Unsupported"),
        ("tiff predictor 7", "tiff", grey({317: (3, [7])}), "Unsupported"),
        ("tiff float predictor on integers", "tiff", grey({317: (3, [3])}), "Invalid"),
        ("tiff predictor with 4 bits", "tiff", grey({258: (3, [4]), 317: (3, [2])}), "Unsupported"),
        ("tiff palette without colours", "tiff", grey({262: (3, [3])}), "Invalid"),
        ("tiff other inks", "tiff", grey({262: (3, [5]), 277: (3, [4]), 332: (3, [2])}), "Unsupported"),
        ("tiff of four samples in lab", "tiff", grey({262: (3, [8]), 277: (3, [3])}), "Unsupported"),
        ("tiff damaged facsimile", "tiff", grey({258: (3, [1]), 259: (3, [4])}), "Invalid"),
        ("tiff uncompressed facsimile", "tiff", grey({258: (3, [1]), 259: (3, [4]), 293: (4, [2])}), "Unsupported"),
        ("tiff tiles not at bytes", "tiff", grey({258: (3, [1]), 322: (3, [4]), 323: (3, [8])}, (8, 8), tiled=True), "Unsupported"),
        ("tiff damaged stream", "tiff", grey({259: (3, [8])}), "Invalid"),
    ]


@query("select * from (values " + ", ".join(f"('{name}', '{kind}')" for name, _, _, kind in refused()) + ") t(path, kind)")
def refusals(spark, sf_dir):
    """Files that the readers refuse, each with its kind of error."""
    files = spark.createDataFrame([(name, kind, bytearray(content)) for name, kind, content, _ in refused()], "path string, format string, content binary")
    found = [f(files.where(F.col("format") == kind)).select("path", F.col("error.kind").alias("kind")) for kind, f in (("gif", readers.frames), ("bmp", readers.bmp), ("tiff", readers.pages))]
    return found[0].union(found[1]).union(found[2])


@query("""select o_custkey, arg_min(o_orderpriority, o_orderkey) as error from orders where o_orderkey % 3 = 0 group by o_custkey""")
def first_error(spark, sf_dir):
    """Of the strips of a page that fail, the first one's error."""
    error = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))
    return R.first_error(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("idx"), error.alias("error")), ["o_custkey"])

