"""Queries over the driver's tables for the operators of this package, with SQL for an independent engine.

The tables hold no images, so rasters are made from them: RASTER is embeddings
as 8-bit samples (row vec_id, column position), BYTES the UTF-8 of documents,
FRAMES the events of a user in order of time.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import udfs
from tessera.operators import colours
from tessera.operators import pixels as P
from tessera.operators import rasters as R
from tessera.sources import readers, tiff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TILE = 64
#: Pages that a task makes up and cuts.
PAGES_A_TASK = 8192


def query(sql: str | None = None):
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("$RASTER", RASTER_SQL).replace("$FRAMES", FRAMES_SQL)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RASTER_SQL = """raster as (select vec_id as y, (i - 1)::bigint as x, label::bigint as label, floor(least(greatest(v::double + 0.5, 0.0), 1.0) * 255 + 0.5)::bigint as s
    from (select vec_id, label, unnest(embedding) as v, unnest(range(1, len(embedding) + 1)) as i from embeddings))"""
FRAMES_SQL = "frames as (select user_id, event_id, ts, event_id % 3 as delay_cs, event_type from events)"


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("x", "v"))
    return rows.select("y", F.col("x").cast("long").alias("x"), "label", P.float_to_u8(F.col("v").cast("double") + 0.5).alias("s"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey images of up to 64 rows: (tile, ys, width, height, samples); a table of any size is that many small images."""
    row = P.bytes_of(F.transform("embedding", lambda v: P.float_to_u8(v.cast("double") + 0.5)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", P.idiv(F.col("vec_id"), TILE).alias("tile"), F.size("embedding").alias("width"), row.alias("row"))
    lists = rows.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("r"), F.first("width").alias("width"))
    return lists.select("tile", F.col("r.vec_id").alias("ys"), "width", F.size("r").alias("height"), F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["row"])), "")).alias("samples"))


def exploded(images: DataFrame, samples: Column, step: int = 1) -> DataFrame:
    """(y, x, s) of images with ys and width; samples is the binary, of which every step-th byte counts."""

    def unpack(batches):
        for b in batches:
            for ys, width, data in zip(*b.columns, strict=True):
                v = data.as_buffer()
                n = width.as_py()
                import numpy as np

                s = np.frombuffer(v, np.uint8)[::step].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ys.as_py(), np.int64), n)), pa.array(np.tile(np.arange(n), len(ys))), pa.array(s)], ["y", "x", "s"])

    return images.select("ys", "width", samples.alias("data")).mapInArrow(unpack, "y long, x long, s long")


# --- rasters as relations ---------------------------------------------------------------------------


@query("with $RASTER select y, x, s from raster")
def float_to_u8(spark, sf_dir):
    return raster(spark, sf_dir).select("y", "x", "s")


@query("with $RASTER select s, count(*) as n from raster group by s")
def histogram(spark, sf_dir):
    return R.histogram(raster(spark, sf_dir), ["s"]).select("s", "n")


@query("with $RASTER select y, x, s, ((s - coalesce(lag(s) over (partition by y order by x), 0)) % 256 + 256) % 256 as d, s as back from raster")
def predictor_roundtrip(spark, sf_dir):
    coded = R.apply_predictor(raster(spark, sf_dir), ["y"], "x", "s", 8, "d")
    return R.undo_predictor(coded, ["y"], "x", "d", 8, "back").select("y", "x", "s", "d", "back")


@query("""with $RASTER, bits as (select y, x, case when s >= 128 then 1 else 0 end::bigint as value from raster),
    marked as (select *, case when lag(value) over (partition by y order by x) = value then 0 else 1 end as n from bits),
    runs as (select *, sum(n) over (partition by y order by x) as run from marked)
    select y, min(x) as start, count(*) as length, min(value) as value from runs group by y, run""")
def runs(spark, sf_dir):
    bits = raster(spark, sf_dir).select("y", "x", (F.col("s") >= 128).cast("long").alias("value"))
    return R.runs(bits, ["y"], "x", "value")


@query("with $RASTER select y, x, case when s >= 128 then 1 else 0 end::bigint as value from raster")
def expand_runs(spark, sf_dir):
    bits = raster(spark, sf_dir).select("y", "x", (F.col("s") >= 128).cast("long").alias("value"))
    return R.expand_runs(R.runs(bits, ["y"], "x", "value")).select("y", "x", "value")


PALETTE = [(0, 0, 0), (64, 32, 16), (128, 128, 128), (192, 160, 200), (255, 255, 255)]


@query("with $RASTER, palette(i, r, g, b) as (values " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE)) + """),
    rgb as (select distinct s as r, 255 - s as g, s // 2 as b from raster),
    d as (select rgb.*, i, (rgb.r - p.r) * (rgb.r - p.r) + (rgb.g - p.g) * (rgb.g - p.g) + (rgb.b - p.b) * (rgb.b - p.b) as d from rgb, palette p)
    select r, g, b, i::bigint as i from (select *, row_number() over (partition by r, g, b order by d, i) as k from d) where k = 1""")
def nearest_palette(spark, sf_dir):
    s = raster(spark, sf_dir).select("s").distinct()
    return R.nearest(s.select(F.col("s").alias("r"), (255 - F.col("s")).alias("g"), P.idiv(F.col("s"), 2).alias("b")), ["r", "g", "b"], PALETTE)


@query("with $RASTER, palette(i, r, g, b) as (values " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE)) + """),
    d as (select y, x, i, (s - p.r) * (s - p.r) + (255 - s - p.g) * (255 - s - p.g) + (s // 2 - p.b) * (s // 2 - p.b) as d from raster, palette p)
    select y, x, arg_min(i, d * 256 + i)::bigint as i from d group by y, x""")
def map_colours(spark, sf_dir):
    s = F.col("s")
    px = raster(spark, sf_dir).select("y", "x", s.alias("r"), (255 - s).alias("g"), P.idiv(s, 2).alias("b"))
    return R.map_colours(px, ["r", "g", "b"], PALETTE).select("y", "x", "i")


@query("with $RASTER select y // 64 as tile, bool_or(s = 0) as clear, bool_or(s < 128) as needs_transparent, bool_or(s > 200) as bright from raster group by y // 64")
def any_pixel(spark, sf_dir):
    s = F.col("s")
    px = raster(spark, sf_dir).select(P.idiv(F.col("y"), 64).alias("tile"), "s")
    return R.any_pixel(px, {"clear": s == 0, "needs_transparent": s < 128, "bright": s > 200}, ["tile"])


@query("with $RASTER select count(distinct s) as colours, label from raster group by label")
def distinct_colours(spark, sf_dir):
    return R.distinct_colours(raster(spark, sf_dir), ["s"], ["label"])


@query("with $RASTER select label % 3 as part, count(distinct s * 1000 + x) as colours, true as close from raster group by label % 3")
def distinct_merged(spark, sf_dir):
    """Distinct (value, column) pairs of groups of images, counted, and estimated from sketches of the images."""
    px = raster(spark, sf_dir).withColumn("part", F.col("label") % 3)
    exact = R.distinct_colours(px, ["s", "x"], ["part"])
    sketches = R.colour_sketches(px, ["s", "x"], ["part", "label"])
    near = R.merged_colours(sketches, ["part"]).withColumnRenamed("colours", "estimate")
    return exact.join(near, "part").select("part", "colours", (F.abs(F.col("estimate") - F.col("colours")) <= 0.05 * F.col("colours") + 1).alias("close"))


@query("with $RASTER select label, (row_number() over (partition by label order by s) - 1)::bigint as i, s from (select distinct label, s from raster)")
def palette_exact(spark, sf_dir):
    return R.exact_palette(R.histogram(raster(spark, sf_dir), ["s"], ["label"]), "s", ["label"])


@query("""with $RASTER, first as (select label, s, min(y * 64 + x) as spot from raster group by label, s)
    select label, s, (row_number() over (partition by label order by spot) - 1)::bigint as i from first""")
def first_seen_index(spark, sf_dir):
    return R.first_seen(raster(spark, sf_dir), ["label"], ["y", "x"], "s").select("label", "s", "i")


@query("with $RASTER select y, x, case when s % 7 = 3 then 9 when s % 7 < 4 then (s % 7) * 10 when s % 7 = 5 then 55 else 0 end::bigint as grey from raster")
def palette_lookup(spark, sf_dir):
    px = raster(spark, sf_dir).select(F.lit(0).alias("image"), "y", "x", (F.col("s") % 7).alias("index"))
    local = spark.createDataFrame([(0, 3, 9)], "image int, i long, grey long")
    common = spark.createDataFrame([(0, 0), (1, 10), (2, 20), (3, 30), (5, 55)], "i long, grey long")
    return R.palette_lookup(px, "index", local, common, ["image"], ["grey"], 0).select("y", "x", "grey")


@query("with $RASTER, w as (select label, s, count(*) as n from raster group by label, s) select label, ((sum(s * n) + sum(n) // 2) // sum(n))::bigint as s from w group by label")
def weighted_mean(spark, sf_dir):
    return R.weighted_mean(R.histogram(raster(spark, sf_dir), ["s"], ["label"]), ["s"], "n", ["label"])


def cut_sql(most: int, rounds: int) -> str:
    """Median cut of the colours (s, 255 - s, s // 2) of each label, a table of boxes for each round."""
    channel = "case ch when 0 then r when 1 then g else b end"
    ctes = ["h as (select label, s as r, 255 - s as g, s // 2 as b, count(*) as n from raster group by label, s)", "b0 as (select *, 0::bigint as box from h)"]
    for k in range(1, rounds + 1):
        errors = ", ".join(f"(4 * (sum(n)::hugeint * sum({c} * {c} * n)::hugeint - sum({c} * n)::hugeint * sum({c} * n)::hugeint)) // sum(n)::hugeint as e{c}" for c in "rgb")
        ctes += [
            f"e{k} as (select label, box, {errors} from b{k - 1} group by label, box)",
            f"r{k} as (select *, case when er >= eg and er >= eb then 0 when eg >= eb then 1 else 2 end as ch, row_number() over (partition by label order by er + eg + eb desc, box) as turn, count(*) over (partition by label) as boxes from e{k})",
            f"c{k} as (select label, box, ch, boxes + turn - 1 as fresh from r{k} where er + eg + eb > 0 and turn <= {most} - boxes)",
            f"x{k} as (select c.label, c.box, fresh, ch, {channel} as x, sum(n) as m from b{k - 1} p join c{k} c on c.label = p.label and c.box = p.box group by c.label, c.box, fresh, ch, {channel})",
            f"w{k} as (select *, sum(m) over (partition by label, box order by x) as cum, sum(m) over (partition by label, box) as total, max(x) over (partition by label, box) as top from x{k})",
            f"v{k} as (select label, box, fresh, ch, coalesce(min(x) filter (where 2 * cum >= total), max(x)) as edge from w{k} where x < top group by label, box, fresh, ch)",
            f"b{k} as (select p.label, r, g, b, n, case when {channel} > edge then fresh else p.box end::bigint as box from b{k - 1} p left join v{k} v on v.label = p.label and v.box = p.box)",
        ]
    means = ", ".join(f"((sum({c} * n) + sum(n) // 2) // sum(n))::bigint as {c}" for c in "rgb")
    ctes.append(f"p0 as (select label, box, {means} from b{rounds} group by label, box)")
    for k in (1, 2):
        d = " + ".join(f"(h.{c} - p.{c}) * (h.{c} - p.{c})" for c in "rgb")
        ctes += [
            f"n{k} as (select h.label, h.r, h.g, h.b, h.n, arg_min(p.box, ({d}) * 1000 + p.box) as box from h join p{k - 1} p on p.label = h.label group by h.label, h.r, h.g, h.b, h.n)",
            f"m{k} as (select label, box, {means} from n{k} group by label, box)",
            f"p{k} as (select p.label, p.box, {', '.join(f'coalesce(m.{c}, p.{c}) as {c}' for c in 'rgb')} from p{k - 1} p left join m{k} m on m.label = p.label and m.box = p.box)",
        ]
    return "with $RASTER, " + ", ".join(ctes) + " select label, (row_number() over (partition by label order by r, g, b) - 1)::bigint as i, r, g, b from (select distinct label, r, g, b from p2)"


@query(cut_sql(16, 6))
def median_cut(spark, sf_dir):
    s = F.col("s")
    rgb = raster(spark, sf_dir).select("label", s.alias("r"), (255 - s).alias("g"), P.idiv(s, 2).alias("b"))
    return colours.median_cut(R.histogram(rgb, ["r", "g", "b"], ["label"]), ["label"], 16)


@query("""with palette as (select o_orderkey as i, o_orderkey * 7 % 256 as r, o_custkey * 5 % 256 as g, o_orderkey // 3 % 256 as b from orders),
    asked as (select distinct c_custkey % 256 as r, c_custkey * 3 % 251 as g, c_nationkey * 10 as b from customer)
    select r, g, b, arg_min(i, d * 100000000 + i)::bigint as i from
    (select a.r, a.g, a.b, i, (a.r - p.r) * (a.r - p.r) + (a.g - p.g) * (a.g - p.g) + (a.b - p.b) * (a.b - p.b) as d from asked a, palette p) group by r, g, b""")
def nearest_of_many(spark, sf_dir):
    """Nearest entries of a palette of more colours than files have, by a grid."""
    o, c, n = F.col("o_orderkey"), F.col("c_custkey"), F.col("c_nationkey")
    palette = table(spark, sf_dir, "orders").select(o.alias("i"), (o * 7 % 256).alias("r"), (F.col("o_custkey") * 5 % 256).alias("g"), (P.idiv(o, 3) % 256).alias("b"))
    asked = table(spark, sf_dir, "customer").select((c % 256).cast("long").alias("r"), (c * 3 % 251).cast("long").alias("g"), (n * 10).cast("long").alias("b")).distinct()
    return colours.nearest_by_grid(asked, colours.RGB, palette)


@query("""with $RASTER, px as (select label, y, x % 8 as px, x // 8 as py, s // 32 as v from raster),
    d as (select *, lag(v) over (partition by label, px, py order by y) as b from px)
    select label, y as frame, min(px) as "left", min(py) as top, max(px) + 1 as "right", max(py) + 1 as bottom from d where b is distinct from v group by label, y""")
def change_bbox(spark, sf_dir):
    px = raster(spark, sf_dir).select("label", F.col("y").alias("frame"), (F.col("x") % 8).alias("x"), P.idiv(F.col("x"), 8).alias("y"), P.idiv(F.col("s"), 32).alias("v"))
    return R.bounding_box(R.changed(px, ["label"], "frame", "v"), ["label", "frame"])


@query("""with $FRAMES select user_id, event_id, delay_cs from
    (select *, lead(1) over (partition by user_id order by ts, event_id) as n from frames) where delay_cs > 0 or n is null""")
def viewer_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 3).alias("delay_cs"))
    return R.viewer_frames(frames, ["user_id"], ["ts", "event_id"], "delay_cs").select("user_id", "event_id", "delay_cs")


@query("""with recursive $RASTER, cells as (select label, y, x, case when s >= 100 then s // 100 else 0 end as v, y % 4 as disposal, row_number() over (partition by label, x order by y) as k from raster),
    fold as (select label, x, k, y, v, disposal, 0::bigint as under, case when v > 0 then v else 0::bigint end as shown from cells where k = 1
        union all select c.label, c.x, c.k, c.y, c.v, c.disposal,
            case f.disposal when 2 then 0 when 3 then f.under else f.shown end,
            case when c.v > 0 then c.v else case f.disposal when 2 then 0 when 3 then f.under else f.shown end end
        from fold f join cells c on c.label = f.label and c.x = f.x and c.k = f.k + 1)
    select label, y as frame, sum(shown)::bigint as total, count(*) filter (where shown > 0)::bigint as visible from fold group by label, y""")
def disposal_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("vec_id").alias("frame"), F.col("embedding").alias("e"))
    s = F.transform("e", lambda v: P.idiv(P.float_to_u8(v.cast("double") + 0.5), 100))
    patches = rows.select("label", "frame", F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(64).alias("w"), F.lit(1).alias("h"), (F.col("frame") % 4).cast("int").alias("disposal"), P.bytes_of(s).alias("index"))
    shown = R.composite(patches, "label", 64, 1).groupBy("label", "frame").agg(F.sum("value").alias("total"), F.count("*").alias("visible"))
    return rows.select("label", "frame").join(shown, ["label", "frame"], "left").na.fill(0, ["total", "visible"])


@query("""with $RASTER, px as (select y // 64 as tile, y % 64 as y, x, s from raster)
    select tile, o::bigint as o, case when o in (1, 2) then y when o in (3, 4) then 63 - y when o in (5, 6) then x else 63 - x end as row,
    case when o in (1, 4) then x when o in (2, 3) then 63 - x when o in (5, 8) then y else 63 - y end as col, s from px, range(1, 9) t(o)""")
def orient_all(spark, sf_dir):
    px = raster(spark, sf_dir).withColumn("o", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))))
    row, col = P.oriented(F.col("y") % 64, F.col("x"), F.lit(64), F.lit(64), F.col("o"))
    return px.select(P.idiv(F.col("y"), 64).alias("tile"), "o", row.alias("row"), col.alias("col"), "s")


@query("with $RASTER select 63 - (y % 64) as y, x, s, y // 64 as tile from raster")
def bottom_up(spark, sf_dir):
    return raster(spark, sf_dir).select(P.bottom_up(F.col("y") % 64, 64).alias("y"), "x", "s", P.idiv(F.col("y"), 64).alias("tile"))


@query("""with heights as (select unnest(range(1, 70)) as h), stored as (select h, unnest(range(0, h)) as k from heights),
    passes as (select h, unnest(range(0, h)) as y from heights), ranked as (select h, y, row_number() over (partition by h order by case when y % 8 = 0 then 0 when y % 8 = 4 then 1 when y % 4 = 2 then 2 else 3 end, y) - 1 as k from passes)
    select h::bigint as h, k::bigint as k, y::bigint as y from ranked""")
def interlace_order(spark, sf_dir):
    h = spark.range(1, 70).select(F.col("id").alias("h"))
    return h.withColumn("k", F.explode(F.expr("sequence(0L, h - 1)"))).withColumn("y", P.interlaced_row(F.col("k"), F.col("h")))


@query("with $RASTER select y, x, ((s // 8) * 255 + 15) // 31 as r, ((s // 4) * 255 + 31) // 63 as g, ((s // 8) * 255 + 15) // 31 as b from raster")
def mask_scale(spark, sf_dir):
    s = F.col("s")
    word = F.shiftleft(P.idiv(s, 8), 11).bitwiseOR(F.shiftleft(P.idiv(s, 4), 5)).bitwiseOR(P.idiv(s, 8))
    return raster(spark, sf_dir).select("y", "x", *(P.mask_channel(word, m).alias(c) for c, m in zip("rgb", (0xF800, 0x7E0, 0x1F), strict=True)))


@query("with $RASTER select y, x, ((s // 64) * 255 + 1) // 3 as d2, ((s // 16) * 255 + 7) // 15 as d4, ((s * 16) * 65535 + 2047) // 4095 as d12, ((s * 257) * 255 + 32767) // 65535 as back from raster")
def depth_scale(spark, sf_dir):
    s = F.col("s")
    return raster(spark, sf_dir).select("y", "x", P.scale(P.idiv(s, 64), 3, 255).alias("d2"), P.scale(P.idiv(s, 16), 15, 255).alias("d4"), P.scale(s * 16, 4095, 65535).alias("d12"), P.u16_to_u8(s * 257).alias("back"))


@query("with $RASTER select y, x, xor(s, 128) as u, 255 - s as inverse, s // 16 as high, s % 16 as low from raster")
def signed_invert(spark, sf_dir):
    s = F.col("s")
    return raster(spark, sf_dir).select("y", "x", P.signed_to_unsigned(s, 8).alias("u"), P.invert(s, 8).alias("inverse"), P.palette_index(s, 0, 4).alias("high"), P.palette_index(s, 1, 4).alias("low"))


@query("""with $RASTER, f as (select y, x, s::double * 255 / 255 as a, (255 - s - 128.0::double) * 127 / 127 as b, (s // 2 - 128.0::double) * 127 / 127 as c from raster),
    rb as (select *, c * (2 - 2 * 0.299::double) + a as red, b * (2 - 2 * 0.114::double) + a as blue from f),
    rgb as (select *, (a - 0.114::double * blue - 0.299::double * red) / 0.587::double as green from rb)
    select y, x, least(greatest(floor(red + 0.5), 0), 255)::bigint as r, least(greatest(floor(green + 0.5), 0), 255)::bigint as g, least(greatest(floor(blue + 0.5), 0), 255)::bigint as b from rgb""")
def ycbcr_rgb(spark, sf_dir):
    s = F.col("s")
    r, g, b = P.ycbcr_to_rgb(s, 255 - s, P.idiv(s, 2))
    return raster(spark, sf_dir).select("y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


@query("with $RASTER select y, x, ((255 - s) * (s)) // 255 as r, (s * s) // 255 as g, ((255 - s // 2) * s) // 255 as b from raster")
def cmyk_rgb(spark, sf_dir):
    s = F.col("s")
    r, g, b = P.cmyk_to_rgb(s, 255 - s, P.idiv(s, 2), 255 - s)
    return raster(spark, sf_dir).select("y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


@query("with $RASTER select y, x, case when x * 4 > 0 then least(255, (s * 255 + (x * 4) // 2) // (x * 4)) else 0 end as v from raster")
def unpremultiply(spark, sf_dir):
    return raster(spark, sf_dir).select("y", "x", P.unpremultiply(F.col("s"), F.col("x") * 4).alias("v"))


@query("with $RASTER select y, x, case when s < 128 then 0 else s end as v, case when s < 128 then 0 else 255 end::bigint as a from raster")
def alpha_threshold(spark, sf_dir):
    v, a = P.alpha_threshold([F.col("s")], F.col("s"))
    return raster(spark, sf_dir).select("y", "x", v.alias("v"), a.alias("a"))


@query("with $RASTER select s * 65536 + (255 - s) * 256 + s // 2 as packed, s as r, 255 - s as g, s // 2 as b, count(*) as n from raster group by s")
def pack_rgb(spark, sf_dir):
    s = F.col("s")
    packed = raster(spark, sf_dir).select(P.pack_rgb(s, 255 - s, P.idiv(s, 2)).alias("packed"))
    r, g, b = P.unpack_rgb(F.col("packed"))
    return packed.groupBy("packed").agg(F.count("*").alias("n")).select("packed", r.alias("r"), g.alias("g"), b.alias("b"), "n")


@query("select n::bigint as n, greatest(1, ceil(log2(n)))::bigint as bits from range(1, 257) t(n)")
def table_bits(spark, sf_dir):
    return spark.range(1, 257).select(F.col("id").alias("n"), P.table_bits(F.col("id")).alias("bits"))


@query("""with $RASTER, q as (select label, s, (s // 16) * 17 as t from raster)
    select label, round(10 * log10(65025.0::double / avg((s - t)::double * (s - t))), 6) as psnr, max(abs(s - t))::double as max_diff, round(avg(abs(s - t)), 9) as mean_diff from q group by label""")
def quality(spark, sf_dir):
    px = raster(spark, sf_dir).withColumn("t", P.idiv(F.col("s"), 16) * 17)
    return R.quality(px, "s", "t", ["label"]).select("label", F.round("psnr", 6).alias("psnr"), "max_diff", F.round("mean_diff", 9).alias("mean_diff"))


@query("""select o_orderkey, case when o_orderkey % 5 = 0 or o_custkey % 7 = 0 then 'Invalid' when (o_orderkey % 5 * 4000) * (o_custkey % 7 * 4000) > 100000000 then 'LimitExceeded' end as error from orders""")
def limit_guard(spark, sf_dir):
    w, h = F.col("o_orderkey") % 5 * 4000, F.col("o_custkey") % 7 * 4000
    return table(spark, sf_dir, "orders").select("o_orderkey", P.limit_error(w, h, 100_000_000).alias("error"))


@query("select o_orderkey, case o_orderkey % 7 when 0 then 1 when 1 then 2 when 2 then 3 when 5 then 5 when 6 then 0 else 4 end::bigint as channels from orders")
def channel_counts(spark, sf_dir):
    names = F.array(*map(F.lit, ("Gray", "GrayAlpha", "Rgb", "Rgba", "Cmyk", "CmykAlpha", "Lab")))
    colour = F.element_at(names, (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(P.channels_of(colour), F.lit(0)).alias("channels"))


@query("""select doc_id, case when doc_id % 4 = 0 then 'gif' when doc_id % 4 = 1 then 'bmp' when doc_id % 4 = 2 then 'tiff' end as format from documents""")
def magic_bytes(spark, sf_dir):
    head = F.element_at(F.array(*(F.unhex(F.lit(h)) for h in ("474946383961", "424D0000", "4D4D002A", "89504E47"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", P.magic(F.concat(head, F.encode("text", "utf-8"))).alias("format"))


@query("select c_custkey, coalesce(case when c_custkey % 3 = 0 then null else c_nationkey end, case when c_custkey % 6 in (2, 3, 4) then 0 when c_custkey % 5 >= 3 then 2 else 1 end)::bigint as photometric from customer")
def photometric_default(spark, sf_dir):
    key = F.col("c_custkey")
    found = P.inferred_photometric(F.when(key % 3 != 0, F.col("c_nationkey")), key % 6, key % 5)
    return table(spark, sf_dir, "customer").select("c_custkey", found.cast("long").alias("photometric"))


# --- strips and tags --------------------------------------------------------------------------------


PAGES_SQL = """pages_ as (select p_partkey as path, (p_partkey % 97 + 1)::bigint as width, (p_partkey % 61 + 1)::bigint as height, (p_partkey % 3 + 1)::bigint as spp, case when p_partkey % 2 = 0 then 2 else 1 end as planar,
    case when p_partkey % 3 = 0 then 16 end as tile, least(p_partkey % 7 + 1, p_partkey % 61 + 1) as rps from part)"""


@query("with " + PAGES_SQL + """, geo as (select *, coalesce(tile, width) as cw, coalesce(tile, rps) as ch, case when planar = 2 then spp else 1 end as planes from pages_),
    g2 as (select *, (width + cw - 1) // cw as across, (height + ch - 1) // ch as down from geo),
    c as (select *, unnest(range(0, across * down * planes)) as idx from g2)
    select path, idx::bigint as idx, (idx // (across * down))::bigint as plane, ((idx % (across * down)) % across * cw)::bigint as x0, ((idx % (across * down)) // across * ch)::bigint as y0, cw::bigint as width,
        (case when tile is not null then ch else least(ch, height - (idx % (across * down)) // across * ch) end)::bigint as rows from c""")
def chunks_enumerate(spark, sf_dir):
    key = F.col("p_partkey")
    height = (key % 61 + 1).cast("long")
    tile = F.when(key % 3 == 0, F.lit(16).cast("long"))
    pages = table(spark, sf_dir, "part").select(key.alias("path"), F.lit(0).alias("page"), (key % 97 + 1).cast("long").alias("width"), height.alias("height"), (key % 3 + 1).cast("long").alias("samples_per_pixel"),
        F.when(key % 2 == 0, 2).otherwise(1).alias("planar"), tile.alias("tile_w"), tile.alias("tile_h"), F.least(key % 7 + 1, height).alias("rows_per_strip"))
    return R.enumerate_chunks(pages).select("path", "idx", "plane", "x0", "y0", F.col("chunk_width").alias("width"), F.col("chunk_rows").alias("rows"))


RETILED_SQL = """with pages_ as (select p_partkey as path, (p_partkey % 47 + 1)::bigint as width, (p_partkey % 31 + 1)::bigint as height, (p_partkey % 3 + 1)::bigint as spp from part),
    ys as (select *, unnest(range(0, height)) as y from pages_), xs as (select *, unnest(range(0, width)) as x from ys), px as (select *, unnest(range(0, spp)) as c from xs)
    select path, (x // 20)::int as bx, (y // 12)::int as "by", least(20, min(width) - x // 20 * 20)::int as w, least(12, min(height) - y // 12 * 12)::int as h,
        sha256(unhex(string_agg(printf('%02x', (path + 31 * c + 7 * x + 13 * y) % 251), '' order by y, x, c))) as digest from px group by path, x // 20, y // 12"""


@query(RETILED_SQL)
def retiled(spark, sf_dir):
    """Strips, tiles and planes of pages in blocks of another size."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    parts = parts.repartition(max(spark.sparkContext.defaultParallelism, -(-parts.count() // PAGES_A_TASK)))  # few bytes of keys are many of samples
    key = F.col("p_partkey").cast("long")
    height, tile = key % 31 + 1, F.when(key % 3 == 0, F.lit(16).cast("long"))
    pages = parts.select(key.alias("path"), F.lit(0).alias("page"), (key % 47 + 1).alias("width"), height.alias("height"), (key % 3 + 1).alias("samples_per_pixel"),
        F.when(key % 2 == 0, 2).otherwise(1).alias("planar"), tile.alias("tile_w"), tile.alias("tile_h"), F.least(key % 7 + 1, height).alias("rows_per_strip"))
    chunks = R.enumerate_chunks(pages)
    inner = F.when(F.col("planar") == 2, 1).otherwise(F.col("samples_per_pixel")).cast("int")
    # 7 x goes through all remainders by 251 before it repeats, so a row is a part of one line for each number of samples, from the x where 7 x is the row's first value: 36 is the inverse of 7
    line = F.element_at(F.array(*(F.lit(bytes((7 * x + 31 * c) % 251 for x in range(251 + 47) for c in range(n))) for n in (1, 2, 3))), inner)
    x = lambda y: (F.col("path") + 31 * F.col("plane") + 7 * F.col("x0") + 13 * (F.col("y0") + y)) % 251 * 36 % 251
    row = lambda y: F.substring(line, (x(y) * inner + 1).cast("int"), (F.col("chunk_width") * inner).cast("int"))
    data = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("chunk_rows") - 1), F.lit(b""), lambda rows, y: F.concat(rows, row(y)))
    blocks = R.retile(chunks.withColumn("data", data), 20, 12, sample_bytes=1)
    return blocks.select("path", "bx", "by", "w", "h", F.sha2("samples", 256).alias("digest"))


def tiff_files(spark: SparkSession, sf_dir: str, options: tiff.EncodeOptions = tiff.EncodeOptions("Lzw", True, strip_bytes=1000)) -> DataFrame:
    t = tiles(spark, sf_dir)
    return t.select(F.col("tile").cast("string").alias("path"), "ys", "width", "height", udfs.tiff_encode(F.col("samples"), F.col("width"), F.col("height"), "Gray8", options).alias("content"))


TILES_SQL = "tiles as (select (vec_id // 64)::varchar as path, count(*) as height, 64::bigint as width from embeddings group by vec_id // 64)"


@query("with " + TILES_SQL + """ select path, width, height, [8::bigint] as bits_per_sample, 5::bigint as compression, 1::bigint as photometric, 1::bigint as samples_per_pixel, least(15, height) as rows_per_strip, 2::bigint as predictor from tiles""")
def tiff_page_fields(spark, sf_dir):
    fields = R.page_fields(readers.tags(tiff_files(spark, sf_dir)))
    return fields.select("path", "width", "height", "bits_per_sample", "compression", "photometric", "samples_per_pixel", "rows_per_strip", "predictor")


@query("with " + TILES_SQL + """, s as (select *, unnest(range(0, (height + 14) // 15)) as idx from tiles)
    select path, idx::bigint as idx, (idx * 15)::bigint as y0, least(15, height - idx * 15)::bigint as rows, true as placed from s""")
def tiff_strips_located(spark, sf_dir):
    tags = readers.tags(tiff_files(spark, sf_dir))
    found = R.locate_chunks(R.enumerate_chunks(R.page_fields(tags)), tags)
    return found.select("path", "idx", "y0", F.col("chunk_rows").alias("rows"), (F.col("offset").isNotNull() & F.col("byte_count").isNotNull()).alias("placed"))


@query("with $RASTER, r as (select *, (row_number() over (partition by y // 64, x order by y) - 1) as k from raster) select y, x, s from r where k < 15")
def tiff_crop(spark, sf_dir):
    """The top strip of each page, the only one that is decoded."""
    files = tiff_files(spark, sf_dir)
    wanted = readers.chunks(files).where("y0 = 0")
    got = readers.chunk_pixels(files, wanted).where("error is null").select("path", "data")
    images = got.join(files.select("path", "ys", "width"), "path").select(F.slice("ys", 1, 15).alias("ys"), "width", "data")
    return exploded(images, F.col("data"), 8)


@query("with $RASTER select y, x, s from raster")
def assembled_strips(spark, sf_dir):
    """Strips decoded one by one, as for pages larger than a task, and put together again."""
    files = tiff_files(spark, sf_dir)
    places = readers.chunks(files)
    data = readers.chunk_pixels(files, places).select("path", "page", "idx", "data")
    pages = files.select("path", F.lit(0).alias("page"), "width", "height", F.lit(1).alias("channels"))
    whole = R.assemble(places.drop("error").join(data, ["path", "page", "idx"]), pages)
    return exploded(whole.join(files.select("path", "ys", "width"), "path"), F.col("samples"), 8)


@query("with $RASTER select y, x, s from raster")
def tiff_roundtrip(spark, sf_dir):
    files = tiff_files(spark, sf_dir)
    decoded = readers.pages(files).select("path", "samples").join(files.select("path", "ys", "width"), "path")
    return exploded(decoded, F.col("samples"))


@query("with $RASTER select y, x, s from raster")
def bmp_roundtrip(spark, sf_dir):
    t = tiles(spark, sf_dir)
    files = t.select("ys", "width", udfs.bmp_encode(udfs.grey_rgba(F.col("samples")), F.col("width"), F.col("height"), F.lit("Rgb24")).alias("content"))
    return exploded(files.select("ys", "width", udfs.bmp_decode(F.col("content")).alias("rgba")), F.col("rgba"), 4)


@query("with $RASTER select y, x, s from raster")
def gif_roundtrip(spark, sf_dir):
    t = tiles(spark, sf_dir)
    files = t.select("ys", "width", udfs.gif_encode(udfs.grey_rgba(F.col("samples")), F.col("width"), F.col("height")).alias("content"))
    return exploded(files.select("ys", "width", udfs.gif_first_frame(F.col("content")).alias("rgba")), F.col("rgba"), 4)


@query("with $RASTER select y, x, case when s >= 128 then 1 else 0 end::bigint as s from raster")
def fax_roundtrip(spark, sf_dir):
    """Rows as two-level images through group 4 and back."""
    row = F.transform("embedding", lambda v: F.when(P.float_to_u8(v.cast("double") + 0.5) >= 128, "1").otherwise("0"))
    bits = F.unhex(F.lpad(F.conv(F.array_join(row, ""), 2, 16), 16, "0"))
    rows = table(spark, sf_dir, "embeddings").select(F.array("vec_id").alias("ys"), F.lit(64).alias("width"), udfs.fax_encode(bits, F.lit(64), F.lit(1), F.lit("g4")).alias("fax"))
    back = rows.select("ys", "width", udfs.fax_decode(F.col("fax"), F.lit(64), F.lit(1), F.lit("g4")).alias("bits"))
    digits = F.split(F.lpad(F.conv(F.hex("bits"), 16, 2), 64, "0"), "")
    return back.select(F.element_at("ys", 1).alias("y"), F.posexplode(F.slice(digits, 1, 64)).alias("x", "d")).select("y", F.col("x").cast("long").alias("x"), F.col("d").cast("long").alias("s"))


# --- codecs over whole texts ------------------------------------------------------------------------

BYTES_SQL = "select doc_id, octet_length(encode(text))::bigint as n, md5(text) as digest from documents"


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("text", "utf-8")
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a codec is worth a shuffle only where few files would leave cores idle
        docs = docs.select("doc_id", "text").repartition(cores)
    return docs.select("doc_id", data.alias("data"), F.octet_length(data).alias("size"))


def summary(rows: DataFrame, data: str) -> DataFrame:
    return rows.select("doc_id", F.octet_length(data).cast("long").alias("n"), F.md5(data).alias("digest"))


def codec(name: str, encode, decode) -> None:
    def run(spark, sf_dir):
        coded = text_bytes(spark, sf_dir).select("doc_id", "size", encode(F.col("data")).alias("coded"))
        return summary(coded.select("doc_id", decode(F.col("coded"), F.col("size")).alias("back")), "back")

    run.__name__ = name
    query(BYTES_SQL)(run)


codec("packbits_roundtrip", udfs.packbits_encode, udfs.packbits_decode)
codec("tiff_lzw_roundtrip", udfs.tiff_lzw_encode, udfs.tiff_lzw_decode)
codec("gif_lzw_roundtrip", udfs.gif_lzw_encode, udfs.gif_lzw_decode)
codec("deflate_roundtrip", udfs.deflate, udfs.inflate)
codec("bit_reversal", udfs.reverse_bits, lambda data, size: udfs.reverse_bits(data))


@query("select vec_id // 64 as tile, (54 + count(*) * 192)::bigint as n from embeddings group by vec_id // 64")
def bmp_size(spark, sf_dir):
    t = tiles(spark, sf_dir)
    files = t.select("tile", udfs.bmp_encode(udfs.grey_rgba(F.col("samples")), F.col("width"), F.col("height"), F.lit("Rgb24")).alias("content"))
    return files.select("tile", F.octet_length("content").cast("long").alias("n"))
