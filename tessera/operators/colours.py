"""Palettes of histograms of any size: median cut by rounds, refinement, and nearest entries by a grid.

A histogram is a table with a row for each colour of an image; no image's rows need
to meet in one task. What a round learns of a box is sums and at most 256 values of
one channel; what it sends back is one plane for each box.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.pixels import idiv, long, pack_rgb
from tessera.scratch import Workspace

RGB = ("r", "g", "b")
#: Rows of boxes or planes up to which they are sent to every task; more are joined.
FEW_BOXES = 1 << 16
#: Entries of a palette up to which each colour is held against all of them at once.
FEW_ENTRIES = 256
#: Edges of the cells of the colour grid; the last has all.
CELLS = (16, 32, 64, 128, 256)


def few(df: DataFrame, most: int = FEW_BOXES) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def mean(total: Column, n: Column) -> Column:
    """Mean of non-negative numbers, halves rounded up."""
    return idiv(total + idiv(n, 2), n)


def planes(ws: Workspace, k: int, rows: DataFrame, key: Sequence[str], most: int) -> DataFrame:
    """(key, box, channel, at, new) of the boxes that a round cuts: values of the channel over at go to the box new.

    As many boxes as there are entries left are cut, those with the largest squared error
    first, across the channel with the most of it, at the median of its values.
    """
    wide = lambda c: c.cast("decimal(19,0)")
    sums = [F.sum("n").alias("n")] + [F.sum(F.col(c) * F.col("n")).alias(f"s{c}") for c in RGB] + [F.sum(F.col(c) * F.col(c) * F.col("n")).alias(f"q{c}") for c in RGB]
    boxes = ws.save(rows.groupBy(*key, "box").agg(*sums), f"sums-{k}")
    # four times the error, whole: at least 1 where there are two values
    error = [F.call_function("div", 4 * (wide(F.col("n")) * wide(F.col(f"q{c}")) - wide(F.col(f"s{c}")) * wide(F.col(f"s{c}"))), wide(F.col("n"))) for c in RGB]
    boxes = boxes.select(*key, "box", F.array(*error).alias("errors")).withColumn("score", F.aggregate("errors", F.lit(0).cast("long"), lambda a, e: a + e))
    image = Window.partitionBy(*key)
    boxes = boxes.withColumn("rank", F.row_number().over(image.orderBy(F.col("score").desc(), "box"))).withColumn("boxes", F.count("*").over(image))
    boxes = boxes.where((F.col("score") > 0) & (F.col("rank") <= most - F.col("boxes")))
    boxes = boxes.select(*key, "box", F.array_position("errors", F.array_max("errors")).cast("int").alias("channel"), (F.col("boxes") + F.col("rank") - 1).alias("new"))
    value = F.element_at(F.array(*RGB), F.col("channel"))
    values = rows.join(few(boxes), [*key, "box"]).groupBy(*key, "box", "channel", "new", value.alias("v")).agg(F.sum("n").alias("n"))
    box = Window.partitionBy(*key, "box")
    so_far = F.sum("n").over(box.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    values = values.select("*", so_far.alias("before"), F.sum("n").over(box).alias("all"), F.max("v").over(box).alias("top")).where("v < top")
    return values.groupBy(*key, "box", "channel", "new").agg(F.coalesce(F.min(F.when(2 * F.col("before") >= F.col("all"), F.col("v"))), F.max("v")).alias("at"))


def median_cut(counts: DataFrame, image: Sequence[str], most: int, refine: int = 2) -> DataFrame:
    """(image, i, r, g, b) of a palette of at most so many colours for each image; counts has image, r, g, b, n.

    Boxes are cut in rounds until an image has ``most`` of them or none holds two colours;
    entries are the means of boxes, moved ``refine`` times to the means of the colours
    nearest to them. Equal entries are one; entries are in order of colour.
    """
    ws = Workspace(counts.sparkSession, "colours")
    key = [*image, "__all"]  # a key also where there are no image columns
    rows = counts.select(*image, F.lit(0).alias("__all"), *(long(F.col(c)).alias(c) for c in (*RGB, "n")), F.lit(0).cast("long").alias("box"))
    rows = ws.save(rows, "boxes-0")
    for k in range(1, most):
        cuts = ws.save(planes(ws, k, rows, key, most), f"planes-{k}")
        if not cuts.limit(1).count():
            break
        over = F.element_at(F.array(*RGB), F.col("channel")) > F.col("at")
        rows = rows.join(few(cuts), [*key, "box"], "left")
        rows = ws.save(rows.select(*key, *RGB, "n", F.when(over, F.col("new")).otherwise(F.col("box")).alias("box")), f"boxes-{k}")
        ws.drop(f"boxes-{k - 1}")
    means = [mean(F.sum(F.col(c) * F.col("n")), F.sum("n")).alias(c) for c in RGB]
    palette = ws.save(rows.groupBy(*key, "box").agg(*means), "palette")
    colours = rows.drop("box")
    for k in range(refine):
        near = nearest_entries(colours, key, palette) if most <= FEW_ENTRIES else nearest_by_grid(colours, RGB, palette.withColumnRenamed("box", "i"), "box", key)
        moved = near.groupBy(*key, "box").agg(*means)
        palette = palette.select(*key, "box", F.struct(*RGB).alias("old")).join(moved, [*key, "box"], "left")
        palette = ws.save(palette.select(*key, "box", *(F.coalesce(F.col(c), F.col(f"old.{c}")).alias(c) for c in RGB)), f"palette-{k}")
    order = Window.partitionBy(*key).orderBy(pack_rgb(*(F.col(c) for c in RGB)))
    return palette.select(*key, *RGB).distinct().withColumn("i", (F.row_number().over(order) - 1).cast("long")).select(*image, "i", *RGB)


def squared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    terms = [(x - y) * (x - y) for x, y in zip(a, b, strict=True)]
    return sum(terms[1:], terms[0])


def nearest_entries(colours: DataFrame, key: Sequence[str], palette: DataFrame) -> DataFrame:
    """colours with box: the nearest of at most FEW_ENTRIES entries of the image, the first of equals."""
    entries = palette.groupBy(*key).agg(F.collect_list(F.struct("box", *RGB)).alias("__entries"))
    mine = [F.col(c) for c in RGB]
    near = F.array_min(F.transform("__entries", lambda e: F.struct(squared(mine, [e[c] for c in RGB]).alias("d"), e["box"].alias("box"))))
    return colours.join(few(entries, FEW_BOXES // FEW_ENTRIES), list(key)).withColumn("box", near["box"]).drop("__entries")


def nearest_by_grid(colours: DataFrame, channels: Sequence[str], palette: DataFrame, out: str = "i", key: Sequence[str] = ()) -> DataFrame:
    """colours with the closest entry of a palette of any size, the first of equals.

    palette has key, i and the channels (0 to 255). Entries lie in the cells of a grid. Each
    distinct colour meets those of its cell and the cells around it; if what it finds may be
    farther than something outside of them, it meets those of cells twice as wide, up to one
    cell that has all. Only colours that are far from every entry come to meet many.
    """
    ws = Workspace(colours.sparkSession, "nearest")
    key, names = list(key), [f"__p{k}" for k in range(len(channels))]
    entries = palette.groupBy(*key, *(long(F.col(c)).alias(n) for c, n in zip(channels, names, strict=True))).agg(F.min("i").cast("long").alias("__i"))
    entries = ws.save(entries, "entries")
    mine = [long(F.col(c)) for c in channels]
    left, found = colours.select(*key, *channels).distinct(), None
    for size in CELLS:
        steps = F.array(*(F.array(*map(F.lit, s)) for s in product((-1, 0, 1), repeat=len(channels)))) if size < CELLS[-1] else F.array(F.array(*[F.lit(0)] * len(channels)))
        place = lambda values, size=size: F.array(*(idiv(v, size) for v in values))
        asked = left.withColumn("__cell", F.explode(F.transform(steps, lambda s: F.zip_with(place(mine), s, lambda a, b: a + b))))
        lying = entries.withColumn("__cell", place([F.col(n) for n in names]))
        best = F.min(F.struct(squared(mine, [F.col(n) for n in names]).alias("d"), F.col("__i").alias("i"))).alias("__best")
        near = asked.join(lying, [*key, "__cell"]).groupBy(*key, *channels).agg(best)
        # an entry outside is at least so far away along some channel
        room = F.least(*(F.least(m % size + 1, size - m % size) for m in mine)) + size
        enough = F.lit(True) if size == CELLS[-1] else F.coalesce(F.col("__best.d") < room * room, F.lit(False))
        met = ws.save(left.join(near, [*key, *channels], "left").withColumn("__done", enough), f"cells-{size}")
        done = met.where("__done and __best is not null").select(*key, *channels, F.col("__best.i").alias(out))
        found = done if found is None else found.union(done)
        left = met.where("not __done").select(*key, *channels)
        if not left.limit(1).count():
            break
    return colours.join(found, [*key, *channels])
