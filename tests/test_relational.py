"""Operators on pixels that spread one image over many tasks, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import palette as palettes
from tessera.operators import colours as C
from tessera.operators import rasters as R
from tessera.plans import queries

rng = np.random.default_rng(8)
PAGES = "path string, page int, width long, height long, samples_per_pixel long, planar int, tile_w long, tile_h long, rows_per_strip long"


def plan(df):
    return df._jdf.queryExecution().toString()


# --- palettes ---------------------------------------------------------------------------------------


def plain_cut(rgb, n, most, refine=2):
    """Boxes as lists of rows; one round cuts all that may be cut."""
    boxes = [list(range(len(rgb)))]
    while True:
        scored = []
        for k, box in enumerate(boxes):
            x, w = rgb[box].astype(object), n[box].astype(object)
            total = int(w.sum())
            errors = [4 * (total * int((x[:, c] * x[:, c] * w).sum()) - int((x[:, c] * w).sum()) ** 2) // total for c in range(3)]
            scored.append((-sum(errors), k, errors.index(max(errors))))
        todo = [s for s in sorted(scored) if s[0] < 0][: most - len(boxes)]
        if not todo:
            break
        for _, k, c in todo:
            box = boxes[k]
            values = sorted({int(v) for v in rgb[box, c]})
            total = int(n[box].sum())
            half = [v for v in values[:-1] if 2 * int(n[box][rgb[box, c] <= v].sum()) >= total]
            at = half[0] if half else values[-2]
            boxes[k] = [i for i in box if rgb[i, c] <= at]
            boxes.append([i for i in box if rgb[i, c] > at])

    def mean(box):
        total = int(n[box].sum())
        return tuple((int((rgb[box, c] * n[box]).sum()) + total // 2) // total for c in range(3))

    entries = [mean(b) for b in boxes]
    for _ in range(refine):
        d = ((rgb[:, None, :] - np.array(entries)[None]) ** 2).sum(-1).argmin(1)
        entries = [mean(np.flatnonzero(d == k)) if (d == k).any() else e for k, e in enumerate(entries)]
    return sorted(set(entries))


@pytest.mark.parametrize("most", [1, 5, 16])
def test_median_cut_against_plain_rounds(spark, most):
    rows = []
    images = {1: rng.integers(0, 256, (300, 3)), 2: rng.integers(100, 104, (40, 3)), 3: np.array([[9, 9, 9]]), 4: np.array([[0, 0, 0], [0, 0, 1], [255, 255, 255]])}
    for image, rgb in images.items():
        images[image] = rgb = np.unique(rgb, axis=0)
        n = rng.integers(1, 1000, len(rgb))
        n[0] = 10**9
        rows += [(image, *map(int, c), int(k)) for c, k in zip(rgb, n, strict=True)]
    df = spark.createDataFrame(rows, "image long, r int, g int, b int, n long")
    got = C.median_cut(df, ["image"], most)
    assert "Arrow" not in plan(got) and "Python" not in plan(got)
    found = {}
    for r in got.orderBy("image", "i").collect():
        assert r.i == len(found.setdefault(r.image, []))
        found[r.image].append((r.r, r.g, r.b))
    for image, rgb in images.items():
        n = np.array([r[4] for r in rows if r[0] == image])
        assert found[image] == plain_cut(rgb, n, most)
    assert C.median_cut(df.where("false"), ["image"], most).count() == 0


def test_palettes_of_very_many_colours_are_good(spark):
    colours = spark.range(200_000).select((F.col("id") * 7919 % 256).alias("r"), (F.col("id") * 104_729 % 251).alias("g"), (F.col("id") % 241).alias("b")).distinct().withColumn("n", F.lit(1).cast("long"))
    got = C.median_cut(colours, [], 64)
    entries = np.array([[r.r, r.g, r.b] for r in got.collect()])
    sample = np.array([[r.r, r.g, r.b] for r in colours.limit(3000).collect()])
    theirs = palettes.build(np.unique(palettes.pack_rgb(sample)), np.ones(len(np.unique(palettes.pack_rgb(sample))), int), 64)
    error = lambda p: ((sample[:, None, :].astype(int) - p[None].astype(int)) ** 2).sum(-1).min(1).mean()
    assert len(entries) <= 64 and error(entries) < 1.25 * error(theirs)


def test_nearest_by_grid_against_all_entries(spark):
    near = rng.integers(0, 256, (5000, 3))
    for entries in (near, np.array([[250, 3, 7]]), np.concatenate([rng.integers(0, 9, (300, 3)), [[255, 255, 255]] * 2])):
        asked = np.concatenate([rng.integers(0, 256, (200, 3)), [[0, 0, 0], [255, 255, 255], [255, 0, 128]]])
        palette = spark.createDataFrame([(k, *map(int, e)) for k, e in enumerate(entries)], "i int, r int, g int, b int")
        got = C.nearest_by_grid(spark.createDataFrame([tuple(map(int, a)) for a in asked], "r int, g int, b int"), C.RGB, palette).collect()
        assert len(got) == len(asked)
        for r in got:
            d = ((entries - np.array([r.r, r.g, r.b])) ** 2).sum(1)
            assert r.i == int(d.argmin())


# --- frames -----------------------------------------------------------------------------------------


def plain_composite(rows, width, height):
    canvas, undo, out = np.zeros((height, width), int), None, {}
    for frame, left, top, w, h, disposal, index in sorted(rows):
        if undo is not None:
            how, ys, xs, saved = undo
            if how == 2:
                canvas[ys, xs] = 0
            elif how == 3:
                canvas[ys, xs] = saved
        ys, xs = slice(max(top, 0), max(0, min(top + h, height))), slice(max(left, 0), max(0, min(left + w, width)))
        undo = (disposal, ys, xs, canvas[ys, xs].copy())
        patch = np.frombuffer(index, np.uint8).reshape(h, w)
        for y in range(h):
            for x in range(w):
                if patch[y, x] and 0 <= top + y < height and 0 <= left + x < width:
                    canvas[top + y, left + x] = patch[y, x]
        out[frame] = canvas.copy()
    return out


def test_compositing_against_a_canvas(spark):
    width, height, rows, want = 9, 7, [], {}
    for animation in range(6):
        own = []
        for frame in range(0, 36, 3):
            w, h = int(rng.integers(0 if frame else 1, 8)), int(rng.integers(1, 6))
            index = (rng.integers(0, 5, w * h) * rng.integers(0, 2, w * h)).astype(np.uint8).tobytes()
            own.append((frame, int(rng.integers(0, 10)), int(rng.integers(0, 8)), w, h, int(rng.integers(0, 4)), index))
        want[animation] = plain_composite(own, width, height)
        rows += [(animation, *r) for r in own]
    df = spark.createDataFrame(rows, "animation long, frame int, left int, top int, w int, h int, disposal int, index binary")
    got = R.composite(df, "animation", width, height)
    assert "InArrow" not in plan(got) and "Pandas" not in plan(got)
    found = {(r.animation, r.frame, r.y, r.x): r.value for r in got.collect()}
    assert found == {(a, f, y, x): int(v) for a, frames in want.items() for f, canvas in frames.items() for (y, x), v in np.ndenumerate(canvas) if v}


# --- pages ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("planar", [1, 2])
@pytest.mark.parametrize("tile", [None, 16])
def test_retiled_pages(spark, planar, tile):
    image = rng.integers(-(2**40), 2**40, (45, 53, 3))
    h, w, channels = image.shape
    pages = spark.createDataFrame([("p", 0, w, h, channels, planar, tile, tile, 7)], "path string, page int, width long, height long, samples_per_pixel long, planar int, tile_w long, tile_h long, rows_per_strip long")
    chunks = []
    for r in R.enumerate_chunks(pages).collect():
        at = slice(r.plane, r.plane + 1) if planar == 2 else slice(None)
        data = np.zeros((r.chunk_rows, r.chunk_width, 1 if planar == 2 else channels), "<i8")
        part = image[r.y0 : r.y0 + r.chunk_rows, r.x0 : r.x0 + r.chunk_width, at]
        data[: part.shape[0], : part.shape[1]] = part
        chunks.append((*r, bytearray(data.tobytes())))
    schema = R.enumerate_chunks(pages).schema.add("data", "binary")
    df = spark.createDataFrame(chunks, schema)
    got = R.retile(df, 20, 12)
    assert "collect_list" not in plan(got)
    back = np.zeros_like(image)
    for r in got.collect():
        assert (r.x0, r.y0) == (r.bx * 20, r.by * 12)
        back[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.frombuffer(r.samples, "<i8").reshape(r.h, r.w, r.channels)
    assert (back == image).all()
    some = R.retile(df.where("idx > 0"), 20, 12).where("bx = 0 and by = 0").first()
    assert np.frombuffer(some.samples, "<i8").reshape(some.h, some.w, -1)[0, 0, 0] == 0


def test_retiled_pages_are_dealt_to_all_cores_and_made_once(spark, sf):
    got = plan(queries.retiled(spark, sf)).split("== Physical Plan ==")[1]
    scan, cut = got.index("parquet"), got.rindex("MapInArrow")
    assert "RoundRobinPartitioning(4)" in got[cut:scan]
    df = R.enumerate_chunks(spark.createDataFrame([("p", 0, 5, 5, 1, 1, None, None, 7)], PAGES)).withColumn("data", F.unhex(F.repeat(F.substring("path", 2, 0), F.col("idx").cast("int"))))
    assert plan(R.retile(df, 3, 3, sample_bytes=1)).split("== Physical Plan ==")[1].count("unhex") == 1


def test_a_block_of_a_task_travels_as_one_row(spark):
    pages = spark.range(50).select("id", F.lit(0).alias("page"), *(F.lit(v).cast("long").alias(c) for c, v in (("width", 40), ("height", 24), ("samples_per_pixel", 3))), F.lit(2).alias("planar"),
        *(F.lit(None).cast("long").alias(c) for c in ("tile_w", "tile_h")), F.lit(1).cast("long").alias("rows_per_strip"))
    df = R.enumerate_chunks(pages.coalesce(1)).withColumn("data", F.unhex(F.repeat(F.lit("07"), 40)))
    got = R.retile(df, 20, 12, ["id", "page"], 1)
    assert {bytes(r.samples) for r in got.collect()} == {b"\7" * 720}
    nodes, shuffled = [got._jdf.queryExecution().executedPlan().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("ShuffleQueryStage"):
            shuffled.append(node.plan().metrics().apply("shuffleRecordsWritten").value())
        elif node.nodeName().startswith("ResultQueryStage"):
            nodes.append(node.plan())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert shuffled == [200]  # of 7,200 pieces


def test_retiled_pages_of_all_kinds_in_small_batches(spark):
    pages, chunks, want = [], [], {}
    for n, (w, h, channels, planar, tile) in enumerate([(31, 17, 3, 2, None), (47, 29, 2, 1, 16), (1, 1, 1, 1, None), (20, 12, 3, 2, 16), (41, 25, 1, 2, None)]):
        pages.append((None if n == 1 else f"p{n}", n % 2, w, h, channels, planar, tile, tile, 4))
        want[pages[-1][:2]] = rng.integers(0, 256, (h, w, channels, 3)).astype(np.uint8)
    found = R.enumerate_chunks(spark.createDataFrame(pages, PAGES))
    for r in found.collect():
        image = want[r.path, r.page]
        part = image[r.y0 : r.y0 + r.chunk_rows, r.x0 : r.x0 + r.chunk_width, slice(r.plane, r.plane + 1) if r.planar == 2 else slice(None)]
        data = np.zeros((r.chunk_rows, r.chunk_width, *part.shape[2:]), np.uint8)
        data[: part.shape[0], : part.shape[1]] = part
        lost = r.path == "p0" and r.idx == 2
        if lost:
            part[:] = 0
        chunks.append((*r, None if lost else bytearray(data.tobytes())))
    df = spark.createDataFrame(chunks, found.schema.add("data", "binary"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rows = R.retile(df.repartition(3, "idx"), 20, 12, sample_bytes=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == sum(-(-p[2] // 20) * -(-p[3] // 12) for p in pages)
    for r in rows:
        image = want[r.path, r.page][r.y0 : r.y0 + 12, r.x0 : r.x0 + 20]
        assert (r.x0, r.y0, r.h, r.w, r.channels) == (r.bx * 20, r.by * 12, *image.shape[:3]) and bytes(r.samples) == image.tobytes()


def test_blocks_and_strips_larger_than_a_batch(spark):
    w, h = 1300, 1000
    image = rng.integers(0, 256, (h, w)).astype(np.uint8)
    assert image.size > R.BATCH_SAMPLES
    for rows, block in ((h, (w, h)), (h, (7, 400)), (3, (1200, 1100))):
        found = R.enumerate_chunks(spark.createDataFrame([("p", 0, w, h, 1, 1, None, None, rows)], PAGES))
        df = spark.createDataFrame([(*r, bytearray(image[r.y0 : r.y0 + r.chunk_rows].tobytes())) for r in found.collect()], found.schema.add("data", "binary"))
        back = np.zeros_like(image)
        for r in R.retile(df, *block, sample_bytes=1).collect():
            back[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.frombuffer(r.samples, np.uint8).reshape(r.h, r.w)
        assert (back == image).all()


def test_strips_of_another_length_are_an_error(spark):
    df = R.enumerate_chunks(spark.createDataFrame([("p", 0, 5, 5, 3, 1, None, None, 5)], PAGES))
    for n in (74, 50):
        with pytest.raises(Exception, match="samples of a strip or tile"):
            R.retile(df.withColumn("data", F.unhex(F.repeat(F.lit("00"), n))), 3, 3, sample_bytes=1).collect()


def test_running_sums_of_long_rows(spark):
    px = spark.range(3000).select((F.col("id") % 2).alias("row"), (F.col("id") / 2).cast("long").alias("x"), (F.col("id") * 37 % 256).alias("d"))
    px = px.union(spark.createDataFrame([(None, 0, 250), (None, 1, 10)], "row long, x long, d long"))
    got = R.undo_predictor(px, ["row"], "x", "d", 8, "v", block=100)
    want = {}
    for r in sorted(px.collect(), key=lambda r: (r.row is None, r.row or 0, r.x)):
        want[r.row, r.x] = (want.get((r.row, r.x - 1), 0) + r.d) % 256
    assert got.columns == ["row", "x", "d", "v"] and {(r.row, r.x): r.v for r in got.collect()} == want
