"""Every query of the catalogue against its SQL, and rasters through files and SQL functions."""

import numpy as np
import pytest
from conftest import comparable
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.errors import Limits
from tessera.functions import udfs
from tessera.operators import rasters as R
from tessera.plans import queries as plans
from tessera.sources import bmp, datasource, gif, readers, tiff
from tessera.streaming.files import arriving_frames


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf).toPandas()
    assert comparable(got) == comparable(duck.execute(plans.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())



@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(4)
    image = (rng.integers(0, 4, (6, 5, 4)) * 60).astype(np.uint8) | np.array([0, 0, 0, 255], np.uint8)
    (tmp_path / "a.bmp").write_bytes(bmp.encode(image))
    (tmp_path / "b.gif").write_bytes(gif.encode_frames([(image, 3), (image[::-1].copy(), 4)], gif.EncodeOptions(loop_count=2)))
    e = tiff.Encoder(tiff.EncodeOptions("Deflate", True, strip_bytes=20))
    e.add_page(image[..., :3].copy(), "Rgb8")
    e.add_page(image[..., :1].copy(), "Gray8")
    (tmp_path / "c.tif").write_bytes(e.finish())
    (tmp_path / "d.gif").write_bytes(b"GIF89a")
    (tmp_path / "e.bin").write_bytes(b"x")
    return tmp_path, image


def test_readers_over_files(spark, folder):
    path, image = folder
    files = readers.files(spark, str(path))
    assert {r["format"]: r["count"] for r in files.groupBy("format").count().collect()} == {"bmp": 1, "gif": 2, "tiff": 1, None: 1}
    frames = readers.frames(files.where("format = 'gif'")).orderBy("path", "frame").collect()
    assert [f["frame"] for f in frames] == [0, 1, None] and frames[0]["rgba"] == image.tobytes() and frames[2]["error"]["kind"] == "Truncated"
    assert readers.gif(files.where("format = 'gif'")).where("error is null").first()["loop_count"] == 2
    assert readers.gif_info(files.where("format = 'gif'")).where("width = 5 and height = 6").count() == 1
    assert readers.bmp(files.where("format = 'bmp'")).first()["rgba"] == image.tobytes()
    assert readers.bmp_info(files.where("format = 'bmp'")).first()["bits_per_pixel"] == 24
    tif = files.where("format = 'tiff'")
    assert readers.page_info(tif).count() == 2
    page = readers.pages(tif, page=1).collect()
    assert len(page) == 1 and page[0]["samples"] == image[..., :1].tobytes()
    assert readers.chunks(tif).where("page = 0").count() == 6
    assert readers.tags(tif).where("tag = 256").count() == 2
    assert readers.bmp(files.where("format = 'bmp'"), Limits(max_pixels=3)).first()["error"]["kind"] == "LimitExceeded"
    with pytest.raises(Exception, match="Truncated"):
        readers.frames(files.where("format = 'gif'"), mode="failfast").collect()


def test_scan_of_headers_has_no_pixels_in_its_plan(spark, folder):
    files = readers.files(spark, str(folder[0]))
    plan = files.where("length < 10").select("path")._jdf.queryExecution().toString()
    assert "content" not in plan.split("Physical Plan")[1] and "LessThan(length,10)" in plan


def test_bitmaps_equal_those_of_the_image_source(spark, folder):
    path, image = folder
    row = spark.read.format("image").load(f"{path}/a.bmp").select("image.*").first()
    theirs = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)[..., 2::-1]
    assert (theirs == image[..., :3]).all()


def test_data_sources(spark, folder):
    path, image = folder
    datasource.register(spark)
    assert spark.read.format("gif").load(f"{path}/*.gif").where("error is null").count() == 2
    assert spark.read.format("bmp").load(f"{path}/*.bmp").first()["rgba"] == image.tobytes()
    assert spark.read.format("tiff").option("page", "0").load(f"{path}/*.tif").count() == 1
    assert spark.read.format("tiff").load(f"{path}/*.tif").where("page = 1").select("height").collect()[0][0] == 6
    out = path / "out"
    rows = spark.createDataFrame([("x.bmp", bytearray(bmp.encode(image))), ("y.bmp", bytearray(b"BM"))], "name string, content binary")
    rows.write.format("rasterfile").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == ["_manifest.json", "x.bmp", "y.bmp"] and bmp.decode((out / "x.bmp").read_bytes()).rgba.tobytes() == image.tobytes()


def test_sql_functions(spark, folder):
    path, image = folder
    udfs.register(spark)
    readers.files(spark, str(path)).createOrReplaceTempView("files")
    rows = spark.sql("select f.frame, f.delay_cs from files, lateral gif_frames(content) f where format = 'gif' and f.error is null order by frame").collect()
    assert [(r.frame, r.delay_cs) for r in rows] == [(0, 3), (1, 4)]
    assert spark.sql("select t.* from files, lateral tiff_tags(content) t where format = 'tiff' and t.tag = 257").count() == 2
    assert spark.sql("select p.width from files, lateral tiff_pages(content) p where format = 'tiff'").count() == 2
    assert spark.sql("select md5(packbits_decode(packbits_encode(content), cast(length as int))) = md5(content) as same from files where format = 'tiff'").first().same
    assert bytes(spark.sql("select bmp_decode(content) as p from files where format = 'bmp'").first().p) == image.tobytes()


def test_animations_and_pages_are_written_in_order(spark):
    rng = np.random.default_rng(9)
    images = [(rng.integers(0, 3, (4, 4, 4)) * 80).astype(np.uint8) | np.array([0, 0, 0, 255], np.uint8) for _ in range(3)]
    rows = [(7, k, 4, 4, k + 1, bytearray(im.tobytes())) for k, im in enumerate(images)][::-1]
    frames = spark.createDataFrame(rows, "movie long, frame int, width int, height int, delay_cs int, rgba binary")
    got, _ = gif.decode(bytes(udfs.encode_animations(frames, "movie").first()["content"]))
    assert [f.delay_cs for f in got.frames] == [1, 2, 3] and all((a.rgba == b).all() for a, b in zip(got.frames, images))
    pages = frames.select("movie", F.col("frame").alias("page"), "width", "height", F.col("rgba").alias("samples"))
    back = tiff.decode_pages(bytes(udfs.encode_pages(pages, "movie", "Rgba8").first()["content"]))
    assert all((a.samples == b).all() for a, b in zip(back, images))


def test_stream_of_files(spark, folder):
    path, _ = folder
    q = arriving_frames(spark, str(path)).select("frame", "delay_cs", "error").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("arrived").where("error is null").count() == 2 and spark.table("arrived").where("error is not null").count() == 1


def test_pages_of_very_many_tiles(spark):
    pages = spark.createDataFrame([("p", 0, 1500, 1000, 1, 1, 1, 1, 1000, [8], 1)], "path string, page int, width long, height long, samples_per_pixel long, planar long, tile_w long, tile_h long, rows_per_strip long, bits_per_sample array<long>, compression long")
    found = R.enumerate_chunks(pages)
    got = found.agg(F.count("*"), F.countDistinct("idx"), F.max("idx"), F.max("x0"), F.max("y0")).first()
    assert tuple(got) == (1_500_000, 1_500_000, 1_499_999, 1499, 999)
    strips = pages.withColumn("tile_w", F.lit(None).cast("long")).withColumn("rows_per_strip", F.lit(400).cast("long"))
    tags = spark.createDataFrame([("p", 0, 273, [10, 20, 30])], "path string, page int, tag int, ints array<long>")
    rows = R.locate_chunks(R.enumerate_chunks(strips), tags).orderBy("idx").collect()
    assert [(r.offset, r.byte_count) for r in rows] == [(10, 600_000), (20, 600_000), (30, 300_000)]
    packed = R.locate_chunks(R.enumerate_chunks(strips.withColumn("compression", F.lit(5).cast("long"))), tags)
    assert packed.where("offset is not null and byte_count is null").count() == 3


def test_palettes_of_many_colours(spark):
    counts = spark.range(1000).select((F.col("id") % 2).alias("image"), (F.col("id") * 7919).alias("colour"), F.lit(1).cast("long").alias("n"))
    exact = R.exact_palette(counts.where("image = 0 and colour < 7919 * 100"), "colour", ["image"])
    assert exact.count() == 50
    cut = R.exact_palette(counts, "colour", ["image"])
    assert {r["image"]: r["count"] for r in cut.groupBy("image").count().collect()} == {0: 256, 1: 256}
    assert R.exact_palette(counts.drop("image"), "colour", [], most=2000).count() == 1000
    px = spark.range(5000).select(F.lit(0).alias("image"), F.col("id").alias("index"))
    common = spark.range(5000).select(F.col("id").alias("i"), (F.col("id") * 3).alias("grey"))
    local = spark.createDataFrame([], "image int, i long, grey long")
    assert R.palette_lookup(px, "index", local, common, ["image"], ["grey"]).where("grey = 3 * index").count() == 5000


def test_first_error_wins(spark):
    rows = spark.createDataFrame([(1, 3, "late"), (1, 1, "early"), (1, 0, None), (2, 0, None)], "page int, idx int, error string")
    assert [tuple(r) for r in R.first_error(rows, ["page"]).collect()] == [(1, "early")]
