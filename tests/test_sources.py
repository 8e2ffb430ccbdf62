"""Data sources: planning, streams across restarts, commits; compositing of arriving patches."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_relational import plain_composite

from tessera.sources import bmp, datasource, gif, tiff
from tessera.sources.datasource import FileWriter, RasterReader, TiffReader, recover
from tessera.streaming.frames import composite_arriving

rng = np.random.default_rng(12)


def image(h=6, w=5):
    return (rng.integers(0, 4, (h, w, 4)) * 60).astype(np.uint8) | np.array([0, 0, 0, 255], np.uint8)


def test_small_files_go_many_to_a_partition(spark, tmp_path):
    for k in range(3000):
        (tmp_path / f"{k:05d}.gif").write_bytes(b"x" * 100)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "a.gif").write_bytes(b"x")
    found = RasterReader({"path": str(tmp_path)}).partitions()
    paths = [p for part in found for p, _, _ in part.value]
    assert len(found) == -(-3000 // 31) and len(set(paths)) == len(paths) == 3000
    assert [p.value for p in RasterReader({"path": str(tmp_path / "none*")}).partitions()] == [[]]


def test_pages_of_a_large_file_are_dealt(spark, tmp_path):
    datasource.register(spark)
    e = tiff.Encoder(tiff.EncodeOptions("None"))
    pages = [rng.integers(0, 256, (40, 50, 1)).astype(np.uint8) for _ in range(23)]
    for p in pages:
        e.add_page(p, "Gray8")
    (tmp_path / "a.tif").write_bytes(e.finish())
    (tmp_path / "empty.tif").write_bytes(b"")
    (tmp_path / "bad.tif").write_bytes(b"II*\\0" + bytes(3))
    reader = TiffReader({"path": str(tmp_path / "a.tif"), "maxPartitionBytes": "10000"})
    ranges = [r for p in reader.partitions() for r in p.value]
    assert len(ranges) > 4 and [k for _, a, b in ranges for k in range(a, b + 1)] == list(range(23))
    df = spark.read.format("tiff").option("maxPartitionBytes", "10000").load(str(tmp_path))
    got = df.where("error is null").select("page", "samples").collect()
    assert len(got) == 23 and all(r.samples == pages[r.page].tobytes() for r in got)
    assert {r.path.rsplit("/", 1)[1]: r.error.kind for r in df.where("error is not null").collect()}.keys() == {"empty.tif", "bad.tif"}
    assert sorted(r.page for r in df.where("page >= 7 and page < 11 and error is null").select("page").collect()) == [7, 8, 9, 10]
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    for filters, want in (([GreaterThan(("page",), 3), LessThan(("page",), 6)], [4, 5]), ([EqualTo(("page",), 22)], [22]), ([EqualTo(("page",), 50)], [])):
        r = TiffReader({"path": str(tmp_path / "a.tif"), "maxPartitionBytes": "10000"})
        assert list(r.pushFilters(filters)) == filters
        assert [row["page"] for p in r.partitions() for b in r.read(p) for row in b.to_pylist()] == want


def test_streams_read_each_file_once_across_restarts(spark, tmp_path):
    datasource.register(spark)
    path = tmp_path / "in"
    path.mkdir()

    def add(k):
        (path / f"{k}.gif").write_bytes(gif.encode_frames([(image(), 1)], gif.EncodeOptions()))

    def run():
        stream = spark.readStream.format("gif").option("log", str(tmp_path / "log")).option("maxFilesPerTrigger", 2).load(str(path))
        q = stream.select("path", "frame").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    for k in range(6):  # each run goes on where the one before has ended
        add(k)
        if k % 2:
            run()
    rows = [r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(rows) == [f"{k}.gif" for k in range(6)]
    admitted = [json.loads(p.read_text()) for p in sorted((tmp_path / "log").glob("*.json"))]
    assert max(map(len, admitted)) == 2 and sum(map(len, admitted)) == 6


def visible(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith((".", "_")))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    datasource.register(spark)
    out = tmp_path / "out"
    rows = spark.createDataFrame([(f"{k}.bmp", bytearray(bmp.encode(image()))) for k in range(8)], "name string, content binary").repartition(4)
    rows.where("name < '4'").write.format("rasterfile").mode("append").save(str(out))
    assert visible(out) == ["0.bmp", "1.bmp", "2.bmp", "3.bmp"] and json.loads((out / "_manifest.json").read_text()) == visible(out)
    for broken in (rows.withColumn("name", F.when(F.col("name") == "7.bmp", F.lit("../7.bmp")).otherwise(F.col("name"))), rows.withColumn("name", F.lit("same.bmp"))):
        with pytest.raises(Exception, match="file name"):
            broken.write.format("rasterfile").mode("append").save(str(out))
        assert sorted(p.name for p in out.iterdir()) == ["0.bmp", "1.bmp", "2.bmp", "3.bmp", "_manifest.json"]
    rows.where("name >= '6'").write.format("rasterfile").mode("overwrite").save(str(out))
    assert visible(out) == ["6.bmp", "7.bmp"] and json.loads((out / "_manifest.json").read_text()) == visible(out)


def test_attempts_that_spark_does_not_count_are_forgotten(tmp_path):
    w = FileWriter({"path": str(tmp_path)}, False)
    first, second = w.write(iter([{"name": "a.bmp", "content": b"1"}])), w.write(iter([{"name": "a.bmp", "content": b"2"}]))
    with pytest.raises(ZeroDivisionError):
        w.write({"name": "b.bmp", "content": b"3" * (1 // k)} for k in (1, 0))
    w.commit([second, None])
    assert first != second and sorted(p.name for p in tmp_path.iterdir()) == ["_manifest.json", "a.bmp"] and (tmp_path / "a.bmp").read_bytes() == b"2"


def test_a_commit_that_was_broken_off_is_ended(tmp_path, monkeypatch):
    w = FileWriter({"path": str(tmp_path)}, False)
    done = w.write({"name": f"{k}.bmp", "content": b"x"} for k in range(5))
    moved, move = [], datasource.os.replace

    def breaks(a, b):
        if "_staging" in a:
            if len(moved) == 2:
                raise OSError("gone")
            moved.append(b)
        move(a, b)

    monkeypatch.setattr(datasource.os, "replace", breaks)
    with pytest.raises(OSError, match="gone"):
        w.commit([done])
    monkeypatch.undo()
    assert len(visible(tmp_path)) == 2 and not (tmp_path / "_manifest.json").exists()
    recover(str(tmp_path))
    assert visible(tmp_path) == [f"{k}.bmp" for k in range(5)] == json.loads((tmp_path / "_manifest.json").read_text())
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("_")) == ["_manifest.json"]


def test_arriving_patches_across_a_restart(spark, tmp_path, band=4):
    width, height, want, batches = 9, 7, {}, [[], []]
    for animation in range(3):
        own = []
        for frame in range(9):
            w, h = int(rng.integers(1, 8)), int(rng.integers(1, 6))
            own.append((frame, int(rng.integers(-2, 10)), int(rng.integers(-2, 8)), w, h, int(rng.integers(0, 4)), (rng.integers(0, 5, w * h) * rng.integers(0, 2, w * h)).astype(np.uint8).tobytes()))
        want[animation] = plain_composite(own, width, height)
        for r in own:
            batches[int(rng.integers(0, 2))].append((animation, *r))
    batches[1].append(batches[0][0])  # a frame given twice
    schema = "animation long, frame int, left int, top int, w int, h int, disposal int, index binary"

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = composite_arriving(stream, "animation", width, height, band, patience_ms=10**8)
        q = got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(once=True).start()
        q.awaitTermination(120)

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()  # each goes on where the one before has ended
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("band").collect():
        got[r.animation, r.frame] = got.get((r.animation, r.frame), b"") + bytes(r.pixels)
    assert got == {(a, f): canvas.astype(np.uint8).tobytes() for a, frames in want.items() for f, canvas in frames.items()}
