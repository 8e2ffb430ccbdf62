"""Data sources ``gif``, ``bmp``, ``tiff`` (reading, also as streams) and ``rasterfile`` (writing).

They open files on a file system that every executor mounts; for stores that only
Spark reads, use sources.readers over binaryFile, which gives the same tables.

Reading plans by bytes: small files go many to a partition, and the pages of a
``tiff`` file larger than a partition are dealt in ranges, of which a task maps only
what it decodes. Options: path, mode (permissive or failfast), maxPixels,
maxPartitionBytes, and for tiff page. Bounds on page in a query reach the plan.

A stream admits files in order of time and name, ``maxFilesPerTrigger`` at a time,
and writes what it admits to the folder ``log`` before Spark hears of it, so that a
batch that is run again after a failure has the same files.

Writing stages files apart, task by task. Committing lists the files of the tasks
that Spark counts, then moves them, then gives the list its final name; what other
attempts have left goes with the staging folder. ``recover`` ends a commit that was
broken off.
"""

from __future__ import annotations

import glob
import json
import mmap
import os
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.errors import Limits, RasterError, guarded
from tessera.sources import bmp as bmp_
from tessera.sources import readers, schemas
from tessera.sources import tiff as tiff_

#: Bytes of files in a partition, and what opening a file counts for.
PARTITION_BYTES, OPEN_BYTES = 128 << 20, 4 << 20
#: Filters that bound the pages.
BOUNDS = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
#: A file and the pages of it that a partition reads (all if last is None).
Part = tuple[str, int, int | None]


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def listed(path: str) -> Iterator[os.DirEntry]:
    """Visible files below a folder."""
    with os.scandir(path) as entries:
        for e in sorted(entries, key=lambda e: e.name):
            if not hidden(e.name):
                if e.is_dir():
                    yield from listed(e.path)
                else:
                    yield e


def sizes(path: str) -> list[tuple[str, int]]:
    if os.path.isdir(path):
        return [(e.path, e.stat().st_size) for e in listed(path)]
    return [(p, os.path.getsize(p)) for p in sorted(glob.glob(path)) if os.path.isfile(p) and not hidden(os.path.basename(p))]


def packed(parts: Sequence[tuple[Part, int]], most: int) -> list[InputPartition]:
    """Parts in partitions of about so many bytes, in order."""
    out: list[list[Part]] = [[]]
    held = 0
    for part, size in parts:
        if out[-1] and held + size + OPEN_BYTES > most:
            out.append([])
            held = 0
        out[-1].append(part)
        held += size + OPEN_BYTES
    return [InputPartition(p) for p in out]


class RasterReader(DataSourceReader):
    schema = schemas.FRAMES

    def __init__(self, options: dict, schema: StructType | None = None):
        self.options = options
        self.arrow = to_arrow_schema(schema or StructType.fromDDL(self.schema))
        self.first, self.last = (int(options["page"]), int(options["page"])) if "page" in options else (0, None)

    def option(self, name: str, default):
        found = self.options.get(name, self.options.get(name.lower()))
        return default if found is None else type(default)(found)

    @property
    def limits(self) -> Limits:
        return Limits(max_pixels=self.option("maxPixels", Limits().max_pixels))

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  name given by the interface
        for f in filters:
            if isinstance(f, BOUNDS) and f.attribute == ("page",) and isinstance(f.value, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    last = f.value - isinstance(f, LessThan)
                    self.last = last if self.last is None else min(self.last, last)
            yield f  # Spark checks it again

    def parts(self, path: str, size: int, most: int) -> Iterator[tuple[Part, int]]:
        yield (path, self.first, self.last), size

    def planned(self, files: Sequence[tuple[str, int]]) -> list[InputPartition]:
        most = self.option("maxPartitionBytes", PARTITION_BYTES)
        return packed([p for path, size in files for p in self.parts(path, size, most)], most)

    def partitions(self):
        return self.planned(sizes(local(self.options["path"])))

    def rows(self, part: Part, limits: Limits, mode: str) -> Iterator[dict]:
        with open(part[0], "rb") as f:
            yield from readers.frame_rows(part[0], f.read(), limits, mode)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        mode = self.option("mode", "permissive")
        yield from readers.batches((row for part in partition.value for row in self.rows(part, self.limits, mode)), self.arrow)


class TiffReader(RasterReader):
    schema = schemas.PAGES

    def parts(self, path: str, size: int, most: int) -> Iterator[tuple[Part, int]]:
        if size <= most:
            yield (path, self.first, self.last), size
            return
        with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            t, e = guarded(tiff_.Tiff, data, self.limits)
            pages = 1 if e else len(t.directories)
        each = max(1, pages * most // size)
        last = pages - 1 if self.last is None else min(self.last, pages - 1)
        for k in range(self.first, last + 1, each):
            yield (path, k, min(k + each - 1, last)), size * min(each, last - k + 1) // pages

    def rows(self, part: Part, limits: Limits, mode: str) -> Iterator[dict]:
        path, first, last = part
        with open(path, "rb") as f:
            if os.fstat(f.fileno()).st_size == 0:
                yield from readers.page_rows(path, b"", limits, mode, True, None)
                return
            with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                yield from readers.page_rows(path, data, limits, mode, True, None if last is None and first == 0 else range(first, 1 << 62 if last is None else last + 1))


class BmpReader(RasterReader):
    schema = schemas.BMP

    def rows(self, part: Part, limits: Limits, mode: str) -> Iterator[dict]:
        with open(part[0], "rb") as f:
            i, e = guarded(bmp_.decode, f.read(), limits)
        yield readers.error_row(part[0], e, mode) if e else {"path": part[0], **readers.bmp_fields(i.info), "has_alpha": i.has_alpha, "icc_profile": i.icc_profile, "rgba": i.rgba.tobytes()}


def replaced(path: str, text: str) -> None:
    """Writes a file as a whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


class RasterStream(DataSourceStreamReader):
    """Offsets count batches of admitted files, each of which is a file of names in the log."""

    def __init__(self, reader: RasterReader):
        self.reader, self.path = reader, local(reader.options["path"])
        if "log" not in reader.options:
            raise ValueError("option log: a folder for the lists of admitted files, kept with the stream's checkpoint")
        self.log = local(reader.options["log"])
        self.most = reader.option("maxFilesPerTrigger", 1000)

    def entry(self, k: int) -> str:
        return os.path.join(self.log, f"{k:09d}.json")

    def batch(self, k: int) -> list[str]:
        with open(self.entry(k)) as f:
            return json.load(f)

    def batches(self) -> int:
        os.makedirs(self.log, exist_ok=True)
        return len([n for n in os.listdir(self.log) if n.endswith(".json")])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        n = self.batches()
        if not hasattr(self, "known"):
            self.known = {p for k in range(n) for p in self.batch(k)}
        found = sorted((e.stat().st_mtime_ns, e.path) for e in listed(self.path) if e.path not in self.known)[: self.most]
        if found:
            replaced(self.entry(n), json.dumps([p for _, p in found]))
            self.known |= {p for _, p in found}
            n += 1
        return {"batch": n}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        paths = [p for k in range(start["batch"], end["batch"]) for p in self.batch(k)]
        return self.reader.planned([(p, os.path.getsize(p)) for p in paths])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


def source(kind: str, reader: type[RasterReader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return reader.schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return reader(dict(self.options), schema)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
            return RasterStream(reader(dict(self.options), schema))

    return Source


@dataclass
class Written(WriterCommitMessage):
    #: (staged file, name) of a task's rows.
    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """One file a row, from columns name and content."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = local(options["path"]), overwrite, uuid.uuid4().hex
        self.staging = os.path.join(self.path, f"_staging-{self.job}")

    def write(self, iterator: Iterator) -> Written:
        attempt = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(attempt)
        out = []
        for row in iterator:
            name = row["name"]
            if not name or os.path.basename(name) != name or hidden(name):
                raise RasterError("Invalid", f"file name {name!r}")
            staged = os.path.join(attempt, str(len(out)))
            with open(staged, "wb") as f:
                f.write(row["content"])
            out.append((staged, name))
        return Written(out)

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise RasterError("Invalid", f"file name {max(names, key=names.count)!r} given twice")
        os.makedirs(self.path, exist_ok=True)
        replaced(os.path.join(self.path, f"_commit-{self.job}.json"), json.dumps({"files": files, "overwrite": self.overwrite, "staging": self.staging}))
        recover(self.path)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def recover(path: str) -> None:
    """Ends commits whose list is written: moves what is still staged, and names the list of all files ``_manifest.json``."""
    for journal in sorted(glob.glob(os.path.join(glob.escape(path), "_commit-*.json"))):
        with open(journal) as f:
            todo = json.load(f)
        for staged, name in todo["files"]:
            if os.path.exists(staged):
                os.replace(staged, os.path.join(path, name))
        names = {name for _, name in todo["files"]}
        manifest = os.path.join(path, "_manifest.json")
        if todo["overwrite"]:
            for e in list(os.scandir(path)):
                if e.is_file() and not hidden(e.name) and e.name not in names:
                    os.remove(e.path)
        elif os.path.exists(manifest):
            with open(manifest) as f:
                names |= set(json.load(f))
        replaced(manifest, json.dumps(sorted(names)))
        shutil.rmtree(todo["staging"], ignore_errors=True)
        os.remove(journal)


class RasterFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasterfile"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # for bounds on page
    for s in (source("gif", RasterReader), source("tiff", TiffReader), source("bmp", BmpReader), RasterFile):
        spark.dataSource.register(s)
