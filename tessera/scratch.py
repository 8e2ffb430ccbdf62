"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """Tables written to the folder that driver and executors share (``spark.checkpoint.dir``).

    A written table cuts lineage and survives lost executors. Where the setting
    is unset (tests on one machine) a temporary folder of this process is used.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="tessera-")
        self.path = f"{base}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.path)

    def _remove(self, path: str) -> None:
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone when the interpreter ends
            return

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._remove(f"{self.path}/{name}")
