"""A store of overlays (sidecars): the latest values for each file, as Parquet snapshots.

Every save writes a new snapshot beside the old ones, so readers never see a half-written one. Of two saves at one time
the second fails, as its snapshot is there already, and can be repeated. The last KEPT snapshots stay, for whoever still
reads them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Snapshots that are kept.
KEPT = 3


def key_of(path):
    """The store's key of a file."""
    return F.xxhash64(path)


class OverlayStore:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        """schema: the overlay's columns; path_key bigint is added before them."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"path_key bigint, {schema}"

    def _numbers(self) -> list[int]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        found = [(m, s.getPath()) for s in fs.listStatus(at) if (m := re.fullmatch(r"v(\d+)", s.getPath().getName()))]
        # Spark marks a finished snapshot.
        done = [int(m[1]) for m, p in found if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(done)

    def load(self) -> DataFrame:
        """The latest snapshot; an empty table if there is none."""
        n = self._numbers()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{n[-1]}") if n else self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame) -> None:
        numbers = self._numbers()
        df.write.parquet(f"{self.path}/v{(numbers or [0])[-1] + 1}")
        jvm = self.spark.sparkContext._jvm
        for n in numbers[: max(len(numbers) + 1 - KEPT, 0)]:
            old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{n}")
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def save(self, overlays: DataFrame) -> None:
        """Overlays by path_key replace those of the same key; of several for one key the largest row by its columns counts."""
        names = self.load().columns
        new = overlays.groupBy("path_key").agg(F.max(F.struct(*[c for c in names if c != "path_key"])).alias("_o")).select("path_key", "_o.*").select(*names)
        self._write(self.load().join(new.select("path_key"), "path_key", "left_anti").unionByName(new))

    def delete(self, keys: DataFrame) -> None:
        """Keys that aren't in the store are no error."""
        self._write(self.load().join(keys.select("path_key"), "path_key", "left_anti"))
