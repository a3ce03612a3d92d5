"""Results kept per experiment as Parquet, so that finished ones are reused."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

PARTITIONS = ("dataset", "model", "forecast_method")


class ArtifactStore:
    """A folder of Parquet tables. Writing an experiment replaces its partitions and no others."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def of(self, *settings: object) -> ArtifactStore:
        """The part of the store that belongs to these settings: results of other settings are elsewhere, so neither
        is taken for the other. Settings are told apart by how they print."""
        digest = hashlib.sha256("\n".join(map(repr, settings)).encode()).hexdigest()[:16]
        return ArtifactStore(self.spark, f"{self.root}/{digest}")

    def write(self, name: str, df: DataFrame, drop: Sequence[str] = (), replace: bool = False) -> None:
        """Partitioned by those experiment columns the table has; `drop` leaves out bulky inputs. `replace` removes
        the partitions of other experiments too."""
        df = df.drop(*drop)
        parts = [c for c in PARTITIONS if c in df.columns]
        w = df.write.mode("overwrite")
        if parts:
            w = w.partitionBy(*parts).option("partitionOverwriteMode", "static" if replace else "dynamic")
        w.parquet(self.path(name))
        files, mark = self._mark(name)
        files.create(mark, True).close()

    def exists(self, name: str) -> bool:
        """Whether a write has been finished: its commit marker is there."""
        files, mark = self._mark(name)
        return bool(files.exists(mark))

    def _mark(self, name: str):
        """The file system and path of a table's commit marker, an empty file that table readers skip. Spark's own
        marker is missing where only some partitions are overwritten."""
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_STORED")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()), mark

    def read(self, name: str, **only) -> DataFrame:
        """`only` filters on experiment columns: partitions that do not match are not listed or read."""
        df = self.spark.read.parquet(self.path(name))
        for c, v in only.items():
            df = df.filter(df[c] == v)
        return df

    def reuse(self, name: str, make: Callable[[], DataFrame], rerun: bool = False) -> DataFrame:
        """The stored table, made first where it is missing. Reading it back cuts the plan at a table that
        outlives lost executors. A rerun leaves nothing of what was there before."""
        if rerun or not self.exists(name):
            self.write(name, make(), replace=rerun)
        return self.read(name)

    def unfinished(self, name: str, grid: DataFrame, on: Sequence[str]) -> DataFrame:
        """Experiments of the grid without stored rows."""
        if not self.exists(name):
            return grid
        return grid.join(self.read(name).select(*on).distinct(), list(on), "left_anti")
