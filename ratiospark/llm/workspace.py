"""Tables written between the steps of a long job, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Workspace:
    """``save`` writes a table under ``spark.checkpoint.dir`` and reads it back.

    That cuts lineage, so a lost executor costs one step at most, and each step
    is computed once.  Where the setting is absent and the master is local, as in
    tests, a temporary folder takes its place; on a cluster that would be a
    different disk on each machine, so there it is an error.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.gettempdir()
        self.root = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
        self.count = 0
        self.paths: set[str] = set()

    def save(self, df: DataFrame, *measures: Column, name: str = "") -> DataFrame:
        """The table as written, in the folder ``name`` if given; ``saved_rows`` of it is its number of rows, ``saved_<name>`` an aggregate of that name."""
        self.count += 1
        path, seen = f"{self.root}/{name or self.count}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *measures).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.saved_path = path
        for measure, value in seen.get.items():
            setattr(out, f"saved_{measure}", value)
        self.paths.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes saved tables that nothing needs any more."""
        self._delete({df.saved_path for df in tables})

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all saved tables but these."""
        self._delete(self.paths - {df.saved_path for df in tables})

    def _delete(self, paths: set[str]) -> None:
        jvm = self.spark._jvm
        for path in map(jvm.org.apache.hadoop.fs.Path, sorted(paths)):
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths -= paths
