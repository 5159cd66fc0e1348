"""Tables written between the steps of a job, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local, as in tests, a temporary
    folder takes its place; on a cluster that would be a different disk on each
    machine, so there it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Staged tables that are still there.
_HELD: set[str] = set()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and the work done once."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    _HELD.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _delete(spark: SparkSession, paths: set[str]) -> None:
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, sorted(paths)):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _HELD.difference_update(paths)


def unstaged(df: DataFrame) -> None:
    """Deletes a staged table that nothing needs any more."""
    _delete(df.sparkSession, {df.staged_path})


class staging:
    """A scope: tables staged in it are deleted at its end, when its results have been written elsewhere.

    Results are lazy and read staged tables, so operators can't delete those that
    their result needs; who writes the result can.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> staging:
        self.before = set(_HELD)
        return self

    def __exit__(self, *_: object) -> None:
        _delete(self.spark, _HELD - self.before)
