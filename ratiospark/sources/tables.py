"""Readers and writers of runs, metrics and reports."""

from __future__ import annotations

import csv
import json
import os
import traceback
from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_LAYOUT = ("data_id", "split_id", "fold_id")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, only the named columns; absent ones raise."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_dataset(spark: SparkSession, root: str, optional_schema: str | None = None) -> DataFrame:
    """A partitioned dataset; one without files raises, or is empty where a schema is given."""
    try:
        return spark.read.option("recursiveFileLookup", "false").parquet(root)
    except AnalysisException:
        if optional_schema is None:
            raise
        return spark.createDataFrame([], optional_schema)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S5."""
    return spark.read.csv(path, header=True, schema=schema)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Unreadable records have NULLs."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", "true").json(path)


def read_yaml(path: str) -> dict:
    """A missing file is an empty configuration."""
    if not os.path.exists(path):
        return {}
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def append_runs(df: DataFrame, root: str, layout: Sequence[str] = RUN_LAYOUT) -> None:
    """Appended below data_id=/split_id=/fold_id=, which prunes later reads; few files a partition."""
    df.repartition(*layout).write.mode("append").partitionBy(*layout).parquet(root)


def write_csv(df: DataFrame, path: str, small: bool = True) -> None:
    """One file for a report, many for data."""
    (df.coalesce(1) if small else df).write.mode("overwrite").csv(path, header=True)


def write_json_atomically(value: object, path: str) -> None:
    """To a sibling file that then takes the name."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, indent=1, default=str)
    os.replace(f"{path}.tmp", path)


def status_row(run: Mapping[str, object], status: str, error: BaseException | None = None) -> dict[str, object]:
    """Started, completed or failed, with the time and what went wrong."""
    row = {**run, "status": status, "timestamp_utc": datetime.now(UTC).isoformat()}
    if error is not None:
        row |= {"error_type": type(error).__name__, "error_message": str(error), "traceback": "".join(traceback.format_exception(error))}
    return row


def guarded(run: Mapping[str, object], work: Callable[[], object], log: Callable[[dict], None]) -> object | None:
    """Runs ``work`` between status rows; a failure is logged and the sweep goes on."""
    log(status_row(run, "started"))
    try:
        out = work()
    except Exception as error:  # the sweep's other runs are independent of it
        log(status_row(run, "failed", error))
        return None
    log(status_row(run, "completed"))
    return out


def latex_table(rows: Sequence[Mapping[str, object]], columns: Sequence[str]) -> str:
    """A table in LaTeX from report rows."""
    show = lambda v: f"{v:.4g}" if isinstance(v, float) else str(v).replace("_", r"\_")
    lines = [" & ".join(show(r.get(c, "")) for c in columns) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", " & ".join(c.replace("_", r"\_") for c in columns) + r" \\ \hline", *lines, r"\end{tabular}"])


def console_table(rows: Sequence[Mapping[str, object]], columns: Sequence[str]) -> str:
    """Aligned text."""
    show = lambda v: "NA" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    cells = [list(columns), *([show(r.get(c)) for c in columns] for r in rows)]
    widths = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells)


def results_csv(nested: Mapping[str, Mapping[str, float]], path: str) -> None:
    """{row: {column: value}} as CSV."""
    columns = sorted({c for v in nested.values() for c in v})
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["name", *columns])
        out.writerows([k, *(v.get(c, "") for c in columns)] for k, v in nested.items())


def union_ragged(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; absent columns are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def replace_run(df: DataFrame, root: str, layout: Sequence[str] = ("run_id",)) -> None:
    """The rows of a run in place of those it may have left before: a run written twice is there once.

    The folder is named by a text that no reader takes for a number, ``part``.
    """
    named = df.withColumn("part", F.concat_ws("_", F.lit("run"), *(F.col(c).cast("string") for c in layout)))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(root)


def intact_runs(spark: SparkSession, root: str) -> set[str]:
    """The runs below ``root`` that are completed and whose predictions are all there: as many rows as their manifest says."""
    status = read_dataset(spark, f"{root}/status", "run_id string, status string, timestamp_utc string")
    manifest = read_dataset(spark, f"{root}/manifest", "run_id string, n_rows long")
    held = read_dataset(spark, f"{root}/predictions", "run_id string").groupBy("run_id").agg(F.count("*").alias("held"))
    done = latest_status(status).where("status = 'completed'").join(manifest, "run_id").join(held, "run_id").where("held = n_rows")
    return {str(r.run_id) for r in done.select("run_id").collect()}


def latest_status(status: DataFrame) -> DataFrame:
    """The last status row of each run."""
    return status.groupBy("run_id").agg(F.max_by("status", "timestamp_utc").alias("status"))
