"""Measures of dependence beyond correlation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiospark.operators.linear import gram
from ratiospark.operators.positions import with_average_rank


def mutual_information(cells: DataFrame, x: str, y: str, n: str = "n") -> DataFrame:
    """Mutual information (nats) of a contingency table (x, y, n)."""
    total = cells.agg(F.sum(n).alias("t"))
    px = cells.groupBy(x).agg(F.sum(n).alias("nx"))
    py = cells.groupBy(y).agg(F.sum(n).alias("ny"))
    rows = cells.join(px, x).join(py, y).crossJoin(F.broadcast(total))
    return rows.agg(F.sum(F.col(n) / F.col("t") * F.log(F.col(n) * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


#: Cells of the grids that a task counts in one reading of its rows.
CELLS = 4_000_000


def _counted(rows: DataFrame, grids: Sequence[tuple[int, int]], bounds: tuple[float, float, float, float]) -> DataFrame:
    """(a, b, i, j, n): rows by cell of each grid, counted in the tasks as they read their rows once; cells are summed by Spark."""
    x0, x1, y0, y1 = bounds
    starts = np.cumsum([0] + [a * b for a, b in grids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(starts[-1], dtype=np.int64)
        for batch in batches:
            x, y = ((batch.column(k).to_numpy() - lo) / (hi - lo) for k, (lo, hi) in enumerate(((x0, x1), (y0, y1))))
            across = {a: np.minimum(np.floor(x * a), a - 1).astype(np.int64) for a in {a for a, _ in grids}}
            along = {b: np.minimum(np.floor(y * b), b - 1).astype(np.int64) for b in {b for _, b in grids}}
            for (a, b), at in zip(grids, starts, strict=False):
                counts[at : at + a * b] += np.bincount(across[a] * b + along[b], minlength=a * b)
        for (a, b), at in zip(grids, starts, strict=False):
            held = np.flatnonzero(counts[at : at + a * b])
            if len(held):
                cols = [np.full(len(held), a), np.full(len(held), b), held // b, held % b, counts[at + held]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["a", "b", "i", "j", "n"])

    return rows.mapInArrow(run, "a long, b long, i long, j long, n long").groupBy("a", "b", "i", "j").agg(F.sum("n").alias("n"))


def mic(df: DataFrame, x: str, y: str, exponent: float = 0.6) -> float:
    """Greatest normalised mutual information over equal-width grids of at most n^exponent cells; rows with a NULL are left out.

    No row is multiplied by grids: tasks keep the counts of as many grids as have
    ``CELLS`` cells together, and the rows are read once for each such block.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    n, x0, x1, y0, y1 = rows.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n or x0 == x1 or y0 == y1:
        return 0.0
    most = max(4, int(n**exponent + 1e-9))
    blocks: list[list[tuple[int, int]]] = [[]]
    held = 0
    for a in range(2, most // 2 + 1):
        for b in range(2, most // a + 1):
            if held + a * b > CELLS and blocks[-1]:
                blocks.append([])
                held = 0
            blocks[-1].append((a, b))
            held += a * b
    best = 0.0
    for grids in blocks:
        cells = _counted(rows, grids, (x0, x1, y0, y1))
        whole = lambda c: F.sum("n").over(Window.partitionBy("a", "b", c))
        mi = F.sum(F.col("n") / n * F.log(F.col("n") * n / (F.col("nx") * F.col("ny")))).alias("mi")
        scores = cells.withColumns({"nx": whole("i"), "ny": whole("j")}).groupBy("a", "b").agg(mi)
        best = max(best, float(scores.agg(F.max(F.col("mi") / F.log(F.least("a", "b")))).first()[0] or 0.0))
    return best


def rdc(df: DataFrame, x: str, y: str, k: int = 8, scale: float = 1 / 6, repeats: int = 3, ridge: float = 1e-6, seed: int = 0) -> float:
    """Randomised dependence coefficient: ranks, random sine features, greatest canonical correlation; the median of ``repeats``.

    Ranks come from positions over ranges, ties by their mean; the features'
    covariances from one aggregate.
    """
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    n = rows.count()
    for c in ("x", "y"):
        rows = with_average_rank(rows, c, f"u_{c}")
    found = []
    for t in range(repeats):
        rng = np.random.default_rng(seed + t)
        wx, wy = (rng.normal(0, scale, (k, 2)) for _ in range(2))
        wave = lambda c, w: [F.sin(F.col(c) * float(a) + float(b)) for a, b in w]
        g = gram(rows, [F.lit(1.0), *wave("u_x", wx), *wave("u_y", wy)])
        mean = g[0, 1:] / n
        cov = g[1:, 1:] / n - np.outer(mean, mean) + ridge * np.eye(2 * k)
        a, b, c = cov[:k, :k], cov[k:, k:], cov[:k, k:]
        values = np.linalg.eigvals(np.linalg.solve(a, c) @ np.linalg.solve(b, c.T))
        found.append(float(np.sqrt(min(1.0, max(0.0, values.real.max())))))
    return float(np.median(found))
