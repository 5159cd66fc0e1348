"""Convex stacking of configurations under equity constraints (K1-K4).

The fold by configuration matrices are small (at most about a hundred columns), so
the linear program is solved on the driver by a dense two-phase simplex.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratiospark.operators.summary import complete_grid, top_configs


def simplex(c: np.ndarray, a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> np.ndarray | None:
    """x >= 0 with a x = b that maximises c x, by Bland's rule; None if there is none."""
    a, b = a.astype(float).copy(), b.astype(float).copy()
    a[b < 0], b[b < 0] = -a[b < 0], -b[b < 0]
    m, n = a.shape
    table = np.hstack([a, np.eye(m), b[:, None]])
    basis = list(range(n, n + m))

    def pivot(costs: np.ndarray, allowed: int) -> bool:
        while True:
            reduced = costs[:allowed] - costs[basis] @ table[:, :allowed]
            entering = np.flatnonzero(reduced > tol)
            if not len(entering):
                return True
            col = int(entering[0])
            rows = np.flatnonzero(table[:, col] > tol)
            if not len(rows):
                return False
            ratios = table[rows, -1] / table[rows, col]
            row = int(min(rows[ratios <= ratios.min() + tol], key=lambda r: basis[r]))
            table[row] /= table[row, col]
            for r in range(m):
                if r != row:
                    table[r] -= table[r, col] * table[row]
            basis[row] = col

    pivot(np.r_[np.zeros(n), -np.ones(m)], n + m)
    if sum(table[r, -1] for r in range(m) if basis[r] >= n) > 1e-7:
        return None
    for r in range(m):
        if basis[r] >= n and len(cols := np.flatnonzero(np.abs(table[r, :n]) > tol)):
            table[r] /= table[r, cols[0]]
            for q in range(m):
                if q != r:
                    table[q] -= table[q, cols[0]] * table[r]
            basis[r] = int(cols[0])
    pivot(np.r_[c, np.zeros(m)], n)
    x = np.zeros(n + m)
    x[basis] = table[:, -1]
    return x[:n]


def stack(accuracy: np.ndarray, bounded: dict[str, tuple[np.ndarray, float, float]], objective: str = "min_fold") -> np.ndarray | None:
    """Weights >= 0 with sum 1 that maximise the least (or mean) fold accuracy while each bounded metric stays in its range on every fold.

    Matrices are folds by configurations.  None if no weights do.
    """
    folds, k = accuracy.shape
    rows, right, slack = [], [], []
    # Variables: w, then t = t_plus - t_minus for the least fold.
    for f in range(folds if objective == "min_fold" else 0):
        rows.append(np.r_[accuracy[f], -1, 1])
        right.append(0.0)
        slack.append(-1)
    for m, low, high in bounded.values():
        for f in range(folds):
            rows += [np.r_[m[f], 0, 0], np.r_[m[f], 0, 0]]
            right += [low, high]
            slack += [-1, 1]
    rows.append(np.r_[np.ones(k), 0, 0])
    right.append(1.0)
    slack.append(0)
    a = np.array(rows)
    extra = np.zeros((len(rows), sum(s != 0 for s in slack)))
    for j, i in enumerate(i for i, s in enumerate(slack) if s):
        extra[i, j] = slack[i]
    c = np.r_[np.zeros(k), 1, -1] if objective == "min_fold" else np.r_[accuracy.mean(axis=0), 0, 0]
    x = simplex(np.r_[c, np.zeros(extra.shape[1])], np.hstack([a, extra]), np.array(right))
    return None if x is None else cleaned(x[:k])


def cleaned(w: np.ndarray) -> np.ndarray:
    """K3: negatives cut, sum 1; fails on weights that are no numbers."""
    if not np.isfinite(w).all() or np.maximum(w, 0).sum() <= 0:
        raise ValueError("the weights are not finite")
    w = np.maximum(w, 0)
    return w / w.sum()


def optimise(runs: DataFrame, fold: str, key: str, accuracy: str, constraints: dict[str, tuple[float, float]], max_models: int = 100, objective: str = "min_fold") -> DataFrame:
    """K1, K2: (key, weight) of the stack of the best ``max_models`` configurations on the complete grid."""
    grid = complete_grid(runs.na.drop(subset=[accuracy, *constraints]).dropDuplicates([fold, key]), fold, key)
    chosen = top_configs(grid, key, accuracy, max_models).select(key)
    grid = complete_grid(grid.join(F.broadcast(chosen), key, "left_semi"), fold, key)
    rows = grid.select(fold, key, accuracy, *constraints).collect()
    folds, keys = sorted({r[fold] for r in rows}), sorted({r[key] for r in rows})

    def matrix(name: str) -> np.ndarray:
        out = np.full((len(folds), len(keys)), np.nan)
        for r in rows:
            out[folds.index(r[fold]), keys.index(r[key])] = r[name]
        if np.isnan(out).any():
            raise ValueError("the grid has missing cells")
        return out

    w = stack(matrix(accuracy), {m: (matrix(m), low, high) for m, (low, high) in constraints.items()}, objective)
    if w is None:
        raise ValueError("no weights meet the constraints on every fold")
    return _weights(runs, key, keys, w)


def _weights(runs: DataFrame, key: str, keys: Sequence[str], w: np.ndarray) -> DataFrame:
    return runs.sparkSession.createDataFrame([(k, float(x)) for k, x in zip(keys, w, strict=True)], f"{key} string, weight double")
