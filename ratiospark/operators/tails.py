"""Convex fits of tail means of row losses, by Newton steps on Spark aggregates (M13-M16, the hinge of M20).

A row's loss is a sum of absolute values, squares or negative parts of values that
are affine in the coefficients: the residual, the row's share of a covariance, the
ratio's distance from its target.  The mean of the worst share ``keep`` of the losses
g is the least over nu of nu + mean((g - nu)+) / keep, so nu is one more variable and
the whole is convex in coefficients and thresholds.  Kinks are rounded by a width that
falls in steps; at each width, one aggregate gives value, gradient and hessian of
every block, and another the values at several step lengths.  Only those sums come to
the driver, as many as the square of the number of features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """weight * shape(constant + slopes . coefficients) of a row; shape "abs", "square" or "negative" (the size of what is below 0)."""

    weight: float
    shape: str
    constant: Column
    slopes: Sequence[Column]


@dataclass(frozen=True)
class Block:
    """The mean of the row losses, of the worst share ``keep`` of them if given; held at ``bound`` if given, else minimised."""

    parts: Sequence[Part]
    keep: float | None = None
    weight: float = 1.0
    bound: float | None = None


@dataclass
class TailFit:
    """Coefficients, the intercept first; the objective they reach, and the value of each block."""

    coef: np.ndarray
    objective: float
    values: list[float] = field(default_factory=list)


def _rounded(v, mu: float, shape: str, sqrt):
    """A shape with its kink rounded, and its first two derivatives; of columns or numbers."""
    if shape == "square":
        return v * v, 2 * v, 2.0
    root = sqrt(v * v + mu * mu)
    if shape == "abs":
        return root, v / root, mu * mu / (root * root * root)
    sign = -1 if shape == "negative" else 1
    return (sign * v + root) / 2, (sign + v / root) / 2, mu * mu / (2 * root * root * root)


def _loss(block: Block, theta: np.ndarray, mu: float) -> Column:
    out = F.lit(0.0)
    for p in block.parts:
        out = out + p.weight * _rounded(_affine(p, theta), mu, p.shape, F.sqrt)[0]
    return out


def _affine(p: Part, theta: np.ndarray) -> Column:
    out = p.constant
    for s, t in zip(p.slopes, theta, strict=True):
        out = out + s * float(t)
    return out


class _Problem:
    def __init__(self, rows: DataFrame, blocks: Sequence[Block], k: int, l1: float, l2: float, scalars: Sequence[tuple[np.ndarray, float]]):
        self.rows, self.blocks, self.k, self.l1, self.l2, self.scalars = rows, blocks, k, l1, l2, scalars
        self.tails = [b for b, block in enumerate(blocks) if block.keep is not None]
        self.penalty = 1e3

    def _means(self, points: Sequence[np.ndarray], mu: float) -> np.ndarray:
        """Block means at each point."""
        columns = []
        for x in points:
            for b, block in enumerate(self.blocks):
                g = _loss(block, x[: self.k], mu)
                if block.keep is not None:
                    g = _rounded(g - float(x[self.k + self.tails.index(b)]), mu, "positive", F.sqrt)[0]
                columns.append(F.avg(g).alias(f"c{len(columns)}"))
        return np.array(list(self.rows.agg(*columns).first()), dtype=float).reshape(len(points), -1)

    def values(self, x: np.ndarray, means: np.ndarray) -> list[float]:
        return [m if b.keep is None else float(x[self.k + self.tails.index(i)]) + m / b.keep for i, (b, m) in enumerate(zip(self.blocks, means, strict=True))]

    def total(self, x: np.ndarray, means: np.ndarray, mu: float) -> float:
        out = self.l1 * np.sqrt(x[1 : self.k] ** 2 + mu * mu).sum() + self.l2 / 2 * (x[1 : self.k] ** 2).sum()
        for block, v in zip(self.blocks, self.values(x, means), strict=True):
            out += block.weight * v if block.bound is None else self.penalty * _rounded(v - block.bound, mu, "positive", np.sqrt)[0]
        for a, bound in self.scalars:
            for sign in (1, -1):
                out += self.penalty * _rounded(sign * (a @ x[: self.k]) - bound, mu, "positive", np.sqrt)[0]
        return float(out)

    def objective(self, points: Sequence[np.ndarray], mu: float) -> list[float]:
        return [self.total(x, m, mu) for x, m in zip(points, self._means(points, mu), strict=True)]

    def newton(self, x: np.ndarray, mu: float) -> np.ndarray:
        """The Newton step at x."""
        k, n = self.k, self.k + len(self.tails)
        rows, sums = self.rows, []
        for b, block in enumerate(self.blocks):
            made = {}
            for j, p in enumerate(block.parts):
                made[f"_v{b}_{j}"] = _affine(p, x[:k])
            rows = rows.withColumns(made)
            shapes = [_rounded(F.col(f"_v{b}_{j}"), mu, p.shape, F.sqrt) for j, p in enumerate(block.parts)]
            slope = {f"_d{b}_{i}": sum((p.weight * f1 * p.slopes[i] for p, (_, f1, _) in zip(block.parts, shapes, strict=True)), F.lit(0.0)) for i in range(k)}
            bend = {f"_h{b}_{j}": F.lit(p.weight) * f2 for j, (p, (_, _, f2)) in enumerate(zip(block.parts, shapes, strict=True))}
            g = sum((p.weight * f0 for p, (f0, _, _) in zip(block.parts, shapes, strict=True)), F.lit(0.0))
            if block.keep is None:
                outer = {f"_o{b}": g, f"_s{b}": F.lit(1.0), f"_t{b}": F.lit(0.0)}
            else:
                f0, f1, f2 = _rounded(g - float(x[k + self.tails.index(b)]), mu, "positive", F.sqrt)
                outer = {f"_o{b}": f0, f"_s{b}": f1, f"_t{b}": f2}
            rows = rows.withColumns(slope | bend | outer)
            d = [F.col(f"_d{b}_{i}") for i in range(k)]
            first, second = F.col(f"_s{b}"), F.col(f"_t{b}")
            sums += [F.avg(F.col(f"_o{b}")).alias(f"m{b}"), F.avg(first).alias(f"s{b}"), F.avg(second).alias(f"t{b}")]
            sums += [F.avg(first * d[i]).alias(f"g{b}_{i}") for i in range(k)] + [F.avg(second * d[i]).alias(f"x{b}_{i}") for i in range(k)]
            for i in range(k):
                for j in range(i, k):
                    inner = sum((F.col(f"_h{b}_{q}") * p.slopes[i] * p.slopes[j] for q, p in enumerate(block.parts)), F.lit(0.0))
                    sums.append(F.avg(first * inner + second * d[i] * d[j]).alias(f"h{b}_{i}_{j}"))
        row = rows.agg(*sums).first()
        grad, hess = np.zeros(n), np.zeros((n, n))
        beta = x[1:k]
        root = np.sqrt(beta**2 + mu * mu)
        grad[1:k] += self.l1 * beta / root + self.l2 * beta
        hess[range(1, k), range(1, k)] += self.l1 * mu * mu / root**3 + self.l2
        for b, block in enumerate(self.blocks):
            share = 1.0 if block.keep is None else 1 / block.keep
            g1, h1 = np.zeros(n), np.zeros((n, n))
            g1[:k] = [share * row[f"g{b}_{i}"] for i in range(k)]
            for i in range(k):
                for j in range(i, k):
                    h1[i, j] = h1[j, i] = share * row[f"h{b}_{i}_{j}"]
            if block.keep is not None:
                t = k + self.tails.index(b)
                g1[t] = 1 - share * row[f"s{b}"]
                h1[t, :k] = h1[:k, t] = [-share * row[f"x{b}_{i}"] for i in range(k)]
                h1[t, t] = share * row[f"t{b}"]
            if block.bound is None:
                grad, hess = grad + block.weight * g1, hess + block.weight * h1
            else:
                v = self.values(x, [row[f"m{q}"] for q in range(len(self.blocks))])[b]
                _, f1, f2 = _rounded(v - block.bound, mu, "positive", np.sqrt)
                grad, hess = grad + self.penalty * f1 * g1, hess + self.penalty * (f1 * h1 + f2 * np.outer(g1, g1))
        for a, bound in self.scalars:
            wide = np.r_[a, np.zeros(n - k)]
            for sign in (1, -1):
                _, f1, f2 = _rounded(sign * (a @ x[:k]) - bound, mu, "positive", np.sqrt)
                grad, hess = grad + self.penalty * f1 * sign * wide, hess + self.penalty * f2 * np.outer(wide, wide)
        return -np.linalg.lstsq(hess + 1e-12 * max(1e-12, np.trace(hess) / n) * np.eye(n), grad, rcond=None)[0]


LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)


def least_tails(rows: DataFrame, blocks: Sequence[Block], start: np.ndarray, l1: float = 0.0, l2: float = 0.0, scalars: Sequence[tuple[np.ndarray, float]] = (), widths: int = 6, steps: int = 12, tol: float = 1e-6) -> TailFit:
    """The coefficients (intercept first, not penalised) of the least sum of the blocks, from ``start``.

    ``scalars`` are (a, bound): |a . coefficients| is held at the bound.  Bounds are
    exact penalties whose weight rises until they hold; one that can't is an error.
    """
    problem = _Problem(rows, blocks, len(start), l1, l2, scalars)
    losses = [float(v) for v in rows.agg(*(F.avg(_loss(b, start, 0.0)).alias(f"l{i}") for i, b in enumerate(blocks))).first()]
    x = np.r_[start, [losses[b] for b in problem.tails]]
    scale = max(1e-9, losses[0])
    while True:
        for w in range(widths):
            mu = scale * 0.1 ** (w + 1)
            for _ in range(steps):
                step = problem.newton(x, mu)
                tried = [x + t * step for t in LENGTHS]
                found = problem.objective([*tried, x], mu)
                best = found.pop()
                k = int(np.nanargmin(found))
                gained = best - found[k]
                if gained > 0:
                    x = tried[k]
                # A wide rounding need not be solved closely.
                if not gained > (1e-3 if w < widths - 2 else tol) * (abs(best) + 1e-12):
                    break
        means = problem._means([x], 1e-12 * scale)[0]
        values = problem.values(x, means)
        over = [v - b.bound for v, b in zip(values, blocks, strict=True) if b.bound is not None] + [abs(a @ x[: len(start)]) - bound for a, bound in scalars]
        if max(over, default=0.0) <= 1e-4 * scale:
            break
        problem.penalty *= 30
        if problem.penalty > 1e9:
            raise ValueError("no coefficients meet the bounds")
    reached = sum(b.weight * v for b, v in zip(blocks, values, strict=True) if b.bound is None) + l1 * np.abs(x[1 : len(start)]).sum() + l2 / 2 * (x[1 : len(start)] ** 2).sum()
    return TailFit(x[: len(start)], float(reached), values)
