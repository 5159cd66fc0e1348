"""Fits whose group errors stay under a bound, with certificates.

The fit minimises the mean loss subject to: each group's mean loss is at most a
share of the plain fit's worst one.  Squared losses are quadratic, so one aggregate,
a Gram matrix a group, holds all there is to know of the rows; log-likelihoods take
one aggregate of group losses, gradients and Hessians a Newton step.  The program is
solved by a barrier method in as many variables as coefficients.  It first looks for
a fit within the bounds.  Where there is none, it says so, and the weights of the
groups prove it: no coefficients have a weighted mean loss under the weighted bounds.
Else the multipliers give a lower bound on the objective, and the gap to it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratiospark.functions.numeric import logistic, soft_plus
from ratiospark.operators.linear import LinearModel, _design, _model, _prepared, glm, gram

#: Mean losses, gradients and Hessians by group.
Parts = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class BoundedFit:
    """``errors`` of the groups against their ``limit``; ``lower`` is proven to be under every objective within the limits.

    Without a fit within the limits ``feasible`` is false, the model is the one of
    least worst error, and ``multipliers`` are weights, of sum 1, under which no
    coefficients have a mean error as low as ``limit``: ``lower`` is that least mean.
    """

    model: LinearModel
    feasible: bool
    errors: dict
    limit: float
    multipliers: dict
    objective: float
    lower: float


@dataclass(frozen=True)
class Quadratics:
    """Group losses b'Ab - 2 c'b + d of squared errors, from Gram matrices."""

    groups: list
    share: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    @staticmethod
    def of(df: DataFrame, features: Sequence[str], y: str, group: str) -> Quadratics:
        """One aggregate; groups are few enough for the driver, NULL is one of them."""
        grams = gram(df, _design(features, y), groups=[group])
        names = sorted((g[0] for g in grams), key=lambda g: (g is None, str(g)))
        found = np.array([grams[g,] for g in names])
        n = found[:, 0, 0]
        scaled = found / n[:, None, None]
        return Quadratics(names, n / n.sum(), scaled[:, :-1, :-1], scaled[:, :-1, -1], scaled[:, -1, -1])

    def __call__(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ab = self.a @ b
        return ab @ b - 2 * self.c @ b + self.d, 2 * (ab - self.c), 2 * self.a

    def least(self, weights: np.ndarray, ridge: np.ndarray | float = 0.0) -> tuple[np.ndarray, float]:
        """The coefficients of least weighted loss, and that loss."""
        a, c = np.tensordot(weights, self.a, 1) + ridge, weights @ self.c
        b = np.linalg.lstsq(a, c, rcond=None)[0]
        return b, float(b @ a @ b - 2 * c @ b + weights @ self.d)


def _likelihoods(df: DataFrame, features: Sequence[str], y: str, group: str, family: str) -> tuple[list, np.ndarray, Parts]:
    """Groups, their shares, and mean negative log-likelihoods by one aggregate a call."""
    names = sorted(((r[0], r[1]) for r in df.groupBy(group).agg(F.count("*")).collect()), key=lambda g: (g[0] is None, str(g[0])))
    n = np.array([c for _, c in names], dtype=float)
    x = _design(features, y)[:-1]
    k = len(x)

    def parts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        eta: Column = F.lit(0.0)
        for v, coef in zip(x, b, strict=True):
            eta = eta + v * F.lit(float(coef))
        mean = logistic(eta) if family == "logistic" else F.exp(eta)
        loss = soft_plus(eta) - F.col(y) * eta if family == "logistic" else mean - F.col(y) * eta
        bend = mean * (1 - mean) if family == "logistic" else mean
        aggs = [F.avg(loss), *(F.avg((mean - F.col(y)) * v) for v in x), *(F.avg(bend * x[i] * x[j]) for i in range(k) for j in range(i, k))]
        rows = {r[0]: np.array(r[1:], dtype=float) for r in df.groupBy(group).agg(*(a.alias(f"c{i}") for i, a in enumerate(aggs))).collect()}
        found = np.array([rows[g] for g, _ in names])
        hessian = np.zeros((len(names), k, k))
        upper = np.triu_indices(k)
        hessian[:, upper[0], upper[1]] = hessian[:, upper[1], upper[0]] = found[:, 1 + k :]
        return found[:, 0], found[:, 1 : 1 + k], hessian

    return [g for g, _ in names], n / n.sum(), parts


def _newton(value: Callable, at: np.ndarray, steps: int = 40) -> np.ndarray:
    """Damped Newton steps on a convex function that gives (value, gradient, Hessian), its value infinite outside its domain."""
    here = value(at)
    for _ in range(steps):
        move = -np.linalg.lstsq(here[2], here[1], rcond=None)[0]
        falls = float(-here[1] @ move)
        if falls / 2 <= 1e-12 * max(1.0, abs(here[0])):
            break
        size = 1.0
        while True:
            there = value(at + size * move)
            if there[0] <= here[0] - 0.25 * size * falls or size < 1e-10:
                break
            size /= 2
        if size < 1e-10:
            break
        at, here = at + size * move, there
    return at


OUTSIDE = (np.inf, np.zeros(0), np.zeros((0, 0)))


def _within(parts: Parts, limit: float | None, b: np.ndarray, tol: float, growth: float) -> tuple[np.ndarray, np.ndarray | None]:
    """Coefficients with all errors under the limit, or, where that is shown not to be or there is no limit, those of least worst error and the groups' weights."""
    k = len(b)
    worst = float(parts(b)[0].max())
    at, t = np.append(b, 1.1 * worst + 1e-12), 1.0 / max(worst, 1e-12)

    def value(v: np.ndarray, t: float):
        loss, grad, hess = parts(v[:k])
        room = v[k] - loss
        if room.min() <= 0 or not np.isfinite(loss).all():
            return OUTSIDE
        inv = 1 / room
        g = np.append(inv @ grad, t - inv.sum())
        h = np.zeros((k + 1, k + 1))
        h[:k, :k] = np.tensordot(inv, hess, 1) + (grad * (inv**2)[:, None]).T @ grad
        h[:k, k] = h[k, :k] = -(inv**2) @ grad
        h[k, k] = (inv**2).sum()
        return t * v[k] - np.log(room).sum(), g, h

    while True:
        at = _newton(lambda v, t=t: value(v, t), at)
        loss = parts(at[:k])[0]
        if limit is not None and loss.max() < limit * (1 - 1e-10):
            return at[:k], None
        weights = 1 / (at[k] - loss)
        if (limit is not None and at[k] - len(loss) / t > limit) or len(loss) / t < tol * max(worst, 1e-12):
            return at[:k], weights / weights.sum()
        t *= growth


def bounded_fit(df: DataFrame, features: Sequence[str], y: str, group: str, bound: float, family: str = "linear", l2: float = 0.0, tol: float = 1e-8) -> BoundedFit:
    """M19 ("linear"), M21 ("logistic", "poisson"): the fit of least mean loss, plus ``l2`` times the squared slopes, whose group losses are at most ``bound`` of the plain fit's worst.

    Rows with a NULL in a feature or in y must be left out before; a NULL group is a group.
    """
    df = _prepared(df, [*features, y, group])
    ridge = l2 * np.diag([0.0] + [1.0] * len(features))
    if family == "linear":
        exact = Quadratics.of(df, features, y, group)
        groups, share, parts, growth = exact.groups, exact.share, exact, 10.0
        b = exact.least(share, ridge)[0]
    else:
        exact, growth = None, 100.0
        groups, share, parts = _likelihoods(df, features, y, group, family)
        plain = glm(df, features, y, family, l2)
        b = np.append(plain.intercept, plain.beta)
    link = {"linear": "identity", "logistic": "logit", "poisson": "log"}[family]
    errors = parts(b)[0]
    limit, zero = bound * float(errors.max()), dict.fromkeys(groups, 0.0)

    def result(b: np.ndarray, feasible: bool, multipliers: dict, lower: float) -> BoundedFit:
        loss = parts(b)[0]
        return BoundedFit(_model(features, b, link), feasible, dict(zip(groups, loss.tolist(), strict=True)), limit, multipliers, float(share @ loss + b @ ridge @ b), lower)

    if bound >= 1:
        return result(b, True, zero, float(share @ errors + b @ ridge @ b))
    b, weights = _within(parts, limit, b, tol, growth)
    if weights is not None:
        # The least weighted loss: over the limit, it proves that no fit is within.
        lower = exact.least(weights)[1] if exact else float(weights @ parts(b)[0])
        return result(b, False, dict(zip(groups, weights.tolist(), strict=True)), lower)

    def value(v: np.ndarray, t: float):
        loss, grad, hess = parts(v)
        room = limit - loss
        if room.min() <= 0 or not np.isfinite(loss).all():
            return OUTSIDE
        inv = 1 / room
        g = t * (share @ grad + 2 * ridge @ v) + inv @ grad
        h = t * (np.tensordot(share, hess, 1) + 2 * ridge) + np.tensordot(inv, hess, 1) + (grad * (inv**2)[:, None]).T @ grad
        return t * (share @ loss + v @ ridge @ v) - np.log(room).sum(), g, h

    t = 1.0 / max(limit, 1e-12)
    while True:
        b = _newton(lambda v, t=t: value(v, t), b)
        loss = parts(b)[0]
        if len(loss) / t < tol * max(limit, 1e-12):
            break
        t *= growth
    multipliers = 1 / (t * (limit - loss))
    objective = float(share @ loss + b @ ridge @ b)
    if exact:
        # The multipliers of the groups at their limit again, from the gradients: the bound depends on their errors squared.
        grad, tight = parts(b)[1], limit - loss < 1e-4 * limit
        found = np.zeros(len(loss))
        found[tight] = np.maximum(0, np.linalg.lstsq(grad[tight].T, -(share @ grad + 2 * ridge @ b), rcond=None)[0])
        lower, multipliers = max(((exact.least(share + m, ridge)[1] - limit * m.sum(), m) for m in (multipliers, found)), key=lambda x: x[0])
    else:
        lower = objective - len(loss) / t
    return result(b, True, dict(zip(groups, multipliers.tolist(), strict=True)), float(lower))


def price_bounds(df: DataFrame, features: Sequence[str], y: str, group: str, bound: float) -> tuple[float, float, float]:
    """(lower, exact, upper) relative rise of the mean squared error that the bound costs, all from one aggregate.

    Below: the best multiplier of the worst group alone, a concave program in one
    number.  Above: the first point within the bounds on the way from the plain fit
    to the fit of least worst error, a root of a quadratic for each group.  NaN where
    no fit is within the bounds.
    """
    df = _prepared(df, [*features, y, group])
    exact = Quadratics.of(df, features, y, group)
    b, plain = exact.least(exact.share)
    errors = exact(b)[0]
    worst, limit = int(errors.argmax()), bound * float(errors.max())
    fit = bounded_fit(df, features, y, group, bound)
    if not fit.feasible:
        return float("nan"), float("nan"), float("nan")

    def dual(m: float) -> float:
        return exact.least(exact.share + m * np.eye(len(errors))[worst])[1] - m * limit

    low, high = 0.0, 1.0
    while dual(2 * high) > dual(high) and high < 1e12:
        high *= 2
    high *= 2
    for _ in range(200):  # golden section
        a, z = high - (high - low) * 0.6180339887498949, low + (high - low) * 0.6180339887498949
        low, high = (a, high) if dual(a) < dual(z) else (low, z)
    inner, _ = _within(exact, None, b, 1e-9, 10.0)  # the fit of least worst error
    move = inner - b
    reach = 0.0
    for k in range(len(errors)):
        quad, line, rest = float(move @ exact.a[k] @ move), float(2 * (exact.a[k] @ b - exact.c[k]) @ move), float(errors[k] - limit)
        if rest > 0:
            reach = max(reach, (-line - np.sqrt(max(0.0, line * line - 4 * quad * rest))) / (2 * quad) if quad > 0 else -rest / line)
    reach = min(1.0, reach)
    at = exact.share @ exact(b + reach * move)[0]
    return (max(dual(low), plain) - plain) / plain, (fit.objective - plain) / plain, (float(at) - plain) / plain
