"""Linear estimators on weighted Gram matrices.

One Spark aggregate gives X'WX and X'Wy for any weights that are column
expressions; the system, of a size set by the number of features, is solved on the
driver.  Robust fits repeat that with new weights (iteratively reweighted least
squares), tail means take Newton steps (``tails``), and bounds on the greatest
residual exchange a few rows with the driver, so no fit moves rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratiospark.operators.stacking import simplex
from ratiospark.operators.tails import Block, Part, TailFit, least_tails
from ratiospark.sources.staging import staged


@dataclass(frozen=True)
class LinearModel:
    """Coefficients of ``features``, the intercept, and a link for the mean."""

    features: tuple[str, ...]
    beta: np.ndarray
    intercept: float
    link: str = "identity"

    def linear(self) -> Column:
        out = F.lit(self.intercept)
        for c, b in zip(self.features, self.beta, strict=True):
            out = out + F.col(c) * float(b)
        return out

    def mean(self) -> Column:
        eta = self.linear()
        return {"identity": eta, "log": F.exp(eta), "logit": 1 / (1 + F.exp(-eta))}[self.link]

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.mean())


def gram(df: DataFrame, columns: Sequence[Column], weight: Column | None = None, groups: Sequence[str] = ()):
    """Sums of weighted products of the columns: a symmetric matrix, or one by group."""
    w, k = (F.lit(1.0) if weight is None else weight), len(columns)
    sums = [F.sum(w * columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]

    def matrix(row) -> np.ndarray:
        out = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
        return out

    if not groups:
        return matrix(df.agg(*sums).first())
    return {tuple(r[g] for g in groups): matrix(r) for r in df.groupBy(*groups).agg(*sums).collect()}


def _design(features: Sequence[str], y: Column | str) -> list[Column]:
    return [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(y).cast("double") if isinstance(y, str) else y]


def _prepared(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of an iterative fit, staged once."""
    return df if "staged_path" in df.__dict__ else staged(df.select(*dict.fromkeys(columns)))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]


def _model(features: Sequence[str], coef: np.ndarray, link: str = "identity") -> LinearModel:
    return LinearModel(tuple(features), np.asarray(coef[1:]), float(coef[0]), link)


def least_squares(df: DataFrame, features: Sequence[str], y: str, weight: Column | None = None, l2: float = 0.0) -> LinearModel:
    """M1: ordinary, weighted or ridge least squares; the intercept is not penalised, ``l2`` is a row's share."""
    g = gram(df, _design(features, y), weight)
    n = g[0, 0]
    a = g[:-1, :-1] + n * l2 * np.diag([0.0] + [1.0] * len(features))
    return _model(features, _solve(a, g[:-1, -1]))


def reweighted(df: DataFrame, features: Sequence[str], y: str, weight: Callable[[Column], Column], steps: int = 50, tol: float = 1e-6, start: LinearModel | None = None, l2: float = 0.0) -> LinearModel:
    """Least squares with weights of the residual, until coefficients settle; unconverged fits return the last."""
    df = _prepared(df, [*features, y])
    model = start or least_squares(df, features, y, l2=l2)
    for _ in range(steps):
        new = least_squares(df, features, y, weight(F.col(y) - model.linear()), l2)
        moved = max(abs(new.intercept - model.intercept), *(np.abs(new.beta - model.beta)), 0.0)
        model = new
        if moved < tol:
            break
    return model


@dataclass(frozen=True)
class AbsoluteFit:
    """Sum of absolute residuals, and a dual value under every fit's sum; ``passes`` over the rows."""

    model: LinearModel
    primal: float
    dual: float
    passes: int


def least_absolute_exact(df: DataFrame, features: Sequence[str], y: str, tol: float = 1e-8, most: int = 300) -> AbsoluteFit:
    """M12 with a certificate: Newton steps, or reweighted ones where the band holds too few rows, on absolute values rounded within a band that shrinks until primal and dual value agree to ``tol``.

    The slopes of the rounded values at their minimum, between -1 and 1, are
    orthogonal to the features, so the sum of slope times y is a lower bound.  A pass
    is one aggregate: the step's system over the rows in the band, and the slopes'
    sums; a step's length comes from one more, for several lengths at once.  Raises
    where the values don't agree after ``most`` passes.
    """
    df = _prepared(df, [*features, y])
    x = _design(features, y)[:-1]
    k, target = len(x), F.col(y).cast("double")
    whole = gram(df, _design(features, y))
    coef, scale = _solve(whole[:-1, :-1], whole[:-1, -1]), math.sqrt(max(whole[-1, -1], 1e-300) / max(whole[0, 0], 1))
    n = whole[0, 0]

    def residual(b: np.ndarray) -> Column:
        out = target
        for v, c in zip(x, b, strict=True):
            out = out - v * F.lit(float(c))
        return out

    upper = np.triu_indices(k)

    def symmetric(values: Sequence[float]) -> np.ndarray:
        out = np.zeros((k, k))
        out[upper] = values
        return out + np.triu(out, 1).T

    def at(b: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        r = residual(b)
        slope = F.least(F.greatest(r / band, F.lit(-1.0)), F.lit(1.0))
        near = F.when(F.abs(r) < band, 1.0).otherwise(0.0)
        weight = 1 / F.greatest(F.abs(r), F.lit(band))
        aggs = [F.sum(F.abs(r)), F.sum(slope * target), *(F.sum(slope * v) for v in x), *(F.sum(w * x[i] * x[j]) for w in (near, weight) for i, j in zip(*upper, strict=True))]
        row = df.agg(*(a.alias(f"c{i}") for i, a in enumerate(aggs))).first()
        cut = 2 + k + len(upper[0])
        return np.array(row[2 : 2 + k]), symmetric(row[2 + k : cut]) / band, symmetric(row[cut:]), float(row[0]), float(row[1])

    def rounded_sums(points: list[np.ndarray], band: float) -> list[float]:
        each = [F.when(F.abs(r) < band, r * r / (2 * band) + band / 2).otherwise(F.abs(r)) for r in map(residual, points)]
        return list(df.agg(*(F.sum(e).alias(f"c{i}") for i, e in enumerate(each))).first())

    if not n:
        raise ValueError("no rows")
    band, passes, ridge = scale, 1, 1e-10 * whole[:-1, :-1] / scale
    size = np.sqrt(np.diag(whole)[:-1] * n)
    lengths = [(0, a) for a in (1.0, 0.5, 0.2, 0.05, 0.01)] + [(1, a) for a in (8.0, 4.0, 2.0, 1.0, 0.5, 0.0)]
    while passes < most:
        slopes, hessian, majorant, primal, dual = at(coef, band)
        passes += 1
        settled = (np.abs(slopes) <= 1e-11 * size).all()
        if not settled:
            moves = _solve(hessian + ridge, slopes), _solve(majorant, slopes)
            sums = rounded_sums([coef + a * moves[m] for m, a in lengths], band)
            passes += 1
            best = int(np.argmin(sums))
            if sums[best] < sums[-1] * (1 - 1e-15):
                coef = coef + lengths[best][1] * moves[lengths[best][0]]
                continue
            # The sums are as low as rounding shows; a Newton step may still level the slopes.
            there = at(coef + moves[0], band)
            passes += 1
            if np.abs(there[0] / size).max() < 0.5 * np.abs(slopes / size).max():
                coef, (slopes, _, _, primal, dual) = coef + moves[0], there
        # As low as rounding allows.
        if primal - dual <= tol * primal and (np.abs(slopes) <= 1e-9 * size).all():
            return AbsoluteFit(_model(features, coef), primal, dual, passes)
        if primal <= 1e-12 * n * scale:
            return AbsoluteFit(_model(features, coef), primal, 0.0, passes)
        band /= 8
    raise ArithmeticError(f"no certificate after {most} passes: {primal} against {dual}")


def least_absolute(df: DataFrame, features: Sequence[str], y: str, floor: float = 1e-4) -> LinearModel:
    """Least absolute deviations, weights 1 / |residual|."""
    return reweighted(df, features, y, lambda r: 1 / F.greatest(F.abs(r), F.lit(floor)))


def least_proportional(df: DataFrame, features: Sequence[str], y: str) -> LinearModel:
    """Weights 1 / (residual^2 + 1), at most 99 steps to a tolerance of 1e-4."""
    return reweighted(df, features, y, lambda r: 1 / (r * r + 1), steps=99, tol=1e-4)


def log_absolute(df: DataFrame, features: Sequence[str], y: str, floor: float = 1e-3) -> LinearModel:
    """Sum of log |residual|, majorised: weights 1 / residual^2, from the absolute fit."""
    df = _prepared(df, [*features, y])
    return reweighted(df, features, y, lambda r: 1 / F.greatest(r * r, F.lit(floor)), start=least_absolute(df, features, y))


def _extremes(df: DataFrame, model: LinearModel, y: str) -> tuple[float, list[tuple[float, ...]]]:
    """The greatest |residual| and the rows (1, features, y) of the highest and the lowest residual, by one aggregate."""
    r = F.col(y).cast("double") - model.linear()
    row = F.array(*_design(model.features, y))
    found = df.agg(F.max(r), F.min(r), F.max_by(row, r), F.min_by(row, r)).first()
    return max(abs(found[0]), abs(found[1])), [tuple(found[2]), tuple(found[3])]


def _chebyshev(active: Sequence[tuple[float, ...]]) -> tuple[np.ndarray, float]:
    """Coefficients with the least greatest |residual| on a few rows, and that residual; a linear program on the driver."""
    rows = np.array(active)
    x, t = rows[:, :-1], rows[:, -1]
    n, k = x.shape
    one = np.ones((n, 1))
    a = np.vstack([np.hstack([x, -x, -one]), np.hstack([-x, x, -one])])
    found = simplex(np.r_[np.zeros(2 * k), -1.0, np.zeros(2 * n)], np.hstack([a, np.eye(2 * n)]), np.r_[t, -t])
    return found[:k] - found[k : 2 * k], float(found[2 * k])


def least_maximum(df: DataFrame, features: Sequence[str], y: str, rounds: int = 500, tol: float = 1e-9) -> LinearModel:
    """The least greatest |residual|, by exchange.

    A linear program over a few rows bounds it from below; one aggregate finds
    the rows furthest off, which join the few, until none is further off than
    the bound.
    """
    df = _prepared(df, [*features, y])
    model = least_squares(df, features, y)
    high, active = _extremes(df, model, y)
    for _ in range(rounds):
        coef, bound = _chebyshev(active)
        model = _model(features, coef)
        high, worst = _extremes(df, model, y)
        if high <= bound + tol * (1 + abs(bound)):
            return model
        active = list(dict.fromkeys([*active, *worst]))
    raise ValueError(f"the greatest residual {high} is still over the bound {bound}")


def _bounded_squares(g: np.ndarray, active: Sequence[tuple[float, ...]], bound: float, sweeps: int = 20_000) -> np.ndarray:
    """Least squares from their Gram matrix with |residual| <= bound on a few rows: coordinate ascent on the multipliers."""
    rows = np.array(active)
    sides, right = np.vstack([rows[:, :-1], -rows[:, :-1]]), np.r_[rows[:, -1] + bound, -rows[:, -1] + bound]
    n = g[0, 0]
    inverse = np.linalg.pinv(g[:-1, :-1] / n)
    coef, pull = inverse @ (g[:-1, -1] / n), sides @ inverse
    size = np.einsum("ij,ij->i", pull, sides)
    held = np.zeros(len(sides))
    for _ in range(sweeps):
        worst = 0.0
        for i in range(len(sides)):
            change = max(-held[i], (sides[i] @ coef - right[i]) / max(size[i], 1e-300))
            if change:
                held[i] += change
                coef = coef - change * pull[i]
                worst = max(worst, abs(change) * size[i])
        if worst <= 1e-12 * (1 + bound):
            break
    return coef


def bounded_maximum(df: DataFrame, features: Sequence[str], y: str, limit: Callable[[float, float], float], rounds: int = 500) -> LinearModel:
    """Least squares with a greatest residual of at most ``limit`` of the plain fit's greatest and least |residual|.

    By exchange, as ``least_maximum``; if no coefficients meet the bound, that
    fit is returned.
    """
    df = _prepared(df, [*features, y])
    g = gram(df, _design(features, y))
    model = _model(features, _solve(g[:-1, :-1], g[:-1, -1]))
    r = F.abs(F.col(y) - model.linear())
    high, low = df.agg(F.max(r), F.min(r)).first()
    bound = limit(high, low)
    if high <= bound:
        return model
    least = least_maximum(df, features, y)
    if _extremes(df, least, y)[0] > bound:
        return least
    active: list[tuple[float, ...]] = []
    for _ in range(rounds):
        high, worst = _extremes(df, model, y)
        if high <= bound * (1 + 1e-9):
            break
        active = list(dict.fromkeys([*active, *worst]))
        model = _model(features, _bounded_squares(g, active, bound * (1 - 1e-9)))
    return model


def max_deviation_constrained(df: DataFrame, features: Sequence[str], y: str, share: float) -> LinearModel:
    """The greatest residual at most (1 - share) of the least-squares one's."""
    return bounded_maximum(df, features, y, lambda high, low: (1 - share) * high)


def least_mse_constrained(df: DataFrame, features: Sequence[str], y: str, share: float) -> LinearModel:
    """The greatest residual at most (1 + share) times the range of the least-squares |residuals|."""
    return bounded_maximum(df, features, y, lambda high, low: (1 + share) * (high - low))


def _residual(features: Sequence[str], y: str) -> Part:
    return Part(1.0, "abs", F.col(y).cast("double"), [F.lit(-1.0), *(-F.col(f).cast("double") for f in features)])


def _tail_rows(df: DataFrame, features: Sequence[str], y: str) -> tuple[DataFrame, np.ndarray]:
    """The columns of a fit, staged once, and the coefficients to start from."""
    rows = staged(df.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(y).cast("double").alias(y)))
    model = least_squares(rows, features, y)
    return rows, np.r_[model.intercept, model.beta]


def _ratio_slopes(rows: DataFrame, features: Sequence[str], y: str) -> tuple[list[Column], np.ndarray, float, float]:
    """(1, features) / y by row, their means, and the mean and deviation of y."""
    size = F.when(F.abs(F.col(y)) > 1e-9, F.col(y)).otherwise(F.lit(1e-9))
    over = [1 / size, *(F.col(f) / size for f in features)]
    found = rows.agg(*(F.avg(c).alias(f"c{i}") for i, c in enumerate(over)), F.avg(y).alias("mean"), F.stddev_pop(y).alias("sd")).first()
    return over, np.array([found[f"c{i}"] for i in range(len(over))]), found["mean"], found["sd"]


def _covariance_share(rows: DataFrame, features: Sequence[str], y: str, weight: float, shape: str = "abs") -> Part:
    """A row's share of the covariance of the price with the ratio f / y: (y - mean) times the ratio less its mean."""
    over, means, mean, _ = _ratio_slopes(rows, features, y)
    off = F.col(y) - F.lit(mean)
    return Part(weight, shape, F.lit(0.0), [off * (c - F.lit(float(m))) for c, m in zip(over, means, strict=True)])


def _fitted(features: Sequence[str], found: TailFit) -> LinearModel:
    return _model(features, found.coef)


def tail_mean(df: DataFrame, features: Sequence[str], y: str, keep: float, l2: float = 0.0, l1: float = 0.0, steps: int = 12) -> LinearModel:
    """M13 without bounds: the least mean of the worst ``keep`` share of the |residuals|; at most ``steps`` Newton steps at each width."""
    return stable_regression(df, features, y, keep, l2, l1, steps=steps)


def stable_regression(df: DataFrame, features: Sequence[str], y: str, keep: float = 0.5, l2: float = 0.0, l1: float = 0.0, cov_bound: float | None = None, spread_bound: float | None = None, steps: int = 12) -> LinearModel:
    """The tail mean of |residuals|, with penalties of the coefficients and two optional bounds on the ratio f / y.

    ``cov_bound``: |covariance of the ratio with y| at most this many deviations
    of y; ``spread_bound``: mean distance of the ratio from its mean at most this.
    """
    rows, start = _tail_rows(df, features, y)
    blocks, scalars = [Block([_residual(features, y)], keep)], []
    if cov_bound is not None or spread_bound is not None:
        over, means, mean, sd = _ratio_slopes(rows, features, y)
        if cov_bound is not None:
            products = rows.agg(*(F.avg((F.col(y) - F.lit(mean)) * c).alias(f"c{i}") for i, c in enumerate(over))).first()
            scalars.append((np.array(list(products), dtype=float), cov_bound * sd))
        if spread_bound is not None:
            blocks.append(Block([Part(1.0, "abs", F.lit(0.0), [c - F.lit(float(m)) for c, m in zip(over, means, strict=True)])], bound=spread_bound))
    return _fitted(features, least_tails(rows, blocks, start, l1, l2, scalars, steps=steps))


def stable_adversarial(df: DataFrame, features: Sequence[str], y: str, keep: float, rho_cov: float, rho_var: float, l1: float = 0.0, l2: float = 0.0, negative_only: bool = False) -> LinearModel:
    """One tail mean of |e| + rho_cov |share of the covariance of ratio and price| + rho_var |e - mean e|; e is the residual.

    ``negative_only`` counts a share only where it is negative.
    """
    rows, start = _tail_rows(df, features, y)
    means = rows.agg(F.avg(y), *(F.avg(f) for f in features)).first()
    apart = Part(rho_var, "abs", F.col(y) - F.lit(means[0]), [F.lit(0.0), *(F.lit(means[1 + i]) - F.col(f) for i, f in enumerate(features))])
    share = _covariance_share(rows, features, y, rho_cov, "negative" if negative_only else "abs")
    return _fitted(features, least_tails(rows, [Block([_residual(features, y), share, apart], keep)], start, l1, l2))


def stable_adversarial_two(df: DataFrame, features: Sequence[str], y: str, keep: float, rho_cov: float, l1: float = 0.0, l2: float = 0.0, negative_only: bool = False) -> LinearModel:
    """Two tail means, of |e| and, times rho_cov, of the |shares of the covariance|, each over its own worst rows."""
    rows, start = _tail_rows(df, features, y)
    share = _covariance_share(rows, features, y, 1.0, "negative" if negative_only else "abs")
    return _fitted(features, least_tails(rows, [Block([_residual(features, y)], keep), Block([share], keep, rho_cov)], start, l1, l2))


def robust_ratio(df: DataFrame, features: Sequence[str], y: str, keep: float, weight: float, anchor: float = 1.0, value: str | None = None, l1: float = 0.0, l2: float = 0.0) -> LinearModel:
    """A tail mean of |e| + weight (|v h| + h^2), h = f / y - anchor, v the centred ``value``, by default y in deviations."""
    wanted = df.withColumn("_value", F.col(value or y).cast("double")).withColumn("_y", F.col(y).cast("double"))
    rows = staged(wanted.select(*(F.col(f).cast("double").alias(f) for f in features), F.col("_y").alias(y), "_value"))
    model = least_squares(rows, features, y)
    mean, sd = rows.agg(F.avg("_value"), F.stddev_pop("_value")).first()
    v = (F.col("_value") - F.lit(mean)) / F.lit(1.0 if value else sd or 1.0)
    over = _ratio_slopes(rows, features, y)[0]
    prd = Part(weight, "abs", v * F.lit(-anchor), [v * c for c in over])
    cod = Part(weight, "square", F.lit(-anchor), over)
    return _fitted(features, least_tails(rows, [Block([_residual(features, y), prd, cod], keep)], np.r_[model.intercept, model.beta], l1, l2))


def linear_svm(df: DataFrame, features: Sequence[str], y: str, l2: float = 0.0) -> LinearModel:
    """M20, the hinge: the mean of what y f lacks to 1, y being 1 or -1 (0 counts as -1), plus l2 times the squared coefficients."""
    signed = df.withColumn("_s", F.when(F.col(y) > 0, 1.0).otherwise(-1.0))
    rows, start = _tail_rows(signed.select(*features, "_s"), features, "_s")
    s = F.col("_s")
    return _fitted(features, least_tails(rows, [Block([Part(1.0, "negative", F.lit(-1.0), [s, *(s * F.col(f) for f in features)])])], start, l2=2 * l2))


def glm(df: DataFrame, features: Sequence[str], y: str, family: str, l2: float = 0.0, steps: int = 30, weight: Column | None = None) -> LinearModel:
    """Linear, logistic or Poisson regression by reweighted least squares on the working response, or "svm"; ``mean`` gives the prediction."""
    if family == "linear":
        return least_squares(df, features, y, weight, l2)
    if family == "svm":
        if weight is not None:
            raise ValueError("the hinge takes no weights")
        return linear_svm(df, features, y, l2)
    link = {"logistic": "logit", "poisson": "log"}[family]
    if weight is None:
        df = _prepared(df, [*features, y])
    coef = np.zeros(len(features) + 1)
    if family == "poisson":
        coef[0] = math.log(max(df.agg(F.avg(y)).first()[0] or 1e-9, 1e-9))
    for _ in range(steps):
        model = _model(features, coef, link)
        mu = F.greatest(F.least(model.mean(), F.lit(1e12)), F.lit(1e-9))
        var = mu * (1 - F.least(mu, F.lit(1 - 1e-9))) if family == "logistic" else mu
        var = F.greatest(var, F.lit(1e-9))
        w = var if weight is None else var * weight
        g = gram(df, _design(features, model.linear() + (F.col(y) - mu) / var), w)
        n = df.count() if l2 else 0
        new = _solve(g[:-1, :-1] + n * l2 * np.diag([0.0] + [1.0] * len(features)), g[:-1, -1])
        moved, coef = np.abs(new - coef).max(), new
        if moved < 1e-8:
            break
    return _model(features, coef, link)


def group_constrained(df: DataFrame, features: Sequence[str], y: str, group: str, bound: float, family: str = "linear", l2: float = 0.0, rounds: int = 60) -> tuple[LinearModel, dict]:
    """``group_bounded`` without the attained error; warns where the bound is not met."""
    model, extra, reached = group_bounded(df, features, y, group, bound, family, l2, rounds)
    if reached > 1 + 1e-3:
        warnings.warn(f"after {rounds} rounds the worst group's error is {reached:.4f} of its bound", stacklevel=2)
    return model, extra


def group_bounded(df: DataFrame, features: Sequence[str], y: str, group: str, bound: float, family: str = "linear", l2: float = 0.0, rounds: int = 60) -> tuple[LinearModel, dict, float]:
    """(model, multipliers, attained error): a fit whose group errors are at most ``bound`` of the plain fit's worst group error.

    Multipliers by group grow while a group's mean loss is over the bound; the
    fit is the one of rows weighted by 1 + multiplier.  The attained error is the
    greatest group error over its limit: 1, to a tolerance of 1e-3, where the
    bound is met.
    """

    df = _prepared(df, [*features, y, group])

    def loss(m: LinearModel) -> Column:
        mu = m.mean()
        if family == "logistic":
            mu = F.least(F.greatest(mu, F.lit(1e-9)), F.lit(1 - 1e-9))
            return -(F.col(y) * F.log(mu) + (1 - F.col(y)) * F.log(1 - mu))
        if family == "poisson":
            return mu - F.col(y) * F.log(F.greatest(mu, F.lit(1e-9)))
        return F.pow(F.col(y) - mu, 2)

    def by_group(m: LinearModel) -> dict:
        return {r[0]: r[1] for r in df.groupBy(group).agg(F.avg(loss(m))).collect()}

    model = glm(df, features, y, family, l2)
    errors = by_group(model)
    limit, extra = bound * max(errors.values()), dict.fromkeys(errors, 0.0)
    for k in range(rounds):
        if max(errors.values()) <= limit * (1 + 1e-3):
            break
        for g, e in errors.items():
            extra[g] = max(0.0, extra[g] + (e / limit - 1) * 4 / math.sqrt(k + 1))
        pairs = [x for g, v in extra.items() for x in (F.lit(g), F.lit(1 + v))]
        model = glm(df, features, y, family, l2, weight=F.create_map(*pairs)[F.col(group)])
        errors = by_group(model)
    return model, extra, max(errors.values()) / limit


def fair_ridge(df: DataFrame, features: Sequence[str], y: str, alpha: float = 0.0, rho_ratio: float = 0.0, rho_cov: float = 0.0, mode: str = "div") -> LinearModel:
    """Ridge on log prices with a penalty on the spread of the ratio and on its covariance with the price, in closed form.

    The ratio is f / y ("div") or f - y ("diff").  With D = 1 / y or 1 and z = y
    less its mean, the system is X'X / n + alpha I + rho_ratio X'D^2X / n plus the
    rank-one term rho_cov a a', a = X'(D z) / n; all by one aggregate.
    """
    d = 1 / F.greatest(F.abs(F.col(y)), F.lit(1e-12)) if mode == "div" else F.lit(1.0)
    n, mean = df.agg(F.count("*"), F.avg(y)).first()
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    k = len(x)
    t, z = F.col(y).cast("double"), F.col(y) - F.lit(mean)
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(d * d * x[i] * x[j]).alias(f"b{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(x[i] * t).alias(f"c{i}") for i in range(k)] + [F.sum(d * d * x[i] * t).alias(f"d{i}") for i in range(k)] + [F.sum(d * z * x[i]).alias(f"e{i}") for i in range(k)] + [F.sum(d * z * t).alias("f")]
    row = df.agg(*sums).first()
    full = lambda p: np.array([[row[f"{p}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n
    vec = lambda p: np.array([row[f"{p}{i}"] for i in range(k)]) / n
    # The target ratio is y / y = 1 ("div") or y - y = 0 ("diff"): both pull X b towards y.
    a = full("a") + alpha * np.diag([0.0] + [1.0] * (k - 1)) + rho_ratio * full("b")
    b = vec("c") + rho_ratio * vec("d")
    u = vec("e")
    base, along = _solve(a, b), _solve(a, u)
    # Sherman-Morrison for a + rho u u', whose right side gains rho u (d z t).
    target = row["f"] / n
    base = base + rho_cov * target * along
    return _model(features, base - along * (rho_cov * float(u @ base)) / (1 + rho_cov * float(u @ along)))


def price_of_fairness(plain: float, constrained: float) -> float:
    """Relative loss a constraint costs."""
    return (constrained - plain) / plain if plain else float("nan")


def fairness_price_bounds(hessian: np.ndarray, direction: np.ndarray, delta: float, curvature: float = 0.0) -> tuple[float, float, float]:
    """(Taylor, lower, upper) loss of moving ``delta`` along a constraint's gradient.

    The cheapest step is -delta H^-1 a / (a' H^-1 a), costing delta^2 / (2 a' H^-1 a)
    to second order; with curvature M the exact cost lies between the factors
    2 (exp(-M) + M - 1) / M^2 and 2 (exp(M) - M - 1) / M^2 of that.
    """
    step = np.linalg.solve(hessian, direction)
    taylor = delta * delta / (2 * float(direction @ step))
    if curvature <= 0:
        return taylor, taylor, taylor
    m = curvature
    return taylor, 2 * (math.exp(-m) + m - 1) / m**2 * taylor, 2 * (math.exp(m) - m - 1) / m**2 * taylor
