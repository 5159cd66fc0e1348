"""Bounded fits: feasibility, certificates and prices, recomputed with numpy."""

import numpy as np
import pytest

from ratiospark.operators import bounded, linear


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(2)
    n = 600
    x, g = rng.normal(size=(n, 2)), rng.integers(0, 3, n)
    y = 3 + x @ [1.0, -0.5] + np.array([0.0, 0.8, -0.5])[g] + np.array([0.0, 0.6, 0.0])[g] * x[:, 0] + rng.normal(0, 0.3, n)
    df = spark.createDataFrame([(float(a), float(b), float(t), [None, "b", "c"][k]) for (a, b), t, k in zip(x, y, g, strict=True)], "a double, b double, y double, g string").cache()
    return df, np.c_[np.ones(n), x], y, g


def losses(x, y, g, b):
    return np.array([np.mean((y[g == k] - x[g == k] @ b) ** 2) for k in range(3)])


@pytest.mark.parametrize("bound", [0.9, 0.8])
def test_feasible_bounds_are_met_with_a_small_gap(groups, bound):
    df, x, y, g = groups
    fit = bounded.bounded_fit(df, ["a", "b"], "y", "g", bound)
    b = np.append(fit.model.intercept, fit.model.beta)
    plain = np.linalg.lstsq(x, y, rcond=None)[0]
    limit = bound * losses(x, y, g, plain).max()
    assert fit.feasible and np.isclose(fit.limit, limit)
    assert losses(x, y, g, b).max() <= limit * (1 + 1e-9)
    assert np.isclose(fit.objective, np.mean((y - x @ b) ** 2)) and 0 <= fit.objective - fit.lower <= 1e-6 * fit.objective
    # No feasible neighbour is better.
    rng = np.random.default_rng(0)
    for size in (1e-1, 1e-2, 1e-3):
        for _ in range(300):
            c = b + size * rng.normal(size=3)
            assert losses(x, y, g, c).max() > limit or np.mean((y - x @ c) ** 2) >= fit.objective - 1e-7
    assert set(fit.errors) == {None, "b", "c"}


def test_infeasible_bounds_are_proven(groups):
    df, x, y, g = groups
    fit = bounded.bounded_fit(df, ["a", "b"], "y", "g", 0.2)
    assert not fit.feasible
    w = np.array([fit.multipliers[k] for k in ("b", "c", None)])
    assert w.min() >= 0 and np.isclose(w.sum(), 1)
    rows = np.array([w[2], w[0], w[1]])[g] / np.bincount(g)[g]
    b = np.linalg.lstsq(x * np.sqrt(rows)[:, None], y * np.sqrt(rows), rcond=None)[0]
    assert np.isclose(np.sum(rows * (y - x @ b) ** 2), fit.lower) and fit.lower > fit.limit


def test_a_bound_of_one_is_the_plain_fit(groups):
    df, x, y, _ = groups
    fit = bounded.bounded_fit(df, ["a", "b"], "y", "g", 1.0)
    assert np.allclose(np.append(fit.model.intercept, fit.model.beta), np.linalg.lstsq(x, y, rcond=None)[0])


def test_price_lies_between_its_bounds(groups):
    df, *_ = groups
    prices = [bounded.price_bounds(df, ["a", "b"], "y", "g", s) for s in (0.95, 0.88, 0.8)]
    for low, exact, high in prices:
        assert 0 < low <= exact + 1e-7 and exact <= high + 1e-7
    assert prices[0][1] < prices[1][1] < prices[2][1]
    assert np.isnan(bounded.price_bounds(df, ["a", "b"], "y", "g", 0.2)).all()


def test_likelihood_bounds(spark):
    rng = np.random.default_rng(4)
    n = 500
    x, g = rng.normal(size=n), rng.integers(0, 2, n)
    p = 1 / (1 + np.exp(-(0.3 + np.where(g == 1, 1.6, 0.5) * x)))
    y = (rng.uniform(size=n) < p).astype(float)
    df = spark.createDataFrame([(float(a), float(t), int(k)) for a, t, k in zip(x, y, g, strict=True)], "x double, y double, g int")

    def loss(b):
        eta = b[0] + b[1] * x
        each = np.logaddexp(0, eta) - y * eta
        return np.array([each[g == k].mean() for k in (0, 1)]), each.mean()

    plain = linear.glm(df, ["x"], "y", "logistic")
    worst = loss([plain.intercept, plain.beta[0]])[0].max()
    fit = bounded.bounded_fit(df, ["x"], "y", "g", 0.995, "logistic", tol=1e-6)
    b = np.array([fit.model.intercept, fit.model.beta[0]])
    by_group, whole = loss(b)
    assert fit.feasible and by_group.max() <= 0.995 * worst * (1 + 1e-9) and np.isclose(whole, fit.objective)
    assert fit.objective - fit.lower < 1e-4
    for _ in range(400):
        c = b + rng.normal(0, 0.05, 2)
        other = loss(c)
        assert other[0].max() > 0.995 * worst or other[1] >= whole - 1e-5
    assert not bounded.bounded_fit(df, ["x"], "y", "g", 0.3, "logistic", tol=1e-4).feasible
