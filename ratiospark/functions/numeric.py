"""Column expressions shared by the operators; undefined values are NULL, not NaN or errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """True for numbers; NaN, infinities and NULL are not.  (In Spark NaN > 0 holds, hence the explicit test.)"""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def positive(c: Column | str) -> Column:
    """Finite and above zero."""
    return finite(c) & (col(c) > 0)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def median(c: Column | str, weight: Column | None = None) -> Column:
    return F.percentile(col(c), 0.5) if weight is None else F.percentile(col(c), 0.5, weight)


def quantile(c: Column | str, q: float) -> Column:
    """Exact, linearly interpolated."""
    return F.percentile(col(c), q)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation that is NULL where a side is constant; ``corr`` itself raises there under ANSI."""
    return F.try_divide(F.covar_pop(col(x), col(y)), F.stddev_pop(col(x)) * F.stddev_pop(col(y)))


def fisher_z(r: Column) -> Column:
    """atanh, with |r| held below 1."""
    held = F.least(F.greatest(r, F.lit(-0.999999)), F.lit(0.999999))
    return 0.5 * F.log((1 + held) / (1 - held))


def slope(y: Column | str, x: Column | str) -> Column:
    """Least-squares slope of y on x, NULL where x is constant."""
    return F.try_divide(F.covar_pop(col(x), col(y)), F.var_pop(col(x)))


def r_squared(truth: Column | str, guess: Column | str) -> Column:
    return 1 - F.try_divide(F.sum(F.pow(col(truth) - col(guess), 2)), F.var_pop(col(truth)) * F.count(col(truth)))


def number(c: Column | str) -> Column:
    """Coercion of text; what is no number is NULL."""
    return col(c).try_cast("double") if hasattr(Column, "try_cast") else F.expr(f"try_cast({c} as double)")


def soft_plus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def pseudo_huber(e: Column, delta: float) -> tuple[Column, Column, Column]:
    """Loss and its first two derivatives."""
    root = F.sqrt(1 + F.pow(e / delta, 2))
    return delta * delta * (root - 1), e / root, 1 / F.pow(root, 3)
