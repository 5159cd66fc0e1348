"""Gradient boosting with fairness objectives, on distributed histograms.

Features are binned once at quantiles.  A round turns the current scores into a
gradient and a hessian by column expressions; a level of a tree is one aggregate of
their sums by node, feature and bin, combined before the shuffle, and its splits
are picked on the driver from those sums, whose number is set by the depth, the
features and the bins.  Scores are carried as a column and staged every few rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiospark.operators.quantiles import quantiles
from ratiospark.sources.staging import staged, unstaged

TOL = 1e-6
#: An objective takes the rows with columns y and f and returns them with g and h.
Objective = Callable[[DataFrame], DataFrame]


def ratio_and_slope(mode: str) -> tuple[Column, Column]:
    """r and dr/df: f / max(|y|, eps) ("div") or f - y ("diff")."""
    y, f = F.col("y"), F.col("f")
    if mode == "div":
        size = F.greatest(F.abs(y), F.lit(1e-12))
        return f / size, 1 / size
    return f - y, F.lit(1.0)


def _kept_apart(g: Column, h: Column) -> tuple[Column, Column]:
    """Gradients and hessians too small to divide by become the tolerance."""
    return F.when(F.abs(g) < TOL, F.lit(TOL)).otherwise(g), F.greatest(h, F.lit(TOL))


def _with(df: DataFrame, g: Column, h: Column) -> DataFrame:
    g, h = _kept_apart(2 * (F.col("f") - F.col("y")) + g, 2 + h)
    return df.withColumns({"g": g, "h": h})


def by_row(step: Callable) -> Objective:
    """An objective of a row's y and f alone: ``step`` gives g and h from columns and from arrays."""

    def objective(df: DataFrame) -> DataFrame:
        g, h = step(F.col("y"), F.col("f"))
        return df.withColumns({"g": g, "h": F.lit(h)})

    objective.step = step
    return objective


def squared_error() -> Objective:
    """M2."""
    return by_row(lambda y, f: (2 * (f - y), 2.0))


def covariance_penalty(rho: float, mode: str = "div") -> Objective:
    """M3: + rho n c^2 / 2, c the mean of r z, z = y less its mean."""

    def objective(df: DataFrame) -> DataFrame:
        r, dr = ratio_and_slope(mode)
        n, mean, ry, rm = df.agg(F.count("*"), F.avg("y"), F.avg(r * F.col("y")), F.avg(r)).first()
        a = (F.col("y") - mean) * dr / n
        return _with(df, rho * n * (ry - mean * rm) * a, rho * n * a * a)

    return objective


def smooth_penalty(rho: float, mode: str = "div") -> Objective:
    """M4: + rho (r - t)^2 z^2, t = 1 or 0: no aggregate but the mean of y."""

    def objective(df: DataFrame) -> DataFrame:
        r, dr = ratio_and_slope(mode)
        z = F.col("y") - df.agg(F.avg("y")).first()[0]
        return _with(df, 2 * rho * (r - (1 if mode == "div" else 0)) * dr * z * z, 2 * rho * dr * dr * z * z)

    return objective


def _bin_sums(df: DataFrame, mode: str) -> tuple[DataFrame, Column, Column]:
    """Rows joined with the size and mean ratio of their target bin."""
    r, dr = ratio_and_slope(mode)
    bins = df.groupBy("target_bin").agg(F.count("*").alias("n_b"), F.avg(r).alias("m_b"))
    return df.join(F.broadcast(bins), "target_bin"), r, dr


def bin_mean_penalty(rho: float, mode: str = "div", within: float = 0.0) -> Objective:
    """M5: + rho n Var(E[r | bin]) / 2; M6 with ``within``: the spread inside bins as well."""

    def objective(df: DataFrame) -> DataFrame:
        rows, r, dr = _bin_sums(df, mode)
        n, mean = df.agg(F.count("*"), F.avg(r)).first()
        g = rho * (F.col("m_b") - mean) * dr + within * (r - F.col("m_b")) * dr
        h = rho * (1 / F.col("n_b") - 1 / n) * dr * dr + within * (1 - 1 / F.col("n_b")) * dr * dr
        return _with(rows, g, h).drop("n_b", "m_b")

    return objective


def bin_independence(rho: float, mode: str = "div", anchor: str = "global", uniform: bool = False) -> Objective:
    """+ rho n sum w_b (mu_b - anchor)^2 / 2, weights by size or uniform, anchor the mean ratio or its target."""

    def objective(df: DataFrame) -> DataFrame:
        rows, r, dr = _bin_sums(df, mode)
        n, mean, bins = df.agg(F.count("*"), F.avg(r), F.count_distinct("target_bin")).first()
        aim = mean if anchor == "global" else (1.0 if mode == "div" else 0.0)
        w = F.lit(1.0 / bins) if uniform else F.col("n_b") / n
        pull = rho * n * w * (F.col("m_b") - aim) / F.col("n_b") * dr
        bend = rho * n * w * dr * dr / F.pow(F.col("n_b"), 2)
        return _with(rows, pull, bend).drop("n_b", "m_b")

    return objective


def bin_weights(df: DataFrame, kind: str = "inv_freq", floor: float = 0.0) -> DataFrame:
    """M8: ``weight`` by target bin: n / (K n_b), n_b / n times K, or 1, at least ``floor``."""
    bins = df.groupBy("target_bin").agg(F.count("*").alias("n_b"))
    total = bins.agg(F.sum("n_b").alias("n"), F.count("*").alias("k"))
    w = {"inv_freq": F.col("n") / (F.col("k") * F.col("n_b")), "freq": F.col("k") * F.col("n_b") / F.col("n"), "none": F.lit(1.0)}[kind]
    table = bins.crossJoin(F.broadcast(total)).select("target_bin", F.greatest(w, F.lit(floor)).alias("weight"))
    return df.join(F.broadcast(table), "target_bin")


def weighted_squares(kind: str = "inv_freq", floor: float = 0.0) -> Objective:
    """M8: squared error of rows weighted by bin."""

    def objective(df: DataFrame) -> DataFrame:
        rows = bin_weights(df.drop("weight"), kind, floor)
        return rows.withColumns({"g": 2 * F.col("weight") * (F.col("f") - F.col("y")), "h": 2 * F.col("weight")}).drop("weight")

    return objective


def covariance_dispersion(rho_cov: float, rho_disp: float, mode: str = "div", one_sided: bool = False, huber: float | None = None) -> Objective:
    """M9: covariance (or only negative covariance) and dispersion around the target, squared or pseudo-Huber."""

    def objective(df: DataFrame) -> DataFrame:
        r, dr = ratio_and_slope(mode)
        n, mean, ry, rm = df.agg(F.count("*"), F.avg("y"), F.avg(r * F.col("y")), F.avg(r)).first()
        c, a = ry - mean * rm, (F.col("y") - mean) * dr / n
        on = rho_cov if not one_sided or c < 0 else 0.0
        e = r - (1 if mode == "div" else 0)
        if huber:
            root = F.sqrt(1 + F.pow(e / huber, 2))
            first, second = e / root, 1 / F.pow(root, 3)
        else:
            first, second = 2 * e, F.lit(2.0)
        return _with(df, on * n * c * a + rho_disp * first * dr, on * n * a * a + rho_disp * second * dr * dr)

    return objective


def primal_dual_weights(df: DataFrame, loss: Column, eta: float, keep: float) -> DataFrame:
    """M7, the adversary's step: ``weight`` to weight * exp(eta (loss - max)), capped at 1 / floor(keep n) and redistributed, to a sum of 1."""
    n, top = df.agg(F.count("*"), F.max(loss)).first()
    cap = 1 / max(1, int(keep * n))
    rows = staged(df.withColumn("weight", F.col("weight") * F.exp(eta * (loss - top))))
    fixed, free = 0, rows.agg(F.sum("weight")).first()[0]
    scale = 1 / free
    for _ in range(10):
        over = F.col("weight") * scale >= cap
        count, rest = rows.agg(F.sum(over.cast("long")), F.sum(F.when(~over, F.col("weight")))).first()
        if count == fixed or not rest:
            break
        fixed, scale = count, (1 - count * cap) / rest
    return rows.withColumn("weight", F.least(F.col("weight") * scale, F.lit(cap)))


def primal_dual(rho: float, keep: float, eta: float = 0.1) -> Objective:
    """M7: squared error and ratio losses under adversarial weights, which are carried in ``weight``; g and h are scaled by n times the weight."""

    def objective(df: DataFrame) -> DataFrame:
        n = df.count()
        rows = df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0 / n))
        r, dr = ratio_and_slope("div")
        rows = primal_dual_weights(rows, F.pow(F.col("f") - F.col("y"), 2) + rho * F.pow(r - 1, 2), eta, keep)
        w = n * F.col("weight")
        g = w * (2 * (F.col("f") - F.col("y")) + 2 * rho * (r - 1) * dr)
        return rows.withColumns({"g": F.when(g == 0, F.lit(TOL)).otherwise(g), "h": F.greatest(w * (2 + 2 * rho * dr * dr), F.lit(TOL))})

    return objective


@dataclass(frozen=True)
class Tree:
    """Splits (feature, last bin to the left) by node, from 1; children of n are 2n and 2n + 1; values by leaf."""

    splits: dict[int, tuple[str, int]]
    values: dict[int, float]

    def node(self, bins: dict[str, Column]) -> Column:
        def walk(n: int) -> Column:
            if n not in self.splits:
                return F.lit(n)
            feature, cut = self.splits[n]
            return F.when(bins[feature] <= cut, walk(2 * n)).otherwise(walk(2 * n + 1))

        return walk(1)

    def value(self, bins: dict[str, Column]) -> Column:
        def walk(n: int) -> Column:
            if n not in self.splits:
                return F.lit(float(self.values.get(n, 0.0)))
            feature, cut = self.splits[n]
            return F.when(bins[feature] <= cut, walk(2 * n)).otherwise(walk(2 * n + 1))

        return walk(1)


@dataclass
class Booster:
    """A fitted ensemble: base score, bin edges by feature, and trees."""

    features: tuple[str, ...]
    edges: dict[str, list[float]]
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def _bins(self) -> dict[str, Column]:
        return {c: _bin(c, self.edges[c]) for c in self.features}

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        binned = df.withColumns({f"_b_{c}": x for c, x in self._bins().items()})
        cols = {c: F.col(f"_b_{c}") for c in self.features}
        score = F.lit(self.base)
        for tree in self.trees:
            score = score + self.rate * tree.value(cols)
        return binned.withColumn(name, score).drop(*(f"_b_{c}" for c in self.features))


def _bin(c: str, edges: Sequence[float]) -> Column:
    """Number of edges below the value; NULL and NaN go to bin -1."""
    table = F.array(*(F.lit(float(e)) for e in edges)) if edges else F.array().cast("array<double>")
    value = F.col(c).cast("double")
    return F.when(value.isNull() | F.isnan(value), -1).otherwise(F.size(F.filter(table, lambda e: e < value)))


def quantile_bins(df: DataFrame, column: str, k: int) -> DataFrame:
    """Adds ``target_bin``: equal-count groups of the column."""
    edges = quantiles(df, (), {f"q{i}": (F.col(column), i / k) for i in range(1, k)})
    edges = edges.select(F.array_distinct(F.array(*edges.columns)).alias("_e"))
    return df.crossJoin(F.broadcast(edges)).withColumn("target_bin", F.size(F.filter("_e", lambda e: e < F.col(column)))).drop("_e")


def _grow(rows: DataFrame, features: Sequence[str], depth: int, l1: float, l2: float, least: int) -> Tree:
    bins = {c: F.col(f"_b_{c}") for c in features}
    splits: dict[int, tuple[str, int]] = {}
    values: dict[int, float] = {}
    live = {1}
    leaf = lambda g, h: -(max(abs(g) - l1, 0.0) * (1 if g > 0 else -1)) / (h + l2)
    score = lambda g, h: max(abs(g) - l1, 0.0) ** 2 / (h + l2)
    for level in range(max(1, depth)):
        placed = rows.withColumn("_node", Tree(splits, {}).node(bins)).where(F.col("_node").isin(*live)) if splits else rows.withColumn("_node", F.lit(1))
        pairs = ", ".join(f"'{c}', _b_{c}" for c in features)
        long = placed.select("_node", "g", "h", F.expr(f"stack({len(features)}, {pairs}) as (feature, bin)"))
        sums: dict[int, dict[str, list[tuple]]] = {}
        for r in long.groupBy("_node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect():
            sums.setdefault(r[0], {}).setdefault(r.feature, []).append((r.bin, r.g, r.h, r.n))
        grown = set()
        for node, by_feature in sums.items():
            first = by_feature[features[0]]
            g, h, n = (sum(x[k] for x in first) for k in (1, 2, 3))
            values[node] = leaf(g, h)
            best = (1e-9, None, None)
            if level < depth:
                for feature in features:
                    gl = hl = nl = 0
                    for b, bg, bh, bn in sorted(by_feature[feature])[:-1]:
                        gl, hl, nl = gl + bg, hl + bh, nl + bn
                        if nl >= least and n - nl >= least and (gain := score(gl, hl) + score(g - gl, h - hl) - score(g, h)) > best[0]:
                            best = (gain, (feature, b), (gl, hl))
            if best[1]:
                splits[node] = best[1]
                grown |= {2 * node, 2 * node + 1}
                # The children's sums are known from the split; the last level needs no pass of its own.
                gl, hl = best[2]
                values |= {2 * node: leaf(gl, hl), 2 * node + 1: leaf(g - gl, h - hl)}
        live = grown
        if not live:
            break
    return Tree(splits, {n: v for n, v in values.items() if n not in splits})


def boost(df: DataFrame, features: Sequence[str], y: str, objective: Objective, rounds: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32, l1: float = 1e-3, l2: float = 1e-2, least: int = 30, target_bins: int = 10, stage_every: int = 5, hook: Callable[[int, DataFrame], None] | None = None) -> Booster:
    """Fits a booster; scores start at the mean of y.  ``hook`` sees each round's rows (D3)."""
    probs = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    row = df.agg(F.avg(y).alias("_y"), *(F.array_distinct(F.percentile_approx(F.col(c).cast("double"), probs, 10_000)).alias(c) for c in features)).first()
    model = Booster(tuple(features), {c: sorted(row[c] or []) for c in features}, float(row["_y"]), rate)
    rows = df.withColumns({f"_b_{c}": x for c, x in model._bins().items()}).select(*(f"_b_{c}" for c in features), F.col(y).cast("double").alias("y")).withColumn("f", F.lit(model.base))
    rows = last = staged(quantile_bins(rows, "y", target_bins))
    cols = {c: F.col(f"_b_{c}") for c in features}
    for k in range(rounds):
        scored = objective(rows)
        tree = _grow(scored, features, depth, l1, l2, least)
        model.trees.append(tree)
        rows = scored.drop("g", "h").withColumn("f", F.col("f") + rate * tree.value(cols))
        if k % stage_every == stage_every - 1:
            old, rows = last, staged(rows)
            last = rows
            unstaged(old)
        if hook:
            hook(k, rows)
    return model


def bin_mean_on_row(df: DataFrame, value: str, bin_col: str) -> DataFrame:
    """The mean of a value over its bin, on each row."""
    return df.withColumn("bin_mean", F.avg(value).over(Window.partitionBy(bin_col)))
