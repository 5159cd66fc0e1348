"""Leaf-wise gradient boosting on distributed histograms, with numbers and categories (M2-M10 as configured).

Features are cut into at most 255 bins once and kept as one byte each.  A tree grows
best first: of all leaves, the one whose split gains most is split next, until the
plan's leaves are reached.  A split depends on its leaf's sums only, so a pass over the
rows serves all leaves that the queue could still come to: it counts the smaller child
of each, and the larger one follows from its parent by subtraction.  The tree is the
same as with one pass a split, in about as many passes as it is deep.

Tasks add up flat arrays of gradient, hessian and count by node, feature and bin; Spark
merges them by node, and the driver sees sums whose number depends on leaves, features
and bins only.  Numbers are split at a bin, with missing values on the side that gains
more; categories are put in order of gradient over hessian and split as sets.

A pass is a Spark job, so passes read rows in large chunks that the executors keep, as
an RDD: its jobs start in about half the time of a table's, and 200 trees are thousands.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiospark.operators.boosting import Objective, quantile_bins
from ratiospark.sources.staging import staged, unstaged

#: Bins of a feature, the missing ones (numbers) or all other categories in bin 0.
BINS = 256
#: Bytes of partial sums up to which tasks send theirs to the driver at once, without a merging stage.
DIRECT = 32 << 20
#: Rows packed together, or a few more.
CHUNK = 30_000
#: Rounds whose scores are made from the round before; then from those last written, so that a lost executor costs few steps.
CHAIN = 10

#: Where the executors keep chunks: in memory as they are, or on their local disks.
KEPT = StorageLevel.MEMORY_AND_DISK_DESER

#: Packed rows: bins by feature, then numbers by row, equal ones as one.
Chunk = tuple


@dataclass(frozen=True)
class TreePlan:
    """``least`` rows in a leaf; a split must gain more than ``min_gain``.

    Category splits: ``cat_smooth`` is added to hessians for the order only,
    ``cat_l2`` to the penalty; at most ``cat_set`` categories on one side; those
    with under ``cat_least`` rows in the leaf stay with the rest.
    """

    rounds: int = 200
    leaves: int = 31
    depth: int = 15
    rate: float = 0.1
    bins: int = 255
    least: int = 30
    min_gain: float = 0.0
    l1: float = 1e-3
    l2: float = 1e-2
    cat_smooth: float = 10.0
    cat_l2: float = 10.0
    cat_set: int = 32
    cat_least: int = 100
    share: float = 1.0
    seed: int = 2025


@dataclass(frozen=True)
class Split:
    """Bins of a feature that go left; ``gain`` and the left side's sums (gradient, hessian, rows)."""

    gain: float
    feature: int
    left: tuple[int, ...]
    sums: tuple[float, float, float]


@dataclass
class Grown:
    """A tree as arrays over its nodes: feature (-1 for a leaf), children, bins that go left, value."""

    feature: list[int]
    low: list[int]
    high: list[int]
    left: list[tuple[int, ...]]
    value: list[float]

    def places(self, bins: np.ndarray, wanted: Sequence[int] | None = None) -> Iterator[tuple[int, np.ndarray | slice]]:
        """The leaves and the places of their rows, from bins by (feature, row); with ``wanted`` leaves, only those."""
        table = np.zeros((len(self.feature), BINS), dtype=bool)
        for k, some in enumerate(self.left):
            table[k, list(some)] = True
        leads = np.ones(len(self.feature), dtype=bool) if wanted is None else np.isin(np.arange(len(self.feature)), wanted)
        for k in reversed(range(len(self.feature))):  # children come after their parents
            if self.feature[k] >= 0:
                leads[k] = leads[self.low[k]] | leads[self.high[k]]
        under: list[tuple[int, np.ndarray | slice]] = [(0, slice(None))] if leads[0] else []
        while under:
            node, at = under.pop()
            if self.feature[node] < 0:
                yield node, at
                continue
            left = table[node].take(bins[self.feature[node]][at], mode="clip")
            for child, side in ((self.low[node], left), (self.high[node], ~left)):
                if leads[child]:
                    some = np.flatnonzero(side) if isinstance(at, slice) else at.compress(side)
                    if len(some):
                        under.append((child, some))

    def router(self, wanted: Sequence[int] | None = None) -> Callable[[np.ndarray], np.ndarray]:
        """What gives the leaf of each row, from its bins by feature; with ``wanted`` leaves, rows of others are left at the root."""

        def nodes(bins: np.ndarray) -> np.ndarray:
            out = np.zeros(len(bins), dtype=np.int64)
            for node, at in self.places(np.ascontiguousarray(bins.T), wanted):
                out[at] = node
            return out

        return nodes

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row, from its bins by feature."""
        return self.router()(bins)


def _raised(f: np.ndarray, bins: np.ndarray, trees: Sequence[Grown], rate: float) -> np.ndarray:
    """Scores with the trees' steps added, from bins by (feature, row)."""
    f = f.copy()
    for tree in trees:
        for node, at in tree.places(bins):
            f[at] += rate * tree.value[node]
    return f


def _leaf(g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    return -np.sign(g) * np.maximum(np.abs(g) - l1, 0) / (h + l2)


def _score(g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    return np.maximum(np.abs(g) - l1, 0) ** 2 / np.maximum(h + l2, 1e-12)


def best_split(sums: np.ndarray, categorical: Sequence[bool], plan: TreePlan, allowed: Sequence[int] | None = None) -> Split | None:
    """The split of a leaf that gains most, from its sums by (feature, bin, [gradient, hessian, rows]); the first feature of equal ones."""
    best = None
    g, h, n = sums[0].sum(axis=0)
    for k in range(len(sums)) if allowed is None else allowed:
        own, options = sums[k], []
        if categorical[k]:
            held = np.flatnonzero(own[:, 2] >= max(1, plan.cat_least))
            order = held[np.argsort(own[held, 0] / (own[held, 1] + plan.cat_smooth), kind="stable")]
            for way in (order, order[::-1]):
                options.append((way[: plan.cat_set], plan.l2 + plan.cat_l2, np.empty(0, dtype=np.int64)))
        else:
            held = 1 + np.flatnonzero(own[1:, 2])
            options.append((held, plan.l2, np.empty(0, dtype=np.int64)))
            if own[0, 2]:
                options.append((held, plan.l2, np.zeros(1, dtype=np.int64)))
        for order, l2, first in options:
            if not len(order):
                continue
            left = np.cumsum(own[order], axis=0) + own[first].sum(axis=0)
            right = np.array([g, h, n]) - left
            gain = _score(left[:, 0], left[:, 1], plan.l1, l2) + _score(right[:, 0], right[:, 1], plan.l1, l2) - _score(g, h, plan.l1, l2)
            gain = np.where((left[:, 2] >= plan.least) & (right[:, 2] >= plan.least), gain, -np.inf)
            at = int(gain.argmax())
            if gain[at] > max(plan.min_gain, 1e-9) and (best is None or gain[at] > best.gain * (1 + 1e-12)):
                best = Split(float(gain[at]), k, tuple(sorted(int(b) for b in [*first, *order[: at + 1]])), tuple(left[at].tolist()))
    return best


def _packed(rows: DataFrame, features: int) -> RDD[Chunk]:
    """Rows with ``bins`` and two numbers, many of them in one: passes read it many times, and as whole arrays."""

    def join(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        bins, *numbers = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
        numbers = [x[:1] if (x == x[0]).all() else x for x in numbers]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, *numbers)], names=["bins", "first", "second"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            bins = _matrix(batch.column(0), features)
            if len(bins):
                held.append([bins.T, *(batch.column(k).to_numpy() for k in (1, 2))])
                size += len(bins)
            if size >= CHUNK:
                yield join(held)
                held, size = [], 0
        if held:
            yield join(held)

    return rows.mapInArrow(run, "bins binary, first binary, second binary").rdd.map(tuple)


def _arrays(chunk: Chunk, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's bins by (feature, row) and its numbers, those that are equal as an array of one."""
    return np.frombuffer(chunk[0], dtype=np.uint8).reshape(features, -1), np.frombuffer(chunk[1]), np.frombuffer(chunk[2])


def _histograms(packed: RDD[Chunk], features: int, tree: Grown, wanted: Sequence[int], tasks: int) -> dict[int, np.ndarray]:
    """Sums by (feature, bin, [gradient, hessian, rows]) of the rows in each wanted node."""

    def count(chunks: Iterable[Chunk]) -> Iterator[tuple[int, np.ndarray]]:
        out = {}
        for chunk in chunks:
            bins, *steps = _arrays(chunk, features)
            for node, at in tree.places(bins, wanted):
                own = out.setdefault(node, np.zeros((3, features, BINS)))
                weights = [x if len(x) == 1 else x[at] for x in steps]
                for k in range(features):
                    bin_ = bins[k][at]
                    rows = np.bincount(bin_, minlength=BINS)
                    for j, w in enumerate(weights):
                        own[j, k] += rows * w if len(w) == 1 else np.bincount(bin_, w, BINS)
                    own[2, k] += rows
        yield from out.items()

    parts = packed.mapPartitions(count)
    if tasks * len(wanted) * features * BINS * 3 * 8 > DIRECT:
        parts = parts.reduceByKey(np.add)
    found = {node: np.zeros((3, features, BINS)) for node in wanted}
    for node, part in parts.collect():
        found[node] += part
    return {node: np.moveaxis(x, 0, 2) for node, x in found.items()}


def grow(rows: DataFrame, categorical: Sequence[bool], plan: TreePlan, tasks: int, allowed: Sequence[int] | None = None) -> Grown:
    """A tree for rows with ``bins``, ``g`` and ``h``, best leaf first."""
    # All passes of the tree read what the first one makes: kept by the executors while it grows, and made anew where one is lost.
    return _grown(_packed(rows.select("bins", "g", "h"), len(categorical)), categorical, plan, tasks, allowed)


def _grown(packed: RDD[Chunk], categorical: Sequence[bool], plan: TreePlan, tasks: int, allowed: Sequence[int] | None, replaced: RDD[Chunk] | None = None) -> Grown:
    """``grow`` on chunks; those ``replaced`` are let go as soon as all of ``packed`` are made."""
    packed.persist(KEPT)
    try:
        root = Grown([-1], [-1], [-1], [()], [0.0])
        sums = _histograms(packed, len(categorical), root, [0], tasks)
        if replaced:
            replaced.unpersist()
        return _best_first(packed, root, sums, categorical, plan, tasks, allowed)
    finally:
        packed.unpersist()


def _best_first(packed: RDD[Chunk], tree: Grown, sums: dict[int, np.ndarray], categorical: Sequence[bool], plan: TreePlan, tasks: int, allowed: Sequence[int] | None) -> Grown:
    features = len(categorical)
    depth, splits, totals = {0: 0}, {0: best_split(sums[0], categorical, plan, allowed)}, {0: tuple(sums[0][0].sum(axis=0).tolist())}
    children: dict[int, tuple[int, int]] = {}  # of all nodes whose children have been counted
    reach = {0: splits[0].gain if splits[0] else 0.0}  # the least gain on the way to a node, its own included

    def chosen() -> tuple[list[int], list[int]]:
        """The nodes that the queue splits as far as their gains are known, and those it could still split whose children are not counted.

        A node's turn comes with the least gain on its way from the root: all nodes
        with more come first.  So only the first ``leaves - 1`` in that order count.
        """
        turn = sorted((n for n in reach if splits[n] and depth[n] < plan.depth), key=lambda n: (-reach[n], n))[: plan.leaves - 1]
        return turn, [n for n in turn if n not in children]

    while True:
        done, waiting = chosen()
        if not waiting:
            break
        smaller = {}
        for node in waiting:
            split = splits[node]
            low, high = len(tree.feature), len(tree.feature) + 1
            for side in (split.sums, tuple(np.subtract(totals[node], split.sums))):
                depth[len(tree.feature)], totals[len(tree.feature)] = depth[node] + 1, side
                for column, value in ((tree.feature, -1), (tree.low, -1), (tree.high, -1), (tree.left, ()), (tree.value, 0.0)):
                    column.append(value)
            tree.feature[node], tree.low[node], tree.high[node], tree.left[node] = split.feature, low, high, split.left
            children[node] = (low, high)
            smaller[node] = low if totals[low][2] <= totals[high][2] else high
        # Children that can't be split any more need no sums of their own.
        live = [n for n in waiting if depth[n] + 1 < plan.depth and max(totals[c][2] for c in children[n]) >= 2 * plan.least]
        counted = _histograms(packed, features, tree, [smaller[n] for n in live], tasks) if live else {}
        for node in waiting:
            low, high = children[node]
            if node in live:
                sums[smaller[node]] = counted[smaller[node]]
                sums[high if smaller[node] == low else low] = sums[node] - counted[smaller[node]]
            del sums[node]
            for child in (low, high):
                splits[child] = best_split(sums[child], categorical, plan, allowed) if child in sums and depth[child] < plan.depth else None
                reach[child] = min(reach[node], splits[child].gain) if splits[child] else 0.0
    # Nodes that were counted ahead but not reached are leaves again.
    reached = set(done)
    for node in children:
        if node not in reached:
            tree.feature[node], tree.left[node] = -1, ()
    cat = {child for node in reached for child in children[node] if categorical[tree.feature[node]]}
    for node, (g, h, _) in totals.items():
        tree.value[node] = float(_leaf(g, h, plan.l1, plan.l2 + (plan.cat_l2 if node in cat else 0)))
    return _pruned(tree)


def _pruned(tree: Grown) -> Grown:
    """The tree without nodes that its root doesn't lead to."""
    order, out = [0], Grown([], [], [], [], [])
    for node in order:
        if tree.feature[node] >= 0:
            order += [tree.low[node], tree.high[node]]
    new = {node: k for k, node in enumerate(order)}
    for node in order:
        split = tree.feature[node] >= 0
        out.feature.append(tree.feature[node])
        out.low.append(new[tree.low[node]] if split else -1)
        out.high.append(new[tree.high[node]] if split else -1)
        out.left.append(tree.left[node])
        out.value.append(tree.value[node])
    return out


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    """Bins as (rows, features), from one binary value a row."""
    joined = column.cast(pa.large_binary())
    if joined.null_count or not len(joined):
        return np.zeros((0, features), dtype=np.uint8)
    start, end = (np.frombuffer(joined.buffers()[1], dtype=np.int64)[k] for k in (joined.offset, joined.offset + len(joined)))
    return np.frombuffer(joined.buffers()[2], dtype=np.uint8)[start:end].reshape(len(joined), features)


@dataclass
class LeafwiseBooster:
    """A fitted ensemble: bin edges of numbers, bins of categories, base score and trees."""

    features: tuple[str, ...]
    edges: dict[str, list[float]]
    categories: dict[str, list[str]]
    base: float
    rate: float
    trees: list[Grown] = field(default_factory=list)

    @property
    def categorical(self) -> list[bool]:
        return [c in self.categories for c in self.features]

    def bins_of(self, columns: Sequence[pa.Array]) -> np.ndarray:
        """Bins by (row, feature).  Numbers: 0 for null and NaN, else 1 and the edges below; categories: their place, 0 for others and null."""
        out = np.zeros((len(columns[0]), len(self.features)), dtype=np.uint8)
        for k, (c, column) in enumerate(zip(self.features, columns, strict=True)):
            if c in self.categories:
                coded = column.cast(pa.string()).dictionary_encode()
                place = {v: i + 1 for i, v in enumerate(self.categories[c])}
                table = np.array([place.get(v, 0) for v in coded.dictionary.to_pylist()] + [0], dtype=np.uint8)
                out[:, k] = table[coded.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]
            else:
                value = column.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
                out[:, k] = np.where(np.isnan(value), 0, 1 + np.searchsorted(self.edges[c], value, side="left"))
        return out

    def score(self, bins: np.ndarray) -> np.ndarray:
        return _raised(np.full(len(bins), self.base), np.ascontiguousarray(bins.T), self.trees, self.rate)

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with its scores, by Arrow batches."""
        model = self

        @F.pandas_udf("double")
        def scored(*columns: pd.Series) -> pd.Series:
            return pd.Series(model.score(model.bins_of([pa.array(c, from_pandas=True) for c in columns])))

        return df.withColumn(name, scored(*(F.col(c).cast("string" if c in self.categories else "double") for c in self.features)))

    def importance(self) -> dict[str, int]:
        """Splits by feature."""
        used = [f for tree in self.trees for f in tree.feature if f >= 0]
        return {c: used.count(k) for k, c in enumerate(self.features)}

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model as a table of trees; ``load`` in any session gives an equal one."""
        head = {"features": self.features, "edges": self.edges, "categories": self.categories, "base": self.base, "rate": self.rate}
        rows = [(-1, json.dumps(head)), *((k, json.dumps(asdict(t))) for k, t in enumerate(self.trees))]
        spark.createDataFrame(rows, "tree long, content string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LeafwiseBooster:
        head, *trees = (json.loads(r.content) for r in spark.read.parquet(path).orderBy("tree").collect())
        made = [Grown(**{**t, "left": [tuple(x) for x in t["left"]]}) for t in trees]
        return LeafwiseBooster(tuple(head["features"]), head["edges"], head["categories"], head["base"], head["rate"], made)


def prepared(df: DataFrame, features: Sequence[str], categorical: Sequence[str], y: str, plan: TreePlan) -> LeafwiseBooster:
    """A booster without trees: edges at approximate quantiles, the commonest categories, the mean of y."""
    numbers = [c for c in features if c not in categorical]
    probs = F.array(*(F.lit(k / (plan.bins - 1)) for k in range(1, plan.bins - 1)))
    edges = [F.array_sort(F.array_distinct(F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), probs, 10_000))).alias(c) for c in numbers]
    row = df.agg(F.avg(y).alias("_y"), *edges).first()
    named = {}
    for c in features:
        if c in categorical:
            counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
            named[c] = [r.v for r in counts.orderBy(F.desc("n"), "v").limit(plan.bins).collect()]
    return LeafwiseBooster(tuple(features), {c: list(row[c] or []) for c in numbers}, named, float(row["_y"] or 0.0), plan.rate)


def boost_leafwise(df: DataFrame, features: Sequence[str], y: str, objective: Objective, plan: TreePlan = TreePlan(), categorical: Sequence[str] = (), target_bins: int = 0, stage_every: int = 5, hook: Callable[[int, DataFrame], None] | None = None) -> LeafwiseBooster:
    """Fits a booster; scores start at the mean of y.

    ``target_bins`` adds groups of y for objectives by bin; ``hook`` sees the rows
    after each round (D3).  Rows are picked and binned once.  Objectives of a row's
    y and f alone (with a ``step``) are computed in chunks whose scores the executors
    keep from round to round; scores are written after ``stage_every`` rounds, twice
    as many, and so on.  For others a round makes its scores from those last written
    and the trees since, and writes them every ``stage_every`` rounds, or always for
    objectives that carry columns of their own.
    """
    names = list(features)
    picked = staged(df.select(F.col(y).cast("double").alias("_y"), *(F.col(c).cast("string" if c in categorical else "double").alias(c) for c in names)))
    model = prepared(picked, features, categorical, "_y", plan)
    flags = model.categorical

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.ascontiguousarray(model.bins_of(batch.columns[1:]))
            packed = pa.Array.from_buffers(pa.binary(len(names)), len(bins), [None, pa.py_buffer(bins)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([packed, batch.column(0), pa.array(np.full(len(bins), model.base))], names=["bins", "y", "f"])

    rows = staged(picked.mapInArrow(cut, "bins binary, y double, f double"))
    unstaged(picked)
    if target_bins:
        binned, rows = rows, staged(quantile_bins(rows, "y", target_bins))
        unstaged(binned)
    plain, last, since = set(rows.columns), rows, []
    rng, tasks, step = np.random.default_rng(plan.seed), rows.rdd.getNumPartitions(), getattr(objective, "step", None)
    kept, links, due = None, 0, stage_every
    try:
        for k in range(plan.rounds):
            allowed = sorted(rng.choice(len(names), max(1, round(plan.share * len(names))), replace=False).tolist()) if plan.share < 1 else None
            if step:
                links = (links + 1) % CHAIN if since else 0
                before, kept = kept, _scored(kept, since[-1:], plan.rate, len(names)) if links else _scored(_packed(last.select("bins", "y", "f"), len(names)), since, plan.rate, len(names))
                tree = _grown(_stepped(kept.persist(KEPT), step), flags, plan, tasks, allowed, replaced=before)
                stepped = rows
            else:
                scored = objective(rows)
                tree = grow(scored, flags, plan, tasks, allowed)
                stepped = scored.drop("g", "h")
            model.trees.append(tree)
            since.append(tree)
            own = set(stepped.columns) != plain
            rows = _moved(stepped, [tree], plan.rate, len(names)) if own else _moved(last, since, plan.rate, len(names))
            if own or k + 1 == due:
                old, rows, since = last, staged(rows), []
                last, due = rows, due * 2 if step else due + stage_every
                unstaged(old)
            if hook:
                hook(k, rows)
    finally:
        if kept:
            kept.unpersist()
    unstaged(last)
    return model


def _scored(packed: RDD[Chunk], trees: Sequence[Grown], rate: float, features: int) -> RDD[Chunk]:
    """Chunks of bins, y and f with the trees' steps added to f."""
    trees = list(trees)

    def run(chunk: Chunk) -> Chunk:
        bins, _, f = _arrays(chunk, features)
        return chunk[0], chunk[1], _raised(np.broadcast_to(f, bins.shape[1]) if len(f) == 1 else f, bins, trees, rate).tobytes()

    return packed.map(run) if trees else packed


def _stepped(packed: RDD[Chunk], step: Callable) -> RDD[Chunk]:
    """Chunks of bins, y and f as bins, gradient and hessian."""

    def run(chunk: Chunk) -> Chunk:
        g, h = step(np.frombuffer(chunk[1]), np.frombuffer(chunk[2]))
        return chunk[0], np.atleast_1d(g).tobytes(), np.atleast_1d(h).tobytes()

    return packed.map(run)


def _moved(rows: DataFrame, trees: Sequence[Grown], rate: float, features: int) -> DataFrame:
    """Rows with the trees' steps added to ``f``."""
    at, trees = rows.columns.index("f"), list(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.columns
            bins = np.ascontiguousarray(_matrix(batch.column("bins"), features).T)
            cols[at] = pa.array(_raised(cols[at].to_numpy(), bins, trees, rate))
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
