"""Quality scores: random-indexing word vectors, pooled, into a small calibrated network.

Every word has a fixed sparse index vector of a few +1 and -1.  A word's vector is
the sum of the index vectors of its neighbours, over all texts; words share
``buckets`` hashed rows, so the table has a fixed size however many words there
are (with 16,384 rows and a vocabulary of V words, a word shares its row with V /
16,384 others on average, mostly rare ones, which hardly move its sum).  The sums
are whole numbers, exact in any order of merging.  A document is the mean and spread of its words' vectors and four shape
measures.  A two-layer network in numpy, fitted on a bounded sample of labelled
rows, gives a logit; a temperature fitted on labelled rows kept out of that turns
it into a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratiospark.llm.workspace import Workspace


@dataclass(frozen=True)
class ModelPlan:
    """``sample``: most labelled rows that the network is fitted on; a fifth of them sets the temperature."""

    buckets: int = 1 << 14
    dims: int = 64
    nonzero: int = 4
    window: int = 2
    sample: int = 20_000
    hidden: int = 32
    epochs: int = 40
    rate: float = 3e-3
    decay: float = 1e-4
    seed: int = 7


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\s]+")


def word_rows(text: str | None, plan: ModelPlan) -> np.ndarray:
    """Row of each word of a text; runs of letters and digits, and runs of other signs."""
    words = _WORD.findall(text.lower().encode()) if text else []
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)) % np.uint64(plan.buckets)).astype(np.int64)


def index_vectors(plan: ModelPlan) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's index vector."""
    rng = np.random.default_rng(plan.seed)
    return rng.integers(0, plan.dims, (plan.buckets, plan.nonzero)), rng.choice(np.array([-1.0, 1.0]), (plan.buckets, plan.nonzero))


def word_vectors(docs: DataFrame, plan: ModelPlan) -> np.ndarray:
    """The words' vectors, buckets x dims, each of length 1 or 0, from all texts; the sums are made on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(plan)
        total = np.zeros(plan.buckets * plan.dims)

        def add(rows: np.ndarray, ends: np.ndarray) -> None:
            for k in range(1, plan.window + 1):
                one, two = rows[:-k], rows[k:]
                inside = ends[:-k] == ends[k:]
                one, two = one[inside], two[inside]
                for a, b in ((one, two), (two, one)):
                    for j in range(plan.nonzero):
                        total[:] += np.bincount(a * plan.dims + place[b, j], sign[b, j], minlength=len(total))

        def rows() -> Iterator[pa.RecordBatch]:
            table = total.reshape(plan.buckets, plan.dims).astype(np.int32)
            used = np.flatnonzero(table.any(axis=1))
            for at in range(0, len(used), 4096):
                part = used[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([table[r].tobytes() for r in part], pa.binary())], names=["bucket", "vector"])
            total[:] = 0

        held: list[np.ndarray] = []
        words = seen = 0
        for batch in batches:
            for text in batch.column(0):
                held.append(word_rows(text.as_py(), plan))
                words += len(held[-1])
                if words > 500_000 or len(held) >= 2000:
                    add(np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held]))
                    held, words, seen = [], 0, seen + words
                    if seen > 1 << 27:  # far from 2^31 in any entry
                        yield from rows()
                        seen = 0
        if held:
            add(np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held]))
        yield from rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket not in sums:
                    sums[bucket] = np.zeros(plan.dims, dtype=np.int64)
                sums[bucket] += np.frombuffer(vector, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["bucket", "vector"])

    parts = docs.select("text").mapInArrow(count, "bucket int, vector binary")
    table = np.zeros((plan.buckets, plan.dims))
    # A merging task gets one vector a bucket and input task: as many tasks as keep that about even.
    tasks = min(plan.buckets, max(32, docs.rdd.getNumPartitions() // 4))
    for bucket, vector in parts.repartition(tasks, "bucket").mapInArrow(merge, "bucket int, vector binary").collect():
        table[bucket] = np.frombuffer(vector, dtype=np.int64)
    table -= np.outer(np.abs(table).sum(axis=1), table.sum(axis=0) / max(1.0, float(np.abs(table).sum())))
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, norm, out=np.zeros_like(table), where=norm > 0).astype(np.float32)


def features(text: str | None, vectors: np.ndarray, plan: ModelPlan) -> np.ndarray:
    """Mean and spread of the words' vectors; length, variety, immediate repeats and capitals."""
    rows = word_rows(text, plan)
    out = np.zeros(2 * plan.dims + 4, dtype=np.float32)
    if not len(rows):
        return out
    different, times = np.unique(rows, return_counts=True)
    picked = vectors[different]
    share = (times / len(rows)).astype(np.float32)
    mean = share @ picked
    out[: plan.dims] = mean
    out[plan.dims : 2 * plan.dims] = np.sqrt(np.maximum(0, share @ (picked * picked) - mean * mean))
    letters = np.frombuffer(text.encode(), dtype=np.uint8)
    capitals = np.count_nonzero((letters >= 65) & (letters <= 90)) / len(letters)
    out[2 * plan.dims :] = np.log1p(len(rows)), len(different) / len(rows), np.mean(rows[1:] == rows[:-1]) if len(rows) > 1 else 0, capitals
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer of tanh, one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, plan: ModelPlan) -> Network:
    """Adam on the log loss of four fifths of the rows, then the temperature of least log loss on the rest."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    aside = np.arange(len(y)) % 5 == 4
    known, labels = x[~aside], y[~aside]
    net = Network(known.mean(axis=0), known.std(axis=0) + 1e-6, [])
    rng = np.random.default_rng(plan.seed)
    net.weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], plan.hidden)), np.zeros(plan.hidden), rng.normal(0, plan.hidden**-0.5, plan.hidden), np.zeros(1)]
    z = (known - net.mean) / net.scale
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    turn = 0
    for _ in range(plan.epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            a, b = z[order[at : at + 256]], labels[order[at : at + 256]]
            w1, b1, w2, b2 = net.weights
            h = np.tanh(a @ w1 + b1)
            g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -40, 40))) - b) / len(b)
            back = np.outer(g, w2) * (1 - h * h)
            grads = [a.T @ back + plan.decay * w1, back.sum(axis=0), h.T @ g + plan.decay * w2, np.array([g.sum()])]
            turn += 1
            for w, d, m, v in zip(net.weights, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w -= plan.rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    if aside.any():
        logits, truth = net.logits(x[aside]), 2 * y[aside] - 1
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        net.temperature = float(grid[np.argmin([np.logaddexp(0, -truth * logits / t).mean() for t in grid])])
    return net


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, plan: ModelPlan = ModelPlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts score as texts without words.  Labels with a null are
    not learned from; a document labelled both ways counts as 0.  If fewer than
    two classes are labelled, every score is the share of label 1, or 0.5 without
    labels.  Repeated rows score alike; rows with null ids are scored.  A score of
    0.5 itself predicts 1.  Other columns are not read.
    """
    work = Workspace(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, plan))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py(), vectors.value, plan).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "x"])

    described = work.save(docs.mapInArrow(describe, "doc_id long, x binary"))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y")).where(~held_out())
    chosen = known.withColumn("o", F.xxhash64("doc_id", F.lit(plan.seed))).orderBy("o", "doc_id").limit(plan.sample)
    rows = described.join(F.broadcast(chosen), "doc_id").select("o", "doc_id", "y", "x").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: (r.o, r.doc_id))
    y = np.array([r.y for r in rows], dtype=np.float64)
    if len(rows) and 0 < y.mean() < 1:
        net = fit(np.stack([np.frombuffer(r.x, dtype=np.float32) for r in rows]), y, plan)
    else:
        prior = float(y.mean()) if len(rows) else 0.5
        net = lambda x: np.full(len(x), prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net(x.astype(np.float64)), pa.float64())], names=["doc_id", "score"])

    scored = described.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
