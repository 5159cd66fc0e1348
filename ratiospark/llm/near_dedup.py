"""Near-duplicate groups by MinHash with tensored banding and verified links.

A table key of ordinary banding takes k minhashes, and L tables take L * k of
them.  Tensoring makes two collections of m half-keys, of k / 2 minhashes each,
and forms the m * m table keys as pairs of one half from each, so m * k minhashes
serve m * m tables.  With ``halves`` 16 and ``rows`` 3, two sets of similarity
0.75 share a table key with probability above 0.999, at 0.8 above 0.9999.

A pair collides in a table only if it collides in both halves, so halves that no
other set has are dropped before pairs of halves are formed; documents without
copies mostly end there.  Equal sets are one class from the start.  In a bucket,
members are compared with one pivot, the least id; links are confirmed on the full
sets, and connected components follow.  What a bucket's members need beyond that
is decided by the components: if all are in one, no further link matters.
Otherwise the member with the most collisions is the next pivot (the source of a
group of copies is closer to each of them than they are to each other), and then
members of different components are joined, where these are few for the bucket's
size; documents of other buckets are compared block by block.  These last pairs are
screened by sketches of ``bits`` one-bit minhashes before they are emitted: at 2048
bits, a pair at 0.75 fails the screen with probability below 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratiospark.llm.workspace import Workspace


@dataclass(frozen=True)
class DedupPlan:
    """``percent``: least similarity of a link.  ``linear``: pairs a member in the round of all pairs.  ``screen``: least estimate, in percent.

    ``block`` documents of a cluster are held in one row, ``tile`` blocks a side are compared in one task.
    """

    words: int = 5
    percent: int = 75
    halves: int = 16
    rows: int = 3
    linear: int = 24
    bits: int = 2048
    block: int = 256
    tile: int = 8
    screen: int = 68


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words; of all its words if there are fewer."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    out = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - size + 1 + k]
    return np.unique(_mix(out))


class Sketcher:
    """Half-keys of sets: 2 * halves values, each from ``rows`` minhashes."""

    def __init__(self, plan: DedupPlan):
        self.plan = plan
        seeds = _mix(np.arange(1, 4 * plan.halves * plan.rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.a, self.b = (seeds[0::2] | np.uint64(1))[:, None], seeds[1::2][:, None]
        self.place = _mix(np.arange(1, 2 * plan.halves + 1, dtype=np.uint64))

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 4096):
            low = np.minimum(low, (self.a * shingles[None, at : at + 4096] + self.b).min(axis=1))
        low = low.reshape(2 * self.plan.halves, self.plan.rows)
        out = self.place.copy()
        for k in range(self.plan.rows):
            out = _mix(out ^ low[:, k])
        return out.view(np.int64)


def bit_sketches(docs: DataFrame, plan: DedupPlan) -> DataFrame:
    """(doc_id, label, n, bits): the lowest bits of ``plan.bits`` minhashes, 64 a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _mix(np.arange(1, 2 * plan.bits + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        a, b = (seeds[0::2] | np.uint64(1))[:, None], seeds[1::2][:, None]
        for batch in batches:
            n, bits = [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), plan.words)
                low = np.full(plan.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(shingles), 512):
                    low = np.minimum(low, (a * shingles[None, at : at + 512] + b).min(axis=1))
                n.append(len(shingles))
                bits.append(np.packbits((_mix(low) & np.uint64(1)).astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "label", "n", "bits"])

    return docs.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label long, n long, bits array<long>")


def _close(plan: DedupPlan) -> str:
    """Condition on two sides (a, b) of a join: other components, sizes that allow a link, and sketches that do."""
    differ = " + ".join(f"bit_count(bits_a[{k}] ^ bits_b[{k}])" for k in range(plan.bits // 64))
    most = plan.bits * (100 - plan.screen) // 200
    return f"label_a <> label_b AND 100 * least(n_a, n_b) >= {plan.percent} * greatest(n_a, n_b) AND {differ} <= {most}"


def _sides(rows: DataFrame, key: str) -> list[DataFrame]:
    return [rows.select(key, *(F.col(c).alias(f"{c}_{side}") for c in rows.columns if c != key)) for side in "ab"]


def sketches(docs: DataFrame, plan: DedupPlan) -> DataFrame:
    """(doc_id, n_shingles, print, halves): ``print`` identifies the set, null for the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(plan)
        for batch in batches:
            sets = (shingle_set(t.as_py(), plan.words) for t in batch.column(1))
            rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), sketch(s)) if len(s) else (0, None, []) for s in sets]
            n, prints, halves = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(halves, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "halves"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, print binary, halves array<long>")


def _similar(pairs: DataFrame, texts: DataFrame, plan: DedupPlan) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            a, b, text_b, text_a = (batch.column(k) for k in range(4))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                if (one := a[k].as_py()) != last:
                    last, kept = one, shingle_set(text_a[k].as_py(), plan.words)
                other = shingle_set(text_b[k].as_py(), plan.words)
                if 100 * min(len(kept), len(other)) >= plan.percent * max(len(kept), len(other)):
                    common = len(np.intersect1d(kept, other, assume_unique=True))
                    keep[k] = 100 * common >= plan.percent * (len(kept) + len(other) - common)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    return both.select("a", "b", "text_b", "text_a").mapInArrow(run, "a long, b long")


def _rooted(work: Workspace, hook: DataFrame) -> DataFrame:
    """``hook`` (id, to) with every id led to the end of its way: ways halve in each step."""
    while True:
        up = hook.select(F.col("id").alias("to"), F.col("to").alias("up"))
        new = work.save(hook.join(up, "to").select("id", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")), F.sum(F.col("moved").cast("long")).alias("moved"))
        work.drop(hook)
        hook = new
        if not hook.saved_moved:
            return hook


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(id, label) of every node of the saved ``edges`` (a, b): the least node it reaches.

    Each round hooks every node to its least neighbour, follows the hooks to their
    ends by doubling, and contracts the edges, until none is left.  A chain of
    rising ids is one round, of as many steps as its length has binary digits; a
    component's least node is never hooked.
    """
    label = None
    while edges.saved_rows or label is None:
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(edges.select(F.col("b").alias("id"), F.col("a").alias("other")))
        hook = _rooted(work, work.save(ends.groupBy("id").agg(F.least("id", F.min("other")).alias("to"))))
        if label is None:
            label = hook.select("id", F.col("to").alias("label"))
            label.saved_path, label.saved_rows = hook.saved_path, hook.saved_rows
        else:
            label = work.save(label.join(hook.select(F.col("id").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")))
        if not edges.saved_rows:
            break
        one = hook.select(F.col("id").alias("a"), F.col("to").alias("x"))
        two = hook.select(F.col("id").alias("b"), F.col("to").alias("y"))
        moved = edges.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = work.save(moved.where("a <> b").distinct())
    return label


def _cluster_pairs(work: Workspace, heavy: DataFrame, known: DataFrame, plan: DedupPlan) -> DataFrame:
    """Pairs (a, b) of documents that meet in the buckets ``heavy`` (key, doc_id) and whose sketches allow a link.

    Buckets that share documents form clusters, mostly one for each passage that
    makes up much of many documents.  A cluster's documents are dealt out to blocks
    of about ``plan.block``, and blocks are compared with blocks, each pair of
    documents once.  The pairs of blocks form a triangle that is cut into tiles of
    ``plan.tile`` blocks a side; a tile is a key of its own, so one large cluster
    is spread over as many tasks as it has tiles.
    """
    pivots = heavy.groupBy("key").agg(F.min("doc_id").alias("pivot"))
    clusters = components(work, work.save(heavy.join(pivots, "key").where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()))
    sizes = clusters.groupBy("label").agg(F.ceil(F.count("*") / plan.block).cast("int").alias("blocks"))
    dealt = clusters.join(sizes, "label").select(F.col("label").alias("cluster"), F.expr("pmod(xxhash64(id), blocks)").cast("int").alias("block"), F.col("id").alias("doc_id")).join(known, "doc_id")
    held = dealt.groupBy("cluster", "block").agg(F.collect_list(F.struct("doc_id", "label", "n", "bits")).alias("docs"))
    held = work.save(held.select("cluster", "block", "docs.doc_id", "docs.label", "docs.n", F.flatten("docs.bits").alias("bits")))
    tiles = sizes.select(F.col("label").alias("cluster"), F.ceil(F.col("blocks") / plan.tile).cast("int").alias("tiles"))
    row = F.floor(F.col("block") / plan.tile).cast("int")
    spread = held.join(tiles, "cluster").withColumn("row", row).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    spread = spread.withColumns({"low": F.least("row", "other"), "high": F.greatest("row", "other")}).drop("tiles", "other")
    one, two = (spread.select("cluster", "low", "high", *(F.col(c).alias(f"{c}_{side}") for c in ("row", "block", "doc_id", "label", "n", "bits"))) for side in "ab")
    most = plan.bits * (100 - plan.screen) // 200

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, n, bits = ([np.asarray(batch.column(4 * side + k)[row].values) for side in (0, 1)] for k in range(4))
                # Unsigned: bits are counted of absolute values.
                bits = [x.view(np.uint64).reshape(len(i), -1) for x, i in zip(bits, ids, strict=True)]
                for at in range(len(ids[0])):
                    may = (labels[1] != labels[0][at]) & (ids[1] != ids[0][at]) & (100 * np.minimum(n[1], n[0][at]) >= plan.percent * np.maximum(n[1], n[0][at]))
                    other = np.flatnonzero(may)
                    other = other[np.bitwise_count(bits[1][other] ^ bits[0][at]).sum(axis=1) <= most]
                    if len(other):
                        low, high = np.minimum(ids[1][other], ids[0][at]), np.maximum(ids[1][other], ids[0][at])
                        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    fields = [f"{c}_{side}" for side in "ab" for c in ("doc_id", "label", "n", "bits")]
    met = one.where("row_a = low").join(two.where("row_b = high"), ["cluster", "low", "high"]).where("block_a <= block_b")
    return met.select(*fields).mapInArrow(run, "a long, b long")


def _of_one_id(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of texts that stand under one id."""
    known = sketched.where("print IS NOT NULL AND doc_id IS NOT NULL")
    several = known.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x <> y").select("doc_id")
    reps = known.join(several, "doc_id").join(classes, "print").select("doc_id", F.col("rep").alias("b"))
    return reps.join(reps.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").where("a <> b").select("a", "b")


def near_duplicates(docs: DataFrame, plan: DedupPlan = DedupPlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are runs of other than ASCII white space, with A-Z in lower case.  Null
    and blank texts have no shingles and are linked with nothing.  ``kept`` marks
    the document whose id is the component's.  Rows with a null id link nothing
    and are kept, with a null component.  Rows that repeat an id are each returned;
    if their texts differ, the id is linked with what any of them is linked with.
    Columns of ``docs`` but the two named are not read.  Of the similarities at
    the threshold itself the link is taken.
    """
    work = Workspace(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = work.save(sketches(docs, plan))
    classes = work.save(sketched.where("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("rep")))
    half = work.save(sketched.where("print IS NOT NULL").join(classes.select(F.col("rep").alias("doc_id"), "print"), ["doc_id", "print"], "left_semi").groupBy("doc_id", "print").agg(F.first("halves").alias("halves")).select("doc_id", F.posexplode("halves").alias("k", "half")))
    shared = work.save(half.groupBy("half").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("half"))
    left = F.col("k") < plan.halves
    sides = half.join(shared, "half", "left_semi").groupBy("doc_id").agg(F.collect_set(F.when(left, F.col("half"))).alias("one"), F.collect_set(F.when(~left, F.col("half"))).alias("two"))
    keys = work.save(sides.select("doc_id", "two", F.explode("one").alias("l")).select("doc_id", "l", F.explode("two").alias("r")).select("doc_id", F.xxhash64("l", "r").alias("key")))
    buckets = work.save(keys.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1"))
    rows = work.save(keys.join(buckets, "key"))
    work.drop(half, shared, keys, buckets)
    texts = docs.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("text"))
    texts = work.save(texts.groupBy("doc_id", "h").agg(F.first("text").alias("text")).drop("h"))

    def pivoted(rows: DataFrame) -> DataFrame:
        return rows.where("doc_id <> pivot").select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()

    label = components(work, work.save(_similar(pivoted(rows), texts, plan).unionByName(_of_one_id(sketched, classes)).distinct()))

    def link(pairs: DataFrame) -> None:
        """Verifies pairs of documents of different components and merges the components of those linked."""
        nonlocal label
        found = _similar(pairs, texts, plan)
        for side in "ab":
            found = found.join(label.select(F.col("id").alias(side), F.col("label").alias(f"label_{side}")), side, "left").withColumn(side, F.coalesce(f"label_{side}", side)).drop(f"label_{side}")
        found = work.save(found.where("a <> b").distinct())
        if found.saved_rows:
            merged = components(work, found)
            moved = label.join(merged.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
            label = work.save(moved.unionByName(merged.join(label, "id", "left_anti")))

    def unresolved(rows: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component."""
        labelled = rows.select("key", "doc_id", "n").join(label.select(F.col("id").alias("doc_id"), "label"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("label", "doc_id").alias("label"))
        mixed = work.save(labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key"))
        return work.save(labelled.join(mixed, "key", "left_semi"))

    open_rows = unresolved(rows)
    if open_rows.saved_rows:
        # Another pivot from each bucket; members of its component need no comparison.
        collisions = open_rows.groupBy("doc_id").agg(F.count("*").alias("times"))
        order = F.max(F.struct("times", (-F.col("doc_id")).alias("minus"), F.col("label"))).alias("p")
        pivots = work.save(open_rows.join(collisions, "doc_id").groupBy("key").agg(order).select("key", (-F.col("p.minus")).alias("pivot"), F.col("p.label").alias("pivot_label")))
        link(pivoted(open_rows.join(pivots, "key").where("label <> pivot_label")))
        open_rows = unresolved(open_rows)
    if open_rows.saved_rows:
        known = work.save(bit_sketches(open_rows.select("doc_id", "label").distinct().join(texts, "doc_id"), plan))
        sizes = open_rows.groupBy("key", "label").agg(F.count("*").alias("m"), F.first("n").alias("members"))
        per = sizes.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.max("members").alias("members"), F.expr("sum(m * (members - m)) / 2").alias("pairs"))
        per = per.select("key", F.col("top.label").alias("top"), (F.col("pairs") <= F.lit(plan.linear) * F.col("members")).alias("few"))
        per = work.save(per)
        inside = work.save(open_rows.select("key", "doc_id").join(per.where("few").select("key", "top"), "key").join(known, "doc_id"))
        one, two = _sides(inside, "key")
        pairs = one.where("label_a <> top_a").join(two, "key").where(_close(plan)).select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b"))
        if (many := per.where("NOT few").select("key")).limit(1).count():
            heavy = work.save(open_rows.join(many, "key", "left_semi").select("key", "doc_id"))
            pairs = pairs.unionByName(_cluster_pairs(work, heavy, known, plan))
        link(work.save(pairs.distinct()))

    work.keep(sketched, classes, label)
    members = sketched.select("doc_id", "n_shingles", "print").join(classes, "print", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    labelled = members.join(label.select(F.col("id").alias("rep"), "label"), "rep", "left")
    out = labelled.select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    return out.select("*", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
