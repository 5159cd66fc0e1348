"""Merkle manifest of a dataset, with its nodes in level-partitioned Parquet.

Rows become leaves, sorted in runs by group and key.  Every level is a table of the
store, sorted by coordinate (tree, position): it comes from one sequential reading of
the level before, in which a task hashes each run of ``fanout`` consecutive nodes as
it passes.  Runs that the border of two tasks cuts, at most two a stretch of a file,
are put together by a small aggregate.  A task holds one run besides the batch that
it reads, so no tree has to fit in memory.  The groups' roots are the leaves of one
more tree, built alike.

A proof is the list of sibling digests from a leaf to the root.  Proofs come from the
top down by merge joins on the coordinate: a node meets its parent, which holds the
digests of its run and its own path, so that wide rows are those of the level above
the leaves, one for each ``fanout`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiospark.llm.workspace import Workspace

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class MerklePlan:
    """``fanout`` consecutive nodes make one of the next level."""

    fanout: int = 16


def digest(*values: Column) -> Column:
    """SHA-256 of values, each as its UTF-8 byte count, a colon and itself, or ``-`` if null; so no two rows of values run together."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _placed(work: Workspace, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with their ``tree`` (one for each value of the keys, in their order), position ``pos`` in it from 0, and its size ``n``.

    Rows are dealt by ranges of keys and order, sorted in each and written; the row
    numbers of the writing tasks and the sizes of their parts give the positions.
    """
    runs = work.save(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    runs = runs.withColumn("_run", F.shiftright("_at", 33))
    sizes = runs.groupBy(*keys, "_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sizes = sizes.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_run").alias("_k__run"), "_first", F.min("_first").over(whole).alias("tree"), (F.sum("_size").over(whole.orderBy("_run")) - F.col("_size")).alias("_before"), F.sum("_size").over(whole).alias("n"))
    sizes = work.save(sizes)
    matching = F.lit(True)
    for k in [*keys, "_run"]:
        matching = matching & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return runs.join(sizes, matching).select("tree", (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "n", *rows.columns)


def _next_level(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, pos, n, first, digest, children) of the runs of ``nodes``, which are in order within tasks; the digest of a run that is not whole here is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * 3
        names: list[str] = []
        schema = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string()))])

        def made(bounds: list[int]) -> pa.RecordBatch:
            tree, pos, n = kept
            out = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                first, size, run = int(pos[a]), int(n[a]), names[a:b]
                whole = first % fanout == 0 and (b - a == fanout or first + b - a == size)
                out.append((int(tree[a]), first // fanout, -(-size // fanout), first, hashlib.sha256("".join(run).encode()).hexdigest() if whole else None, run))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            kept = [np.concatenate([old, batch.column(k).to_numpy()]) for k, old in enumerate(kept)]
            names += batch.column(3).to_pylist()
            tree, pos, _ = kept
            cuts = np.flatnonzero((np.diff(tree) != 0) | (np.diff(pos) != 1) | (np.diff(pos // fanout) != 0)) + 1
            if len(cuts):
                yield made([0, *cuts.tolist()])
                kept, names = [x[cuts[-1] :] for x in kept], names[cuts[-1] :]
        if names:
            yield made([0, len(names)])

    return nodes.where("n > 1").select("tree", "pos", "n", "digest").mapInArrow(run, "tree long, pos long, n long, first long, digest string, children array<string>")


def _levels(work: Workspace, leaves: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """The store: ``leaves`` (tree, pos, n, digest and others), then each level above, up to the last tree's root."""
    levels = [work.save(leaves.sortWithinPartitions("tree", "pos"), F.max("n").alias("longest"), name=f"{name}/level=0")]
    n = levels[0].saved_longest or 0
    while n > 1:
        runs = work.save(_next_level(levels[-1], fanout))
        whole = runs.where("digest IS NOT NULL").select("tree", "pos", "n", "digest", "children")
        parts = runs.where("digest IS NULL").groupBy("tree", "pos").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("first", "children"))).alias("parts"))
        children = F.flatten(F.transform("parts", lambda p: p["children"]))
        cut = parts.select("tree", "pos", "n", F.sha2(F.array_join(children, ""), 256).alias("digest"), children.alias("children"))
        level = whole.unionByName(cut).repartitionByRange("tree", "pos").sortWithinPartitions("tree", "pos")
        levels.append(work.save(level, name=f"{name}/level={len(levels)}"))
        work.drop(runs)
        n = -(-n // fanout)
    return levels


def _below(nodes: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` of one level with ``path`` and what else ``above``, the next level with its paths, knows of their trees."""
    up = above.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("children").alias("_run"), F.col("path").alias("_path"), *(c for c in above.columns if c.startswith("top_")))
    met = nodes.where("n > 1").join(up, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("pos") / fanout) == F.col("_pos")))
    at = (F.col("pos") % fanout).cast("int")
    step = F.struct(F.array_join(F.slice("_run", F.lit(1), at), "").alias("left"), F.array_join(F.slice("_run", at + 2, F.lit(fanout)), "").alias("right"))
    return met.withColumn("path", F.concat(F.array(step), "_path")).drop("_tree", "_pos", "_run", "_path")


def _paths(levels: Sequence[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The leaves with ``path``, an array of (left, right) siblings of each level, and the columns ``top_...`` of their tree; ``tops``: (top_tree, path, ...)."""
    found = None
    for level in reversed(levels):
        roots = level.where("n = 1").join(tops, F.col("tree") == F.col("top_tree"))
        found = roots if found is None else _below(level, found, fanout).unionByName(roots)
    return found


@dataclass
class Manifest:
    """A store: the levels of the groups' trees, those of the tree of their roots, and its root (None of an empty table)."""

    levels: list[DataFrame]
    crown: list[DataFrame]
    root: str | None
    plan: MerklePlan


def build(work: Workspace, leaves: DataFrame, keys: Sequence[str], order: Sequence[str], plan: MerklePlan = MerklePlan()) -> Manifest:
    """Builds the store of ``leaves``, which have a ``digest``: one tree for each value of the keys (null is one, and first), its leaves ascending by ``order`` (nulls first), ties by digest."""
    rows = leaves.withColumn("_row", F.monotonically_increasing_id())
    placed = _placed(work, work.save(rows), keys, [*order, "digest", "_row"]).drop("_row")
    levels = _levels(work, placed, plan.fanout, "nodes")
    roots = None
    for level in levels:
        some = level.where("n = 1").select(F.col("tree").alias("of"), "digest")
        roots = some if roots is None else roots.unionByName(some)
    crown = _levels(work, _placed(work, roots, [], ["of"]), plan.fanout, "crown")
    last = crown[-1].where("n = 1").select("digest").first()
    return Manifest(levels, crown, last[0] if last else None, plan)


def proofs(found: Manifest) -> DataFrame:
    """The leaves with ``path`` (array of (left, right): the siblings' digests before and after, one entry a level), ``subroot`` and ``root``."""
    fanout = found.plan.fanout
    none = F.array().cast("array<struct<left:string,right:string>>")
    end = found.crown[-1].where("n = 1").select(F.col("tree").alias("top_tree"), none.alias("path"))
    crown = _paths(found.crown, end, fanout).select(F.col("of").alias("top_tree"), F.col("digest").alias("top_digest"), "path")
    out = _paths(found.levels, crown, fanout)
    return out.withColumn("subroot", F.col("top_digest")).withColumn("root", F.lit(found.root)).drop("top_tree", "top_digest")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and a proof give."""
    return F.aggregate(path, leaf, lambda value, step: F.sha2(F.concat(step["left"], value, step["right"]), 256))


def siblings(path: Column) -> Column:
    """The digests of a proof one after another, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def audit(docs: DataFrame, plan: MerklePlan = MerklePlan()) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): a manifest of ``docs`` by source, and what tampered texts do to it.

    Rows whose decimal id's CRC-32 is divisible by 5 are tampered with: their
    text's A-Z are lower-cased.  ``folded_root`` comes from the tampered row, or
    from the row as it is, and the original proof; ``verified`` says whether it is
    the root.  Nulls in any field, empty texts and texts of any length have a
    digest; a null source is a group, and the first; null ids come first in their
    group and are not tampered with; rows that share an id follow by digest, and
    repeated rows are leaves of their own.  An empty table gives no rows.  Other
    columns are not read.
    """
    work = Workspace(docs.sparkSession)
    fields = [F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = digest(*fields[:-1], F.translate("text", UPPER, LOWER))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", digest(*fields).alias("digest"), F.when(hit & F.col("text").rlike("[A-Z]"), tampered).alias("altered"))
    found = proofs(build(work, leaves, ["source"], ["doc_id"], plan))
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("altered", "digest"), F.col("path")).alias("folded_root"))
    out = work.save(out.withColumn("verified", F.col("folded_root") == F.col("root")))
    work.keep(out)
    return out


def audit_sql(fanout: int = 16, heights: tuple[int, int] = (6, 6)) -> str:
    """DuckDB's SQL for ``audit`` over ``documents`` with distinct ids, up to ``fanout ** height`` leaves a source and as many sources."""
    ctes = []
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(field(c) for c in FIELDS[:-1])
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    bits = "unnest(string_split('" + ",".join(str(k) for k in range(256)) + "', ','))::UINTEGER"
    step = "if(c & 1 = 1, xor(c >> 1, 3988292384::UINTEGER), c >> 1)"
    for k in range(8):
        ctes.append(f"crc{k} AS (SELECT b, {step} AS c FROM " + (f"crc{k - 1})" if k else f"(SELECT x AS b, x AS c FROM (SELECT {bits} AS x)))"))
    ctes.append("tab AS (SELECT list(c ORDER BY b) AS t FROM crc7)")
    ctes.append("docs AS (SELECT d.*, xor(4294967295::UINTEGER, list_reduce(list_prepend(4294967295::UINTEGER, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::UINTEGER)), lambda a, x: xor(a >> 8, t[xor(a & 255, x)::INTEGER + 1]))) % 5 = 0 AS hit FROM documents d, tab)")
    ctes.append(f"leaves AS (SELECT doc_id, source, sha256({head} || {field('text')}) AS d, CASE WHEN hit THEN sha256({head} || {field(lower)}) END AS altered FROM docs)")
    ctes.append("ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp FROM leaves)")
    for name, height, base in (("a", heights[0], "SELECT grp AS g, pos AS p, d FROM ranked"), ("b", heights[1], f"SELECT 0 AS g, g AS p, d FROM a{heights[0]}")):
        ctes.append(f"{name}0 AS ({base})")
        for k in range(height):
            ctes.append(f"{name}r{k} AS (SELECT g, p // {fanout} AS p, list(d ORDER BY p) AS run, max(max(p)) OVER (PARTITION BY g) AS top FROM {name}{k} GROUP BY g, p // {fanout})")
            ctes.append(f"{name}{k + 1} AS (SELECT g, p, CASE WHEN top = 0 THEN run[1] ELSE sha256(list_aggregate(run, 'string_agg', '')) END AS d FROM {name}r{k})")
    ctes.append("s0 AS (SELECT doc_id, d, grp, pos AS p, '' AS proof, coalesce(altered, d) AS fold FROM ranked)")
    at = 0
    for name, height in (("a", heights[0]), ("b", heights[1])):
        for k in range(height):
            g = "s.grp" if name == "a" else "0"
            left = f"coalesce(list_aggregate(r.run[1:s.p % {fanout}], 'string_agg', ''), '')"
            right = f"coalesce(list_aggregate(r.run[s.p % {fanout} + 2:], 'string_agg', ''), '')"
            ctes.append(f"s{at + 1} AS (SELECT doc_id, s.d, grp, s.p // {fanout} AS p, CASE WHEN r.top = 0 THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN r.top = 0 THEN fold ELSE sha256({left} || fold || {right}) END AS fold FROM s{at} s JOIN {name}r{k} r ON r.g = {g} AND r.p = s.p // {fanout})")
            at += 1
        if name == "a":
            ctes.append(f"s{at + 1} AS (SELECT doc_id, d, grp, grp AS p, proof, fold FROM s{at})")
            at += 1
    return "WITH " + ",\n".join(ctes) + f"""
        SELECT s.doc_id, s.d AS leaf, a.d AS subroot, b.d AS root, sha256(s.proof) AS proof_sha256, s.fold AS folded_root, s.fold = b.d AS verified
        FROM s{at} s JOIN a{heights[0]} a ON a.g = s.grp, b{heights[1]} b"""
