"""Ranked lexical search with variable-block-max WAND, exact.

Documents are dealt to shards of bounded size.  A shard's posting list of a term is
cut into blocks of differing length: dynamic programming picks the borders for which
the sum of (block's greatest impact - impact) over the postings, plus a fixed charge
a block, is least.  A search splits the shard's documents at the borders of all blocks
of the query's terms.  In each stretch between two borders the sum of the terms' block
maxima bounds every score, as the pivot test of block-max WAND does; stretches are
visited from the greatest bound down, and all whose bound is under the k-th score so
far are skipped with their blocks.  Nothing is approximate: a stretch with an equal
bound is visited, since ties go to the lower id.

The index holds the terms of the queries at hand.  Queries are taken in blocks, so
that vocabulary and queries that are broadcast have a bound.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiospark.llm.workspace import Workspace

_FOLD = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class SearchPlan:
    """``k`` results a query; ``shard`` documents in a shard, about; ``pairs`` of query and term searched at once.

    Block borders lie at multiples of ``step`` postings, at most ``window`` steps
    apart; a block costs as much as ``charge`` of impact above the true ones.
    """

    k: int = 20
    shard: int = 16_384
    pairs: int = 1_000_000
    step: int = 8
    window: int = 32
    charge: int = 4_000_000


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, digits and all characters beyond ASCII."""
    return (text or b"").translate(_FOLD).split()


def _asked(items: DataFrame) -> DataFrame:
    """(item_id, term, times): the terms of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms(t)) for t in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(batch)), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([w for c in counts for w in c], pa.binary()), pa.array([n for c in counts for n in c.values()], pa.int64())], names=["item_id", "term", "times"])

    found = items.select("item_id", F.col("text").cast("binary")).mapInArrow(run, "item_id long, term binary, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms, and those of the vocabulary with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, at, tf = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms(text)
                ids, counts = np.unique(np.array([k for k in map(known.get, words) if k is not None], dtype=np.int32), return_counts=True)
                n.append(len(words))
                at.append(ids)
                tf.append(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _document_counts(forward: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term, counted in the tasks and summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there])], names=["term", "df"])

    out = np.zeros(size, dtype=np.int64)
    for term, df in forward.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").cast("long")).toLocalIterator():
        out[term] = df
    return out


def block_borders(impacts: np.ndarray, lengths: np.ndarray, plan: SearchPlan) -> tuple[np.ndarray, np.ndarray]:
    """For posting lists laid end to end: (list, border) pairs in order, a border being a block's end in its list.

    Lists of like length are solved side by side, one step of the programme at a time.
    """
    cells = -(-lengths // plan.step)
    offsets, firsts = np.cumsum(lengths) - lengths, np.cumsum(cells) - cells
    owner = np.repeat(np.arange(len(lengths)), cells)
    tops = np.maximum.reduceat(impacts, offsets[owner] + (np.arange(cells.sum()) - firsts[owner]) * plan.step) if len(owner) else impacts
    size = np.ceil(np.log2(np.maximum(cells, 1))).astype(int)
    found: list[np.ndarray] = []
    for kind in np.unique(size[cells > 0]):
        some = np.flatnonzero((size == kind) & (cells > 0))
        width = int(cells[some].max())
        cell = np.arange(width)
        top = np.where(cell < cells[some, None], tops[np.minimum(firsts[some, None] + cell, len(tops) - 1)], 0)
        end = np.minimum(np.arange(width + 1) * plan.step, lengths[some, None])
        cost = np.zeros((len(some), width + 1), dtype=np.int64)
        back = np.zeros((len(some), width + 1), dtype=np.int32)
        for p in range(1, width + 1):
            low = max(0, p - plan.window)
            most = np.maximum.accumulate(top[:, low:p][:, ::-1], axis=1)
            total = cost[:, low:p][:, ::-1] + most * (end[:, p : p + 1] - end[:, low:p][:, ::-1])
            back[:, p] = total.argmin(axis=1)
            cost[:, p] = np.take_along_axis(total, back[:, p : p + 1], axis=1)[:, 0] + plan.charge
        live, at = np.arange(len(some)), cells[some]
        while len(live):
            found.append(np.stack([some[live], end[live, at]]))
            at = at - 1 - back[live, at]
            live, at = live[at > 0], at[at > 0]
    pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)
    order = np.lexsort((pairs[1], pairs[0]))
    return pairs[0][order], pairs[1][order]


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one shard (column 0) after another, from rows in its order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and held[0].column(0)[0].as_py() != shard[a]:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and the lists' lengths."""
    lists = table.column(name).chunk(0)
    return lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)


INDEX = "shard int, term int, docs array<int>, impacts array<int>, ends array<int>, tops array<int>, ids array<long>"


def _index(forward: DataFrame, documents: int, length: int, shards: int, plan: SearchPlan) -> DataFrame:
    """The shards' posting lists with their blocks; the row of term -1 holds the ids of the shard's documents, numbered in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            term, sizes = _column(rows, "terms")
            tf, _ = _column(rows, "tfs")
            n = rows.column("n").to_numpy()
            weight = 75 + (25 * n * documents) // length
            doc = np.repeat(np.arange(len(n), dtype=np.int32), sizes)
            impact = (1_000_000_000 * tf // (1000 * tf + 12 * weight[doc])).astype(np.int32)
            order = np.argsort(term, kind="stable")
            term, doc, impact = term[order], doc[order], impact[order]
            names, lengths = np.unique(term, return_counts=True)
            owner, end = block_borders(impact.astype(np.int64), lengths, plan)
            first = np.cumsum(lengths) - lengths
            begin = np.where(np.diff(owner, prepend=-1) != 0, 0, np.roll(end, 1)) + first[owner]
            tops = np.maximum.reduceat(impact, begin)
            blocks = np.bincount(owner, minlength=len(names))
            size = len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, shard, dtype=np.int32)), pa.array(names.astype(np.int32)), _lists(doc, lengths), _lists(impact, lengths), _lists(end.astype(np.int32), blocks), _lists(tops.astype(np.int32), blocks), pa.nulls(size, pa.list_(pa.int64()))],
                names=["shard", "term", "docs", "impacts", "ends", "tops", "ids"],
            )
            none = [pa.array([[]], pa.list_(pa.int32()))] * 4
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([-1], pa.int32()), *none, pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64()))], names=["shard", "term", "docs", "impacts", "ends", "tops", "ids"])

    dealt = forward.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "row")
    return dealt.select("shard", "doc_id", "n", "terms", "tfs").mapInArrow(run, INDEX)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [low, high), one after another."""
    sizes = high - low
    return np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Shard:
    """A shard's index in memory."""

    def __init__(self, rows: pa.Table):
        terms = rows.column("term").to_numpy()
        lists = rows.filter(pa.array(terms >= 0)).combine_chunks()
        self.ids = rows.filter(pa.array(terms < 0)).column("ids")[0].as_py()
        terms = lists.column("term").to_numpy()
        self.docs, lengths = _column(lists, "docs")
        self.impacts, _ = _column(lists, "impacts")
        ends, blocks = _column(lists, "ends")
        self.tops = _column(lists, "tops")[0].astype(np.int64)
        first = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(terms)), blocks)
        self.high = first[owner] + ends
        self.low = np.where(np.diff(owner, prepend=-1) != 0, first[owner], np.roll(self.high, 1))
        at = np.cumsum(blocks) - blocks
        self.blocks = {int(t): (int(a), int(a + b)) for t, a, b in zip(terms, at, blocks, strict=True)}
        self.scored = self.held = 0

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and scores of the k best documents, equal scores by number."""
        none = np.empty(0, dtype=np.int64)
        there = [(self.blocks[t], w) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if w > 0 and t in self.blocks]
        if not there:
            return none, none
        block = _ranges(np.array([b[0] for b, _ in there]), np.array([b[1] for b, _ in there]))
        weight = np.repeat(np.array([w for _, w in there]), [b[1] - b[0] for b, _ in there])
        low, high = self.low[block], self.high[block]
        first, last = self.docs[low], self.docs[high - 1] + 1
        self.held += int((high - low).sum())
        # Bounds of the stretches between borders.
        bound = weight * self.tops[block]
        border = np.concatenate([first, last])
        order = np.argsort(border, kind="stable")
        border = border[order]
        total = np.cumsum(np.concatenate([bound, -bound])[order])
        edge = np.flatnonzero(np.diff(border, append=border[-1] + 1))
        start, total = border[edge], total[edge]
        end = np.append(start[1:], start[-1])
        some = total > 0
        start, end, total = start[some], end[some], total[some]
        falling = np.argsort(-total, kind="stable")
        start, end, total = start[falling], end[falling], total[falling]
        doc, score, least, size = none, none, 1, 16 * k
        seen, span = 0, np.cumsum(end - start)
        while seen < len(total) and total[seen] >= least:
            until = int(np.searchsorted(span, (span[seen - 1] if seen else 0) + size, side="left")) + 1
            until = min(until, int(np.searchsorted(-total, -least, side="right")))
            chosen = np.zeros(len(self.ids) + 1, dtype=np.int32)
            np.add.at(chosen, start[seen:until], 1)
            np.add.at(chosen, end[seen:until], -1)
            chosen = np.cumsum(chosen)
            before = np.concatenate([[0], np.cumsum(chosen)])
            open_ = before[last] > before[first]
            at = _ranges(low[open_], high[open_])
            self.scored += len(at)
            where = self.docs[at]
            inside = chosen[where] > 0
            found = np.zeros(len(self.ids), dtype=np.int64)
            np.add.at(found, where[inside], (np.repeat(weight[open_], high[open_] - low[open_]) * self.impacts[at])[inside])
            new = np.flatnonzero(found >= least)
            doc, score = np.concatenate([doc, new]), np.concatenate([score, found[new]])
            keep = np.lexsort((doc, -score))[:k]
            doc, score = doc[keep], score[keep]
            if len(doc) == k:
                least = int(score[-1])
            seen, size = until, size * 8
        return doc, score


def _searched(index: DataFrame, shards: int, queries: list[tuple], plan: SearchPlan) -> DataFrame:
    """(item_id, doc_id, score): the k best of each shard for each query (item, terms, weights)."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches):
            shard, out = Shard(rows), []
            for item, terms, weights in shared.value:
                doc, score = shard.best(terms, weights, plan.k)
                out += [(item, shard.ids[d], s) for d, s in zip(doc.tolist(), score.tolist(), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_id", "doc_id", "score"])

    return index.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "term").mapInArrow(run, "item_id long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, plan: SearchPlan = SearchPlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, those with a score above 0.

    Documents are rows: repeated ids are ranked one by one, null ids come last
    among equal scores.  Null and empty texts have no terms; they count neither
    among the documents nor their lengths.  Texts of any length are read whole.
    Rows of one item id are one query of all their terms, repeated rows once; a
    null item id is one of them.  Items whose terms no document holds have no
    rows; empty tables give none.  Other columns are not read.
    """
    work = Workspace(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = work.save(_asked(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()))
    blocks, found = max(1, -(-asked.saved_rows // plan.pairs)), []
    for block in range(blocks):
        pairs = asked.where(F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(blocks)) == block).collect()
        vocabulary = {bytes(t): k for k, t in enumerate(sorted({bytes(p.term) for p in pairs}))}
        forward = work.save(_forward(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("length"), F.count(F.when(F.size("terms") > 0, 1)).alias("dealt"))
        documents, length = forward.saved_documents or 0, forward.saved_length or 0
        df = _document_counts(forward, len(vocabulary))
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()]
        queries: dict = {}
        for p in pairs:
            k = vocabulary[bytes(p.term)]
            queries.setdefault(p.item_id, []).append((k, weight[k] * p.times))
        queries = [(item, *np.array(sorted(q), dtype=np.int64).T) for item, q in sorted(queries.items(), key=lambda x: (x[0] is None, x[0]))]
        shards = max(1, -(-(forward.saved_dealt or 0) // plan.shard))
        index = work.save(_index(forward, documents, max(1, length), shards, plan))
        work.drop(forward)
        found.append(work.save(_searched(index, shards, queries, plan)))
        work.drop(index)
    work.keep(*found)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= plan.k).select("item_id", "rank", "doc_id", "score")


#: DuckDB's SQL for ``rank(documents, benchmark)``.
RANK_SQL = r"""
    WITH words AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                   FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
    held AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY row, doc_id, term),
    lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM held GROUP BY row),
    corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
    weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, corpus GROUP BY term),
    asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
              FROM (SELECT DISTINCT item_id, text FROM benchmark)),
    times AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
    scored AS (SELECT item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
               FROM times JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (row), corpus GROUP BY item_id, row, doc_id),
    placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM placed WHERE rank <= 20"""
