"""Removal of lines that other documents hold, with two Bloom filters ahead of the shuffle.

Every task enters the distinct line keys of its documents in two bit maps: a bit that
is met once is set in the first, one that is met again in the second.  Merging maps
keeps that: a bit set in both of two first maps goes to the second.  A key held by two
documents has all its bits in the merged second map, so lines without them are unique
and stay where they are.  Only the suspected repeats are shuffled, as 128-bit hashes;
grouping those by key confirms repeats exactly and gives the first document of each.

The maps have 16 bits for each key up to ``max_bits`` together, so what is broadcast is
bounded; beyond, more unique keys are suspected, which costs shuffled hashes and
changes no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratiospark.llm.workspace import Workspace

_BLANK = b" \t\n\v\f\r"
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: 64-bit words of a map that are compressed and merged together.
WORDS = 8192


@dataclass(frozen=True)
class LinePlan:
    """Keys of at least ``min_chars`` code points count.  ``hot_keys`` bounds the keys whose verdict is broadcast, ``hot_rows`` the documents from which on a key is one of them."""

    min_chars: int = 10
    bits_per_key: int = 16
    probes: int = 2
    max_bits: int = 1 << 28
    hot_rows: int = 4096
    hot_keys: int = 250_000


def line_key(line: bytes, least: int) -> bytes | None:
    """16 bytes for the key of a line, None where the key is too short: stripped of ASCII blanks, A-Z lower-cased."""
    key = line.strip(_BLANK).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def _keyed(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, part, keys): the distinct line keys of each row, two longs a key; ``part`` tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(2).to_pylist():
                keys = dict.fromkeys(line_key(line, least) for line in (text or b"").split(b"\n"))
                keys.pop(None, None)
                found.append(np.frombuffer(b"".join(keys), dtype="<i8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "part", "keys"])

    return docs.select("doc_id", "part", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, part long, keys array<long>")


def _places(keys: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """The bits of keys, one row for each probe."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return np.stack([((keys * (_ODD ** np.uint64(k))) >> shift).astype(np.int64) for k in range(1, probes + 1)])


def enter(once: np.ndarray, twice: np.ndarray, at: np.ndarray) -> None:
    """Sets bits in the first map, and in the second those met before, here or earlier."""
    at, met = np.unique(at, return_counts=True)
    if not len(at):
        return
    word, bit = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    word = word[starts]
    new = np.bitwise_or.reduceat(bit, starts)
    again = np.bitwise_or.reduceat(np.where(met > 1, bit, np.uint64(0)), starts)
    twice[word] |= again | (once[word] & new)
    once[word] |= new


def _twice_seen(keyed: DataFrame, bits: int, plan: LinePlan) -> np.ndarray:
    """The merged second map, made in the tasks and merged by stretches of ``WORDS`` words."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros((2, -(-bits // 64)), dtype=np.uint64)
        for batch in batches:
            keys = batch.column(0).flatten().to_numpy()[::2].view(np.uint64)
            enter(once, twice, _places(keys, bits, plan.probes).ravel())
        for k in range(0, len(once), WORDS):
            if once[k : k + WORDS].any():
                pair = [pa.array([zlib.compress(x[k : k + WORDS].tobytes(), 1)], pa.binary()) for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *pair], names=["at", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for at, *pair in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                once, twice = (np.frombuffer(zlib.decompress(x), dtype=np.uint64) for x in pair)
                old = maps.setdefault(at, [np.zeros_like(once), np.zeros_like(once)])
                old[1] |= twice | (old[0] & once)
                old[0] |= once
        for at, (_, twice) in maps.items():
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["at", "twice"])

    parts = keyed.select("keys").mapInArrow(fill, "at long, once binary, twice binary").repartition("at")
    out = np.zeros(-(-bits // 64), dtype=np.uint64)
    for at, twice in parts.mapInArrow(merge, "at long, twice binary").toLocalIterator():
        got = np.frombuffer(zlib.decompress(bytes(twice)), dtype=np.uint64)
        out[at : at + len(got)] = got
    return out


def _suspects(keyed: DataFrame, twice: np.ndarray, bits: int, plan: LinePlan) -> DataFrame:
    """(doc_id, part, hi, lo) of the keys with all their bits in the map."""
    shared = keyed.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            keys = batch.column(2).flatten().to_numpy().reshape(-1, 2)
            row = np.repeat(np.arange(len(batch)), batch.column(2).value_lengths().to_numpy() // 2)
            held = np.ones(len(keys), dtype=bool)
            for at in _places(np.ascontiguousarray(keys[:, 0]).view(np.uint64), bits, plan.probes):
                held &= (table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            rows = pa.array(row[held])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(keys[held, k]) for k in (0, 1))], names=["doc_id", "part", "hi", "lo"])

    return keyed.mapInArrow(run, "doc_id long, part long, hi long, lo long")


def _repeats(suspects: DataFrame, work: Workspace, plan: LinePlan) -> DataFrame:
    """The suspects whose key an earlier document holds: exact, by grouping keys.

    A key in very many documents would gather them in one task of the join back,
    so the verdicts of such keys are broadcast; by the number of suspects there
    can't be more than ``hot_keys`` of them.
    """
    held = suspects.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.count("doc_id").alias("named"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    held = work.save(held.where("first < last OR named BETWEEN 1 AND n - 1").select("hi", "lo", "n", "first"))
    hot = max(plan.hot_rows, suspects.saved_rows // plan.hot_keys)
    told = suspects.join(F.broadcast(held.where(F.col("n") > hot).select("hi", "lo", F.col("first").alias("hot_first"))), ["hi", "lo"], "left")
    rare = told.where("hot_first IS NULL").join(held.where(F.col("n") <= hot).select("hi", "lo", "first"), ["hi", "lo"])
    every = rare.unionByName(told.where("hot_first IS NOT NULL").withColumn("first", F.col("hot_first")))
    return every.where("doc_id IS NULL OR doc_id > first").select("doc_id", "part", "hi", "lo")


def dedup_lines(docs: DataFrame, plan: LinePlan = LinePlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that a document of a smaller id holds, with ``n_lines`` (before) and ``n_dropped`` (longs; columns of these names are replaced).

    A line's key is the line without ASCII blanks at its ends and with A-Z
    lower-cased; keys shorter than ``min_chars`` code points never count.  All
    lines of the smallest id that holds a key stay, repeated ones too.  Null and
    empty texts are one empty line and stay as they are.  Rows of one id are one
    document; rows with a null id are one document that comes last.  Texts of any
    length are taken whole, a line of any length as its 128-bit hash.  Empty
    tables give empty ones; other columns pass unchanged.
    """
    work, least = Workspace(docs.sparkSession), plan.min_chars
    docs = docs.drop("n_lines", "n_dropped")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("part", F.xxhash64("text"))
    keyed = work.save(_keyed(named, least), F.sum(F.size("keys") / 2).cast("long").alias("keys"))
    bits = min(plan.max_bits, 1 << max(16, (plan.bits_per_key * (keyed.saved_keys or 0)).bit_length()))
    suspects = work.save(_suspects(keyed, _twice_seen(keyed, bits, plan), bits, plan))
    work.drop(keyed)
    drops = work.save(_repeats(suspects, work, plan).groupBy("doc_id", "part").agg(F.collect_set(F.struct("hi", "lo")).alias("_drop")))
    work.keep(drops)
    drops = drops.select(F.col("doc_id").alias("_drop_id"), F.col("part").alias("_drop_part"), F.col("_drop.hi").alias("_drop_hi"), F.col("_drop.lo").alias("_drop_lo"))
    met = docs.withColumn(text_col, F.col(text_col).cast("string").cast("binary")).withColumn("_drop_of", F.xxhash64(F.col(text_col).cast("string")))
    met = met.join(drops, F.col(id_col).cast("long").eqNullSafe(F.col("_drop_id")) & (F.col("_drop_of") == F.col("_drop_part")), "left").select(*docs.columns, "_drop_hi", "_drop_lo")
    where = docs.columns.index(text_col)
    names = [*docs.columns, "n_lines", "n_dropped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = [], [], []
            for text, hi, lo in zip(batch.column(where).to_pylist(), batch.column(len(names) - 2).to_pylist(), batch.column(len(names) - 1).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                kept = lines
                if hi:
                    pairs = np.array([hi, lo], dtype="<i8").T.tobytes()
                    drop = {pairs[k : k + 16] for k in range(0, len(pairs), 16)}
                    kept = [line for line in lines if line_key(line, least) not in drop]
                    text = b"\n".join(kept)
                texts.append(text)
                total.append(len(lines))
                dropped.append(len(lines) - len(kept))
            cols = batch.columns[:-2]
            cols[where] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=names)

    schema = met.drop("_drop_hi", "_drop_lo").schema.add("n_lines", "long").add("n_dropped", "long")
    return met.mapInArrow(run, schema).withColumn(text_col, F.col(text_col).cast("string"))


def line_report(deduped: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of deduplicated rows; a null text counts as the empty one."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB's SQL for ``line_report(dedup_lines(documents))``.
LINES_SQL = """
    WITH split AS (SELECT doc_id, row, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no
                   FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
    keyed AS (SELECT *, translate(regexp_replace(line, '^[ \\x09-\\x0D]+|[ \\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split),
    held AS (SELECT k, min(doc_id) AS lowest FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
    told AS (SELECT doc_id, row, line_no, line, lowest IS NOT NULL AND doc_id <> lowest AS dropped FROM keyed LEFT JOIN held USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM told GROUP BY doc_id, row"""
