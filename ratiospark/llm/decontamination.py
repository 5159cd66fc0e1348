"""Benchmark decontamination by spaced-seed hashing.

A mask selects some token positions of a window and ignores the others.  The
selected tokens of every window of every benchmark item, under each of a few fixed
masks, give the test hashes; those of the documents are the training hashes.
Documents first meet a bit map of the test hashes (a Bloom filter of bounded size),
so that few rows reach the join on the hashes.  Each joined pair of positions fixes
a diagonal of document against item; on it, the best-scoring stretch around the hit
(a match counts 1, a substitution -1) decides: substituted tokens lower its identity
but don't end it.  Where that stretch is not alike enough, the one with the most
matches of all that are decides, so two passages that a changed part divides are
found by either of them.
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
class SeedPlan:
    """``masks``: 1 for a selected position.  An overlap counts from ``identity`` on, with ``tokens`` matches or ``coverage`` of the item.

    ``max_bits`` bounds the bit map, in which a hash has ``probes`` bits; ``region`` the tokens kept together around hits.
    """

    masks: tuple[str, ...] = ("110101001", "1010011001", "1001110001", "111101")
    tokens: int = 13
    coverage: float = 0.6
    identity: float = 0.7
    max_bits: int = 1 << 27
    probes: int = 3
    region: int = 1024


_BLANK = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Beyond ASCII: signs that are no part of a word, and characters that are one each.
_SIGN = re.compile(r"[^\w\x00-\x7f]")
_ALONE = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's tokens: runs of lower-case letters and digits, and each ideograph or kana by itself."""
    text = text.lower() if text else ""
    if not text.isascii():
        text = _SIGN.sub(" ", text)
        if _ALONE.search(text):
            text = _ALONE.sub(r" \g<0> ", text)
    words = text.encode().translate(_BLANK).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def seeds(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """One hash for each window of the mask's length."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, salt + 1, dtype=np.uint64)
    for k, chosen in enumerate(mask):
        if chosen == "1":
            out = (out ^ hashes[k : k + n]) * _ODD
            out ^= out >> np.uint64(29)
    return out


def _seed_rows(items: DataFrame, plan: SeedPlan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(item, int(h), at) for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, m in enumerate(plan.masks) for at, h in enumerate(seeds(tokens(text), m, k).view(np.int64))]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["item_id", "seed", "item_at"])

    return items.mapInArrow(run, "item_id long, seed long, item_at int")


def _token_rows(rows: DataFrame, key: str, out: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=[key, out])

    return rows.mapInArrow(run, f"{key} long, {out} array<long>")


def _places(hashes: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    """The bits of a hash: as many of its lowest bits as the map needs, then those of its products with odd numbers."""
    return [((hashes * (_ODD ** np.uint64(k))) >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64) for k in range(1, probes + 1)]


def _bit_map(test: DataFrame, plan: SeedPlan) -> np.ndarray:
    """A Bloom filter of the test hashes, bytes of 8 bits: at least 16 bits a hash, up to ``max_bits``; made in the tasks, merged by word."""
    n = test.select("seed").distinct().count()
    bits = min(plan.max_bits, 1 << max(20, (16 * n).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits, plan.probes))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    words = test.select("seed").mapInArrow(place, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("set"))
    out = np.zeros(bits // 64, dtype=np.int64)
    for word, value in words.toLocalIterator():
        out[word] = value
    return out.view(np.uint8)


def _hits(docs: DataFrame, bit_map: np.ndarray, margin: int, plan: SeedPlan) -> DataFrame:
    """Regions of documents around possible hits: (doc_id, part, start, tokens, hits of (at, seed))."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        bits = 8 * len(table)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                at, found = [], []
                for k, mask in enumerate(plan.masks):
                    h = seeds(words, mask, k)
                    there = np.arange(len(h))
                    for probe in range(1, plan.probes + 1):
                        place = _places(h[there], bits, probe)[-1]
                        there = there[(table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
                    at.append(there)
                    found.append(h[there])
                at, found = np.concatenate(at), np.concatenate(found)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[order].view(np.int64)
                cuts = np.flatnonzero((np.diff(at) > 2 * margin) | (np.diff(at // plan.region) > 0)) + 1
                for part, (a, f) in enumerate(zip(np.split(at, cuts), np.split(found, cuts), strict=True)):
                    start, end = max(0, int(a[0]) - margin), int(a[-1]) + margin
                    out.append((doc, part, start, words[start:end].view(np.int64), a.astype(np.int32), f))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "part", "start", "tokens", "at", "seeds"])

    return docs.mapInArrow(run, "doc_id long, part int, start int, tokens array<long>, at array<int>, seeds array<long>")


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the best-scoring stretch of a diagonal."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -1))])
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


def longest_stretch(same: np.ndarray, identity: float) -> tuple[int, int, int]:
    """(start, end, matches) of the stretch with the most matches among those of at least that identity; the shortest, then the first."""
    scale = 1000
    total = np.concatenate([[0], np.cumsum(np.where(same, scale, 0) - round(scale * identity))])
    matches = np.concatenate([[0], np.cumsum(same)])
    # The first place from which the stretch that ends here is alike enough, less the substitutions at its start.
    first = np.searchsorted(-np.minimum.accumulate(total), -total, side="left")
    start = np.minimum(np.searchsorted(matches, matches[first], side="right") - 1, np.arange(len(total)))
    gain, length = matches - matches[first], np.arange(len(total)) - start
    end = int(np.lexsort((start, length, -gain))[0])
    return int(start[end]), end, int(gain[end])


def overlaps(docs: DataFrame, items: DataFrame, plan: SeedPlan = SeedPlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_token, end_token, n_matches, n_substituted): the best overlap of each document with each item it holds.

    A document and an item overlap if some stretch of a diagonal has the plan's
    ``identity`` and enough matches, and a seed in it is found.  Null and empty
    texts overlap nothing, nor do items shorter than the shortest mask; items with
    a null id are not looked for.  Repeated rows of one id count once, and rows of
    one id with different texts give the best overlap of any; items that repeat an
    id are taken together.  A document with a null id is reported with it.  Other
    columns are not read.  The longest item sets how much text around a hit is kept.
    """
    work = Workspace(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL").dropDuplicates(["item_id", "text"])
    test = work.save(_seed_rows(items, plan))
    words = work.save(_token_rows(items, "item_id", "item"))
    margin = words.agg(F.max(F.size("item"))).first()[0] or 1
    regions = work.save(_hits(docs, _bit_map(test, plan), margin, plan))
    place = ["doc_id", "part", "start"]
    hits = work.save(regions.select(*place, F.explode(F.arrays_zip("at", "seeds")).alias("h")).select(*place, F.col("h.at").alias("at"), F.col("h.seeds").alias("seed")))
    lines = work.save(hits.join(test, "seed").select(*place, "item_id", (F.col("at") - F.col("item_at")).alias("line")).distinct())
    pairs = lines.join(regions.select(*(F.col(c).alias(f"r_{c}") for c in place), "tokens"), F.expr("doc_id <=> r_doc_id AND part = r_part AND start = r_start")).select(*place, "item_id", "line", "tokens").join(words, "item_id")
    # Of a region's tokens, those beside the item on the line.
    first = F.greatest(F.col("line") - F.col("start"), F.lit(0))
    pairs = pairs.withColumn("tokens", F.slice("tokens", first + 1, F.size("item"))).withColumn("start", F.col("start") + first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item, start, line, text, words in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                text, words = np.asarray(text, dtype=np.int64), np.asarray(words, dtype=np.int64)
                shift = line - start  # of the item's first token, in the region
                low, high = max(0, -shift), min(len(words), len(text) - shift)
                if high <= low:
                    continue
                same = text[low + shift : high + shift] == words[low:high]
                a, b, n = best_stretch(same)
                if n < plan.identity * (b - a):
                    a, b, n = longest_stretch(same, plan.identity)
                if b > a and (n >= plan.tokens or n >= plan.coverage * len(words)):
                    out.append((doc, item, line + low + a, line + low + b, n, b - a - n))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start_token", "end_token", "n_matches", "n_substituted"])

    found = pairs.select("doc_id", "item_id", "start", "line", "tokens", "item").mapInArrow(run, "doc_id long, item_id long, start_token long, end_token long, n_matches long, n_substituted long")
    best = F.max(F.struct("n_matches", -F.col("n_substituted"), -F.col("start_token"), F.col("end_token"))).alias("best")
    out = work.save(found.groupBy("doc_id", "item_id").agg(best))
    work.keep(out)
    return out.select("doc_id", "item_id", (-F.col("best.col3")).alias("start_token"), "best.end_token", "best.n_matches", (-F.col("best.col2")).alias("n_substituted"))


def decontaminated(docs: DataFrame, items: DataFrame, plan: SeedPlan = SeedPlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no item; rows with a null id stay."""
    return docs.join(overlaps(docs, items, plan, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_anti")
