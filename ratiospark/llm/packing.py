"""Cost-balanced packing of tokenised documents into sequences of fixed length.

A piece of n tokens costs ``linear * n + quadratic * n**2``: the matrix products
grow with n, attention with its square.  Documents are packed in blocks of
bounded size, each within one task, so nothing is shuffled and a lost task is
simply run again.  In a block, documents of at least a whole sequence give whole
sequences; what is left is taken in descending order of cost, each to the
lowest-cost sequence that still has room for it.  The block opens exactly as
many sequences as its tokens fill: a document that fits nowhere whole is cut
where room is left, and the rest of the block, less than one sequence, goes into
sequences whose lengths are powers of two and need no padding.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class PackingPlan:
    """``block_tokens`` bounds what a task holds: a block ends with the document that reaches it."""

    tokenizer: str = ""
    end_id: int = 2
    sequence: int = 4096
    linear: float = 1.0
    quadratic: float = 1.0 / 4096
    block_tokens: int = 1 << 21
    cached_words: int = 400_000


class WordIds(dict):
    """Token ids of whole texts (little-endian bytes) from the ids of their words.

    The tokenizer drops white space and never joins over it, so a text's ids are
    those of its words in order.  A word is cut by the tokenizer's own pattern
    and each part goes through the library's merges once; both are kept in
    tables of bounded size.  A word outside the Latin ranges, or one that could
    hold a special token, goes through the whole library; so does one with U+0130,
    whose lower case is two characters and no one part.
    """

    #: White space to ``str.split`` but not to the tokenizer.
    ODD = "\x1c\x1d\x1e\x1f"
    PLAIN = re.compile(r"[!-;=-~\u00a1-\u012f\u0131-\u024f]+")
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.library, self.limit = Tokenizer.from_file(path), limit
        self.model, self.parts = self.library.model, {}  # of parts, twice as many
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, part: str) -> bytes:
        if (found := self.parts.get(part)) is None:
            if len(self.parts) >= 2 * self.limit:
                self.parts.clear()
            mapped = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            found = self.parts[part] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return found

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if (plain := self.PLAIN.fullmatch(word)) and word.isalpha() and unicodedata.is_normalized("NFC", word):
            found = self.part(word.lower())
        elif plain and word[:-1].isalpha() and word[-1] in ".,!?;:" and unicodedata.is_normalized("NFC", word):
            found = self.part(word[:-1].lower()) + self.part(word[-1])
        elif plain and unicodedata.is_normalized("NFC", word):
            found = b"".join(map(self.part, self.PARTS.findall(word.lower())))
        else:
            found = self.whole(word)
        self[word] = found
        return found

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in self.ODD):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def pack_block(lengths: np.ndarray, plan: PackingPlan) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one block; sequences count from 0."""
    size, out = plan.sequence, []
    whole = lengths // size
    n = 0
    for doc in np.flatnonzero(whole):
        for k in range(int(whole[doc])):
            out.append((int(doc), k * size, size, n, 0))
            n += 1
    rest = lengths - whole * size
    docs = np.flatnonzero(rest)
    docs = docs[np.lexsort((docs, -rest[docs]))]
    opened = int(rest.sum()) // size
    room = np.full(opened, size, dtype=np.int64)
    cost = np.zeros(opened)
    tail: list[tuple[int, int, int]] = []

    def put(doc: int, start: int, length: int, where: int) -> None:
        out.append((doc, start, length, n + where, int(size - room[where])))
        room[where] -= length
        cost[where] += plan.linear * length + plan.quadratic * length * length

    for doc in docs.tolist():
        start, left = int(whole[doc]) * size, int(rest[doc])
        while left:
            fits = np.where(room >= left, cost, np.inf) if opened else np.empty(0)
            if opened and fits[where := int(fits.argmin())] < np.inf:
                put(doc, start, left, where)
                break
            if not opened or not room.any():
                tail.append((doc, start, left))
                break
            cut = int(room[where := int(room.argmax())])
            put(doc, start, cut, where)
            start, left = start + cut, left - cut
    n += opened
    total = sum(x[2] for x in tail)
    sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    offset = 0
    for doc, start, length in tail:
        while length:
            cut = min(length, sizes[0] - offset)
            out.append((doc, start, cut, n, offset))
            start, length, offset = start + cut, length - cut, offset + cut
            if offset == sizes[0]:
                sizes, n, offset = sizes[1:], n + 1, 0
    return out


def pack(docs: DataFrame, plan: PackingPlan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document (``SCHEMA``).

    A document is its tokens and the end id, so an empty or null text is one
    token.  Each token lies in one piece; ``offset`` runs without gaps from 0 in
    each sequence; a sequence is full or its length a power of two.  Repeated
    rows are packed as often as they come, rows with a null id like others; an
    empty table gives no piece.  Of sequences that cost the same the first is
    filled, of documents that cost the same the first comes first.  Other columns
    are not read.  ``sequence_id`` is the task's number times 2^32 plus a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(plan.tokenizer, plan.cached_words)
        end = np.asarray([plan.end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, ids, tokens, held
            pieces = pack_block(np.asarray([len(t) // 4 for t in tokens], dtype=np.int64), plan)
            rows = [(ids[d], s, n, zlib.crc32(memoryview(tokens[d])[4 * s : 4 * (s + n)]), len(tokens[d]) // 4, base + q, o) for d, s, n, q, o in pieces]
            base += 1 + max(p[3] for p in pieces)
            ids, tokens, held = [], [], 0
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    coded = words.text(text)
                    ids.append(key)
                    tokens.append(coded + end)
                    held += len(coded) // 4 + 1
                    if held >= plan.block_tokens:
                        yield flush()
        if tokens:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
