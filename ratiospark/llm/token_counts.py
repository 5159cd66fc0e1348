"""Token counts by a finite-state transducer compiled from a byte-level BPE vocabulary.

The token that ends the BPE coding of a word's first i bytes is the one token t
ending there for which (last token before t, t) is a pair that BPE leaves
unmerged.  So what the rest of a word needs to know of its beginning is, for each
start of a token that may still be under way, how much of it has been read, the
token before it and how many tokens the coding has by then.  Those facts are the
states of a deterministic transducer; the transition on a byte carries the change
of the token count (which may be zero or negative).  States are compiled as texts
reach them and kept in tables of bounded size.

The texts of a batch form one stream of symbols, a byte with a mark where a word
begins; such a mark leads to the same state from everywhere.  The stream is cut
into chunks of equal length, which step through the transducer side by side.  A
chunk's state map says, for each state in which it may be entered, the state in
which it is left and the tokens up to its first mark; the maps compose in a
parallel prefix scan, which gives the state and the count at every chunk's start.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Unicode's White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def character_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    classes[WHITE] = SPACE
    return classes


def word_starts(codes: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Marks the characters at which the tokenizer begins a word.

    ``starts`` marks the first characters of texts.  Words are contractions
    ('s 't 're 've 'm 'll 'd), runs of letters, of digits or of others, each with
    one blank before it if there is one, and runs of white space, less the last
    character if a word follows.
    """
    n = len(codes)
    if not n:
        return starts.copy()
    kind = classes[codes]
    before = np.empty_like(kind)
    before[0], before[1:] = 9, kind[:-1]
    before[starts] = 9
    last = np.empty(n, dtype=bool)  # of its text
    last[-1], last[:-1] = True, starts[1:]
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = codes[:-1] == 32
    blank_before &= before != 9
    after = np.empty_like(kind)
    after[-1], after[:-1] = 9, kind[1:]
    after[last] = 9
    marks = np.where(
        kind == SPACE,
        (before != SPACE) | ((after != SPACE) & (after != 9)),
        np.where(before == SPACE, ~blank_before, kind != before),
    )
    quote = np.flatnonzero((codes == 39) & (before != OTHER) & ~blank_before & ~last)
    if len(quote):
        one = codes[quote + 1]
        two = np.where(last[quote + 1] | (quote + 2 >= n), 0, codes[np.minimum(quote + 2, n - 1)])
        length = np.where(np.isin(one, [115, 116, 109, 100]), 2, 0)
        length[((one == 114) | (one == 118)) & (two == 101)] = 3
        length[(one == 108) & (two == 108)] = 3
        quote, length = quote[length > 0], length[length > 0]
        marks[quote] = True
        marks[quote + 1] = False
        end = quote + length
        marks[end[end < n]] = True
    marks[starts] = True
    return marks


class Transducer:
    """The compiled part of the transducer; ``step`` moves many lanes at once and compiles what is missing."""

    MASK_BITS = 18

    def __init__(self, path: str, max_states: int):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model, self.max_states = Tokenizer.from_file(path).model, max_states
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letter = {b: chr(b) for b in printable}
        self.letter |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in self.letter)}
        byte = {c: b for b, c in self.letter.items()}
        self.text = [""] * len(spec["model"]["vocab"])
        self.child: dict[int, int] = {}
        self.token, self.leaf = [-1], [True]
        for text, token in spec["model"]["vocab"].items():
            self.text[token] = text
            node = 0
            for c in text:
                key = node << 8 | byte[c]
                if key not in self.child:
                    self.leaf[node] = False
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.leaf.append(True)
                node = self.child[key]
            self.token[node] = token
        self.unmerged: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self._room(1 << self.MASK_BITS)
        self.first = np.full(256, -1, dtype=np.int32)

    def _room(self, slots: int) -> None:
        self.bits = slots.bit_length() - 1
        self.keys = np.full(slots, -1, dtype=np.int64)
        self.value = np.zeros(slots, dtype=np.int64)  # next state << 16 | change of count + 2^15
        self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        if (self.used + len(keys)) * 3 > len(self.keys):
            old, kept = self.keys >= 0, (self.keys, self.value)
            keys, values = np.concatenate([kept[0][old], keys]), np.concatenate([kept[1][old], values])
            self._room(len(self.keys) * 4)
        self.used += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            done = self.keys[slot] == keys
            self.value[slot[done]] = values[done]
            keys, values, slot = keys[~done], values[~done], (slot[~done] + 1) & (len(self.keys) - 1)

    def _stay(self, one: int, two: int) -> bool:
        """BPE codes the bytes of these two tokens as these two tokens (-1: nothing)."""
        if (known := self.unmerged.get((one, two))) is None:
            if len(self.unmerged) > 2_000_000:
                self.unmerged.clear()
            text = self.text[two] if one < 0 else self.text[one] + self.text[two]
            known = self.unmerged[one, two] = [t.id for t in self.model.tokenize(text)] == ([two] if one < 0 else [one, two])
        return known

    def _compile(self, state: int, byte: int) -> int:
        after, end = [], None
        for node, before, count in self.states[state]:
            node = self.child.get(node << 8 | byte, -1)
            if node < 0:
                continue
            if end is None and (token := self.token[node]) >= 0 and self._stay(before, token):
                end = (token, count + 1)
            if not self.leaf[node]:
                after.append((node, before, count))
        if end is None:
            raise ValueError("the vocabulary has no coding for this byte")
        token, change = end
        facts = (*((node, before, count - change) for node, before, count in after), (0, token, 0))
        number = self.number.setdefault(facts, len(self.states))
        if number == len(self.states):
            self.states.append(facts)
        return number << 16 | change + (1 << 15)

    def step(self, state: np.ndarray, byte: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lanes' next states and changes of count."""
        keys = np.where(mark, 0, state.astype(np.int64)) << 8 | byte
        value = self._find(keys)
        if len(missing := np.flatnonzero(value < 0)):
            new = np.unique(keys[missing])
            self._insert(new, np.fromiter((self._compile(int(k) >> 8, int(k) & 255) for k in new), dtype=np.int64, count=len(new)))
            value[missing] = self._find(keys[missing])
        return (value >> 16).astype(np.int32), ((value & 0xFFFF) - (1 << 15)).astype(np.int16)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        value = np.where(there == keys, self.value[slot], -1)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            hit = there == keys[rest]
            value[rest[hit]] = self.value[slot[hit]]
            on = ~hit & (there >= 0)
            rest, slot = rest[on], slot[on]
        return value

    def run(self, state: np.ndarray, byte: np.ndarray, mark: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and token counts of lanes (columns) that stop after ``length`` symbols."""
        order = np.argsort(-length, kind="stable")
        state, byte, mark, length = state[order], byte[:, order], mark[:, order], length[order]
        count = np.zeros(len(state), dtype=np.int64)
        for k in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -k, side="left"))
            state[:live], change = self.step(state[:live], byte[k, :live], mark[k, :live])
            count[:live] += change
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]


def count_stream(machine: Transducer, byte: np.ndarray, mark: np.ndarray, chunk: int) -> np.ndarray:
    """Change of the token count at every symbol; exact in sum over any stretch between marks."""
    n = len(byte)
    lanes = -(-n // chunk)
    byte = np.concatenate([byte, np.zeros(lanes * chunk - n, np.uint8)]).reshape(lanes, chunk).T.copy()
    mark = np.concatenate([mark, np.ones(lanes * chunk - n, bool)]).reshape(lanes, chunk).T.copy()
    head = np.where(mark.any(axis=0), mark.argmax(axis=0), chunk)  # symbols before the first mark
    state = np.zeros(lanes, dtype=np.int32)
    change = np.zeros((chunk, lanes), dtype=np.int16)
    for k in range(chunk):
        state, change[k] = machine.step(state, byte[k], mark[k])
    change[np.arange(chunk)[:, None] < head[None, :]] = 0

    # State maps: entries and exits of each chunk, closed so that each exit is an entry of the next.
    maps: list[dict[int, tuple[int, int]]] = [{} for _ in range(lanes)]
    fixed = head < chunk  # left in the same state whatever the entry
    todo = {c: {int(state[c - 1])} for c in range(1, lanes) if head[c] and fixed[c - 1]}
    guesses = {c: {0} for c in range(1, lanes) if head[c] and not fixed[c - 1]}
    for c, s in guesses.items():
        todo.setdefault(c, set()).update(s)
    while todo:
        lane, entry = np.array([(c, s) for c, ss in todo.items() for s in ss], dtype=np.int64).T
        out, tokens = machine.run(entry.astype(np.int32), byte[:, lane], mark[:, lane], head[lane])
        todo = {}
        for c, s, x, m in zip(lane.tolist(), entry.tolist(), out.tolist(), tokens.tolist(), strict=True):
            maps[c][s] = (int(state[c]) if fixed[c] else x, m)
        for c in set(lane.tolist()):
            if not fixed[c] and c + 1 < lanes and (new := {x for x, _ in maps[c].values()} - maps[c + 1].keys()):
                todo[c + 1] = new
    entries = [list(m) or [0] for m in maps]
    width = max(map(len, entries), default=1)
    place = [{s: k for k, s in enumerate(e)} for e in entries]
    to = np.zeros((lanes, width), dtype=np.int64)  # entry's place in this chunk to its place in the next
    tokens_to = np.zeros((lanes, width), dtype=np.int64)
    for c in range(lanes):
        for k, s in enumerate(entries[c]):
            exit_state, m = maps[c].get(s, (int(state[c]), 0))
            to[c, k] = place[c + 1].get(exit_state, 0) if c + 1 < lanes else 0
            tokens_to[c, k] = m
    scan, reach = to.copy(), 1  # after the scan, scan[c] maps the first chunk's entry to the entry of chunk c + 1
    while reach < lanes:
        scan[reach:] = np.take_along_axis(scan[reach:], scan[:-reach], axis=1)
        reach *= 2
    at = np.concatenate([[0], scan[:-1, 0]]) if lanes else np.zeros(0, np.int64)
    change[0] += np.where(head > 0, tokens_to[np.arange(lanes), at], 0).astype(np.int16)
    return change.T.reshape(-1)[:n]


class Counter:
    """Token counts of texts as the library gives them, special strings included."""

    def __init__(self, path: str, chunk: int = 256, max_states: int = 300_000):
        self.machine, self.chunk = Transducer(path, max_states), chunk
        self.classes = character_classes()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each text."""
        parts: list[str] = []
        owner: list[int] = []
        n_bytes = np.zeros(len(texts), dtype=np.int64)
        n_tokens = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            pieces = [text or ""]
            for special in self.machine.special:
                n_bytes[k] += (cut := sum(p.count(special) for p in pieces)) * len(special.encode())
                n_tokens[k] += cut
                pieces = [q for p in pieces for q in p.split(special)] if cut else pieces
            for p in pieces:
                if p:
                    parts.append(p)
                    owner.append(k)
        if not parts:
            return n_bytes, n_tokens
        if len(self.machine.states) > self.machine.max_states:
            self.machine.reset()
        whole = "".join(parts)
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        byte = np.frombuffer(whole.encode(), dtype=np.uint8)
        at = np.cumsum([0, *map(len, parts)])[:-1]
        starts = np.zeros(len(codes), dtype=bool)
        starts[at] = True
        mark = np.zeros(len(byte), dtype=bool)
        first = np.flatnonzero((byte & 0xC0) != 0x80)
        mark[first] = word_starts(codes, self.classes, starts)
        change = count_stream(self.machine, byte, mark, self.chunk)
        edges = first[at]
        np.add.at(n_tokens, owner, np.add.reduceat(change, edges, dtype=np.int64))
        np.add.at(n_bytes, owner, np.diff([*edges, len(byte)]))
        return n_bytes, n_tokens


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs`` (``SCHEMA``), nothing shuffled.

    A null or empty text has 0 bytes and 0 tokens; repeated rows are repeated;
    null ids stay null; rows don't depend on each other, so ties are none; other
    columns are not read.  ``batch_chars`` bounds the texts taken together; a
    longer text is taken alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end] or "") <= batch_chars):
                    held += len(texts[end] or "")
                    end += 1
                n_bytes, n_tokens = counter(texts[at:end])
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
                at = end

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
