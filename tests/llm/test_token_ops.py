import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import SF
from tokenizers import Tokenizer

from ratiospark.llm import packing, sharding, token_counts
from ratiospark.llm.queries import QUERIES

ODD = ["a'll b's c're 'sx''s  'd\n's \n's \n\n's\t'm 'lle it's' '", "  x   y\n\n z  ", "<|endoftext|>a<|endoftext|><|endoftext|> b", None, "", "é　ü 12 ½ 漢字かな 🎉🎉 ̀a", "a" * 5000, "ab" * 3000, " " * 3000, "x" * 255 + "'s", "1" * 2000 + "'ll" + " " * 700 + "q", "don't" * 500, "\n \n  \n" * 300, "'" * 1000, "é" * 3000, "🎉" * 700, "\x1c\x1d\x85  b", "<|startoftext|>x İSTANBUL ΣΑΣ ﬁ"]


def mixed(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abAB 'slmrevtd\n.1é🎉\t") for _ in range(rng.randrange(300))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_equal_the_library(byte_bpe):
    texts = ODD + mixed(600)
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"), chunk=64)
    n_bytes, n_tokens = counter(texts)
    assert n_bytes.tolist() == [len((t or "").encode()) for t in texts]
    assert n_tokens.tolist() == [len(byte_bpe.encode(t or "").ids) for t in texts]
    # With other chunks and after the tables were dropped.
    counter.machine.reset()
    counter.chunk = 7
    assert counter(texts)[1].tolist() == n_tokens.tolist()


def test_count_query(spark, byte_bpe):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_transducer_token_counts"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(byte_bpe.encode(docs[r.doc_id] or "").ids)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 512, len(docs[r.doc_id].encode()))


def test_count_odd_rows(odd_docs):
    found = token_counts.count_tokens(odd_docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert found.count() == 8 and found.where("doc_id = 3 AND n_tokens = 0 AND n_bytes = 0").count() == 1
    assert token_counts.count_tokens(odd_docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def word_ids(library, text):
    return np.asarray([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def check_packing(rows, texts, library, size=4096):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, found in pieces.items():
        ids, at = word_ids(library, texts[doc]), 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_packing(QUERIES["op3_cost_balanced_packing"](spark, SF).collect(), texts, library) == 0


def test_packing_odd_texts(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(enumerate(ODD + mixed(200, 2) + ["word " * 9000, ""]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    plan = packing.PackingPlan(tokenizer=public_tokenizers.path("word_bpe_49k.json"), block_tokens=20_000, cached_words=50)
    assert check_packing(packing.pack(docs, plan).collect(), texts, library) == 0
    assert packing.pack(docs.limit(0), plan).count() == 0


def test_packing_repeated_and_null_rows(odd_docs):
    plan = packing.PackingPlan(tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(odd_docs, plan).collect()
    assert sum(r.doc_id == 1 and r.start == 0 for r in rows) == 2 and any(r.doc_id is None for r in rows)


def test_blocks_are_balanced():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1500, 3000)
    plan = packing.PackingPlan()
    cost = defaultdict(float)
    for _, _, n, q, _ in packing.pack_block(lengths, plan):
        cost[q] += plan.linear * n + plan.quadratic * n * n
    full = sorted(cost.values())[15:]
    assert max(full) / min(full) < 1.6
    assert packing.pack_block(np.array([], dtype=np.int64), plan) == []


def test_lookup_table():
    table = sharding.fill_table(sharding.SHARDS)
    loads = np.bincount(table, minlength=128)
    assert loads.max() - loads.min() <= 1
    fewer = sharding.fill_table(sharding.SHARDS[:-1])
    moved = np.mean([a != b for a, b in zip(table, fewer, strict=True) if a != 127])
    assert moved < 0.2
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "b"], 100)
    # By the definition, turn by turn, on a small table.
    small, names = sharding.fill_table(["a", "b", "c"], 11), ["a", "b", "c"]
    prefs = {s: [(sharding._number(f"{s}/offset") + k * (sharding._number(f"{s}/step") % 10 + 1)) % 11 for k in range(11)] for s in names}
    claimed = {}
    for turn in range(11):
        s = names[turn % 3]
        claimed[next(p for p in prefs[s] if p not in claimed)] = turn % 3
    assert small == [claimed[k] for k in range(11)]


def test_sharding_odd_rows(odd_docs):
    found = sharding.place(odd_docs.withColumnRenamed("key", "slot"), "doc_id", ["a", "b"], 11)
    assert found.count() == 8 and found.where("shard IS NULL").count() == 0
    assert sharding.place(odd_docs.limit(0), "doc_id", ["a"], 11).count() == 0


def test_word_ids_of_every_plain_character():
    """Each character of the fast path, alone and in words, against the library."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), packing.WordIds(path, 400_000)
    for c in map(chr, [*range(33, 127), *range(0xA1, 0x250)]):
        for text in (c, f"a{c}", f"{c}b", f"a{c}b", f"1{c}.", f"{c}{c}"):
            assert np.frombuffer(words.text(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
