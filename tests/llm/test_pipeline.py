import public_tokenizers
from oracle import SF
from test_text_ops import brute_components, spans_by_definition
from test_token_ops import check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from ratiospark.llm import decontamination


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        done = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert check_packing(done.collect(), texts, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))) == 0
            break
        assert done.columns == columns
        now = {r.doc_id: r.text for r in done.collect()}
        assert set(now) <= set(texts)
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert all(d in now for d, t in texts.items() if labels.get(d) == 1 and len(t.split()) > 60)
        elif name == "near_duplicates":
            assert set(now) == {d for d, (c, _) in brute_components(texts.items()).items() if d == c}
        elif name == "decontamination":
            items = [decontamination.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            held = lambda t: any(w.tobytes() in decontamination.tokens(t).tobytes() for w in items)
            assert set(now) == {d for d, t in texts.items() if not held(t)}
        else:
            assert all(not spans_by_definition(t) for t in now.values()) and set(now) == set(texts)
            assert all(now[d] == t for d, t in texts.items() if not spans_by_definition(t))
        docs, texts = done, now


def test_stages_on_odd_rows(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() >= 0
    empty = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_decisions_reach_rows_without_an_id_of_their_own(spark):
    words = lambda c: " ".join(f"{c}{chr(97 + k % 26)}{chr(97 + k // 26)}ord" for k in range(60))
    a, b, c, few = words("q"), words("w"), words("z"), "plain words make a small text"
    held = spark.read.parquet(f"{SF}/benchmark.parquet").first().text

    def after(stage, rows):
        docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
        done = stage(spark, docs, SF)
        assert done.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in done.collect()), key=str)

    rows = [(None, few), (1, a), (1, few), (None, b), (2, None)]
    assert after(corpus_pipeline.quality, rows) == sorted([(1, a), (None, b)], key=str)
    rows = [(5, a), (5, a), (5, b), (None, a), (2, a), (None, c), (None, c)]
    assert after(corpus_pipeline.deduplicate, rows) == sorted([(2, a), (5, b), (None, c)], key=str)
    rows = [(None, f"{a} {held}"), (3, f"{held} {a}"), (3, a), (None, b), (4, None)]
    assert after(corpus_pipeline.decontaminate, rows) == sorted([(3, a), (None, b), (4, None)], key=str)


def test_access_tokens_leave_the_corpus(spark):
    secret = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6"
    docs = spark.createDataFrame([(1, f"deploy with {secret} please", "en"), (2, "nothing here", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    done = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["pii"](spark, docs, SF).collect()}
    assert done == {1: "deploy with [SECRET] please", 2: "nothing here", 3: None}
