import hashlib
import random
import re

import numpy as np
import pytest
from oracle import SF, assert_same
from pyspark.sql import functions as F

from ratiospark.llm import decontamination, html_extraction, near_dedup, pii, quality_model, quality_rules, warc_revisits
from ratiospark.llm.queries import QUERIES, oracle_sql


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), oracle_sql()[name])


# Near duplicates.


def brute_components(docs, percent=75):
    sets = {d: set(near_dedup.shingle_set(t, 5).tolist()) for d, t in docs}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: (root(d), len(s)) for d, s in sets.items()}


def test_shingles_by_definition():
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    for t in ["", "a b", "a b c d e", "A b C d e f a b c d e f", "É é x y z w v", "x y z a b c", "q\x1cw e r t y"]:
        w = words(t)
        want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(near_dedup.shingle_set(t, 5)) == len(want)


def test_groups_of_copies(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(4000)]
    docs = []
    passage = rng.choices(vocabulary, k=70)
    for base in range(25):
        words = rng.choices(vocabulary, k=rng.randrange(5, 160))
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += [" ".join(passage + rng.choices(vocabulary, k=rng.randrange(5, 40))) for _ in range(150)]  # near the threshold, in one bucket
    hub = rng.choices(vocabulary, k=120)
    docs += [" ".join(hub)] + [" ".join(w if k % 60 != s else "changed" for k, w in enumerate(hub)) for s in range(30)]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), near_dedup.DedupPlan(linear=2)).collect()
    want = brute_components(rows)
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_odd_rows(odd_docs):
    rows = near_dedup.near_duplicates(odd_docs).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[2].n_shingles == by[3].n_shingles == by[6].n_shingles == 0 and by[3].component_id == 3
    assert by[None].component_id is None and by[None].kept
    assert near_dedup.near_duplicates(odd_docs.limit(0)).count() == 0


# Quality model.


def test_scores_of_held_out_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op5_random_indexing_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.95
    good, bad = rows[rows.quality == 1].score.values, rows[rows.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.95


def test_scores_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, None, 0), (7, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    plan = quality_model.ModelPlan(buckets=512, dims=8, epochs=2)
    rows = quality_model.quality_scores(odd_docs, labels, plan).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_model.quality_scores(odd_docs, labels.limit(0), plan).collect()} == {0.5}
    assert quality_model.quality_scores(odd_docs.limit(0), labels, plan).count() == 0


def test_word_vectors_by_definition(spark):
    plan = quality_model.ModelPlan(buckets=64, dims=8, nonzero=2)
    texts = ["a b c a", "d e", "f", None, "b b b"]
    table = quality_model.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), plan)
    place, sign = quality_model.index_vectors(plan)
    want = np.zeros((64, 8))
    for t in texts:
        rows = quality_model.word_rows(t, plan)
        for i in range(len(rows)):
            for j in range(max(0, i - 2), min(len(rows), i + 3)):
                if i != j:
                    np.add.at(want[rows[i]], place[rows[j]], sign[rows[j]])
    want = want - np.outer(np.abs(want).sum(axis=1), want.sum(axis=0) / np.abs(want).sum())
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(table, np.divide(want, norm, out=np.zeros_like(want), where=norm > 0), atol=1e-5)


# Quality rules.


def counts_by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark):
    rng = random.Random(0)
    texts = ["", None, "a " * 40, "x\n\nx\nx \n y", "🎉 é # | a b \x0b\x0c c\r\nd", " lead", "trail ", "a b c d e f g h " * 3 + "z"]
    texts += [" ".join(rng.choices("abcde", k=rng.randrange(60))) for _ in range(150)] + ["\n".join(rng.choices(["a b", "c", "", " "], k=9)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.counts(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_by_definition(texts[r.doc_id]), texts[r.doc_id]


def test_binomial_tail(spark):
    from math import comb, log

    rows = [(n, k) for n in (30, 400, 5000) for k in (0, 1, n // 300)]
    df = spark.createDataFrame(rows, "n long, k long").withColumn("p", quality_rules.log_binomial_tail(0.01))
    for r in df.collect():
        if r.k < 0.01 * r.n:
            want = sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
            assert r.p == pytest.approx(log(want), abs=1e-9)


def test_rules_reject_junk_and_keep_clean(spark):
    clean = [(k, " ".join(f"w{k}x{j}" for j in range(40)), "en") for k in range(3000)]
    junk = [(k, " ".join(f"w{k}#### {j}" for j in range(40)), "en") for k in range(3000, 3050)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(3000)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    assert kept == set(range(3000))
    assert quality_rules.judge(docs, labels.limit(50)).where("NOT kept").count() == 0  # too few labels to certify a cutoff


def test_rules_on_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(odd_docs, labels).collect()
    assert len(rows) == 8 and all(r.kept is not None for r in rows)
    assert {r.doc_id: r.base_failed for r in rows}[5]  # 30,000 times one word
    assert quality_rules.judge(odd_docs.limit(0), labels.limit(0)).count() == 0


# Decontamination.


def test_leaks_are_found_and_others_left(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(500)]
    rows, want = [], set()
    for k, item in enumerate(sorted(items)):
        words = items[item].split()
        for j in range(0, len(words), 9):
            words[j] = "substitute"
        rows.append((k, " ".join(rng.choices(vocabulary, k=50) + words + rng.choices(vocabulary, k=50))))
        want.add((k, item))
    rows += [(1000 + k, " ".join(rng.choices(vocabulary, k=200))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.overlaps(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert decontamination.decontaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 50


def test_query_equals_all_alignments(spark):
    docs = [(r.doc_id, decontamination.tokens(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, decontamination.tokens(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plan, want = decontamination.SeedPlan(), set()
    for d, text in docs:
        for i, words in items:
            if not np.isin(words, text).mean() > 0.5:
                continue
            for line in range(-len(words) + 1, len(text)):
                low, high = max(0, -line), min(len(words), len(text) - line)
                same = text[low + line : high + line] == words[low:high]
                if same.sum() >= 5:
                    a, b, n = decontamination.best_stretch(same)
                    if n >= plan.identity * (b - a) and (n >= plan.tokens or n >= plan.coverage * len(words)):
                        want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in QUERIES["op7_spaced_seed_decontamination"](spark, SF).collect()} == want and want


def test_decontamination_of_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "x y z"), (4, "plain words make a small text of a dozen words or so here"), (4, "long " * 9)], "item_id long, text string")
    found = decontamination.overlaps(odd_docs, items).collect()
    assert {r.doc_id for r in found} == {1, None, 5}
    assert {r.doc_id for r in decontamination.decontaminated(odd_docs, items).collect()} == {None, 2, 3, 6, 7}
    assert decontamination.overlaps(odd_docs, items.limit(0)).count() == decontamination.overlaps(odd_docs.limit(0), items).count() == 0


# Main text.


def test_main_text_of_pages(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op8_main_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|div|ul|li)\b[^>]*>", body))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><div class='top menu'>a b c</div><div><p>One two three four five</p><ul><li>alpha beta</li></ul><form>no<input></form><p>Last &lt;p&gt; &amp; more&nbsp;text</p></div><div id=comments><p>spam spam spam</p></div></body>", "One two three four five\nalpha beta\nLast <p> & more text"),
        ("<p>b one two</p><aside><p>nope nope nope nope</p></aside><p>b three<br>four</p><section class=comments>bad bad</section>", "b one two\nb three\nfour"),
        ("<script>var a='<p>x</p>'</script><!-- c --><p>hi  \n there</p>", "hi there"),
        (None, ""),
        ("", ""),
        ("<nav><a>x</a></nav>", ""),
        ("plain words", "plain words"),
    ],
)
def test_main_text_without_labels(page, text):
    assert html_extraction.extract(page, {}) == text


def test_best_stretch_is_the_best():
    rng = np.random.default_rng(1)
    for _ in range(50):
        same = rng.random(30) < 0.6
        a, b, n = decontamination.best_stretch(same)
        score = np.where(same, 1, -1)
        best = max((score[i:j].sum() for i in range(30) for j in range(i, 31)), default=0)
        assert score[a:b].sum() == best and n == same[a:b].sum()


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>words of a page</p>"), (2, "u", "<" * 3000), (2, "u", "<a " + "'" * 3000), (3, "u", "<p>" + "w " * 50000)], "page_id long, url string, html string")
    assert html_extraction.main_texts(pages).count() == 5 and html_extraction.main_texts(pages.limit(0)).count() == 0


# Personal data.

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def spans_by_definition(text):
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans(spark):
    rng = random.Random(3)
    texts = ["", None, "a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 300.1.1.1 000255.1.1.1", "+1 (017) 555-7713 +12 +1234567890123456", "4026 0839 7753 1332 4539578763621486", "a" * 30000, "1" * 30000, "1 " * 9000 + "x", "+1234567890 🎉a@b.co é+1 (974) 555-3436", "@@..@a.b a..b@c-.d-.e- "]
    texts += ["".join(rng.choice("ab1294 .-@+()é🎉\n_%") for _ in range(rng.randrange(200))) for _ in range(800)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, row string")
    for r in pii.span_report(pii.find_spans(df)).collect():
        want = spans_by_definition(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert [r[f"n_{k}"] for k, _ in PATTERNS] == [want.count(f"{k}:") for k, _ in PATTERNS]


def test_revealing_terms(spark):
    rows = [(k, f"the clerk Zarathu of case {'abcdefgh'[k]} is at zara@corp.org every day") for k in range(6)]
    rows += [(10 + k, "the day of every other case is at hand") for k in range(40)]
    rows += [(90, "Zarathu alone stays as it is"), (91, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_spans(df)
    text = rows[0][1]
    spans = {r.doc_id: r.spans for r in pii.span_report(found).collect()}
    at = text.index("Zarathu")
    assert f"term:{at}:{at + 7}" in spans[0] and "email:" in spans[0] and f":{text.index('every')}:" not in spans[0]
    assert spans[90] == "" and spans[10] == "" and spans[91] == ""
    safe = {r.doc_id: r.text for r in pii.sanitise(found, ["doc_id", "text"]).collect()}
    assert "Zarathu" not in safe[0] and "[EMAIL]" in safe[0] and safe[90] == rows[-2][1] and safe[91] is None


def test_terms_of_shared_entities(spark):
    """Each address occurs once; its domain and the term, far from it, meet in six texts."""
    far = "lorem " * 60
    rows = [(k if k else None, f"the clerk Zarathu {far} of case {'abcdefgh'[k]} is at {'pqrstuvw'[k]}@corp.org every day") for k in range(6)]
    rows += [(10 + k, "the day of every other case is at hand") for k in range(40)]
    rows += [(90, "Zarathu alone"), (None, "and Zarathu again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_spans(df, pii.PiiPlan(everywhere=True))
    safe = [r.text for r in pii.sanitise(found, ["doc_id", "text"]).collect()]
    assert len(safe) == len(rows) and not any("Zarathu" in t for t in safe)
    assert "[TERM] alone" in safe and "and [TERM] again" in safe and rows[10][1] in safe
    near = {r.text for r in pii.sanitise(pii.find_spans(df), ["doc_id", "text"]).collect()}
    assert "Zarathu alone" in near and not any("Zarathu" in t and "EMAIL" in t for t in near)


def test_personal_data_of_odd_rows(odd_docs):
    found = pii.find_spans(odd_docs)
    rows = {(r.doc_id, r.n_email, r.n_phone) for r in pii.span_report(found).collect()}
    assert (7, 1, 1) in rows and pii.sanitise(found, odd_docs.columns).columns == odd_docs.columns
    assert found.count() == 8 and pii.find_spans(odd_docs.limit(0)).count() == 0


# Revisits.


def test_revisits(spark):
    h = lambda **k: {x.replace("_", "-"): v for x, v in k.items()}
    rows = [
        (1, "http://www.Site.org/a/?utm_source=x&b=2&a=1#f", 10, "response", 200, h(ETag='"1"', Date="10", Server="s"), "d1"),
        (2, "https://site.org:443/a?a=1&b=2", 20, "response", 200, h(ETag='"2"', Content_Length="5"), "d2"),
        (3, "site.org/a?b=2&a=1", 30, "response", 404, h(ETag='"3"'), "d3"),
        (4, "site.org/a?b=2&a=1", 20, "revisit", 304, h(ETag='W/"1"', Date="20", Server="other", Content_Length="0"), None),
        (5, "site.org/a?b=2&a=1", 40, "revisit", 304, h(etag='"1"'), None),
        (6, "site.org/a?b=2&a=1", 41, "revisit", 304, h(Date="41"), None),
        (7, "site.org/b", 50, "revisit", 304, None, None),
        (8, None, 50, "revisit", 304, h(ETag='"1"'), None),
        (9, "site.org/a?b=2&a=1", None, "revisit", 304, h(ETag='"1"'), None),
        (9, "site.org/a?b=2&a=1", None, "revisit", 304, h(ETag='"1"'), None),
    ]
    schema = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string"
    found = warc_revisits.resolve_revisits(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 7
    by = {r.record_id: r for r in found}
    assert (by[4].source_id, by[4].outcome, by[4].digest) == (1, "resolved", "d1")
    assert by[4].headers == {"etag": 'W/"1"', "date": "20", "server": "s"}
    assert (by[5].source_id, by[5].outcome, by[5].headers) == (2, "mismatch", None)
    assert by[6].outcome == "unverified" and by[7].outcome == by[8].outcome == by[9].outcome == "no_response"
    assert warc_revisits.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_one_url_in_many_stretches(spark):
    rows = spark.range(3000).select(F.col("id").alias("ts"), F.lit("u").alias("key"))
    points, probes = rows.where("ts % 7 = 0"), rows.where("ts % 5 = 0")
    from ratiospark.llm.workspace import Workspace

    for r in warc_revisits.latest_earlier(Workspace(spark), probes, points, rows_each=10).collect():
        assert r.point_ts == ((r.ts - 1) // 7 * 7 if r.ts > 0 else None)


def test_spans_of_a_text_with_many_matches(spark):
    """Time in proportion to the matches: 60,000 addresses, and overlapping kinds, in one text."""
    import time

    began = time.perf_counter()
    texts = ["192.168.1.1," * 60_000, "a@b.co +1 (974) 555-3436;é🎉" * 20_000, "Zarathu a@b.co " * 3000]
    texts += [f"Zarathu {k} at z@corp.org" for k in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_spans(df)
    rows = {r.doc_id: r for r in pii.span_report(found).collect()}
    assert (rows[0].n_ip, rows[1].n_email, rows[1].n_phone) == (60_000, 20_000, 20_000)
    for k in (0, 1, 2):
        assert rows[k].base_sha256 == hashlib.sha256(spans_by_definition(texts[k]).encode()).hexdigest()
    safe = {r.doc_id: r.text for r in pii.sanitise(found, df.columns).collect()}
    assert safe[0] == "[IP]," * 60_000 and safe[1] == "[EMAIL] [PHONE];é🎉" * 20_000
    assert time.perf_counter() - began < 120


def test_terms_against_brute_force(spark):
    """Spans of secrets and of terms on the given documents, the PMI taken from its definition."""
    from collections import Counter, defaultdict
    from math import log2

    sf, plan = "/root/testdata/sf0.01", pii.PiiPlan(everywhere=True, secrets=True)
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    word = re.compile(r"[^\W\d_]{3,}")
    secret = lambda t: [m for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}", t) if 4 <= sum(c.isdigit() for c in m[0]) <= len(m[0]) - 4]
    held, with_term, both = defaultdict(set), Counter(), defaultdict(set)
    for d, text in docs:
        for kind, p in PATTERNS:
            if any(valid(kind, m[0]) for m in re.finditer(p, text)):
                held[d].add(kind)
        if secret(text):
            held[d].add("secret")
        with_term.update(set(word.findall(text.lower())))
    share = Counter(k for ks in held.values() for k in ks)
    text_of = dict(docs)
    for d, kinds in held.items():
        plain = re.sub(PATTERNS[0][1], " ", text_of[d])
        plain = re.sub(r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}", " ", plain)
        for t in set(word.findall(plain.lower())):
            for k in kinds:
                both[t, k].add(d)
    telling = set()
    for (t, k), found in both.items():
        pmi = log2(len(found) / with_term[t] / (share[k] / len(docs)))
        if len({text_of[d] for d in found}) >= plan.kind_support and log2(len(docs) / share[k]) - pmi <= plan.residual_bits:
            telling.add(t)
    assert telling == {"token"}
    rows = pii.span_report(pii.find_spans(spark.read.parquet(f"{sf}/documents.parquet"), plan)).collect()
    for r in rows:
        text = text_of[r.doc_id]
        want = sum(1 for m in word.finditer(text.lower()) if m[0] in telling)
        spans = r.spans.split(",")
        assert sum(s.startswith(("term:", "removed_term:")) for s in spans) == want
        assert [s for s in spans if s.startswith("secret:")] == [f"secret:{m.start()}:{m.end()}" for m in secret(text)]


# Components and the screen.


def test_components_of_a_long_chain(spark):
    """5,000 revisions in a chain, a star, a zigzag and a ring, in few rounds."""
    from ratiospark.llm.workspace import Workspace

    edges = [(k, k + 1) for k in range(5000)] + [(10_000 + k, 20_000) for k in range(300)]
    edges += [(30_000 + min(a, b), 30_000 + max(a, b)) for a, b in ((k // 2 if k % 2 == 0 else 999 - k // 2, (k + 1) // 2 if k % 2 else 999 - (k + 1) // 2) for k in range(900)) if a != b]
    edges += [(40_000 + k, 40_000 + (k + 1) % 50) for k in range(50)]
    work = Workspace(spark)
    saved = work.save(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long"))
    found = {r.id: r.label for r in near_dedup.components(work, saved).collect()}
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in [*edges, *edges[::-1]]:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert found == label
    assert work.count < 40


def test_one_id_with_two_texts(spark):
    words = lambda c: " ".join(f"{c}{k}x" for k in range(60))
    rows = [(5, words("a")), (5, words("b")), (7, words("a")), (3, words("b")), (9, words("c")), (9, words("c"))]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 6 and {r.doc_id: r.component_id for r in found} == {5: 3, 7: 3, 3: 3, 9: 9}


def test_screen_passes_links_at_the_threshold():
    """Sets of similarity 0.75, the least of a link: a screen that fails one in 100,000 passes all of these."""
    rng, plan = np.random.default_rng(5), near_dedup.DedupPlan()
    seeds = near_dedup._mix(np.arange(1, 2 * plan.bits + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    a, b = (seeds[0::2] | np.uint64(1))[:, None], seeds[1::2][:, None]
    sketch = lambda s: near_dedup._mix((a * s[None] + b).min(axis=1)) & np.uint64(1)
    # 225 shared, 35 of each side: 225 / 295, just above it.
    worst = max(int((sketch(x[:260]) != sketch(np.concatenate([x[:225], x[260:295]]))).sum()) for x in (rng.integers(0, 2**63, 295, dtype=np.uint64) for _ in range(300)))
    assert worst <= plan.bits * (100 - plan.screen) // 200


def test_tiles_meet_every_pair_of_blocks(spark):
    """A dense cluster compared in small tiles gives the same groups."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = rng.choices(vocabulary, k=70)
    docs = [" ".join(passage + rng.choices(vocabulary, k=rng.randrange(5, 40))) for _ in range(200)]
    rows = list(enumerate(docs))
    plan = near_dedup.DedupPlan(linear=0, block=8, tile=3)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), plan).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in found} == brute_components(rows)


# Overlaps that substitutions divide.


def brute_overlap(text, words, identity=0.7, tokens=13, coverage=0.6):
    """Some stretch of some diagonal is alike enough: all stretches tried."""
    for line in range(-len(words) + 1, len(text)):
        low, high = max(0, -line), min(len(words), len(text) - line)
        same = [text[k + line] == words[k] for k in range(low, high)]
        total = np.concatenate([[0], np.cumsum(same)])
        n = total[None, :] - total[:, None]
        length = np.arange(len(total))[None, :] - np.arange(len(total))[:, None]
        if ((length > 0) & (n >= identity * length - 1e-9) & ((n >= tokens) | (n >= coverage * len(words)))).any():
            return True
    return False


def test_longest_stretch_by_definition():
    rng = np.random.default_rng(4)
    for _ in range(300):
        same = rng.random(rng.integers(1, 40)) < rng.random()
        start, end, n = decontamination.longest_stretch(same, 0.7)
        every = [(int(same[i:j].sum()), i - j, -i) for i in range(len(same) + 1) for j in range(i, len(same) + 1) if 10 * int(same[i:j].sum()) >= 7 * (j - i)]
        most, short, first = max(every)
        assert (n, start - end) == (most, short) and n == same[start:end].sum()


def test_overlaps_against_brute_force(spark):
    rng = random.Random(21)
    vocabulary = [f"v{k}" for k in range(400)]
    items = {k: rng.choices(vocabulary, k=n) for k, n in enumerate([60, 60, 40, 14, 8, 120])}
    docs = {}
    for k in range(160):
        words = list(items[k % 6])
        begin = rng.randrange(max(1, len(words) - 13))
        piece = words[begin : begin + rng.choice([9, 13, 20, 38, 60])]
        if k % 4 == 1 and len(piece) > 36:
            piece[13:25] = rng.choices(vocabulary, k=12)
        elif k % 4 > 1:
            share = rng.choice([0.05, 0.1, 0.2, 0.3])
            piece = [rng.choice(vocabulary) if rng.random() < share else w for w in piece]
        docs[k] = rng.choices(vocabulary, k=rng.randrange(30)) + piece + rng.choices(vocabulary, k=rng.randrange(30))
    # Two equal passages of 13 words around 12 others.
    docs[500] = items[0][:13] + rng.choices(vocabulary, k=12) + items[0][25:38]
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.overlaps(frame, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()}
    want = {(d, i) for d, text in docs.items() for i, words in items.items() if brute_overlap(text, words)}
    assert found <= want and (500, 0) in found and len(found) >= 0.95 * len(want) > 50
    # Equal passages of 13 words are all found.
    runs = {(d, i) for d, text in docs.items() for i, words in items.items() if any(text[a : a + 13] == words[b : b + 13] for a in range(len(text) - 12) for b in range(len(words) - 12))}
    assert runs <= found


def test_recall_by_identity():
    """Share of overlaps of 40 tokens, at 0.7 to 1 of their tokens equal, in which a seed is equal."""
    rng, plan = np.random.default_rng(9), decontamination.SeedPlan()
    for identity in (0.7, 0.75, 0.8, 0.9, 1.0):
        hit = 0
        for _ in range(400):
            same = rng.permutation(40) < round(40 * identity)
            hit += any(all(same[a + k] for k, c in enumerate(m) if c == "1") for m in plan.masks for a in range(40 - len(m) + 1))
        assert hit / 400 >= 0.98


def test_tokens_beyond_ascii():
    same = lambda a, b: decontamination.tokens(a).tolist() == decontamination.tokens(b).tolist()
    assert same("“Für” — die ‘größte’ Zahl…", "für die GRÖSSTE zahl".replace("ss", "ß").replace("SS", "ß"))
    assert len(decontamination.tokens("漢字かな交じり文")) == 8 and len(decontamination.tokens("naïve café")) == 2


# Pages as they come.


def test_parsing_takes_time_in_proportion():
    import time

    pages = ["<script" * 140_000, "<a \"" * 250_000, "<a x=\"" * 160_000 + ">", "<p><" + "a='" * 300_000, "<a x=\"<b y='" * 80_000 + ">", "<div>" * 200_000 + "</p>" * 250_000, "<div>" * 200_000, "<svg>" * 200_000, "<!--" * 250_000, "<!" * 500_000, "</script" * 120_000, "<script>" + "</script" * 120_000, "<" * 1_000_000, "<nav>" * 200_000 + "<article>", "<p class=menu>" * 70_000, "<a b='" + "x' c='" * 150_000]
    for page in pages:
        began = time.perf_counter()
        html_extraction.extract(page, {})
        assert time.perf_counter() - began < 20, page[:20]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>one</p><svg/><p>two</p></article>", "one\ntwo"),
        ("<article><p>one</p><svg class=i/><p>two</p></article>", "one\ntwo"),
        ("<article><p>one</p><svg-icon name=x></svg-icon><p>two</p><template-part>three</template-part></article>", "one\ntwo\nthree"),
        ("<article><p>one</p><svg><title>no</title><text>no</text></svg><p>two</p></article>", "one\ntwo"),
        ("<div class='has-sidebar'><p>one two</p><p>three</p></div><div class=sidebar><p>no</p></div>", "one two\nthree"),
        ("<div class='comments-open no-ads'><h1>one</h1><p>two three</p></div>", "one\ntwo three"),
        ("<div class='layout-sidebar'><h1>one</h1><p>two three four five</p><div class=sidebar>no</div></div>", "one\ntwo three four five"),
        ("<form id=page><header>no</header><h1>one</h1><p>two three four</p><footer>no</footer></form>", "one\ntwo three four"),
        ("<article><p>one two three</p></article><section id=comments><article><p>no no</p></article><article class=comment><p>no no no no no no</p></article></section>", "one two three"),
        ("<article><p>one two three</p><article class='comment'><p>no</p></article></article>", "one two three"),
        ("<aside><article><p>no</p></article></aside><article><p>one two</p></article>", "one two"),
        ("<nav><a>no</a><article><p>one two</p></article>", "one two"),
        ("<p>one <a title=it's>two</a> three isn't > four</p>", "one two three isn't > four"),
        ("<p>one <img alt='a > b < c'> two</p>", "one two"),
    ],
)
def test_wrappers_marks_and_raw_elements(page, text):
    assert html_extraction.extract(page, {}) == text


def test_pages_without_an_article_element(spark):
    """Made pages in other markup than the given ones, weights learned from some that name their main part."""
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choices([f"w{k}" for k in range(300)], k=n))
    rows, want = [], {}
    for k in range(300):
        blocks = [words(rng.randrange(8, 60)) for _ in range(rng.randrange(2, 6))]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        outer = [("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div id=post><section>", "</section></div>"), ("<td class=text>", "</td>")][k % 5]
        menu = "".join(f"<li><a href=/{j}>{words(2)}</a></li>" for j in range(8))
        page = f"<html><head><title>{words(4)}</title></head><body><nav><ul>{menu}</ul></nav><div class='ad banner'>{words(6)}</div>{outer[0]}{body}{outer[1]}<div class=comments><p>{words(25)}</p></div><footer>{words(5)}</footer></body></html>"
        rows.append((k, f"u{k}", page, "x"))
        want[k] = "\n".join(blocks)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {r.page_id: r.text for r in html_extraction.main_texts(pages).collect()}
    assert found == want


# Certified cutoffs.


def test_certified_cutoffs_against_brute_force(spark):
    """Two languages with enough labels, one with too few; the path, the counts and the exact tails from their definitions."""
    from math import comb

    rng, plan = random.Random(6), quality_rules.RiskPlan(risk=0.01)
    docs, labels = [], []
    for k in range(4000):
        lang = "en" if k % 2 else "de" if k % 16 else "fr"
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}x" for _ in range(30)]
        for j in range(rng.choice([0] * 30 + [1, 2, 4, 9]) if lang == "en" else rng.choice([0] * 300 + [3])):
            words[j] += "###"
        if rng.random() < 0.004:
            words[5] += "!" * rng.randrange(1, 60)
        docs.append((k, " ".join(words), lang))
        labels.append((k, int(k % 5 != 0), 0))
    rows = quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), plan).collect()
    values = {}
    for d, text, lang in docs:
        n, chars, symbols, dup, repeat = counts_by_definition(text)
        values[d] = (1000 * symbols // chars, 1000 * text.count("!") // n, 0, 1000 * repeat // n, 1000 * chars // n)
    aside = lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:7], 16) % 4 == 0
    limits, used = {}, set()
    for lang in ("en", "de", "fr"):
        clean = [values[d] for d, _, x in docs if x == lang and d % 5 and not aside(d)]
        first = [values[d] for d, _, x in docs if x == lang and d % 5 and aside(d)]
        path = sorted((sum(v[p] > c for v in first), level, p, c) for p, cuts in enumerate(plan.cutoffs.values()) for level, c in enumerate(cuts))
        limits[lang] = {}
        for i, (_, _, p, c) in enumerate(path):
            k, n = sum(any(v[q] > x for _, _, q, x in path[: i + 1]) for v in clean), len(clean)
            if sum(comb(n, j) * plan.risk**j * (1 - plan.risk) ** (n - j) for j in range(k + 1)) > plan.delta / 3:
                used.add(lang)
                break
            limits[lang][p] = min(c, limits[lang].get(p, c))
        assert sum(any(v[q] > x for q, x in limits[lang].items()) for v in clean) <= plan.risk * len(clean)
    assert limits["en"] and limits["de"] and limits["en"] != limits["de"] and not limits["fr"] and "en" in used
    lang_of = {d: x for d, _, x in docs}
    assert {r.doc_id: r.kept for r in rows} == {d: not any(v[p] > c for p, c in limits[lang_of[d]].items()) for d, v in values.items()}
    assert any(not r.kept for r in rows)


def test_scores_against_brute_force(spark):
    """Scores by another route: vectors of plain Python sums, features word by word, the same fit, one forward pass a text."""
    from collections import Counter
    from zlib import crc32

    rng = random.Random(3)
    plan = quality_model.ModelPlan(buckets=256, dims=8, nonzero=2, epochs=4, hidden=6)
    good, bad = [f"word{k}" for k in range(60)], [f"junk{k}" for k in range(30)]
    texts = {k: " ".join(rng.choices(good if k % 2 else bad, k=rng.randrange(1, 40))) for k in range(300)} | {300: "", 301: None}
    labels = {k: k % 2 for k in range(260)}
    found = quality_model.quality_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), spark.createDataFrame([(d, y, 0) for d, y in labels.items()], "doc_id long, quality int, toxic int"), plan)
    got = {r.doc_id: r for r in found.collect()}
    place, sign = quality_model.index_vectors(plan)
    table = [[0.0] * 8 for _ in range(256)]
    rows = {d: quality_model.word_rows(t, plan).tolist() for d, t in texts.items()}
    for words in rows.values():
        for i, w in enumerate(words):
            for x in words[max(0, i - 2) : i] + words[i + 1 : i + 3]:
                for p, v in zip(place[x], sign[x], strict=True):
                    table[w][p] += v
    table = np.array(table)
    table = table - np.outer(np.abs(table).sum(axis=1), table.sum(axis=0) / np.abs(table).sum())
    norm = np.linalg.norm(table, axis=1)
    table = table / np.where(norm > 0, norm, 1)[:, None]

    def described(d):
        words = rows[d]
        if not words:
            return np.zeros(20)
        picked, n = np.array([table[w] for w in words]), len(words)
        mean = picked.mean(axis=0)
        spread = np.sqrt(np.maximum((picked**2).mean(axis=0) - mean**2, 0))
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n - 1)
        return np.array([*mean, *spread, np.log(1 + n), len(Counter(words)) / n, repeats, 0])

    assert all(got[d].held_out == (crc32(str(d).encode()) % 3 == 1) for d in texts)
    # The fit reads its rows in the order of a hash of Spark's.
    order = [r.doc_id for r in spark.createDataFrame([(d,) for d in labels if crc32(str(d).encode()) % 3 != 1], "doc_id long").orderBy(F.xxhash64("doc_id", F.lit(plan.seed)), "doc_id").collect()]
    net = quality_model.fit(np.array([described(d) for d in order], dtype=np.float32), np.array([labels[d] for d in order]), plan)
    w1, b1, w2, b2 = net.weights
    for d in texts:
        logit = sum(np.tanh(sum((x - m) / s * w for x, m, s, w in zip(described(d), net.mean, net.scale, col, strict=True)) + b) * v for col, b, v in zip(w1.T, b1, w2, strict=True)) + b2[0]
        assert got[d].score == pytest.approx(1 / (1 + np.exp(-logit / net.temperature)), abs=2e-3)
        assert got[d].predicted == int(got[d].score >= 0.5)


def test_revisits_with_other_columns_and_long_values(spark):
    """Columns named like the operator's own, very long URLs and headers, ties and repeated rows."""
    long = "http://site.org/" + "p" * 40_000
    rows = [
        (1, long, 10, "response", 200, {"ETag": '"1"', "X": "v" * 50_000}, "d1", "k", 7, "s"),
        (2, long + "/", 10, "response", 200, {"ETag": '"2"'}, "d2", None, None, None),
        (3, long, 20, "revisit", 304, {"etag": '"2"'}, None, "k", 8, "s"),
        (3, long, 20, "revisit", 304, {"etag": '"2"'}, None, "k", 8, "s"),
        (4, long, 10, "revisit", 304, {"etag": '"2"'}, None, "k", 8, "s"),
        (5, long, 20, None, None, None, None, None, None, None),
    ]
    schema = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string, key string, stretch int, source string"
    found = warc_revisits.resolve_revisits(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.record_id, r.source_id, r.outcome) for r in found) == [(3, 2, "resolved"), (3, 2, "resolved"), (4, None, "no_response")]


def test_extra_columns_with_the_operators_names(spark):
    """Each operator reads the columns it is told of, whatever others are called."""
    names = ["bits", "label", "half", "print", "key", "row", "spans", "terms", "x", "score", "stratum", "tokens", "line", "n_words", "values"]
    docs = spark.createDataFrame([(1, "write to me@site.org now please and soon", "en"), (2, None, None)], "doc_id long, text string, lang string").selectExpr("*", *(f"doc_id AS {n}" for n in names))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").selectExpr("*", "doc_id AS text", "doc_id AS y")
    items = spark.createDataFrame([(1, "nothing of that kind at all here", 3)], "item_id long, text string, seed long")
    assert near_dedup.near_duplicates(docs).count() == 2 and quality_rules.judge(docs, labels).count() == 2
    assert quality_model.quality_scores(docs, labels, quality_model.ModelPlan(buckets=64, dims=4, epochs=1)).count() == 2
    assert decontamination.overlaps(docs, items).count() == 0
    safe = pii.sanitise(pii.find_spans(docs), docs.columns)
    assert safe.columns == docs.columns and safe.where("text LIKE '%[EMAIL]%' AND row = 1").count() == 1
