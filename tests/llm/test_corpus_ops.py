"""Line deduplication, lexical search and the Merkle manifest, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from ratiospark.llm import lexical_search, line_dedup, merkle, pii, quality_rules
from ratiospark.llm.workspace import Workspace

# Lines.


def brute_lines(rows, least=10):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    order = lambda d: (d is None, d or 0)
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or doc == min(held[key(x)], key=order)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows(spark, rows, plan):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in line_dedup.line_report(line_dedup.dedup_lines(docs, plan)).collect()), key=repr)


def test_lines_of_other_documents_go(spark):
    rng = random.Random(8)
    pool = [f"line number {k} of the pool" for k in range(60)] + ["short", "çéöüñßæøåđ", "éééé", "A Line\tof CAPITALS", " a line\tof capitals\r", " kept apart by a wide blank", ""]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)) + [f"only in document {k}, once"])) for k in rng.sample(range(10**6), 150)]
    rows += [(None, pool[0] + "\nonly in the nameless"), (None, "only in the nameless\n" + "x" * 50), (3, None), (4, ""), (5, "\n\n"), (7, "twice in one text\ntwice in one text"), (8, "of one id, two texts"), (8, "of one id, two texts\nand more"), (8, "of one id, two texts")]
    for plan in (line_dedup.LinePlan(), line_dedup.LinePlan(max_bits=1 << 7), line_dedup.LinePlan(hot_rows=3)):
        assert line_rows(spark, rows, plan) == brute_lines(rows)


def test_second_filter_misses_no_repeat():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    maps = []
    for part in (keys[:2000], keys[1500:]):
        once, twice = np.zeros((2, 1024), dtype=np.uint64)
        for some in np.array_split(part, 7):
            line_dedup.enter(once, twice, line_dedup._places(some, 1 << 16, 2).ravel())
        maps.append((once, twice))
    twice = maps[0][1] | maps[1][1] | (maps[0][0] & maps[1][0])
    held = np.ones(len(keys), dtype=bool)
    for at in line_dedup._places(keys, 1 << 16, 2):
        held &= (twice[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    assert held[1500:2000].all()
    assert held.mean() < 0.25


def test_lines_of_odd_rows(spark, odd_docs):
    out = line_dedup.dedup_lines(odd_docs.withColumnRenamed("key", "n_lines"))
    assert sorted(out.columns) == sorted([c for c in odd_docs.columns if c != "key"] + ["n_lines", "n_dropped"])
    rows = out.collect()
    assert len(rows) == 8
    assert [r.text for r in rows if r.doc_id == 3] == [None]
    # The repeated row is one document; the null id comes last and loses the line.
    assert [(r.n_dropped, r.text) for r in rows if r.doc_id is None] == [(1, "")]
    assert all(r.n_dropped == 0 for r in rows if r.doc_id is not None)
    assert line_dedup.line_report(line_dedup.dedup_lines(odd_docs.limit(0))).count() == 0


# Search.


def brute_ranks(docs, items, k=20):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(d, Counter(words(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(w for _, c in counts for w in c)
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(words(text))
    out = []
    for item, query in asked.items():
        scores = []
        for (d, c), n in zip(counts, sizes, strict=True):
            m = 75 + (25 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * q * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in query.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def test_ranks_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)] + ["Été", "naïve", "x1"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 120)))) for k in rng.sample(range(10**6), 700)]
    docs += [(k + 2 * 10**6, t) for k, t in docs[:40]]  # equal scores
    docs += [(None, docs[0][1]), (1, None), (2, ""), (3, "... !"), (4, "W1-w2_w3"), (5, "w1 w2 w3"), (5, "w1 w2 w3")]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30)))) for k in range(25)] + [(30, "w1 w1 w1"), (31, "nowhere"), (32, None), (33, "a b"), (33, "w2 été"), (33, "w2 été"), (None, "naïve X1")]
    table, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute_ranks(docs, items)
    for plan in (lexical_search.SearchPlan(), lexical_search.SearchPlan(shard=90, step=2, window=5, pairs=100)):
        assert sorted((tuple(r) for r in lexical_search.rank(table, asked, plan).collect()), key=repr) == want


def test_borders_are_the_best_ones():
    rng = np.random.default_rng(1)
    plan = lexical_search.SearchPlan(step=1, window=6, charge=50)
    lengths = np.array([1, 9, 2, 12, 5, 9])
    impacts = rng.integers(1, 60, lengths.sum())
    owner, end = lexical_search.block_borders(impacts, lengths, plan)
    at = 0
    for k, n in enumerate(lengths.tolist()):
        values, at = impacts[at : at + n], at + n

        def cost(borders, values=values):
            parts = [values[a:b] for a, b in zip([0, *borders], borders, strict=False)]
            return sum(50 + int((p.max() - p).sum()) for p in parts) if max(map(len, parts)) <= 6 else 1 << 60

        every = [[b for b in range(1, n) if m >> b & 1] + [n] for m in range(0, 1 << n, 2)]
        got = end[owner == k].tolist()
        assert got[-1] == n and cost(got) == min(map(cost, every))


def test_blocks_are_skipped(spark):
    rng = random.Random(6)
    common = [f"c{k}" for k in range(40)]
    docs = [(k, " ".join(rng.choices(common, k=200) + ([f"rare{k % 40}"] * (k < 80)))) for k in range(6000)]
    plan = lexical_search.SearchPlan()
    vocabulary = {w.encode(): k for k, w in enumerate(common + [f"rare{k}" for k in range(40)])}
    table = spark.createDataFrame([(d, t.encode()) for d, t in docs], "doc_id long, text binary")
    forward = Workspace(spark).save(lexical_search._forward(table, vocabulary).selectExpr("*", "doc_id AS row"))
    rows = lexical_search._index(forward, 6000, 6000 * 200, 1, plan).toArrow()
    shard = lexical_search.Shard(rows.combine_chunks())
    doc, _ = shard.best(np.array([3, 40]), np.array([700, 9000]), 2)
    assert sorted(doc.tolist()) == [0, 40]
    assert shard.scored < 0.2 * shard.held


def test_search_of_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "plain words"), (2, "LONG")], "item_id long, text string")
    rows = [tuple(r)[:3] for r in lexical_search.rank(odd_docs, items).orderBy("item_id", "rank").collect()]
    assert rows == [(1, 1, 1), (1, 2, 1), (1, 3, None), (2, 1, 5)]
    assert lexical_search.rank(odd_docs.limit(0), items).count() == lexical_search.rank(odd_docs, items.limit(0)).count() == 0


# Manifest.


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(nodes, fanout):
    """The root and each leaf's siblings."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for leaf, at in enumerate(places):
            run = runs[at // fanout]
            paths[leaf].append((run[: at % fanout], run[at % fanout + 1 :]))
        nodes, places = [sha("".join(r)) for r in runs], [at // fanout for at in places]
    return nodes[0], paths


def brute_audit(rows, fanout=16):
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, brute_leaf(row), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: brute_tree([leaf for _, _, leaf, _ in sorted(trees[s], key=lambda x: x[:3])], fanout) for s in names}
    root, upper = brute_tree([made[s][0] for s in names], fanout)
    out = []
    for at, s in enumerate(names):
        for (_, _, leaf, row), path in zip(sorted(trees[s], key=lambda x: x[:3]), made[s][1], strict=True):
            whole = path + upper[at]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            value = brute_leaf((*row[:4], lower(row[4]))) if hit else leaf
            for left, right in whole:
                value = sha("".join([*left, value, *right]))
            out.append((row[0], leaf, made[s][0], root, sha("".join(x for left, right in whole for x in left + right)), value, value == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["hot"] * 9 + ["b", "Z", "é", None, "", "lone"][:5]), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(["Some Text", "plain", "", None, "Ünï 1"])) for k in rng.sample(range(10**5), 700)]
    rows += [(1, "lone", "en", 3, "One"), (None, "hot", None, None, None), (None, "hot", None, None, None), (None, "hot", "en", 1, "Null Id"), (9, "b", "en", 1, "same"), (9, "b", "en", 1, "same"), (9, "b", "en", 1, "other")]
    rows += [(k, f"s{k % 40:02d}", "de", k, f"Text {k}") for k in range(-3, 60)]
    for fanout, parts in ((16, 5), (3, 2)):
        docs = spark.createDataFrame(rows, DOCS).repartition(parts)
        got = merkle.audit(docs, merkle.MerklePlan(fanout))
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_audit(rows, fanout)


def test_levels_of_the_store(spark):
    work = Workspace(spark)
    leaves = spark.range(1000).select(merkle.digest(merkle.F.col("id")).alias("digest"), "id")
    store = merkle.build(work, leaves.repartition(7), [], ["id"])
    assert [level.count() for level in store.levels] == [1000, 63, 4, 1]
    nodes = [sha(f"{len(str(k))}:{k}") for k in range(1000)]
    assert store.levels[3].first().digest == brute_tree(nodes, 16)[0]
    # One tree only, so its root is the root.
    assert store.root == store.levels[3].first().digest
    proof = merkle.proofs(store).where("id = 999").first()
    assert [(p.left, p.right) for p in proof.path] == [("".join(a), "".join(b)) for a, b in brute_tree(nodes, 16)[1][999]]


def test_manifest_of_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumn("n_chars", merkle.F.col("label").cast("long")).withColumnRenamed("label", "leaf").withColumnRenamed("key", "root")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in merkle.audit(docs).collect()), key=repr) == brute_audit(rows)
    lone = docs.where("doc_id = 7")
    row = merkle.audit(lone).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")
    assert merkle.audit(docs.limit(0)).count() == 0


# Rules with few labels, and what copies repeat.


def test_rules_are_certified_with_few_labels(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for k in range(1300):
        lang, junk = ("fr" if k % 4 == 0 else "en"), k % 5 == 0
        docs.append((k, " ".join(f"w{rng.randrange(10**6)}" + "#$%" * junk for _ in range(40)), lang))
        labels.append((k, int(not junk), 0))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = quality_rules.judge(docs, labels, quality_rules.RiskPlan())
    assert plain.where("NOT kept").count() == 0
    wider = quality_rules.judge(docs, labels, quality_rules.RiskPlan(wider=quality_rules.WIDER, slack=quality_rules.SLACK))
    assert {r.doc_id for r in wider.where("NOT kept").collect()} == {k for k in range(0, 1300, 5)}


def test_near_copies_are_one_vote(spark):
    rng = random.Random(10)
    plain = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + rng.choice("abcdefgh") for _ in range(40)) for _ in range(150)]
    report = "The zorblax report number {} for our unusual quimble words reached the office at mail box desk.one@site.org and the clerks of the lower house read all of it twice before they left for the day"
    true = ["Ask vexmorr about it {} " + plain[k] + " or write to pay.desk@bank.org then {}".format(k) for k in range(5)]
    texts = plain + [report.format(k) for k in (17, 18, 19)] + [t.format(k) for k, t in enumerate(true)] + ["an unrelated zorblax note", "an unrelated vexmorr note"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    terms = {}
    for families in (False, True):
        found = pii.find_spans(docs, pii.PiiPlan(everywhere=True, families=families))
        rows = found.select(merkle.F.explode("spans").alias("s")).where("s.kind IN ('term', 'removed_term')").select("s.value").distinct().collect()
        terms[families] = {r.value.lower() for r in rows}
    assert {"zorblax", "quimble", "vexmorr"} <= terms[False]
    assert "vexmorr" in terms[True] and not terms[True] & {"zorblax", "quimble", "clerks", "report", "unusual"}


def test_votes_of_families(spark):
    rng = random.Random(11)
    base = [f"word{rng.randrange(1000)}" for _ in range(120)]
    copies = [" ".join(w if j != 3 * k else f"changed{k}" for j, w in enumerate(base)) for k in range(30)]
    apart = [" ".join(f"other{rng.randrange(10**6)}" for _ in range(60)) for _ in range(20)] + ["", "two words"]
    rows = spark.createDataFrame(list(enumerate(copies + apart)), "key long, text string")
    vote = {r.key: r.vote for r in pii.votes(Workspace(spark), rows).collect()}
    assert len(vote) == 52 and all(vote[k] == 1 for k in range(30, 52))
    assert sum(vote[k] for k in range(30)) < 2.5
