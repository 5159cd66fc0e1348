"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

The patterns give base spans and, with ``secrets``, spans of access tokens.  Their
values are the protected entities, and so is what values share: an address's
account and domain, an ip's first two and three parts, a card's issuer, a phone
number without its last four digits, and each kind as a whole (that a document
holds a secret, say).  How strongly a term reveals an entity is estimated from the
corpus: with P(e | t) the share of the documents with t that mention e, the
pointwise mutual information is PMI(t; e) = log2(P(e | t) / P(e)), and e's own
information is IC(e) = -log2 P(e).  A term discloses e where at most
``residual_bits`` of IC(e) are left, IC(e) - PMI(t; e) = -log2 P(e | t), and where
``support`` different texts show the pair (``kind_support`` for a kind, which many
words meet by chance); an e whose IC is no more than that has nothing to disclose.
The term is then a span in every document that holds it (``everywhere``), or in
those that mention e: it is removed if it leaves under ``removed_bits``, else
generalised to a tag.

A text's matches are placed by running sums that are made in blocks, so time grows
in proportion to the text however many matches it has.

All on the main path are DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratiospark.llm.workspace import Workspace

#: Fixed patterns, in the order of kinds.  The guards before and the possessive
#: signs change no match: they keep a long run from being tried at each of its
#: characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An access token: at least 32 letters and digits, four of each.
SECRET = r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}+"
#: Cheap patterns without which a text has no match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "secret": "[A-Za-z0-9]{32}"}
KINDS = tuple(PATTERNS)
#: Ranks of spans beyond the base ones.
SECRET_RANK, TERM_RANK = len(KINDS), len(KINDS) + 1
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


@dataclass(frozen=True)
class PiiPlan:
    """``everywhere``: tag a term also in documents that do not mention the entity it discloses; ``secrets``: protect access tokens.

    ``families``: support counts votes in place of different texts.  A document
    whose shingle sketch others share has that part of a vote, so a group of near
    copies has about one vote together, and what copies repeat is no evidence.
    """

    support: int = 3
    kind_support: int = 10
    residual_bits: float = 1.0
    removed_bits: float = 0.15
    everywhere: bool = False
    secrets: bool = False
    families: bool = False


#: Bands of a document's sketch, and how many documents may share a band before its count is broadcast.
BANDS, HOT_ROWS, HOT_BANDS = 4, 4096, 250_000


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, step, zero: Column, block: int = 256) -> Column:
    """For each place of an array, ``step`` over all values before it; in blocks, since a step copies what it has so far."""

    def places(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, zero, step))
        return _let(places(totals, zero), lambda starts: F.flatten(F.transform(parts, lambda part, i: F.slice(places(part, F.get(starts, i)), F.lit(1), F.size(part)))))

    count = F.floor((F.size(values) - 1) / block).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count), lambda j: F.slice(values, j * block + 1, F.lit(block)))
    return F.when(F.size(values) > 0, _let(parts, joined)).otherwise(F.array().cast("array<int>"))


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("000"), x), -3, 3).cast("int") <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "secret":
        return F.length(digits).between(4, F.length(value) - 4)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(numbers, doubled), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def _placed(text: Column, pattern: str | Column, rank: int, kind: str) -> Column:
    """Spans of a pattern's matches, in order: their places follow from the lengths of matches and of the gaps between them."""

    def place(pair: Column) -> Column:
        gaps, hits = pair["gaps"], pair["hits"]
        lengths = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))

        def spans(before: Column) -> Column:
            start = lambda i: F.get(before, i) + F.length(F.get(gaps, i))
            return F.transform(hits, lambda h, i: F.struct(start(i).alias("start"), F.lit(rank).alias("rank"), (start(i) + F.length(h)).alias("end"), F.lit(kind).alias("kind"), h.alias("value")))

        return _let(_running(lengths, lambda a, x: a + x, F.lit(0)), spans)

    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pair = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))
    return _let(pair, place).cast(SPAN)


def _spans_of(text: Column, kind: str) -> Column:
    """A kind's valid spans, in order."""
    pattern, rank = (SECRET, SECRET_RANK) if kind == "secret" else (PATTERNS[kind], KINDS.index(kind))
    spans = F.filter(_placed(text, pattern, rank, kind), lambda s: _valid(kind, s["value"]))
    return F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column, secrets: bool = False) -> Column:
    """Spans (``SPAN``) of the patterns, by start, then kind; code points, end exclusive."""
    kinds = (*KINDS, "secret") if secrets else KINDS
    return F.sort_array(F.concat(*(_spans_of(text, kind) for kind in kinds)))


def located(docs: DataFrame, id_col: str, text_col: str, secrets: bool = False) -> DataFrame:
    """``docs`` as ``row``, with a ``key`` for each, doc_id and base ``spans``; the text is only in the row."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    spans = base_spans(_text(text_col), secrets)
    return rows.select("row", F.monotonically_increasing_id().alias("key"), F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), spans.alias("spans"))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0))


def _entities(s: Column) -> Column:
    """What a span mentions: its value and what other values can share with it."""
    low, digits = F.lower(s["value"]), F.regexp_replace(s["value"], "[^0-9]", "")
    named = lambda name, value: F.concat(F.lit(f"{name}:"), value)
    of = {
        "email": (named("email", low), named("account", F.substring_index(low, "@", 1)), named("domain", F.substring_index(low, "@", -1))),
        "ip": (named("ip", low), named("net", F.substring_index(low, ".", 3)), named("net", F.substring_index(low, ".", 2))),
        "card": (named("card", digits), named("issuer", F.left(digits, F.lit(6)))),
        "phone": (named("phone", digits), named("block", F.left(digits, F.length(digits) - 4))),
        "secret": (named("secret", s["value"]),),
    }
    return F.coalesce(*(F.when(s["kind"] == kind, F.array(*names)) for kind, names in of.items()))


def _kinds() -> Column:
    return F.array_distinct(F.transform("spans", lambda s: F.concat(F.lit("kind:"), s["kind"])))


def _bands(text: Column) -> Column:
    """A sketch of the shingles of five words: for each band a hash of two minima, which near copies share and others don't."""

    def of(words: Column) -> Column:
        shingles = F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))).otherwise(F.array(F.xxhash64(words)))
        # Each minimum is over the hashes in an order of its own, so short texts have all of them.
        least = lambda h, k: F.array_min(F.transform(h, lambda x: x.bitwiseXOR(F.xxhash64(F.lit(k)))))
        return _let(shingles, lambda h: F.array(*(F.xxhash64(F.lit(k), least(h, 2 * k), least(h, 2 * k + 1)) for k in range(BANDS))))

    return _let(F.split(F.lower(text), r"\s+"), of)


def votes(work: Workspace, rows: DataFrame) -> DataFrame:
    """(key, vote) of rows (key, text): 1 over the number of rows with the commonest band of the row.

    Counts of bands that very many rows share are broadcast, so that no task gathers those rows.
    """
    bands = work.save(rows.select("key", F.explode(_bands(F.col("text"))).alias("band")))
    common = work.save(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    hot = max(HOT_ROWS, bands.saved_rows // HOT_BANDS)
    told = bands.join(F.broadcast(common.where(F.col("n") > hot).withColumnRenamed("n", "hot")), "band", "left")
    rare = told.where("hot IS NULL").join(common.where(F.col("n") <= hot), "band", "left").select("key", F.coalesce("n", F.lit(1)).alias("n"))
    every = rare.unionByName(told.where("hot IS NOT NULL").select("key", F.col("hot").alias("n")))
    return work.save(every.groupBy("key").agg((1 / F.max("n")).alias("vote")))


def disclosing_pairs(work: Workspace, base: DataFrame, plan: PiiPlan, rows: int) -> tuple[DataFrame, DataFrame]:
    """(key, entity) of the mentions, and (entity, term, bits) of the terms that disclose one.

    ``base`` has all documents, ``rows`` of them, with key, text and spans.
    """
    spanned = base.where(F.size("spans") > 0)
    # What supports a pair: different texts, or votes.
    counted = (lambda df: df.join(voted, "key")) if plan.families else (lambda df: df)
    voted = votes(work, spanned) if plan.families else None
    support = (F.sum("vote") + 1e-9) if plan.families else F.count_distinct("print")
    mentions = work.save(counted(spanned.select("key", F.xxhash64("text").alias("print"), F.explode(F.array_distinct(F.flatten(F.transform("spans", _entities)))).alias("entity"))))
    # Fewer texts can't support a pair; an entity in more documents leaves no more than the bound by itself.
    known = mentions.groupBy("entity").agg(support.alias("texts"), F.count("*").alias("mentions")).where(F.col("texts") >= plan.support)
    hidden = F.log2(F.lit(float(rows)) / F.col("mentions")) > plan.residual_bits
    shared = work.save(mentions.join(known.where(hidden).select("entity", "mentions"), "entity"))
    # All terms are counted, and written, before any is looked up: one row a term meets the join.
    often = work.save(base.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("docs")).where(F.col("docs") >= plan.support))
    words = F.array_distinct(_words(F.regexp_replace(F.regexp_replace("text", PATTERNS["email"], " "), SECRET if plan.secrets else r"\z", " ")))
    held = spanned.join(shared.groupBy("key").agg(F.max("mentions").alias("most")), "key").select("key", "most", F.explode(words).alias("term"))
    enough = lambda most: F.col(most) >= F.col("docs") * 2.0 ** -plan.residual_bits * (1 - 1e-9)
    held = work.save(held.join(often, "term").where(enough("most")).select("key", "term", "docs"))
    pairs = shared.join(held, "key").where(enough("mentions")).groupBy("entity", "term", "docs").agg(support.alias("texts"), F.count("*").alias("both")).where(F.col("texts") >= plan.support)
    # Kinds are few and in many documents: their pairs are counted before any row is kept.
    kinds = work.save(spanned.select("key", F.explode(_kinds()).alias("entity")))
    common = work.save(kinds.groupBy("entity").agg(F.count("*").alias("mentions")).where(hidden & (F.col("mentions") >= plan.kind_support)).select("entity"))
    met = spanned.select("key", F.xxhash64("text").alias("print"), F.explode(_kinds()).alias("entity"), words.alias("words")).join(F.broadcast(common), "entity", "left_semi")
    met = met.select("key", "print", "entity", F.explode("words").alias("term"))
    likely = work.save(met.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= plan.kind_support).join(often, "term").where(enough("both")))
    if likely.saved_rows:
        texts = counted(met.join(likely.select("entity", "term"), ["entity", "term"], "left_semi")).groupBy("entity", "term").agg(support.alias("texts"))
        pairs = pairs.unionByName(likely.join(texts, ["entity", "term"]).where(F.col("texts") >= plan.kind_support).select(*pairs.columns))
    left = F.greatest(F.lit(0.0), F.log2(F.col("docs") / F.col("both")))
    telling = work.save(pairs.withColumn("bits", left).where(F.col("bits") <= plan.residual_bits).select("entity", "term", "bits"))
    return shared.select("key", "entity").unionByName(kinds), telling


def revealing_terms(work: Workspace, base: DataFrame, plan: PiiPlan, rows: int) -> DataFrame:
    """(key, terms): for each document, the terms to tag, with what they leave of an entity."""
    mentions, telling = disclosing_pairs(work, base, plan, rows)
    if plan.everywhere:
        bits = telling.groupBy("term").agg(F.min("bits").alias("bits"))
        # Not a row of a text without a term is written.
        found = base.select("key", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).join(bits, "term") if telling.saved_rows else bits.selectExpr("0L AS key", "term", "bits").limit(0)
    else:
        found = mentions.join(telling, "entity").groupBy("key", "term").agg(F.min("bits").alias("bits"))
    return work.save(found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "bits"))).alias("terms")))


def _with_terms(rows: DataFrame, plan: PiiPlan) -> DataFrame:
    """Adds the spans of the terms to those of the patterns, in order."""

    def spans(kind: str, chosen: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform(chosen, lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
        return F.when(F.size(chosen) > 0, _placed(F.col("text"), pattern, TERM_RANK, kind)).otherwise(F.array().cast(SPAN))

    removed = F.filter("terms", lambda t: t["bits"] < plan.removed_bits)
    tagged = F.filter("terms", lambda t: t["bits"] >= plan.removed_bits)

    def apart(both: Column) -> Column:
        """Without the terms inside an address or the like, which are covered already."""
        is_term = lambda s: s["rank"] == TERM_RANK
        ends = F.transform(both, lambda s: F.when(is_term(s), 0).otherwise(s["end"]))
        starts = F.transform(F.reverse(both), lambda s: F.when(is_term(s), 2**31 - 1).otherwise(s["start"]))
        before = _running(ends, lambda a, x: F.greatest(a, x), F.lit(0))
        after = F.reverse(_running(starts, lambda a, x: F.least(a, x), F.lit(2**31 - 1)))
        edges = F.struct(before.alias("before"), after.alias("after"))
        return _let(edges, lambda e: F.filter(both, lambda s, i: ~is_term(s) | ((F.get(e["before"], i) <= s["start"]) & (F.get(e["after"], i) >= s["end"]))))

    both = _let(F.sort_array(F.concat("spans", spans("removed_term", removed), spans("term", tagged))), apart)
    return rows.withColumn("spans", F.when(F.col("terms").isNotNull(), both).otherwise(F.col("spans")))


def find_spans(docs: DataFrame, plan: PiiPlan = PiiPlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``row``, with doc_id, text and all ``spans`` (``SPAN``).

    Null texts count as empty.  Repeated rows and rows with a null id each get
    their spans; for the support of a pair, equal texts count once.  Spans with the
    same start stand in the order of kinds.  Other columns, whatever their names,
    stay in ``row``.  An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession)
    saved = work.save(located(docs, id_col, text_col, plan.secrets))
    base = saved.withColumn("text", _text(text_col))
    terms = revealing_terms(work, base, plan, saved.saved_rows)
    work.keep(saved, terms)
    return _with_terms(base.join(terms, "key", "left"), plan).select("row", "doc_id", "spans", "text")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_report(found: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, the digest of the base spans, and all spans."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    return found.select("doc_id", *(of(k) for k in KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitise(found: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The rows with each span replaced: a tag by kind, nothing for removed terms; overlapping spans give one tag.

    A text is cut into blocks, so that a place is found without reading all before it.
    """
    size = 1024

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        """Characters a to b."""
        i, j = (F.floor(x / size).cast("int") for x in (a, b))
        block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
        apart = F.concat(F.substring(block(i), a % size + 1, F.lit(size)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.substring(block(j), F.lit(1), b % size))
        return F.when(i == j, F.substring(block(i), a % size + 1, b - a)).otherwise(apart)

    def masked(state: Column) -> Column:
        blocks, before = state["blocks"], state["before"]
        tag = lambda s: F.when(s["kind"] == "removed_term", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        pieces = F.transform("spans", lambda s, i: F.when(s["start"] >= F.get(before, i), F.concat(cut(blocks, F.get(before, i), s["start"]), tag(s))).otherwise(""))
        rest = cut(blocks, F.array_max(F.transform("spans", lambda s: s["end"])), F.length("text"))
        return F.concat(F.array_join(pieces, ""), rest)

    ends = F.transform("spans", lambda s: s["end"])
    state = F.struct(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)).alias("blocks"), _running(ends, lambda a, x: F.greatest(a, x), F.lit(0)).alias("before"))
    text = F.when(F.size("spans") > 0, _let(state, masked)).otherwise(F.col(f"row.`{text_col}`"))
    return found.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns))
