"""Quality rules whose cutoffs are chosen under a guaranteed risk of false rejection.

A rule rejects a document whose value (in thousandths, below) exceeds a cutoff.
What is certified, for each stratum (language), is all rules together.  A quarter
of the labelled clean documents, set aside by a hash of the id, puts the cutoffs of
all rules in one order: those that reject fewest of them first, then the lenient
before the strict.  Along it the rules become stricter one cutoff at a time.  The
other three quarters test each step: they are n trials, those that any rule rejects
by then are k failures, and the step is certified if P(Binomial(n, risk) <= k), the
exact p-value of "the risk is above ``risk``", is at most delta over the number of
strata (Bonferroni).  Testing stops at the first step that fails, so the steps of a
stratum count as one test (fixed sequence).  With probability 1 - delta, in every
stratum the rules together reject at most ``risk`` of the clean documents.  A
stratum with too few labels gets no cutoffs.

All on the main path are DataFrame functions, and each document's counts are
taken within its row: texts are not exploded.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiospark.llm.workspace import Workspace

BLANKS = r"[\x20\x09-\x0D]"
#: Further risks, and failures allowed for, of the query and the pipeline: with four strata, 0.5 % takes about 1,640 trials, 5 % takes 164.
WIDER, SLACK = (0.01, 0.02, 0.03, 0.05), 2
#: Values of the rules, in thousandths, rounded down.
VALUES = {
    "symbols": ("n_symbols", "word_chars"),
    "shouts": ("n_shouts", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}


@dataclass(frozen=True)
class RiskPlan:
    """``risk``: greatest share of a stratum's clean documents that may be rejected.  ``cutoffs``: for each rule, from lenient to strict.

    ``wider``: further risks, rising, for strata with too few trials for ``risk``: the
    first at which their number would do with ``slack`` failures.  It is chosen by the
    number of trials alone, so the guarantee, at that risk, is unchanged.
    """

    risk: float = 0.005
    wider: tuple[float, ...] = ()
    slack: int = 0
    delta: float = 0.05
    min_words: int = 20
    cutoffs: dict[str, tuple[int, ...]] = field(
        default_factory=lambda: {
            "symbols": (700, 500, 400, 300, 250, 200, 150, 100, 70, 50),
            "shouts": (3000, 2000, 1500, 1000, 800, 600, 500, 400, 300, 200),
            "dup_lines": (900, 800, 700, 600, 500, 400, 300),
            "repeats": (290, 270, 250, 230, 210, 200, 180, 150),
            "word_length": (50000, 40000, 30000, 25000, 20000, 18000, 16000, 15000),
        }
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words in windows of 8 (hashes, by position) that occur more than once."""

    def twice(zipped: Column) -> Column:
        same = F.filter(zipped, lambda x, i: (F.get(zipped, i - 1)["h"] == x["h"]) | (F.get(zipped, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    zipped = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    step = lambda a, x: F.struct((a["n"] + F.least(F.lit(8), x - a["last"])).alias("n"), x.alias("last"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last"))
    return F.aggregate(_let(zipped, twice), start, step, lambda a: a["n"])


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_shouts (long).

    A null text has none of each.  ``n_lines`` counts the lines with a word,
    ``n_shouts`` the exclamation marks.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.regexp_replace(body, rf"^{BLANKS}++|(?<!{BLANKS}){BLANKS}++\z", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANKS}+"))

    def of_words(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        windows = F.when(F.size(w) >= 8, _let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - 7), lambda i: F.xxhash64(F.slice(h, i, 8)))))
        repeat = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(0))
        return F.struct(F.size(w).cast("long").alias("words"), F.length(F.array_join(w, "")).cast("long").alias("chars"), F.coalesce(repeat, F.lit(0)).cast("long").alias("repeat"))

    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    rows = docs.withColumns({"_w": _let(words, of_words), "_l": of_lines, "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"), "n_shouts": (F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit("")))).cast("long")})
    named = {"n_words": "_w.words", "word_chars": "_w.chars", "n_repeat_words": "_w.repeat", "n_dup_lines": "_l.dup", "n_lines": "_l.lines"}
    return rows.withColumns({k: F.col(v) for k, v in named.items()}).drop("_w", "_l")


def _value(rule: str) -> Column:
    part, whole = VALUES[rule]
    return F.when(F.col(whole) > 0, F.expr(f"1000 * {part} div {whole}")).otherwise(0)


def _log_gamma(x: str) -> str:
    """Stirling's series at x + 8, for x >= 1."""
    y = f"({x} + 8D)"
    shift = " * ".join(f"({x} + {k}D)" for k in range(8))
    return f"(({y} - 0.5D) * ln({y}) - {y} + 0.9189385332046727D + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) - ln({shift}))"


def log_binomial_tail(risk: float | str, k: str = "k") -> Column:
    """ln P(Binomial(n, risk) <= k) of columns n and k, exact to rounding, where k < n * risk; else 0.  ``risk`` is a number or a column's name, ``k`` a name or a number.

    The terms below k fall at least geometrically; beyond 20 * sqrt(n) + 50 of
    them, nothing is left within double precision.
    """
    risk = risk if isinstance(risk, str) else f"{risk}D"
    top = f"{_log_gamma('(n + 1D)')} - {_log_gamma(f'({k} + 1D)')} - {_log_gamma(f'(n - {k} + 1D)')} + {k} * ln({risk}) + (n - {k}) * ln(1 - {risk})"
    less = f"a.term * ({k} - i) * (1 - {risk}) / ((n - {k} + i + 1) * {risk})"
    terms = f"aggregate(sequence(0L, least({k}, cast(20 * sqrt(n) + 50 as bigint))), struct(1D as term, 0D as sum), (a, i) -> struct({less} as term, a.sum + a.term as sum), a -> a.sum)"
    return F.expr(f"CASE WHEN {k} < n * {risk} THEN {top} + ln({terms}) ELSE 0D END")


def set_aside(id_col: Column) -> Column:
    """A quarter of the ids, by their MD5."""
    return F.conv(F.substring(F.md5(id_col.cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % 4 == 0


def certified_cutoffs(work: Workspace, clean: DataFrame, plan: RiskPlan) -> DataFrame:
    """One row per stratum of ``clean`` (doc_id, stratum and the counts): a column ``max_<rule>`` each, null if none is certified.

    A document with several texts counts once, with its highest values.
    """
    rules = list(plan.cutoffs)
    grid = [(level, place, cut) for place, rule in enumerate(rules) for level, cut in enumerate(plan.cutoffs[rule])]
    values = work.save(clean.groupBy("stratum", "doc_id").agg(F.array(*(F.max(_value(r)) for r in rules)).alias("values")).withColumn("aside", set_aside(F.col("doc_id"))))
    hit = lambda place, cut: F.get("values", F.lit(place)) > cut
    step = lambda level, place, cut: F.struct(F.sum(F.when(F.col("aside") & hit(place, cut), 1).otherwise(0)).alias("k"), F.lit(level).alias("level"), F.lit(place).alias("place"), F.lit(cut).cast("long").alias("cut"))
    path = work.save(values.groupBy("stratum").agg(F.sort_array(F.array(*(step(*g) for g in grid))).alias("path")))
    first = F.array_min(F.transform("path", lambda s, i: F.when(F.get("values", s["place"]) > s["cut"], i)))
    # A row a stratum: while these are few, no stratum's documents are dealt to one task.
    tested = values.join(F.broadcast(path) if path.saved_rows <= 10_000 else path, "stratum").withColumn("first", first)
    failed = F.array(*(F.struct(F.lit(i).alias("step"), F.sum(F.when(~F.col("aside") & (F.col("first") <= i), 1).otherwise(0)).alias("k")) for i in range(len(grid))))
    tests = tested.groupBy("stratum").agg(F.sum(F.when(~F.col("aside"), 1).otherwise(0)).alias("n"), failed.alias("tests")).withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(1))))
    tests = tests.join(path, "stratum").select("stratum", "n", "strata", "path", F.inline("tests")).withColumn("step", F.get("path", F.col("step"))).drop("path")
    bound = F.log(F.lit(plan.delta) / F.col("strata"))
    tests = tests.withColumn("risk", F.coalesce(*(F.when(log_binomial_tail(r, f"{plan.slack}L") <= bound, F.lit(r)) for r in (plan.risk, *plan.wider)), F.lit(plan.risk)))
    passed = log_binomial_tail("risk") <= bound
    # k, and with it the p-value, rises along the path: the last step that passes has passed all before it.
    return tests.where(passed).groupBy("stratum").agg(*(F.min(F.when(F.col("step.place") == place, F.col("step.cut"))).alias(f"max_{r}") for place, r in enumerate(rules)))


def judge(docs: DataFrame, labels: DataFrame, plan: RiskPlan = RiskPlan(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", passed: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed and kept, and the columns ``passed`` on.

    ``labels`` has doc_id and quality; a document labelled both 0 and 1, or with
    a null, is not clean.  Null strata are one stratum.  Rows that repeat are
    judged alike; null ids are judged and never match a label.  Without labels
    only the base rules reject.  A value at the cutoff itself is kept.  Other
    columns are not read.
    """
    work = Workspace(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"), *passed)
    counted = counts(picked).drop("text")
    failed = (F.col("n_words") < plan.min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = work.save(counted.withColumn("base_failed", failed))
    clean = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).where("quality = 1")
    cutoffs = work.save(certified_cutoffs(work, counted.where(~F.col("base_failed")).join(clean, "doc_id", "left_semi"), plan))
    rejected = F.lit(False)
    for rule in plan.cutoffs:
        rejected = rejected | F.coalesce(_value(rule) > F.col(f"max_{rule}"), F.lit(False))
    out = counted.join(cutoffs, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *passed)


def rules_sql(plan: RiskPlan = RiskPlan()) -> str:
    """``judge`` in DuckDB's SQL, by other formulas: windows as rows, the tail as a plain sum."""
    grid = ", ".join(f"('{r}', {c}, {level}, {place})" for place, (r, cuts) in enumerate(plan.cutoffs.items()) for level, c in enumerate(cuts))
    tail = lambda k, r: f"list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({r}) + (n - i) * ln(1 - {r}))))"
    risk = "CASE " + " ".join(f"WHEN {plan.slack} < n * {r} AND {tail(plan.slack, r)} <= {plan.delta} / strata THEN {r}" for r in (plan.risk, *plan.wider)) + f" ELSE {plan.risk} END"
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN CASE WHEN {w} > 0 THEN 1000 * {p} // {w} ELSE 0 END" for r, (p, w) in VALUES.items()) + " END"
    return f"""
        WITH texts AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
        worded AS (
            SELECT *, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines
            FROM texts),
        windows AS (
            SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM worded WHERE len(words) >= 8)),
        repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
        repeats AS (
            SELECT doc_id, count(DISTINCT p) AS n
            FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY doc_id),
        counted AS (
            SELECT doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
                   len(lines)::BIGINT AS n_lines, (length(text) - length(replace(text, '!', '')))::BIGINT AS n_shouts
            FROM worded LEFT JOIN repeats r USING (doc_id)),
        based AS (SELECT *, n_words < {plan.min_words} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
        rules(rule, cut, level, place) AS (VALUES {grid}),
        clean AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1),
        measured AS (
            SELECT stratum, doc_id, rule, max({value}) AS v, ('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT % 4 = 0 AS aside
            FROM based SEMI JOIN clean USING (doc_id), (SELECT DISTINCT rule FROM rules) WHERE NOT base_failed GROUP BY ALL),
        path AS (
            SELECT stratum, rule, cut, row_number() OVER (PARTITION BY stratum ORDER BY count(*) FILTER (aside AND v > cut), level, place) AS step
            FROM measured JOIN rules USING (rule) GROUP BY stratum, rule, cut, level, place),
        trials AS (SELECT m.stratum, doc_id, min(step) FILTER (v > cut) AS first FROM measured m JOIN path USING (stratum, rule) WHERE NOT aside GROUP BY ALL),
        tests AS (
            SELECT p.stratum, p.rule, p.cut, count(doc_id) AS n, count(*) FILTER (first <= step) AS k
            FROM path p LEFT JOIN trials t ON p.stratum = t.stratum GROUP BY ALL),
        risks AS (SELECT *, {risk} AS risk FROM (SELECT *, (SELECT count(DISTINCT stratum) FROM measured) AS strata FROM tests)),
        tails AS (
            SELECT *, {tail("k", "risk")} AS p
            FROM risks),
        cutoffs AS (SELECT stratum, rule, min(cut) AS cut FROM tails WHERE p <= {plan.delta} / strata GROUP BY ALL),
        rejected AS (SELECT DISTINCT doc_id FROM based JOIN cutoffs USING (stratum) WHERE {value} > cut)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
        FROM based"""
