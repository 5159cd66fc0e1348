"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags negative;
the weights are log odds of lying inside the main text, by the element a word
stands in and by the tag, from labelled pages: those whose markup names its main
part (<article> or <main>).  A linear scan finds the contiguous stretch with the
highest total.  Elements that are never main text (menus, forms, ...) are left out:
they cost next to nothing to cross, teach nothing, and are dropped from the
stretch, which is then cut into blocks.  A class name or a form marks an element as
one of these only while the page has text besides it: a wrapper of the whole page
is no sidebar, whatever its class says.

Markup is read in one pass whose time grows in proportion to the page.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element names, by what they mean here.
RAW = "script style iframe textarea title xmp noembed noframes".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = set("nav aside footer header form button select option fieldset dialog menu head noscript template svg math object canvas".split())
#: Of these, those that can wrap a whole page.
WRAPPING = {"form", "fieldset", "dialog"}
#: What a page's text is made of.
CONTENT = set("article main p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Words in class, id and role that mark such elements.
HINTS = set("ad ads advert advertisement advertising adslot banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice popup promo related replies respond share sharing sidebar signup social sponsor sponsored subscribe widget".split())
#: First or last words of class names that only speak of such an element.
ABOUT = set("has no with without non open closed enabled disabled".split())
NAMED = set("article main body html section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody blockquote pre figure figcaption address".split()) | INLINE | VOID | DROPPED

_OPENING = re.compile(r"<(?:!--|[!?]|/?[a-z][^\s/<>]*)", re.I)
#: The rest of a tag: quotes count after an equals sign only.
_INSIDE = re.compile(r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+""")
_PLAIN = re.compile(r"[^<>]*+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_CLOSING = re.compile(r"</([a-z]+)", re.I)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class ExtractionPlan:
    """``labelled``: most pages from which weights are learned.  Weights are cut off at ``word_cap`` and ``tag_cap``."""

    labelled: int = 2000
    word_cap: float = 2.0
    tag_cap: float = 40.0
    unknown_word: float = 1.0
    unknown_tag: float = -0.1
    dropped: float = -0.01
    wrapped: float = 0.05


def _marked(tag: str, attrs: str) -> int:
    """0, or 1 if the element is never main text, or 2 if it is that unless it wraps the page."""
    if tag in DROPPED:
        return 2 if tag in WRAPPING else 1
    if not attrs or tag in ("main", "body", "html"):
        return 0
    for found in _HINT.findall(attrs):
        for name in "".join(found).lower().split():
            words = _NAME.findall(name)
            if tag == "article":
                words = [name]
            if not HINTS.isdisjoint(words) and ABOUT.isdisjoint((words[0], words[-1])):
                return 2
    return 0


def markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, '/' or '', name, attributes) of the tags, in order; comments, declarations and raw elements have no name.

    A tag ends at the next '>' outside quoted values, or, if another tag begins
    before that, at the next '>' of any kind; after such a one, quotes are not
    looked at up to the place that was read already.
    """
    size, last, read = len(page), page.rfind(">"), 0
    at = 0
    while m := _OPENING.search(page, at):
        start, body = m.span()
        at = body
        if m[0] == "<!--":
            end = page.find("-->", body)
            at = size if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        if start > last:
            continue
        if m[0][1] in "!?":
            at = page.find(">", body) + 1
            yield start, at, "", "", ""
            continue
        end = (_INSIDE if start >= read else _PLAIN).match(page, body).end()
        if start >= read and page[end : end + 1] != ">":
            read = end
            end = _PLAIN.match(page, body).end()
        if page[end : end + 1] != ">":
            continue
        at = end + 1
        slash = m[0][1:2] if m[0][1] == "/" else ""
        name = m[0][1 + len(slash) :].lower()
        if name in _RAW_END and not slash:
            closing = _RAW_END[name].search(page, at)
            shut = page.find(">", closing.end()) if closing else -1
            at = size if shut < 0 else shut + 1
            yield start, at, "", "", ""
        else:
            yield start, at, slash, name, page[body:end]


def parse(page: str, plan: ExtractionPlan = ExtractionPlan()) -> list[tuple[str, str, bool]]:
    """(feature, text, dropped): text for stretches of words, '' for tags, in page order.

    ``feature`` is a word's element or a tag's name; elements that are marked as
    never main text end in '!'.  Unclosed elements end with their parent, a
    paragraph or list item with the next one; <article> and <main> end a marked
    element whose end tag doesn't come any more.
    """
    out: list[tuple[str, str, int, int]] = []  # feature, text, innermost mark around it, its own mark
    stack: list[tuple[str, int]] = []
    open_tags: Counter[str] = Counter()
    #: Of marked elements: kind, the marked one around it, words in it alone, whether it holds content, its tag.
    marks: list[list] = []
    around = [-1]
    ends = {m[1].lower(): m.start() for m in _CLOSING.finditer(page)}
    loose = 0

    def pop() -> str:
        name, mark = stack.pop()
        open_tags[name] -= 1
        if mark >= 0:
            around.pop()
        return name

    def words(text: str) -> None:
        nonlocal loose
        if text.strip():
            out.append((f"in {stack[-1][0]}" if stack else "in body", text, around[-1], -1))
            if around[-1] < 0:
                loose += len(text.split())
            else:
                marks[around[-1]][2] += len(text.split())

    at = 0
    for start, end, slash, name, attrs in markup(page):
        words(page[at:start])
        at = end
        if not name:
            continue
        tag = name if name in NAMED else "other"
        if slash:
            out.append((f"/{tag}", "", around[-1], -1))
            if open_tags[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in ("article", "main"):
            unclosed = next((k for k, (n, mark) in enumerate(stack) if mark >= 0 and ends.get(marks[mark][4], -1) < start), None)
            while unclosed is not None and len(stack) > unclosed:
                pop()
        elif tag not in INLINE and tag not in VOID:
            while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p" or tag == "li" == stack[-1][0]):
                if stack[-1][1] >= 0 and stack[-1][0] != "li":
                    break
                if pop() == "p":
                    break
        kind = _marked(tag, attrs)
        out.append((tag, "", around[-1], len(marks) if kind else -1))
        if tag in CONTENT and around[-1] >= 0:
            marks[around[-1]][3] = True
        if kind:
            marks.append([kind, around[-1], 0, False, name])
        if tag not in VOID and not attrs.endswith("/"):
            stack.append((tag, len(marks) - 1 if kind else -1))
            open_tags[tag] += 1
            if kind:
                around.append(len(marks) - 1)
    words(page[at:])
    marked = _confirmed(marks, loose, plan.wrapped)
    return [(f"{feature}!" if own >= 0 and marked[own] else feature, text, mark >= 0 and marked[mark]) for feature, text, mark, own in out]


def _confirmed(marks: list[list], loose: int, share: float) -> list[bool]:
    """Whether what stands in each marked element is dropped, given the words in none: wrappers of the page's content are not."""
    held, content = [m[2] for m in marks], [m[3] for m in marks]
    inner: list[list[int]] = [[] for _ in marks]
    for k in range(len(marks) - 1, -1, -1):
        if (outer := marks[k][1]) >= 0:
            held[outer] += held[k]
            content[outer] |= content[k]
            inner[outer].append(k)
    dropped = [True] * len(marks)
    outermost = [(-held[k], k) for k, m in enumerate(marks) if m[1] < 0]
    heapq.heapify(outermost)
    while outermost:
        _, k = heapq.heappop(outermost)
        if marks[k][0] == 2 and content[k] and loose < share * held[k]:
            dropped[k] = False
            loose += marks[k][2]
            for x in inner[k]:
                heapq.heappush(outermost, (-held[x], x))
    return dropped


def feature_counts(page: str) -> dict[str, tuple[int, int]]:
    """Counts of a labelled page's features inside and outside its main part; none if it has no such part."""
    tokens = parse(page)
    inside, found = 0, Counter()
    if not any(f in ("article", "main") for f, text, _ in tokens if not text):
        return {}
    for feature, text, dropped in tokens:
        if not text and feature in ("/article", "/main"):
            inside = max(0, inside - 1)
        if not dropped and not feature.endswith("!"):
            found[feature, inside > 0] += len(text.split()) if text else 1
        if not text and feature in ("article", "main"):
            inside += 1
    return {f: (found[f, True], found[f, False]) for f in {f for f, _ in found}}


def learned_weights(pages: DataFrame, plan: ExtractionPlan) -> dict[str, float]:
    """Weights by feature, from at most ``plan.labelled`` labelled pages; features are a bounded list."""
    labelled = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b"))
    order = F.xxhash64(F.col("page_id"), F.lit("label"))
    ids = labelled.select("page_id", order.alias("o")).orderBy("o", "page_id").limit(plan.labelled).select("page_id").distinct()
    sample = labelled.join(F.broadcast(ids), "page_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for f, (i, o) in feature_counts(page).items():
                    inside[f] += i
                    outside[f] += o
        names = list(inside)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[f] for f in names], pa.int64()), pa.array([outside[f] for f in names], pa.int64())], names=["feature", "i", "o"])

    rows = sample.select("html").mapInArrow(run, "feature string, i long, o long").groupBy("feature").agg(F.sum("i"), F.sum("o")).collect()
    return weights_of({f: (i, o) for f, i, o in rows}, plan)


def weights_of(counts: dict[str, tuple[int, int]], plan: ExtractionPlan) -> dict[str, float]:
    out = {}
    for feature, (i, o) in counts.items():
        odds = math.log((i + 0.5) / (o + 0.5))
        if feature.startswith("in "):
            out[feature] = max(-plan.word_cap, min(plan.word_cap, odds))
        else:
            out[feature] = max(-plan.tag_cap, min(-0.01, 8 * odds))
    return out


def extract(page: str | None, weights: dict[str, float], plan: ExtractionPlan = ExtractionPlan()) -> str:
    """The page's main text, blocks joined by line breaks; '' if it has none."""
    tokens = parse(page, plan) if page else []
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    for k, (feature, text, dropped) in enumerate(tokens):
        if dropped or feature.endswith("!"):
            score = plan.dropped
        elif text:
            score = weights.get(feature, plan.unknown_word) * len(text.split())
        else:
            score = weights.get(feature, plan.unknown_tag)
        total += score
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, best_range = total, (start, k + 1)
    blocks: list[str] = []
    block: list[str] = []
    for feature, text, dropped in tokens[slice(*best_range)]:
        if text:
            if not dropped:
                block.append(text)
        elif feature.strip("/!") not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    cleaned = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in cleaned if b)


def main_texts(pages: DataFrame, plan: ExtractionPlan = ExtractionPlan()) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; one scan learns weights, one extracts, nothing is shuffled but counts.

    A null or empty page has an empty text.  Repeated rows are repeated, rows with
    a null id or url are extracted, other columns are not read.  Of stretches with
    the same total the first counts.  Without labelled pages the default weights
    hold.
    """
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = learned_weights(picked, plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, weights, plan) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
