"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page becomes a line of tokens: tags, words, and whole elements that never hold article
text (``LEFT_OUT``: menus, footers, forms, scripts, adverts and the like), each one token
whatever its length. Every token has a weight learned from labelled pages; words score
positive and everything else negative. Forms and elements that only their class, id or role
marks are left out where they hold less than a share of the page's words and not its only
article; otherwise their start is one negative token and what they hold is scored. One linear scan finds the contiguous run with the
highest sum; widened to whole blocks, and to the whole of the page's only article where it
reaches into that, it is the article.

Labelled pages are those that mark their article themselves, with exactly one ``article`` or
``main`` element; a bounded sample of them gives the weights: the log of how much more
often a kind of token (word by the block it stands in, tag by name) occurs inside than
outside. A kind that the sample lacks has a stated weight, and with no labelled page at all
every kind has. What is left out inside a page's own single article parts nothing there.

Text keeps page order; character references are decoded, white space within a block becomes
one space, and blocks are joined by one line feed. NULL or empty html, and pages without
words, give an empty text. Unclosed, misnested and truncated markup is read as far as it
goes. Ties go to the first, longest run. Repeated rows each give their row.
"""

from __future__ import annotations

import html
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import SLICE, broadcast, slices, worker_cache

# Names of HTML elements, and words of class, id or role that mark what is no article text.
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
LEFT_OUT = frozenset("aside button canvas dialog footer form head iframe input map menu nav noscript object script select style svg template textarea title".split())
MARKED = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer footnote-nav gdpr header masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted promotion related respond replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Elements of this kind end an open paragraph, and one of their own kind where they cannot be nested.
ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())
HOME = frozenset(("article", "main"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
#: Words that turn a class name into one of what an element has or lacks, not of what it is.
ABOUT = frozenset("with without has have no non not free hide is".split())
#: Share of a page's words from which an element is not left out: whole names of ``MARKED``, and longer names.
WHOLE_NAME, LONGER_NAME = 0.5, 0.2

WORD, TAG, OUT = range(3)
#: Weights of kinds that no labelled page has, and the range of learned ones; a word's is a share of the most.
LEAST, MOST = 0.05, 12.0
UNSEEN = {WORD: 1.0, TAG: -LEAST, OUT: -6.0}


def _left_out(name: str, attributes: str, at_home: bool) -> float:
    """The share of a page's words up to which the element is left out: 0 never, above 1 always."""
    if name == "form":
        return WHOLE_NAME
    if name in LEFT_OUT:
        return 2.0
    if name == "header":
        return 0.0 if at_home else 2.0
    if name in ("html", "body", *HOME):
        return 0.0
    share = 0.0
    for found in _ATTRIBUTE.finditer(attributes):
        attribute, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
        if attribute == "hidden" or attribute == "aria-hidden" and value == "true" or attribute == "style" and _NONE.search(value):
            return 2.0
        if attribute in ("class", "id", "role"):
            for one in value.split():
                words = set(re.split(r"[_\-]+", one))
                if not MARKED.isdisjoint(words) and ABOUT.isdisjoint(words):
                    share = max(share, WHOLE_NAME if words <= MARKED or one in MARKED else LONGER_NAME)
    return share


@dataclass
class Page:
    """A page's tokens: kind, name, words, block number; ``pieces`` has the text of each block's parts."""

    kinds: list[tuple[int, str]] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    home: list[bool] = field(default_factory=list)
    homes: int = 0


def read(source: str) -> Page:
    """The tokens of ``source``; a text node is one token that counts for all its words."""
    page, stack = Page(), []
    # elements that may be left out: depth of the stack, first token, name, share; and closed ones with the token behind
    open_: list[tuple[int, int, str, float]] = []
    spans: list[list] = []
    left_out = 0  # depth of the stack at which the element left out began
    block, inside = 0, 0
    at, end = 0, len(source)

    def add(kind: int, name: str, count: int = 1, text: str = "") -> None:
        page.kinds.append((kind, name))
        page.count.append(count)
        page.block.append(block)
        page.text.append(text)
        page.home.append(inside > 0)

    def finish() -> None:
        nonlocal block
        while open_ and open_[-1][0] > len(stack):
            depth, first, name, share = open_.pop()
            spans.append([first, len(page.kinds), name, share, depth])
            block += 1

    def close(depth: int) -> None:
        nonlocal left_out, inside
        for name in stack[depth:]:
            inside -= name in HOME
        del stack[depth:]
        finish()
        if left_out > len(stack):
            left_out = 0

    while at < end:
        found = _TOKEN.match(source, at)
        at = found.end()
        name = found[2]
        if name is None:
            piece = found[0]
            if piece[0] == "<" and piece != "<" or left_out:
                continue
            text = html.unescape(piece)
            words = len(text.split())
            holder = next((n for n in reversed(stack) if n in BLOCKS), "body")
            add(WORD, holder, words, text)
            continue
        name = name.lower()
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] == name), None)
            if depth is not None:
                was_out, before = left_out, len(spans)
                close(depth)
                if was_out:
                    if not left_out:
                        block += 1
                    continue
            if not left_out:
                if name in BLOCKS:
                    block += 1
                add(TAG, "/" + name)
                if depth is not None and len(spans) > before and spans[-1][4] == depth + 1:
                    spans[-1][1] = len(page.kinds)  # the end tag belongs to the element
            continue
        attributes = found[3]
        if name in RAW:
            shut = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
            at = shut.end() if shut else end
            if not left_out:
                add(OUT, name)
            continue
        if name in EMPTY or attributes.rstrip().endswith("/"):
            if not left_out:
                block += name in BLOCKS
                add(TAG, name, 1, " " if name in ("br", "wbr", "img") else "")
            continue
        if name in BLOCKS:
            # a block ends an open paragraph; an item or cell ends the one before it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == "p" or (stack[i] == name and name in ENDS_ITSELF):
                    close(i)
                    break
                if stack[i] in BLOCKS:
                    break
        if left_out:
            stack.append(name)
            continue
        share = _left_out(name, attributes, inside > 0)
        if 0 < share < 1:
            block += 1
            open_.append((len(stack) + 1, len(page.kinds), name, share))
        elif share:
            block += 1
            add(OUT, name)
            stack.append(name)
            left_out = len(stack)
            continue
        if name in BLOCKS:
            block += 1
        # the tag that opens an article is not part of it
        add(TAG, name)
        stack.append(name)
        inside += name in HOME
    close(0)
    _decide(page, spans)
    page.homes = sum(kind == TAG and name in HOME and not home for (kind, name), home in zip(page.kinds, page.home, strict=True))
    return page


def _decide(page: Page, spans: list[list]) -> None:
    """Replace each outermost element that is left out by one token; mark the start of the others."""
    if not spans:
        return
    words = np.cumsum([0, *(n if k[0] == WORD else 0 for k, n in zip(page.kinds, page.count, strict=True))])
    homes = np.cumsum([0, *(k[0] == TAG and k[1] in HOME for k in page.kinds)])
    keep, behind = np.ones(len(page.kinds), bool), 0
    for first, end, name, share, _ in sorted(spans, key=lambda x: (x[0], -x[1])):
        if first < behind:
            continue
        page.kinds[first] = (OUT, name)
        only_home = homes[end] - homes[first] == homes[-1] > 0
        if not only_home and words[end] - words[first] < share * words[-1]:
            keep[first + 1 : end] = False
            behind = end
    for values in (page.kinds, page.count, page.block, page.text, page.home):
        values[:] = [v for v, k in zip(values, keep.tolist(), strict=True) if k]


def best_run(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous run with the highest sum; (0, 0) if no score is positive."""
    best, span, total, first = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += score
        if total > best:
            best, span = total, (first, i + 1)
    return span


@dataclass
class Weights:
    """Weight of each token kind, learned from labelled pages."""

    learned: dict[tuple[int, str], float]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def of(self, kind: tuple[int, str]) -> float:
        return self.learned.get(kind, UNSEEN[kind[0]])


def main_text(source: str | None, weights: Weights) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = read(source)
    own = page.homes == 1
    # an element left out within the page's own article does not end it
    scores = (-LEAST if own and home and k[0] == OUT else weights.of(k) * n for k, n, home in zip(page.kinds, page.count, page.home, strict=True))
    first, end = best_run(list(scores))
    if first == end:
        return ""
    if own and any(page.home[first:end]):
        # a page's only article is taken whole
        inside = [i for i, home in enumerate(page.home) if home]
        first, end = min(first, inside[0]), max(end, inside[-1] + 1)
    low, high = page.block[first], page.block[end - 1]
    blocks: dict[int, list[str]] = defaultdict(list)
    for block, text in zip(page.block, page.text, strict=True):
        if low <= block <= high:
            blocks[block].append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def learn(pages: DataFrame, source: str = "html", rows: int = 4000) -> Weights:
    """Weights from at most ``rows`` pages that mark their article themselves, those whose html hashes lowest."""
    marked = pages.select(F.col(source).cast("string").alias("html")).where(F.size(F.regexp_extract_all("html", F.lit(r"(?i)<(?:article|main)[\s>]"), 0)) == 1)
    digest = F.xxhash64("html")
    # pages of equal html count once, so the sample is bounded
    sample = marked.withColumn("_h", digest).where(F.col("_h") <= _border(marked, digest, rows)).dropDuplicates(["_h"]).drop("_h")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[int, str, bool], int] = defaultdict(int)
        for batch in slices(batches):
            for one in batch.column(0).to_pylist():
                page = read(one)
                if page.homes == 1:
                    for (kind, name), n, home in zip(page.kinds, page.count, page.home, strict=True):
                        tally[kind, name, home] += n
        kinds, names, homes = zip(*tally, strict=True) if tally else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(names, pa.string()), pa.array(homes, pa.bool_()), pa.array(tally.values(), pa.int64())], names=["kind", "name", "home", "n"])

    counted = sample.mapInArrow(count, "kind int, name string, home boolean, n long").groupBy("kind", "name", "home").agg(F.sum("n").alias("n"))
    # bounded: names that occur often enough to be learned, most frequent first
    rows_ = counted.where("n > 0").orderBy(F.desc("n"), "kind", "name", "home").limit(5000).collect()
    inside = sum(r.n for r in rows_ if r.home) + 1
    outside = sum(r.n for r in rows_ if not r.home) + 1
    seen: dict[tuple[int, str], list[int]] = defaultdict(lambda: [0, 0])
    for r in rows_:
        seen[r.kind, r.name][0 if r.home else 1] += r.n
    learned = {}
    for kind, (a, b) in seen.items():
        odds = float(np.clip(np.log((a + 0.5) / inside) - np.log((b + 0.5) / outside), -MOST, MOST))
        if kind[0] == WORD and a:
            learned[kind] = max(LEAST, odds / MOST)
        elif kind[0] == WORD:
            learned[kind] = odds / MOST  # words of a block that never holds article text
        else:
            learned[kind] = min(-LEAST, odds)
    return Weights(learned)


def _border(marked: DataFrame, digest, rows: int) -> object:
    """The ``rows``-th smallest digest: a sample by hash needs no sorting of pages."""
    smallest = marked.select(digest.alias("h")).distinct().orderBy("h").limit(rows)
    return F.lit(smallest.agg(F.max("h")).collect()[0][0])


def extract(pages: DataFrame, weights: Weights, source: str = "html", result: str = "text") -> DataFrame:
    """``pages`` with a string column ``result`` (a column of that name is replaced)."""
    read_weights, key = broadcast(pages.sparkSession, weights), weights.key

    @F.arrow_udf("string")
    def run(sources: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = worker_cache("html", key, read_weights)
        for batch in sources:
            yield pa.array([main_text(x, own) for at in range(0, len(batch), SLICE) for x in batch.slice(at, SLICE).to_pylist()], pa.string())

    return pages.withColumn(result, run(F.col(source).cast("string")))
