"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is read once as a row of words and tags. Words score positive, tags negative; a linear scan finds the stretch with
the largest sum, which is the main region. The weights come from labelled pages: a page that marks its content with an
``article`` or ``main`` element says which words and tags are content. A word's weight is the share of content among the
words of its element (name and first class), a tag's weight is minus the share of other text among such tags. Elements
seen too rarely fall back to their name, then to ``DEFAULT``. Elements that say themselves that they are not main text
are not counted, their words score nothing and their tags ``APART_WEIGHT``. Tags of flowing text (lists, tables, figures, paragraphs)
that were seen too rarely cost next to nothing. A region that meets an element that marks content is extended to that element's ends, so
that no list, table or short paragraph at its edge is lost. From the region, blocks of menus, headers, footers, side
bars, notices, adverts, forms and reader comments are left out; scripts, styles and comments are never words.

A class, id or role sets an element aside as a whole token (``sidebar``, ``site-footer``), not by a part of one that says
something else (``has-sidebar``, ``comment-status-open``). If a page's only ``article`` or ``main`` is inside such an element, that is
a wrapper and is not set aside; if class names would set aside every word of a page, they are not read.

The weights are fitted on at most ``SAMPLE`` pages, those with the smallest hash of their id; extraction reads all
pages whole.

Defined results: a null or empty page has empty text; a page without tags is text as a whole; unclosed elements end with
the element around them; repeated rows and null ids are read one by one; of equal stretches the first and shortest
counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.common import map_batches, share

SAMPLE = 20_000
MIN_SEEN = 20
DEFAULT = 0.8
TAG = 4.0
APART_WEIGHT = -1.0
LEAST_WORD = 0.02
LEAST_TAG = 0.05
SIGNATURES = 20_000

HIDDEN = frozenset("template svg iframe title textarea select canvas video audio".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.IGNORECASE | re.DOTALL,
)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in HIDDEN}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
LETTERS = re.compile(r"[a-z]+")
PARTS = re.compile(r"[^\W_]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr noscript object".split()
)
# Tags of formulas are read over: their many tags say nothing about the text around them.
FORMULA = frozenset(
    "math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub "
    "msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split()
)
CONTENT = frozenset(["article", "main"])
# Tags of flowing text.
FLOW = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption colgroup col thead tbody tfoot tr th td figure figcaption picture img "
    "blockquote pre hr br details summary address section".split()
)
APART = frozenset("nav header footer aside form button menu dialog fieldset head".split())
APART_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar "
    "aside widget related recommended footer masthead topbar comment comments disqus replies respond newsletter subscribe "
    "signup login search share sharing social".split()
)
# What a name may be compounded with and still say the same, as in ``site-footer`` or ``share-buttons``.
WITH = frozenset(
    "site page main global primary secondary top bottom section block area box bar list links link button buttons form widgets "
    "posts title header".split()
)
# These hold articles of their own, so one in them does not make them the wrapper of the main text.
OF_ARTICLES = frozenset("comment comments disqus replies respond related recommended".split())


@dataclass
class Node:
    name: str
    signature: str
    apart: bool
    by_name: bool
    content: int  # the number of the outermost content element around it, or zero
    named: int = 0  # the tag's number if its class, id or role set it aside
    articles: bool = False  # set aside by a name of ``OF_ARTICLES``, here or further out


def signature(name: str, attributes: str) -> tuple[str, frozenset[str]]:
    """An element's name with its first class or id, and those of its names that say that it is not main text."""
    first, apart = "", set()
    for found in NAMES.finditer(attributes):
        value = (found[1] or found[2] or found[3] or "").lower()
        words = LETTERS.findall(value)
        first = first or (words[0] if words else "")
        if not APART_NAMES.isdisjoint(words):
            for token in value.split():
                parts = set(PARTS.findall(token))
                parts -= {x for x in parts if x.isdigit()}
                if parts <= APART_NAMES | WITH:
                    apart |= parts & APART_NAMES
    return (f"{name}.{first}" if first else name), frozenset(apart)


@dataclass
class Found:
    """What a reading saw of class names: whether any set words aside, and the wrappers of the first content element."""

    words: bool = False
    named: bool = False
    free: bool = False  # a content element that no class name set aside
    main: frozenset[int] = frozenset()
    article: frozenset[int] = frozenset()


def read(page: str) -> list[tuple]:
    """Events of a page in order: ``("t", signature, content, apart)`` for tags, ``("w", signature, content, apart, text,
    block)`` for text. ``content`` is the number of the element around it that marks content, or zero."""
    seen = Found()
    events = list(tags(page, seen, lambda number: True))
    wrappers = frozenset() if seen.free else seen.main or seen.article
    if wrappers:
        seen = Found()
        events = list(tags(page, seen, lambda number: number not in wrappers))
    if seen.named and not seen.words:
        events = list(tags(page, Found(), lambda number: False))
    return events


def tags(page: str, seen: Found, judged: Callable[[int], bool]):
    """The events of one reading; class names count in the elements whose number is ``judged``."""
    stack = [Node("", "", False, False, 0)]
    top, block, at, number = stack[0], 0, 0, 0
    endless: set[str] = set()

    def words(piece: str):
        if piece and not piece.isspace():
            seen.words = seen.words or not top.apart
        return ("w", top.signature, top.content, top.apart, piece, block)

    while found := TOKEN.search(page, at):
        if found.start() > at:
            yield words(page[at : found.start()])
        at = found.end()
        name = found[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            yield words(" ")
            continue
        if name in HIDDEN and not found[2]:
            # What is between the tags is not shown; without a closing tag, what follows is read on.
            if found[4].endswith("/") or name in endless:
                continue
            end = CLOSING[name].search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(name)
            continue
        if name in FORMULA:
            continue
        if name not in INLINE:
            block += 1
        if found[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    yield ("t", "/" + stack[k].signature, stack[k].content, stack[k].apart)
                    del stack[k:]
                    top = stack[-1]
                    break
            continue
        sign, names = signature(name, found[4]) if found[4] else (name, frozenset())
        number += 1
        apart = bool(names) and name not in ("html", "body") and judged(number)
        if name in VOID:
            yield ("t", sign, top.content, top.apart)
            continue
        by_name = name in APART and not (name == "header" and top.content)
        content = name in CONTENT and not apart
        # A new content element ends what an unclosed menu or header began.
        inherited = top.apart and not (content and top.by_name)
        node = Node(name, sign, apart or by_name or inherited, (by_name and not apart) or (top.by_name and inherited),
                    top.content if top.content and not apart and not by_name else number if content else 0,
                    number if apart else 0,
                    (apart and not OF_ARTICLES.isdisjoint(names)) or (top.articles and inherited))
        seen.named = seen.named or apart
        if name in CONTENT:
            if not node.apart:
                seen.free = True
            elif not node.articles and (name == "main" or not apart):
                around = frozenset(x.named for x in [*stack, node] if x.named)
                if name == "main":
                    seen.main = seen.main or around
                else:
                    seen.article = seen.article or around
        stack.append(node)
        top = node
        yield ("t", sign, node.content, node.apart)
    if at < len(page):
        yield words(page[at:])


@dataclass
class Weights:
    """Shares of content by kind of event and signature."""

    shares: dict[tuple[str, str], float] = field(default_factory=dict)

    def of(self, kind: str, sign: str) -> float:
        found = self.shares.get((kind, sign))
        if found is None:
            name = sign.split(".")[0]
            flows = kind == "t" and name.removeprefix("/") in FLOW
            found = self.shares.get((kind, name), 1.0 if flows else DEFAULT)
        return max(LEAST_WORD, found) if kind == "w" else -max(LEAST_TAG, TAG * (1 - found))


def extract(page: str | None, weights: Weights) -> str:
    """The blocks of the best region, joined by line ends."""
    if not page:
        return ""
    best = total = 0.0
    start = 0
    region = (0, 0)
    pieces = []
    known: dict[tuple[str, str], float] = {}
    for kind, sign, content, apart, *rest in read(page):
        key = (kind, sign)
        weight = known.get(key)
        if weight is None:
            weight = known[key] = weights.of(kind, sign)
        if apart:
            weight = APART_WEIGHT if kind == "t" else 0.0
        if kind == "w":
            weight *= len(rest[0].split())
            pieces.append((rest[0], apart, rest[1], content))
        if total <= 0:
            # The stretch may begin with this event; a tag that scores negative never does.
            total, start = 0.0, len(pieces) - (kind == "w")
        total += weight
        if total > best:
            best, region = total, (start, len(pieces))
    met = {content for _, apart, _, content in pieces[region[0] : region[1]] if content and not apart}
    inside = [k for k, piece in enumerate(pieces) if piece[3] in met]
    if inside:
        region = min(region[0], inside[0]), max(region[1], inside[-1] + 1)
    blocks: list[tuple[int, list[str]]] = []
    for text, apart, block, _ in pieces[region[0] : region[1]]:
        if apart:
            continue
        if not blocks or blocks[-1][0] != block:
            blocks.append((block, []))
        blocks[-1][1].append(text)
    lines = (" ".join(html.unescape("".join(parts)).split()) for _, parts in blocks)
    return "\n".join(x for x in lines if x)


def counts(page: str | None) -> Counter:
    """Words and tags by signature and by name, in content and elsewhere; empty for a page that marks no content."""
    seen: Counter = Counter()
    marked = False
    for kind, sign, content, apart, *rest in read(page or ""):
        if apart:
            continue
        n = len(rest[0].split()) if kind == "w" else 1
        marked = marked or (content > 0 and kind == "w" and n > 0)
        for name in {sign, sign.split(".")[0]}:
            seen[kind, name, content > 0] += n
    return seen if marked else Counter()


def fit(
    pages: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", html_col: str = "html", signatures: int = SIGNATURES
) -> Weights:
    """Weights from the pages that mark their content."""
    chosen = (
        pages.select(F.col(id_col).alias("page_id"))
        .filter(F.col("page_id").isNotNull())
        .groupBy("page_id")
        .agg(F.lit(1).alias("one"))
        .orderBy(F.xxhash64("page_id"), "page_id")
        .limit(sample)
        .select("page_id")
    )
    # At most ``sample`` ids are broadcast.
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).join(
        F.broadcast(chosen), "page_id", "left_semi"
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for page in batch.column("html").to_pylist():
            seen.update(counts(page))
        keys = list(seen)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.string()),
                pa.array([seen[k] if k[2] else 0 for k in keys], pa.int64()),
                pa.array([seen[k] for k in keys], pa.int64()),
            ],
            ["kind", "sign", "inside", "n"],
        )

    found = (
        map_batches(rows.select("html"), "kind string, sign string, inside long, n long", work)
        .groupBy("kind", "sign")
        .agg(F.sum("inside").alias("inside"), F.sum("n").alias("n"))
        .filter(F.col("n") >= MIN_SEEN)
        .orderBy(F.desc("n"), "kind", "sign")
        .limit(signatures)
    )
    return Weights({(r["kind"], r["sign"]): (r["inside"] + DEFAULT) / (r["n"] + 1) for r in found.collect()})


def main_text(
    pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    shared = share(pages.sparkSession, weights)
    schema = T.StructType(
        [pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(x, shared()) for x in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            schema.fieldNames(),
        )

    return map_batches(pages, schema, work)
