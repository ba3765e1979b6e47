"""Main text of web pages: a tree-structured graphical model over each page's blocks.

The block elements of a page, and the texts that stand beside blocks in a container, form a
tree. Each node has one of three states: OUTER (a frame around everything), CONTENT or
BOILERPLATE. Node potentials come from its tag, class and id names, link share and text length;
parent-child potentials say which states nest in which. Messages passed up to the root and
down again (sum-product) give exact marginals; the text of nodes whose CONTENT marginal is at
least 0.5 is the page's text.

Both kinds of potentials are learned by counting on labelled pages: those that mark their
article (<article> or <main>), at most TRAIN_PAGES of them, picked by hash. Blocks around the
mark are OUTER, in it CONTENT, all others BOILERPLATE; parts of the article that are named as
something else are not counted. The mark itself is no learned feature, so pages without one are
judged by the same lengths, links, tags and names. To these come bounded priors: tags with a
meaning (nav, article), names that say what a part is by custom, and long or linked text. An
element's tag outweighs its names, and a name counts less if it is only a part of a longer one.
Counting and extraction run in Spark tasks over batches of pages; only the counts of the
bounded sample reach the driver. Time to read a page is linear in its length.

Defined results: null or empty html, and pages without content, have an empty text. Unclosed,
misnested or unknown tags are tolerated; a tag that the page's end cuts off is left out, and
when a quote is never closed, later tags end at their first ">". White space is what Python's
str.split() splits at; a <br> counts as white space. Repeated pages each get their row. Extra
columns are left out. Without any labelled page the priors decide alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspan.llm.common import with_columns

TRAIN_PAGES = 4_000
OUTER, CONTENT, BOILERPLATE = 0, 1, 2

# HTML's elements without content, with text that is not shown, inline, and
# containers, whose tag says nothing and whose own texts are nodes of their own.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style title textarea noscript template svg iframe".split())
INLINE = set(
    "a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label "
    "mark meter nobr object output picture progress q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var video wbr annotation math menclose mfrac mi mn mo mover mroot mrow "
    "ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover "
    "semantics".split())
CONTAINER = set("#page html body div section td article main center".split())
# An open element of the first kind is closed by the start of any of the others.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"},
}
# Names of the parts of a page by custom, and words that say nothing beside them.
HINTS = {
    BOILERPLATE: set(
        "nav navigation menu navbar breadcrumb breadcrumbs header masthead topbar footer foot "
        "contentinfo aside sidebar complementary widget related recommended share sharing "
        "social ad ads advert advertisement adverts sponsored sponsor promo promotion banner "
        "notice notices cookie cookies consent gdpr popup modal dialog newsletter subscribe "
        "alert comment comments disqus reply replies respond form search login signup fieldset "
        "button select copyright legal pagination pager tags toolbar skip".split()),
    CONTENT: set("article main content post entry story".split()),
}
PLAIN = set(
    "area bar block body bottom box buttons container group inner items left links list outer "
    "page panel posts primary right secondary section site top wrap wrapper".split())
MARKS = {"article", "main"}
#: Log-odds for a tag with a meaning, a name by custom, and a word within a longer name.
MARK, TAG, NAME, WORD = 10.0, 6.0, 4.0, 1.0
#: Observations that a feature's share of states is drawn to the share of all nodes by.
SMOOTH = 20.0
#: Least log P(state of child | state of parent), parents by row: an article may hold parts
#: that don't belong to it, but nothing is content inside boilerplate.
FLOOR = np.array([[-3.0, -3.0, -3.0], [-9.0, -3.0, -1.0], [-30.0, -30.0, -3.0]])

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(
    r"[\s/]*+([^\s/>=][^\s/>=]*+)?(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*+)))?+")


@dataclass
class Page:
    """Block elements and texts in page order, and the text blocks that they hold."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    length: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    #: Stands in a marked article; stands inside a part that is named as boilerplate.
    marked: list[bool] = field(default_factory=list)
    told: list[bool] = field(default_factory=list)


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag or text, names): "text", "open", "shut" or "alone", in one pass."""
    at, end, last, quoted = 0, len(source), source.rfind(">"), True
    while at < end:
        begin = source.find("<", at)
        if begin < 0:
            begin = end
        if begin > at:
            yield "text", source[at:begin], ""
        if begin == end:
            return
        if source.startswith("<!--", begin):
            stop = source.find("-->", begin + 4)
            at = end if stop < 0 else stop + 3
            continue
        found = _TAG.match(source, begin)
        if not found:
            stop = source.find(">", begin) if source[begin + 1:begin + 2] in ("!", "?") else -2
            if stop == -2:
                yield "text", "<", ""
            at = begin + 1 if stop == -2 else end if stop < 0 else stop + 1
            continue
        if begin > last:
            return
        at, names = found.end(), []
        if quoted:
            while at < end and source[at] != ">":
                part = _ATTRIBUTE.match(source, at)
                if part[1] and part[1].lower() in ("class", "id", "role"):
                    names.append(part[2] or part[3] or part[4] or "")
                at = max(part.end(), at + 1)
            if at >= end:  # a quote that is never closed
                quoted, at, names = False, found.end(), []
        if not quoted:
            at = source.find(">", at)
        kind = ("shut" if source[begin + 1] == "/" else
                "alone" if source[at - 1] == "/" else "open")
        tag = found[1].lower()
        at += 1
        yield kind, tag, " ".join(names)
        if tag in HIDDEN and kind == "open":
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            at = stop.start() if stop else end


def parse(source: str) -> Page:
    page = Page()

    def add(tag: str, names: tuple[str, ...], parent: int) -> int:
        marked = parent >= 0 and page.marked[parent]
        page.parent.append(parent)
        page.depth.append(page.depth[parent] + 1 if parent >= 0 else 0)
        page.tag.append("header in article" if marked and tag == "header" else tag)
        page.names.append(names)
        page.linked.append(0)
        page.length.append(0)
        page.marked.append(marked or tag in MARKS)
        page.told.append(parent >= 0 and (page.told[parent] or is_told(page, parent)))
        return len(page.tag) - 1

    # Open blocks: tag, node, and the inline elements that are open in them.
    frames: list[tuple[str, int, list[str]]] = [("#page", add("#page", (), -1), [])]
    opened: Counter = Counter()  # open blocks by tag
    held: list[str] = []
    links = in_links = 0

    def flush() -> None:
        nonlocal in_links
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            node = frames[-1][1]
            if page.tag[node] in CONTAINER:
                node = add("#text", (), node)
            page.blocks.append((node, text))
            page.length[node] += len(text)
            page.linked[node] += in_links
        in_links = 0

    def shut() -> None:
        nonlocal links
        flush()
        tag, _, inline = frames.pop()
        opened[tag] -= 1
        links -= inline.count("a")

    for kind, tag, names in tokens(source):
        if kind == "text":
            held.append(tag)
            if links > 0:
                in_links += len(tag)
        elif tag in VOID:
            held.append(" ")
        elif tag in HIDDEN:
            pass
        elif tag in INLINE:
            inline = frames[-1][2]
            if kind == "open":
                inline.append(tag)
                links += tag == "a"
            elif kind == "shut" and tag in inline[-64:]:
                while (closed := inline.pop()) != tag:
                    links -= closed == "a"
                links -= tag == "a"
        elif kind == "shut":
            if opened[tag] > 0:
                while frames[-1][0] != tag:
                    shut()
                shut()
        else:
            flush()
            while len(frames) > 1 and (frames[-1][0] == "p"
                                       or tag in CLOSED_BY.get(frames[-1][0], ())):
                shut()
            node = add(tag, tuple(sorted(set(names.lower().split()))), frames[-1][1])
            if kind == "open":
                frames.append((tag, node, []))
                opened[tag] += 1
    flush()
    return page


# ---- potentials -----------------------------------------------------------------------------


@lru_cache(100_000)
def hints(tag: str, names: tuple[str, ...]) -> tuple[tuple[float, float, float], bool]:
    """Prior potentials of an element's tag and names; whether they tell it as boilerplate."""
    if tag in ("#page", "html", "body"):
        return (MARK, 0.0, 0.0), False
    if tag in MARKS:
        return (0.0, MARK, 0.0), False
    content = boilerplate = 0.0
    for name in names:
        words = {word for word in re.split("[^a-z]+", name) if word}
        bad, good = words & HINTS[BOILERPLATE], words & HINTS[CONTENT]
        if bad and not words - bad - good - PLAIN and not (good and bad == {"header"}):
            boilerplate = max(boilerplate, NAME)
        elif bad and not good:
            boilerplate = max(boilerplate, WORD)
        elif good and not bad:
            content = max(content, WORD if words - good - PLAIN else NAME)
    if tag in HINTS[BOILERPLATE]:
        boilerplate = TAG
    return (0.0, content, boilerplate), boilerplate - content >= NAME


def is_told(page: Page, i: int) -> bool:
    return hints(page.tag[i], page.names[i])[1]


def features(page: Page, i: int) -> list[str]:
    """What is learned: neither the mark nor the tag of a container is."""
    out = [] if page.tag[i] in CONTAINER or page.tag[i] == "#text" else [f"tag:{page.tag[i]}"]
    if page.length[i]:
        out += [f"length:{page.length[i].bit_length()}", f"links:{share(page, i)}"]
    return out + [f"name:{name}" for name in page.names[i]]


def share(page: Page, i: int) -> int:
    """Quarters of a text that are links."""
    return min(3, 4 * page.linked[i] // page.length[i])


def label(page: Page) -> list[int] | None:
    """States of a page that marks its article, -1 if not known; None for other pages."""
    marks = [i for i, tag in enumerate(page.tag) if tag in MARKS]
    if not marks:
        return None
    states = [BOILERPLATE] * len(page.tag)
    for i in marks:
        up = page.parent[i]
        while up >= 0 and states[up] == BOILERPLATE:
            states[up] = OUTER
            up = page.parent[up]
    for i, marked in enumerate(page.marked):
        if marked:
            states[i] = -1 if page.told[i] or is_told(page, i) else CONTENT
    return states


def count(texts: list[bytes | None]) -> Counter:
    """(what, state or pair of states) counts of the labelled pages among some.

    What stands inside a menu says nothing of lists elsewhere: only edges and link shares
    are counted there.
    """
    found: Counter = Counter()
    for text in texts:
        page = parse(text.decode("utf-8", "replace")) if text else None
        states = (label(page) if page else None) or []
        for i, state in enumerate(states):
            if state < 0:
                continue
            up = page.parent[i]
            if up >= 0 and states[up] >= 0:
                found["#edge", 3 * states[up] + state] += 1
            found["#links" if page.told[i] else "#state", state] += 1
            for name in features(page, i):
                if not page.told[i] or name.startswith("links:"):
                    found[name, state] += 1
    return found


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    edges: np.ndarray  # log P(state of child | state of parent)

    def unary(self, page: Page) -> np.ndarray:
        """Inside a part that is named, only names and links count: its length says nothing."""
        out = np.zeros((len(page.tag), 3))
        for i in range(len(page.tag)):
            out[i] = hints(page.tag[i], page.names[i])[0]
            if page.told[i]:
                continue
            for name in features(page, i):
                if (weight := self.weights.get(name)) is not None:
                    out[i] += weight
            if page.length[i]:
                out[i, CONTENT] += min(2.0, max(-0.5, np.log2(page.length[i] / 40)))
                out[i, BOILERPLATE] += (0.0, 0.0, 1.0, 3.0)[share(page, i)]
        return out


def fit(pages: DataFrame, limit: int = TRAIN_PAGES) -> Model:
    """Counts of at most `limit` different labelled pages, turned into potentials."""
    key = F.xxhash64("page_id", "url", "html")
    marks = F.col("html").rlike("(?i)<(article|main)[ >]")
    order = pages.where(marks).select(key.alias("h")).distinct().orderBy("h").limit(limit)
    bound = order.agg(F.max("h")).first()[0]
    counts: dict[tuple[str, int], int] = {}
    if bound is not None:
        picked = (pages.where(marks & (key <= bound)).select(key.alias("h"), "html")
                  .dropDuplicates(["h"]).select(F.col("html").cast("binary").alias("html")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                total += count(batch.column(0).to_pylist())
            rows = [(what, state, n) for (what, state), n in total.items()]
            yield pa.RecordBatch.from_pylist(
                [{"what": w, "state": s, "n": n} for w, s, n in rows],
                pa.schema([("what", pa.string()), ("state", pa.int32()), ("n", pa.int64())]))

        summed = picked.mapInArrow(run, "what string, state int, n long").groupBy(
            "what", "state").agg(F.sum("n").alias("n"))
        counts = {(r.what, r.state): r.n for r in summed.collect()}
    return model_of(counts)


def model_of(counts: dict[tuple[str, int], int]) -> Model:
    states = np.array([counts.get(("#state", s), 0) for s in range(3)])
    linked = states + [counts.get(("#links", s), 0) for s in range(3)]
    # Prior: frames hold anything, content holds content, boilerplate only boilerplate.
    prior = np.array([[5.0, 5.0, 5.0], [1e-3, 20.0, 1.0], [1e-3, 1e-3, 20.0]])
    seen = np.array([[counts.get(("#edge", 3 * a + b), 0) for b in range(3)]
                     for a in range(3)])
    edges = np.log((prior + seen) / (prior + seen).sum(axis=1, keepdims=True))
    # Shares again after the floor: nodes without evidence must not favour a parent's state.
    edges = np.maximum(edges, FLOOR)
    edges -= np.log(np.exp(edges).sum(axis=1, keepdims=True))
    weights = {}
    for name in {what for what, _ in counts if not what.startswith("#")}:
        each = np.array([counts.get((name, s), 0) for s in range(3)])
        of = (linked if name.startswith("links:") else states) + 1.0
        base = of / of.sum()
        # How much likelier a state is with the feature; none for a feature seldom seen.
        weights[name] = np.log((each + SMOOTH * base) / (each.sum() + SMOOTH) / base)
    return Model(weights, edges)


# ---- inference ------------------------------------------------------------------------------


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(unary: np.ndarray, parent: np.ndarray, depth: np.ndarray,
              edges: np.ndarray) -> np.ndarray:
    """Exact marginals of a forest, by messages from the leaves up and from the roots down."""
    belief, up, down = unary.copy(), np.zeros_like(unary), np.zeros_like(unary)
    order = np.argsort(depth, kind="stable")
    begins = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    levels = [order[a:b] for a, b in zip(begins, begins[1:])]
    for nodes in levels[:0:-1]:
        up[nodes] = _logsum(edges[None] + belief[nodes][:, None, :], 2)
        np.add.at(belief, parent[nodes], up[nodes])
    for nodes in levels[1:]:
        cavity = (belief + down)[parent[nodes]] - up[nodes]
        down[nodes] = _logsum(cavity[:, :, None] + edges[None], 1)
    total = belief + down
    return np.exp(total - _logsum(total, 1)[:, None])


def extract(texts: list[bytes | None], model: Model) -> list[str]:
    pages = [parse(text.decode("utf-8", "replace") if text else "") for text in texts]
    sizes = [len(page.tag) for page in pages]
    base = np.concatenate(([0], np.cumsum(sizes))).astype(int)
    if not len(pages):
        return []
    parent = np.concatenate([np.array(p.parent) + b for p, b in zip(pages, base)])
    depth = np.concatenate([np.array(p.depth) for p in pages])
    unary = np.concatenate([model.unary(page) for page in pages])
    content = marginals(unary, parent, depth, model.edges)[:, CONTENT] >= 0.5
    return ["\n".join(text for node, text in page.blocks if content[b + node])
            for page, b in zip(pages, base)]


def main_text(pages: DataFrame, limit: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    model = fit(pages, limit)
    out = with_columns(pages.select("page_id", "url", "html"), "html",
                       [T.StructField("text", T.StringType(), False)],
                       lambda texts: [pa.array(extract(texts, model), pa.string())])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
