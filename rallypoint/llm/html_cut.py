"""HTML main text by minimum cut.

A page becomes a row of text blocks. A logistic classifier's costs for calling a
block content or boilerplate are the capacities from the two terminals; blocks
that follow each other, and blocks under one parent, are tied by smoothness
edges that weaken with their distance in the tree. The minimum cut, found by
maximum flow, labels all blocks of the page at once. Blocks whose own costs
outweigh all their ties are labelled beforehand, which changes no cut, so the
flow runs on what is left.

The classifier is fitted on at most SAMPLE_BLOCKS blocks of about SAMPLE_PAGES
pages that have an article or main element. Labels come from such elements
alone: blocks inside one, and in no nav, footer, aside, form or the like, are
content. Two sets of weights are fitted, one with the hints of tags and names
(class, id, role) and one without; pages that hint at no main part use the
latter. The fit starts from, and without examples stays at, the prior weights.
Blocks in a nav, footer, aside, menu or dialog, in a header outside articles, in
places for comments, and such that aren't displayed, are boilerplate whatever
their text, within an article too.

Names are judged word by word: one that has main words alone ("post", "content")
makes its element main, whatever other names it has in part ("category-tools"),
unless another has words of boilerplate alone ("comment"). An element that only
its names or its being a form call boilerplate isn't if it holds at least half of
the page's unlinked text and no other main part is outside it; places for
comments stay boilerplate at any length.

Reading is linear in the page's length. A quote that opens an attribute's value
and isn't closed before white space, `/` or `>` ends with its tag at the next
`>`; `<` without any `>` behind it is text. Form controls (button, select,
option, textarea and the like) are dropped wherever they stand, in a paragraph
too; options and lists of them end with any block that begins.

Defined results for unusual input: a null, empty or tagless html gives the text
that its only block has (none: empty); unclosed comments, scripts, styles,
titles and text areas end with the page, other unclosed tags with their parent;
very long pages are handled whole; ties between labels count as boilerplate;
repeated rows are extracted one by one; an empty table gives an empty result;
other columns, whatever their names, are never read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 2000
SAMPLE_BLOCKS = 200_000
#: Weight of the prior in the fit, in examples.
PRIOR_EXAMPLES = 100.0
#: Smoothness of neighbours and of siblings, in natural logarithms.
NEIGHBOUR, SIBLING = 0.6, 0.4
#: Capacities are whole numbers of this part of a natural logarithm.
UNIT = 1000

# HTML's own element kinds, and words that containers go by.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp".split())
HIDDEN = frozenset("noscript template svg math object canvas select datalist option optgroup button".split())
CHOICES = frozenset("select datalist option optgroup".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
MAIN_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav footer aside menu dialog label".split())
#: Tags that may hold a whole page.
FORM_TAGS = frozenset("form fieldset".split())
MAIN_WORDS = frozenset("article content main post entry story text".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer foot header "
    "masthead topbar comment comments reply replies respond disqus discussion related recommended more share sharing social follow login signin signup "
    "register form search widget toolbar tools copyright legal disclaimer skip pagination pager tags hidden contentinfo complementary".split()
)

COMMENT_WORDS = frozenset("comment comments reply replies respond disqus discussion".split())
#: An element with this share of the page's unlinked text is none by its name alone.
MOST = 0.5

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTED = re.compile(r"=\s*([\"'])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_COMMENT_END = re.compile("--!?>")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Features of text and place, then hints.
FEATURES = ("one", "length", "links", "stops", "heading", "paragraph", "item", "share", "main", "boiler")
HINTS = 2
#: Rows: weights for pages without and with hints at a main part.
PRIOR = np.array([[-0.8, 0.5, -3.0, 0.8, 0.8, 1.3, -0.6, 1.0, 0.0, -4.5], [-0.8, 0.5, -3.0, 0.8, 0.8, 1.3, -0.6, 0.5, 3.0, -4.5]])


@dataclass
class Element:
    """number and parent tell block elements apart; main and boiler hold inside, structural ones by tags alone.

    soft is the number of the innermost element, this or above, that may be boilerplate by name or as a form, or -1;
    shut tells places for comments and what isn't displayed.
    """

    tag: str
    number: int
    parent: int
    is_block: bool
    main: bool = False
    boiler: bool = False
    tag_main: bool = False
    tag_boiler: bool = False
    link: bool = False
    hidden: bool = False
    soft: int = -1
    shut: bool = False


@dataclass
class Soft:
    """An element that is boilerplate unless the page's text says otherwise; above is the number of the next one outside."""

    above: int
    form: bool
    comments: bool
    unlinked: int = 0
    main: int = 0
    holds: bool = True
    holds_form: bool = False


@dataclass
class Block:
    """apart counts the block elements between the block and the one before it."""

    text: str
    linked: int
    element: Element
    apart: int


def attributes(attrs: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attrs):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def _named(found: dict[str, str]) -> tuple[bool, bool, bool]:
    """Whether an element's names call it main, boilerplate, or a place for comments."""
    main = boiler = partly = comments = False
    for key in ("class", "id", "role"):
        for name in found.get(key, "").split():
            words = set(_WORDS.findall(_CAMEL.sub("-", name).lower()))
            main = main or bool(words) and words <= MAIN_WORDS
            boiler = boiler or bool(words) and words <= BOILER_WORDS
            partly = partly or not words.isdisjoint(BOILER_WORDS)
            comments = comments or not words.isdisjoint(COMMENT_WORDS)
    return main and not boiler, boiler or (partly and not main), comments


def _open(tag: str, attrs: str, above: Element, number: int, parent: int, soft: list[Soft]) -> Element:
    tag_main, tag_boiler = tag in MAIN_TAGS, tag in BOILER_TAGS or (tag == "header" and not above.tag_main)
    main, named, comments, shut, at = tag_main, False, False, above.shut, above.soft
    if attrs and tag not in ("html", "body"):
        found = attributes(attrs)
        by_name, named, comments = _named(found)
        main = main or by_name
        if named and tag_main and not comments:
            named = any(set(_WORDS.findall(x.lower())) <= BOILER_WORDS for x in found.get("class", "").split())
        shut = shut or (named and comments) or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(found.get("style", "")) is not None
    if named or tag in FORM_TAGS:
        at = len(soft)
        soft.append(Soft(above.soft, tag in FORM_TAGS, comments))
    return Element(
        tag, number, parent, tag in BLOCKS, above.main or (main and not named), above.boiler or tag_boiler or shut,
        above.tag_main or tag_main, above.tag_boiler or tag_boiler, above.link or tag == "a", above.hidden or tag in HIDDEN, at, shut,
    )


class _Reader:
    """The open elements of a page, the blocks among them, and what is open within the innermost block."""

    def __init__(self) -> None:
        root = Element("", 0, 0, True)
        self.open, self.blocks, self.inline = [root], [root], [Counter()]
        self.counts: Counter[str] = Counter()
        self.made, self.least = 0, 0
        self.last_depth = 0
        self.parts: list[tuple[str, bool]] = []
        self.out: list[Block] = []
        self.soft: list[Soft] = []

    def text(self, text: str) -> None:
        if not self.open[-1].hidden:
            self.parts.append((text, self.open[-1].link))

    def end_block(self) -> None:
        if self.parts:
            whole = " ".join(html.unescape("".join(x for x, _ in self.parts)).split())
            if whole:
                depth = len(self.blocks)
                self.least = min(self.least, depth)
                linked = sum(len(x) for x, link in self.parts if link)
                self.out.append(Block(whole, linked, self.blocks[-1], self.last_depth + depth - 2 * self.least))
                self.last_depth = self.least = depth
            self.parts.clear()

    def _pop(self) -> Element:
        gone = self.open.pop()
        self.counts[gone.tag] -= 1
        if gone.is_block:
            self.blocks.pop()
            self.inline.pop()
            self.least = min(self.least, len(self.blocks))
        else:
            self.inline[-1][gone.tag] -= 1
        return gone

    def _pop_to(self, tag: str) -> None:
        while self._pop().tag != tag:
            pass

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self.end_block()
            while self.open[-1].tag in CHOICES:
                self._pop()
            shut = CLOSES.get(tag, ())
            while self.blocks[-1].tag in shut:
                self._pop_to(self.blocks[-1].tag)
        elif tag == "br":
            self.text(" ")
        elif tag in HIDDEN:
            self.text(" ")
            if tag in ("option", "optgroup"):
                while self.open[-1].tag in ("option", tag):
                    self._pop()
        if tag in VOID or (attrs.endswith("/") and tag not in BLOCKS):
            return
        self.made += 1
        element = _open(tag, attrs, self.open[-1], self.made, self.blocks[-1].number, self.soft)
        self.open.append(element)
        self.counts[tag] += 1
        if element.is_block:
            self.blocks.append(element)
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text(" ")
        elif tag in BLOCKS:
            self.end_block()
            if self.counts[tag] > 0:
                self._pop_to(tag)
        elif self.inline[-1][tag] > 0:
            self._pop_to(tag)
            self.text(" " if tag in HIDDEN else "")

    def settle(self) -> list[Block]:
        """The blocks, after it is known which elements hold most of the page's text."""
        whole = mains = 0
        for b in self.out:
            unlinked, main = len(b.text) - min(b.linked, len(b.text)), b.element.main and not b.element.boiler
            whole += unlinked
            mains += main
            if b.element.soft >= 0:
                self.soft[b.element.soft].unlinked += unlinked
                self.soft[b.element.soft].main += main
        for x in reversed(self.soft):
            if x.above >= 0:
                self.soft[x.above].unlinked += x.unlinked
                self.soft[x.above].main += x.main
        for x in self.soft:
            x.holds = x.comments or x.unlinked < MOST * whole or x.main < mains
            x.holds_form = x.holds and x.form
            if x.above >= 0:
                x.holds = x.holds or self.soft[x.above].holds
                x.holds_form = x.holds_form or self.soft[x.above].holds_form
        for e in {id(b.element): b.element for b in self.out}.values():
            if e.soft >= 0:
                e.boiler = e.boiler or self.soft[e.soft].holds
                e.tag_boiler = e.tag_boiler or self.soft[e.soft].holds_form
        return self.out


def _tag_end(page: str, at: int) -> int:
    """Where the `>` of the tag whose name ends at `at` stands, or -1."""
    while True:
        stop = page.find(">", at)
        if stop < 0:
            return -1
        quote = _QUOTED.search(page, at, stop)
        if not quote:
            return stop
        close = page.find(quote[1], quote.end())
        if close < 0 or page[close + 1 : close + 2] not in ("", " ", "\t", "\n", "\r", "\f", "/", ">"):
            return page.find(">", quote.end())
        at = close + 1


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, white space settled, none empty."""
    reader = _Reader()
    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        mark = page.find("<", at)
        if mark < 0 or mark > last:
            reader.text(page[at:])
            break
        if mark > at:
            reader.text(page[at:mark])
        if page.startswith("<!--", mark):
            if page.startswith((">", "->"), mark + 4):
                at = page.find(">", mark) + 1
                continue
            stop = _COMMENT_END.search(page, mark + 4)
            if not stop:
                break
            at = stop.end()
            continue
        tag = _TAG.match(page, mark)
        if not tag:
            if page[mark + 1 : mark + 2] in ("!", "?", "/"):
                at = page.find(">", mark) + 1
            else:
                reader.text("<")
                at = mark + 1
            continue
        stop = _tag_end(page, tag.end())
        if stop < 0:
            reader.text(page[mark:])
            break
        name, attrs, at = tag[2].lower(), page[tag.end() : stop], stop + 1
        if tag[1]:
            reader.end(name)
        elif name in RAW:
            reader.text(" ")
            if not attrs.endswith("/") or not reader.open[-1].hidden:
                found = _RAW_END[name].search(page, at)
                if not found:
                    break
                at = page.find(">", found.end()) + 1 or size
        else:
            reader.start(name, attrs)
    reader.end_block()
    return reader.settle()


def features(blocks: list[Block]) -> np.ndarray:
    inside: Counter[int] = Counter()
    for b in blocks:
        inside[b.element.parent] += len(b.text) - min(b.linked, len(b.text))
    whole = sum(inside.values()) or 1
    rows = []
    for b in blocks:
        n, tag = len(b.text), b.element.tag
        stops = sum(map(b.text.count, ".!?,;:"))
        rows.append(
            (1.0, min(3.0, np.log1p(n) / 2 - 1.5), min(1.0, b.linked / n), min(2.0, 12.0 * stops / (n + 12)), len(tag) == 2 and tag[0] == "h" and tag[1].isdigit(),
             tag in ("p", "pre", "blockquote"), tag in ("li", "td", "th", "dt", "dd"), inside[b.element.parent] / whole, b.element.main, b.element.boiler)
        )
    return np.array(rows, float).reshape(-1, len(FEATURES))


def examples(page: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the page's blocks, none if it has no article or main element.

    A block in such an element whose names alone call it boilerplate has no label.
    """
    blocks = blocks_of(page or "")
    if not any(b.element.tag_main for b in blocks):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    label = np.array([b.element.tag_main and not (b.element.tag_boiler or b.element.shut) for b in blocks], float)
    known = np.array([not (y and b.element.boiler) for y, b in zip(label, blocks, strict=True)])
    return features(blocks)[known], label[known]


def _newton(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    weights = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + PRIOR_EXAMPLES * (weights - prior)
        bend = (x * (p * (1 - p))[:, None]).T @ x + PRIOR_EXAMPLES * np.eye(len(weights))
        move = np.linalg.solve(bend, slope)
        weights = weights - move
        if np.abs(move).max() < 1e-8:
            break
    return weights


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR) -> np.ndarray:
    """Both rows of weights, most probable under a normal prior around `prior` (Newton steps)."""
    if not len(y):
        return prior.copy()
    plain = x.copy()
    plain[:, -HINTS:] = 0
    return np.array([_newton(plain, y, prior[0]), _newton(x, y, prior[1])])


class Network:
    """Maximum flow (Dinic) between a source and a sink."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.left: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def join(self, a: int, b: int, there: int, back: int = 0) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [there, back]

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for e in self.out[a]:
                b = self.to[e]
                if self.left[e] and level[b] < 0:
                    level[b] = level[a] + 1
                    todo.append(b)
        return level

    def flow(self, source: int, sink: int) -> list[int]:
        """Runs the flow; the levels that remain tell the source's side (>= 0)."""
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return level
            at = [0] * len(self.out)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    most = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= most
                        self.left[e ^ 1] += most
                    first = next(i for i, e in enumerate(path) if not self.left[e])
                    a = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                edges = self.out[a]
                while at[a] < len(edges):
                    e = edges[at[a]]
                    if self.left[e] and level[self.to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(edges):
                    path.append(e)
                    a = self.to[e]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    at[a] += 1
                else:
                    break


def settled(pull: list[int], ties: list[dict[int, int]]) -> list[int]:
    """1 or -1 for blocks whose pull outweighs all ties that are still open, else 0.

    A settled block's ties become its neighbours' pulls; pull and ties change
    in place. What is left has the same minimum cuts as before.
    """
    label = [0] * len(pull)
    open_ = [sum(x.values()) for x in ties]
    todo = deque(i for i in range(len(pull)) if abs(pull[i]) > open_[i])
    while todo:
        i = todo.popleft()
        if label[i]:
            continue
        label[i] = 1 if pull[i] > 0 else -1
        for j, tie in ties[i].items():
            if not label[j]:
                pull[j] += label[i] * tie
                open_[j] -= tie
                del ties[j][i]
                if abs(pull[j]) > open_[j]:
                    todo.append(j)
    return label


def content(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks the minimum cut leaves on the content side."""
    n = len(blocks)
    if not n:
        return []
    odds = np.clip(features(blocks) @ weights[int(any(b.element.main for b in blocks))], -12, 12)
    odds[[b.element.tag_boiler or b.element.shut for b in blocks]] = -12
    # The difference of a block's two terminal capacities; what both could send is cut in any case.
    pull = (np.rint(UNIT * np.log1p(np.exp(odds))) - np.rint(UNIT * np.log1p(np.exp(-odds)))).astype(int).tolist()
    ties: list[dict[int, int]] = [{} for _ in range(n)]

    def tie(i: int, j: int, much: int) -> None:
        ties[i][j] = ties[i].get(j, 0) + much
        ties[j][i] = ties[j].get(i, 0) + much

    last_child: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            tie(i - 1, i, round(UNIT * NEIGHBOUR / (1 + b.apart)))
        parent = b.element.parent
        if parent in last_child:
            tie(last_child[parent], i, round(UNIT * SIBLING))
        last_child[parent] = i
    label = settled(pull, ties)
    rest = [i for i in range(n) if not label[i]]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        net = Network(len(rest) + 2)
        source, sink = len(rest), len(rest) + 1
        for i in rest:
            if pull[i] > 0:
                net.join(source, at[i], pull[i])
            elif pull[i] < 0:
                net.join(at[i], sink, -pull[i])
            for j, much in ties[i].items():
                if i < j and j in at:
                    net.join(at[i], at[j], much, much)
        level = net.flow(source, sink)
        for i in rest:
            label[i] = 1 if level[at[i]] >= 0 else -1
    return [x > 0 for x in label]


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, content(blocks, weights), strict=True) if keep)


def extract_batches(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py(), weights) for x in batch.column("html")]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def example_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page, h in zip(batch.column("html"), batch.column("h").to_pylist(), strict=True):
            x, y = examples(page.as_py())
            # Numbers that order the blocks of all sampled pages at random, alike in every run.
            order = np.random.default_rng(h & (1 << 63) - 1).integers(0, 1 << 62, len(y))
            yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(y), *(pa.array(c) for c in x.T.copy())], names=["h", "y", *FEATURES])


def train(pages: DataFrame, markup: str, page_id: str, sample_pages: int = SAMPLE_PAGES, sample_blocks: int = SAMPLE_BLOCKS) -> np.ndarray:
    """Weights fitted on a sample of pages; only numbers of at most sample_blocks blocks reach the driver."""
    share = sample_pages / max(1, pages.count())
    hashed = pages.where(F.col(markup).isNotNull()).select(F.xxhash64(page_id, markup).alias("h"), F.col(markup).alias("html"))
    slice_ = hashed if share >= 1 else hashed.where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
    fields = ", ".join(["h bigint", *(f"{c} double" for c in ("y", *FEATURES))])
    found = slice_.mapInArrow(example_batches, fields).orderBy("h", *FEATURES).limit(sample_blocks).toArrow()
    return fit(np.column_stack([found[c].to_numpy() for c in FEATURES]), found["y"].to_numpy())


def extract(pages: DataFrame, markup: str = "html", page_id: str = "page_id", url: str = "url", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    weights = train(pages, markup, page_id, sample_pages)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}
    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(markup).alias("html"))
    return read.mapInArrow(lambda batches: extract_batches(batches, weights), f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars bigint")
