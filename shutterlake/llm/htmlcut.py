"""Main text of HTML pages by minimum cut.

1. A page becomes blocks of text in page order, each with measures of its text and of its place (``MEASURES``). Words of class, id
   and role count as hints for their element and, a little less at each level, for what is in it; a hint that only qualifies
   another word counts less, and one on an element that holds the page's heading or most of its text hardly counts.
2. A logistic classifier, fitted on pages that ``htmltrain`` makes, gives every block its log odds of being content. The costs of
   calling it content and boilerplate are the capacities of its edges to the two terminals.
3. Blocks that follow each other, and neighbours under the same parent, are joined by edges whose capacity falls with the regions
   (articles, asides, lists, ...) that lie between them. The maximum flow's cut is the labelling of least total cost. Blocks whose
   terminal capacity exceeds all their other edges are settled beforehand, which changes no cut.

Defined results: null, empty and unclosed html work (what is unclosed ends with the page); a page without content has the text
'' and 0 characters; character references are decoded; white space inside a block becomes one space; the blocks of content are
joined by one space; a tie between both sides makes a block boilerplate; repeated rows get equal results each; pages of any
length and depth are read whole, in memory proportional to the page; columns but page_id, url and html are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .htmltree import BLOCK, EMPTY, HEADINGS, OPEN, TEXT, UNSEEN, attributes, walk

WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
REGIONS = frozenset("article main section aside nav footer header form table ul ol dl fieldset figure blockquote dialog".split())
AGAINST_ELEMENTS = frozenset("nav footer aside form menu dialog fieldset".split())
CONTROLS = frozenset("button input select textarea option".split())

#: Words of class, id or role that name what is no article text.
AGAINST = frozenset(
    "nav navbar navigation menu menubar masthead banner footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo "
    "promotion promoted cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login breadcrumb breadcrumbs comment "
    "comments discussion respond replies disqus share sharing social related recommended recommendations widget pagination pager toolbar copyright "
    "legal disclaimer alert skip search complementary contentinfo paywall tracking outbrain taboola feedback".split()
)
FOR = frozenset("article content main post entry story body text maintext articlebody".split())
#: Words that say whether something is there, not what the element is.
STATES = frozenset("has have with without no not non is closed open opened off on enabled disabled allowed hidden show hide".split())
#: Words that name a part of whatever the other word names.
PARTS = frozenset(
    "area bar block body bottom box button buttons card col column container content element entry form group head header heading icon icons inner item items label "
    "left line link links list main module outer panel post posts region right row section site slot small stories text thread title top unit wrap wrapper global primary secondary page".split()
)
WHOLE, PART = 1.0, 0.3
FADES = 0.95
PHRASES = re.compile(
    r"\xa9|all rights reserved|we use cookies|(?:accept|manage)(?: all)? cookies|(?:cookie|privacy) policy|terms (?:of|and) \w+|subscribe (?:to|now)|sign (?:up|in)\b|log in\b|read more"
    r"|share (?:this|on)|follow us|leave a (?:comment|reply)|(?:related|popular|latest) (?:articles|posts|stories|news)|most (?:read|popular)|you may also like|skip to|back to top|advertisement|sponsored",
)
#: Every phrase holds one of these, which are sought first.
PHRASE_PARTS = ("\xa9", "rights", "cookies", "policy", "terms", "subscribe", "sign ", "log in", "read more", "share ", "follow us", "leave a", "related", "popular", "latest", "most read", "you may", "skip to", "back to", "advert", "sponsor")
ENDS = frozenset(".!?…。:;\"'”)")
DIGIT = re.compile("[0-9]")
PUNCTUATION = re.compile(r"[.,;:!?…。、]")

MEASURES = (
    "one words long links long_links ends punctuation digits phrases heading paragraph item cell against favour page_header own_header controls around_links"
).split()


class Block:
    """A text: the share of it in links, its element, and the regions between it and the block before it."""

    __slots__ = ("text", "linked", "node", "name", "apart")

    def __init__(self, text, linked, node, name, apart):
        self.text, self.linked, self.node, self.name, self.apart = text, linked, node, name, apart


class Tree:
    """The elements of a page (node 0 is the page): parent, name, own hints, and sums over what is in them."""

    __slots__ = ("parent", "name", "against", "favour", "chars", "linked", "controls", "heading", "regions")

    def __init__(self):
        self.parent, self.name, self.against, self.favour, self.regions = [0], [""], [0.0], [0.0], [0]
        self.chars, self.linked, self.controls, self.heading = [0], [0], [0], [0]

    def add(self, parent: int, name: str, against: float, favour: float) -> int:
        self.parent.append(parent)
        self.name.append(name)
        self.against.append(against)
        self.favour.append(favour)
        self.regions.append(self.regions[parent] + (name in REGIONS))
        for own in (self.chars, self.linked, self.controls, self.heading):
            own.append(0)
        return len(self.parent) - 1

    def sum_up(self) -> None:
        for k in range(len(self.parent) - 1, 0, -1):
            p = self.parent[k]
            self.chars[p] += self.chars[k]
            self.linked[p] += self.linked[k]
            self.controls[p] += self.controls[k]
            self.heading[p] += self.heading[k]


def hints(raw: str) -> tuple[float, float, bool]:
    """(how far class, id and role speak against content, how far for it, whether the element is hidden)."""
    against = favour = 0.0
    hidden = False
    if not raw or raw.isspace():
        return against, favour, hidden
    for name, value in attributes(raw).items():
        if name in ("class", "id", "role", "itemprop"):
            for token in value.split():
                words = [w.lower() for w in WORD.findall(token)]
                if not words or STATES.intersection(words):
                    continue
                said = [w in AGAINST for w in words]
                if any(said):
                    rest = [w for w, x in zip(words, said) if not x]
                    against = max(against, WHOLE if all(w in PARTS or w in FOR or len(w) < 3 for w in rest) else PART)
                elif FOR.intersection(words):
                    favour = max(favour, WHOLE if words[-1] in FOR or words[0] in FOR else PART)
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()) or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
    return against, (favour if against < WHOLE else 0.0), hidden


def blocks(page: str) -> tuple[list[Block], Tree]:
    """The blocks of text of a page, in page order, and its elements."""
    out: list[Block] = []
    tree = Tree()
    stack = [0]
    parts: list[str] = []
    unseen = in_link = linked = 0
    least = 0  # the fewest regions that were open since the last block

    def flush():
        nonlocal linked, least
        if parts:
            text = "".join(parts)
            parts.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                node = stack[-1]
                least = min(least, tree.regions[node])
                apart = tree.regions[out[-1].node] + tree.regions[node] - 2 * least if out else 0
                share = min(1.0, linked / len(text))
                out.append(Block(text, share, node, tree.name[node], apart))
                tree.chars[node] += len(text)
                tree.linked[node] += int(share * len(text))
                if tree.name[node] == "h1":
                    tree.heading[node] += 1
                least = tree.regions[node]
        linked = 0

    for kind, name, raw in walk(page):
        if kind == TEXT:
            if not unseen and name:
                parts.append(name)
                if in_link:
                    linked += len(name.strip())
        elif kind == OPEN:
            if name in BLOCK:
                flush()
            against, favour, hidden = hints(raw)
            if name in AGAINST_ELEMENTS or hidden:
                against = WHOLE
            elif name in ("html", "body"):
                against = min(against, PART)
            if name in ("article", "main"):
                against, favour = min(against, PART) if name == "main" else against, WHOLE if against < WHOLE else 0.0
            if name in CONTROLS:
                tree.controls[stack[-1]] += 1
            if name in BLOCK or against or favour:
                stack.append(tree.add(stack[-1], name, against, favour))
            else:
                stack.append(stack[-1])
            unseen += name in UNSEEN
            in_link += name == "a"
        elif kind == EMPTY:
            if name in CONTROLS:
                tree.controls[stack[-1]] += 1
            if name in BLOCK:
                flush()
            elif name == "br" and not unseen:
                parts.append(" ")
        else:
            if name in BLOCK:
                flush()
            unseen -= name in UNSEEN
            in_link -= name == "a"
            stack.pop()
            least = min(least, tree.regions[stack[-1]])
    flush()
    tree.sum_up()
    return out, tree


def _inherited(tree: Tree) -> tuple[list[float], list[float], list[int]]:
    """For each element: what speaks against and for it, its own hints or its parents', and its header (1 of the page, 2 of an article)."""
    total = max(1, tree.chars[0] - tree.linked[0])
    n = len(tree.parent)
    against, favour, header = [0.0] * n, [0.0] * n, [0] * n
    for k in range(1, n):
        p = tree.parent[k]
        own = tree.against[k]
        if own:
            share = (tree.chars[k] - tree.linked[k]) / total
            # An element around the page's heading, or around nearly all its text, is not what the hint says.
            if tree.heading[k] and tree.heading[k] == tree.heading[0] and share > 0.3:
                own *= 0.1
            elif share > 0.9:
                own *= 0.3
        against[k] = max(own, against[p] * FADES)
        favour[k] = max(tree.favour[k], favour[p] * FADES)
        if tree.favour[k] == WHOLE:
            header[k] = 0
        else:
            header[k] = header[p] or (tree.name[k] == "header") * (2 if favour[p] > 0.5 else 1)
    return against, favour, header


def _phrases(text: str) -> float:
    """The share of a text that phrases of boilerplate are."""
    low = text.lower()
    if not any(p in low for p in PHRASE_PARTS):
        return 0.0
    return sum(len(m.group()) for m in PHRASES.finditer(low)) / len(low)


def measured(found: list[Block], tree: Tree) -> np.ndarray:
    """A row of ``MEASURES`` for each block."""
    against, favour, header = _inherited(tree)
    total = max(1, tree.chars[0])
    out = np.zeros((len(found), len(MEASURES)))
    for i, b in enumerate(found):
        k, text = b.node, b.text
        n = text.count(" ") + 1
        # What is around: the element that the block shares with others, two levels up at most.
        around = k
        for _ in range(2):
            if tree.chars[around] <= len(text):
                around = tree.parent[around]
        near = tree.chars[around]
        controls = tree.controls[around] if near < 0.3 * total else tree.controls[k]
        heading = b.name in HEADINGS
        out[i] = (
            1.0,
            math.log1p(n) / 5,
            min(n, 60) / 60,
            b.linked,
            b.linked * math.log1p(n) / 5,
            text[-1] in ENDS,
            min(0.3, len(PUNCTUATION.findall(text)) / n) * 3,
            len(DIGIT.findall(text)) / len(text),
            min(1.0, _phrases(text) * 2),
            heading,
            b.name in ("p", "blockquote", "pre"),
            b.name in ("li", "dt", "dd"),
            b.name in ("td", "th"),
            against[k],
            favour[k] if against[k] < 0.5 else 0.0,
            header[k] == 1,
            header[k] == 2 and not heading,
            min(1.0, controls / 2),
            tree.linked[around] / max(1, near),
        )
    return out


class Flow:
    """Maximum flow by shortest augmenting levels; node 0 is the source, node 1 the sink."""

    def __init__(self, n: int):
        self.head: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.head[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.head[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self) -> list[int]:
        level, queue = [-1] * len(self.head), deque([0])
        level[0] = 0
        while queue:
            a = queue.popleft()
            for e in self.head[a]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def cut(self) -> list[bool]:
        """Which nodes stay on the source's side."""
        while True:
            level = self.levels()
            if level[1] < 0:
                return [x >= 0 for x in level]
            turn = [0] * len(self.head)
            path: list[int] = []
            a = 0
            while True:
                if a == 1:
                    least = min(self.room[e] for e in path)
                    first = 0
                    for k in range(len(path) - 1, -1, -1):
                        e = path[k]
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                        if self.room[e] <= 1e-9:
                            first = k
                    a = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                own = self.head[a]
                while turn[a] < len(own):
                    e = own[turn[a]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                        break
                    turn[a] += 1
                if turn[a] < len(own):
                    path.append(own[turn[a]])
                    a = self.to[own[turn[a]]]
                elif a == 0:
                    break
                else:
                    e = path.pop()
                    a = self.to[e ^ 1]
                    turn[a] += 1


def least_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: log(1 + exp(-s)) for calling a block of odds s content, log(1 + exp(s)) for the other, w for each edge cut."""
    # Both costs less the smaller one: the odds themselves, on the side that they speak for.
    excess = list(odds)
    beside: list[list[tuple[int, float]]] = [[] for _ in odds]
    free = [0.0] * len(odds)
    for a, b, w in edges:
        beside[a].append((b, w))
        beside[b].append((a, w))
        free[a] += w
        free[b] += w
    settled: list[bool | None] = [None] * len(odds)
    todo = deque(i for i in range(len(odds)) if abs(excess[i]) > free[i] + 1e-9)
    while todo:
        i = todo.popleft()
        if settled[i] is not None:
            continue
        settled[i] = excess[i] > 0
        for j, w in beside[i]:
            if settled[j] is None:
                excess[j] += w if settled[i] else -w
                free[j] -= w
                if abs(excess[j]) > free[j] + 1e-9:
                    todo.append(j)
    left = [i for i in range(len(odds)) if settled[i] is None]
    place = {i: k + 2 for k, i in enumerate(left)}
    flow = Flow(len(left) + 2)
    for i in left:
        if excess[i] > 0:
            flow.edge(0, place[i], excess[i])
        else:
            flow.edge(place[i], 1, -excess[i])
    for a, b, w in edges:
        if a in place and b in place:
            flow.edge(place[a], place[b], w, w)
    if left:
        side = flow.cut()
        for i in left:
            settled[i] = side[place[i]]
    return settled


def joined(found: list[Block], tree: Tree, near: float, sibling: float) -> list[tuple[int, int, float]]:
    """The smoothness edges: between neighbours in the page, and neighbours under the same parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        parent = tree.parent[b.node]
        before = last.get(parent, -1)
        if i:
            w = near / (1 + b.apart) ** 2
            if before == i - 1:
                w += sibling
            out.append((i - 1, i, w))
        if 0 <= before < i - 1:
            out.append((before, i, sibling))
        last[parent] = i
    return out


class Labeller:
    """The fitted weights: of the measures, and of the two kinds of edges."""

    def __init__(self, weights: np.ndarray, near: float, sibling: float):
        self.weights, self.near, self.sibling = weights, near, sibling

    def label(self, found: list[Block], tree: Tree) -> tuple[list[bool], list[float]]:
        """(which blocks are content, the classifier's log odds)."""
        odds = (measured(found, tree) @ self.weights).tolist()
        return least_cut(odds, joined(found, tree, self.near, self.sibling)), odds


@lru_cache(1)
def labeller() -> Labeller:
    from .htmltrain import fitted

    return fitted()


def main_text(page: str | None, by: Labeller | None = None) -> tuple[str, int, int, int]:
    """(main text, number of blocks, of content blocks, of labels that the cut changed against the classifier alone)."""
    found, tree = blocks(page or "")
    if not found:
        return "", 0, 0, 0
    labels, odds = (by or labeller()).label(found, tree)
    kept = [b.text for b, x in zip(found, labels) if x]
    return " ".join(kept), len(found), len(kept), sum(x != (s > 0) for x, s in zip(labels, odds))


def _extract(by: Labeller):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), *[(c, pa.int64()) for c in ("n_chars", "n_blocks", "n_content", "n_changed")]])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                got = [main_text(p, by) for p in part.column("html").to_pylist()]
                numbers = [[len(g[0]) for g in got], *([g[k] for g in got] for k in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array([g[0] for g in got], pa.string()), *[pa.array(x, pa.int64()) for x in numbers]], schema=schema)

    return run


def extract(pages: DataFrame, by: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_content and n_changed (labels that the cut changed) of every page."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract(by or labeller()), "page_id long, url string, text string, n_chars long, n_blocks long, n_content long, n_changed long")
