"""HTML as balanced events, read in one pass with memory for the open elements only."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.DOTALL)
ATTR = re.compile(r"""([a-zA-Z_:@][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style template noscript iframe svg math object select option button textarea title canvas audio video noembed noframes datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot".split())
#: What an element closes when it opens, and the elements that this doesn't reach out of.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol menu dl table select".split())
SECTIONS = frozenset("article main section td th table aside nav body".split())
PHRASING = frozenset("p b i a span em strong li u s small font".split())

TEXT, OPEN, EMPTY, CLOSE = range(4)


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values as written, without quotes; the first of a repeated name counts."""
    out: dict[str, str] = {}
    for name, value in ATTR.findall(raw):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), value)
    return out


def walk(page: str) -> Iterator[tuple[int, str, str]]:
    """(TEXT, text, ''), (OPEN, name, raw attributes), (EMPTY, name, raw attributes) and (CLOSE, name, ''); each OPEN has its CLOSE.

    Names are in lower case, text is as written (references not decoded). What is unclosed ends where its parent does, or where
    HTML says that it must; an end tag without its start tag is left out.
    """
    stack: list[str] = []
    is_open: defaultdict[str, int] = defaultdict(int)

    def up_to(k: int):
        while len(stack) > k:
            name = stack.pop()
            is_open[name] -= 1
            yield CLOSE, name, ""

    def innermost(names, stop) -> int:
        """The place of the innermost open element of ``names``, or -1 if one of ``stop`` is further in."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in names:
                return k
            if stack[k] in stop:
                break
        return -1

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            yield TEXT, page[at:], ""
            break
        if start > at:
            yield TEXT, page[at:start], ""
        m = TOKEN.match(page, start)
        if m is None:  # a bare <
            yield TEXT, "<", ""
            at = start + 1
            continue
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name == "br":
                yield EMPTY, name, ""
                continue
            if is_open[name]:
                k = len(stack) - 1 if stack[-1] == name else innermost((name,), SECTIONS if name in PHRASING else ())
                if k >= 0:
                    yield from up_to(k)
            continue
        if name in CLOSES_P and is_open["p"]:
            k = innermost(("p",), BLOCK - {"p"})
            if k >= 0:
                yield from up_to(k)
        if name in CLOSES and any(is_open[n] for n in CLOSES[name]):
            k = innermost(CLOSES[name], LISTS)
            if k >= 0:
                yield from up_to(k)
        if name in VOID or (m.group(3).endswith("/") and name not in BLOCK and name not in RAW):
            yield EMPTY, name, m.group(3)
            continue
        stack.append(name)
        is_open[name] += 1
        yield OPEN, name, m.group(3)
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}", re.IGNORECASE).search(page, at)
            inside = page[at : stop.start()] if stop else page[at:]
            if inside:
                yield TEXT, inside, ""
            at = stop.start() if stop else end
    yield from up_to(0)
