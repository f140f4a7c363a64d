"""Pages with known labels, and the fit of the block classifier and of the smoothness on them.

Pages are drawn from layouts: their blocks' roles are known, and words are syllables, so that nothing but measures can be
learned. Content words never hold the letter q and boilerplate words of ``MARK`` do; a block's label is read off that way, and no
measure looks at letters. Class names are left out often, exchanged at times, and wrappers carry misleading ones, as on real pages.
"""

from __future__ import annotations

import numpy as np

from .htmlcut import Labeller, blocks, joined, least_cut, measured

PAGES, SEED, RIDGE = 500, 7, 0.02
MARK = "q"
SYLLABLES = "ta re mi no sel kor van dim pu est gra lo ner ish tu fen ol bra chi dor".split()
NEAR, SIBLING = (0.0, 0.3, 0.6, 1.2, 2.0), (0.0, 0.2, 0.5, 1.0)
WRAPPERS = "page,wrapper,site has-sidebar,layout-with-nav,no-sidebar,container,page-with-ads,comments-closed post,menu-open,content-area,row".split(",")


class Maker:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, of):
        return of[int(self.rng.integers(len(of)))]

    def word(self, mark: bool) -> str:
        out = "".join(self.pick(SYLLABLES) for _ in range(int(self.rng.integers(1, 4))))
        return out + MARK if mark else out

    def words(self, lo: int, hi: int, mark: bool) -> str:
        return " ".join(self.word(mark) for _ in range(int(self.rng.integers(lo, hi + 1))))

    def sentences(self, lo: int, hi: int, mark: bool) -> str:
        return " ".join((self.words(2, 6, mark) + ", " + self.words(1, 12, mark) if self.chance(0.5) else self.words(1, 16, mark)).capitalize() + self.pick("...!?") for _ in range(int(self.rng.integers(lo, hi + 1))))

    def hint(self, *names: str, p: float = 0.75) -> str:
        if not self.chance(p):
            return f' class="{self.pick(["", "x1", "block", "inner", "c-9"])}"' if self.chance(0.5) else ""
        return f' {self.pick(["class", "class", "id"])}="{self.pick(names)}"'

    def linked(self, text: str) -> str:
        words = text.split(" ")
        k = int(self.rng.integers(len(words)))
        words[k] = f'<a href="/x">{words[k]}</a>'
        return " ".join(words)

    # Content.

    def paragraph(self, tag: str = "p") -> str:
        text = self.sentences(1, 6, False) if self.chance(0.8) else self.words(1, 4, False) + self.pick(["", ".", ":"])
        if self.chance(0.2):
            text = self.linked(text)
        return f"<{tag}>{text}</{tag}>"

    def article(self) -> str:
        out = [f"<h1>{self.words(2, 9, False)}</h1>"] if self.chance(0.85) else []
        tag = self.pick(["p", "p", "p", "div"])
        for _ in range(int(self.rng.integers(1, 9))):
            draw = self.rng.random()
            if draw < 0.7:
                out.append(self.paragraph(tag))
            elif draw < 0.8:
                out.append(f"<h{self.pick('23')}>{self.words(1, 6, False)}</h{2}>")
            elif draw < 0.88:
                items = "".join(f"<li>{self.linked(self.words(1, 9, False)) if self.chance(0.3) else self.words(1, 14, False)}</li>" for _ in range(int(self.rng.integers(2, 6))))
                out.append(f"<ul>{items}</ul>")
            elif draw < 0.93:
                out.append(f"<blockquote>{self.sentences(1, 2, False)}</blockquote>")
            elif draw < 0.97:
                out.append(f"<figure><img src=x><figcaption>{self.words(2, 9, False)}</figcaption></figure>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3, False)}</td><td>{self.word(False)}</td></tr>" for _ in range(3)) + "</table>")
            if self.chance(0.12):
                out.append(self.inset())
        return "".join(out)

    # Boilerplate.

    def inset(self) -> str:
        kind = self.pick(["ad", "ad", "related", "share", "news"])
        if kind == "ad":
            return f"<div{self.hint('ad', 'advert', 'sponsored', 'ad-slot', 'promo-box', p=0.95)}>{self.sentences(1, 3, True)}</div>"
        if kind == "related":
            return f"<div{self.hint('related', 'related-posts', 'recommended')}>{self.links(2, 5)}</div>"
        if kind == "share":
            return f"<div{self.hint('share', 'social', 'share-buttons')}><a href=x>Share this {self.word(True)}</a> <a href=y>{self.word(True)}</a></div>"
        return f"<form{self.hint('newsletter', 'subscribe')}><p>Subscribe to {self.words(1, 6, True)}.</p><input><button>{self.word(True)}</button></form>"

    def links(self, lo: int, hi: int) -> str:
        items = [f"<a href='/{k}'>{self.words(1, 5, True)}</a>" for k in range(int(self.rng.integers(lo, hi + 1)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.7) else " | ".join(items)

    def navigation(self) -> str:
        tag = self.pick(["nav", "nav", "div", "td"])
        return f"<{tag}{self.hint('nav', 'menu', 'navbar', 'main-menu', 'navigation')}>{self.links(2, 9)}</{tag}>"

    def header(self) -> str:
        tag = self.pick(["header", "header", "div"])
        return f"<{tag}{self.hint('banner', 'masthead', 'site-header', p=0.6)}><div>{self.words(1, 4, True)}</div>{self.pick(['', f'<p>{self.words(3, 9, True)}</p>'])}{self.navigation() if self.chance(0.5) else ''}</{tag}>"

    def notice(self) -> str:
        return f"<div{self.hint('cookie', 'cookie-banner', 'notice', 'consent', 'alert')}><p>{self.pick(['We use cookies ', 'We use cookies: ', ''])}{self.sentences(1, 2, True)}</p><button>{self.word(True)}</button>{self.pick(['', f'<a href=p>Privacy policy {self.word(True)}</a>'])}</div>"

    def sidebar(self) -> str:
        tag = self.pick(["aside", "div", "td", "div"])
        parts = [f"<h3>{self.words(1, 4, True)}</h3>{self.links(2, 6)}" if self.chance(0.6) else f"<div><h4><a href=r>{self.words(2, 6, True)}</a></h4><p>{self.sentences(1, 2, True)} <a href=m>Read more {self.word(True)}</a></p></div>" for _ in range(int(self.rng.integers(1, 4)))]
        return f"<{tag}{self.hint('sidebar', 'sidebar-right', 'widget-area', 'sidebar-content', p=0.9 if tag != 'aside' else 0.5)}>{''.join(parts)}</{tag}>"

    def comments(self) -> str:
        tag = self.pick(["section", "div", "ol"])
        inner = self.pick(["div", "article", "li"])
        own = "".join(f"<{inner}{self.hint('comment', 'comment-body', 'reply')}><b>{self.word(True)}</b> <span>{self.word(True)}</span><p>{self.sentences(1, 5, True)}</p>{self.pick(['', f'<a href=r>{self.word(True)}</a>'])}</{inner}>" for _ in range(int(self.rng.integers(1, 7))))
        return f"<{tag}{self.hint('comments', 'comments-list', 'discussion', 'responses comments', p=0.97)}><h2>{self.words(1, 3, True)}</h2>{own}</{tag}>"

    def footer(self) -> str:
        tag = self.pick(["footer", "footer", "div"])
        return f"<{tag}{self.hint('footer', 'site-footer', 'footer-inner', p=0.9 if tag == 'div' else 0.3)}><p>{self.pick(['&copy; 2024 ', '', ''])}{self.words(2, 8, True)}{self.pick(['', ' All rights reserved.', '.'])}</p>{self.pick(['', f'<p>{self.sentences(1, 2, True)}</p>'])}{self.links(1, 5)}</{tag}>"

    def page(self) -> str:
        article, semantic = self.article(), self.chance(0.4)
        if semantic:
            inside = self.pick(["", f"<header>{self.pick(['', '<h2>' + self.words(2, 5, False) + '</h2>'])}</header>"]) + article + (self.comments() if self.chance(0.25) else "")
            article = f"<article{self.hint('post', 'story', 'alert-news post', 'entry', p=0.5)}>{inside}</article>"
        elif self.chance(0.7):
            article = f"<div{self.hint('content', 'entry-content', 'post', 'story-body', 'main-content', 'social-science', 'text', p=0.5)}>{article}</div>"
        if self.chance(0.3):
            article = f"<main>{article}</main>"
        around = [self.sidebar()] * self.chance(0.35)
        if self.chance(0.1):
            body = f"<table><tr><td>{self.links(3, 8)}</td><td>{article}</td></tr></table>"
        else:
            body = "".join([*around, article] if self.chance(0.4) else [article, *around])
        above = [f() for f, p in ((self.notice, 0.25), (self.header, 0.45), (self.navigation, 0.55)) if self.chance(p)] + [self.inset()] * self.chance(0.3)
        below = [f() for f, p in ((self.comments, 0.3), (self.footer, 0.7), (self.notice, 0.1)) if self.chance(p)]
        body = "".join([*above, body, *below])
        for _ in range(int(self.rng.integers(0, 3))):
            body = f'<div class="{self.pick(WRAPPERS)}">{body}</div>'
        if self.chance(0.08):
            body = f"<form id=aspnet>{body}<input type=hidden></form>"
        return f"<html><head><title>{self.words(2, 5, False)}</title></head><body{self.pick(['', ' class=page', ' class=has-menu'])}>{body}</body></html>"


def labelled(pages: int, seed: int) -> list[tuple]:
    """(blocks, tree, labels) of so many pages."""
    maker, out = Maker(np.random.Generator(np.random.PCG64(seed))), []
    for _ in range(pages):
        found, tree = blocks(maker.page())
        out.append((found, tree, np.array([MARK not in b.text.replace("Subscribe", "").lower() for b in found])))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Weights of log odds, by Newton's method on the penalised likelihood."""
    w = np.zeros(x.shape[1])
    penalty = ridge * len(y) / 100 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def wrong(by: Labeller, pages: list[tuple]) -> int:
    """The number of blocks that get the wrong label."""
    return sum(int((np.array(by.label(found, tree)[0], bool) != y).sum()) for found, tree, y in pages if found)


def fitted(pages: int = PAGES, seed: int = SEED) -> Labeller:
    """Weights from two thirds of the pages; of the strengths of the edges, those with the fewest errors on the others."""
    made = labelled(pages, seed)
    train, rest = made[: 2 * pages // 3], made[2 * pages // 3 :]
    weights = logistic(np.concatenate([measured(f, t) for f, t, _ in train if f]), np.concatenate([y for f, _, y in train if f]).astype(float))
    odds = [(measured(f, t) @ weights).tolist() for f, t, _ in rest]
    best = None
    for near in NEAR:
        for sibling in SIBLING:
            errors = sum(int((np.array(least_cut(o, joined(f, t, near, sibling)), bool) != y).sum()) for (f, t, y), o in zip(rest, odds) if f)
            if best is None or errors < best[0]:
                best = (errors, near, sibling)
    return Labeller(weights, best[1], best[2])
