"""Extraction on pages with known text, and the cut against all labellings of small graphs."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest

from shutterlake.llm import htmlcut, htmltrain, htmltree

ARTICLE = (
    "<h1>The long road</h1><p>It was raining in the town when the old bridge fell, and nobody saw it happen.</p><p>Short one.</p>"
    "<p>Her cookie recipe won the prize at the fair.</p><ul><li>first thing</li><li>second thing</li></ul><p>The copyright court ruled on Monday.</p>"
)
TEXT = "The long road It was raining in the town when the old bridge fell, and nobody saw it happen. Short one. Her cookie recipe won the prize at the fair. first thing second thing The copyright court ruled on Monday."
AROUND = (
    '<header class="site-header"><div>The Gazette</div><nav><a href="/">Home</a> <a href="/a">About us</a></nav></header>{}'
    '<aside><h3>More</h3><ul><li><a href="x">Other stories today</a></li></ul></aside><footer><p>&copy; 2024 The Gazette. All rights reserved.</p></footer>'
)


@pytest.mark.parametrize("name", ["page has-sidebar", "no-sidebar", "layout-with-nav", "comments-closed post", "social-science", "alert-news", "content", "x"])
@pytest.mark.parametrize("attr", ["class", "id"])
@pytest.mark.parametrize("around", ["{}", AROUND])
def test_wrappers_keep_their_article(name, attr, around):
    page = "<html><body>" + around.format(f'<div {attr}="{name}">{ARTICLE}</div>') + "</body></html>"
    assert htmlcut.main_text(page)[0] == TEXT
    page = f'<body><div {attr}="{name}">' + around.format(f"<article>{ARTICLE}</article>") + "</div></body>"
    assert htmlcut.main_text(page)[0] == TEXT


@pytest.mark.parametrize(
    "extra",
    [
        '<section class="comments"><h2>Comments</h2><div class="comment"><b>Ann</b><p>I liked this story very much, it was a good read.</p></div></section>',
        '<ol id="comments-list"><li><p>What a nonsense, I have never read such a thing before.</p></li><li><p>Agreed.</p></li></ol>',
        '<div class="ad">Buy the best umbrella of the year, it never breaks. Only today.</div>',
        '<div class="cookie-banner"><p>We use cookies to make this site work better for you.</p><button>Accept</button></div>',
        '<form><label>Name</label><input name=n><p>Subscribe to our newsletter.</p><button>Send</button></form>',
        '<div class="share-buttons"><a href="a">Share on one</a> <a href="b">Share on two</a></div>',
        '<div class="sidebar"><h4><a href=r>Another story</a></h4><p>Nobody knew what the mayor was going to say. <a href=m>Read more</a></p></div>',
        "<script>var a = '<p>x</p>';</script><style>p{}</style><noscript>Switch it on.</noscript><!-- <p>gone</p> -->",
        '<p style="display: none">You cannot see this sentence here.</p><p hidden>Nor this one.</p>',
    ],
)
def test_boilerplate_goes(extra):
    for inside in (f"<article>{ARTICLE}{extra}</article>", f"<article>{ARTICLE}</article>{extra}", f'{extra}<div class="entry-content">{ARTICLE}</div>'):
        assert htmlcut.main_text("<html><body>" + AROUND.format(inside) + "</body></html>")[0] == TEXT


def test_form():
    page = "<article><h1>A &lt; B</h1><p>One <b>two</b>\n three.<p>Four&nbsp;and&#32;five.<br>Six."
    assert htmlcut.main_text(page)[0] == "A < B One two three. Four and five. Six."
    for nothing in (None, "", "<script>x", "<nav><a href=x>Home</a></nav>", "<!--"):
        assert htmlcut.main_text(nothing)[0] == ""


def test_walk_balances():
    pool = ["<p>", "</p>", "<div class='a'>", "</div>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<br>", "<img src=x>", "text", "<script>", "</script>", "<", "<!-- c", "-->", "</x>", "<br/>", "<x/>"]
    rng = np.random.default_rng(1)
    for _ in range(2000):
        page = "".join(rng.choice(pool, rng.integers(0, 25)))
        stack = []
        for kind, name, _ in htmltree.walk(page):
            if kind == htmltree.OPEN:
                stack.append(name)
            elif kind == htmltree.CLOSE:
                assert stack.pop() == name
        assert not stack


def test_cut_is_the_least_of_all_labellings():
    rng = np.random.default_rng(2)
    changed = 0
    for _ in range(300):
        n = int(rng.integers(1, 9))
        odds = rng.normal(0, 1.5, n).tolist()
        edges = [(i - 1, i, float(rng.random() * 2)) for i in range(1, n)] + [(i, j, float(rng.random())) for i in range(n) for j in range(i + 2, n) if rng.random() < 0.3]
        cost = lambda x: sum(math.log1p(math.exp(-s if y else s)) for s, y in zip(odds, x)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: E731,B023
        got = htmlcut.least_cut(odds, edges)
        assert cost(got) == pytest.approx(min(cost(x) for x in itertools.product((False, True), repeat=n)))
        changed += got != [s > 0 for s in odds]
    assert changed > 50


def test_flow():
    flow = htmlcut.Flow(4)
    for a, b, c in ((0, 2, 3.0), (0, 3, 1.0), (2, 1, 1.0), (3, 1, 3.0), (2, 3, 1.0)):
        flow.edge(a, b, c)
    assert flow.cut() == [True, False, True, False]


def test_fitted_on_other_pages():
    by, pages = htmlcut.labeller(), htmltrain.labelled(150, 4711)
    n = sum(len(f) for f, _, _ in pages)
    errors = htmltrain.wrong(by, pages)
    assert errors < 0.025 * n and by.near > 0
    assert any(a != (s > 0) for f, t, _ in pages if f for a, s in zip(*by.label(f, t)))
    # The cut doesn't make the classifier worse, and the fit is the same each time.
    assert errors <= htmltrain.wrong(htmlcut.Labeller(by.weights, 0, 0), pages)
    assert np.array_equal(htmltrain.fitted(60).weights, htmltrain.fitted(60).weights)


def test_deep_pages_take_memory_in_proportion():
    by, peak = htmlcut.labeller(), []
    for n in (4000, 8000):
        tracemalloc.start()
        assert len(htmlcut.blocks("<div>x" * n)[0]) == n
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < 2.5 * peak[0]
    assert htmlcut.main_text("<div>x" * 50_000, by)[1] == 50_000
    assert htmlcut.main_text("<div><b></i></p>x" * 20_000, by)[1] == 20_000


def test_tables(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "t"), (1, "u", f"<article>{ARTICLE}</article>", "t"), (2, None, None, None), (None, "u", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(repr, (tuple(r)[:4] for r in htmlcut.extract(pages).collect())))
    assert got == sorted(map(repr, [(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "u", "", 0)]))
    assert htmlcut.extract(pages.limit(0)).count() == 0
