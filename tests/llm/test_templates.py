"""Templates are counted by articles, at any size of the host."""

import random
import time
from collections import defaultdict

import pytest

from millrace.llm import html


def extracted(spark, pages, **options):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_pages(df, **options).collect()}
    assert got == {r.page_id: r.text for r in html.extract_pages(df, max_broadcast=0, **options).collect()}
    return got


def test_a_site_name_as_heading_hides_no_template(spark):
    page = "<body><div><h1>Site name</h1></div><article><h2>T{0}</h2><p>text {0}</p><div class='c'>Join us</div></article></body>"
    got = extracted(spark, [page.format(i) for i in range(20)])
    assert got[7] == "T7\n\ntext 7"


def test_a_template_of_a_section_goes_on_a_large_host(spark):
    page = "<article><h1>T{0}</h1><p>text {0}</p>{1}</article>"
    got = extracted(spark, [page.format(i, "<div class='c'>Only here</div>" if i < 12 else "") for i in range(1500)])
    assert got[3] == "T3\n\ntext 3"


def one(html_text: str) -> str:
    root = html.parse(html_text)
    html.put_hashes(html.walk(root))
    return html.extract(root, frozenset())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article class="post has-sidebar no-comments"><p>text</p></article>', "text"),
        ('<div class="content-sidebar-wrap"><article><p>a</p></article></div>', "a"),
        ('<article><p class="social-history">kept</p></article>', "kept"),
        ("<article>Let <math><mi>x</mi></math> be <label>one</label></article>", "Let x be one"),
        ('<article hidden>z<div style="display:none">w</div></article>', "z\n\nw"),
        ('<form><div class="sidebar"><article>only</article></div></form>', "only"),
        ('<section id="comments"><article class="comment">c</article></section><article>real<div class="share-box">s</div><div class="site-footer">f</div></article>', "real"),
        ('<div class="sidebar-left">x</div><div role="main">m<div class="post-comments">c</div></div>', "m"),
        ("<main>a<aside>b</aside><form>c</form><p>d</main>", "a\n\nd"),
    ],
)
def test_class_words_cost_no_page_its_article(page, text):
    assert one(page) == text


def test_time_is_linear_in_what_is_left_open():
    n = 20_000
    began = time.process_time()
    for page in ("<b>" * n + "</i>" * n + "<p></p>" * n, "<li><ul>" + "<b>" * n + "<li></li>" * n, "<div>" * n + "</div>" * n):
        html.parse(page)
    assert time.process_time() - began < 10


def test_pages_against_brute_force(spark):
    """Pages put together from known blocks: what stays follows from how many articles of the host hold a box."""
    rng = random.Random(4)
    boxes = [f"box {k} <b>of</b> words" for k in range(12)]
    pages, spec = [], []
    for i in range(150):
        host, article = f"h{i % 3}.example", i if i % 5 else 0  # every fifth page is a copy of one article
        inner = random.Random(article)
        parts = [("h1", f"Title {article}")]
        for _ in range(inner.randrange(1, 8)):
            parts.append(rng.choice([("p", "shared passage of prose &amp; more"), ("p", f"text {inner.randrange(99)}\n of  it"), ("div", None)]) if article else ("p", f"text {inner.randrange(99)}"))
        if article == 3:
            parts.append(("p", "long " * 60_000))
        parts = [(tag, rng.choice(boxes[: 2 + i % 3 * 5]) if text is None else text) for tag, text in parts]
        body = "".join(f"<p>{text}</p>" if tag == "p" else f"<h1>{text}</h1>" if tag == "h1" else f'<div class="b">{text}</div>' for tag, text in parts)
        pages.append((i, f"http://{host}/{i}", f"<nav>menu {i}</nav><div class='ad'>buy {i}</div><article>{body}</article><footer>f{i}</footer>"))
        spec.append((host, article, parts))
    pages += [(500, None, None), (501, "http://h0.example/e", "")] + [pages[7]] * 2
    seen = defaultdict(set)
    for host, article, parts in spec:
        for tag, text in parts:
            if tag == "div":
                seen[host, text].add(article)
    want = {i: "\n\n".join(" ".join(html.unescape(text.replace("<b>", "").replace("</b>", "")).split()) for tag, text in parts if tag != "div" or len(seen[host, text]) < html.MIN_TITLES) for i, (host, article, parts) in enumerate(spec)}
    assert any(len(v) >= html.MIN_TITLES for v in seen.values()) and any(len(v) < html.MIN_TITLES for v in seen.values())
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as text", "3 as hash", "4 as title")
    for options in ({}, {"max_broadcast": 0}):
        got = html.extract_pages(df, **options).collect()
        assert len(got) == len(pages)
        for r in got:
            assert r.text == want.get(r.page_id, "") and r.n_chars == len(r.text)


@pytest.mark.parametrize("around", ["article", "main", 'div role="main"'])
def test_what_articles_share_is_content(spark, around):
    """Lists, definition lists, tables, plain boxes and prose that twelve articles share; the wanted text is put together from the blocks, without the extractor's rules."""
    shared = [
        ("<ul><li>1 tsp salt</li><li>3 <b>eggs</b></li></ul>", ["1 tsp salt", "3 eggs"]),
        ("<table><tr><td>Vegan</td><td>Yes</td></tr><tr><th>Serves</th></tr></table>", ["Vegan", "Yes", "Serves"]),
        ('<table class="facts"><caption>Facts</caption><tr><td>4 <a href="/x">g</a> of it</td></tr></table>', ["Facts", "4 g of it"]),
        ("<dl><dt>Term</dt><dd>what it means</dd></dl>", ["Term", "what it means"]),
        ("<div>A plain box of prose.</div>", ["A plain box of prose."]),
        ('<p class="lead">A lead that all have.</p>', ["A lead that all have."]),
        ("<div>See <a href='/a'>this</a> and much that is no link</div>", ["See this and much that is no link"]),
        ("<blockquote>Said by all</blockquote><p>shared passage</p><ol><li>Stir</li></ol>", ["Said by all", "shared passage", "Stir"]),
    ]
    templates = [
        '<ul><li><a href="/one">one</a></li><li><a href="/two">two</a></li></ul>',
        '<div class="x"><p>Read on <a href="/more">more of this and that here</a></p></div>',
        "<div>Write to us <button>Send</button></div>",
        '<div class="joined">Join us</div>',
    ]
    rng = random.Random(9)
    pages, want = [], {}
    for i in range(24):
        parts = [(t, w) for t, w in shared] + [(t, []) for t in templates]
        rng.shuffle(parts)
        own = [f"Title {i}", f"text of {i}"]
        body = f"<h1>{own[0]}</h1><p>{own[1]}</p>" + "".join(t for t, _ in parts)
        pages.append(f"<nav><a href='/'>home</a></nav><{around}>{body}</{around.split()[0]}><p>after all</p>")
        want[i] = "\n\n".join(own + [x for _, w in parts for x in w])
    assert extracted(spark, pages) == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><div class="restaurant-menu"><p>Soup</p></div><section id="comment"><p>We comment.</p></section></article>', "Soup\n\nWe comment."),
        ('<article>a<div class="main-menu">x</div><div class="restaurant-menu"><a href="/">x</a></div><div class="cookie-notice">y</div><div class="comment">c</div></article>', "a"),
        ('<article><section id="notice"><p>Notice of a sale</p></section><div id="share"><a href="/s">tell</a></div></article>', "Notice of a sale"),
        ('<main><h1>T</h1><div class="school-search">A search for schools</div><div class="search">find</div></main>', "T\n\nA search for schools"),
    ],
)
def test_names_that_an_article_may_be_about(page, text):
    assert one(page) == text
