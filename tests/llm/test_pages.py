"""Pages with a known article."""

import html
import random
import time

import pytest

from pulsegrid.llm.pages import extract, main_text

CLUTTER = [
    "<nav><ul><li><a href='/a'>Home</a></li><li><a href=/b>About us</a></li></ul></nav>",
    "<header><h2>The Site</h2><p>Some tagline of the site that goes on and on for a good while, really.</p></header>",
    '<div class="ad">Buy now, the best offer of the year, only today and only here, do not miss it at all.</div>',
    "<!-- <p>comment</p> --><script>var a = '<p>no</p>';</script><style>p{x:y}</style>",
    '<aside class="sidebar"><p>Read also this long teaser about something else that is not the article.</p></aside>',
    '<div id="cookie-notice"><p>We use cookies to make this page much better for all of our visitors.</p></div>',
    '<form action="/s"><label>Search this site</label><input name=q><button>Go on</button></form>',
    '<footer>&copy; example &middot; All rights reserved by the owners of this site, since a long time.</footer>',
    '<section class="comments"><div class="comment"><p>First! I liked this article a lot, thank you for writing.</p></div></section>',
    "<div style='display: none'>Hidden text that nobody sees because the style hides it from all.</div>",
]


def page(rng, wrap):
    words = lambda n: " ".join(rng.choice(["alpha", "b&c", "<x", "dé", '"q"', "ok."]) for _ in range(n))
    parts = [words(5)] + [words(rng.choice([1, 3, 20, 60])) for _ in range(rng.randint(1, 8))]
    body = f"<h1>{html.escape(parts[0])}</h1>"
    for p in parts[1:]:
        text = html.escape(p).replace(" ", rng.choice([" ", "\n", " <b>", "&#32;"]), 1)
        body += f"<p>{text}</p>" if rng.random() < 0.8 else f"<div><p>{text}</div>"
        if rng.random() < 0.3:
            body += rng.choice(CLUTTER[2:])  # a header inside an article is its own
    around = rng.sample(CLUTTER, 5)
    page = "".join(around[:3]) + wrap[0] + body + wrap[1] + "".join(around[3:])
    return f"<!DOCTYPE html><html class='no-menu'><head><title>T</title></head><body class='has-sidebar'>{page}</body></html>", " ".join(parts)


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ("<main>", "</main>"), ("<div role='main'>", "</div>")])
def test_articles(wrap):
    rng = random.Random(8)
    for _ in range(200):
        source, want = page(rng, wrap)
        assert main_text(source) == want, source


def test_unmarked_page():
    prose = "This is a paragraph of prose that is long enough to be taken for the text of the page. " * 2
    links = "".join(f"<div><a href='/{i}'>Link number {i}</a></div>" for i in range(20))
    page = f"<body><div>{links}</div><div><p>{prose}<p>Short.</p><p>{prose}</div><div>{links}</div></body>"
    assert main_text(page) == f"{prose}Short. {prose}".strip()


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>a</p", "a"), ("<article><p>cut &am", "cut &am"), ("<script>x", ""),
    ("<article>a<br>b&nbsp;c<b>d</b>e</article>", "a b cde"), ("<p>1 < 2</p>", "1 < 2"), ("<!-- open", ""),
    ("<article><p class=\"x>y</p><p>z</p></article>", 'y z'),
])
def test_edges(page, want):
    assert main_text(page) == want


def test_table(spark):
    rows = [(1, "u", "<article>hé \U0001f600</article>"), (1, "u", None), (None, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract(pages).collect())
    assert got == [(0, "", "", 0), (1, "u", "", 0), (1, "u", "hé \U0001f600", 4)]
    assert extract(pages.limit(0)).collect() == []


def test_given_pages(spark, tiny):
    import re

    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(p|h1|br)>", " ", inner).replace("<b>", "")).split())
        assert got[r.page_id] == want


@pytest.mark.parametrize("attributes", [
    'href="/trips/hidden-valley"', "title='The hidden cost'", "href=/class=hidden/x", 'data-hidden="1"', 'title="role=main class=ad id=menu"', 'data-class="sidebar"',
    'title="a hidden', "alt='style=display:none'",
])
def test_words_in_values(attributes):
    """What a value says, or the end of a longer name, hides nothing."""
    assert main_text(f"<article><p>See <a {attributes}>this valley</a> now.</p></article>") == "See this valley now."


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", "class=x hidden", 'aria-hidden = "true"', 'title="a" style="display:none"', "data-x='1'class='ad'"])
def test_hidden(attributes):
    assert main_text(f"<div><p>{'Some prose is here. ' * 9}</p><p {attributes}>gone</p></div>") == ("Some prose is here. " * 9).strip()


@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div role=main>{}</div>", "<div class=menu><article>{}</article></div>"])
def test_layout_word_around_article(inner):
    body = "<p>One.</p><div class=ad><p>Buy now.</p></div><p>Two.</p>"
    page = f"<nav>Home</nav><div class='page sidebar-left'><p>Beside.</p>{inner.format(body)}<p>After.</p></div><footer>End</footer>"
    assert main_text(page) == "One. Two."
    # beside an article of its own, and where hidden, such a one is no text of the page
    assert main_text(page + "<article>Own.</article>") == "Own."
    assert main_text(f"<div hidden>{page}</div>") == main_text(f"<div class=comments>{page}</div>") == ""
    prose = "This is prose that is longer than the teaser beside it. " * 4
    assert main_text(f"<p>{prose}</p>{page}") == prose.strip()


@pytest.mark.parametrize("page, want", [
    ('<article><p class="notice">Cookie notice<p>Real article', "Real article"),
    ('<article><ul><li class="share">Share<li>One<ul><li class=ad>Ad<li>Two</ul><li>Three</ul>', "One Two Three"),
    ("<article><dl><dt class=notice>N<dd>D<dt>T</dl>x", "D T x"),
    ("<article><table><tr><td class=ad>A<td>B<tr><td>C<table><td class=promo>P</table>D</table>E", "B C D E"),
    ("<article><p class=notice>N<div>D</div>E", "D E"),
    ("<article><select><option>a<option>b</select>c", "c"),
    ("<article><p>a<b>b<p>c</b>d", "ab cd"),
    ("<article><p class=ad>x<table><td><p>y</table>z", "y z"),
    ('<article>A<div class="article-share">S</div><p class="entry-footer">F</p><div class=story-ad>X</div><div class="ad-content">C</div>', "A C"),
    ('<article><div class="entry-content has-sidebar no-ads"><p>T</p></div><div class="post related">R</div>', "T"),
    ("<article><header><h1>Title</h1><p>By A. Uthor</p></header><p>Text</p></article>", "Title Text"),
])
def test_names_and_implied_ends(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("piece", ["<p><b>x</b>", "<b>x", "<li>x", "<td><p>x", "<div>x</p></i>", "<p><table>"])
def test_a_megabyte_of_open_elements(piece):
    """Time in proportion to the page, however many elements stay open."""
    begin = time.process_time()
    main_text("<article>" + piece * (1_000_000 // len(piece)))
    assert time.process_time() - begin < 8


def test_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, "<article>é😀</article>"), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "9L AS n_chars")
    got = sorted(map(tuple, extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (2, None, "é😀", 2), (None, "v", "", 0)], key=str)
    assert extract(pages.where("false")).collect() == []
