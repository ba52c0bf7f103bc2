"""Main text of pages."""

from __future__ import annotations

import html
import re

import numpy as np
import pytest

from utilscope.llm import html_text
from utilscope.llm.html_text import extract_main_text, main_text, surges

PAGE = """<html lang=en><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><nav>Home</nav><div class="wrapper"><main><article><header><h1>Title &amp;
more</h1></header><p>One <b>two</b><br>three&nbsp;four <span class="ad">BUY</span>five<p>Six<div class="ad">BUY</div>
<form><input>Sub</form><p class=notice>N</p><script>var t="</p>";</script><ul><li>i1<li>i2</ul></article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>nice</p></article></section></main>
<aside>side text</aside></div><footer>&copy; f</footer></body></html>"""


def test_the_article_alone():
    assert main_text(PAGE) == "Title & more\nOne two three four five\nSix\ni1\ni2"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a < b &amp; c<p>d", "a < b & c\nd"),
    ("<div class=menu>m</div><h2>Hi</h2><p>short</p><div class='sidebar'>long long long</div>", "Hi\nshort"),
    ("<article><div class='post-header'><h1>T</h1></div><p>x</p><div class='post-footer'>f</div></article>", "T\nx"),
    ("<div class='site-header'>S</div><article><p>x<span class='ad'>A</span> y</p></article>", "x y"),
    ("<nav>only a menu</nav>", ""), ("<article></article>", ""), ("<!-- c <p>x</p>", ""),
])
def test_small_pages(page, text):
    assert main_text(page) == text


def test_surge_and_dive():
    lengths = np.array([0, 5, 0, 0, 0, 90, 3, 0, 40, 0, 0, 0, 2])
    assert surges(lengths, 3, 86) == [(5, 9)]
    assert surges(np.array([0, 7]), 3, 86) == [(1, 2)] and surges(np.zeros(4, int)) == []


def test_all_test_pages_against_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row, got in zip(pages.collect(), extract_main_text(pages, ["page_id", "url"]).collect()):
        article = re.search(r"<article>(.*?)(</article>|\Z)", row["html"], re.S)[1]
        parts = [re.sub("<br>", " ", re.sub("</?b>", "", p)) for p in re.split("</?(?:p|h1)>", article)]
        blocks = [" ".join(html.unescape(p).split()) for p in parts]
        want = "\n".join(b for b in blocks if b)
        assert (got["page_id"], got["text"], got["n_chars"]) == (row["page_id"], want, len(want))


def test_long_and_broken_pages_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, None, "u", 1), (1, "<div>" * 20_000 + "x", "u", 1), (2, '<a "' * 20_000, None, 1), (None, "<p>" + "w " * 200_000, "u", 1)],
        "page_id long, html string, url string, inside int",
    )
    rows = extract_main_text(df, ["page_id", "url"]).collect()
    assert [r["n_chars"] for r in rows] == [0, 1, 0, 399_999]
    assert extract_main_text(df.limit(0), ["page_id"]).collect() == []


LONG = "A sentence of the real text that goes on for a while. " * 4
ITEMS = "".join(f"<div class='menu'>item {i}</div>" for i in range(4))


@pytest.mark.parametrize("page, text", [
    (f"<h1>Title</h1>{ITEMS}<p>{LONG}</p>{ITEMS.replace('menu', 'ad')}<p>The end.</p>", f"Title\n{LONG.strip()}\nThe end."),
    (f"<div>Title</div>{ITEMS}<div>{LONG}</div>{ITEMS}<div>The <a href=x>end</a>.</div>", f"Title\n{LONG.strip()}\nThe end."),
    (f"<div>{LONG}</div>{ITEMS}<ul><li>a</li><li>b</li></ul>{ITEMS}<div><a href=x>Next</a></div>", LONG.strip()),
    (f"<div><article><p>A teaser</p></article></div><div>{LONG}</div>", f"A teaser\n{LONG.strip()}"),
    (f"<article></article><div>{LONG}</div>", LONG.strip()), ("<article></article><div>few words</div>", "few words"),
    (f"<article><p>{LONG}</p></article><div>outside of it</div>", LONG.strip()),
    ("<article><p>Short.</p></article><div>outside of it</div>", "Short."),
])
def test_text_outside_of_articles_and_far_from_the_surge(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<div class='page-with-sidebar'><article><h1>T</h1><p>x</p></article><div class=sidebar>s</div></div>", "T\nx"),
    ("<div class='page-with-sidebar'><main><p>x</p></main></div>", "x"),
    ("<article class='post tag-cookies'><p>x</p></article>", "x"), ("<article class='comments-open'><p>x</p></article>", "x"),
    (f"<article><p>{LONG}</p></article><article class='post category-social'><p>x</p></article>", f"{LONG.strip()}\nx"),
    (f"<div id='menu-open'><p>{LONG}</p><div class='ad'>BUY</div></div><p>y</p>", f"{LONG.strip()}\ny"),
    ("<p>x <span class=ad>A <span>B</span> C</span>y</p>", "x y"),
    ("<app-root class='menu-open'><div><article><p>x</p></article></div></app-root>", "x"),
    (f"<div class='page-with-sidebar'><p>{LONG}</p></div><div class='comments'><p>{LONG * 2}</p></div>", LONG.strip()),
    (f"<p>{LONG}</p><div class='comments'><article class='comment'><p>{LONG * 3}</p></article></div>"
     "<article><p>x</p></article>", f"{LONG.strip()}\nx"),
    (f"<article><p>Short.</p></article><div class='post-menu'>{LONG}</div>", f"Short.\n{LONG.strip()}"),
    (f"<article><p>{LONG[:100]}</p></article><div class='ad'>{LONG}</div>", LONG[:100].strip()),
    (f"<p>{LONG}</p><div class='cookie-notice'>We use cookies</div>", LONG.strip()),
])
def test_names_of_wrappers_and_articles(page, text):
    assert main_text(page) == text


SECTIONS = [
    "<section id='discussion'>{}</section>", "<section id='related-work'>{}</section>", "<section id='menu-planning'>{}</section>",
    "<div id='login-errors'>{}</div>", "<section id='search-trees'>{}</section>", "<div id='header-files'>{}</div>",
    "<section class='menu-planning'>{}</section>", "<div class='related-work' id='comments-on-method'>{}</div>",
]


@pytest.mark.parametrize("main", ["article", "main"])
@pytest.mark.parametrize("section", SECTIONS)
def test_no_section_of_an_article_is_lost_by_its_id(main, section):
    page = f"<{main}><p>{LONG}</p>{section.format('<h2>Part</h2><p>Some more.</p>')}<p>{LONG}</p></{main}>"
    assert main_text(page) == f"{LONG.strip()}\nPart\nSome more.\n{LONG.strip()}"


@pytest.mark.parametrize("anchor", ["search-trees", "related", "menu", "comments", "footer", "discussion"])
def test_no_heading_is_lost_by_its_anchor(anchor):
    for page in (f"<article><p>{LONG}</p><h2 id='{anchor}'>Part</h2><p>x</p></article>", f"<p>{LONG}</p><h2 id='{anchor}'>Part</h2><p>x</p>"):
        assert main_text(page) == f"{LONG.strip()}\nPart\nx"


def test_every_line_of_a_trusted_article_is_kept():
    page = f"<article><h1>T</h1><ul><li>a</li></ul><div class=ad>BUY</div><table><tr><td>1</td></tr></table><p>{LONG}</p><p>Home</p></article>"
    assert main_text(page) == f"T\na\n1\n{LONG.strip()}\nHome"


REPLIES = "<p>I liked it a lot, thank you very much for all of it.</p>" * 12


@pytest.mark.parametrize("beside", [
    f"<section class='user-feedback'><h3>3 responses</h3>{REPLIES}</section>", f"<div><h3>Leave a comment</h3>{REPLIES}</div>",
    f"<section><div class=top><h2><b>12</b> Comments</h2></div>{REPLIES}</section>".replace("<b>12</b> ", "12 "),
    f"<section><h4>Comments (4)</h4>{REPLIES}</section>", "<article class='teaser'><h2>Another story</h2><p>It begins so</p></article>",
    "<article class='post-teaser'><p>Another story</p></article>",
])
@pytest.mark.parametrize("inside", [False, True])
def test_comments_by_their_form_and_teasers_are_left_out(beside, inside):
    article = f"<article><h1>T</h1><p>{LONG}</p></article>"
    page = f"<main>{article}{beside}</main>" if inside else f"{article}{beside}"
    assert main_text(page) == f"T\n{LONG.strip()}"


def test_an_article_on_responses_keeps_them():
    page = f"<article><p>{LONG}</p><h2>3 responses</h2><p>x</p></article>"
    assert main_text(page) == f"{LONG.strip()}\n3 responses\nx"


TOP = "<div>We use cookies to improve.</div><div>Home</div><div>Contact us: 555</div><div><a href=a>A</a></div>"
DIVS = f"{TOP}<div>Title</div><div>{LONG}</div><div>Next</div><div>{LONG}</div><div>The end.</div><div>© 2024 Somebody</div>"


def test_sums_decide_on_pages_of_plain_divs(monkeypatch):
    """A label between two paragraphs lies in the surge and stays; before and behind it, labels go."""
    assert main_text(DIVS) == f"Title\n{LONG.strip()}\nNext\n{LONG.strip()}\nThe end."
    monkeypatch.setattr(html_text, "surges", lambda lengths: [])
    assert main_text(DIVS) == f"Title\n{LONG.strip()}\n{LONG.strip()}\nThe end."


def test_layouts_of_divs_against_their_articles():
    """Generated layouts: whatever stands around it, the article comes out whole."""
    random = np.random.default_rng(4)
    around = ["<div>Home</div>", "<div><a href=x>About us</a></div>", "<div class='menu'>Products</div>", "<div>Contact us: 1</div>",
              "<div>We use cookies on this site.</div>", "<div>Copyright 2020 Them</div>", "<div><a href=x>An old story</a></div>"]
    body = ["<div>{}</div>", "<p>{}</p>", "<div><p>{}</p></div>", "<h2>{}</h2><p>{}</p>"]
    for _ in range(200):
        pick = lambda of, n: [of[i] for i in random.integers(0, len(of), n)]
        texts, blocks = [], []
        for form in pick(body, int(random.integers(1, 7))):
            words = [" ".join(pick(["some", "words", "of", "text"], int(random.integers(1, 60)))) + "." for _ in range(form.count("{}"))]
            texts += words
            blocks.append(form.format(*words))
        page = "".join([*pick(around, int(random.integers(0, 6))), *blocks, *pick(around, int(random.integers(0, 6)))])
        assert main_text(page) == "\n".join(texts), page
