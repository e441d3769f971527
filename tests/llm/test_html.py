"""Site templates inside articles; names that only look like those of menus; deep pages."""

import re
import time
from collections import Counter
from xml.etree import ElementTree

import pytest

from textloom.llm.html_extraction import extract, main_text, templates

NAMES = [
    '<p class="legal-theory">', '<p id="social-impact">', '<section id="discussion">', '<div class="feedback-loops">', '<div class="discussion-body">',
    '<div class="article-header">', '<p class="notice-of-change">', '<h2 id="comments-on-kant">', '<div class="ad-hoc-methods">', "<math>",
]


@pytest.mark.parametrize("tag", NAMES)
def test_article_text_stays(tag):
    assert main_text(f"<article><p>before</p>{tag}body</{tag.split()[0][1:].rstrip('>')}></article>").split() == ["before", "body"]


@pytest.mark.parametrize("tag", ['div class="ad"', "div id=ad-slot-3", 'p class="ad"', 'ul class="share-buttons"', "section id=comments", 'div class="siteNav"', 'div class="cookie-notice x"'])
def test_named_parts_go(tag):
    assert main_text(f"<article><p>text</p><{tag}>gone</{tag.split()[0]}></article>") == "text"


def planted(site, page):
    """A page of a site: nothing says what its menu, notice and adverts are; two adverts take turns."""
    menu = "<ul><li><a href=/a>Home</a></li><li><a href=/b>World</a></li></ul>"
    notice = "<p>We value your privacy and use crumbs.</p>"
    advert = ["<div><p>Buy one shoe</p></div>", "<section><p>Buy two hats</p></section>"][page % 2]
    own = "".join(f"<p>Paragraph {k} of story {page} on {site}.</p>" for k in range(4))
    quoted = "<p>A passage that some pages quote.</p>" if page % 5 == 0 else ""
    wanted = [f"Story {page}", *(f"Paragraph {k} of story {page} on {site}." for k in range(4))] + (["A passage that some pages quote."] if quoted else [])
    return f"<body><article>{menu}<h1>Story {page}</h1>{advert}{own}{quoted}{notice}</article></body>", "\n".join(wanted)


def test_template_inside_articles_goes(spark):
    rows, want = [], {}
    for page in range(60):
        for n, site in enumerate(["one.example", "two.example"]):
            html, want[page * 2 + n] = planted(site, page)
            rows.append((page * 2 + n, f"http://{site}/{page}", html))
    # a small host: no template can be told
    html, _ = planted("three.example", 0)
    rows.append((1000, "http://three.example/0", html))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert got.pop(1000).startswith("Home\nWorld\nStory 0\nBuy one shoe")
    assert got == want
    assert all(main_text(h) != want[i] for i, _, h in rows if i < 1000)  # without the template they'd be another text

    # the same template, counted by another reader: elements of the article, lists as wholes
    count, sizes = Counter(), Counter()
    for _, url, html in rows:
        host = url.split("/")[2]
        sizes[host] += 1
        article = ElementTree.fromstring(re.sub("href=(/.)", r'href="\1"', html)).find("article")
        count.update({(host, ElementTree.tostring(e), e.tag in ("p", "h1", "ul")) for e in article.iter() if e.tag not in ("article", "li", "a")})
    want = Counter(h for (h, _, prose), n in count.items() if n >= 10 and n >= sizes[h] * (0.5 if prose else 0.3))
    assert {r["host"]: r["count"] for r in templates(pages).groupBy("host").count().collect()} == want == {"one.example": 6, "two.example": 6}


def test_near_copies_are_no_template(spark):
    """Half of a host's pages are near copies of one text: its paragraphs stay."""
    rows = []
    for page in range(100):
        if page < 50:
            own = [f"<p>Common paragraph {k}</p>" for k in range(12)]
            own[page % 12] = f"<p>Changed paragraph {page}</p>"
        else:
            own = [f"<p>Paragraph {k} of {page}</p>" for k in range(12)]
        rows.append((page, "http://x.example/", f"<article>{''.join(own)}<p>Notice to all</p></article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in extract(pages).collect():
        lines = r["text"].split("\n")
        assert len(lines) == 12 and "Notice to all" not in lines


@pytest.mark.parametrize("page", ["<article>" + "<div>" * 100_000 + "x" + "</div>" * 100_000, "<ul><li><ul>" + "<span>" * 50_000 + "<li>x</li>" * 50_000, "<article>" * 50_000 + "x"])
def test_deep_pages_in_linear_time(page):
    began = time.perf_counter()
    assert main_text(page).startswith("x")
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>One</p></article><article><p>Two</p></article>", "One\nTwo"),
        ("<main><p>a</p></main><div><main><p>b</p></main></div><main>c</main>", "a\nb\nc"),
        ("<article>x<article>y</article>z</article><article>w</article>", "x\ny\nz\nw"),
        ("<body><form id=all><nav>n</nav><h1>T</h1><p>All</p><input value=q><button>Go</button></form></body>", "T\nAll"),
        ("<form><div><article><p>In</p><form>q</form></article></div></form>", "In"),
        ("<article><p>a</p></article><form><p>Your mail</p></form>", "a"),
        ("<article><p hidden>kept</p><p style='display:none'>too</p></article>", "kept\ntoo"),
        ("<div class=sticky-banner>x</div><div class='ad-300x250'>x</div><ol class=commentlist><li>x</ol><p>y</p>", "y"),
    ],
)
def test_page_order_forms_and_what_is_kept(page, want):
    assert main_text(page) == want
