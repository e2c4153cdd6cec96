import html
import re
import time

import pytest

from wakeline.llm import html_text as h

PAGE = """<html><head><title>T</title></head><body><header><a href=/>Site</a> <h1>Site name</h1></header><div id="cookie-notice">We use cookies, yes, really!</div><nav><ul><li>a<li>b</ul></nav>
<main><div class="story"><h1>Head &amp; line</h1><p>First para, with words; and more. <a href=x>link</a> tail.<p>Second   para&nbsp;here, yes. Also more text, to be sure.<blockquote>Quote, short.</blockquote><ul><li>one item<li>two item</ul></div></main>
<aside class="sidebar">Side text, side text, long side text. Yes.</aside><div class="comments"><p>Great article, thanks! I liked it, really, so much.</p></div><form><p>Name <input></form><footer>&copy; me</footer>"""


def test_boilerplate_goes():
    assert h.main_text(PAGE) == "Head & line\nFirst para, with words; and more. link tail.\nSecond para here, yes. Also more text, to be sure.\nQuote, short.\none item\ntwo item"


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("plain", "plain"), ("<p>a<b>b</p>c &lt;d", "ab\nc <d"), ("<article><p>x<br>y</p><script>var a='</p>';</script><p>z", "x y\nz"), ("<!-- <p>no</p> --><p>yes", "yes"), ("<article><div class='ad'>buy</div><p>ok, text.</p></article>", "ok, text."),
    ("<style>p{}</style>", ""), ("<p>1 < 2 & 3", "1 < 2 & 3"), ("</div></p>odd", "odd"), ("<article><p>t</p><section class='comments'><p>c</p></section></article>", "t"), ("<article><p>a</p><p hidden>b</p><p style='display: none'>c</p></article>", "a"),
])
def test_small_pages(page, text):
    assert h.main_text(page) == text


def test_paths_without_semantic_names():
    body = "".join(f"<div class=x><p>A longer paragraph number {i}, with some words; and marks, as prose has them.</p></div>" for i in range(12))
    page = "<body><div class=top><a>one</a><a>two</a></div><div class=links>" + "<div><a>go</a></div>" * 10 + f"</div><div class=body>{body}</div><div class=low>all rights</div>"
    lines = h.main_text(page).split("\n")
    assert len(lines) == 12 and all("paragraph number" in x for x in lines)


TELLTALE = re.compile(r"</?(article|nav|footer)>")


def nameless(page):
    """The page without the names that speak: plain divs, no classes."""
    return TELLTALE.sub(lambda m: m[0].replace(m[1], "div"), page).replace(' class="ad"', "")


PARTS = ["It rained all night, and by the morning, as the river rose, the old bridge was closed; nobody, not even the mayor, could cross.", "Short.", "The repairs, we hear, will take until May: the stones, cut by hand, have to come from the same quarry, which closed in 1931.", "Those who work on the other bank, some forty people, now take the ferry; it runs twice a day, if the wind allows it."]
LINKS = "".join(f"<div><a href=/{i}>Topic {i}</a></div>" for i in range(9))
SHAPES = {
    "divs": ("<div><div><a href=/>Daily</a></div>" + LINKS + "</div><div><h2>Bridge closed</h2>%s</div><div>Imprint</div>", "<div>%s</div>"),
    "spans in cells": ("<table><tr><td>" + LINKS + "</td><td><div><h2>Bridge closed</h2>%s</div></td></tr></table><div><a>Imprint</a></div>", "<p>%s</p>"),
    "headline outside": ("<div>" + LINKS + "</div><h1>Bridge closed</h1><div>%s</div><ul><li><a>Imprint</a><li><a>Jobs</a></ul>", "<p>%s"),
    "links after": ("<div><h2>Bridge closed</h2>%s<div>" + LINKS + "</div></div>", "<p>%s</p>"),
    "a form around all": ("<form><div>" + LINKS + "</div><div><h2>Bridge closed</h2>%s</div><input></form>", "<p>%s</p>"),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_known_text_without_telling_names(shape):
    frame, part = SHAPES[shape]
    page = "<html><head><title>Bridge closed</title></head><body>" + frame % "".join(part % x for x in PARTS)
    assert h.main_text(page) == "\n".join(["Bridge closed", *PARTS])


def test_names_alone_decide_nothing():
    page = "<body><article>" + LINKS + "</article><div class=sidebar>" + "".join(f"<p>{x}</p>" for x in PARTS * 4) + "</div>"
    assert PARTS[0] in h.main_text(page)


def test_the_result_comes_through_the_content_paths(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    mine = [h.main_text(p) for p in pages]
    same = sum(h.main_text(nameless(p)) == t for p, t in zip(pages, mine, strict=True))
    assert same > 0.6 * len(pages)  # most texts do not even need the names
    for stand_in in (lambda page: set(range(len(page.priors))), lambda page: set()):
        monkeypatch.setattr(h, "content_paths", stand_in)
        assert sum(h.main_text(p) != t for p, t in zip(pages, mine, strict=True)) > 0.9 * len(pages)


@pytest.mark.parametrize("page", ["<div>x" * 10_000, "<div>x" * 10_000 + "</section></b>" * 10_000, "<b>x" * 5_000 + "</i>" * 5_000 + "<li>" * 5_000 + "<td>" * 5_000, "<p><a '" * 5_000 + "\"" * 5_000, "<ul><li>" * 10_000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    h.main_text(page)
    assert time.perf_counter() - began < 2


def plain(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner))
    return "\n".join(x for x in parts if x)


def test_query_matches_a_plain_reading(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = h.op10_html_text(spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "a"), (1, "u", None, "a"), (None, None, "<p>x" * 20_000, "b")], "page_id long, url string, html string, text string")
    rows = h.page_texts(df).collect()
    assert sorted(r.n_chars for r in rows) == [0, 0, 39_999] and h.page_texts(df.limit(0)).count() == 0
