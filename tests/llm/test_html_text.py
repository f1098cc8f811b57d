import itertools
import random

import pytest

from arborquery.llm import html_text as h


def test_min_cut_equals_trying_every_labelling():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 9)
        terminal = [rng.randint(-6, 6) for _ in range(n)]
        links = [(i, k, rng.randint(0, 5)) for i in range(n) for k in range(i + 1, n) if rng.random() < 0.4]

        def cost(labels):
            return sum(abs(t) for t, x in zip(terminal, labels, strict=True) if t and (t > 0) != x) + sum(w for i, k, w in links if labels[i] != labels[k])

        assert cost(h.min_cut(terminal, links)) == min(cost(x) for x in itertools.product([False, True], repeat=n))


def test_long_chains():
    rng = random.Random(4)
    n = 3000
    labels = h.min_cut([rng.randint(-300, 300) for _ in range(n)], [(i, i + 1, 400) for i in range(n - 1)])
    assert len(labels) == n


SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home page of the site</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, as every other site does, to make it better for all of you.</div>
<div id=main><article><header><h1>Title</h1></header><p>Short.</p><p>Fish &amp; chips&nbsp;with a <a href=x title="a > b">link</a>s
 here<p>Unclosed <b>bold<br>and on</p><div class=ad>Buy now, this very long advert text goes on and on for ever and ever.</div><ul><li>one<li>two</ul>
<!-- a comment with <p>markup</p> --><section class="comments"><h3>Comments</h3><p>A great long article, thanks for writing this article for us all.</p></section></article>
<aside>Related stories of some length that nobody has asked for today.</aside></div><script>var t = "<p>no</p>";</script>
<form>Subscribe <input> to us</form><footer>All rights reserved by the owners of this site.</footer></body></html>"""


def test_article_is_kept_and_the_rest_goes():
    assert h.main_text(SITE) == "Title Short. Fish & chips with a links here Unclosed bold and on one two"


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<html></html>", ""),
        ("<script>no end", ""),
        ("<!-- no end <p>x</p>", ""),
        ("<article><p>cut off &amp", "cut off &"),
        ("<article><p>cut off <a hre", "cut off"),
        ("<article>a < b <3 c</article>", "a < b <3 c"),
        ("<article><p>x</p></div></p></article>", "x"),
        ("<article><p hidden>not</p><p style='display: none'>nor</p><p>seen</p></article>", "seen"),
        ("<article><div style='' ><h1>A</h1></div><img alt='>'><p>B</p>", "A B"),
    ],
)
def test_odd_pages(page, text):
    assert h.main_text(page) == text


def test_pages_without_article_markup():
    page = "<p>Only a paragraph of ordinary text without article markup, long enough.</p><div><a href=1>a</a> <a href=2>b</a></div><p>And more text that is here.</p>"
    assert h.main_text(page) == "Only a paragraph of ordinary text without article markup, long enough. And more text that is here."


def test_long_and_deep_pages_take_linear_time():
    for page in ("<div>" * 20_000 + "x", "<p><b>x<br>" * 20_000, "<a" * 100_000, "</div>" * 50_000, "<article>" + "<p>some words</p>" * 20_000):
        h.main_text(page)


def test_query_rows(spark, sf):
    rows = [(1, "u", SITE, "x"), (1, "u", SITE, "x"), (2, None, None, None), (None, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, h.op3_html_text(spark, sf(pages=pages)).collect()), key=str)
    text = h.main_text(SITE)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert h.op3_html_text(spark, sf(pages=pages.limit(0))).collect() == []
