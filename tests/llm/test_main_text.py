"""Main text: the cut against all labellings, and pages of many shapes."""

import itertools
import random

import pytest

from quillspan.llm import main_text as M
from quillspan.llm import queries

SF = "/root/testdata/sf0.001"


def cost(labels, gains, edges):
    return sum(g for g, k in zip(gains, labels) if g > 0 and not k) - sum(g for g, k in zip(gains, labels) if g < 0 and k) + sum(c for a, b, c in edges if labels[a] != labels[b])


def test_cuts_are_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 9)
        gains = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(1, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        best = min(cost(labels, gains, edges) for labels in itertools.product((False, True), repeat=n))
        assert cost(M.source_side(n, gains, edges), gains, edges) == best


def test_edges_smooth_what_is_near():
    page = M.page_blocks("<div><p>one</p><p>two</p></div><div><ul><li>three</li></ul></div>")
    count, edges = M.smoothness(page)
    beside = {(a, b): c for a, b, c in edges if b == a + 1 and b < 3}
    assert count == 5 and beside[0, 1] > beside[1, 2]


ARTICLE = "<article><h1>Title &amp; more</h1><p>First   para\n graph.<br>Goes on &lt;here&gt; <b>bold<p>Short.<ul><li>item one<li>item two</ul></article>"
WANT = "Title & more\nFirst para graph. Goes on <here> bold\nShort.\nitem one\nitem two"


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("<html></html>", ""),
        (ARTICLE, WANT),
        (f"<header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a></ul></nav>{ARTICLE}<aside>Side</aside><footer>&copy; me</footer>", WANT),
        (f'<body class="has-sidebar"><div id="cookie-notice">We use cookies.</div><div class="wrap">{ARTICLE}<div class="comments"><h3>Comments</h3><article class="comment"><p>Nice article, I liked it.</p></article></div></div>', WANT),
        (f"<script>var a = '<p>no</p>';</script><style>p{{}}</style>{ARTICLE}<form><label>Mail</label><input><button>Go</button></form><script>unclosed", WANT),
        (f"<title>Head</title>{ARTICLE[:-10]}<div class=ad>Buy this now.</div></article><!-- <p>never</p> --><footer>cut in the mid", WANT),
        ("<main><header><h1>Name</h1></header><p>Text of it.</p><div class='share-buttons'><a href=x>Share</a></div></main>", "Name\nText of it."),
        ('<div role="navigation"><a href="/">Home</a></div><div id="content"><p>The text stands in a div, without an article.</p><p>It has two parts.</p></div><div class="footer">All rights</div>', "The text stands in a div, without an article.\nIt has two parts."),
        ("just a text without any markup, of some length.", "just a text without any markup, of some length."),
        ("<p>a < b and c > d</p><p title='x > y'>quoted \"</p><p it's>odd</p></p></div>", 'a < b and c > d\nquoted "\nodd'),
        ("<p>nul &#0; &#x41; &nbsp; &unknown; &amp</p>", "nul � A &unknown; &"),
        ("<nav><a href=1>Never closed<article><p>Still the article.</p></article>", "Still the article."),
        ("<table><tr><td>one<td>two<tr><td>three</table>", "one\ntwo\nthree"),
    ],
)
def test_pages(html, want):
    assert M.main_text(html) == want


def test_very_long_and_deep_pages():
    text = "\n".join(f"Sentence {k} of the article, which is long." for k in range(20_000))
    page = "<nav>" + "<a href=x>menu</a>" * 5_000 + "</nav><article>" + "".join(f"<p>{x}</p>" for x in text.split("\n")) + "</article>" + "<div>" * 20_000 + "<footer>end"
    assert M.main_text(page) == text
    assert M.main_text('<p a="' * 3_000) == "" and M.main_text("<" * 100_000) == "<" * 100_000


def test_whole_table_against_its_own_markup(spark):
    import html
    import re

    rows = {r.page_id: r for r in queries.op13_main_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page.html, re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner[1]).replace("<br>", " ") if inner else "")
        want = "\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts) if x)
        got = rows[page.page_id]
        assert (got.text, got.n_chars, got.url) == (want, len(want), page.url)


def test_nulls_repeats_clashing_columns_and_an_empty_table(spark):
    columns = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, ARTICLE, "clash", "7"), (1, "u", ARTICLE, None, None), (None, "v", None, "clash", "7"), (2, "w", "", None, None)]
    got = M.extract_main_text(spark.createDataFrame(rows, columns), carry=["page_id", "url", "text", "n_chars"])
    assert got.columns == ["text", "n_chars", "page_id", "url"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(WANT, len(WANT), 1, None), (WANT, len(WANT), 1, "u"), ("", 0, None, "v"), ("", 0, 2, "w")], key=repr)
    assert M.extract_main_text(spark.createDataFrame([], columns), carry=["page_id"]).collect() == []


def test_the_classifier_learns_from_landmarks(spark):
    weights = M.fit_text_odds(spark.read.parquet(f"{SF}/pages.parquet"), "page_id", sample_pages=100)
    link = M.page_blocks("<ul><li><a href=x>a menu entry</a></ul>").blocks[0]
    prose = M.page_blocks("<p>Many words that stand in a row, with commas, and that end in a full stop as prose does, on and on and on.</p>").blocks[0]
    assert M.content_odds(link, weights) < 0 < M.content_odds(prose, weights)
    assert M.fit_text_odds(spark.createDataFrame([], "page_id long, html string"), "page_id") == M.PRIOR
