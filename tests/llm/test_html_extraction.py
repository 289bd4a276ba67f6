"""Main text of pages: plain pages as a whole, odd markup, and what the consensus of a host mends."""

import html
import re

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import html_extraction as H
from evenkeel.llm import queries

PAGE = "page_id long, url string, html string"
NAV = "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav>"
ODD = [
    ("", ""),
    ("<p>", ""),
    ("plain &lt;text&gt; &#65;&nbsp;z &amp;amp;", "plain <text> A z &amp;"),
    ("<div><p>a\n\t b<p>c", "a b\nc"),
    ("<!-- x --><p>a<!---->b<!-- open", "ab"),
    ("<p>a<script>if (a < b) { write('<p>x</p>') }</script>b</p><style>p{}</style>", "ab"),
    ('<div title="x > y">kept</div>', "kept"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
    ("<ul><li>one<li>two<ul><li>three</ul><li>four</ul>", "one\ntwo\nthree\nfour"),
    ("</p></div>a < b<br>c", "a < b c"),
    ("<form><div><article><p>inside</p></article></div></form>", "inside"),
    ("<form><label>Name</label><input></form><p>text</p>", "text"),
    ("<article><h1>T</h1><p>x</p><article><p>a comment</p></article></article>", "T\nx"),
    ("<article><header><h1>T</h1><p>by</p></header><p>x <b>y</b>z</p><footer>f</footer></article>", "T\nx yz"),
    ("<p>a&#xD800;b</p>", "a�b"),
]
AROUND = [
    '<div class="cookie-notice"><p>We use cookies.</p></div>',
    '<div id="sidebar-left"><p>Popular now, and more of it.</p></div>',
    '<div class="ad-slot"><p>Buy this.</p></div>',
    '<section class="comments"><h2>Comments</h2><article><p>Nice post, I liked it very much indeed.</p></article></section>',
    "<aside><p>Aside.</p></aside>",
    '<div role="banner"><p>Site</p></div>',
    "<footer><p>&copy; site</p></footer>",
]


@pytest.mark.parametrize(("source", "want"), ODD)
def test_odd_markup(source, want):
    assert H.main_text(source, []) == want


@pytest.mark.parametrize("article", ["<article>{}</article>", '<main class="c1">{}</main>', '<div class="has-sidebar"><div class="post-12">{}</div></div>'])
def test_what_surrounds_an_article_goes(article):
    body = article.format("<h1>Head</h1><p>First of &quot;two&quot;.</p><div class='more'><p>Second\none.</p></div>")
    for around in ("".join(AROUND), NAV):
        assert H.main_text(f"<html><head><title>t</title></head><body>{around}{body}{around}</body>", []) == 'Head\nFirst of "two".\nSecond one.'


def test_names_are_generalised():
    assert [H.general(x) for x in ("post-17", "css-1q2w3e", "h2", "col-md-6")] == ["post-#", "css-*", "h#", "col-md-#"]


def test_pages_of_one_host_agree(spark):
    """A page whose notice is longer than its article is mended by its host; the other host keeps its own layout."""
    page = lambda k, text, note: f"<body>{NAV}<div class='box-{k}'><p>{note}</p></div><div class='text-{k}'><p>{text}</p></div></body>"
    rows = [(k, f"http://Site.example.com/{k}", page(k, f"A long text of page {k}, " * 9, "short")) for k in range(12)]
    rows.append((50, "https://site.example.com/x", page(50, "tiny text", "a notice without a name that is by far the longest thing here " * 3)))
    rows.append((51, "http://other.example.com/", page(51, "tiny", "the longest thing of this host " * 4)))
    rows += [(52, None, "<p>no url</p>"), (53, "http://site.example.com/y", None), (54, "http://site.example.com/z", "<main><p>another layout</p></main>"), (50, "https://site.example.com/x", page(50, "tiny text", "again " * 40))]
    pages = spark.createDataFrame(rows, PAGE).withColumns({c: F.lit(1) for c in ("host", "rated", "path", "text", "n_chars")})
    for most in (0, H.MOST_BROADCAST):
        got = sorted((r.page_id, r.text, r.n_chars) for r in H.extract(pages, most).collect())
        assert [t for k, t, _ in got if k < 12] == [" ".join((f"A long text of page {k}, " * 9).split()) for k in range(12)]
        assert [t for k, t, _ in got if k == 50] == ["tiny text"] * 2
        assert [t for k, t, _ in got if k > 50] == ["the longest thing of this host " * 3 + "the longest thing of this host", "no url", "", "another layout"]
        assert all(n == len(t) for _, t, n in got)


def test_no_pages(spark):
    assert H.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_very_long_and_deep_pages():
    assert H.main_text("<p>" + "word " * 500_000, []) == ("word " * 500_000).strip()
    assert H.main_text("<div>" * 30_000 + "x" + "</p>" * 30_000, []) == "x"
    assert H.main_text("<a title=\"" * 30_000 + "<p>", []) == ""


def test_whole_table_equals_plain_articles(spark, data):
    """Pages of the given table have one article each, cut here by its own marks."""
    got = {r.page_id: r for r in queries.op13_html_extraction(spark, data).collect()}
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        article = page.html[page.html.index("<article>") : page.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[page.page_id].text == "\n".join(b for b in blocks if b)
        assert got[page.page_id].n_chars == len(got[page.page_id].text) and got[page.page_id].url == page.url
