"""HTML extraction: parsing, votes, and the whole query against an independent cut of the test pages."""

from __future__ import annotations

import html
import re

import pytest

from bookwright.llm import html_extract as X
from bookwright.llm.queries import all_queries

PAGE = """<html><body class="has-sidebar"><header>Site</header><div id="cookie-notice">We use cookies</div>
<div class="wrap"><div class="post content"><h1>Ti&eacute;tle &amp; x</h1><p>First   para <a href=x>link</a> text
 more.<p>Second<br>line<ul><li>one<li>two</ul><form><p>sub</p></form><aside>s</aside><script>if(a<b)"</p>"</script>
<table><tr><td>a<td>b</table><div class="ad"><p>ad text</p></div><section id="comments"><p>I comment</p></section></div>
<div class="sidebar">side</div></div><footer>f"""


def test_noise_goes_and_blocks_stay():
    assert X.main_text(X.parse(PAGE), None) == "Tiétle & x\nFirst para link text more.\nSecond line\none\ntwo\na\nb"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("<", "<"), ("<p", ""), ("plain  text", "plain text"), ("<a b='", ""), ("<!-- x", ""), ("<script>", ""),
        ("</p></div>", ""), ("<p>a<div>b</div>c</p>d", "a\nb\nc\nd"), ("&lt;b&gt; &#233;&nbsp;x", "<b> é x"),
        ("<body><p hidden>no<p style='display: none'>no<p>yes", "yes"),
        ("<body><article><p>a long text of the page</p><article class=comment><p>reply</article></article>", "a long text of the page"),
    ],
)
def test_odd_pages(page, text):
    assert X.main_text(X.parse(page), None) == text


def test_deep_and_long_pages():
    assert X.main_text(X.parse("<div>" * 5000 + "x"), None) == "x"
    assert X.main_text(X.parse("<a '" * 20000), None) == ""


ARTICLE = "A long paragraph of the story that this page is about, as it goes on. " * 6


@pytest.mark.parametrize(
    "frame",
    [
        "<div class='content has-sidebar'>{}</div>", "<div class='post no-comments'>{}</div>", "<article class='post comments-open'>{}</article>",
        "<div class='page with-banner'>{}</div>", "<section class='story ad-free'>{}</section>", "<div id='navigation-page'>{}</div>",
        "<form action='/'>{}</form>", "<div class='banner'>{}</div>",
    ],
)
def test_frames_keep_the_article(frame):
    page = X.parse("<body><nav>Home</nav>" + frame.format(f"<p>{ARTICLE}</p><div class='sidebar'>More</div>") + "<footer>end</footer>")
    assert X.main_text(page, None) == ARTICLE.strip()


@pytest.mark.parametrize("noise", ["<nav>{}</nav>", "<div class='comments'>{}</div>", "<div hidden class='sidebar'>{}</div>", "<aside>{}</aside>"])
def test_pages_without_an_article_stay_empty(noise):
    assert X.main_text(X.parse("<body>" + noise.format(f"<p>{ARTICLE}</p>")), None) == ""
    page = X.parse("<body><p>Short story.</p>" + noise.format(f"<p>{ARTICLE}</p>"))
    assert X.main_text(page, None) == "Short story."


def test_deep_pages_with_classes():
    """Time and memory grow with the page, not with its square."""
    import time
    import tracemalloc

    page = "".join(f"<div class='level-{i} deep'>" for i in range(8000)) + ARTICLE
    tracemalloc.start()
    start = time.time()
    parsed = X.parse(page)
    taken = time.time() - start
    text = X.main_text(parsed, max(X.votes(parsed), key=len))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text == ARTICLE.strip() and taken < 4 and peak < 50_000_000


def test_the_host_decides(spark):
    long = "words that fill the story of this page " * 5
    page = "<body><div class='story-{n}'><p>{a}</p></div><div class='list'><p>{b}</p></div>"
    rows = [(i, f"https://H.example/{i}", page.format(n=i, a=long, b="short")) for i in range(5)]
    rows += [(5, "https://h.example:80/5", page.format(n=5, a="tiny story", b=long)), (6, None, page.format(n=1, a="x", b=long))]
    rows += [(7, "https://h.example/7", None), (7, "https://h.example/7", "<p>no such path"), (None, "odd", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 host", "2 path", "3 text")
    got = sorted(((r.page_id, r.text) for r in X.extract(df).collect()), key=str)
    story = long.strip()
    want = [(i, story) for i in range(5)] + [(5, "tiny story"), (6, story), (7, ""), (7, "no such path"), (None, "")]
    assert got == sorted(want, key=str)
    assert X.extract(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = all_queries()["op2_consensus_html"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
