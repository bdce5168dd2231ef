"""Main text: the tables' pages against their template, other templates by hand."""

import html as H
import re

import pytest

from folioform.llm import html_extraction as X

BLOG = """<html><head><title>t</title></head><body class="has-sidebar"><div id="header"><h1>My Site</h1><ul class=menu><li><a href=/>Home</a></ul></div>
<div class="wrap"><div class="post"><h1>Title of it</h1><p>First   paragraph, with a lot of words, and commas; it goes on &amp; on.</p><p>Short.</p>
<ul><li>Point one is here.<li>Point two</ul><blockquote>A quote, said someone.</blockquote><h2>Next</h2><p>Second paragraph &lt;b&gt; has&nbsp;<b>more</b> words, and they
are many, so that it counts.<br>Really, it does.<table><tr><td>a<td>b</table><div class="ad">Buy now, please, at once!</div></div>
<div class="side-col"><p><a href=p>Popular posts</a></p><ul><li><a href=x>One thing that happened</a><li><a href=y>Another thing</a></ul></div></div>
<div id="comments"><p>I liked it, thanks, this was great, wow, so great, more, please!</p></div><div class="cookie-notice">We use cookies, and so on.</div>
<script>document.write("<p>no, no, no.</p>")</script><form><p>Your name, please.</p></form><footer>c</footer></body></html>"""
MAIN = """<header><h1>Site</h1><nav>m</nav></header><main><article class="no-comments"><header><h1>Head</h1><p>By X</p></header><p>Text one.</p><figure><img src=i>
<figcaption>A caption</figcaption></figure><section><h2>Sub</h2><p>Text two <span class="ad">AD</span>rest.</p><p hidden>never</p></section>
<section class="comments"><h2>Comments</h2><article class="comment"><p>Nice, nice, nice, nice, nice, nice.</p></article></section><footer>Tags</footer></article><aside>rel</aside></main>"""
PLAIN = """<body><div class="top"><a href=/>Home</a> <a href=/a>About</a></div><div class="c1"><div>Lorem ipsum dolor, sit amet; consectetur. And more.</div>
<div>Second part, of the text. It has two sentences.</div></div><div class="c2"><div>Terms</div><div>Privacy</div></div></body>"""


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (BLOG, ["Title of it", "First paragraph, with a lot of words, and commas; it goes on & on.", "Short.", "Point one is here.", "Point two", "A quote, said someone.", "Next",
                "Second paragraph <b> has more words, and they are many, so that it counts. Really, it does.", "a", "b"]),
        (MAIN, ["Head", "Text one.", "A caption", "Sub", "Text two rest."]),
        (PLAIN, ["Lorem ipsum dolor, sit amet; consectetur. And more.", "Second part, of the text. It has two sentences."]),
        ("<p>Only text, here.<p>And <b>more<p>of it.", ["Only text, here.", "And more", "of it."]),
        ("just &#x41; text &lt;x&gt; <!-- not <p> this --> here", ["just A text <x> here"]),
        ("<div><a href=x>a b c</a></div>", []),
        ("", []),
        (None, []),
        ("<div", ["<div"]),
        ("<script>var a = '<p>x</p>'", []),
        ("</p></div>a<br/>b</body>", ["a b"]),
    ],
)
def test_templates(page, blocks):
    assert X.main_blocks(page) == blocks


def test_long_and_deep_pages():
    assert X.main_blocks("<div>" * 20_000 + "x" + "</div>" * 20_000) == ["x"]
    assert X.main_blocks("<article>" + "<p>Some words, here. " * 50_000 + "</article>") == ["Some words, here."] * 50_000
    assert X.main_blocks("<p><b>" * 20_000 + "x <a '" * 100)[0].startswith("x")


def test_query_against_the_template(spark, data):
    got = {r["page_id"]: r for r in X.op12_html_extraction(spark, data).collect()}
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        inner = re.search(r"<article>(.*)</article>", page["html"], re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        r = got[page["page_id"]]
        assert (r["url"], r["text"], r["n_chars"]) == (page["url"], want, len(want))


def test_odd_rows(spark):
    rows = [(1, "u", "<p>Hello, you.</p>", "x"), (None, None, None, None), (1, "u", "<p>Hello, you.</p>", "x"), (2, None, "", "x")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    got = X.main_text(df)
    assert got.columns == ["page_id", "url", "text"] and got.schema["page_id"].dataType == df.schema["page_id"].dataType
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "Hello, you."), (1, "u", "Hello, you."), (None, None, ""), (2, None, "")], key=str)
    assert X.main_text(df.limit(0)).count() == 0
