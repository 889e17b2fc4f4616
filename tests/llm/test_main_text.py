"""Main text: the given pages against a plain reading of their template, other pages by hand."""

import html
import re

import pytest
from filetrail.llm import main_text
from filetrail.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
LONG = "A sentence of the article that has enough words to look like one. " * 4


def by_template(page):
    article = re.search("<article>(.*)</article>", page, re.S).group(1).replace("<br>", " ")
    blocks = [re.sub("[ \t-\r]+", " ", html.unescape(re.sub("<[^>]+>", "", b))).strip() for b in re.split("</?(?:p|h1)>", article)]
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op12_main_text"](spark, SF_DIR).collect()}
    assert len(got) == len(pages)
    for page in pages:
        text = by_template(page.html)
        assert tuple(got[page.page_id]) == (page.page_id, page.url, text, len(text))


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("plain words", "plain words"), ("<p>unclosed <b>bold<p>Next &amp; last&nbsp;&#x41;&am", "unclosed bold\n\nNext & last\xa0A&am"),
    (f"<nav><a>Home</a></nav><article><h1>T</h1><p>{LONG}<p>Of.<br>x</article><footer>f</footer>", f"T\n\n{LONG.strip()}\n\nOf. x"),
    (f"<article><p>{LONG}</p><div class='commentList'><p>{LONG}</p></div><article><p>{LONG}</p></article></article>", LONG.strip()),
    (f"<body class='has-sidebar'><header>h</header><main><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}</form></main>", LONG.strip()),
    (f"<form><article><p>{LONG}</p><form><label>Name</label></form></article></form>", LONG.strip()),
    (f"<body><div id=top><a>1</a><a>2</a><a>3</a></div><div class=body><p>{LONG}</p><div>short</div></div><div><a>4</a><a>5</a></div>",
     f"{LONG.strip()}\n\nshort"),
    (f"<div role='navigation'>{LONG}</div><div class='cookie-notice'>{LONG}</div><div class='ad'>{LONG}</div><p>{LONG}", LONG.strip()),
    (f"<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><pre>x\n  y</pre><p>{LONG}</article>", f"one\n\ntwo\n\na\n\nb\n\nx y\n\n{LONG.strip()}"),
    (f"<script>var a = '<p>no</p>';</script><style>p{{}}</style><!-- <p>no --><p>{LONG}<textarea>no</textarea>", LONG.strip()),
    ("</div></p></article>text</b> after", "text after"), ("<p>end<a href='x", "end"), ("<article></article>", ""),
])
def test_pages_by_hand(page, text):
    assert main_text.main_text(page) == text


def test_odd_rows(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    wide = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (4, "u", "<p>x"), (4, "u", "<p>x"), (5, "u", deep), (6, "u", wide)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'no' as text", "7 as n_chars")
    got = [tuple(r) for r in main_text.extract(pages, batch_chars=1000).collect()]
    text = "\n\n".join(["word"] * 50_000)
    assert sorted(got, key=str) == sorted(
        [(1, "u", "", 0), (2, None, "", 0), (None, "u", "x", 1), (4, "u", "x", 1), (4, "u", "x", 1), (5, "u", "deep", 4), (6, "u", text, len(text))],
        key=str)
    assert main_text.extract(pages.limit(0)).count() == 0
