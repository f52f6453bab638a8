import html
import re

import numpy as np
import pytest

from newsflow.llm import maintext


@pytest.fixture(scope="module")
def trees(spark):
    return maintext.train(spark)


def article(source):
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub("<br>", " ", inner))
    return "\n\n".join(t for t in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in parts) if t)


def test_given_pages(spark, sf, trees):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in maintext.extracted(pages, trees).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(article(r["html"])) and got[r["page_id"]]["url"] == r["url"]


def test_held_out_layouts(trees):
    parts = [maintext.labelled(seed) for seed in range(5001, 5101)]
    rows, labels = np.concatenate([r for r, _ in parts]), np.concatenate([y for _, y in parts])
    assert ((trees.score(rows) > 0) == (labels > 0)).mean() > 0.97


PAGE = """<html><body><header><h2>Site name</h2><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav></header><main><article><h1>Title here now</h1>
<p>First paragraph of   text is long enough. It has more than one sentence.</p><aside class="related"><h3>Related</h3><ul><li><a href=1>Some other story</a></li></ul></aside>
<p>Second one follows, with <em>emphasis</em> and a <a href=x>link</a>. And more &amp; more.</p><div class="ad">Buy now our things.</div><p>Third.</p></article></main>
<div class="sidebar"><p>Subscribe to our letter. It is good.</p></div><div class="cookie-notice"><p>We use cookies to make things better. Accept them.</p></div>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this article a lot. Thanks for it.</p></div></section>
<form><label>Name</label><input><button>Send</button></form><script>var a = "<p>no</p>";</script><footer><p>&copy; 2020 Site. All rights reserved.</p></footer></body></html>"""


def test_parts_of_a_page(trees):
    want = "Title here now\n\nFirst paragraph of text is long enough. It has more than one sentence.\n\nSecond one follows, with emphasis and a link. And more & more.\n\nThird."
    assert maintext.main_texts([PAGE], trees) == [want]


def test_awkward_pages(spark, trees):
    rows = [(1, None), (2, ""), (3, "just &amp; text"), (4, "hello <b>world</b>"), (5, "<p>a < b <3 <div>unclosed <p class=\"x>"), (6, "<div>" * 3000 + "deep"), (7, "<p>" + "long text. " * 20_000), (7, "hello <b>world</b>"), (None, "x")]
    frame = spark.createDataFrame([(i, "u", h, "t", 5) for i, h in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = maintext.extracted(frame, trees).collect()
    assert [r["text"] for r in got][:4] == ["", "", "just & text", "hello world"]
    assert len(got) == len(rows) and got[5]["text"] == "deep" and got[6]["n_chars"] == len("long text. " * 20_000) - 1
    assert maintext.extracted(frame.limit(0), trees).count() == 0


def test_nothing_is_kept_below_what_is_dropped():
    page = maintext.parse("<div><p>aaaa bbbb</p></div><p>cc</p>")
    kept = maintext.decode(page, np.array([0.0, -3.0, 0.5, 1.0]))
    assert kept == [True, False, False, True]
