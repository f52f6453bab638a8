"""Golden literals of the scalar functions."""

import datetime as dt
import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from newsflow.functions import dates, markup, scores, stocks, text, urls


def one(spark, expr, *values):
    cols = [F.lit(v).alias(f"c{i}") for i, v in enumerate(values)]
    df = spark.range(1).select(*cols)
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [
    ("  hello  ", "hello"), ("a  b\n\tc", "a b c"), ("ＡＢＣ１２３", "ABC123"), ("", ""), (" \t\n ", ""),
    ("a\x1cb\x85c\xa0d　e", "a b c d e"), ("騰訊，控股", "騰訊,控股"), ("été", "été"),
])
def test_normalise(spark, raw, want):
    assert one(spark, text.normalise, raw) == want


def test_normalise_mixed_rows_and_null(spark):
    rows = [("plain",), ("ｗｉｄｅ",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(text.normalise(F.col("t")).alias("r"))
    assert [r["r"] for r in df.collect()] == ["plain", "wide", None]


def test_nfkc_safe_set_is_stable():
    ranges = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), text.NFKC_SAFE)
    safe = re.compile(f"[\\x00-\\x7f{ranges}]")
    chars = [chr(c) for c in range(0x10000) if safe.match(chr(c))]
    assert len(chars) > 30_000
    whole = "".join(chars)
    assert unicodedata.normalize("NFKC", whole) == whole
    for c in chars:
        assert unicodedata.normalize("NFKC", c) == c and unicodedata.combining(c) == 0
        assert unicodedata.normalize("NFKC", "A" + c) == "A" + c


def test_white_space_set():
    every = "".join(chr(c) for c in range(0x110000) if re.match(r"\s", chr(c)))
    assert every == text.WHITE_SPACE_CHARS


def test_strip_and_blank(spark):
    assert one(spark, text.strip, "\u3000\x1c a b\xa0\n") == "a b"
    assert one(spark, text.is_blank, " \u3000\x1f") is True
    assert one(spark, text.is_blank, " x") is False


def test_digest(spark):
    s = "騰訊控股業績公告"
    assert one(spark, text.digest, s) == hashlib.sha256(s.encode()).hexdigest()


def test_chinese(spark):
    assert one(spark, text.chinese_ratio, "騰訊ab") == 0.5
    assert one(spark, text.chinese_ratio, "") == 0.0
    assert one(spark, text.is_chinese, "騰訊abc") is True
    assert one(spark, text.is_chinese, "english") is False


def utc(*a):
    return dt.datetime(*a)


@pytest.mark.parametrize("raw,want", [
    ("02/04/2026 22:59", utc(2026, 4, 2, 14, 59)),
    (" Release Time: 14/04/2026 22:52", utc(2026, 4, 14, 14, 52)),
    ("not a date", None), ("99/99/2026 22:52", None),
])
def test_release_time(spark, raw, want):
    assert one(spark, dates.release_time, raw) == want


@pytest.mark.parametrize("raw,want", [
    ("2026年4月6日 星期一　06:00AM", utc(2026, 4, 5, 22)), ("2026年4月6日 星期一　06:00PM", utc(2026, 4, 6, 10)),
    ("2026年4月6日 12:05am", utc(2026, 4, 5, 16, 5)), ("2026年4月6日 12:05PM", utc(2026, 4, 6, 4, 5)), ("2026年4月6日", None),
])
def test_chinese_date(spark, raw, want):
    page = f'<div class="x"></div><div itemprop="d" class="date color2nd"><b>{raw}</b></div><footer>2020年1月1日 01:00AM</footer>'
    assert one(spark, lambda h: dates.chinese_date_cell(markup.date_cell(h)), page) == want


def test_chinese_date_needs_both_classes(spark):
    page = '<div class="date">2026年4月6日 06:00AM</div>'
    assert one(spark, lambda h: dates.chinese_date_cell(markup.date_cell(h)), page) is None


def test_newstime(spark):
    at = lambda page: one(spark, lambda h: dates.newstime_cell(markup.newstime_cell(h)), page)
    cell = "<div class=\"newstime5\"><script>w({dt:'2026/04/06 01:27'})</script></div>"
    label = "<div class=\"newstime5 newshead-Source\">2020/01/01 00:00</div>"
    assert at(label + cell) == utc(2026, 4, 5, 17, 27)
    assert at("<div class=\"side\">2026/04/06 01:27</div>") is None
    assert at(label) is None


@pytest.mark.parametrize("raw,want", [
    ("Thu, 15 Jan 2026 12:00:00 GMT", utc(2026, 1, 15, 12)), ("Thu, 15 Jan 2026 20:00:00 +0800", utc(2026, 1, 15, 12)),
    ("15 Jan 2026 12:00 +0000", utc(2026, 1, 15, 12)), ("yesterday", None), (None, None),
])
def test_rfc822(spark, raw, want):
    assert one(spark, lambda c: dates.rfc822(c.cast("string")), raw) == want


@pytest.mark.parametrize("raw,want", [
    ("00700", ["00700"]), ("00700, 00388", ["00700", "00388"]), ("00700\n00388", ["00700", "00388"]), ("", []), ("  ", []),
])
def test_split_codes(spark, raw, want):
    assert one(spark, stocks.split_codes, raw) == want


def test_standardise(spark):
    for raw in ("700", "00700", "00700.HK", " 700.hk "):
        assert one(spark, stocks.standardise, raw) == "00700.HK"
    assert one(spark, stocks.standardise, "abc") is None


def test_pagination(spark):
    r = one(spark, stocks.pagination, "Showing 100 of 1471 records")
    assert (r.showing, r.total, r.complete) == (100, 1471, False)
    assert one(spark, stocks.pagination, "Showing 1471 of 1471 records").complete
    assert one(spark, stocks.pagination, "nothing here") is None


def test_absolute(spark):
    assert one(spark, lambda h: urls.absolute(h, "https://b"), "/x") == "https://b/x"
    assert one(spark, lambda h: urls.absolute(h, "https://b"), "http://c/x") == "http://c/x"


def test_directions_and_scores(spark):
    sign = lambda i, l: one(spark, scores.direction, i, l)
    assert [sign(3.0, "NEGATIVE"), sign(-3.0, "POSITIVE"), sign(0.0, "NEGATIVE"), sign(0.0, "NEUTRAL")] == [1, -1, -1, 0]
    r = one(spark, lambda a, b: scores.recency(a, b), utc(2024, 1, 1), utc(2024, 1, 1, 4))
    assert abs(r - 6.703200460356394) < 1e-12
    assert one(spark, lambda v: scores.clip(v, 0.0, 1.0), 1.7) == 1.0
    assert one(spark, lambda v: scores.fused(v, F.lit(-2.0), F.lit(-1)), 3.0) == pytest.approx(3 * .67 + 2 * .66)


def test_tag_text(spark):
    page = "<nav>menu</nav><article><h1> A &amp; B</h1><!-- no --><p>x<script>var t='</p>';</script> y&nbsp;</p><p>&nbsp;</p>&copy;</article>"
    assert one(spark, lambda h: markup.unescape(markup.tag_text(h, "article")), page) == "A & B x y ©"
    assert one(spark, lambda h: markup.unescape(markup.tag_text(h, "article")), "<p>none</p>") is None
    assert one(spark, lambda h: markup.unescape(markup.tag_text(h, "article")), "<article>  </article>") is None


def test_select_text_nested(spark):
    page = '<div class="a newscon2"><div>in<br>ner</div><p>more<script>x</script></p></div><div>out</div>'
    assert one(spark, lambda h: markup.select_text(h, F.lit("*.newscon")), page) == "in ner more"
    assert one(spark, lambda h: markup.select_text(h, F.lit("*.absent")), page) is None


def test_title_and_main_text(spark):
    page = "<head><title> T &lt;1&gt; </title><style>p{}</style></head><body><nav>n</nav><p>one <b>two</b></p><p>three</p><footer>f</footer></body>"
    assert one(spark, lambda h: markup.unescape(markup.page_title(h)), page) == "T <1>"
    assert one(spark, markup.main_text, page) == "one two\nthree"


def test_open_references_stay(spark):
    page = "<title>a &amp;&amp</title><body><article>x&amp;lt; &copy;&ampz; &eacute &#65;&#66 &amp</article></body>"
    assert one(spark, lambda h: markup.unescape(markup.page_title(h)), page) == "a &&amp"
    want = "x&lt; ©&ampz; &eacute A&#66 &amp"
    assert one(spark, lambda h: markup.unescape(markup.tag_text(h, "article")), page) == want
    assert one(spark, lambda h: markup.select_text(h, F.lit("article.")), page) == want


def test_collapse_against_python(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85　é") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["", " ", "\x1e\x1f", "\x1f\x1e a\x1f\x1e\x1e\x1fb ", "a" + " " * 33 + "b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.collapse(F.col("t")).alias("c")).collect()
    assert all(r["c"] == " ".join(r["t"].split()) for r in rows)


def test_collapse_runs_one_regular_expression(spark):
    plan = spark.range(1).select(text.collapse(F.col("id").cast("string")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 1  # of rare spaces only
