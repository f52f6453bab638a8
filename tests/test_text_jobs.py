"""Extraction, entity match and lookups on small fixtures."""

from pyspark.sql import functions as F

from newsflow import params
from newsflow.operators import cleaning, entities, extraction
from newsflow.sources import feeds, listings

LONG = "正文" * 40


def test_extract_pages_by_source(spark):
    pages = [
        ("AASTOCKS", "u1", "<title>T1</title><div class='newstime5'>{dt:'2026/04/06 01:27'}</div><div class='x newscon'>a<div>b</div>c</div>", None, None),
        ("MINGPAO", "u2", "<div class='date color2nd'>2026年4月6日 06:00PM</div><article><p>x</p><article>y</article>z</article>", "feed title", None),
        ("YAHOO_HK", "u3", "<body><nav>n</nav><p>main</p></body>", "yahoo", "2026-01-01 00:00:00"),
        ("AASTOCKS", "u4", "<div>nothing</div>", None, None),
    ]
    df = spark.createDataFrame(pages, "source_name string, source_url string, html string, feed_title string, t string")
    got = {r["source_url"]: r for r in extraction.extract_pages(df.withColumn("feed_published_at", F.col("t").cast("timestamp"))).collect()}
    assert (got["u1"]["body"], got["u1"]["title"], str(got["u1"]["published_at"])) == ("a b c", "T1", "2026-04-05 17:27:00")
    assert (got["u2"]["body"], got["u2"]["title"], str(got["u2"]["published_at"])) == ("x y z", "feed title", "2026-04-06 10:00:00")
    assert (got["u3"]["body"], str(got["u3"]["published_at"])) == ("main", "2026-01-01 00:00:00")
    assert got["u4"]["outcome"] == "skipped_empty" and got["u1"]["outcome"] == "success"


def test_links_dedup_and_absolute(spark):
    html = "<a href='/aafn-con/NOW.1'>x</a><a class=y href=\"/aafn-con/NOW.2\">x</a><a href='/aafn-con/NOW.1'>x</a><a href='/other'>o</a>"
    links = extraction.page_links(spark.createDataFrame([(1, html)], "page int, html string"), params.AASTOCKS_BASE, "page")
    assert [r["link"] for r in links.orderBy("position").collect()][:2] == [params.AASTOCKS_BASE + "/aafn-con/NOW.1", params.AASTOCKS_BASE + "/aafn-con/NOW.2"]
    assert links.count() == 4


def test_listing_triage(spark):
    rows = [(None, "h", "x", "1"), ("", "h", "x", "1"), ("/a.pdf", " H ", "bogus", "00700\n00388"), ("https://b/c.pdf", "H", "Release Time: 02/04/2026 22:59", "")]
    df = listings.triage(spark.createDataFrame(rows, "pdf_href string, headline string, release string, stock string"))
    assert [r["reason"] for r in df.collect()] == ["no_pdf_link", "no_href", "ok", "ok"]
    first, second = listings.announcements(df).collect()
    assert (first["pdf_url"], first["title"], first["published_at"], first["stock_codes"]) == (params.HKEX_BASE + "/a.pdf", "H", None, ["00700", "00388"])
    assert (second["pdf_url"], str(second["published_at"]), second["stock_codes"]) == ("https://b/c.pdf", "2026-04-02 14:59:00", [])


def test_feed_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><title> A &amp; B </title><link>https://e/1</link><pubDate>Thu, 15 Jan 2026 12:00:00 GMT</pubDate></item>"
        "<item><title></title><link>https://e/2</link></item><item><title>no link</title></item></channel></rss>")
    items = feeds.read_feed_files(spark, str(tmp_path))
    assert [(r["title"], r["url"], str(r["published_at"])) for r in feeds.entries(items).collect()] == [("A & B", "https://e/1", "2026-01-15 12:00:00")]
    polled = spark.createDataFrame([(items.first()["feed"],), ("file:///missing.xml",)], "feed string")
    assert [r["feed"] for r in feeds.failed_feeds(items, polled).collect()] == ["file:///missing.xml"]


def test_outcomes(spark):
    rows = [(429, "http", "ok", "b"), (404, "http", "ok", "b"), (None, "browser", "ok", "b"), (200, "http", "encrypted", None), (200, "http", "ok", " "), (200, "http", "ok", "b")]
    df = spark.createDataFrame(rows, "status int, channel string, parse_state string, body string").coalesce(1)
    got = extraction.classify(df, extraction.failure_catalogue(spark, "NEWS-")).select("outcome", "error_code").collect()
    assert [tuple(r) for r in got] == [("rate_limited", None), ("failure", "NEWS-6101"), ("failure", "NEWS-6104"), ("failure", "NEWS-6202"), ("skipped_empty", None), ("success", None)]


def test_cleaning_rules(spark):
    rows = [("1", "s", " ", LONG), ("2", "s", "", LONG), ("3", "s", "t", None), ("4", "s", "t", "x" * 49), ("5", "s", "t", "x" * 50)]
    df = spark.createDataFrame(rows, "raw_id string, source_name string, title string, body string")
    got = {r["raw_id"]: r["reject_reason"] for r in cleaning.assess(df).collect()}
    assert got == {"1": None, "2": "EMPTY_FIELD", "3": "EMPTY_FIELD", "4": "BODY_TOO_SHORT", "5": None}


def test_lookup_bounds(spark):
    import pytest
    table = spark.createDataFrame([("a",), ("b",)], "cleaned_id string")
    assert cleaning.lookup_batch(table, ["a", "a", "zz"]).count() == 1
    for ids in ([], [str(i) for i in range(51)]):
        with pytest.raises(ValueError):
            cleaning.lookup_batch(table, ids)


MASTER = [("00700.HK", "騰訊控股", "Tencent Holdings", "TECHNOLOGY"), ("09988.HK", "阿里巴巴", "Alibaba", "TECHNOLOGY"), ("00388.HK", "香港交易所", "HKEX", "FINANCIALS")]


def master(spark):
    return spark.createDataFrame(MASTER, "stock_code string, company_name_zh string, company_name_en string, sector string")


def test_mentions_with_and_without_broadcast(spark, monkeypatch):
    texts = [
        ("1", "騰訊控股公佈業績；監管機構調查阿里巴巴"), ("2", "Shares of TENCENT  holdings rose, Alibabas fell"),
        ("3", "見 00388.HK 及 9988.HK，12345.HK"), ("4", "購買Alibaba股票"), ("5", "nothing here"),
    ]
    df = spark.createDataFrame(texts, "cleaned_id string, body_cleaned string")
    want = [("1", "00700.HK"), ("1", "09988.HK"), ("2", "00700.HK"), ("3", "00388.HK"), ("3", "09988.HK"), ("4", "09988.HK")]
    assert sorted(map(tuple, entities.mentioned_stocks(df, master(spark)).collect())) == want
    assert sorted(map(tuple, entities.mentioned_stocks(df.union(df), master(spark)).collect())) == want
    monkeypatch.setattr(entities, "small", lambda rows: rows)
    assert sorted(map(tuple, entities.mentioned_stocks(df, master(spark)).collect())) == want


def test_lookup_by_name(spark):
    asked = spark.createDataFrame([("Alibab",), ("騰迅控股",), ("tencent holdings",), ("Apple",)], "query string")
    got = {r["query"]: (r["stock_code"], r["edits"]) for r in entities.lookup_by_name(asked, master(spark)).collect()}
    assert got == {"Alibab": ("09988.HK", 1), "騰迅控股": ("00700.HK", 1), "tencent holdings": ("00700.HK", 0)}


def test_keywords_with_chinese(spark):
    df = spark.createDataFrame([("盈利增長，盈利 warning",)], "b string")
    found = entities.keyword_words(F.col("b"), ["盈利", "warning"])
    kinds = entities.classify_types(F.col("b"), found, {"EARNINGS": ["盈利"], "REGULATORY": ["warning"]})
    r = df.select(kinds.alias("t")).first()["t"]
    assert (r["primary"], r["secondary"]) == ("EARNINGS", "REGULATORY")


def test_filings_reach_the_raw_table(spark):
    listed = spark.createDataFrame([("u1", " Notice ", ["00700", "09988"]), ("u2", "Other", ["00388"]), ("u3", None, [])], "pdf_url string, title string, stock_codes array<string>")
    listed = listed.withColumn("published_at", F.lit("2026-04-01").cast("timestamp"))
    texts = spark.createDataFrame([("u1", " ", "body", False), ("u2", "x", "y", True), ("u3", "z", None, False)], "pdf_url string, p string, f string, e boolean")
    texts = texts.withColumn("routed", extraction.route_text(F.col("p"), F.col("f"), F.col("e")))
    filed = extraction.filed_articles(listed, texts)
    assert {r["source_url"]: r["outcome"] for r in filed.collect()} == {"u1": "success", "u2": "pdf_encrypted", "u3": "success"}
    rows = extraction.raw_shape(filed, F.lit("2026-05-01").cast("timestamp")).collect()
    assert {r["source_url"]: (r["body"], r["extra_metadata"]["stock_code"]) for r in rows} == {"u1": ("body", ["00700", "09988"]), "u3": ("z", [])}
    plain = extraction.raw_shape(filed.drop("extra_metadata"), F.lit("2026-05-01").cast("timestamp"))
    assert plain.where("extra_metadata is not null").count() == 0
