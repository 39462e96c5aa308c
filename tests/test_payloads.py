"""Landed payloads with known results."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.sources import payloads


def test_names():
    assert [payloads.camel_to_snake(x) for x in ("organName", "icbCode4", "HTTPServer", "plain")] == ["organ_name", "icb_code4", "http_server", "plain"]


def test_news_json(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"articles": [{"title": "b", "description": None, "publishedAt": "2024-01-02T00:00:00Z"}, {"title": "a", "description": "x", "publishedAt": "2024-01-01T00:00:00Z"}]}))
    got = payloads.news_json(spark, str(tmp_path)).orderBy("news_id").collect()
    assert [(r.news_id, r.text.strip()) for r in got] == [(0, "a x"), (1, "b")]


def test_json_rows(spark):
    good, bad = payloads.json_rows(spark.createDataFrame([('﻿{"a":1}',), ("",), ("{oops",), (None,)], "body string"), "body", "a int")
    assert sorted((r.parsed.a if r.parsed else -1) or -1 for r in good.collect()) == [-1, -1, 1]
    assert [r.body for r in bad.collect()] == ["{oops"]


def test_listings_and_articles(spark):
    page = spark.createDataFrame([(1, "### [One](http://h/a-post7.html)\n### [One](http://h/a-post7.html)\n### [Two](http://h/b)")], "page_id int, md string")
    stubs = payloads.markdown_stubs(page, "page_id", "md")
    assert {(r.title, r.news_id) for r in stubs.collect()} == {("One", 7), ("Two", None)}
    html = '<meta property="og:title" content="Meta"><script type="application/ld+json">{"headline":"LD","datePublished":""}</script>'
    meta = payloads.article_metadata(spark.createDataFrame([("http://h/a-post7.html", html)], "url string, html string"), "url", "html")
    got = payloads.article_record(stubs, meta, "url", F.lit("2025-01-01").cast("timestamp")).collect()
    assert [(r.news_id, r.title, r.publish_date) for r in got] == [(7, "LD", dt.datetime(2025, 1, 1))]


def test_events(spark):
    channels = payloads.channel_names(spark.createDataFrame([('[{"ChannelID":13,"NameEn":"","Name":"co tuc"}]',)], "p string"), "p")
    rows = spark.createDataFrame([(12345, 13, "/Date(1775494800000)/", "05/04/2026", None, " ", "<p>x</p>"), (2, 99, "1970-01-01", "2026-04-05", "1775494800000", "note", "")], "event_id int, channel_id int, event_date string, record_date string, exright_date string, note string, content string")
    got = {r.event_id: r for r in payloads.corporate_events(rows, channels).collect()}
    assert got["12345"].event_type == "co tuc" and got["12345"].event_description == "x" and got["12345"].event_date == dt.date(2026, 4, 6)
    assert got["2"].event_type == "99" and got["2"].event_date == dt.date(2026, 4, 5)


def test_company_news_and_codes(spark):
    rows = spark.createDataFrame([("1", "2024-12-20 10:30:00", "t", "relative/path", "25500", "25000"), (None, None, "u", "https://a.b/c", None, None)], "news_id string, publish_date string, title string, link string, price_at_publish string, reference_price string")
    got = {r.title: r for r in payloads.company_news(rows).collect()}
    assert (got["t"].source, got["t"].price, got["t"].price_change) == (None, 25500.0, 500.0)
    assert (got["u"].source, got["u"].price, got["u"].news_id) == ("a.b", 0.0, None)
    codes = payloads.industry_code(spark.createDataFrame([("", "5510", None, "1")], "icb_code4 string, icb_code3 string, icb_code2 string, icb_code1 string")).first()
    assert codes.industry_code == "5510"
    bars = payloads.intraday(spark.createDataFrame([("A", "stock", 1704067200, 1000.0, 1000.0, 1000.0, 2000.0, 5)], "symbol string, asset_type string, t long, open double, high double, low double, close double, volume long")).first()
    assert bars.close == 2.0 and bars.time == dt.datetime(2024, 1, 1, 7)
