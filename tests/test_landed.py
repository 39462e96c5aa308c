"""Landed tables, pages and statements with known results; reads by range, source and page."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import statements, stored, upsert
from tidemark.operators.numbering import numbered
from tidemark.sources import html_tables, payloads, ranges, shared

WIKI = """<table class="wikitable"><caption>List</caption><thead><tr><th rowspan="2">Symbol</th><th colspan="2">GICS</th><th rowspan=2>Founded</th></tr>
<tr><th>Sector<th>Sub-<br>Industry</tr></thead><tbody>
<tr><td><a href="x">MMM</a></td><td rowspan="2">Industrials &amp; more</td><td>Conglomerates</td><td>1902</td></tr>
<tr><td>AOS</td><td>Building<sup>[1]</sup> <script>no()</script>Products</td></tr>
<tr><td>A<table><tr><td>inner</td></tr></table>BT</td><td colspan=2>Health Care</td><td></td></tr></table>"""


def test_grid():
    (names, body), (inner, cells) = html_tables.grids(WIKI)
    assert names == ["Symbol", "GICS Sector", "GICS Sub- Industry", "Founded"]
    assert body == [["MMM", "Industrials & more", "Conglomerates", "1902"], ["AOS", "Industrials & more", "Building[1] Products", None], ["ABT", "Health Care", "Health Care", ""]]
    assert inner == ["0"] and cells == [["inner"]]


@pytest.mark.parametrize("html,want", [(None, []), ("", []), ("<table></table>", []), ("<p>no", []), ("<table><td>a<td>b", [(["0", "1"], [["a", "b"]])]), ("<table><tr><th>H</th></tr></table>", [(["H"], [])]), ("<table><tr><td rowspan=0>a<td colspan=x>b<tr><td>c</table>", [(["0", "1"], [["a", "b"], ["a", "c"]])])])
def test_odd_tables(html, want):
    assert html_tables.grids(html) == want


def test_a_span_does_not_reach_beyond_the_table():
    (_, body), = html_tables.grids('<table><tr><td rowspan="99999999" colspan="9999">a</td></tr><tr><td>b</td></tr></table>')
    assert [len(x) for x in body] == [1001, 1001] and body[0][999:] == ["a", None] and body[1][999:] == ["a", "b"]


def test_html_records(spark):
    pages = spark.createDataFrame([(1, WIKI), (2, None), (None, WIKI.replace("GICS", "Other"))], "page long, html string")
    rows = html_tables.html_tables(pages, "page")
    assert rows.count() == 8
    got = html_tables.records(rows, {"symbol": "Symbol", "sector": "GICS Sector"})
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, "MMM", "Industrials & more"), (1, 0, 1, "AOS", "Industrials & more"), (1, 0, 2, "ABT", "Health Care")]


def test_merge_pages(spark):
    """A group split over pages, one of them wrapped, one broken, one without content; pages come in their order."""
    head = '"Head":[{"YearPeriod":2025,"TermName":"Quý 4"}]'
    rows = [
        ("A", 2, '{"data":{%s,"Content":{"P":[{"NameEn":"Third","Value1":"3"}],"Q":[{"NameEn":"Other","Value1":"9"}]}}}' % head),
        ("A", 1, '{"Content":{"P":[{"NameEn":"First","Value1":"1"},{"NameEn":"Second","Value1":"2"}],"R":null}}'),
        ("A", 3, "{oops"), ("A", 4, '{"data":{}}'), ("B", 1, "null"), ("B", 1, None),
    ]
    pages = spark.createDataFrame(rows, "k string, page int, body string")
    got = [(r.k, r.group, r.number, r.record["NameEn"]) for r in payloads.merge_payload_pages(pages, "k", "page", "body").orderBy("group", "number").collect()]
    assert got == [("A", "P", 1, "First"), ("A", "P", 2, "Second"), ("A", "P", 3, "Third"), ("A", "Q", 1, "Other")]
    long = statements.periodic_statement(payloads.merged_payload(pages, "k", "page", "body"), "k", "payload").collect()
    assert {(r["item"], r.year, r.quarter, r.fiscal_date, r.value) for r in long} == {(n, 2025, 4, dt.date(2025, 12, 31), v) for n, v in (("First", 1.0), ("Second", 2.0), ("Third", 3.0), ("Other", 9.0))}


def test_merged_records_leave_their_payload_behind(spark):
    """Pages with one number come in the order of their text, and no record carries the text to where records are numbered."""
    one = '{"Content":{"P":[{"NameEn":"%s"},{"NameEn":"%s"}]}}'
    rows = [("A", 1, one % ("z", "y")), ("A", 1, one % ("a", "b")), ("A", 1, one % ("a", "b")), ("A", 0, one % ("first", "next"))]
    merged = payloads.merge_payload_pages(spark.createDataFrame(rows, "k string, page int, body string"), "k", "page", "body")
    assert [r.record["NameEn"] for r in merged.orderBy("number").collect()] == ["first", "next", "a", "a", "b", "b", "z", "y"]
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "body" not in plan[: plan.rindex("Generate explode")]


def test_statement_by_metadata(spark):
    meta = [(1, "rev", "INCOME", "CT", "Revenue (Bn. VND)", "Doanh thu", 2), (2, "rev", "INCOME", "NH", "never", "", 1), (3, "pe", " ratio ", "CT", "", "P/E vi", 1), (4, "nim", "income", "NH", None, None, 0), (5, "", "income", "CT", "no", "", 0), (6, "x", "cash", "CT", "X", "", 0)]
    m = spark.createDataFrame(meta, "position int, field_name string, type string, com_type_code string, en_name string, name string, order int")
    companies = spark.createDataFrame([("HPG", "CT"), ("VCB", "NH"), ("NEW", None)], "symbol string, company_type string")
    fields = {"rev": 1000.0, "pe": None, "nim": 3.5, "x": 1.0, "ghost": 2.0}
    rows = spark.createDataFrame([(s, 2024, 4, fields) for s in ("HPG", "VCB", "NEW", "GONE")], "symbol string, year int, quarter int, fields map<string,double>")
    got = payloads.statement_by_metadata(rows, companies, m, ["income", "RATIO"]).collect()
    ct = {(1, "pe", "P/E vi", None), (2, "rev", "Revenue (Bn. VND)", 1000.0)}
    by = {s: {(r.place, r.field_name, r.label, r.value) for r in got if r.symbol == s} for s in ("HPG", "VCB", "NEW", "GONE")}
    assert by["HPG"] == by["NEW"] == by["GONE"] == ct
    assert by["VCB"] == {(1, "nim", "nim", 3.5), (2, "pe", "P/E vi", None), (3, "rev", "Revenue (Bn. VND)", 1000.0)}
    assert {r.field_name for r in payloads.statement_by_metadata(rows, companies, m).collect()} == {"rev", "pe", "nim", "x"}


def test_prices_by_range(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    make = lambda symbols, x: spark.createDataFrame([(s, day(i), x + i) for s in symbols for i in range(120)], "symbol string, trading_date date, close double")
    sources = []
    for name, rows in (("one", make("AB", 100.0).where("symbol = 'A' OR trading_date < '2024-02-01'")), ("two", make("BC", 500.0))):
        sources.append((name, ranges.price_table(shared.new(spark, name))))
        stored.create(sources[-1][1], rows)
    got = ranges.read_prices(spark, sources, ["A", "B"], day(40), day(50))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(part") >= 2 and "PushedFilters: [IsNotNull(trading_date)" in plan
    rows = got.orderBy("symbol", "trading_date").collect()
    assert [(r.symbol, r.trading_date, r.close, r.source_provider) for r in rows] == [("A", day(i), 100.0 + i, "one") for i in range(40, 51)] + [("B", day(i), 500.0 + i, "two") for i in range(40, 51)]
    np.testing.assert_allclose([r.log_ret for r in rows[1:11]], [np.log((100 + i) / (99 + i)) for i in range(41, 51)])
    assert rows[0].log_ret is None and ranges.read_prices(spark, sources).where("symbol = 'B'").select("source_provider").distinct().collect() == [("one",)]


def test_news_pages_meet(spark):
    rows = [(i, i % 3, None if i % 6 == 0 else dt.datetime(2024, 1, 1 + i % 4), f"t{i}" if i % 5 else None, "c" if i % 4 else None) for i in range(31)]
    news = spark.createDataFrame(rows, "news_id long, asset_id long, publish_date timestamp, title string, content string")
    every = [r.news_id for r in ranges.read_news(news, [0, 2]).collect()]
    assert sorted(every) == [i for i in range(31) if i % 3 != 1]
    after, pages = None, []
    while page := ranges.read_news(news, [0, 2], after, 4).collect():
        pages += [r.news_id for r in page]
        after = (page[-1].publish_date, page[-1].news_id)
    assert pages == every
    assert {r.news_id: r.text for r in ranges.read_news(news).collect()}[0] == "" and {r.news_id: r.text for r in ranges.read_news(news).collect()}[1] == "t1 c"


def test_numbers_follow_the_order(spark):
    d = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("same"))
    got = numbered(d.repartition(5), ["k"], "n")
    assert {(r.k, r.n) for r in got.collect()} == {(i, i) for i in range(5000)}
    assert sorted(r.n for r in numbered(d, ["same"], "n").collect()) == list(range(5000))
    assert numbered(d.limit(0), ["k"]).count() == 0
    chunks = upsert.chunked(spark.createDataFrame([("b",), ("a",), ("c",)], "symbol string"), 2, ["symbol"]).collect()
    assert {(r.symbol, r.chunk_index) for r in chunks} == {("a", 1), ("b", 1), ("c", 2)}
    assert "Window" not in upsert.chunked(d, 10, ["k"])._jdf.queryExecution().optimizedPlan().toString().replace("Window [sum(__n", "")
