"""Dimensions, tickers, company payloads and labels: rows with known results, nulls, ties and empty frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dimensions as dm
from tidemark.sources import payloads, shared


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_coins(spark):
    listed = spark.createDataFrame([("a", "btc", "Bitcoin", None, 1, 0), ("b", "BTC", "Other", "x", 9, 1), ("c", "usdt", None, "y", None, 2), ("d", None, "N", "z", 3, 3), ("e", "eth", "Late", "x", 5, None), ("f", "eth", "Tie", "x", 4, 4), ("ea", "eth", "First", "x", 7, 4)], "id string, symbol string, name string, image string, market_cap_rank int, position int")
    got = dm.coins(listed)
    assert got.columns == list(dm.COLUMNS)
    assert rows(got, "symbol", "name_en", "logo_url", "market") == [("BTC", "Bitcoin", "", ""), ("ETH", "First", "x", ""), ("USDT", "", "y", "")]
    assert [r.metadata for r in got.where("symbol = 'USDT'").collect()] == ['{"coin_id":"c","chain":"","is_stablecoin":"1","market_cap_rank":"0"}']
    assert dm.coins(listed.limit(0)).count() == 0


def test_metals_without_quotes(spark):
    none = spark.createDataFrame([("SI=F", " ", None), ("SI=F", "Silver Dec", "NYB"), ("SI=F", "Silver Mar", "CMX"), (None, "x", "y")], "source_symbol string, long_name string, exchange string")
    assert rows(dm.metals(none), "symbol", "exchange", "description", "asset_class") == [("XAG", "CMX", "Silver Dec", "COMMODITY"), ("XAU", "COMEX", "Gold (XAU/USD)", "COMMODITY")]


def test_all_assets_takes_frames_with_fewer_or_more_columns(spark):
    a = spark.createDataFrame([("A", "STOCK", 1)], "symbol string, asset_class string, extra int")
    got = dm.all_assets(a, dm.metals(spark.createDataFrame([], "source_symbol string, long_name string, exchange string")))
    assert got.columns == list(dm.COLUMNS) and got.count() == 3
    assert rows(got.where("symbol = 'A'"), "symbol", "source", "currency", "logo_url") == [("A", "listing", None, "")]


def test_pages_of_assets(spark):
    a = spark.range(25).select(F.format_string("%03d", "id").alias("id"), F.concat(F.lit("S"), "id").alias("symbol"), F.lit(None).cast("string").alias("name_en"), F.lit("x").alias("name_local"), F.lit(None).cast("string").alias("sector"), F.lit(None).cast("string").alias("industry"), F.when(F.col("id") % 5 == 0, "FUND").otherwise("STOCK").alias("asset_class"), F.lit("VN").alias("market"), F.when(F.col("id") % 7 == 0, "gone").otherwise("active").alias("status"))
    seen, after = [], None
    while page := dm.read_assets(a, after=after, limit=4).collect():
        assert len(page) <= 4 and {(r.name_en, r.sector, r.industry) for r in page} == {("", "Unknown", "")}
        seen += [r.id for r in page]
        after = seen[-1]
    assert seen == [f"{i:03}" for i in range(25) if i % 5 and i % 7]
    assert dm.read_assets(a, None).count() == sum(1 for i in range(25) if i % 7)


def test_active_tickers(spark):
    a = spark.createDataFrame(
        [("1", "fpt", None), ("2", " FPT ", '{"symbol_type":"STOCK"}'), ("3", "FPT", '{"symbol_type":"ETF"}'), (None, "VNM", "{}"), ("5", "E1", '{"symbol_type":" etf "}'), ("6", None, None), ("7", "  ", None), ("8", "ACB", "broken"), ("8", "ACB", "broken")], "id string, symbol string, metadata string"
    ).withColumns({"asset_class": F.lit("STOCK"), "market": F.lit("VN"), "status": F.lit("active")})
    assert rows(dm.active_tickers(a), "symbol", "asset_id") == [("ACB", "8"), ("FPT", "2"), ("VNM", "fallback")]
    assert dm.active_tickers(a.withColumn("market", F.lit(None).cast("string"))).count() == 0


def test_index_history(spark):
    bars = spark.createDataFrame([("HNXIndex", "2024-01-02", 10.0, "nan", None), ("HNXIndex", "2023-12-31", 9.0, "9", 1.0), ("HNXIndex", "no", 9.0, "9", 1.0), ("HNXINDEX", "2024-01-02", 1.0, "1", 1.0), ("XX", "2024-01-03", None, "2.5", 7.9)], "symbol string, trading_date string, high double, close string, volume double")
    day = lambda x: F.lit(x).cast("date")
    got = dm.index_history(bars, ["HNXINDEX", "XX", "XX", "none"], day("2024-01-01"), day("2024-01-31"))
    assert rows(got, *got.columns) == [("HNXINDEX", dt.date(2024, 1, 2), 0.0, 10.0, 0.0, 0.0, 0, "index"), ("XX", dt.date(2024, 1, 3), 0.0, None, 0.0, 2.5, 7, "index")]


def test_company_payloads(spark):
    event = '{"id":5,"eventTitle":"T","issueDate":"1704153600000","recordDate":"2024-02-01","en_EventListName":null,"eventListName":"Cổ tức","organCode":"FPT"}'
    p = spark.createDataFrame([("A", '{"OrganizationEvents":[%s]}' % event), ("B", '{"OrganizationEvents":[%s]}' % event.replace('"issueDate":"1704153600000",', "")), ("C", None), ("D", "{"), ("E", '{"OrganizationEvents":[]}')], "k string, body string")
    got = payloads.company_events(p, "k", "body")
    assert rows(got, "k", "event_id", "event_date", "event_type", "event_description", "public_date") == [("A", "5", dt.date(2024, 1, 2), "FPT", "Cổ tức", None), ("B", "5", dt.date(2024, 2, 1), "FPT", "Cổ tức", None)]
    o = spark.createDataFrame([("A", '{"CompanyListingInfo":{"ticker":"FPT","icbName3":"Phần mềm"}}'), ("B", '{"CompanyListingInfo":{"enIcbName4":"Banks"}}'), ("C", '{"CompanyListingInfo":null}'), ("D", None), ("E", "["), ("F", '{"CompanyListingInfo":{}}')], "k string, body string")
    assert rows(payloads.company_overview(o, "k", "body"), "symbol", "icb_name3", "icb_name4_en") == [("B", None, "Banks"), ("FPT", "Phần mềm", None)]


def test_labels_of_both_kinds(spark, tmp_path):
    rows_in = spark.createDataFrame([("1", True), ("2", False), (None, True), ("3", None), ("1", True)], "id string, label boolean")
    path = shared.new(spark, "labels")
    payloads.save_labels(rows_in, path)
    assert rows(payloads.read_labels(spark, path), "id", "label") == [("1", True), ("1", True), ("2", False)]
    (tmp_path / "hand.json").write_text('{\n  "a": true,\n  "b": false,\n  "c": "so so"\n}')
    assert rows(payloads.read_labels(spark, str(tmp_path / "hand.json"), lines=False), "id", "label") == [("a", True), ("b", False), ("c", None)]


def test_required_tables(spark):
    spark.range(1).createOrReplaceTempView("there")
    payloads.require_table(spark, "there")
    with pytest.raises(LookupError, match="no table gone, lost$"):
        payloads.require_table(spark, "there", "gone", "lost")
