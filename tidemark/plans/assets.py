"""Registered queries of asset dimensions, tickers, index bars, company payloads and labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dimensions as dm
from ..sources import payloads, shared, tables
from .loads import LISTING, _dimension
from .market import PRICES, rounded

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(c):
    return F.col(c).cast("string")


US = """us AS (SELECT 'C' || c_custkey % 97 AS symbol, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name_en, '' AS name_local, 'STOCK' AS asset_class, 'US' AS market, 'USD' AS currency, CASE WHEN c_custkey % 4 = 0 THEN 'NASDAQ' ELSE 'NYSE' END AS exchange, CASE WHEN c_custkey % 6 = 0 THEN 'Unknown' ELSE c_mktsegment END AS sector, CASE WHEN c_custkey % 7 = 0 THEN 'Unknown' ELSE coalesce(n_name, 'Unknown') END AS industry, CAST(NULL AS VARCHAR) AS industry_code, '' AS logo_url, '' AS description, '{"cik":"' || c_custkey || '"}' AS metadata, 'constituents' AS source FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""
COINS = """c0 AS (SELECT 'coin-' || p_partkey AS id, upper(CASE WHEN p_partkey % 17 = 3 THEN NULL WHEN p_partkey % 9 = 0 THEN 'usdt' WHEN p_partkey % 9 = 1 THEN 'Dai' ELSE 'k' || p_partkey // 3 END) AS symbol, p_name, p_size, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS image, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS rank FROM part),
coins AS (SELECT symbol, p_name AS name_en, '' AS name_local, 'CRYPTO' AS asset_class, '' AS market, 'USD' AS currency, '' AS exchange, 'Cryptocurrency' AS sector, '' AS industry, CAST(NULL AS VARCHAR) AS industry_code, image AS logo_url, '' AS description, '{"coin_id":"' || id || '","chain":"","is_stablecoin":"' || CASE WHEN symbol IN ('USDT', 'DAI') THEN 1 ELSE 0 END || '","market_cap_rank":"' || rank || '"}' AS metadata, 'coins' AS source FROM c0 WHERE symbol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY p_size, id) = 1)"""
METALS = """q AS (SELECT min(CASE WHEN c_custkey % 3 <> 0 THEN c_name END) AS long_name FROM customer WHERE c_custkey % 5 = 0),
metals AS (SELECT symbol, name_en, name_local, 'COMMODITY' AS asset_class, '' AS market, 'USD' AS currency, CASE WHEN symbol = 'XAU' THEN 'CMX' ELSE 'COMEX' END AS exchange, 'Precious Metals' AS sector, 'Commodity' AS industry, CAST(NULL AS VARCHAR) AS industry_code, '' AS logo_url, CASE WHEN symbol = 'XAU' THEN long_name ELSE name_en END AS description, '{"source_api":"quotes","source_symbol":"' || s || '","provider_symbol":"' || s || '","commodity_type":"precious_metal","unit":"troy_ounce","quote_pair":"' || symbol || '/USD"}' AS metadata, 'quotes' AS source FROM (VALUES ('XAU', 'Gold (XAU/USD)', 'Gold', 'GC=F'), ('XAG', 'Silver (XAG/USD)', 'Silver', 'SI=F')) AS m(symbol, name_en, name_local, s), q)"""


def _us(spark, sf):
    c, n, k = tables.table(spark, sf, "customer"), tables.table(spark, sf, "nation"), F.col("c_custkey")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    listed = j.select(
        F.concat(F.lit("C"), (k % 97).cast("string")).alias("symbol"), F.when(k % 5 != 0, F.col("c_name")).alias("name_en"), F.when(k % 4 != 0, "NYSE").alias("exchange"),
        F.when(k % 6 != 0, F.col("c_mktsegment")).alias("sector"), F.when(k % 7 != 0, F.col("n_name")).alias("industry"), F.to_json(F.struct(_text("c_custkey").alias("cik"))).alias("metadata"),
    )
    return dm.constituents(listed)


@query(f"WITH {US} SELECT * FROM us")
def us_assets(spark, sf):
    return _us(spark, sf)


def _coins(spark, sf):
    p, k = tables.table(spark, sf, "part"), F.col("p_partkey")
    symbol = F.when(k % 17 == 3, None).when(k % 9 == 0, "usdt").when(k % 9 == 1, "Dai").otherwise(F.concat(F.lit("k"), F.floor(k / 3).cast("string")))
    listed = p.select(F.concat(F.lit("coin-"), _text("p_partkey")).alias("id"), symbol.alias("symbol"), F.col("p_name").alias("name"), F.when(k % 3 != 0, F.col("p_type")).alias("image"), F.when(k % 4 != 0, F.col("p_size")).alias("market_cap_rank"), F.col("p_size").alias("position"))
    return dm.coins(listed)


@query(f"WITH {COINS} SELECT * FROM coins")
def crypto_assets(spark, sf):
    return _coins(spark, sf)


def _metals(spark, sf):
    c, k = tables.table(spark, sf, "customer"), F.col("c_custkey")
    contract = F.when(k % 5 == 0, "GC=F").when(k % 5 == 1, "SI=F").otherwise("CL=F")
    gold = k % 5 == 0
    return dm.metals(c.select(contract.alias("source_symbol"), F.when(gold & (k % 3 != 0), F.col("c_name")).otherwise(" ").alias("long_name"), F.when(gold, "CMX").alias("exchange")))


@query(f"WITH {METALS} SELECT * FROM metals")
def metal_assets(spark, sf):
    return _metals(spark, sf)


@query(f"WITH {LISTING}, {US}, {COINS}, {METALS} SELECT symbol, name_en, name_local, asset_class, market, currency, exchange, sector, industry, industry_code, '' AS logo_url, '' AS description, metadata, 'listing' AS source FROM d UNION ALL SELECT * FROM us UNION ALL SELECT * FROM coins UNION ALL SELECT * FROM metals")
def all_assets(spark, sf):
    """The listing, the constituents, the coins and the metals in one frame."""
    return dm.all_assets(_dimension(spark, sf), _us(spark, sf), _coins(spark, sf), _metals(spark, sf))


STORED = """a AS (SELECT CASE WHEN c_custkey % 31 <> 0 THEN 'A' || c_custkey END AS id, CASE WHEN c_custkey % 37 = 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN ' s' || c_custkey // 4 || ' ' ELSE 'S' || c_custkey // 4 END AS symbol, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name_en, CAST(NULL AS VARCHAR) AS name_local, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS sector, CASE WHEN c_custkey % 5 <> 0 THEN 'I' || c_nationkey END AS industry, CASE WHEN c_custkey % 8 = 0 THEN 'FUND' ELSE 'STOCK' END AS asset_class, CASE WHEN c_custkey % 9 = 0 THEN 'US' ELSE 'VN' END AS market, CASE WHEN c_custkey % 10 = 0 THEN 'delisted' ELSE 'active' END AS status, c_custkey % 5 = 2 AS other FROM customer)"""


def _stored(spark, sf):
    c, k = tables.table(spark, sf, "customer"), F.col("c_custkey")
    group = F.floor(k / 4).cast("string")
    meta = F.get(F.array(*(F.lit(x) for x in (None, '{"symbol_type":"stock "}', '{"symbol_type":"ETF"}', "{}", "no json"))), (k % 5).cast("int"))
    return c.select(
        F.when(k % 31 != 0, F.concat(F.lit("A"), _text("c_custkey"))).alias("id"), F.when(k % 37 == 0, " ").when(k % 2 == 0, F.concat(F.lit(" s"), group, F.lit(" "))).otherwise(F.concat(F.lit("S"), group)).alias("symbol"),
        F.when(k % 3 != 0, F.col("c_name")).alias("name_en"), F.lit(None).cast("string").alias("name_local"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("sector"), F.when(k % 5 != 0, F.concat(F.lit("I"), _text("c_nationkey"))).alias("industry"),
        F.when(k % 8 == 0, "FUND").otherwise("STOCK").alias("asset_class"), F.when(k % 9 == 0, "US").otherwise("VN").alias("market"), F.when(k % 10 == 0, "delisted").otherwise("active").alias("status"), meta.alias("metadata"),
    )


@query(f"WITH {STORED} SELECT id, symbol, coalesce(name_en, '') AS name_en, coalesce(name_local, '') AS name_local, coalesce(sector, 'Unknown') AS sector, coalesce(industry, '') AS industry, asset_class, market, status FROM a WHERE status = 'active' AND asset_class = 'STOCK'")
def read_assets_table(spark, sf):
    return dm.read_assets(_stored(spark, sf))


@query(f"WITH {STORED} SELECT upper(trim(symbol)) AS symbol, coalesce(id, 'fallback') AS asset_id FROM a WHERE asset_class = 'STOCK' AND market = 'VN' AND status = 'active' AND NOT other AND trim(symbol) <> '' QUALIFY row_number() OVER (PARTITION BY upper(trim(a.symbol)) ORDER BY a.symbol, id IS NULL, id) = 1")
def read_active_tickers(spark, sf):
    return dm.active_tickers(_stored(spark, sf))


@query(f"WITH {PRICES} SELECT t.ticker, trading_date, 0.0 AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CAST(volume AS BIGINT) AS volume, 'index' AS source FROM prices JOIN (VALUES ('vnindex', 'S0'), ('HNXINDEX', 'S1'), ('VN30', 'S2'), ('S5', 'S5')) AS t(ticker, symbol) USING (symbol) WHERE trading_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'")
def index_history(spark, sf):
    """Three indices under their own spelling and another symbol, over three years of bars that have no open."""
    s = F.col("symbol")
    bars = tables.prices(spark, sf).select(F.when(s == "S0", "VNINDEX").when(s == "S1", "HNXIndex").when(s == "S2", "VN30").otherwise(s).alias("symbol"), _text("trading_date").alias("trading_date"), "high", "low", "close", "volume")
    day = lambda x: F.lit(x).cast("date")
    return rounded(dm.index_history(bars, ["vnindex", "HNXINDEX", "VN30", "S5"], day("1994-01-01"), day("1996-12-31")))


_DAY = "CAST(o_orderdate AS DATE)"


@query(f"SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS event_id, CAST(CASE WHEN o_custkey % 3 = 0 THEN {_DAY} + 2 WHEN o_orderkey % 5 <> 0 THEN {_DAY} + 1 END AS VARCHAR) AS event_date, {_DAY} AS public_date, {_DAY} + 3 AS exright_date, o_orderpriority AS event_title, CASE WHEN o_orderkey % 4 = 0 THEN 'C' || o_custkey ELSE o_orderstatus END AS event_type, CASE WHEN o_orderkey % 2 = 0 THEN 'Order' ELSE 'Lệnh' END AS event_description FROM orders")
def company_events(spark, sf):
    """The orders of each customer and day as a landed payload of events, and back as rows; event dates, which may be missing, written out."""
    o, k = tables.table(spark, sf, "orders"), F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    millis = lambda d: (F.unix_date(d).cast("long") * 86_400_000).cast("string")
    e = F.struct(
        _text("o_orderkey").alias("id"), F.col("o_orderpriority").alias("eventTitle"), millis(day).alias("publicDate"), F.when(F.col("o_custkey") % 3 != 0, F.when(k % 5 != 0, F.date_add(day, 1).cast("string")).otherwise("")).alias("issueDate"),
        F.when(k % 4 != 0, F.col("o_orderstatus")).alias("eventListCode"), F.lit("Lệnh").alias("eventListName"), F.when(k % 2 == 0, "Order").alias("en_EventListName"), F.date_format(F.date_add(day, 2), "dd/MM/yyyy").alias("recordDate"),
        F.concat(F.lit("/Date("), millis(F.date_add(day, 3)), F.lit(")/")).alias("exrightDate"), F.concat(F.lit("C"), _text("o_custkey")).alias("organCode"),
    )
    landed = o.groupBy("o_custkey", day.alias("day")).agg(F.collect_list(e).alias("OrganizationEvents"))  # a customer's orders of one day
    events = payloads.company_events(landed.select("o_custkey", F.to_json(F.struct("OrganizationEvents")).alias("payload")), "o_custkey", "payload")
    return events.withColumn("event_date", _text("event_date"))


@query("SELECT CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'T' || c_custkey END AS symbol, c_name AS company_profile, CASE WHEN c_custkey % 3 <> 0 THEN 'The ' || c_name END AS company_profile_en, c_mktsegment AS icb_name2, lower(c_mktsegment) AS icb_name2_en, n_name AS icb_name3, CAST(NULL AS VARCHAR) AS icb_name3_en, 'N' || c_nationkey AS icb_name4, CAST(NULL AS VARCHAR) AS icb_name4_en FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0")
def company_overview(spark, sf):
    """Each customer as a landed profile, some of them null, empty or broken, and back as rows."""
    c, n, k = tables.table(spark, sf, "customer"), tables.table(spark, sf, "nation"), F.col("c_custkey")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    info = F.struct(F.when(k % 4 != 0, F.concat(F.lit("T"), _text("c_custkey"))).alias("ticker"), F.col("c_name").alias("companyProfile"), F.when(k % 3 != 0, F.concat(F.lit("The "), "c_name")).alias("en_CompanyProfile"), F.col("c_mktsegment").alias("icbName2"), F.lower("c_mktsegment").alias("enIcbName2"), F.col("n_name").alias("icbName3"), F.concat(F.lit("N"), _text("c_nationkey")).alias("icbName4"))
    body = F.when(k % 10 == 0, None).when(k % 11 == 0, "{}").when(k % 13 == 0, '{"CompanyListingInfo": oops').otherwise(F.to_json(F.struct(info.alias("CompanyListingInfo"))))
    return payloads.company_overview(j.select("c_custkey", body.alias("payload")), "c_custkey", "payload")


@query("SELECT 'P' || p_partkey AS symbol, p_name AS organ_name, p_type AS en_organ_name, p_brand AS exchange, p_size AS product_grp_id FROM part")
def listing_symbols(spark, sf):
    p = tables.table(spark, sf, "part")
    return payloads.listing_symbols(p.select(F.concat(F.lit("P"), _text("p_partkey")).alias("symbol"), F.col("p_name").alias("organName"), F.col("p_type").alias("enOrganName"), F.col("p_brand").alias("board"), F.col("p_size").alias("productGrpID")))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, toxic = 1 AS label FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL")
def saved_labels(spark, sf):
    """The toxicity labels written as JSON into the shared folder, and read back."""
    path = shared.new(spark, "labels")
    payloads.save_labels(tables.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("label")), path)
    return payloads.read_labels(spark, path)
