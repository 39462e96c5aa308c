"""Registered queries of the loads: context joins, normalisers, upserts and streams, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import asof, jobs, statements, stored, upsert
from ..sources import html_tables, payloads, ranges, shared, tables
from ..streaming import jobs as streams
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


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tables.table(spark, sf, name)


ORD = "o AS (SELECT o_custkey AS asset_id, o_orderkey, CAST(o_orderdate AS DATE) AS d, o_totalprice, o_orderpriority, o_orderstatus FROM orders)"


def _orders(spark, sf):
    return _t(spark, sf, "orders").select(F.col("o_custkey").alias("asset_id"), "o_orderkey", F.to_date("o_orderdate").alias("d"), "o_totalprice", "o_orderpriority", "o_orderstatus")


@query(f"WITH {ORD} SELECT asset_id, o_orderkey, d, o_totalprice FROM o QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY d DESC, o_orderkey DESC, o_totalprice DESC) = 1")
def latest_price_per_asset(spark, sf):
    return asof.latest_per_key(_orders(spark, sf).select("asset_id", "o_orderkey", "d", "o_totalprice"), ["asset_id"], ["d", "o_orderkey", "o_totalprice"])


@query(f"WITH {PRICES}, n AS (SELECT symbol, close, trading_date, lag(close, 20) OVER (PARTITION BY symbol ORDER BY trading_date) AS previous FROM prices) SELECT symbol, round(arg_max(close, trading_date), 6) AS latest, round(arg_max(previous, trading_date), 6) AS previous FROM n GROUP BY symbol")
def nth_previous_close(spark, sf):
    return rounded(asof.nth_previous(tables.prices(spark, sf), "symbol", "trading_date", "close", 20))


@query(f"""WITH {ORD}, f AS (SELECT asset_id, d, max(o_totalprice) AS eps FROM o WHERE o_orderkey % 2 = 0 GROUP BY asset_id, d), l AS (SELECT asset_id, d, count(*) AS trades FROM o WHERE o_orderkey % 2 = 1 GROUP BY asset_id, d)
SELECT l.asset_id, l.d, trades, eps FROM l ASOF LEFT JOIN f ON l.asset_id = f.asset_id AND l.d >= f.d""")
def asof_fundamentals(spark, sf):
    o = _orders(spark, sf)
    facts = o.where("o_orderkey % 2 = 0").groupBy("asset_id", "d").agg(F.max("o_totalprice").alias("eps"))
    left = o.where("o_orderkey % 2 = 1").groupBy("asset_id", "d").agg(F.count("*").alias("trades"))
    return asof.asof_join(left, facts, "asset_id", "d", ["eps"])


CAND = f"""{ORD}, ev AS (SELECT asset_id, d AS event_date, CASE WHEN o_orderkey % 4 <> 0 THEN d END AS ingested FROM o WHERE o_orderstatus = 'F'), pr AS (SELECT asset_id, max(d) AS loaded FROM o WHERE o_orderstatus = 'O' GROUP BY asset_id), latest AS (SELECT max(d) AS today FROM o),
asked AS (SELECT DISTINCT ev.asset_id, c_name AS symbol FROM ev JOIN customer ON c_custkey = ev.asset_id LEFT JOIN pr USING (asset_id), latest WHERE loaded IS NULL OR ingested > loaded OR (ingested IS NULL AND event_date >= today - 90))"""


def _candidates(spark, sf):
    o = _orders(spark, sf)
    events = o.where("o_orderstatus = 'F'").select("asset_id", F.col("d").alias("event_date"), F.when(F.col("o_orderkey") % 4 != 0, F.col("d")).alias("ingested_at"))
    loads = o.where("o_orderstatus = 'O'").select("asset_id", F.col("d").alias("ingested_at"))
    assets = _t(spark, sf, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("symbol"))
    today = F.lit(o.agg(F.max("d")).first()[0]).cast("date")
    return events, assets, loads, today


@query(f"WITH {CAND} SELECT * FROM asked")
def refresh_candidates(spark, sf):
    events, assets, loads, today = _candidates(spark, sf)
    return asof.refresh_candidates(events, assets, loads, today, 90)


HIST = "h AS (SELECT asset_id, d AS trading_date, max(o_totalprice) + 1 AS close FROM o GROUP BY asset_id, d), old AS (SELECT asset_id, d AS trading_date, max(o_totalprice) AS close FROM o WHERE o_orderkey % 3 <> 0 GROUP BY asset_id, d)"


@query(f"WITH {CAND}, {HIST}, b AS (SELECT h.* FROM h SEMI JOIN asked USING (asset_id), latest WHERE trading_date > today - INTERVAL 6 YEAR) SELECT asset_id, trading_date, coalesce(b.close, old.close) AS close FROM old FULL JOIN b USING (asset_id, trading_date)")
def history_refresh(spark, sf):
    events, assets, loads, today = _candidates(spark, sf)
    by_day = lambda df, more: df.groupBy("asset_id", F.col("d").alias("trading_date")).agg((F.max("o_totalprice") + more).alias("close"))
    o = _orders(spark, sf)
    return jobs.history_refresh(by_day(o.where("o_orderkey % 3 <> 0"), 0), by_day(o, 1), events, assets, loads, today, 90)


LOAD = """r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS asset_id, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d, o_totalprice FROM orders), today AS (SELECT max(CAST(o_orderdate AS DATE)) AS t FROM orders),
g AS (SELECT * FROM r WHERE d IS NOT NULL AND asset_id IS NOT NULL), i AS (SELECT g.* FROM g, today WHERE d > t - 400 AND d <= t), b AS (SELECT asset_id, d AS trading_date, max(o_totalprice) AS close FROM i GROUP BY asset_id, d),
old AS (SELECT o_custkey AS asset_id, CAST(o_orderdate AS DATE) AS trading_date, max(o_totalprice) / 2 AS close FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2)"""


def _load(spark, sf):
    raw = _raw(spark, sf).join(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day")), "o_orderkey")
    rows = raw.select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("asset_id"), F.col("raw").alias("trading_date"), F.col("o_totalprice").alias("close"), F.lit(0).alias("volume"))
    old = _t(spark, sf, "orders").where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("asset_id"), F.col("o_orderdate").cast("date").alias("trading_date")).agg((F.max("o_totalprice") / 2).alias("close")).withColumn("volume", F.lit(0.0))
    today = F.lit(_t(spark, sf, "orders").agg(F.max("o_orderdate").cast("date")).first()[0]).cast("date")
    return jobs.daily_price_load(old, rows, today, 400)


@query(f"WITH {LOAD} SELECT asset_id, trading_date, coalesce(b.close, old.close) AS close, 0.0::DOUBLE AS volume FROM old FULL JOIN b USING (asset_id, trading_date)")
def daily_price_load(spark, sf):
    return _load(spark, sf)[0]


@query(f"WITH {LOAD} SELECT (SELECT count(*) FROM i) AS loaded, (SELECT count(*) FROM r WHERE d IS NULL OR asset_id IS NULL) AS failed, (SELECT count(*) FROM g) - (SELECT count(*) FROM i) AS outside, 'partial' AS alert")
def daily_price_report(spark, sf):
    return _load(spark, sf)[1]


INGEST = """a AS (SELECT doc_id AS news_id, 'news ' || doc_id AS title, coalesce(text, '') AS body, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS TIMESTAMP) AS publish_date FROM documents WHERE doc_id % 3 <> 0),
t AS (SELECT news_id, title, publish_date, unnest(regexp_split_to_array(upper(regexp_replace(title || '. ' || substr(body, 1, 500), '^[. ]+|[. ]+$', '', 'g')), '[^\\p{L}\\p{N}_]+')) AS w FROM a), m AS (SELECT news_id, arg_min(id, w) AS asset_id FROM t JOIN (VALUES ('THE', 7), ('DIE', 8), ('LES', 9)) v(s, id) ON s = w GROUP BY news_id),
b AS (SELECT news_id, title, publish_date, asset_id, least(greatest(coalesce(toxic * 2.0 - 0.5, 0), -1), 1)::DOUBLE AS score FROM a LEFT JOIN m USING (news_id) LEFT JOIN (SELECT doc_id AS news_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (news_id)),
old AS (SELECT doc_id AS news_id, 'old ' || doc_id AS title, CAST(DATE '2023-01-01' AS TIMESTAMP) AS publish_date, CAST(NULL AS INT) AS asset_id, 0.25::DOUBLE AS score FROM documents WHERE doc_id % 2 = 0),
n AS (SELECT news_id, coalesce(old.title, b.title) AS title, coalesce(old.publish_date, b.publish_date) AS publish_date, CASE WHEN b.news_id IS NOT NULL THEN b.asset_id ELSE old.asset_id END AS asset_id, CASE WHEN b.news_id IS NOT NULL THEN b.score ELSE old.score END AS score FROM old FULL JOIN b USING (news_id))"""


def _ingest(spark, sf):
    d = _t(spark, sf, "documents")
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("timestamp")
    a = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("news_id"), F.concat(F.lit("news "), F.col("doc_id").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("body"), date.alias("publish_date"))
    old = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("news_id"), F.concat(F.lit("old "), F.col("doc_id").cast("string")).alias("title"), F.lit("2023-01-01").cast("timestamp").alias("publish_date"), F.lit(None).cast("int").alias("asset_id"), F.lit(0.25).alias("score"))
    assets = spark.createDataFrame([("THE", 7), ("DIE", 8), ("LES", 9)], "symbol string, asset_id int")
    scores = _t(spark, sf, "labels").groupBy(F.col("doc_id").alias("news_id")).agg((F.max("toxic") * 2.0 - 0.5).alias("score"))
    return jobs.news_ingest(old, a, assets, scores, _t(spark, sf, "embeddings").select(F.col("vec_id").alias("news_id")))


@query(f"WITH {INGEST} SELECT * FROM n")
def news_ingest(spark, sf):
    return _ingest(spark, sf)[0]


@query(f"WITH {INGEST} SELECT news_id FROM n WHERE news_id NOT IN (SELECT vec_id FROM embeddings)")
def news_to_embed(spark, sf):
    return _ingest(spark, sf)[1]


SNAP = f"""{ORD}, p AS (SELECT asset_id, d AS trading_date, max(o_totalprice) AS close, count(*) AS volume FROM o WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2), f AS (SELECT asset_id, d AS fiscal_date, CASE WHEN max(o_orderkey) % 2 = 0 THEN max(o_totalprice) / 1000 END AS pe_ratio, CASE WHEN max(o_orderkey) % 5 <> 0 THEN min(o_totalprice) / 10 END AS eps, max(o_totalprice) / 1e6 AS roe FROM o WHERE o_orderkey % 3 = 0 GROUP BY 1, 2),
w AS (SELECT *, lag(close, 20) OVER (PARTITION BY asset_id ORDER BY trading_date) AS before FROM p), l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY trading_date DESC) = 1)"""


@query(f"""WITH {SNAP} SELECT l.asset_id, c_name AS symbol, l.trading_date, close, volume, round(CASE WHEN coalesce(before, 0) = 0 THEN 0 ELSE (close - before) / before * 100 END, 6) + 0.0 AS return_1m, coalesce(n_name, 'N/A') AS sector, round(coalesce(pe_ratio, CASE WHEN coalesce(eps, 0) = 0 THEN 0 ELSE close * 1000 / eps END, 0), 6) AS pe_ratio, round(coalesce(roe, 0), 6) AS roe, round(coalesce(eps, 0), 6) AS eps
FROM l ASOF LEFT JOIN f ON l.asset_id = f.asset_id AND l.trading_date >= f.fiscal_date JOIN customer ON c_custkey = l.asset_id LEFT JOIN nation ON n_nationkey = c_nationkey""")
def stock_snapshot(spark, sf):
    o = _orders(spark, sf)
    prices = o.where("o_orderkey % 3 <> 0").groupBy("asset_id", F.col("d").alias("trading_date")).agg(F.max("o_totalprice").alias("close"), F.count("*").alias("volume"))
    ratios = o.where("o_orderkey % 3 = 0").groupBy("asset_id", F.col("d").alias("fiscal_date")).agg(F.when(F.max("o_orderkey") % 2 == 0, F.max("o_totalprice") / 1000).alias("pe_ratio"), F.when(F.max("o_orderkey") % 5 != 0, F.min("o_totalprice") / 10).alias("eps"), (F.max("o_totalprice") / 1e6).alias("roe"))
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    assets = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("symbol"), F.col("n_name").alias("sector"))
    return rounded(jobs.stock_snapshot(prices, ratios, assets))


EVENTS = "e AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN DATE '1753-01-01' ELSE CAST(o_orderdate AS DATE) END AS ex, CAST(o_orderdate AS DATE) + 10 AS pub, o_orderpriority AS kind, lower(o_orderpriority || ' ' || o_orderstatus) AS title FROM orders), s AS (SELECT *, CASE WHEN year(ex) < 2000 THEN pub ELSE ex END AS event_date, CASE WHEN contains(kind, 'URGENT') THEN 0.8 ELSE round(coalesce((p - n) / nullif(p + n, 0), 0), 4) END AS sentiment FROM (SELECT *, CAST(contains(title, 'high') AS INT) + CAST(contains(title, ' f') AS INT) AS p, CAST(contains(title, 'low') AS INT) + CAST(contains(title, ' o') AS INT) AS n FROM e))"


def _events(spark, sf):
    o = _t(spark, sf, "orders")
    d = F.col("o_orderdate").cast("date")
    e = o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("1753-01-01").cast("date")).otherwise(d).alias("exright_date"), F.date_add(d, 10).alias("public_date"), F.col("o_orderpriority").alias("event_list_name"), F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).alias("event_title"))
    return jobs.scored_events(e, ["high", " f"], ["low", " o"], "URGENT")


@query(f"WITH {EVENTS} SELECT kind AS event_list_name, count(*) AS events, round(avg(sentiment), 6) AS avg_sentiment FROM s GROUP BY kind")
def event_news_sentiment(spark, sf):
    return rounded(jobs.event_summary(_events(spark, sf)))


@query(f"WITH {EVENTS} SELECT o_custkey, o_orderkey, event_date, sentiment, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY event_date DESC, o_orderkey DESC) AS INT) AS rank FROM s WHERE event_date >= DATE '1996-01-01' QUALIFY rank <= 20")
def recent_events(spark, sf):
    return jobs.recent_events(_events(spark, sf), "o_custkey", "o_orderkey", "1996-01-01").select("o_custkey", "o_orderkey", "event_date", "sentiment", "rank")


@query("SELECT doc_id AS news_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def unembedded_news(spark, sf):
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("news_id"))
    return asof.unmatched(_t(spark, sf, "documents").select(F.col("doc_id").alias("news_id")), e, ["news_id"])


_class = "CASE WHEN k IN ('STOCK', 'INDEX', 'ETF') THEN k WHEN k = 'UNIT_TRUST' THEN 'FUND' WHEN k = 'DEBENTURE' THEN 'BOND' WHEN k = 'FU_BOND' OR contains(k, 'WARRANT') THEN 'DERIVATIVE' WHEN contains(k, 'BOND') THEN 'BOND' WHEN g = 'FIO' THEN 'DERIVATIVE' WHEN g = 'HCX' THEN 'BOND' WHEN regexp_matches(symbol, '^C[A-Z]{3,}[0-9]{2,}$') THEN 'DERIVATIVE' ELSE 'STOCK' END"
LISTING = f"""l AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'CABC' || p_partkey % 90 + 10 || p_partkey ELSE 'P' || p_partkey END AS symbol, p_name AS organ_name, CASE WHEN p_partkey % 13 = 0 THEN 'Delisted' WHEN p_partkey % 7 = 0 THEN NULL ELSE 'HNX' END AS exchange, ['STOCK', 'ETF', 'UNIT_TRUST', 'DEBENTURE', 'INDEX', 'FU_BOND', 'COVERED WARRANT', 'GOV BOND', '', NULL][p_partkey % 10 + 1] AS type, ['FIO', 'HCX', 'XX'][p_partkey % 3 + 1] AS g FROM part),
d AS (SELECT symbol, organ_name AS name_en, organ_name AS name_local, {{0}} AS asset_class, 'VN' AS market, 'VND' AS currency, coalesce(exchange, 'HOSE') AS exchange, coalesce(r_name, 'Unknown') AS sector, coalesce(n_name, 'Unknown') AS industry, CASE WHEN p_partkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE CAST(r_regionkey AS VARCHAR) END AS industry_code, '{{{{"source_api":"listing","symbol_type":"' || coalesce(type, 'STOCK') || '"}}}}' AS metadata
 FROM (SELECT *, upper(trim(coalesce(type, ''))) AS k FROM l) LEFT JOIN nation ON n_nationkey = p_partkey % 40 LEFT JOIN region ON r_regionkey = n_regionkey WHERE upper(coalesce(exchange, '')) <> 'DELISTED')""".replace("{0}", _class).replace("{{", "{").replace("}}", "}")


def _dimension(spark, sf):
    p, n, r = (_t(spark, sf, x) for x in ("part", "nation", "region"))
    k = F.col("p_partkey")
    symbol = F.when(k % 11 == 0, F.concat(F.lit("CABC"), (k % 90 + 10).cast("string"), k.cast("string"))).otherwise(F.concat(F.lit("P"), k.cast("string")))
    kinds = F.array(*(F.lit(x) for x in ("STOCK", "ETF", "UNIT_TRUST", "DEBENTURE", "INDEX", "FU_BOND", "COVERED WARRANT", "GOV BOND", "", None)))
    listing = p.select(symbol.alias("symbol"), F.col("p_name").alias("organ_name"), F.when(k % 13 == 0, "Delisted").when(k % 7 != 0, "HNX").alias("exchange"), F.get(kinds, (k % 10).cast("int")).alias("type"), F.get(F.array(*map(F.lit, ("FIO", "HCX", "XX"))), (k % 3).cast("int")).alias("product_grp_id"))
    j = p.join(n, n["n_nationkey"] == k % 40).join(r, n["n_regionkey"] == r["r_regionkey"])
    industries = j.select(symbol.alias("symbol"), F.col("r_name").alias("icb_name2"), F.col("n_name").alias("icb_name3"), F.when(k % 2 == 0, F.col("n_nationkey")).cast("string").alias("icb_code4"), F.col("r_regionkey").cast("string").alias("icb_code2"))
    return jobs.assets_dimension(listing, industries)


@query(f"WITH {LISTING} SELECT * FROM d")
def assets_dimension(spark, sf):
    return _dimension(spark, sf)


@query(f"WITH {LISTING} SELECT asset_class, count(*) AS n FROM d GROUP BY asset_class")
def asset_class_counts(spark, sf):
    return _dimension(spark, sf).groupBy("asset_class").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def supplier_industries(spark, sf):
    s, n, r = (_t(spark, sf, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("s_suppkey", "s_name", "n_name", "r_name")


_MARKET = "CASE WHEN {0} % 3 = 0 THEN NULL ELSE 'VN' END"


@query(f"WITH t AS (SELECT c_name AS symbol, {_MARKET.format('c_custkey')} AS market, 'STOCK' AS asset_class, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_name AS symbol, {_MARKET.format('c_custkey')} AS market, 'STOCK' AS asset_class, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 5 = 0) SELECT * FROM t WHERE symbol NOT IN (SELECT symbol FROM b) UNION ALL SELECT * FROM b")
def upsert_assets(spark, sf):
    c = _t(spark, sf, "customer")
    of = lambda where, more: c.where(where).select(F.col("c_name").alias("symbol"), F.when(F.col("c_custkey") % 3 != 0, "VN").alias("market"), F.lit("STOCK").alias("asset_class"), (F.col("c_acctbal") + more).alias("v"))
    return jobs.upsert_assets(of("c_custkey % 2 = 0", 0), of("c_custkey % 5 = 0", 1), ["v"])


UP = f"{ORD}, t0 AS (SELECT asset_id, d, max(o_totalprice) AS price, 'old' AS source FROM o WHERE o_orderkey % 3 <> 0 GROUP BY asset_id, d), b0 AS (SELECT asset_id, d, max(o_totalprice) + 1 AS price, 'new' AS source FROM o WHERE o_orderkey % 3 <> 1 GROUP BY asset_id, d)"


def _up(spark, sf):
    o = _orders(spark, sf)
    t = o.where("o_orderkey % 3 <> 0").groupBy("asset_id", "d").agg(F.max("o_totalprice").alias("price")).withColumn("source", F.lit("old"))
    b = o.where("o_orderkey % 3 <> 1").select("asset_id", "d", (F.col("o_totalprice") + 1).alias("price"), F.lit("new").alias("source"))
    return t, b


@query(f"WITH {UP} SELECT asset_id, d, coalesce(b0.price, t0.price) AS price, CASE WHEN b0.price IS NULL THEN 'old' ELSE 'new' END AS source FROM t0 FULL JOIN b0 USING (asset_id, d)")
def upsert_prices(spark, sf):
    t, b = _up(spark, sf)
    return upsert.upsert(t, b, ["asset_id", "d"], ["price"])


@query(f"WITH {UP} SELECT asset_id, d, coalesce(b0.price, t0.price) AS price, CASE WHEN b0.price IS NULL THEN 'old' ELSE 'new' END AS source FROM t0 FULL JOIN b0 USING (asset_id, d)")
def stored_upsert_prices(spark, sf):
    """The same as a write into a stored table in folders of a year, of which the batch's are read and written."""
    t, b = _up(spark, sf)
    table = stored.Table(shared.new(spark, "prices"), ("asset_id", "d"), ("price",), "date_format(d, 'yyyy')")
    stored.create(table, t)
    stored.upsert_into(table, b)
    return table.read(spark)


@query(f"WITH {UP} SELECT asset_id, d, coalesce(b0.price, t0.price) AS price, coalesce(t0.source, b0.source) AS source FROM t0 FULL JOIN b0 USING (asset_id, d)")
def stored_upsert_partial(spark, sf):
    """Only the price of rows that are there changes."""
    t, b = _up(spark, sf)
    table = stored.Table(shared.new(spark, "partial"), ("asset_id", "d"), ("price",), "date_format(d, 'yyyy')")
    stored.create(table, t)
    stored.upsert_into(table, b, ["price"])
    return table.read(spark)


@query(f"WITH {UP} SELECT asset_id, d, coalesce(b0.price, t0.price) AS price, coalesce(t0.source, b0.source) AS source FROM t0 FULL JOIN b0 USING (asset_id, d)")
def upsert_news_partial(spark, sf):
    t, b = _up(spark, sf)
    return upsert.upsert_partial(t, b, ["asset_id", "d"], ["price"], ["price"])


@query(f"WITH {UP}, b1 AS (SELECT * FROM b0 WHERE asset_id % 2 = 0) SELECT * FROM t0 WHERE asset_id NOT IN (SELECT asset_id FROM b1) UNION ALL SELECT * FROM b1")
def replace_by_key(spark, sf):
    t, b = _up(spark, sf)
    b = b.where("asset_id % 2 = 0").groupBy("asset_id", "d").agg(F.max("price").alias("price")).withColumn("source", F.lit("new"))
    return upsert.replace_by_key(t, b, ["asset_id"])


RAW = "raw AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN '/Date(' || CAST(epoch(o_orderdate) AS BIGINT) * 1000 || ')/' WHEN 3 THEN CAST(CAST(epoch(o_orderdate) AS BIGINT) * 1000 AS VARCHAR) ELSE 'not-a-date' END AS raw, o_orderdate FROM orders)"


def _raw(spark, sf):
    s = F.unix_timestamp("o_orderdate")
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 2, F.concat(F.lit("/Date("), (s * 1000).cast("string"), F.lit(")/"))).when(k == 3, (s * 1000).cast("string")).otherwise("not-a-date")
    return _t(spark, sf, "orders").select("o_orderkey", "o_custkey", raw.alias("raw"))


@query(f"WITH {RAW} SELECT o_orderkey, raw, CASE WHEN o_orderkey % 5 < 4 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d, o_orderkey % 5 = 4 AS failed FROM raw")
def parse_mixed_date(spark, sf):
    """All orders: dates written out, and whether the text is none."""
    d = sc.parse_mixed_date(F.col("raw"))
    return _raw(spark, sf).select("o_orderkey", "raw", d.cast("string").alias("d"), d.isNull().alias("failed"))


@query(f"WITH {RAW} SELECT o_orderkey, raw, CASE WHEN o_orderkey % 5 < 4 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d FROM raw")
def parse_mixed_date_all(spark, sf):
    """All orders, dates written out: numbers are milliseconds of any length, strings that are no date come out as null."""
    return _raw(spark, sf).select("o_orderkey", "raw", sc.parse_mixed_date(F.col("raw")).cast("string").alias("d"))


@query("SELECT CAST(o_custkey % 7 AS BIGINT) AS chunk, count(*) FILTER (o_orderkey % 5 < 4) AS loaded, count(*) FILTER (o_orderkey % 5 = 4) AS failed FROM orders GROUP BY 1")
def load_report(spark, sf):
    r = _raw(spark, sf).withColumn("chunk", F.col("o_custkey") % 7)
    good, bad = upsert.split_bad(r, F.col("raw") != "not-a-date")
    return upsert.load_report(good, bad, "chunk")


@query("SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 100) + 1 AS INT) AS chunk_index FROM customer")
def chunk_assets(spark, sf):
    return upsert.chunked(_t(spark, sf, "customer").select("c_custkey"), 100, ["c_custkey"])


@query("WITH n AS (SELECT source, doc_id, 'news ' || doc_id AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) SELECT source, count(*) AS articles, string_agg(title, '; ' ORDER BY n) FILTER (n <= 3) AS titles, greatest(count(*) - 3, 0) AS more FROM n GROUP BY source")
def news_digest(spark, sf):
    d = _t(spark, sf, "documents").select("source", "doc_id", F.concat(F.lit("news "), F.col("doc_id").cast("string")).alias("title"), (-F.col("doc_id")).alias("late"))
    return upsert.digest(d, "source", ["late"])


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9&]+', ' ', 'g')) AS raw, trim(regexp_replace(replace(lower(p_name || ' & ' || p_type), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS label, replace(trim(regexp_replace(replace(lower(p_name || ' & ' || p_type), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' ', '_') AS item FROM part")
def normalize_labels(spark, sf):
    x = F.concat("p_name", F.lit(" & "), "p_type")
    return _t(spark, sf, "part").select("p_partkey", F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9&]+", " ")).alias("raw"), sc.normalize_label(x).alias("label"), sc.item_id(x).alias("item"))


@query("SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_size % 3 = 1 THEN round(p_partkey % 50 * 100.0::DOUBLE / p_size, 6) ELSE 0 END AS percent FROM part")
def rate_to_percent(spark, sf):
    s, k = F.col("p_size"), F.col("p_partkey") % 50
    rate = F.when(s % 3 == 0, s.cast("string")).when(s % 3 == 1, F.concat(s.cast("string"), F.lit(":"), k.cast("string"))).otherwise(" ")
    return rounded(_t(spark, sf, "part").select("p_partkey", "p_size", sc.rate_to_percent(rate).alias("percent")))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text, nullif(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/@]*@)?([^/?#]+)', 1), '') AS host FROM pages")
def page_texts(spark, sf):
    return _t(spark, sf, "pages").select("page_id", sc.strip_html(F.col("html")).alias("text"), sc.source_host(F.col("url")).alias("host"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS url FROM pages) SELECT DISTINCT page_id, url FROM a WHERE url <> ''""")
def page_links(spark, sf):
    return statements.anchors(_t(spark, sf, "pages"), "page_id").select("page_id", "url")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS DATE) AS fiscal_date FROM orders")
def quarter_end(spark, sf):
    label = F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    y, q = sc.period_parts(F.col("label"))
    return _t(spark, sf, "orders").select("o_orderkey", label.alias("label")).select("o_orderkey", y.alias("y"), q.alias("q"), sc.quarter_end(y, q).alias("fiscal_date"))


BAL = """b AS (SELECT c_custkey, c_acctbal AS ta, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal / 4 END AS te, CASE WHEN c_custkey % 3 = 0 THEN 7.0 END AS tl, CASE WHEN c_custkey % 5 < 3 THEN 10.0 END AS sl, CASE WHEN c_custkey % 5 > 1 THEN 20.0 END AS ll, CASE WHEN c_custkey % 7 < 4 THEN 30.0 END AS sa, CASE WHEN c_custkey % 7 > 2 THEN 40.0 END AS la FROM customer),
f AS (SELECT *, coalesce(tl, sl + ll, ta - te) AS l FROM b)"""
BAL_OUT = "c_custkey, ta AS total_assets, te AS total_equity, l AS total_liabilities, coalesce(sa, ta - la) AS short_term_assets, coalesce(la, ta - sa) AS long_term_assets, coalesce(sl, l - ll) AS short_term_liabilities, coalesce(ll, l - sl) AS long_term_liabilities"


def _balance(spark, sf):
    k = F.col("c_custkey")
    some = lambda test, v: F.when(test, F.lit(v))
    return _t(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("total_assets"), F.when(k % 2 == 0, F.col("c_acctbal") / 4).alias("total_equity"), some(k % 3 == 0, 7.0).alias("total_liabilities"), some(k % 5 < 3, 10.0).alias("short_term_liabilities"),
        some(k % 5 > 1, 20.0).alias("long_term_liabilities"), some(k % 7 < 4, 30.0).alias("short_term_assets"), some(k % 7 > 2, 40.0).alias("long_term_assets"), F.lit(None).cast("double").alias("cash_and_equivalents"),
    )


@query(f"WITH {BAL} SELECT {BAL_OUT} FROM f")
def balance_identities(spark, sf):
    return statements.balance_identities(_balance(spark, sf)).drop("cash_and_equivalents")


@query(f"WITH {BAL} SELECT {BAL_OUT}, NULL::DOUBLE AS cash_and_equivalents, 2024 AS year, CAST(c_custkey % 4 + 1 AS INT) AS quarter, last_day(make_date(2024, (c_custkey % 4 + 1) * 3, 1)) AS fiscal_date FROM f WHERE c_custkey % 9 <> 0")
def normalize_balance(spark, sf):
    """Balance sheets with labels of several languages and spellings; a quarter of 0 drops the row."""
    b = _balance(spark, sf)
    named = b.select("c_custkey", F.lit(2024).alias("yearReport"), F.when(F.col("c_custkey") % 9 == 0, 0).otherwise(F.col("c_custkey") % 4 + 1).alias("lengthReport"), F.col("total_assets").alias("Tổng tài sản"), F.col("total_equity").alias("Owner's Equity"), F.when(F.col("c_custkey") % 2 == 0, F.col("total_liabilities")).alias("LIABILITIES"), F.when(F.col("c_custkey") % 2 == 1, F.col("total_liabilities")).alias("Total  liabilities"), F.col("short_term_liabilities").alias("Current liabilities"), F.col("long_term_liabilities").cast("string").alias("Nợ dài hạn"), F.col("short_term_assets").alias("CURRENT ASSETS"), F.col("long_term_assets").alias("Non-current Assets"))
    return statements.normalize_balance(named, ["c_custkey"])


_NULLS = ", ".join(f"NULL::DOUBLE AS {m}" for m in statements.INCOME if m not in ("revenue", "selling_expenses", "ebitda"))


@query(f"SELECT p_partkey, p_retailprice AS revenue, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 5.0 END AS selling_expenses, CASE WHEN p_size % 4 <> 3 THEN CAST(p_size AS DOUBLE) END AS ebitda, {_NULLS}, 2023 AS year, CAST(p_partkey % 4 + 1 AS INT) AS quarter, last_day(make_date(2023, (p_partkey % 4 + 1) * 3, 1)) AS fiscal_date FROM part")
def normalize_income(spark, sf):
    size = F.col("p_size")
    p = _t(spark, sf, "part").select("p_partkey", F.lit(2023).alias("yearReport"), (F.col("p_partkey") % 4 + 1).alias("lengthReport"), F.col("p_retailprice").alias("Net Sales"), F.when(size % 2 == 0, size).alias("Selling Expenses"), F.lit("5").alias("Selling Expense"), F.when(size % 4 == 3, "n/a").otherwise(size.cast("string")).alias("EBITDA"))
    return statements.normalize_income(p, ["p_partkey"])


RATIO_SQL = """p AS (SELECT p_partkey % 50 AS sym, p_partkey, p_retailprice AS r, CASE WHEN p_partkey % 50 < 20 AND p_size % 3 = 0 THEN p_size / 100.0::DOUBLE END AS om, p_size * 10.0 AS o, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS ar, p_size * 1.5::DOUBLE AS cf, p_size / 7.0 AS pe FROM part)
SELECT sym, p_partkey, CASE WHEN p_partkey % 5 = 0 THEN DATE '2022-01-01' ELSE last_day(make_date(2022, (p_partkey % 5) * 3, 1)) END AS fiscal_date, round(pe, 6) AS pe_ratio, round(CASE WHEN count(om) OVER (PARTITION BY sym) = 0 THEN o / nullif(r, 0) ELSE om END, 6) AS operating_margin, round(r / nullif(ar, 0), 6) AS receivable_turnover, cf AS free_cash_flow FROM p"""


@query("WITH " + RATIO_SQL)
def normalize_ratios(spark, sf):
    size, k = F.col("p_size"), F.col("p_partkey")
    p = _t(spark, sf, "part").select((k % 50 + k * 0).alias("sym"), F.lit(2022).alias("yearReport"), (k % 5).alias("lengthReport"), F.col("p_retailprice").alias("Revenue (Bn. VND)"), F.when((k % 50 < 20) & (size % 3 == 0), size / 100.0).alias("Operating Margin"), (size * 10.0).alias("Operating Profit/Loss"), F.when(size % 4 == 0, 0).otherwise(size).alias("Accounts Receivables"), (size * 1.5).alias("Net cash inflows/outflows from operating activities"), (size / 7.0).alias("P/E"), k.alias("eps"))
    out = statements.normalize_ratios(p, "sym")
    return rounded(out.select("sym", F.col("eps").cast("long").alias("p_partkey"), "fiscal_date", "pe_ratio", "operating_margin", "receivable_turnover", "free_cash_flow"))


@query("SELECT p_partkey, p_type AS label FROM part WHERE NOT (contains(lower(p_name || ' ' || p_type), 'brass') OR list_contains(string_split(trim(regexp_replace(lower('i' || p_partkey || ' ' || p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' '), 'tin'))")
def unmapped_labels(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("item_id"), F.col("p_name").alias("item"), F.col("p_type").alias("item_en"))
    return statements.unmapped_labels(p, ["brass", "tin"]).select("p_partkey", "label")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'NH' WHEN c_mktsegment = 'MACHINERY' THEN 'CK' ELSE 'CT' END AS company_type, CASE WHEN c_custkey % 4 = 0 THEN 'index' WHEN c_custkey % 4 = 1 THEN 'derivative' ELSE 'stock' END AS asset_type, CASE WHEN c_custkey % 2 = 0 THEN substr(c_name, 1, 14) ELSE 'site' || c_custkey END AS label, contains('building machinery', lower(c_mktsegment)) AS fits FROM customer")
def asset_labels(spark, sf):
    """Report forms, quotation, labels and sector names of customers that stand in for companies."""
    k = F.col("c_custkey")
    industry = F.when(F.col("c_mktsegment") == "BUILDING", "Ngân hàng thương mại").when(F.col("c_mktsegment") == "MACHINERY", "Môi giới chứng khoán")
    symbol = F.when(k % 4 == 0, "vn30 ").when(k % 4 == 1, "VN30F1M").when(k % 4 == 2, "abc").otherwise("LONGER")
    label = sc.entity_label(F.when(k % 2 == 0, F.col("c_name")), F.concat(F.lit("https://x/site"), k.cast("string"), F.lit(".vn.com")))
    return _t(spark, sf, "customer").select("c_custkey", sc.company_type(industry).alias("company_type"), sc.asset_type(symbol).alias("asset_type"), label.alias("label"), sc.sector_fits(F.lit("Building Machinery"), F.col("c_mktsegment")).alias("fits"))


@query(r"""WITH l AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS l FROM documents), x AS (SELECT doc_id, list_transform(l, lambda y: trim(y)) AS l FROM l),
b AS (SELECT doc_id, l[coalesce(list_min(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN regexp_matches(l[i], '^[A-M].*[.]$') THEN i END), lambda i: i IS NOT NULL)), 0) + 1:] AS l FROM x), c AS (SELECT doc_id, l[:coalesce(list_min(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN regexp_matches(lower(l[i]), 'zzz|qqq') THEN i END), lambda i: i IS NOT NULL)) - 1, len(l))] AS l FROM b),
d AS (SELECT doc_id, list_filter(l, lambda y: NOT regexp_matches(y, '^[0-9 ]*$')) AS l FROM c)
SELECT doc_id, regexp_replace(array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = 1 OR l[i] <> l[i - 1] THEN l[i] END), lambda y: y IS NOT NULL), chr(10)), '^\s+|\s+$', '', 'g') AS body FROM d""")
def clean_bodies(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", sc.clean_body(F.coalesce("text", F.lit("")), r"^[A-M].*[.]$", ["zzz", "qqq"], r"^[0-9 ]*$").alias("body"))


@query("WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS trading_date, CAST(o_totalprice AS DOUBLE) AS p FROM orders) SELECT o_custkey, trading_date, p AS open, p AS high, p AS low, p AS close, p * 2 AS volume FROM o")
def bars_from_arrays(spark, sf):
    """Each customer's orders as one payload of parallel arrays, and back."""
    o = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.unix_timestamp("o_orderdate").alias("t"), F.col("o_totalprice").alias("p"))).alias("x"))
    x = F.col("x")
    payload = o.select("o_custkey", F.to_json(F.struct(x["t"].alias("t"), x["p"].alias("o"), x["p"].alias("h"), x["p"].alias("l"), x["p"].alias("c"), F.transform(x["p"], lambda v: v * 2).alias("v"))).alias("payload"))
    return statements.bars_from_arrays(payload, "o_custkey", "payload")


def _statements(c):
    payload = c.select("c_custkey", F.concat(F.lit('{"Head":[{"YearPeriod":2024,"TermName":"Quarter 1"},{"YearPeriod":2024,"TermName":"Quarter 2"}],"Content":{"Balance":[{"Name":"x","NameEn":"account balance","Value1":"'), F.col("c_acctbal").cast("string"), F.lit('","Value2":"'), (F.col("c_acctbal") * 2).cast("string"), F.lit('"}]}}')).alias("payload"))
    return statements.periodic_statement(payload, "c_custkey", "payload")


@query("SELECT c_custkey, 'account balance' AS item, 2024 AS year, q AS quarter, CAST(last_day(make_date(2024, q * 3, 1)) AS DATE) AS fiscal_date, c_acctbal * q AS value FROM customer CROSS JOIN (SELECT unnest([1, 2]) AS q)")
def periodic_statements(spark, sf):
    return _statements(_t(spark, sf, "customer"))


@query("SELECT c_custkey, 'account balance' AS item, 2024 AS year, q AS quarter, CAST(last_day(make_date(2024, q * 3, 1)) AS DATE) AS fiscal_date, c_acctbal * q AS value FROM customer CROSS JOIN (SELECT unnest([1, 2]) AS q)")
def periodic_statements_all(spark, sf):
    """The statements of all customers."""
    return _statements(_t(spark, sf, "customer"))


@query("WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END AS rk FROM orders) SELECT o_custkey, o_orderkey, o_totalprice, ['first', 'second', 'third'][rk + 1] AS source_provider FROM o QUALIFY rk = min(rk) OVER (PARTITION BY o_custkey)")
def provider_fallback(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    pick = lambda c: o.where(c).drop("o_orderpriority")
    one, two = F.col("o_orderpriority").like("1%"), F.col("o_orderpriority").like("2%")
    return statements.provider_fallback([("first", pick(one)), ("second", pick(two)), ("third", pick(~one & ~two))], "o_custkey")


@query("WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 25 THEN p_size END AS margin FROM part) SELECT p_partkey, CAST(CASE WHEN count(margin) OVER (PARTITION BY p_partkey % 40) = 0 THEN -1 ELSE margin END AS INT) AS margin FROM p")
def derive_if_all_missing(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("k"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("margin"))
    return statements.derive_if_all_missing(p, "k", "margin", F.lit(-1)).select("p_partkey", F.col("margin").cast("int").alias("margin"))


BARS = "SELECT user_id, date_trunc('hour', ts) AS start, arg_min(value, ROW(ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, ROW(ts, value)) AS close, count(*) AS n FROM events GROUP BY 1, 2"


@query(BARS)
def intraday_bars(spark, sf):
    return streams.bars(_t(spark, sf, "events"), "ts", "user_id", "value")


@query(BARS)
def stream_ohlc_bars(spark, sf):
    """The same bars from a file stream: windows that change are upserted into a table in folders of a day, state ends with the watermark."""
    events, at = _t(spark, sf, "events"), shared.new(spark, "bars")
    ticks = streams.file_stream(spark, f"{sf}/events.parque?", events)
    table = stored.Table(f"{at}/table", ("user_id", "start"), ("n",), "date_format(start, 'yyyy-MM-dd')")
    streams.upsert_stream(streams.bars(ticks, "ts", "user_id", "value", late="2 days"), table, f"{at}/checkpoint", mode="update").awaitTermination()
    return table.read(spark)


def _loads(spark, at, rows, number, many):
    """Lets ``rows`` land as ``many`` loads, one after the other, and yields after each."""
    for i in range(many):
        rows.where(F.col(number) == i).drop(number).write.parquet(f"{at}/landed/{i}")
        yield i


@query("SELECT user_id, CAST(ts AS DATE) AS day, event_id % 3 AS load, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id % 3 DESC, event_id DESC, value DESC) = 1")
def stream_upsert_prices(spark, sf):
    """Three loads of daily values, one after the other: each takes the place of the one before where it has the key."""
    e, at = _t(spark, sf, "events"), shared.new(spark, "upserts")
    rows = e.select("user_id", F.to_date("ts").alias("day"), (F.col("event_id") % 3).alias("load"), "event_id", "value")
    table = stored.Table(f"{at}/table", ("user_id", "day"), ("event_id", "value"), "date_format(day, 'yyyy-MM-dd')")
    for _ in _loads(spark, at, rows.withColumn("number", F.col("load")), "number", 3):
        streams.upsert_stream(streams.file_stream(spark, f"{at}/landed/*", rows, None), table, f"{at}/checkpoint").awaitTermination()
    return table.read(spark)


@query("SELECT doc_id AS news_id, arg_min('load ' || (doc_id + k) % 3, (doc_id + k) % 3) AS title, max((doc_id + k) % 3) AS score FROM documents, (SELECT unnest([0, 1]) AS k) GROUP BY doc_id")
def stream_upsert_news(spark, sf):
    """Three loads of news, each document in two of them: the first gives the title, only the score follows the later one."""
    at = shared.new(spark, "news")
    load = F.explode(F.array(*((F.col("doc_id") + k) % 3 for k in (0, 1))))
    rows = _t(spark, sf, "documents").select("doc_id", load.alias("load")).select(F.col("doc_id").alias("news_id"), F.concat(F.lit("load "), F.col("load").cast("string")).alias("title"), F.col("load").alias("score"), F.col("load").alias("number"))
    table = stored.Table(f"{at}/table", ("news_id",), ("score",), "pmod(hash(news_id), 16)")
    for _ in _loads(spark, at, rows, "number", 3):
        streams.upsert_stream(streams.file_stream(spark, f"{at}/landed/*", rows.drop("number"), None), table, f"{at}/checkpoint", ["score"]).awaitTermination()
    return table.read(spark)


LATE = """WITH r AS (SELECT user_id, date_trunc('hour', ts) AS hour, value, event_id, event_id % 5 AS batch FROM events), t AS (SELECT batch, max(hour) AS top FROM r GROUP BY batch),
l AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 DAY AS edge FROM t)
SELECT user_id, hour, arg_max(value, ROW(event_id, value)) AS value, max(event_id) AS event_id FROM r JOIN l USING (batch) WHERE edge IS NULL OR hour > edge GROUP BY user_id, hour"""


@query(LATE)
def late_correction(spark, sf):
    """Hourly values that come in five loads, in no order: later versions correct those of the last ten days, older hours are dropped."""
    e, at = _t(spark, sf, "events"), shared.new(spark, "late")
    rows = e.select("user_id", F.date_trunc("hour", "ts").cast("timestamp").alias("hour"), "value", "event_id", (F.col("event_id") % 5).alias("number"))
    table = stored.Table(f"{at}/table", ("user_id", "hour"), ("event_id", "value"), "date_format(hour, 'yyyy-MM-dd')")
    for _ in _loads(spark, at, rows, "number", 5):
        ticks = streams.file_stream(spark, f"{at}/landed/*", rows.drop("number"), None)
        fixed = streams.corrections(ticks, "user_id", "hour", "value", "event_id", "10 days").drop("revised")
        streams.upsert_stream(fixed, table, f"{at}/checkpoint").awaitTermination()
    return table.read(spark)


@query(LATE)
def late_correction_batch(spark, sf):
    """The same from all rows at once."""
    e = _t(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp").alias("hour"), "value", "event_id", (F.col("event_id") % 5).alias("batch"))
    return streams.corrected(e, "user_id", "hour", "value", "event_id", "batch", "10 days")


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_dedup(spark, sf):
    events, at = _t(spark, sf, "events"), shared.new(spark, "stream")
    stream = streams.file_stream(spark, f"{sf}/events.parque?", events)
    streams.drain(streams.dedup(stream, ["event_id"], "ts", "60 days"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def event_type_summary(spark, sf):
    return _t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT n_nationkey, c_custkey, c_name, c_mktsegment AS sector, n_name AS nation, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS row_no FROM customer JOIN nation ON c_nationkey = n_nationkey")
def listing_tables(spark, sf):
    """The customers of each nation as a page with a table, whose nation spans all rows and whose names take two header rows, and back as rows."""
    c = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    row = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment")))
    p = c.groupBy("n_nationkey", "n_name").agg(row.alias("x"))
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    rows = F.transform("x", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.format_string('<td rowspan="%d">%s</td>', F.size("x"), F.col("n_name"))).otherwise(F.lit("")), cell(x["c_custkey"].cast("string")), cell(x["c_name"]), cell(x["c_mktsegment"]), F.lit("</tr>")))
    head = '<p>x</p><table class="w"><tr><th rowspan=2>Nation</th><th colspan=3>Company</th></tr><tr><th>Key<th>Name<th>GICS<br>Sector</tr>'
    pages = p.select("n_nationkey", F.concat(F.lit(head), F.array_join(rows, "\n"), F.lit("</table>")).alias("html"))
    got = html_tables.records(html_tables.html_tables(pages, "n_nationkey"), {"nation": "Nation", "c_custkey": "Company Key", "c_name": "Company Name", "sector": "Company GICS Sector"}, ("row_no",))
    return got.withColumn("c_custkey", F.col("c_custkey").cast("long")).withColumn("row_no", F.col("row_no").cast("long"))


@query("SELECT c_nationkey, c_mktsegment AS \"group\", row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey % 5, c_custkey) AS number, c_name AS name, CAST(c_acctbal AS VARCHAR) AS value FROM customer")
def merged_pages(spark, sf):
    """Five landed pages of each nation, of which every other one wraps its content, merged into groups in the order of the pages."""
    return payloads.merge_payload_pages(_pages(spark, sf), "c_nationkey", "page", "payload").select("c_nationkey", "group", F.col("number").cast("long").alias("number"), F.col("record")["Name"].alias("name"), F.col("record")["Value1"].alias("value"))


def _pages(spark, sf):
    c = _t(spark, sf, "customer").withColumn("page", F.col("c_custkey") % 5)
    record = F.create_map(F.lit("Name"), F.col("c_name"), F.lit("Value1"), F.col("c_acctbal").cast("string"))
    g = c.groupBy("c_nationkey", "page", "c_mktsegment").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", record.alias("r"))), lambda a, b: (a["c_custkey"] - b["c_custkey"]).cast("int")), lambda x: x["r"]).alias("records"))
    content = g.groupBy("c_nationkey", "page").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "records"))).alias("Content"))
    head = F.array(F.struct(F.lit(2024).alias("YearPeriod"), F.lit("Quarter 3").alias("TermName"))).alias("Head")
    body = F.struct(head, "Content")
    return content.select("c_nationkey", "page", F.when(F.col("page") % 2 == 0, F.to_json(F.struct(body.alias("data")))).otherwise(F.to_json(body)).alias("payload"))


@query("SELECT c_nationkey, c_name AS item, 2024 AS year, 3 AS quarter, DATE '2024-09-30' AS fiscal_date, c_acctbal AS value FROM customer")
def merged_statement(spark, sf):
    """The merged pages as one payload of each nation, read as a statement."""
    return statements.periodic_statement(payloads.merged_payload(_pages(spark, sf), "c_nationkey", "page", "payload"), "c_nationkey", "payload")


META = """m AS (SELECT p_partkey AS position, 'f' || p_partkey % 60 AS field_name, CASE WHEN p_partkey % 5 = 0 THEN ' Ratio' ELSE 'income' END AS type, CASE p_partkey % 3 WHEN 0 THEN 'CT' WHEN 1 THEN 'NH' ELSE 'CK' END AS code, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS en_name, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_type END AS name, p_size AS ord FROM part),
c AS (SELECT c_custkey, c_name AS symbol, CASE WHEN c_mktsegment = 'BUILDING' THEN 'NH' WHEN c_mktsegment = 'MACHINERY' THEN 'CK' ELSE 'CT' END AS kind, c_acctbal FROM customer)"""


@query(f"""WITH {META}, k AS (SELECT DISTINCT kind FROM c), a AS (SELECT kind, m.* FROM m JOIN k ON code = 'CT' OR code = kind WHERE lower(trim(type)) = 'ratio' QUALIFY row_number() OVER (PARTITION BY kind, field_name ORDER BY position) = 1),
f AS (SELECT kind, field_name, coalesce(nullif(en_name, ''), nullif(name, ''), field_name) AS label, row_number() OVER (PARTITION BY kind ORDER BY ord, field_name) AS place FROM a),
s AS (SELECT symbol, kind, 'f' || i AS field_name, CASE WHEN i % 7 <> 0 THEN c_acctbal + i END AS value FROM c, (SELECT unnest(range(0, 60, 5)) AS i) WHERE (c_custkey + i) % 4 <> 0)
SELECT symbol, 2024 AS year, 4 AS quarter, CAST(place AS INT) AS place, field_name, label, value FROM s JOIN f USING (kind, field_name)""")
def statement_by_metadata(spark, sf):
    k = F.col("p_partkey")
    code = F.when(k % 3 == 0, "CT").when(k % 3 == 1, "NH").otherwise("CK")
    meta = _t(spark, sf, "part").select(k.alias("position"), F.concat(F.lit("f"), (k % 60).cast("string")).alias("field_name"), F.when(k % 5 == 0, " Ratio").otherwise("income").alias("type"), code.alias("com_type_code"), F.when(k % 4 == 0, "").otherwise(F.col("p_name")).alias("en_name"), F.when(k % 8 != 0, F.col("p_type")).alias("name"), F.col("p_size").alias("order"))
    c, seg = _t(spark, sf, "customer"), F.col("c_mktsegment")
    companies = c.select(F.col("c_name").alias("symbol"), F.when(seg == "BUILDING", "NH").when(seg == "MACHINERY", "CK").otherwise("CT").alias("company_type"))
    i = F.filter(F.sequence(F.lit(0), F.lit(55), F.lit(5)), lambda i: (F.col("c_custkey") + i) % 4 != 0)
    fields = F.map_from_entries(F.transform(i, lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")), F.when(i % 7 != 0, F.col("c_acctbal") + i))))
    rows = c.select(F.col("c_name").alias("symbol"), F.lit(2024).alias("year"), F.lit(4).alias("quarter"), fields.alias("fields"))
    return payloads.statement_by_metadata(rows, companies, meta, ["RATIO"])


@query(f"""WITH {PRICES}, q AS (SELECT *, 'first' AS source_provider FROM prices WHERE symbol NOT IN ('S1', 'S2') UNION ALL SELECT symbol, trading_date, open * 2, high * 2, low * 2, close * 2, volume, 'second' FROM prices WHERE symbol IN ('S0', 'S1', 'S3')),
p AS (SELECT * FROM q WHERE symbol IN ('S0', 'S1', 'S2', 'S4') AND trading_date BETWEEN DATE '1995-03-10' AND DATE '1996-02-20' QUALIFY source_provider = min(source_provider) OVER (PARTITION BY symbol))
SELECT symbol, trading_date, round(close, 6) AS close, volume, source_provider, round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY trading_date)), 6) + 0.0 AS log_ret FROM p""")
def read_prices_range(spark, sf):
    """Four symbols and a range of days from two stored sources, of which the first that has a symbol counts."""
    p, made = tables.prices(spark, sf), []
    doubled = p.where("symbol IN ('S0', 'S1', 'S3')").select("symbol", "trading_date", *((F.col(c) * 2).alias(c) for c in ("open", "high", "low", "close")), "volume")
    for name, rows in (("first", p.where("symbol NOT IN ('S1', 'S2')")), ("second", doubled)):
        made.append((name, ranges.price_table(shared.new(spark, name))))
        stored.create(made[-1][1], rows)
    got = ranges.read_prices(spark, made, ["S0", "S1", "S2", "S4"], dt.date(1995, 3, 10), dt.date(1996, 2, 20))
    return rounded(got.select("symbol", "trading_date", "close", "volume", "source_provider", "log_ret"))


@query("""WITH n AS (SELECT doc_id AS news_id, doc_id % 7 AS asset_id, CASE WHEN doc_id % 50 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS TIMESTAMP) END AS publish_date, trim('news ' || doc_id || ' ' || coalesce(text, ''), ' ') AS text FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY publish_date DESC NULLS LAST, news_id DESC) AS k FROM n WHERE asset_id IN (1, 2, 3)) SELECT news_id, asset_id, publish_date, md5(text) AS text FROM o WHERE k BETWEEN 21 AND 40""")
def read_news_page(spark, sf):
    """The second page of twenty of three assets' news, after the last row of the first."""
    d = _t(spark, sf, "documents")
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("timestamp")
    news = d.select(F.col("doc_id").alias("news_id"), (F.col("doc_id") % 7).alias("asset_id"), F.when(F.col("doc_id") % 50 != 0, date).alias("publish_date"), F.concat(F.lit("news "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"))
    page = ranges.read_news(news, [1, 2, 3], limit=20).select("publish_date", "news_id").collect()
    return ranges.read_news(news, [1, 2, 3], tuple(page[-1]) if page else None, 20).select("news_id", "asset_id", "publish_date", F.md5("text").alias("text"))
