"""Whole loads, put together from the operators: prices, news, assets, snapshots and sentiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sf
from . import asof, text, upsert


def daily_price_load(prices: DataFrame, rows: DataFrame, as_of: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Prices with the rows of the last ``days`` days, and a report of the load.

    rows: symbol, asset_id, trading_date (text, of any known form), close, volume. Rows without a date or an asset are failures;
    the report has the rows loaded, failed and left out of the window.
    """
    r = rows.withColumn("d", sf.parse_mixed_date(F.col("trading_date").cast("string")))
    good, bad = upsert.split_bad(r, F.col("d").isNotNull() & F.col("asset_id").isNotNull())
    inside = good.where((F.col("d") > F.date_sub(as_of, days)) & (F.col("d") <= as_of))
    batch = inside.select("asset_id", F.col("d").alias("trading_date"), sf.clean_decimal(F.col("close")).alias("close"), sf.clean_decimal(F.col("volume")).alias("volume"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    counts = reduce(lambda a, b: a.join(F.broadcast(b)), (count(inside, "loaded"), count(bad, "failed"), count(good, "dated")))  # one row each
    report = counts.select("loaded", "failed", (F.col("dated") - F.col("loaded")).alias("outside"), F.when(F.col("failed") == 0, "none").when(F.col("loaded") == 0, "fatal").otherwise("partial").alias("alert"))
    return upsert.upsert(prices, batch, ["asset_id", "trading_date"], ["close"]), report


def history_refresh(prices: DataFrame, history: DataFrame, events: DataFrame, assets: DataFrame, loads: DataFrame, as_of: Column, lookback: int = 7, years: int = 6) -> DataFrame:
    """Prices with the last ``years`` years of history of the assets whose events ask for it, see ``asof.refresh_candidates``."""
    asked = asof.refresh_candidates(events, assets, loads, as_of, lookback)
    batch = history.join(asked.select("asset_id"), "asset_id", "left_semi").where(F.col("trading_date") > F.add_months(as_of, -12 * years))
    return upsert.upsert(prices, batch, ["asset_id", "trading_date"], ["close"])


def news_ingest(news: DataFrame, articles: DataFrame, assets: DataFrame, scores: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """News with the new articles (news_id, title, body, publish_date), each with the first asset that it names and its score (0
    without one), and the ids that have no vector yet. Of news that is there only score and asset change."""
    a = articles.withColumn("text", sf.derived_text(F.col("title"), F.col("body")))
    named = text.word_mentions(a.select("news_id", "text"), "news_id", assets).join(assets.select("symbol", "asset_id"), "symbol")
    first = named.groupBy("news_id").agg(F.min_by("asset_id", "symbol").alias("asset_id"))
    batch = a.join(first, "news_id", "left").join(scores, "news_id", "left")
    batch = batch.select("news_id", "title", "publish_date", "asset_id", sf.clamp(F.coalesce("score", F.lit(0.0))).alias("score"))
    out = upsert.upsert_partial(news, batch, ["news_id"], ["asset_id", "score"], ["publish_date"])
    return out, asof.unmatched(out.select("news_id"), vectors, ["news_id"])


def stock_snapshot(prices: DataFrame, ratios: DataFrame, assets: DataFrame) -> DataFrame:
    """Each asset's latest close and volume, its change over twenty rows in percent, and the ratios known at that date; the price
    to earnings is the reported one, else thousand times the close by the earnings, else 0."""
    w = Window.partitionBy("asset_id").orderBy("trading_date")
    back = prices.withColumn("before", F.lag("close", 20).over(w))
    last = back.groupBy("asset_id").agg(F.max_by(F.struct("trading_date", "close", "volume", "before"), "trading_date").alias("x")).select("asset_id", "x.*")
    known = asof.asof_join(last, ratios.withColumnRenamed("fiscal_date", "trading_date"), "asset_id", "trading_date", ["pe_ratio", "eps", "roe"])
    zero, eps = F.lit(0.0), F.coalesce("eps", F.lit(0.0))
    change = F.when(F.coalesce("before", zero) == 0, 0.0).otherwise((F.col("close") - F.col("before")) / F.nullif(F.col("before"), zero) * 100)
    pe = F.coalesce("pe_ratio", F.when(eps == 0, 0.0).otherwise(F.col("close") * 1000 / F.nullif(eps, zero)), zero)
    j = known.join(assets, "asset_id")
    return j.select("asset_id", "symbol", "trading_date", "close", "volume", change.alias("return_1m"), F.coalesce("sector", F.lit("N/A")).alias("sector"), pe.alias("pe_ratio"), F.coalesce("roe", zero).alias("roe"), eps.alias("eps"))


def assets_dimension(listing: DataFrame, industries: DataFrame, market: str = "VN", currency: str = "VND", source: str = "listing") -> DataFrame:
    """Assets of a listing (symbol, organ_name, exchange, type, product_grp_id) that are not delisted, with class, industry and metadata.

    industries: symbol, icb_name2, icb_name3 and icb_code, or icb_code1 to 4 of which the finest counts.
    """
    codes = [c for c in ("icb_code", "icb_code4", "icb_code3", "icb_code2", "icb_code1") if c in industries.columns]
    code = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in codes)) if codes else F.lit(None).cast("string")
    i = industries.select("symbol", "icb_name2", "icb_name3", code.alias("industry_code"))
    a = listing.where(F.upper(F.coalesce("exchange", F.lit(""))) != "DELISTED").join(i, "symbol", "left")
    kind, unknown = sf.asset_class(F.col("type"), F.col("symbol"), F.col("product_grp_id"), F.col("organ_name")), F.lit("Unknown")
    name = F.coalesce("organ_name", F.lit(""))
    return a.select("symbol", name.alias("name_en"), name.alias("name_local"), kind.alias("asset_class"), F.lit(market).alias("market"), F.lit(currency).alias("currency"), F.coalesce("exchange", F.lit("HOSE")).alias("exchange"), F.coalesce("icb_name2", unknown).alias("sector"), F.coalesce("icb_name3", unknown).alias("industry"), "industry_code", sf.metadata_json(source_api=F.lit(source), symbol_type=F.coalesce("type", F.lit("STOCK"))).alias("metadata"))


def upsert_assets(target: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Assets by symbol, market and class; a market that is null is a key like any other, so one rule serves both cases."""
    return upsert.upsert(target, batch, ["symbol", "market", "asset_class"], order)


def scored_events(events: DataFrame, positive: list[str], negative: list[str], dividend: str) -> DataFrame:
    """Events (exright_date, public_date, event_title, event_list_name) with their date and sentiment; dividends are at 0.8."""
    score = F.when(F.contains(F.coalesce("event_list_name", F.lit("")), F.lit(dividend)), 0.8).otherwise(text.lexicon_sentiment(F.coalesce("event_title", F.lit("")), positive, negative))
    return events.withColumn("event_date", sf.event_date(F.col("exright_date"), F.col("public_date"))).withColumn("sentiment", score)


def event_summary(scored: DataFrame) -> DataFrame:
    """Events and their mean sentiment by type."""
    return scored.where("event_list_name IS NOT NULL").groupBy("event_list_name").agg(F.count("*").alias("events"), F.avg("sentiment").alias("avg_sentiment"))


def recent_events(scored: DataFrame, key: str, order: str, since: str = "2020-01-01", k: int = 20) -> DataFrame:
    """The last ``k`` events of each key since a date."""
    return text.top_k_per_group(scored.where(F.col("event_date") >= since), key, [F.desc("event_date"), F.desc(order)], k)


def symbol_basket(listed: str, baskets: dict[str, list[str]]) -> list[str]:
    """Symbols of a named basket, or of a list with commas; trimmed, in capitals."""
    asked = [x.strip().upper() for x in listed.split(",") if x.strip()]
    return baskets.get(asked[0], asked) if len(asked) == 1 else asked

