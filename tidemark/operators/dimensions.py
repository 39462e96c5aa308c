"""Asset dimensions of markets without a listing of their own: constituents, coins, metals, and all of them in one frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc

#: Columns of every dimension, in their order.
COLUMNS = ("symbol", "name_en", "name_local", "asset_class", "market", "currency", "exchange", "sector", "industry", "industry_code", "logo_url", "description", "metadata", "source")

#: Coins that follow a currency.
STABLECOINS = ["USDT", "USDC", "DAI", "BUSD", "TUSD", "USDD", "FRAX", "USDP", "PYUSD"]

#: Symbol, names, quoted contract and exchange of the metals.
METALS = [("XAU", "Gold (XAU/USD)", "Gold", "GC=F", "COMEX"), ("XAG", "Silver (XAG/USD)", "Silver", "SI=F", "COMEX")]


def conformed(df: DataFrame, **constants: str | None) -> DataFrame:
    """``df`` with exactly ``COLUMNS``: its own, else the constant of that name, else null; all are strings."""
    value = lambda c: F.col(c) if c in df.columns else F.lit(constants.get(c))
    return df.select(*(value(c).cast("string").alias(c) for c in COLUMNS))


def constituents(listed: DataFrame, market: str = "US", currency: str = "USD", exchange: str = "NASDAQ", source: str = "constituents") -> DataFrame:
    """Stocks of an index's table of constituents: symbol, name_en, exchange, sector, industry and metadata (JSON).

    Rows are kept as they are, repeated symbols too. Missing names are empty, a missing exchange is the market's main one, a missing
    sector or industry is Unknown.
    """
    filled = {"name_en": "", "exchange": exchange, "sector": "Unknown", "industry": "Unknown"}
    d = listed.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in filled.items()})
    return conformed(d, name_local="", asset_class="STOCK", market=market, currency=currency, logo_url="", description="", source=source)


def coins(listed: DataFrame, order: str = "position", source: str = "coins") -> DataFrame:
    """Coins of a ranked list (id, symbol, name, image, market_cap_rank and a place ``order``), one of each symbol in capitals.

    Of coins with one symbol the first by ``order`` counts, of those in one place the one with the smallest id; coins without a symbol go.
    The metadata says whether the coin follows a currency.
    """
    d = listed.withColumn("symbol", F.upper("symbol")).where("symbol IS NOT NULL")
    first = F.struct(F.col(order).isNull().alias("none"), order, F.col("id").isNull().alias("nameless"), "id", "name", "image", "market_cap_rank")
    d = d.groupBy("symbol").agg(F.min(first).alias("x")).select("symbol", "x.*")
    stable = F.when(F.col("symbol").isin(STABLECOINS), "1").otherwise("0")
    rank = F.coalesce(F.col("market_cap_rank").cast("string"), F.lit("0"))
    meta = sc.metadata_json(coin_id=F.col("id"), chain=F.lit(""), is_stablecoin=stable, market_cap_rank=rank)
    d = d.select("symbol", F.coalesce("name", F.lit("")).alias("name_en"), F.coalesce("image", F.lit("")).alias("logo_url"), meta.alias("metadata"))
    return conformed(d, name_local="", asset_class="CRYPTO", market="", currency="USD", exchange="", sector="Cryptocurrency", industry="", description="", source=source)


def metals(quotes: DataFrame, source: str = "quotes") -> DataFrame:
    """The metals, with the name and exchange of the provider's quote (source_symbol, long_name, exchange) where there is one.

    Of several quotes of a contract the smallest by name and exchange counts; blank names and exchanges count as missing.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    seed = quotes.sparkSession.createDataFrame(METALS, "symbol string, name_en string, name_local string, source_symbol string, place string")
    q = quotes.where(F.col("source_symbol").isin([m[3] for m in METALS])).groupBy("source_symbol").agg(F.min(blank("long_name")).alias("long_name"), F.min(blank("exchange")).alias("exchange"))
    d = seed.join(q, "source_symbol", "left")
    meta = sc.metadata_json(source_api=F.lit(source), source_symbol=F.col("source_symbol"), provider_symbol=F.col("source_symbol"), commodity_type=F.lit("precious_metal"), unit=F.lit("troy_ounce"), quote_pair=F.concat("symbol", F.lit("/USD")))
    d = d.select("symbol", "name_en", "name_local", F.coalesce("exchange", "place").alias("exchange"), F.coalesce("long_name", "name_en").alias("description"), meta.alias("metadata"))
    return conformed(d, asset_class="COMMODITY", market="", currency="USD", sector="Precious Metals", industry="Commodity", logo_url="", source=source)


def all_assets(*frames: DataFrame) -> DataFrame:
    """Dimensions one under another; columns that a frame lacks are empty in it."""
    return reduce(DataFrame.unionByName, (conformed(f, logo_url="", description="", source="listing") for f in frames))


def read_assets(assets: DataFrame, asset_class: str | None = "STOCK", after: str | None = None, limit: int | None = None) -> DataFrame:
    """Active assets of a class (all with None), with missing names and industries empty and a missing sector Unknown.

    A page is ``limit`` rows by id after the id ``after``: each page starts where the last one ended, so that no page skips rows or
    reads those before it in order. Without ``limit`` nothing is sorted.
    """
    d = assets.where("status = 'active'")
    d = d.where(F.col("asset_class") == asset_class) if asset_class else d
    d = d.where(F.col("id") > after) if after is not None else d
    filled = {"name_en": "", "name_local": "", "sector": "Unknown", "industry": ""}
    d = d.select("id", "symbol", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in filled.items()), "asset_class", "market", "status")
    return d.orderBy("id").limit(limit) if limit is not None else d


def active_tickers(assets: DataFrame, market: str = "VN") -> DataFrame:
    """symbol (trimmed, in capitals) and asset_id of a market's active stocks, one row a symbol.

    Assets whose metadata name a symbol type other than STOCK go. Of several assets of one symbol the first by the symbol as it is
    written, then by id, counts; an asset without id has the id ``fallback``. Metadata that are not JSON name no type.
    """
    kind = F.upper(F.trim(F.coalesce(F.get_json_object("metadata", "$.symbol_type"), F.lit(""))))
    d = assets.where((F.col("asset_class") == "STOCK") & (F.col("market") == market) & (F.col("status") == "active") & kind.isin("", "STOCK"))
    d = d.withColumn("ticker", sc.ticker(F.col("symbol"))).where("ticker IS NOT NULL")
    first = F.struct("symbol", F.col("id").isNull().alias("none"), F.col("id").cast("string").alias("id"))
    return d.groupBy("ticker").agg(F.min(first).alias("x")).select(F.col("ticker").alias("symbol"), F.coalesce("x.id", F.lit("fallback")).alias("asset_id"))


#: Indices whose provider writes them in another way.
INDEX_ALIASES = {"VNINDEX": "VNINDEX", "VN30": "VN30", "HNXINDEX": "HNXIndex", "UPCOMINDEX": "HNXUpcomIndex"}


def index_history(bars: DataFrame, asked: list[str], start: Column, end: Column, aliases: dict[str, str] = INDEX_ALIASES, source: str = "index") -> DataFrame:
    """Bars of the asked indices between two dates, under the names that were asked for.

    ``bars`` has symbol (as the provider writes it), trading_date and some of open, high, low, close, volume; columns that it lacks are 0,
    a missing close or volume is 0, volumes are whole. An index that is asked for twice, or under two names, comes under each.
    """
    names = bars.sparkSession.createDataFrame([(s, aliases.get(s.upper(), s)) for s in dict.fromkeys(asked)], "ticker string, symbol string")
    day = sc.parse_mixed_date(F.col("trading_date").cast("string")) if dict(bars.dtypes)["trading_date"] == "string" else F.to_date("trading_date")
    known = [r for r in ("open", "high", "low") if r in bars.columns]
    close = sc.clean_decimal(F.col("close")) if "close" in bars.columns else F.lit(0.0)
    volume = F.coalesce(F.col("volume").try_cast("double").cast("long"), F.lit(0).cast("long")) if "volume" in bars.columns else F.lit(0).cast("long")
    b = bars.where(F.col("symbol").isin([aliases.get(s.upper(), s) for s in asked])).withColumn("trading_date", day).where(F.col("trading_date").between(start, end))
    j = b.join(F.broadcast(names), "symbol")  # the list that the caller wrote
    return j.select("ticker", "trading_date", *(F.col(c).cast("double").alias(c) if c in known else F.lit(0.0).alias(c) for c in ("open", "high", "low")), close.alias("close"), volume.alias("volume"), F.lit(source).alias("source"))
