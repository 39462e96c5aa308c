"""Provider payloads to tables: bars, statements, events, articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sf


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly these columns with these types: missing ones null, others dropped, values that don't cast null."""
    return df.select(*((F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()))


def coalesce_aliases(df: DataFrame, aliases: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Canonical columns from differently labelled ones: the first value of a row in the order of the aliases."""
    own = {}
    for c in df.columns:
        key = "".join(x for x in c.lower() if x.isalnum())
        own.setdefault(key, []).append(c)
    pick = lambda names: [F.col(f"`{c}`") for n in names for c in own.get("".join(x for x in n.lower() if x.isalnum()), [])]
    return df.select(*keep, *((F.coalesce(*p) if (p := pick(names)) else F.lit(None).cast("double")).alias(c) for c, names in aliases.items()))


def bars_from_arrays(payload: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of a JSON payload with arrays t, o, h, l, c, v; t is epoch seconds; null prices become 0."""
    p = payload.select(key, F.from_json(column, "t array<bigint>, o array<double>, h array<double>, l array<double>, c array<double>, v array<double>").alias("p"))
    rows = p.select(key, F.inline(F.arrays_zip("p.t", "p.o", "p.h", "p.l", "p.c", "p.v")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(key, F.to_date(F.timestamp_seconds("t")).alias("trading_date"), *(zero(F.col(a)).alias(b) for a, b in zip("ohlcv", ("open", "high", "low", "close", "volume"))))


def periodic_statement(payload: DataFrame, key: str, column: str) -> DataFrame:
    """Long rows (item, year, quarter, fiscal_date, value) of a payload with Head and Content groups of Value1..n."""
    schema = "Head array<struct<YearPeriod:int,TermName:string>>, Content map<string,array<map<string,string>>>"
    p = payload.select(key, F.from_json(column, schema).alias("p"))
    heads = p.select(key, F.posexplode("p.Head").alias("at", "head"), "p")
    items = heads.select(key, "at", "head", F.explode(F.flatten(F.map_values("p.Content"))).alias("item"))
    quarter = F.nullif(F.regexp_extract("head.TermName", r"(\d)", 1), F.lit("")).try_cast("int")
    quarter = F.coalesce(quarter, F.lit(4))
    value = F.element_at("item", F.concat(F.lit("Value"), (F.col("at") + 1).cast("string"))).try_cast("double")
    return items.select(key, F.coalesce(F.element_at("item", F.lit("NameEn")), F.element_at("item", F.lit("Name"))).alias("item"), F.col("head.YearPeriod").alias("year"), quarter.alias("quarter"), sf.quarter_end(F.col("head.YearPeriod"), quarter).alias("fiscal_date"), value.alias("value"))


def pick_metrics(items: DataFrame, keys: list[str], aliases: DataFrame) -> DataFrame:
    """For every metric the item whose normalised label matches its alias of the lowest priority; one column each.

    aliases: metric, alias (normalised), priority; a small table that the caller writes down.
    """
    a = F.broadcast(aliases)
    j = items.withColumn("label", sf.normalize_label(F.col("item"))).join(a, F.contains(F.col("label"), F.col("alias")))
    best = j.groupBy(*keys, "metric").agg(F.min_by("value", F.struct("priority", "label")).alias("value"))
    return best.groupBy(*keys).pivot("metric", sorted(r.metric for r in aliases.select("metric").distinct().collect())).agg(F.first("value"))


def derive_if_all_missing(df: DataFrame, key: str, metric: str, derived: Column) -> DataFrame:
    """``derived`` for the metric of those keys of which no row has it."""
    have = F.count(metric).over(Window.partitionBy(key))
    return df.withColumn(metric, F.when(have == 0, derived).otherwise(F.col(metric)))


def balance_identities(df: DataFrame) -> DataFrame:
    """Missing liabilities and assets from the others: all liabilities of both terms, else assets less equity; each term's
    assets from all and the other term's as reported; each term's liabilities likewise, from all liabilities as filled."""
    c = {n: F.col(n) for n in BALANCE}
    df = df.withColumn("__l", F.coalesce(c["total_liabilities"], c["short_term_liabilities"] + c["long_term_liabilities"], c["total_assets"] - c["total_equity"]))
    fill = lambda own, total, other: F.coalesce(c[own], total - c[other]).alias(own)
    filled = {
        "total_liabilities": F.col("__l").alias("total_liabilities"),
        "short_term_assets": fill("short_term_assets", c["total_assets"], "long_term_assets"), "long_term_assets": fill("long_term_assets", c["total_assets"], "short_term_assets"),
        "short_term_liabilities": fill("short_term_liabilities", F.col("__l"), "long_term_liabilities"), "long_term_liabilities": fill("long_term_liabilities", F.col("__l"), "short_term_liabilities"),
    }
    return df.select(*(filled.get(n, F.col(n)) for n in df.columns if n != "__l"))


#: The metrics of balance sheets, income statements and ratios, with the labels that they go by.
BALANCE = {
    "total_assets": ["Total Asset", "Total Assets", "TOTAL ASSETS", "Tổng tài sản"],
    "total_liabilities": ["Total Liabilities", "LIABILITIES", "Tổng nợ phải trả", "Nợ phải trả"],
    "total_equity": ["Owner's Equity", "Total Equity", "Vốn chủ sở hữu"],
    "cash_and_equivalents": ["Cash & Equivalents", "Cash and Cash Equivalents", "Tiền và tương đương tiền"],
    "short_term_assets": ["Short-term Asset", "Short Term Assets", "Current Assets", "CURRENT ASSETS", "Tài sản ngắn hạn"],
    "long_term_assets": ["Long-term Asset", "Long Term Assets", "Non-current Assets", "NON-CURRENT ASSETS", "Tài sản dài hạn"],
    "short_term_liabilities": ["Short-term Liability", "Short Term Liabilities", "Current liabilities", "Nợ ngắn hạn"],
    "long_term_liabilities": ["Long-term Liability", "Long Term Liabilities", "Nợ dài hạn"],
}
INCOME = {
    "revenue": ["Net Sales"], "cost_of_goods_sold": ["Cost of Sales"], "gross_profit": ["Gross Profit"], "operating_profit": ["Operating Profit/Loss"], "net_profit_post_tax": ["Net Profit For the Year"],
    "selling_expenses": ["Selling Expenses", "Selling Expense"], "admin_expenses": ["General & Admin", "Admin Expense", "General & Admin Expense"],
    "financial_income": ["Financial Income"], "financial_expenses": ["Financial Expense"], "other_income": ["Other Income"], "other_expenses": ["Other Expense"], "ebitda": ["EBITDA"],
}
RATIOS = {
    "pe_ratio": ["P/E"], "pb_ratio": ["P/B"], "ps_ratio": ["P/S"], "p_cashflow_ratio": ["P/Cash Flow"], "eps": ["EPS"], "bvps": ["BVPS"], "market_cap": ["Market Capital"], "roe": ["ROE"], "roa": ["ROA"], "roic": ["ROIC"],
    "net_profit_margin": ["Net Profit Margin"], "debt_to_equity": ["Debt/Equity"], "financial_leverage": ["Financial Leverage"], "dividend_yield": ["Dividend yield"], "current_ratio": ["Current Ratio"],
    "quick_ratio": ["Quick Ratio"], "interest_coverage": ["Interest Coverage"], "asset_turnover": ["Asset Turnover"], "inventory_turnover": ["Inventory Turnover"],
    "receivable_turnover": ["Receivable Turnover", "Accounts Receivable Turnover"], "revenue_growth": ["Revenue Growth", "Revenue YoY"],
    "profit_growth": ["Profit Growth", "Net Profit YoY", "Profit/Loss after tax YoY", "Attribute to parent company YoY"], "operating_margin": ["Operating Margin", "Operating Profit Margin"],
    "gross_margin": ["Gross Margin", "Gross Profit Margin"], "free_cash_flow": ["Free Cash Flow"],
}


def plain_label(name: str) -> str:
    """A column's label as ``normalize_label`` has it, for names that are known when the plan is made."""
    low = name.lower().translate(str.maketrans(sf.ACCENTED, sf.PLAIN)).replace("&", " and ")
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in low).split())


def find_column(columns: list[str], labels: list[str]) -> str | None:
    """The first column whose plain label contains that of a label, the labels in turn."""
    return next((c for x in map(plain_label, labels) for c in columns if x in plain_label(c)), None)


def _period(df: DataFrame) -> DataFrame:
    """``df`` with year and quarter, from yearReport and lengthReport where it has none."""
    named = {"year": "yearReport", "quarter": "lengthReport"}
    return df.withColumns({k: F.col(v).try_cast("int") for k, v in named.items() if k not in df.columns})


def _metrics(df: DataFrame, metrics: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """``keep`` and the metrics: of the columns that go by a metric's own name or one of its labels the first value."""
    d, by = _period(df), {}
    for c in d.columns:
        by.setdefault(plain_label(c), []).append(c)
    of = {m: [c for x in dict.fromkeys(map(plain_label, [m, *labels])) for c in by.get(x, [])] for m, labels in metrics.items()}
    number = lambda m: sf.clean_decimal_nullable(F.coalesce(*(F.col(f"`{c}`").try_cast("double") for c in of[m]))) if of[m] else F.lit(None).cast("double")
    fiscal = F.col("fiscal_date") if "fiscal_date" in d.columns else sf.quarter_end(F.col("year"), F.col("quarter"))
    out = d.select(*keep, fiscal.alias("fiscal_date"), "year", "quarter", *(number(m).alias(m) for m in metrics))
    return out.where("year IS NOT NULL AND quarter IS NOT NULL AND fiscal_date IS NOT NULL")


def normalize_income(df: DataFrame, keep: list[str]) -> DataFrame:
    """Income statements under canonical names; missing values stay null, rows without a quarter go."""
    return _metrics(df, INCOME, keep)


def normalize_balance(df: DataFrame, keep: list[str]) -> DataFrame:
    """Balance sheets under canonical names, with what follows from the balance identities filled in."""
    return balance_identities(_metrics(df, BALANCE, keep))


def normalize_ratios(df: DataFrame, symbol: str) -> DataFrame:
    """Ratios by quarter under canonical names, found by parts of the labels; margins, turnover and free cash flow of a symbol
    that has none of them follow from its revenue, profits, receivables and operating cash flow."""
    d = _period(df)
    number = lambda c: F.col(f"`{c}`").try_cast("double") if c else F.lit(None).cast("double")
    source = lambda m: m if m in d.columns else find_column(d.columns, RATIOS[m])
    part = lambda *labels: number(find_column(d.columns, list(labels)))
    out = d.select(symbol, F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("quarter", F.lit(0)).alias("quarter"), *(number(source(m)).alias(m) for m in RATIOS), part("Revenue").alias("__r"), part("Operating Profit/Loss").alias("__o"), part("Gross Profit").alias("__g"), part("Accounts Receivables").alias("__a"), part("Net cash inflows/outflows from operating activities").alias("__c"))
    by_revenue = lambda x: sf.safe_ratio(F.col(x), F.col("__r"))
    for metric, derived in (("operating_margin", by_revenue("__o")), ("gross_margin", by_revenue("__g")), ("receivable_turnover", sf.safe_ratio(F.col("__r"), F.col("__a"))), ("free_cash_flow", F.col("__c"))):
        out = derive_if_all_missing(out, symbol, metric, derived)
    return out.select(symbol, sf.quarter_end(F.col("year"), F.col("quarter"), fallback=True).alias("fiscal_date"), "year", "quarter", *(sf.clean_decimal_nullable(F.col(m)).alias(m) for m in RATIOS))


def search_text(*labels: str) -> Column:
    """The plain forms of an item's id and labels, with spaces."""
    return F.array_join(F.filter(F.array(*(sf.normalize_label(F.coalesce(F.col(c), F.lit(""))) for c in labels)), lambda x: x != ""), " ")


def unmapped_labels(items: DataFrame, keywords: list[str]) -> DataFrame:
    """Items (item_id, item, item_en) that no keyword of the metrics is found in, with the label that they show."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | sf.contains_keyword(F.col("__text"), k)
    label = F.trim(F.coalesce(F.nullif("item_en", F.lit("")), F.nullif("item", F.lit(""))))
    return items.withColumn("__text", search_text("item_id", "item", "item_en")).where((F.col("__text") != "") & ~hit).select(*items.columns, label.alias("label")).where("label <> ''")


def provider_fallback(frames: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Rows of each key from the first provider that has any, with its name in source_provider."""
    every = None
    for i, (name, df) in enumerate(frames):
        d = df.withColumn("source_provider", F.lit(name)).withColumn("__rank", F.lit(i))
        every = d if every is None else every.unionByName(d, allowMissingColumns=True)
    return every.withColumn("__best", F.min("__rank").over(Window.partitionBy(key))).where("__rank = __best").drop("__rank", "__best")


def dividends(events: DataFrame) -> DataFrame:
    """Cash (channel 13) and stock (14, 15) dividends in percent from events with channel_id and rate."""
    d = events.where(F.col("channel_id").isin(13, 14, 15)).withColumn("percent", sf.rate_to_percent(F.col("rate")))
    exercise = F.coalesce("exright_date", "record_date")
    return d.select("ticker", exercise.alias("exercise_date"), F.coalesce(F.year(exercise), F.lit(0)).alias("cash_year"), F.when(F.col("channel_id") == 13, F.col("percent")).otherwise(0.0).alias("cash_dividend_percentage"), F.when(F.col("channel_id") != 13, F.col("percent")).otherwise(0.0).alias("stock_dividend_percentage"))


def anchors(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Distinct links of pages: key, url, title."""
    p = r'<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    z = F.arrays_zip(F.regexp_extract_all(html, F.lit(p), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(p), F.lit(2)).alias("title"))
    return pages.select(key, F.inline(z)).select(key, F.col("url"), sf.strip_html(F.col("title")).alias("title")).where("url <> ''").groupBy(key, "url").agg(F.min("title").alias("title"))
