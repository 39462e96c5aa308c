"""Landed provider files: JSON bodies, listings and articles, as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc


def camel_to_snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*map(camel_to_snake, df.columns))


def news_json(spark: SparkSession, path: str) -> DataFrame:
    """Articles of JSON files with an ``articles`` list: news_id by publication and title, text, text_length."""
    from ..operators.numbering import numbered

    schema = "articles array<struct<title:string,description:string,publishedAt:string,url:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("articles"))
    rows = rows.withColumn("text", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    return numbered(rows, ["publishedAt", "title", "url"], "news_id").select("news_id", "text", F.length("text").alias("text_length"), F.try_to_timestamp("publishedAt").alias("publish_date"), "url")


def json_rows(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the parsed body in ``parsed``, and rows whose body is not JSON; blank bodies and byte order marks are let pass."""
    body = F.trim(F.replace(F.col(column), F.lit("﻿"), F.lit("")))
    p = df.withColumn("__body", body).withColumn("parsed", F.from_json("__body", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.coalesce((F.col("__body") != "") & F.col("parsed._corrupt").isNotNull(), F.lit(False))
    return p.where(~bad).drop("__body"), p.where(bad).drop("__body", "parsed")


def markdown_stubs(pages: DataFrame, key: str, column: str) -> DataFrame:
    """Distinct ``### [title](url)`` links of each page."""
    p = r"### \[([^\]]+)\]\(([^)\s]+)\)"
    z = F.arrays_zip(F.regexp_extract_all(column, F.lit(p), F.lit(1)).alias("title"), F.regexp_extract_all(column, F.lit(p), F.lit(2)).alias("url"))
    rows = pages.select(key, F.inline(z))
    return rows.groupBy(key, "url").agg(F.min("title").alias("title")).withColumn("news_id", sc.news_id_from_url(F.col("url")))


def article_metadata(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Title, description and date of an article: from its JSON-LD, else from its meta tags."""
    ld = F.from_json(F.regexp_extract(html, r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1), "headline string, description string, datePublished string")
    meta = lambda name: F.nullif(F.regexp_extract(html, rf'<meta[^>]*(?:property|name)="{name}"[^>]*content="([^"]*)"', 1), F.lit(""))
    blank = lambda c: F.nullif(c, F.lit(""))
    return pages.withColumn("__ld", ld).select(key, F.coalesce(blank(F.col("__ld.headline")), meta("og:title")).alias("title"), F.coalesce(blank(F.col("__ld.description")), meta("og:description")).alias("description"), F.coalesce(blank(F.col("__ld.datePublished")), meta("article:published_time")).alias("published"))


def article_record(stubs: DataFrame, metadata: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Stubs with their articles' metadata; rows without a news id go, a missing date is the time of loading."""
    m = metadata.select(key, F.col("title").alias("__title"), "description", "published")
    j = stubs.where("news_id IS NOT NULL").join(m, key, "left")
    return j.select("news_id", "url", F.coalesce("__title", "title").alias("title"), "description", F.coalesce(F.try_to_timestamp("published"), as_of).alias("publish_date"))


def company_events(payloads: DataFrame, key: str, column: str) -> DataFrame:
    """Events of each landed payload: typed dates, text id, English description before the local one, the organisation where there is no type.

    The date of an event is its issue date, in a payload without any issue date field its record date. Payloads that are not JSON,
    null, or without events add nothing.
    """
    text = ("id", "eventTitle", "en_EventTitle", "publicDate", "issueDate", "sourceUrl", "eventListCode", "eventListName", "en_EventListName", "recordDate", "exrightDate", "organCode")
    rows = payloads.select(key, F.contains(F.col(column), F.lit('"issueDate"')).alias("__issued"), F.explode(F.from_json(column, "OrganizationEvents array<map<string,string>>")["OrganizationEvents"]).alias("e"))
    e = {c: F.col("e")[c] for c in text}
    day = lambda c: sc.parse_mixed_date(e[c])
    date = F.when(F.col("__issued"), day("issueDate")).otherwise(day("recordDate"))
    return rows.select(
        key, e["id"].alias("event_id"), date.alias("event_date"), day("publicDate").alias("public_date"), day("exrightDate").alias("exright_date"), e["eventTitle"].alias("event_title"),
        F.coalesce(e["eventListCode"], e["organCode"]).alias("event_type"), F.coalesce(e["en_EventListName"], e["eventListName"]).alias("event_description"),
    )


def company_overview(payloads: DataFrame, key: str, column: str) -> DataFrame:
    """The profile of each landed payload, one row: symbol (the key where the payload has none), profiles and industries of levels 2 to 4.

    Payloads that are not JSON, null, or without a profile add nothing.
    """
    p = payloads.select(key, F.from_json(column, "CompanyListingInfo map<string,string>")["CompanyListingInfo"].alias("c")).where(F.size("c") > 0)
    named = {"companyProfile": "company_profile", "en_CompanyProfile": "company_profile_en"}
    named |= {f"{a}cbName{i}": f"icb_name{i}{b}" for i in (2, 3, 4) for a, b in (("i", ""), ("enI", "_en"))}
    symbol = F.when(F.map_contains_key("c", F.lit("ticker")), F.col("c")["ticker"]).otherwise(F.col(key).cast("string"))
    return p.select(symbol.alias("symbol"), *(F.col("c")[a].alias(b) for a, b in named.items()))


def listing_symbols(listing: DataFrame) -> DataFrame:
    """A provider's listing under snake names, its board as exchange."""
    return snake_columns(listing).withColumnRenamed("board", "exchange")


def require_table(spark: SparkSession, *names: str) -> None:
    """Raises LookupError with the names of the tables that the catalogue lacks."""
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise LookupError(f"no table {', '.join(missing)}")


def save_labels(labels: DataFrame, path: str) -> None:
    """Labels (id, label) as JSON, an object of one id and its label a line, in as many files as there are partitions.

    Rows without id or label go; of one id all rows are written. What is at ``path`` is replaced.
    """
    labels.where("id IS NOT NULL AND label IS NOT NULL").select(F.to_json(F.create_map(F.col("id").cast("string"), F.col("label").cast("boolean"))).alias("value")).write.mode("overwrite").text(path)


def read_labels(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """id and label of JSON objects that map ids to labels: one a line, or with ``lines`` off one a file, as labels written by hand are.

    Lines that are not JSON add nothing. A label that is not true or false is null.
    """
    rows = spark.read.text(path, wholetext=not lines)
    return rows.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "label")).select("id", F.col("label").try_cast("boolean").alias("label"))


def channel_names(payload: DataFrame, column: str) -> DataFrame:
    """Channel id to its English name, else its local one."""
    rows = payload.select(F.inline(F.from_json(column, "array<struct<ChannelID:int,NameEn:string,Name:string>>")))
    return rows.select(F.col("ChannelID").alias("channel_id"), F.coalesce(F.nullif("NameEn", F.lit("")), F.nullif("Name", F.lit(""))).alias("channel_name")).distinct()


def corporate_events(rows: DataFrame, channels: DataFrame) -> DataFrame:
    """Events with typed dates, the channel's name as type (else its id), and a note or stripped content as description."""
    c = F.broadcast(channels)  # a provider has a few dozen channels
    d = lambda x: sc.parse_mixed_date(F.col(x).cast("string"))
    j = rows.join(c, "channel_id", "left")
    return j.select(
        F.col("event_id").cast("string").alias("event_id"), sc.event_date(d("event_date"), d("record_date")).alias("event_date"), d("record_date").alias("public_date"), d("exright_date").alias("exright_date"),
        F.coalesce("channel_name", F.col("channel_id").cast("string")).alias("event_type"), F.coalesce(F.nullif(F.trim("note"), F.lit("")), sc.strip_html(F.col("content"))).alias("event_description"),
    )


def company_news(rows: DataFrame) -> DataFrame:
    """News with host, price change and zero for missing numbers; a link without host keeps the row."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    r = rows.withColumn("price", number("price_at_publish")).withColumn("reference", number("reference_price"))
    return r.select(F.col("news_id").try_cast("long").alias("news_id"), F.try_to_timestamp("publish_date").alias("publish_date"), "title", sc.source_host(F.col("link")).alias("source"), "price", F.when(F.col("reference") > 0, F.col("price") - F.col("reference")).otherwise(0.0).alias("price_change"))


def industry_code(df: DataFrame) -> DataFrame:
    """The finest industry code there is, of levels 4 to 1."""
    return df.withColumn("industry_code", F.coalesce(*(F.nullif(F.col(f"icb_code{i}"), F.lit("")) for i in (4, 3, 2, 1))))


def intraday(rows: DataFrame, zone: str = "Asia/Ho_Chi_Minh") -> DataFrame:
    """Bars from epoch seconds in the market's time; prices of stocks are quoted in thousands, those of indices and futures are not."""
    scale = F.when(F.col("asset_type").isin("index", "derivative"), 1.0).otherwise(1000.0)
    return rows.select("symbol", F.from_utc_timestamp(F.timestamp_seconds("t"), zone).alias("time"), *((F.col(c) / scale).alias(c) for c in ("open", "high", "low", "close")), F.col("volume").try_cast("long").alias("volume"))


_PAGE = "Head array<struct<YearPeriod:int,TermName:string>>, Content map<string,array<map<string,string>>>"


def merge_payload_pages(pages: DataFrame, key: str, page: str, column: str) -> DataFrame:
    """The records of each key's content groups over all its pages, a row each: key, group, number (from 1 on, by page and place), record.

    A payload is the object itself or stands in its ``data``; a page that is not JSON, or has no content, adds nothing; of a group
    that a page has as null, neither. Pages with one number come in the order of their text.
    """
    place = F.rank().over(Window.partitionBy(key).orderBy(page, column))  # from here on a record's page is a number: no payload goes along with it
    p = pages.select(key, column, place.alias("__page")).select(key, "__page", F.from_json(column, f"data struct<{_PAGE.replace('Head array', 'Head:array').replace(', Content map', ',Content:map')}>, {_PAGE}").alias("__p"))
    rows = p.select(key, "__page", F.explode(F.coalesce("__p.data.Content", "__p.Content")).alias("group", "records")).select(key, "__page", "group", F.posexplode("records").alias("place", "record"))
    w = Window.partitionBy(key, "group").orderBy("__page", "place")  # the records of one statement's group
    return rows.withColumn("number", F.row_number().over(w)).select(key, "group", "number", "record")


def merged_payload(pages: DataFrame, key: str, page: str, column: str) -> DataFrame:
    """key and payload: one JSON object with the periods of the first page that has them and the groups of all pages, as ``periodic_statement`` reads it."""
    r = merge_payload_pages(pages, key, page, column)
    groups = r.groupBy(key, "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "record")), lambda a, b: a["number"] - b["number"]), lambda x: x["record"]).alias("records"))
    content = groups.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("group", "records"))).alias("Content"))
    p = pages.withColumn("__p", F.from_json(column, f"data struct<Head:array<struct<YearPeriod:int,TermName:string>>>, Head array<struct<YearPeriod:int,TermName:string>>"))
    head = p.withColumn("Head", F.coalesce("__p.data.Head", "__p.Head")).where("Head IS NOT NULL").groupBy(key).agg(F.min_by("Head", F.struct(page, column)).alias("Head"))
    return content.join(head, key, "left").select(key, F.to_json(F.struct("Head", "Content")).alias("payload"))


def statement_by_metadata(statements: DataFrame, companies: DataFrame, metadata: DataFrame, reports: list[str] | None = None) -> DataFrame:
    """The fields of each company's statements under their labels, in the order of its kind of company.

    ``statements`` has symbol, year, quarter and fields (a map of field name to value); ``companies`` symbol and company_type;
    ``metadata`` position, field_name, type (of report), com_type_code, en_name, name and order. A company of type CT has the
    metadata of CT, any other also those of its own; of one field the first by position counts, of the report types asked for. The
    label is the English name, else the local one, else the field. Returns symbol, year, quarter, place (from 1 on), field_name, label and
    value, a row for each field that the statement has, null values included.
    """
    m = metadata.where("field_name <> ''")
    if reports:
        m = m.where(F.lower(F.trim("type")).isin([r.strip().lower() for r in reports]))
    kinds = companies.select(F.coalesce("company_type", F.lit("CT")).alias("company_type")).distinct()
    own = m.where("com_type_code <> 'CT'").withColumn("company_type", F.col("com_type_code"))
    every = kinds.agg(F.collect_set("company_type").alias("kinds"))  # one row: there are a few kinds of companies
    common = m.where("com_type_code = 'CT'").join(F.broadcast(every)).withColumn("company_type", F.explode("kinds")).drop("kinds")
    first = Window.partitionBy("company_type", "field_name").orderBy("position")
    rows = own.unionByName(common).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    label = F.coalesce(F.nullif("en_name", F.lit("")), F.nullif("name", F.lit("")), F.col("field_name"))
    place = F.row_number().over(Window.partitionBy("company_type").orderBy("order", "field_name"))  # the fields of a kind of company
    fields = rows.select("company_type", "field_name", label.alias("label"), place.alias("place"))
    c = companies.select("symbol", F.coalesce("company_type", F.lit("CT")).alias("company_type"))
    s = statements.join(c, "symbol", "left").withColumn("company_type", F.coalesce("company_type", F.lit("CT")))
    long = s.select("symbol", "year", "quarter", "company_type", F.explode("fields").alias("field_name", "value"))
    return long.join(fields, ["company_type", "field_name"]).select("symbol", "year", "quarter", "place", "field_name", "label", "value")
