"""Scalar functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters of Vietnamese and their plain letters, in the same order.
ACCENTED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd"


def _bare() -> dict[str, str]:
    """Letters of the Latin blocks that are a plain letter and accents, and that letter."""
    letters = (chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))
    parts = {c: unicodedata.normalize("NFKD", c) for c in letters}
    return {c: d[0] for c, d in parts.items() if len(d) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))}


BARE = _bare()


def strip_accents(x: Column) -> Column:
    """Without accents, whether they are part of a letter or marks after it."""
    return F.regexp_replace(F.translate(x, "".join(BARE), "".join(BARE.values())), r"\p{Mn}+", "")


def normalize_label(x: Column) -> Column:
    """Lower case without accents, composed or not; & is and; other characters than letters and digits become single spaces."""
    low = F.regexp_replace(F.translate(strip_accents(F.lower(x)), ACCENTED, PLAIN), "&", " and ")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def item_id(x: Column) -> Column:
    return F.regexp_replace(normalize_label(x), " ", "_")


def contains_keyword(label: Column, keyword: str) -> Column:
    """Keywords of up to three letters match a whole word, longer ones any part."""
    return F.array_contains(F.split(label, " "), keyword) if len(keyword) <= 3 else F.contains(label, F.lit(keyword))


def clean_decimal_nullable(x: Column) -> Column:
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def clean_decimal(x: Column) -> Column:
    return F.coalesce(clean_decimal_nullable(x), F.lit(0.0))


def safe_ratio(x: Column, y: Column) -> Column:
    return F.try_divide(x, F.nullif(y, F.lit(0.0)))


def rate_to_percent(x: Column) -> Column:
    """``a:b`` is b / a in percent, a plain number itself; blank and a = 0 are 0."""
    t = F.replace(F.trim(x), F.lit(","), F.lit(""))
    p = F.split(t, ":")
    a, b = F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double")
    return F.coalesce(F.when(F.size(p) == 2, F.when(a == 0, 0.0).otherwise(b / F.nullif(a, F.lit(0.0)) * 100)).otherwise(a), F.lit(0.0))


def parse_mixed_date(x: Column, numeric_unit: str = "ms") -> Column:
    """Dates written /Date(ms)/, as epoch number in ``numeric_unit`` (ms or s), ISO, or dd/MM/yyyy; anything else is null."""
    if numeric_unit not in ("ms", "s"):
        raise ValueError("numeric_unit is ms or s")
    t = F.trim(x)
    net = F.nullif(F.regexp_extract(t, r"/Date\((-?\d+)", 1), F.lit("")).try_cast("long")
    number = F.when(t.rlike(r"^\d+$"), t.try_cast("long"))
    net, number = (F.when(n.between(-62135596800000 // k, 253402300799999 // k), n * k) for n, k in ((net, 1), (number, 1 if numeric_unit == "ms" else 1000)))
    millis = F.coalesce(net, number)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))
    day = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(t, F.lit("d/M/yyyy")).cast("date"))
    return F.coalesce(F.to_date(F.timestamp_millis(millis)), iso, day)


def quarter_end(year: Column, quarter: Column, fallback: bool = False) -> Column:
    """The quarter's last day; another quarter gives null, or the first of January with ``fallback``."""
    ok = quarter.between(1, 4)
    end = F.when(ok, F.last_day(F.make_date(year, F.when(ok, quarter * 3).otherwise(1), F.lit(1))))
    return F.coalesce(end, F.make_date(year, F.lit(1), F.lit(1))) if fallback else end


def period_parts(x: Column) -> tuple[Column, Column]:
    """Year and quarter of ``YYYY-Qn``; a plain year is its fourth quarter."""
    year = F.nullif(F.regexp_extract(x, r"^(\d{4})", 1), F.lit("")).try_cast("int")
    quarter = F.nullif(F.regexp_extract(x, r"^\d{4}-Q(\d)$", 1), F.lit("")).try_cast("int")
    return year, F.coalesce(quarter, F.when(x.rlike(r"^\d{4}$"), 4))


def strip_html(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))


def source_host(x: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(x), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/?#]+)", 1), F.lit(""))


def news_id_from_url(x: Column) -> Column:
    first, second = F.regexp_extract(x, r"-post(\d+)", 1), F.regexp_extract(x, r"-d(\d+)\.html", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))).try_cast("long")


def ticker(x: Column) -> Column:
    """Upper case, trimmed; blank is null."""
    return F.nullif(F.upper(F.trim(x)), F.lit(""))


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def event_date(event: Column, public: Column) -> Column:
    """The public date where the event's own lies before 2000."""
    return F.when(F.year(event) < 2000, public).otherwise(event)


#: Listing types and the classes that they are, product groups and theirs, and the market's indices.
CLASSES = {"STOCK": "STOCK", "ETF": "ETF", "FUND": "FUND", "UNIT_TRUST": "FUND", "BOND": "BOND", "DEBENTURE": "BOND", "INDEX": "INDEX", "FU": "DERIVATIVE", "FU_INDEX": "DERIVATIVE", "FU_BOND": "DERIVATIVE", "CW": "DERIVATIVE"}
GROUPS = {"FIO": "DERIVATIVE", "FBX": "DERIVATIVE", "HCX": "BOND"}
INDICES = ["VNINDEX", "HNXINDEX", "UPCOMINDEX", "HNX30", "VN30", "VN100", "VNALL", "VNMID", "VNSML"]


def _upper(x: Column) -> Column:
    return F.upper(F.trim(F.coalesce(x, F.lit(""))))


def asset_class(kind: Column, symbol: Column, group: Column, name: Column) -> Column:
    """Class of a listed instrument: by its type, then by parts of it, product group, name and symbol; STOCK by default."""
    k, of = _upper(kind), lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    by_part = F.when(k.rlike("FU|WARRANT|CW"), "DERIVATIVE").when(F.contains(k, F.lit("BOND")), "BOND")
    by_name = F.when(F.contains(_upper(name), F.lit("CHỨNG QUYỀN")) | _upper(symbol).rlike(r"^[0-9]+[A-Z][0-9]+G[0-9]+$|^C[A-Z]{3,}[0-9]{2,}$"), "DERIVATIVE")
    return F.coalesce(of(CLASSES)[k], by_part, of(GROUPS)[_upper(group)], by_name, F.lit("STOCK"))


def asset_type(symbol: Column) -> Column:
    """index, derivative or stock, as the bars of a symbol are quoted."""
    s = _upper(symbol)
    future = s.rlike(r"^VN(30|100)F[0-9]{1,2}[MQ]$|^4[12][A-Z0-9]{2}[0-9A-HJ-NP-TV-W][1-9A-C][0-9]{3}$")
    return F.when(s.isin(INDICES), "index").when(F.length(s) == 3, "stock").when(future, "derivative").otherwise("stock")


def company_type(industry: Column) -> Column:
    """Which report forms a company uses, by the name of its industry: NH banks, CK brokers, BH insurers, CT others."""
    n = F.lower(F.coalesce(industry, F.lit("")))
    return F.when(F.contains(n, F.lit("ngân hàng")), "NH").when(F.contains(n, F.lit("chứng khoán")), "CK").when(F.contains(n, F.lit("bảo hiểm")), "BH").otherwise("CT")


def sector_fits(asked: Column, sector: Column) -> Column:
    """Whether one of the two names contains the other, case apart."""
    a, b = F.lower(asked), F.lower(sector)
    return F.contains(b, a) | F.contains(a, b)


def entity_label(symbol: Column, key: Column) -> Column:
    """The symbol, else the last part of a path up to its first point; at most 14 characters."""
    known = F.when(~symbol.isin("", "nan", "None"), symbol)
    return F.substring(F.coalesce(known, F.substring_index(F.element_at(F.split(key, "/"), -1), ".", 1)), 1, 14)


def vec_literal(v: Column) -> Column:
    """A vector as text: numbers in brackets, with commas."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vec(x: Column) -> Column:
    return F.from_json(x, "array<double>")


def metadata_json(**fields: Column) -> Column:
    """Fields as JSON; nulls are left out."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def clean_body(x: Column, start: str, stops: list[str], noise: str) -> Column:
    """The body of an article: lines after the first that matches ``start`` (all without one) and before the first with one of
    ``stops``, trimmed, without lines that match ``noise`` or repeat the one before; no more than one empty line in a row."""
    lines = F.transform(F.split(x, r"\r?\n"), lambda y: F.trim(y))
    at = lambda l, test: F.filter(F.transform(l, lambda y, i: F.when(test(y), i + 1)), lambda i: i.isNotNull())
    first = F.coalesce(F.get(at(lines, lambda y: y.rlike(start)), F.lit(0)), F.lit(0))
    body = F.slice(lines, first + 1, F.size(lines))
    stop = lambda y: F.lower(y).rlike("|".join(re.escape(m) for m in stops))
    end = F.coalesce(F.get(at(body, stop), F.lit(0)) - 1, F.size(body))
    kept = F.filter(F.slice(body, 1, end), lambda y: ~y.rlike(noise))
    once = F.aggregate(kept, F.array().cast("array<string>"), lambda s, y: F.when((F.size(s) > 0) & (y != "") & (F.element_at(F.concat(F.array(F.lit("")), s), -1) == y), s).otherwise(F.concat(s, F.array(y))))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(once, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))


def date_window(as_of: Column, back: int) -> tuple[Column, Column]:
    """From ``back`` days before a date to it."""
    return F.date_sub(as_of, back), as_of


def derived_text(title: Column, body: Column, most: int = 500) -> Column:
    """Title and the start of the body; a lone separator goes."""
    return F.regexp_replace(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.substring(F.coalesce(body, F.lit("")), 1, most)), r"^[. ]+|[. ]+$", "")


def model_scores(response: Column) -> Column:
    """id to score of a JSON answer with ``scores``, in code fences or not; scores are clamped."""
    bare = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    rows = F.from_json(bare, "scores array<struct<id:string,score:double>>")["scores"]
    return F.map_from_entries(F.transform(rows, lambda r: F.struct(r["id"], clamp(F.coalesce(r["score"], F.lit(0.0))))))
