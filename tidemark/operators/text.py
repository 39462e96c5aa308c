"""Scores of news texts: keywords, themes, sentiment, mentions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The default keywords, themes, causal phrases, sentiment words, and the parts of sector names that fit a theme.
KEYWORDS = [
    "renewable energy", "clean energy", "solar", "wind power", "hydroelectric", "green energy", "carbon neutral", "sustainability", "emission reduction",
    "renewable", "photovoltaic", "wind farm", "solar panel", "green innovation", "climate", "decarbonisation", "ESG",
]
THEMES = {
    "Clean Energy": ["renewable energy", "solar", "wind power", "clean energy", "carbon neutral", "green innovation", "sustainability", "climate"],
    "Digital Banking": ["digital banking", "fintech", "mobile payment", "blockchain", "cryptocurrency"],
    "Logistics": ["logistics", "supply chain", "warehouse", "shipping", "delivery", "transport"],
    "Manufacturing": ["manufacturing", "production", "factory", "industrial", "automation"],
    "Real Estate": ["real estate", "property", "construction", "housing", "development"],
}
CAUSAL = [
    "because", "therefore", "as a result", "leads to", "caused by", "due to", "resulting in", "impacted by", "driven by", "following",
    "triggered", "boosted by", "weighed on", "lifted by", "attributed to", "on the back of", "amid concerns", "amid expectations",
]
POSITIVE = [
    "tăng trưởng", "lợi nhuận tăng", "doanh thu tăng", "vượt kế hoạch", "kết quả kinh doanh tích cực", "cổ tức", "chi trả cổ tức", "thưởng",
    "phục hồi", "tăng vốn", "mở rộng", "hợp tác", "ký kết", "đầu tư", "nâng hạng", "tốt", "khả quan", "triển vọng", "đột phá", "kỷ lục",
    "hoàn thành", "vượt mốc", "lãi lớn", "cải thiện", "tích cực", "thuận lợi",
]
NEGATIVE = [
    "giảm", "thua lỗ", "lỗ ròng", "sụt giảm", "khó khăn", "rủi ro", "vi phạm", "xử phạt", "cảnh báo", "hủy", "đình chỉ", "kiểm tra",
    "thanh tra", "nợ xấu", "vỡ nợ", "phá sản", "bán ròng", "margin call", "cưỡng chế", "giải chấp", "thiếu thanh khoản", "downgrade", "hạ bậc",
]
THEME_SECTORS = {
    "Clean Energy": ["energy", "utilities", "electricity", "power", "oil", "gas"],
    "Digital Banking": ["banking", "insurance", "finance", "securities", "investment"],
    "Logistics": ["transportation", "logistics", "aviation", "shipping", "freight"],
    "Manufacturing": ["manufacturing", "industrial", "chemicals", "steel", "material", "plastic", "rubber", "textile"],
    "Real Estate": ["real estate", "construction", "property", "housing", "infrastructure"],
}
#: Where a chunk may end, in the order in which they are tried.
SEPARATORS = (". ", "? ", "! ", "\n")
#: Names that one automaton may hold.
MOST_TERMS = 200_000


#: Texts that a task has as Python strings at once.
TEXTS = 256


def alternation(words: list[str]) -> str:
    return "|".join(re.escape(w.lower()) for w in words)


def matches(text: Column, words: list[str]) -> Column:
    """Non-overlapping matches of any of the words, case apart."""
    return F.regexp_count(F.lower(text), F.lit(alternation(words)))


def found(text: Column, words: list[str]) -> Column:
    """How many of the words are contained."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))


def keyword_density(text: Column, words: list[str]) -> Column:
    """Matches by length of the text; 0 for an empty text."""
    return F.when(F.length(text) > 0, matches(text, words) / F.length(text)).otherwise(0.0)


def keyword_presence(text: Column, words: list[str]) -> Column:
    return F.least(found(text, words) / 3, F.lit(1.0))


def keyword_match(text: Column, words: list[str]) -> Column:
    return F.least(matches(text, words) / 3, F.lit(1.0))


def lexicon_sentiment(text: Column, positive: list[str], negative: list[str]) -> Column:
    """(pos - neg) / (pos + neg) over the distinct contained words; 0 without any."""
    p, n = found(text, positive), found(text, negative)
    return F.when(p + n > 0, F.round((p - n) / (p + n), 4)).otherwise(0.0)


def age_days(as_of: Column, published: Column) -> Column:
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(published)) / 86400)


def time_decay(as_of: Column, published: Column, clamp: bool = True) -> Column:
    days = age_days(as_of, published)
    return F.exp(-(F.greatest(days, F.lit(0)) if clamp else days) / 365)


def hybrid(keyword: Column, semantic: Column, decay: Column, weights: tuple[float, float, float] = (0.3, 0.5, 0.2)) -> Column:
    """Weighted sum; without a semantic score the keyword counts 0.7 and the age 0.3."""
    k, s, t = weights
    return F.when(semantic.isNull(), 0.7 * keyword + 0.3 * decay).otherwise(k * keyword + s * semantic + t * decay)


def theme_scores(docs: DataFrame, key: str, themes: dict[str, list[str]]) -> DataFrame:
    """Density times 1000 of every theme: the text is read once, a row comes for each theme."""
    each = F.array(*(F.struct(F.lit(i).alias("theme_order"), F.lit(t).alias("theme"), (keyword_density(F.col("text"), w) * 1000).alias("theme_score")) for i, (t, w) in enumerate(themes.items())))
    return docs.select(key, F.inline(each))


def topic_classify(docs: DataFrame, key: str, themes: dict[str, list[str]]) -> DataFrame:
    """The theme with the highest score, the first of equal ones; Unknown if all are 0."""
    s = theme_scores(docs, key, themes).groupBy(key).agg(F.max_by(F.struct("theme", "theme_score"), F.struct("theme_score", -F.col("theme_order"))).alias("x"))
    return s.select(key, F.when(F.col("x.theme_score") > 0, F.col("x.theme")).otherwise("Unknown").alias("topic"), F.col("x.theme_score").alias("topic_score"))


def theme_coverage(docs: DataFrame, key: str, themes: dict[str, list[str]]) -> DataFrame:
    n = F.create_map(*(x for t, w in themes.items() for x in (F.lit(t), F.lit(len(w)))))
    return theme_scores(docs, key, themes).groupBy("theme").agg(F.avg("theme_score").alias("coverage")).withColumn("keywords", n[F.col("theme")])


def causal_boost(text: Column, phrases: list[str], topic: Column, most: float = 0.15) -> Column:
    return F.least(keyword_density(text, phrases) * 5000 * (1 + topic), F.lit(most))


def term_mentions(docs: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """key and symbol of the terms (symbol, term) that a text contains anywhere, case apart.

    The texts are read once with an automaton of all terms, which is a list of assets' names of checked size.
    """
    import pyarrow as pa

    listed = terms.select("symbol", F.lower("term").alias("term")).where("term <> ''").distinct()
    if listed.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms; deal them out and unite the results")
    of: dict[str, list[str]] = {}
    for r in listed.toLocalIterator():
        of.setdefault(r.term, []).append(r.symbol)

    def run(batches):
        import ahocorasick

        found = ahocorasick.Automaton()
        for t, symbols in of.items():
            found.add_word(t, symbols)
        found.make_automaton()
        for b in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            ids, names = [], []
            for k, t in zip(b.column(key).to_pylist(), b.column("text").to_pylist()):
                hits = sorted({x for _, symbols in found.iter(t or "") for x in symbols}) if of else []
                ids += [k] * len(hits)
                names += hits
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(key).type), pa.array(names, pa.string())], [key, "symbol"])

    return docs.select(key, F.lower("text").alias("text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, symbol string").distinct()


def asset_mentions(docs: DataFrame, key: str, assets: DataFrame) -> DataFrame:
    """key and symbol of the assets (symbol, name_en, name_local) that a text names: the symbol as a whole word, a word of
    four letters or more of the English name, or the whole local name."""
    words = assets.select("symbol", F.explode(F.split(F.coalesce("name_en", F.lit("")), r"\s+")).alias("term")).where(F.length("term") >= 4)
    names = assets.select("symbol", F.coalesce("name_local", F.lit("")).alias("term"))
    return word_mentions(docs, key, assets).unionByName(term_mentions(docs, key, words.unionByName(names))).distinct()


def word_mentions(docs: DataFrame, key: str, symbols: DataFrame) -> DataFrame:
    """Whole-word mentions, case apart: distinct key and symbol. Words meet symbols in an equality join."""
    words = docs.select(key, F.explode(F.array_distinct(F.split(F.upper("text"), r"[^\p{L}\p{N}_]+"))).alias("word")).where("word <> ''")
    return words.join(symbols.select("symbol", F.upper("symbol").alias("word")).distinct(), "word").select(key, "symbol").distinct()


def classification_metrics(df: DataFrame, predicted: Column, actual: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy; 0 where a denominator is 0."""
    p, a = predicted, actual
    g = df.groupBy(*keys).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    g = g.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    g = g.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return g.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def threshold_sweep(df: DataFrame, score: str, actual: str, steps: int = 40) -> DataFrame:
    """Metrics at ``steps`` thresholds from 0 to the highest score: each row is dealt to the thresholds in one generator."""
    top = df.agg(F.max(score).alias("top"))
    each = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    t = df.join(F.broadcast(top)).select("*", each.alias("step")).withColumn("threshold", F.col("top") * F.col("step") / (steps - 1))
    return classification_metrics(t, F.col(score) > F.col("threshold"), F.col(actual) == 1, ("step", "threshold"))


def weight_search(df: DataFrame, keyword: str, semantic: str, decay: str, actual: str, steps: int = 40) -> DataFrame:
    """wk, ws, wt, best F1 and the first step that has it, of each triple of weights in tenths that sum to one.

    Thresholds are ``steps`` even ones from 0 to the triple's highest score and 1e-6. Rows are counted by triple and by
    how many thresholds they exceed, and these counts are cumulated, so that no row is dealt to each threshold.
    """
    grid = F.array(*(F.struct(F.lit(i).alias("wk"), F.lit(j).alias("ws"), F.lit(10 - i - j).alias("wt")) for i in range(11) for j in range(11 - i)))
    g = df.select(keyword, semantic, decay, (F.col(actual) == 1).alias("__y"), F.inline(grid))
    g = g.select("wk", "ws", "wt", "__y", ((F.col("wk") * F.col(keyword) + F.col("ws") * F.col(semantic) + F.col("wt") * F.col(decay)) / 10).alias("__s"))
    top = g.groupBy("wk", "ws", "wt").agg((F.max("__s") + 1e-6).alias("__top"))
    above = F.size(F.filter(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.col("__s") > F.col("__top") * i / (steps - 1)))
    n = g.join(F.broadcast(top), ["wk", "ws", "wt"]).groupBy("wk", "ws", "wt", above.alias("above")).agg(F.count_if("__y").alias("pos"), F.count_if(~F.col("__y")).alias("neg"))
    # a step's hits are the rows that exceed more thresholds than its number; steps without rows of their own follow from the lists
    e = n.groupBy("wk", "ws", "wt").agg(F.collect_list(F.struct("above", "pos", "neg")).alias("x"), F.sum("pos").alias("all"))
    e = e.select("wk", "ws", "wt", "x", "all", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    over = lambda c: F.aggregate("x", F.lit(0).cast("long"), lambda s, r: s + F.when(r["above"] > F.col("step"), r[c]).otherwise(0).cast("long"))
    e = e.withColumn("tp", over("pos")).withColumn("fp", over("neg"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all"))).otherwise(0.0)
    best = e.withColumn("f1", f1).groupBy("wk", "ws", "wt").agg(F.max(F.struct("f1", (-F.col("step")).alias("early"))).alias("b"))
    return best.select("wk", "ws", "wt", F.col("b.f1").alias("f1"), (-F.col("b.early")).alias("step"))


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def balanced_sample(df: DataFrame, stratum: Column, key: str, each: int, seed: int = 42) -> DataFrame:
    """The ``each`` rows of every stratum with the lowest hashes."""
    w = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return df.withColumn("stratum", stratum).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= each).drop("__n")


def histogram(df: DataFrame, score: str, bins: int, low: float, high: float) -> DataFrame:
    """Rows by bin from 1 to ``bins``, scores above 0 only."""
    b = F.least(F.floor((F.col(score) - low) / ((high - low) / bins)) + 1, F.lit(bins))
    return df.where(F.col(score) > 0).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def consecutive_dedup_lines(docs: DataFrame, key: str) -> DataFrame:
    """Texts without lines that equal the line before, trimmed of spaces (any of Unicode's); empty lines go too."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+\z", "")), lambda x: x != "")
    return docs.withColumn("__l", lines).select(key, F.array_join(F.expr("filter(__l, (x, i) -> i = 0 or x <> __l[greatest(i - 1, 0)])"), "\n").alias("text"))


def with_chunks(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """``docs`` with ``chunks``, the overlapping parts of the text.

    A chunk has at most ``size`` characters. Where the text goes on, it ends after the last separator of the first kind
    that has one in its second half. The next chunk starts ``overlap`` characters before its end. Chunks are trimmed,
    empty ones dropped. All other columns pass by the Arrow task, so that nothing has to be joined back.
    """
    import bisect

    import pyarrow as pa
    from pyspark.sql import types as T

    if not 0 <= overlap < size // 2:
        raise ValueError("overlap is to be less than half a chunk")

    def bounds(text: str) -> list[tuple[int, int]]:
        ends = [(len(x), [m.end() for m in re.finditer(re.escape(x), text)]) for x in SEPARATORS]
        out = [(0, 0)] if text else []
        while out and (start := out[-1][0]) < len(text):
            stop = start + size
            if stop < len(text):
                last = ((n, e[bisect.bisect_right(e, stop) - 1]) for n, e in ends if e and e[0] <= stop)
                stop = next((e for n, e in last if e - n >= start + size // 2), stop)
            out[-1] = (start, min(stop, len(text)))
            if stop >= len(text):
                break
            out.append((stop - overlap, 0))
        return out

    def run(batches):
        for b in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            chunks = [[c for x, y in bounds(t) if (c := t[x:y].strip())] if t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunks, pa.list_(pa.string()))], [*b.schema.names, "chunks"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("chunks", T.ArrayType(T.StringType()))]))


def split_chunks(docs: DataFrame, key: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """key, chunk_no and chunk of each chunk."""
    return with_chunks(docs.select(key, "text"), size, overlap).select(key, F.posexplode("chunks").alias("chunk_no", "chunk"))


def topic_aware_score(docs: DataFrame, key: str, words: list[str], themes: dict[str, list[str]], as_of: Column, similarity: str | None = None, k: int = 5, phrases: list[str] | None = None, mode: str = "weighted") -> DataFrame:
    """Score of each text (text, publish_date and, where there is a query vector, its ``similarity``) from its chunks.

    The ``k`` chunks with the highest keyword density count; a bonus of up to 0.3 by keywords re-ranks them. Each is
    of the theme with the most matches. A theme's score is the mean of its three best chunks (or the best one's with
    ``mode`` max), the leading theme the first with the highest. Everything happens inside the row.
    """
    if mode not in ("weighted", "max"):
        raise ValueError("mode is weighted or max")
    count = lambda c, w: F.regexp_count(F.lower(c), F.lit(alternation(w)))
    d = with_chunks(docs)
    d = d.withColumn("chunks", F.when(F.size("chunks") == 0, F.array(F.col("text"))).otherwise(F.col("chunks")))
    counted = F.transform("chunks", lambda c, i: F.struct(i.alias("i"), F.greatest(F.length(c), F.lit(1)).alias("n"), count(c, words).alias("hits"), F.array(*(count(c, w) for w in themes.values())).alias("by_theme")))
    d = d.withColumn("__c", counted)
    rated = F.transform("__c", lambda c: F.struct((-c["hits"] / c["n"]).alias("low"), c["i"].alias("i"), (c["hits"] / c["n"] + F.least(c["hits"] / c["n"] * 1000, F.lit(0.3))).alias("rated"), F.when(F.array_max(c["by_theme"]) > 0, F.array_position(c["by_theme"], F.array_max(c["by_theme"]))).otherwise(0).alias("theme")))
    d = d.withColumn("__top", F.slice(F.array_sort(rated), 1, k))
    best = lambda j: F.slice(F.reverse(F.array_sort(F.transform(F.filter("__top", lambda c: c["theme"] == j + 1), lambda c: c["rated"]))), 1, 3 if mode == "weighted" else 1)
    mean = lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / F.size(x)).otherwise(0.0)
    d = d.withColumn("topic_scores", F.array(*(mean(best(j)) for j in range(len(themes)))))
    topic = F.element_at(F.array(*map(F.lit, themes)), F.array_position("topic_scores", F.array_max("topic_scores")).cast("int"))
    dense = -F.element_at("__top", 1)["low"]
    near = F.when(F.col(similarity).isNotNull(), F.greatest(F.col(similarity), F.lit(0.0))).otherwise(dense) if similarity else dense
    d = d.withColumn("keyword", F.least(keyword_density(F.col("text"), words) * 300, F.lit(1.0))).withColumn("semantic", near).withColumn("time_decay", time_decay(as_of, F.col("publish_date"), clamp=False))
    boost = causal_boost(F.col("text"), phrases, F.array_max("topic_scores")) if phrases else F.lit(0.0)
    two = 0.7 * F.col("keyword") + 0.3 * F.col("time_decay")
    base = F.when(F.col("semantic") > 0, 0.3 * F.col("keyword") + 0.5 * F.col("semantic") + 0.2 * F.col("time_decay")).otherwise(two) if similarity else two
    return d.withColumn("causal_boost", boost).select(key, "keyword", "semantic", "time_decay", "causal_boost", F.least(base + F.col("causal_boost"), F.lit(1.0)).alias("score"), topic.alias("topic"), "topic_scores", F.size("chunks").alias("num_chunks"), F.size("__top").alias("top_chunks"))


def asset_fits(assets: DataFrame, theme_sectors: list[list[str]]) -> DataFrame:
    """symbol and fit: for each theme 1 if the asset's sector or industry contains one of the theme's words."""
    place = F.lower(F.concat(F.coalesce("sector", F.lit("Unknown")), F.lit(" "), F.coalesce("industry", F.lit(""))))
    one = lambda words: F.greatest(*(F.contains(place, F.lit(w)).cast("int") for w in words), F.lit(0))
    return assets.select("symbol", F.array(*map(one, theme_sectors)).alias("fit"))


def _shares() -> Column:
    """Shares of the topic scores; those of themes with less than 0.02 of them are 0."""
    total = F.aggregate("topic_scores", F.lit(0.0), lambda s, x: s + x)
    share = lambda x: x / F.when(total == 0, 1.0).otherwise(total)
    return F.transform("topic_scores", lambda t: F.when(share(t) >= 0.02, share(t)).otherwise(0.0))


def _sector(fit: Column) -> Column:
    """Sum of the ``shares`` of themes that fit."""
    return F.least(F.aggregate(F.zip_with("shares", fit, lambda t, f: t * f), F.lit(0.0), lambda s, x: s + x), F.lit(1.0))


def _impact(direct: int, sector: Column) -> Column:
    return 0.45 * F.lit(direct) + 0.35 * sector + 0.2 * F.col("score")


def _with_named(scores: DataFrame, mentions: DataFrame, fits: DataFrame, key: str) -> DataFrame:
    """The scores, each computed once, with ``shares`` and ``named``: symbol and fit of the assets that the text names."""
    named = mentions.join(fits, "symbol").groupBy(key).agg(F.collect_set(F.struct("symbol", "fit")).alias("named"))
    d = scores.select(key, "score", "topic_scores").join(named, key, "left")
    none = F.array().cast(named.schema["named"].dataType)
    return d.select(key, "score", F.coalesce("named", none).alias("named"), _shares().alias("shares"))


def ticker_impact(scores: DataFrame, mentions: DataFrame, fits: DataFrame, key: str, k: int = 10, least: float = 0.05) -> DataFrame:
    """Impact of each text on assets: 0.45 mention, 0.35 sector, 0.20 score; the k best of each text, ties by symbol.

    Assets without a mention differ by their fit alone. A row carries the first k symbols of every fit, at most two to the number
    of themes of them, and ranks the fits: only those of the first k can hold one of its k best. What the text names is added. Rows
    with one key count as one text.
    """
    first = top_k_per_group(fits, "fit", [F.col("symbol")], k).groupBy("fit").agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))
    kinds = first.agg(F.collect_list(F.struct("fit", "symbols")).alias("kinds"))  # one row
    d = _with_named(scores, mentions, fits, key).join(F.broadcast(kinds))

    def rated(direct: int, fit: Column, symbol: Column, *more: Column) -> Column:
        sector = _sector(fit)
        impact = _impact(direct, sector)
        return F.struct((-F.round(impact, 9)).alias("low"), symbol.alias("symbol"), *more, impact.alias("impact"), F.lit(direct).alias("direct"), sector.alias("sector"))

    plain = F.slice(F.array_sort(F.transform("kinds", lambda x: rated(0, x["fit"], F.get(x["symbols"], F.lit(0)), x["symbols"].alias("symbols")))), 1, k)
    d = d.withColumn("plain", plain)
    unnamed = lambda x: F.filter(x["symbols"], lambda s: ~F.exists("named", lambda n: n["symbol"] == s))
    every = F.flatten(F.transform("plain", lambda x: F.transform(unnamed(x), lambda s: F.struct(x["low"].alias("low"), s.alias("symbol"), x["impact"].alias("impact"), x["direct"].alias("direct"), x["sector"].alias("sector")))))
    both = F.filter(F.concat(every, F.transform("named", lambda n: rated(1, n["fit"], n["symbol"]))), lambda x: x["impact"] >= least)
    best = d.select(key, "score", F.inline(F.slice(F.array_sort(both), 1, k)))
    best = best.groupBy(key, "symbol").agg(F.max(F.struct("impact", "direct", "sector", "score")).alias("x")).select(key, "symbol", "x.*")
    return top_k_per_group(best, key, [F.desc(F.round("impact", 9)), F.col("symbol")], k)


def news_for_ticker(scores: DataFrame, mentions: DataFrame, fits: DataFrame, key: str, k: int = 10, least: float = 0.05) -> DataFrame:
    """Of every asset the k texts with the highest impact on it, ties by key.

    Texts without a mention of the asset rank alike for all assets of one fit: the k best texts of each fit and the k best that
    name the asset are all that can come first. Rows with one key count as one text.
    """
    kinds = fits.select("fit").distinct().agg(F.collect_list("fit").alias("kinds"))  # one row, of at most 2^themes fits
    d = _with_named(scores, mentions, fits, key).join(F.broadcast(kinds))

    def rated(direct: int, fit: Column, group: Column) -> Column:
        sector = _sector(fit)
        return F.struct(F.lit(direct).alias("direct"), group.alias("group"), _impact(direct, sector).alias("impact"), sector.alias("sector"))

    both = F.concat(F.transform("kinds", lambda f: rated(0, f, F.to_json(f))), F.transform("named", lambda n: rated(1, n["fit"], n["symbol"])))
    rows = d.select(key, "score", F.inline(F.filter(both, lambda x: x["impact"] >= least)))
    once = rows.groupBy("direct", "group", key).agg(F.max(F.struct("impact", "sector", "score")).alias("x")).select("direct", "group", key, "x.*")
    some = top_k_per_group(once.withColumn("of", F.struct("direct", "group")), "of", [F.desc(F.round("impact", 9)), F.col(key)], k).drop("rank", "of")
    of = fits.select("symbol", F.inline(F.array(F.struct(F.lit(0).alias("direct"), F.to_json("fit").alias("group")), F.struct(F.lit(1).alias("direct"), F.col("symbol").alias("group")))))
    best = some.join(of, ["direct", "group"]).groupBy("symbol", key).agg(F.max(F.struct("impact", "direct", "sector", "score")).alias("x")).select("symbol", key, "x.*")
    return top_k_per_group(best, "symbol", [F.desc(F.round("impact", 9)), F.col(key)], k)


def thematic_exposure(news: DataFrame, entity: str, key: str, themes: dict[str, list[str]], as_of: Column, similarity: str, entities: int = 20, articles: int = 30) -> DataFrame:
    """The highest hybrid score (0.4, 0.4, 0.2) that each theme reaches among the first articles of the entities with most: a column for each theme."""
    most = news.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), entity).limit(entities)
    some = top_k_per_group(news.join(F.broadcast(most), entity), entity, [F.col(key)], articles)
    decay = time_decay(as_of, F.col("publish_date"), clamp=False)
    each = lambda w: F.max(hybrid(keyword_presence(F.col("text"), w), F.when(F.col(similarity).isNotNull(), F.greatest(F.col(similarity), F.lit(0.0))), decay, (0.4, 0.4, 0.2)))
    return some.groupBy(entity, "articles").agg(*(each(w).alias(t) for t, w in themes.items()))


def topic_scores(docs: DataFrame, key: str, topics: DataFrame, k: int = 5) -> DataFrame:
    """Of each topic (topic_id, words: distinct lower-case words) the k texts with the highest density of its words.

    The topics' words, a list of checked size, go to where the texts are read, and each batch hands on its k best texts of a topic. Longer
    lists meet the words of texts, counted by text first, in an equality join. Rows with one key and length count as one text.
    """
    t = topics.select("topic_id", F.explode("words").alias("word")).distinct()
    rows = docs.select(key, F.greatest(F.length("text"), F.lit(1)).alias("n"), "text")
    if t.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        s = _topic_bests(rows, key, t, k)
    else:
        words = rows.select(key, "n", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("word")).where("word <> ''")
        counts = words.groupBy(key, "n", "word").agg(F.count("*").alias("c"))
        s = counts.join(t, "word").groupBy("topic_id", key, "n").agg(F.sum("c").alias("c")).select("topic_id", key, (F.col("c") / F.col("n")).alias("score"))
    return top_k_per_group(s, "topic_id", [F.desc(F.round("score", 12)), F.col(key)], k)


def _topic_bests(rows: DataFrame, key: str, listed: DataFrame, k: int) -> DataFrame:
    """topic_id, key and score of the k best texts (key, n, text) of each topic (topic_id, word) in each slice of a batch."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from .latent import _counts, _slices, once

    found = listed.orderBy("word", "topic_id").toArrow()
    words = found.column("word").combine_chunks().dictionary_encode()
    place = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
    ends = np.searchsorted(words.indices.to_numpy(), np.arange(len(place) + 1))  # the topics of a word stand together
    topics = found.column("topic_id").combine_chunks().dictionary_encode()
    names, topic = topics.dictionary, topics.indices.to_numpy()

    def run(batches):
        for b in _slices(batches, 1 << 17):
            own, text, word, n = _counts(b.column("t"))
            at = np.array([place.get(w, -1) for w in own.to_pylist()], np.int64)[word]
            text, n, at = text[at >= 0], n[at >= 0], at[at >= 0]
            each = ends[at + 1] - ends[at]
            of = topic[np.arange(each.sum()) + np.repeat(ends[at] - np.cumsum(each) + each, each)]
            pairs, which = np.unique(of.astype(np.int64) * b.num_rows + np.repeat(text, each), return_inverse=True)
            of, row = pairs // max(1, b.num_rows), pairs % max(1, b.num_rows)
            score = np.bincount(which, np.repeat(n, each), len(pairs)) / b.column("n").to_numpy()[row]
            order = np.lexsort((pc.rank(b.column(key), tiebreaker="dense").to_numpy()[row], -np.round(score, 12), of))
            order = order[np.arange(len(order)) - np.searchsorted(of[order], of[order]) < k]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of[order])), b.column(key).take(pa.array(row[order])), pa.array(score[order], pa.float64())], ["topic_id", key, "score"])

    kinds = [x.schema[0].dataType.simpleString() for x in (listed.select("topic_id"), rows.select(key))]
    t = once(rows, key, "n").select(key, "n", F.coalesce(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), F.array()).alias("t"))
    return t.mapInArrow(run, f"topic_id {kinds[0]}, {key} {kinds[1]}, score double")


def hit_rates(results: DataFrame, topics: int) -> DataFrame:
    """Of each method (method, topic_id, rank, score) the share of topics with a hit and the mean first score."""
    first = results.where("rank = 1").groupBy("method").agg(F.count_if(F.col("score") > 0).alias("hits"), F.avg("score").alias("top_score"))
    return first.select("method", (F.col("hits") / topics).alias("hit_rate"), "top_score")
