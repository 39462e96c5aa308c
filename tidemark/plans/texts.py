"""Registered queries over news texts and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latent, probing
from ..operators import text as tx
from ..operators import vectors as ve
from ..sources import shared, tables
from .market import rounded

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Words of the invented prose that stand in for the keyword lists.
WORDS = ["that", "with", "this"]
THEMES = {"A": ["that", "with"], "B": ["this", "from"], "C": ["und", "der"], "D": ["les", "que"]}
AS_OF = "2025-01-01"

NEWS = "news AS (SELECT doc_id AS news_id, coalesce(text, '') AS text, source, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS TIMESTAMP) AS publish_date FROM documents)"


def _m(words: list[str]) -> str:
    return f"len(regexp_extract_all(lower(text), '{'|'.join(words)}'))"


def _dens(words: list[str]) -> str:
    return f"CASE WHEN length(text) > 0 THEN {_m(words)} / length(text) ELSE 0 END"


def _found(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words) + ")"


DAYS = f"floor((epoch(TIMESTAMP '{AS_OF}') - epoch(publish_date)) / 86400)"


@query(f"WITH {NEWS} SELECT news_id, round({_dens(WORDS)}, 9) AS density, round(least({_found(WORDS)} / 3, 1.0), 6) AS presence, round(least({_m(WORDS)} / 3, 1.0), 6) AS matches, round(least(300 * {_dens(WORDS)}, 1.0), 6) AS scaled FROM news")
def keyword_scores(spark, sf):
    t = F.col("text")
    return tables.news(spark, sf).select("news_id", F.round(tx.keyword_density(t, WORDS), 9).alias("density"), F.round(tx.keyword_presence(t, WORDS), 6).alias("presence"), F.round(tx.keyword_match(t, WORDS), 6).alias("matches"), F.round(F.least(tx.keyword_density(t, WORDS) * 300, F.lit(1.0)), 6).alias("scaled"))


@query(f"WITH {NEWS} SELECT news_id, round({_dens(WORDS)}, 9) AS density FROM news WHERE {_dens(WORDS)} > 0.002")
def score_threshold(spark, sf):
    return tables.news(spark, sf).select("news_id", F.round(tx.keyword_density(F.col("text"), WORDS), 9).alias("density")).where("density > 0.002")


@query(f"WITH {NEWS}, p AS (SELECT news_id, {_found(['that', 'this', 'the'])} AS p, {_found(['with', 'from'])} AS n FROM news) SELECT news_id, CASE WHEN p + n > 0 THEN round((p - n) / (p + n), 4) ELSE 0 END AS sentiment FROM p")
def lexicon_sentiment(spark, sf):
    return tables.news(spark, sf).select("news_id", tx.lexicon_sentiment(F.col("text"), ["that", "this", "the"], ["with", "from"]).alias("sentiment"))


@query(f"""WITH {NEWS}, v AS (SELECT vec_id AS news_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / 8 / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) + 1e-9) AS sem FROM embeddings),
s AS (SELECT news_id, least({_found(WORDS)} / 3, 1.0) AS kw, sem, exp(-greatest({DAYS}, 0) / 365) AS decay FROM news LEFT JOIN v USING (news_id))
SELECT news_id, round(decay, 6) AS decay, round(CASE WHEN sem IS NULL THEN 0.7 * kw + 0.3 * decay ELSE 0.3 * kw + 0.5 * sem + 0.2 * decay END, 6) AS score FROM s""")
def hybrid_score(spark, sf):
    """The query vector has all components alike, so its cosine is the mean direction."""
    e = tables.table(spark, sf, "embeddings")
    q = F.array_repeat(F.lit(0.125), 64)
    v = e.select(F.col("vec_id").alias("news_id"), (ve.dot(F.col("embedding"), q) / (ve.norm(F.col("embedding")) + 1e-9)).alias("sem"))
    n = tables.news(spark, sf).join(v, "news_id", "left")
    decay = tx.time_decay(F.lit(AS_OF).cast("timestamp"), F.col("publish_date"))
    return rounded(n.select("news_id", decay.alias("decay"), tx.hybrid(tx.keyword_presence(F.col("text"), WORDS), F.col("sem"), decay).alias("score")))


THEME_SQL = "[" + ", ".join(f"ROW({i}, '{t}', ({_dens(w)}) * 1000)" for i, (t, w) in enumerate(THEMES.items())) + "]"


@query(f"WITH {NEWS}, s AS (SELECT news_id, unnest({THEME_SQL}) AS x FROM news) SELECT news_id, CASE WHEN max(x[3]) > 0 THEN arg_max(x[2], ROW(x[3], -x[1])) ELSE 'Unknown' END AS topic, round(max(x[3]), 6) AS topic_score FROM s GROUP BY news_id")
def topic_classify(spark, sf):
    return rounded(tx.topic_classify(tables.news(spark, sf), "news_id", THEMES))


@query(f"WITH {NEWS}, s AS (SELECT news_id, unnest({THEME_SQL}) AS x FROM news) SELECT x[2] AS theme, round(avg(x[3]), 6) AS coverage, 2 AS keywords FROM s GROUP BY 1")
def theme_coverage(spark, sf):
    return rounded(tx.theme_coverage(tables.news(spark, sf), "news_id", THEMES))


@query(f"WITH {NEWS}, s AS (SELECT news_id, unnest({THEME_SQL}) AS x FROM news), t AS (SELECT news_id, CASE WHEN max(x[3]) > 0 THEN arg_max(x[2], ROW(x[3], -x[1])) ELSE 'Unknown' END AS topic FROM s GROUP BY news_id) SELECT topic, count(*) AS n FROM t GROUP BY topic")
def topic_counts(spark, sf):
    return tx.topic_classify(tables.news(spark, sf), "news_id", THEMES).groupBy("topic").agg(F.count("*").alias("n"))


LABELLED = f"WITH {NEWS}, d AS (SELECT news_id, {_dens(WORDS)} AS score, y.quality FROM news JOIN (SELECT doc_id AS news_id, max(quality) AS quality FROM labels GROUP BY 1) y USING (news_id))"
METRICS = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall"


def _labelled(spark, sf):
    y = tables.table(spark, sf, "labels").groupBy(F.col("doc_id").alias("news_id")).agg(F.max("quality").alias("quality"))
    return tables.news(spark, sf).select("news_id", "text", "publish_date", tx.keyword_density(F.col("text"), WORDS).alias("score")).join(y, "news_id")


@query(LABELLED + f""", m AS (SELECT count(*) FILTER (score > 0.002 AND quality = 1) AS tp, count(*) FILTER (score > 0.002 AND quality <> 1) AS fp, count(*) FILTER (score <= 0.002 AND quality = 1) AS fn, count(*) FILTER (score <= 0.002 AND quality <> 1) AS tn FROM d), p AS (SELECT *, {METRICS} FROM m)
SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM p""")
def classification_metrics(spark, sf):
    return rounded(tx.classification_metrics(_labelled(spark, sf), F.col("score") > 0.002, F.col("quality") == 1))


@query(LABELLED + f""", t AS (SELECT step, (SELECT max(score) FROM d) * step / 39 AS threshold FROM (SELECT unnest(range(40)) AS step)),
m AS (SELECT step, threshold, count(*) FILTER (score > threshold AND quality = 1) AS tp, count(*) FILTER (score > threshold AND quality <> 1) AS fp, count(*) FILTER (score <= threshold AND quality = 1) AS fn FROM d CROSS JOIN t GROUP BY step, threshold), p AS (SELECT *, {METRICS} FROM m)
SELECT CAST(step AS INT) AS step, tp, fp, fn, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM p""")
def threshold_sweep(spark, sf):
    return rounded(tx.threshold_sweep(_labelled(spark, sf), "score", "quality").select("step", "tp", "fp", "fn", "f1"))


def _parts(spark, sf):
    return _labelled(spark, sf).select("quality", tx.keyword_presence(F.col("text"), WORDS).alias("k"), tx.keyword_match(F.col("text"), WORDS).alias("s"), tx.time_decay(F.lit(AS_OF).cast("timestamp"), F.col("publish_date")).alias("t"))


@query(LABELLED + f""", e AS (SELECT d.*, least({_found(WORDS)} / 3, 1.0) AS k, least({_m(WORDS)} / 3, 1.0) AS s, exp(-greatest({DAYS}, 0) / 365) AS t FROM d JOIN news USING (news_id)),
g AS (SELECT i AS wk, j AS ws, 10 - i - j AS wt FROM (SELECT unnest(range(11)) AS i) CROSS JOIN (SELECT unnest(range(11)) AS j) WHERE i + j <= 10),
x AS (SELECT wk, ws, wt, quality, (wk * k + ws * s + wt * t) / 10 AS x FROM e CROSS JOIN g), h AS (SELECT wk, ws, wt, max(x) + 1e-6::DOUBLE AS top FROM x GROUP BY wk, ws, wt),
m AS (SELECT wk, ws, wt, step, count(*) FILTER (x > top * step / 39 AND quality = 1) AS tp, count(*) FILTER (x > top * step / 39 AND quality <> 1) AS fp, count(*) FILTER (x <= top * step / 39 AND quality = 1) AS fn FROM x JOIN h USING (wk, ws, wt) CROSS JOIN (SELECT unnest(range(40)) AS step) GROUP BY wk, ws, wt, step), p AS (SELECT *, {METRICS} FROM m)
SELECT CAST(wk AS INT) AS wk, CAST(ws AS INT) AS ws, CAST(wt AS INT) AS wt, round(max(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END), 6) AS f1 FROM p GROUP BY wk, ws, wt""")
def weight_search(spark, sf):
    """The best F1 over 40 thresholds of each triple of weights."""
    return rounded(tx.weight_search(_parts(spark, sf), "k", "s", "t", "quality").select("wk", "ws", "wt", "f1"))


@query(SQL["weight_search"].replace("SELECT CAST(wk AS INT) AS wk, CAST(ws AS INT) AS ws, CAST(wt AS INT) AS wt, round(max(", "SELECT CAST(wk AS INT) AS wk, round(max(").replace("FROM p GROUP BY wk, ws, wt", "FROM p GROUP BY wk"))
def weight_ablation(spark, sf):
    """The best F1 that a weight of the keyword reaches with any other weights."""
    return weight_search(spark, sf).groupBy("wk").agg(F.max("f1").alias("f1"))


@query(f"WITH {NEWS}, s AS (SELECT source, news_id, round({_dens(WORDS)}, 9) AS density FROM news) SELECT source, news_id, density, CAST(row_number() OVER (PARTITION BY source ORDER BY density DESC, news_id) AS INT) AS rank FROM s QUALIFY rank <= 5")
def top_news_by_source(spark, sf):
    n = tables.news(spark, sf).select("source", "news_id", F.round(tx.keyword_density(F.col("text"), WORDS), 9).alias("density"))
    return tx.top_k_per_group(n, "source", [F.desc("density"), F.col("news_id")], 5)


@query(f"WITH {NEWS}, s AS (SELECT news_id, CASE WHEN {_dens(WORDS)} > 0 THEN 'hit' ELSE 'none' END AS stratum FROM news) SELECT news_id, stratum FROM s QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || news_id), news_id) <= 25")
def balanced_sample(spark, sf):
    n = tables.news(spark, sf).select("news_id", tx.keyword_density(F.col("text"), WORDS).alias("d"))
    return tx.balanced_sample(n, F.when(F.col("d") > 0, "hit").otherwise("none"), "news_id", 25).select("news_id", "stratum")


@query(f"WITH {NEWS}, s AS (SELECT {_dens(WORDS)} AS d FROM news) SELECT CAST(least(floor(d / (0.04 / 40)) + 1, 40) AS BIGINT) AS bin, count(*) AS n FROM s WHERE d > 0 GROUP BY 1")
def score_histogram(spark, sf):
    return tx.histogram(tables.news(spark, sf).select(tx.keyword_density(F.col("text"), WORDS).alias("d")), "d", 40, 0.0, 0.04)


@query(f"WITH {NEWS}, s AS (SELECT {_dens(WORDS)} AS d, length(text) AS n, publish_date FROM news) SELECT count(*) AS articles, min(publish_date) AS first, max(publish_date) AS last, round(avg(n), 6) AS mean_length, round(max(d), 6) AS top, count(*) FILTER (d > 0) AS scored, round(quantile_cont(d, 0.5) FILTER (d > 0), 9) AS median_score FROM s")
def corpus_profile(spark, sf):
    n = tables.news(spark, sf).select("publish_date", F.length("text").alias("n"), tx.keyword_density(F.col("text"), WORDS).alias("d"))
    return n.agg(F.count("*").alias("articles"), F.min("publish_date").alias("first"), F.max("publish_date").alias("last"), F.round(F.avg("n"), 6).alias("mean_length"), F.round(F.max("d"), 6).alias("top"), F.count_if(F.col("d") > 0).alias("scored"), F.round(F.percentile(F.when(F.col("d") > 0, F.col("d")), F.lit(0.5)), 9).alias("median_score"))


@query(f"WITH {NEWS}, w AS (SELECT DISTINCT news_id, unnest(regexp_split_to_array(upper(text), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM news) SELECT news_id, word AS symbol FROM w WHERE word IN ('EN', 'TION', 'LES', 'UND', 'ANAN', 'EDST')")
def ticker_mentions(spark, sf):
    symbols = spark.createDataFrame([(x,) for x in ("EN", "TION", "LES", "UND", "ANAN", "EDST")], "symbol string")
    return tx.word_mentions(tables.news(spark, sf), "news_id", symbols)


def _cut(start: str) -> str:
    """Where the chunk that starts there ends."""
    half = f"substr(text, {start} + 257, 256)"
    last = lambda x: f"CASE WHEN instr(reverse({half}), {x}) > 0 THEN {start} + 513 - instr(reverse({half}), {x}) END"
    return f"CASE WHEN {start} + 512 >= length(text) THEN length(text) ELSE coalesce({last("' .'")}, {last("' ?'")}, {last("' !'")}, {last('chr(10)')}, {start} + 512) END"


CHUNKS = f"""{NEWS}, ch AS (SELECT news_id, text, 0 AS a, CAST({_cut('0')} AS BIGINT) AS b FROM news WHERE length(text) > 0 UNION ALL SELECT news_id, text, CAST(b - 64 AS INT), CAST({_cut('(b - 64)')} AS BIGINT) FROM ch WHERE b < length(text)),
chunks AS (SELECT news_id, CAST(row_number() OVER (PARTITION BY news_id ORDER BY a) - 1 AS INT) AS chunk_no, chunk FROM (SELECT news_id, a, regexp_replace(substr(text, a + 1, b - a), '^\\s+|\\s+$', '', 'g') AS chunk FROM ch) WHERE chunk <> '')"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT * FROM chunks")
def news_chunks(spark, sf):
    return tx.split_chunks(tables.news(spark, sf), "news_id")


PHRASES = ["on the", "of the"]
SEM = "v AS (SELECT vec_id AS news_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / 8 / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) + 1e-9) AS sem FROM embeddings)"
_hits = lambda w, x: f"len(regexp_extract_all(lower({x}), '{'|'.join(w)}'))"
SCORES = f"""{CHUNKS}, {SEM}, every AS (SELECT news_id, chunk_no, chunk FROM chunks UNION ALL SELECT news_id, 0, text FROM news WHERE news_id NOT IN (SELECT news_id FROM chunks)),
c1 AS (SELECT news_id, chunk_no, greatest(length(chunk), 1) AS n, {_hits(WORDS, 'chunk')} AS h, [{', '.join(_hits(w, 'chunk') for w in THEMES.values())}] AS by_theme FROM every),
c2 AS (SELECT *, h / n AS dense, h / n + least(h / n * 1000, 0.3) AS rated, CASE WHEN list_max(by_theme) > 0 THEN list_position(by_theme, list_max(by_theme)) ELSE 0 END AS theme, count(*) OVER (PARTITION BY news_id) AS num_chunks FROM c1),
c3 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY dense DESC, chunk_no) <= 5),
c4 AS (SELECT *, row_number() OVER (PARTITION BY news_id, theme ORDER BY rated DESC) AS place FROM c3),
t AS (SELECT news_id, max(dense) AS dense, any_value(num_chunks) AS num_chunks, count(*) AS top_chunks, [{', '.join(f'coalesce(avg(rated) FILTER (theme = {j + 1} AND place <= 3), 0)' for j in range(len(THEMES)))}] AS topics FROM c4 GROUP BY news_id),
u AS (SELECT news_id, text, least({_dens(WORDS)} * 300, 1.0) AS keyword, CASE WHEN sem IS NULL THEN dense ELSE greatest(sem, 0) END AS semantic, exp(-{DAYS} / 365) AS decay, topics, num_chunks, top_chunks, least({_dens(PHRASES)} * 5000 * (1 + list_max(topics)), 0.15) AS boost FROM news JOIN t USING (news_id) LEFT JOIN v USING (news_id)),
scores AS (SELECT news_id, keyword, semantic, decay AS time_decay, boost AS causal_boost, least(CASE WHEN semantic > 0 THEN 0.3 * keyword + 0.5 * semantic + 0.2 * decay ELSE 0.7 * keyword + 0.3 * decay END + boost, 1.0) AS score, {list(THEMES)!r}[list_position(topics, list_max(topics))] AS topic, topics, num_chunks, top_chunks FROM u)"""


def _with_similarity(spark, sf):
    """News with the cosine of their vectors, where they have one, and the query vector, whose components are all alike."""
    e = tables.table(spark, sf, "embeddings")
    v = e.select(F.col("vec_id").alias("news_id"), (ve.dot(F.col("embedding"), F.array_repeat(F.lit(0.125), 64)) / (ve.norm(F.col("embedding")) + 1e-9)).alias("sem"))
    return tables.news(spark, sf).join(v, "news_id", "left")


def _scores(spark, sf):
    return tx.topic_aware_score(_with_similarity(spark, sf), "news_id", WORDS, THEMES, F.lit(AS_OF).cast("timestamp"), "sem", phrases=PHRASES)


@query(f"WITH RECURSIVE {SCORES} SELECT news_id, round(keyword, 6) AS keyword, round(semantic, 6) AS semantic, round(time_decay, 6) AS time_decay, round(causal_boost, 6) AS causal_boost, round(score, 6) AS score, topic, CAST(num_chunks AS INT) AS num_chunks, CAST(top_chunks AS INT) AS top_chunks, {', '.join(f'round(topics[{j + 1}], 6) AS topic_{t.lower()}' for j, t in enumerate(THEMES))} FROM scores")
def topic_aware_score(spark, sf):
    s = _scores(spark, sf)
    return rounded(s.select("*", *(F.get("topic_scores", F.lit(j)).alias(f"topic_{t.lower()}") for j, t in enumerate(THEMES))).drop("topic_scores"))


#: Stand-ins for assets, whose names occur in the invented prose: symbol, name_en, name_local, sector, industry.
ASSETS = [
    ("EN", "Works", "", "Energy", "power"), ("TION", "Ands Tions", "", "Energy", ""), ("LES", "", "mentre", "Real estate", "housing"), ("UND", "Keit Werke", "", "Logistics", "freight"),
    ("ANAN", "Thing Bank", "", "Banking", "finance"), ("EDST", "", "ingly the", "Banking", "energy"), ("QQQ", "None", "", "Textile", ""),
]
FITS = [["energy", "power"], ["bank"], ["logist", "freight"], ["estate"]]
_fit = ", ".join("CASE WHEN " + " OR ".join(f"contains(place, '{w}')" for w in words) + " THEN 1 ELSE 0 END" for words in FITS)
IMPACT = f"""{SCORES}, assets AS (SELECT *, lower(sector || ' ' || industry) AS place FROM (VALUES {', '.join(map(str, ASSETS))}) t(symbol, name_en, name_local, sector, industry)), fits AS (SELECT *, [{_fit}] AS fit FROM assets),
x AS (SELECT news_id, symbol, score, topics, fit, list_sum(topics) AS total, CASE WHEN list_contains(regexp_split_to_array(upper(text), '[^\\p{{L}}\\p{{N}}_]+'), symbol) OR len(list_filter(string_split(name_en, ' '), lambda w: length(w) >= 4 AND contains(lower(text), lower(w)))) > 0 OR (name_local <> '' AND contains(lower(text), lower(name_local))) THEN 1 ELSE 0 END AS direct FROM scores JOIN news USING (news_id) CROSS JOIN fits),
y AS (SELECT *, least(list_sum(list_transform(range(1, len(fit) + 1), lambda j: CASE WHEN topics[j] / CASE WHEN total = 0 THEN 1 ELSE total END >= 0.02 THEN topics[j] / CASE WHEN total = 0 THEN 1 ELSE total END * fit[j] ELSE 0 END)), 1.0) AS sector FROM x),
impact AS (SELECT * FROM (SELECT news_id, symbol, direct, sector, score, 0.45 * direct + 0.35 * sector + 0.2 * score AS impact FROM y) WHERE impact >= 0.05)"""
IMPACT_COLUMNS = "news_id, symbol, round(impact, 6) AS impact, direct, round(sector, 6) AS sector, round(score, 6) AS score"


def _assets(spark):
    return spark.createDataFrame(ASSETS, "symbol string, name_en string, name_local string, sector string, industry string")


def _impact(spark, sf, f, k):
    a = _assets(spark)
    return rounded(f(_scores(spark, sf), tx.asset_mentions(tables.news(spark, sf), "news_id", a), tx.asset_fits(a, FITS), "news_id", k))


@query(f"WITH RECURSIVE {IMPACT} SELECT DISTINCT news_id, symbol FROM x WHERE direct = 1")
def asset_mentions(spark, sf):
    return tx.asset_mentions(tables.news(spark, sf), "news_id", _assets(spark))


@query(f"WITH RECURSIVE {IMPACT} SELECT {IMPACT_COLUMNS}, CAST(row_number() OVER (PARTITION BY news_id ORDER BY round(impact, 9) DESC, symbol) AS INT) AS rank FROM impact QUALIFY rank <= 10")
def ticker_impact(spark, sf):
    return _impact(spark, sf, tx.ticker_impact, 10)


@query(f"WITH RECURSIVE {IMPACT} SELECT {IMPACT_COLUMNS}, CAST(row_number() OVER (PARTITION BY news_id ORDER BY round(impact, 9) DESC, symbol) AS INT) AS rank FROM impact QUALIFY rank <= 2")
def ticker_impact_batch(spark, sf):
    return _impact(spark, sf, tx.ticker_impact, 2)


@query(f"WITH RECURSIVE {IMPACT} SELECT {IMPACT_COLUMNS}, CAST(row_number() OVER (PARTITION BY symbol ORDER BY round(impact, 9) DESC, news_id) AS INT) AS rank FROM impact QUALIFY rank <= 10")
def news_for_ticker(spark, sf):
    return _impact(spark, sf, tx.news_for_ticker, 10)


_exposure = ", ".join(f"round(max(CASE WHEN sem IS NULL THEN 0.7 * least({_found(w)} / 3, 1.0) + 0.3 * exp(-{DAYS} / 365) ELSE 0.4 * least({_found(w)} / 3, 1.0) + 0.4 * greatest(sem, 0) + 0.2 * exp(-{DAYS} / 365) END), 6) AS {t.lower()}" for t, w in THEMES.items())


@query(f"WITH {NEWS}, {SEM}, e AS (SELECT source, count(*) AS articles FROM news WHERE source IS NOT NULL GROUP BY source ORDER BY articles DESC, source LIMIT 20), n AS (SELECT news.*, sem, articles FROM news LEFT JOIN v USING (news_id) JOIN e USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY news_id) <= 30) SELECT source, articles, {_exposure} FROM n GROUP BY source, articles")
def thematic_exposure(spark, sf):
    x = tx.thematic_exposure(_with_similarity(spark, sf), "source", "news_id", THEMES, F.lit(AS_OF).cast("timestamp"), "sem")
    return rounded(x.toDF(*(c.lower() for c in x.columns)))


TOPIC_SQL = f"""{NEWS}, tw AS (SELECT DISTINCT item_id AS topic_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM benchmark), nw AS (SELECT news_id, greatest(length(text), 1) AS n, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM news),
tc AS (SELECT topic_id, news_id, count(*) / n AS score FROM nw JOIN tw USING (word) WHERE length(word) >= 5 GROUP BY topic_id, news_id, n)"""


def _topics(spark, sf):
    """Benchmark items as topics: their distinct words of five letters or more."""
    b = tables.table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("topic_id"), F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")), lambda w: F.length(w) >= 5).alias("words"))


@query(f"WITH {TOPIC_SQL} SELECT topic_id, news_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 12) DESC, news_id) AS INT) AS rank FROM tc QUALIFY rank <= 5")
def topic_doc_scores(spark, sf):
    return rounded(tx.topic_scores(tables.news(spark, sf), "news_id", _topics(spark, sf)), 9)


@query(f"WITH {TOPIC_SQL}, m AS (SELECT topic_id, max(score) AS score FROM tc GROUP BY topic_id) SELECT 'words' AS method, round(count(*) / (SELECT count(DISTINCT item_id) FROM benchmark), 6) AS hit_rate, round(avg(score), 6) AS top_score FROM m")
def method_hit_rate(spark, sf):
    t = _topics(spark, sf)
    return rounded(tx.hit_rates(tx.topic_scores(tables.news(spark, sf), "news_id", t).withColumn("method", F.lit("words")), t.select("topic_id").distinct().count()))


VEC = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
COS = "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9), 6)"


def _vectors(spark, sf):
    return tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _queries(spark, sf):
    return _vectors(spark, sf).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


@query(f"WITH {VEC} SELECT a.id AS query_id, b.id, {COS} AS score, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS INT) AS rank FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0 QUALIFY rank <= 10")
def similar_items(spark, sf):
    """The stated query set, ids divisible by 20, against all vectors."""
    return ve.nearest(_queries(spark, sf), _vectors(spark, sf), 10)


@query(f"WITH {VEC}, b AS (SELECT 1 AS id, list_transform(range(64), lambda i: 0.125::DOUBLE) AS v) SELECT a.id, {COS} AS score FROM v a, b ORDER BY score DESC, a.id LIMIT 10")
def semantic_search(spark, sf):
    q = F.array_repeat(F.lit(0.125), 64)
    return _vectors(spark, sf).select("id", F.round(ve.cosine(F.col("v"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query("WITH e AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM e GROUP BY label) SELECT label, CAST(i AS INT) AS i, round(x / (n + 1e-9), 6) + 0.0 AS x FROM e JOIN n USING (label)")
def mean_pool(spark, sf):
    p = ve.mean_pool(tables.table(spark, sf, "embeddings"), "label", "embedding")
    return rounded(p.select("label", F.posexplode("v").alias("i", "x")).withColumn("i", F.col("i") + 1))


PLANES = ve.normal_planes(1)[0]
BUCKET = " || ".join(f"CASE WHEN list_dot_product(v, {p!r}::DOUBLE[]) > 0 THEN '1' ELSE '0' END" for p in PLANES)
RINGS = f"""{VEC}, b AS (SELECT id, v, ({BUCKET}) AS bucket FROM v), pairs AS (SELECT a.id AS query_id, b.id, hamming(a.bucket, b.bucket) AS ring, a.v AS q, b.v AS w FROM b a CROSS JOIN b WHERE a.id % 20 = 0),
rings AS (SELECT query_id, ring, sum(count(*)) OVER (PARTITION BY query_id ORDER BY ring) - count(*) AS before FROM pairs GROUP BY query_id, ring), far AS (SELECT query_id, max(ring) AS far FROM rings WHERE before < 50 GROUP BY query_id),
near AS (SELECT query_id, id, list_dot_product(q, w) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(w, w)) + 1e-9) AS sim FROM pairs JOIN far USING (query_id) WHERE ring <= far AND id <> query_id)"""


@query(f"WITH {VEC} SELECT id, {BUCKET} AS bucket FROM v")
def lsh_build(spark, sf):
    return _vectors(spark, sf).select("id", ve.lsh_bucket(F.col("v")).alias("bucket"))


@query(f"WITH {VEC}, b AS (SELECT id, {BUCKET} AS bucket FROM v), c AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket) SELECT CAST(sum(n) AS BIGINT) AS vectors, count(*) AS buckets, round(avg(n), 6) AS mean_size, max(n) AS max_size FROM c")
def lsh_stats(spark, sf):
    b = lsh_build(spark, sf).groupBy("bucket").agg(F.count("*").alias("n"))
    return b.agg(F.sum("n").alias("vectors"), F.count("*").alias("buckets"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("max_size"))


def _index(spark, sf):
    index = _vectors(spark, sf).withColumn("bucket", ve.lsh_bucket(F.col("v")))
    return index.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "bucket"), index


@query(f"WITH {RINGS} SELECT query_id, id, round(sim, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, id) AS INT) AS rank FROM near QUALIFY rank <= 10")
def lsh_query(spark, sf):
    """One table, whose rings grow until there are fifty candidates; ``lsh_tables_query`` is the index with a recall above 0.9."""
    return ve.lsh_query(*_index(spark, sf), 10)


@query(f"WITH {NEWS}, {RINGS.replace('AS bucket FROM v)', 'AS bucket FROM v SEMI JOIN news ON news_id = id)')}, h AS (SELECT query_id, id, least({_m(WORDS)} / 3, 1.0) AS keyword, greatest(sim, 0) AS semantic, exp(-greatest({DAYS}, 0) / 365) AS time_decay FROM near JOIN news ON news_id = id) SELECT query_id, id, round(keyword, 6) AS keyword, round(semantic, 6) AS semantic, round(time_decay, 6) AS time_decay, round(0.3 * keyword + 0.5 * semantic + 0.2 * time_decay, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(0.3 * keyword + 0.5 * semantic + 0.2 * time_decay, 6) DESC, id) AS INT) AS rank FROM h QUALIFY rank <= 10")
def lsh_hybrid_query(spark, sf):
    news = tables.news(spark, sf).select(F.col("news_id").alias("id"), tx.keyword_match(F.col("text"), WORDS).alias("keyword"), tx.time_decay(F.lit(AS_OF).cast("timestamp"), F.col("publish_date")).alias("time_decay"))
    index = _vectors(spark, sf).withColumn("bucket", ve.lsh_bucket(F.col("v"))).join(news, "id")
    q = index.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "bucket")
    return rounded(ve.lsh_hybrid_query(q, index, 10, F.col("keyword"), F.col("time_decay")))


@query()
def lsh_tables_query(spark, sf):
    """The same neighbours from 40 tables of 12 normal planes each, codes of up to two other bits visited too."""
    return ve.lsh_nearest(_queries(spark, sf), _vectors(spark, sf), 10)


@query()
def lsh_tables_stats(spark, sf):
    """Sizes of the buckets of each table."""
    b = ve.lsh_codes(_vectors(spark, sf), "id", "v", 40).groupBy("table", "code").agg(F.count("*").alias("n"))
    return rounded(b.groupBy("table").agg(F.sum("n").alias("vectors"), F.count("*").alias("buckets"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size")))


@query()
def lsh_recall(spark, sf):
    """The share of each query's exact neighbours that ``lsh_tables_query`` finds, and the share of all other vectors that are its candidates."""
    share = ve.lsh_share(_queries(spark, sf), _vectors(spark, sf))
    found = ve.recall(similar_items(spark, sf), lsh_tables_query(spark, sf))
    return rounded(share.join(found, "query_id", "left").select("query_id", "recall", "candidate_share"))


@query()
def lsh_probe_query(spark, sf):
    """The ten nearest from codes that grow with the table, probed by distance to the planes; tests measure recall and candidates."""
    corpus = _vectors(spark, sf)
    return probing.search(_queries(spark, sf), corpus, probing.fit(corpus))


@query()
def lsh_probe_hybrid(spark, sf):
    """The ten best hybrid scores among the same index's candidates."""
    corpus = _vectors(spark, sf).join(tables.news(spark, sf).withColumnRenamed("news_id", "id"), "id")
    q = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return rounded(probing.hybrid(q, corpus, probing.fit(corpus.select("id", "v")), 10, tx.keyword_match(F.col("text"), WORDS), tx.time_decay(F.lit(AS_OF).cast("timestamp"), F.col("publish_date"))))


@query()
def lsh_probe_recall(spark, sf):
    """Recall and share of candidates of the probed index over all vectors."""
    corpus = _vectors(spark, sf)
    return rounded(probing.measured(_queries(spark, sf), corpus, probing.fit(corpus)))


@query(f"WITH {VEC}, d AS (SELECT id, list_dot_product(v, {PLANES[0]!r}::DOUBLE[]) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({PLANES[0]!r}::DOUBLE[], {PLANES[0]!r}::DOUBLE[])) + 1e-9) - list_dot_product(v, {PLANES[1]!r}::DOUBLE[]) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({PLANES[1]!r}::DOUBLE[], {PLANES[1]!r}::DOUBLE[])) + 1e-9) AS diff FROM v) SELECT CASE WHEN diff > 0.03 THEN 'POSITIVE' WHEN diff < -0.03 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label, count(*) AS n, round(avg(diff), 6) + 0.0 AS mean_diff FROM d GROUP BY 1")
def anchor_sentiment(spark, sf):
    return rounded(ve.anchor_sentiment(_vectors(spark, sf), PLANES[0], PLANES[1]).groupBy("label").agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff")))


@query("SELECT label, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY label")
def embedding_stats(spark, sf):
    return tables.table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query(f"""WITH {NEWS}, t AS (SELECT news_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM news), f AS (SELECT news_id, term, 1 + ln(count(*)) AS tf FROM t WHERE length(term) > 1 GROUP BY ALL),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM news)) / (1 + count(*))) + 1 AS idf FROM f GROUP BY term), w AS (SELECT news_id, term, tf * idf AS w FROM f JOIN i USING (term)) SELECT news_id, count(*) AS terms, round(max(w / n), 6) AS top FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY news_id)) AS n FROM w) GROUP BY news_id""")
def tfidf_terms(spark, sf):
    return rounded(latent.strongest(tables.news(spark, sf), "news_id"))


@query("SELECT doc_id AS news_id, array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = 1 OR l[i] <> l[i - 1] THEN l[i] END), lambda x: x IS NOT NULL), chr(10)) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)")
def consecutive_dedup_lines(spark, sf):
    return tx.consecutive_dedup_lines(tables.news(spark, sf), "news_id")


@query(f"WITH {NEWS}, v AS (SELECT vec_id AS news_id FROM embeddings) SELECT news_id, news_id IN (SELECT news_id FROM v) AS embedded FROM news")
def embedding_coverage(spark, sf):
    e = tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("news_id")).distinct()
    n = tables.news(spark, sf).select("news_id")
    return n.join(e, "news_id", "left_semi").withColumn("embedded", F.lit(True)).unionByName(n.join(e, "news_id", "left_anti").withColumn("embedded", F.lit(False)))


@query(f"WITH {NEWS}, t AS (SELECT unnest(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{{L}}\\p{{N}}_]+')) AS term, news_id FROM news), f AS (SELECT term, count(*) AS uses, count(DISTINCT news_id) AS docs FROM t WHERE length(term) > 1 GROUP BY term ORDER BY uses DESC, term LIMIT 2000) SELECT term, round(ln((1 + (SELECT count(*) FROM news)) / (1 + docs)) + 1, 6) AS idf FROM f")
def tfidf_vocabulary(spark, sf):
    """The model's terms, those that occur most, and their inverse document frequencies."""
    return rounded(latent.vocabulary(tables.news(spark, sf), 2000).select("term", "idf"))


@query()
def tfidf_svd_transform(spark, sf):
    """Vectors of the even news from a model of the odd ones, which is written and read again."""
    news, at = tables.news(spark, sf), shared.new(spark, "latent")
    latent.save(latent.fit(news.where("news_id % 2 = 1"), 2000, 32), at)
    return latent.transform(news.where("news_id % 2 = 0"), "news_id", latent.load(spark, at))


@query()
def tfidf_svd_embed(spark, sf):
    """Vectors of the news, 128 directions of 8000 terms; directions are unique up to their signs."""
    return latent.embed(tables.news(spark, sf), "news_id")
