"""Values that SQL does not check: distribution tests, causality, classes of instruments, landed payloads."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.operators import crosssection, distributions, jobs, latent, statements, text, vectors


@pytest.fixture(scope="module")
def series(spark):
    """White noise, a random walk, and a series that follows the noise by two days."""
    rng = np.random.default_rng(5)
    noise = rng.normal(0, 0.01, 400)
    walk, after = np.cumsum(rng.normal(0, 0.01, 400)), np.concatenate([rng.normal(0, 0.01, 2), noise[:-2]]) + rng.normal(0, 0.002, 400)
    rows = [(k, f"{2000 + i // 336:04d}-{i % 336 // 28 + 1:02d}-{i % 28 + 1:02d}", float(x)) for k, v in (("N", noise), ("W", walk), ("Z", after)) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "symbol string, day string, log_ret double").select("symbol", F.to_date("day").alias("trading_date"), "log_ret"), {"N": noise, "W": walk, "Z": after}


def test_kolmogorov_smirnov(series):
    df, values = series
    for r in distributions.ks_normal(df).collect():
        x = np.sort(values[r.symbol])
        phi = np.array([0.5 * math.erfc(-(v - x.mean()) / x.std(ddof=1) / math.sqrt(2)) for v in x])
        n = len(x)
        assert r.ks_stat == pytest.approx(max(np.max(np.arange(1, n + 1) / n - phi), np.max(phi - np.arange(n) / n)))
        assert r.ks_p == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * n * r.ks_stat**2) for k in range(1, 30)))


def test_dickey_fuller(series):
    got = {r.symbol: r for r in distributions.adf(series[0]).collect()}
    assert got["N"].adf_p < 0.001 and got["W"].adf_p > 0.05
    assert got["N"].is_stationary and got["Z"].is_stationary and not got["W"].is_stationary and got["N"].adf_stat < -10


def test_granger(series):
    df, v = series
    got = {(r.cause, r.effect): r for r in crosssection.granger(df.where("symbol <> 'W'")).collect()}
    y, x = v["Z"], v["N"]
    k = got["N", "Z"].lag
    past = lambda s: np.stack([s[k - i : len(s) - i] for i in range(1, k + 1)], 1)
    m = [np.hstack([np.ones((len(y) - k, 1)), past(y)]), np.hstack([np.ones((len(y) - k, 1)), past(y), past(x)])]
    short, full = (float(((y[k:] - a @ np.linalg.lstsq(a, y[k:], rcond=None)[0]) ** 2).sum()) for a in m)
    assert k >= 2 and got["N", "Z"].f == pytest.approx((short - full) / k / (full / (len(y) - 3 * k - 1))) and got["N", "Z"].significant
    assert got["N", "Z"].p < 1e-20 < got["Z", "N"].p


def test_student_quantiles():
    assert distributions.t_quantile(0.05, 5) == pytest.approx(-2.015048, abs=1e-5) and distributions.t_quantile(0.01, 3) == pytest.approx(-4.540703, abs=1e-5)


@pytest.mark.parametrize("kind,symbol,group,name,want", [
    ("STOCK", "VCB", None, None, "STOCK"), ("fu_index", "VN30F1M", None, None, "DERIVATIVE"), ("ETF", "E1VFVN30", None, None, "ETF"), ("CW", "CHPG2401", None, None, "DERIVATIVE"),
    ("UNIT_TRUST", "X", None, None, "FUND"), ("DEBENTURE", "X", None, None, "BOND"), ("INDEX", "VN30", None, None, "INDEX"), ("CORP BOND", "X", None, None, "BOND"), (None, "X", "HCX", None, "BOND"),
    (None, "X", "FIO", None, "DERIVATIVE"), ("", "X", None, "chứng quyền VCB", "DERIVATIVE"), (None, "41I1G2000", None, None, "DERIVATIVE"), (None, "CVCB2301", None, None, "DERIVATIVE"), (None, "ABC", None, None, "STOCK"),
])
def test_asset_class(spark, kind, symbol, group, name, want):
    d = spark.createDataFrame([(kind, symbol, group, name)], "k string, s string, g string, n string")
    assert d.select(sc.asset_class(F.col("k"), F.col("s"), F.col("g"), F.col("n")).alias("x")).first().x == want


def test_scalars(spark):
    d = spark.createDataFrame([("abc", "Nguyễn & Co", "[1.5, 2]")], "a string, b string, v string")
    r = d.select(sc.clean_decimal(F.col("a")).alias("bad"), sc.clean_decimal_nullable(F.col("a")).alias("null"), sc.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("zero"), sc.parse_vec(F.col("v")).alias("v"), sc.metadata_json(x=F.lit(1), y=F.lit(None).cast("string")).alias("m")).first()
    assert (r.bad, r.null, r.zero, r.v, r.m) == (0.0, None, None, [1.5, 2.0], '{"x":1}')
    assert d.select(sc.vec_literal(F.array(F.lit(1.0), F.lit(2.0))).alias("x")).first().x == "[1.0,2.0]"
    keep = spark.createDataFrame([("cash and bank", True), ("cashier", False)], "l string, want boolean")
    assert all(r.x == r.want for r in keep.select("want", sc.contains_keyword(F.col("l"), "and").alias("x")).collect())
    assert jobs.symbol_basket(" vcb, fpt,", {}) == ["VCB", "FPT"] and jobs.symbol_basket("vn30", {"VN30": ["A", "B"]}) == ["A", "B"]


def test_dividends_and_conform(spark):
    e = spark.createDataFrame([("A", 13, "5", "2024-05-01", None), ("A", 15, "10:3", None, "2024-06-01"), ("A", 99, "5", None, None)], "ticker string, channel_id int, rate string, exright_date string, record_date string")
    e = e.withColumn("exright_date", F.to_date("exright_date")).withColumn("record_date", F.to_date("record_date"))
    got = {(r.cash_dividend_percentage, r.stock_dividend_percentage, r.cash_year) for r in statements.dividends(e).collect()}
    assert got == {(5.0, 0.0, 2024), (0.0, 30.0, 2024)}
    c = statements.conform(spark.createDataFrame([("1", "x")], "a string, b string"), {"a": "int", "z": "double"}).first()
    assert (c.a, c.z) == (1, None)


def test_chunks_by_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "a. ", "b? ", "c! ", "\n", "longerword"]) for _ in range(rng.randint(0, 600))) for _ in range(30)]

    def spec(t):
        out, start = [], 0
        while start < len(t):
            end = min(start + 512, len(t))
            if end < len(t):
                for x in text.SEPARATORS:
                    places = [i for i in range(start + 256, end - len(x) + 1) if t.startswith(x, i)]
                    if places:
                        end = places[-1] + len(x)
                        break
            out += [t[start:end].strip()] if t[start:end].strip() else []
            start = len(t) if end >= len(t) else end - 64
        return out

    got = text.with_chunks(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")).collect()
    assert all(r.chunks == spec(texts[r.id]) for r in got)


def test_rings_grow_to_fifty(spark):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(600)], "id int, v array<double>").withColumn("bucket", vectors.lsh_bucket(F.col("v")))
    q = d.where("id < 5").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "bucket")
    code = {r.id: int(r.bucket, 2) for r in d.collect()}
    got = {}
    for r in vectors.lsh_rings(q, d, 10).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    for k, ids in got.items():
        far = max((code[k] ^ code[i]).bit_count() for i in ids)
        assert ids == {i for i in code if (code[k] ^ code[i]).bit_count() <= far} and len(ids) >= 50
        assert sum((code[k] ^ c).bit_count() < far for c in code.values()) < 50


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(5)
    q = d.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = {(r.query_id, r.rank): r.id for r in vectors.nearest(q, d, 3, block=7).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(0, 300, 10):
        s = np.round(u @ u[i], 6)
        s[i] = -9
        assert [got[i, k] for k in (1, 2, 3)] == sorted(range(300), key=lambda j: (-s[j], j))[:3]


def test_svd_keeps_the_similarities(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(25)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(3, 20)))) for i in range(40)] + [(99, "")]
    d = spark.createDataFrame(docs, "id int, text string")
    m = np.zeros((40, 25))
    for r in latent.tfidf(d, "id").collect():
        m[r.id, words.index(r.term)] = r.weight
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    for k in (5, 25):
        model = latent.fit(d, 100, k)
        got = {r.id: np.array(r.v) for r in latent.transform(d, "id", model).collect()}
        x = u[:, :k] * s[:k]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert set(got) == set(range(40)) and np.allclose([[got[i] @ got[j] for j in range(40)] for i in range(40)], x @ x.T, atol=1e-6)


def test_model_transforms_new_texts(spark, tmp_path):
    """A stored model, applied to texts it has not seen: their weights times the right vectors; other partitions give the same."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    old = spark.createDataFrame([(i, text(rng.randint(5, 30))) for i in range(80)], "id long, text string")
    new = [(100, "Caf\u00e9 cafe\u0301 " + text(8)), (101, "unknown zzzz"), (102, None), (103, words[0] + " " + words[0])]
    latent.save(latent.fit(old, 50, 8), str(tmp_path / "model"))
    model = latent.load(spark, str(tmp_path / "model"))
    assert model.count() == 50 and model.where("size(v) = 8").count() == 50
    table = {r.term: (r.idf, np.array(r.v)) for r in model.collect()}
    v = np.stack([x for _, x in table.values()])
    np.testing.assert_allclose(v.T @ v, np.eye(8), atol=1e-8)
    frame = spark.createDataFrame(new, "id long, text string")
    for parts in (1, 4):
        got = {r.id: np.array(r.v) for r in latent.transform(frame.repartition(parts), "id", model).collect()}
        want = {}
        for i, x in new:
            n = collections.Counter(w for w in (x or "").replace("\u00e9", "e").replace("e\u0301", "e").lower().split() if w in table)
            y = sum(((1 + np.log(c)) * table[w][0] * table[w][1] for w, c in n.items()), np.zeros(8))
            if n:
                want[i] = y / np.linalg.norm(y)
        assert set(got) == set(want)
        for i in want:
            np.testing.assert_allclose(got[i], want[i], atol=1e-6)


def test_adf_p_values(spark):
    """The published critical values of long series at three levels, and the ends of the surface."""
    stats = [(-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10), (-20.0, 0.0), (3.0, 1.0), (None, None), (float("nan"), None)]
    d = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(stats)], "i int, s double").withColumn("p", distributions.adf_p(F.col("s")))
    for r in d.collect():
        want = stats[r.i][1]
        assert r.p is None if want is None else abs(r.p - want) < 1e-3
    # falling steadily over the break of the two polynomials
    p = [r.p for r in spark.range(-60, 30).select((F.col("id") / 10).alias("s")).select("s", distributions.adf_p(F.col("s")).alias("p")).orderBy("s").collect()]
    assert all(a <= b + 1e-3 for a, b in zip(p, p[1:]))


def test_lines_are_trimmed_of_spaces_only(spark):
    """A line's digits stay, spaces of any kind around it go, and lines that then equal the one before."""
    rows = [(1, "0 zero\n1 one 1\n 1 one 1 \n\n　 1 one 1\n2\ttab\t\n2\ttab \r"), (2, "00\n11\n22"), (3, ""), (4, " \n ")]
    got = {r.k: r.text for r in text.consecutive_dedup_lines(spark.createDataFrame(rows, "k int, text string"), "k").collect()}
    assert got == {1: "0 zero\n1 one 1\n2\ttab\t\n2\ttab \r", 2: "00\n11\n22", 3: "", 4: ""}


def _brute(v, q, k, near=lambda i, j: True):
    """Query, id, rank and score of the k nearest, ties by id."""
    cos = np.round((v[q] @ v.T) / (np.outer(np.linalg.norm(v[q], axis=1), np.linalg.norm(v, axis=1)) + 1e-9), 6)
    return {(i, n + 1): (j, s) for a, i in enumerate(q) for n, (s, j) in enumerate(sorted(((-cos[a, j], j) for j in range(len(v)) if j != i and near(i, j)))[:k]) for s in [-s]}


def test_searches_meet_by_blocks(spark):
    """Copies and near ties come by their ids; no row carries a block of queries, and no pair of vectors is joined."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(240, 64))
    v[100:140], v[140:150] = v[7], v[8] * 2
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").withColumn("bucket", vectors.lsh_bucket(F.col("v"))).repartition(3)
    q = d.where("id in (7, 8, 100, 145, 200)").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "bucket")
    ask = [7, 8, 100, 145, 200]
    planes = np.array(vectors.normal_planes(4))
    bits = np.einsum("nw,tbw->ntb", v, planes) > 0
    one = (v @ np.array(vectors.normal_planes(1)[0]).T > 0) @ (1 << np.arange(11, -1, -1))
    ring = np.bitwise_count(one[:, None] ^ one[None, :])
    far = {i: min(r for r in range(13) if (ring[i] <= r).sum() >= 50) for i in ask}
    for got, near in (
        (vectors.nearest(q, d, 10, block=2), lambda i, j: True),
        (vectors.lsh_nearest(q, d, 10, tables=4, radius=1), lambda i, j: bool(((bits[i] != bits[j]).sum(1) <= 1).any())),
        (vectors.lsh_query(q, d, 10), lambda i, j: ring[i, j] <= far[i]),
    ):
        want, rows = _brute(v, ask, 10, near), got.collect()
        assert {(r.query_id, r["rank"]): r.id for r in rows} == {k: x[0] for k, x in want.items()}
        assert all(r.score == pytest.approx(want[r.query_id, r["rank"]][1], abs=1e-6) for r in rows)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "collect_list" not in plan


def test_words_are_counted_where_texts_are_read(spark):
    """Rows with one key count together; no word of a text is shuffled to be counted, and terms beyond the frequent ones have their weights too."""
    rows = [(1, "alpha beta gamma"), (2, "beta beta delta"), (2, "delta omega"), (3, ""), (4, None), (5, "gamma omega zeta")]
    d = spark.createDataFrame(rows, "id int, text string")
    t = spark.createDataFrame([("a", ["beta", "delta"]), ("b", ["omega"]), ("c", ["none"])], "topic_id string, words array<string>")
    got = text.topic_scores(d, "id", t, 2)
    assert {(r.topic_id, r["rank"], r.id, round(r.score, 6)) for r in got.collect()} == {("a", 1, 2, 0.2), ("a", 2, 2, round(1 / 11, 6)), ("b", 1, 2, round(1 / 11, 6)), ("b", 2, 5, 0.0625)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Aggregate [id" not in plan.split("MapInArrow")[0]
    want = {(r.id, r.term): r.weight for r in latent.tfidf(d, "id").collect()}
    assert {k for k, _ in want} == {1, 2, 5} and sum(w * w for (k, _), w in want.items() if k == 2) == pytest.approx(1)
    few, latent.FREQUENT = latent.FREQUENT, 2
    try:
        assert {(r.id, r.term): r.weight for r in latent.tfidf(d, "id").collect()} == pytest.approx(want)
    finally:
        latent.FREQUENT = few


def test_tasks_hold_slices_of_a_batch():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([["a"] * n for n in (3, 4, 0, 20, 1, 1, 0)])], ["t"])
    cut = [x.column("t").to_pylist() for x in latent._slices(iter([b, b.slice(0, 0)]), 8)]
    assert [[len(t) for t in x] for x in cut] == [[3, 4, 0], [20], [1, 1, 0]]


def test_words_without_accents(spark):
    """Accents taken from the distinct words give the words of texts without accents, for every character and its neighbours. The sign of
    the Ångström (U+212B), whose lower case is a letter with an accent, loses it too, as in DuckDB's strip_accents."""
    c = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    some = spark.range(1, 0x30000).where("id NOT BETWEEN 55296 AND 57343 AND id <> 8491").select(F.concat(F.lit("xA"), c, F.lit("b "), c, F.lit("1 ΑΣ"), c, F.lit(" İé"), c).alias("text"))
    old = some.select(F.explode(F.split(F.lower(sc.strip_accents(F.col("text"))), r"[^\p{L}\p{N}_]+")).alias("w")).where("w <> ''").groupBy("w").count()
    names, _, place, n = latent._counts(latent._tokens(some).toArrow().column("t").combine_chunks(), bare=True)
    got = collections.Counter()
    for i, x in zip(place.tolist(), n.tolist()):
        got[names[i].as_py()] += x
    got.pop("", None)
    assert got == {r[0]: r[1] for r in old.collect()}
    import pyarrow as pa

    assert latent._bare(pa.array(["\u212b".lower(), "plain"])).to_pylist() == ["a", "plain"]


def test_embed_is_fit_and_transform(spark, monkeypatch):
    """The same vectors, and texts are weighed once."""
    d = spark.createDataFrame([(i, " ".join(f"wörd{(i * j) % 17}" for j in range(1, 9))) for i in range(40)] + [(98, ""), (99, None)], "id long, text string")
    want = {r.id: np.array(r.v) for r in latent.transform(d, "id", latent.fit(d, 12, 4)).collect()}
    calls, weigh = [], latent.weights
    monkeypatch.setattr(latent, "weights", lambda *a: calls.append(1) or weigh(*a))
    got = {r.id: np.array(r.v) for r in latent.embed(d, "id", 12, 4).collect()}
    assert calls == [1] and got.keys() == want.keys() and 98 not in got
    for i in got:
        assert np.abs(got[i]) == pytest.approx(np.abs(want[i]), abs=1e-5)
    assert latent.embed(d.where("id >= 98"), "id", 12, 4).count() == 0
