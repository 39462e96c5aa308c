"""Jobs that were once done in part: each test fails on the part alone."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.operators import latent, text, vectors
from tidemark.plans import loads, texts
from tidemark.sources import tables


def test_planes_have_full_rank():
    assert all(np.linalg.matrix_rank(np.array(t)) == 12 for t in vectors.normal_planes(40))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_lsh_recall(spark, sf):
    r = [x.recall for x in texts.lsh_recall(spark, f"/root/testdata/{sf}").collect()]
    assert len(r) == 25 and np.mean(r) >= 0.9


@pytest.mark.parametrize("raw,unit,date", [("788918400000", "ms", dt.date(1995, 1, 1)), ("788918400", "s", dt.date(1995, 1, 1)), ("788918400", "ms", dt.date(1970, 1, 10)), ("9" * 30, "ms", None), ("/Date(788918400000)/", "s", dt.date(1995, 1, 1)), ("not-a-date", "ms", None)])
def test_unit_of_numeric_dates(spark, raw, unit, date):
    d = spark.createDataFrame([(raw,)], "a string")
    assert d.select(sc.parse_mixed_date(F.col("a"), unit).alias("x")).first().x == date


def test_no_row_is_left_out(spark):
    sf = "/root/testdata/sf0.001"
    out = loads.parse_mixed_date_all(spark, sf).groupBy("d").count().collect()
    assert sum(r["count"] for r in out) == spark.read.parquet(f"{sf}/orders.parquet").count() and any(r.d is None for r in out)
    assert loads.periodic_statements_all(spark, sf).count() == 2 * spark.read.parquet(f"{sf}/customer.parquet").count()


def test_weights_at_their_best_threshold(spark):
    rng = np.random.default_rng(3)
    rows = [(*map(float, rng.random(3) / 5), int(y)) for y in rng.random(80) < 0.4]
    got = {(r.wk, r.ws, r.wt): r for r in text.weight_search(spark.createDataFrame(rows, "k double, s double, t double, y int"), "k", "s", "t", "y").collect()}
    x, y = np.array(rows)[:, :3], np.array(rows)[:, 3] == 1
    assert len(got) == 66
    for w, r in got.items():
        s = (w[0] * x[:, 0] + w[1] * x[:, 1] + w[2] * x[:, 2]) / 10
        f1 = [2 * (y & (s > t)).sum() / (y.sum() + (s > t).sum()) for t in np.linspace(0, s.max() + 1e-6, 40)]
        assert r.f1 == pytest.approx(max(f1)) and f1[r.step] == pytest.approx(max(f1))


def test_recall_comes_with_the_share_of_candidates(spark):
    """Candidates of every query against all pairs of codes; of fewer neighbours than asked for all count, and a query without any keeps its row."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(120, 64))
    v[50:60] = v[3]
    code = (np.einsum("nw,tbw->ntb", v, np.array(vectors.normal_planes(5))) > 0) @ (1 << np.arange(12))
    near = (np.bitwise_count(code[:, None] ^ code[None, :]) <= 2).any(2)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    q = d.where("id % 20 = 0 OR id = 3").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = {r.query_id: r.candidate_share for r in vectors.lsh_share(q, d, 5).collect()}
    assert got == {i: pytest.approx((near[i].sum() - 1) / 119) for i in (0, 3, 20, 40, 60, 80, 100)} and got[3] >= 10 / 119
    few = d.where("id < 4")
    exact = vectors.nearest(q, few, 10)
    assert {r.query_id: r.recall for r in vectors.recall(exact, exact).collect()}[0] == 1
    assert {r.query_id: r.recall for r in vectors.recall(exact, exact.where("rank > 1")).collect()}[0] == pytest.approx(2 / 3)
    assert [tuple(r) for r in vectors.lsh_share(q.where("query_id = 0"), d.where("id = 0"), 5).collect()] == [(0, None)]


def test_lsh_recall_tells_what_it_visits(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = texts.lsh_recall(spark, sf).collect()
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(v)
    code = (np.einsum("nw,tbw->ntb", np.array([v[i] for i in ids]), np.array(vectors.normal_planes(40))) > 0) @ (1 << np.arange(12))
    for r in rows[:5]:
        hit = (np.bitwise_count(code ^ code[ids.index(r.query_id)]) <= 2).any(1)
        assert r.candidate_share == pytest.approx((hit.sum() - 1) / (len(ids) - 1), abs=1e-6)
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 4").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = (np.bitwise_count(code[ids.index(0)] ^ code[[ids.index(i) for i in (1, 2, 3)]]) <= 2).any(1).mean()  # of three neighbours
    assert [tuple(r) for r in texts.lsh_recall(spark, str(tmp_path)).collect()] == [(0, pytest.approx(found, abs=1e-6), pytest.approx(found, abs=1e-6))]


def _weights(rows, m):
    """The keys of ``latent.weights`` and its matrix."""
    out, rows = np.zeros((len(rows), m)), sorted(rows)
    for x, r in zip(out, rows):
        x[r.i] = r.w
    return [r[0] for r in rows], out


def test_embed_has_all_terms_and_directions(spark):
    """The vectors of a table of texts are those of 128 directions of 8000 terms."""
    sf = "/root/testdata/sf0.001"
    news = tables.news(spark, sf)
    got = {r.news_id: np.array(r.v) for r in texts.tfidf_svd_embed(spark, sf).collect()}
    keys, m = _weights(latent.weights(news, "news_id", latent.vocabulary(news, 8000)).collect(), 8000)
    assert sorted(got) == keys and {len(v) for v in got.values()} == {128} and (m.sum(0) > 0).all()
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    x = u[:, :128] * s[:128]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([got[i] for i in keys])
    np.testing.assert_allclose(y @ y.T, x @ x.T, atol=1e-5)


@pytest.fixture(scope="module")
def flat(spark):
    """Random texts, whose directions are of much the same strength, and their weights as a matrix."""
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 500, rng.integers(3, 12)))) for i in range(700)], "id long, text string").cache()
    words = latent.vocabulary(d, 500)
    return d, _weights(latent.weights(d, "id", words).collect(), words.count())[1]


def _residual(model, m):
    v = np.array([r.v for r in sorted(model.collect(), key=lambda r: r.i)])
    image = m.T @ (m @ v)
    np.testing.assert_allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-8)
    return np.linalg.norm(image - v * (v * image).sum(0), axis=0).max() / np.linalg.eigvalsh(m.T @ m)[-1], (v * image).sum(0)


def test_rounds_go_on_until_directions_settle(flat):
    d, m = flat
    rest, strength = _residual(latent.fit(d, 500, 20), m)
    assert rest <= 1.01e-4
    np.testing.assert_allclose(strength, np.linalg.eigvalsh(m.T @ m)[::-1][:20], rtol=1e-3)


def test_rounds_begin_again_from_the_best(flat, monkeypatch):
    """With room for few blocks the same directions; those that do not settle are an error."""
    d, m = flat
    monkeypatch.setattr(latent, "BLOCK", 8)
    monkeypatch.setattr(latent, "HELD", 2)
    rest, strength = _residual(latent.fit(d, 500, 20), m)
    assert rest <= 1.01e-4
    np.testing.assert_allclose(strength, np.linalg.eigvalsh(m.T @ m)[::-1][:20], rtol=1e-3)
    monkeypatch.setattr(latent, "ROUNDS", 4)
    with pytest.raises(ValueError, match="settled"):
        latent.fit(d, 500, 20)


@pytest.mark.parametrize("often,at_once", [(0, 3), (5, 3), (40, 100)])
def test_frequent_terms_as_a_matrix(often, at_once, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(latent, "OFTEN", often)
    monkeypatch.setattr(latent, "AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    m, v = (rng.random((10, 30)) < 0.3) * rng.random((10, 30)), rng.normal(size=(30, 4))
    m[4] = 0
    b = pa.RecordBatch.from_arrays([pa.array([np.flatnonzero(x).astype(np.int32) for x in m], pa.list_(pa.int32())), pa.array([x[x > 0] for x in m], pa.list_(pa.float64()))], ["i", "w"])
    total = np.ones((30, 4))
    np.testing.assert_allclose(latent._project(b, v, total), m @ v, atol=1e-12)
    np.testing.assert_allclose(total, 1 + m.T @ (m @ v), atol=1e-12)
    np.testing.assert_allclose(latent._project(b.slice(3, 5), v), m[3:8] @ v, atol=1e-12)
