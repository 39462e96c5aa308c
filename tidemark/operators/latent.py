"""Texts as vectors: term weights and their strongest directions, fitted once and applied to any texts.

The directions are found by block power iterations: the matrix of weights stays in its rows, each task multiplies its rows
with a block of directions and hands on one partial product, and the driver makes the sum orthogonal to the blocks before (the
blocks of all rounds together, a Krylov space, hold the answer after some), until the directions have settled. Tasks hold terms x
directions, the driver as much for each of the rounds it holds, whatever the number of texts. A model is a table of as many rows as terms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import BARE
from ..sources.shared import cut

#: Directions of a block: smaller ones need fewer in all, and more rounds. Directions beyond those asked for and how many times as many the driver holds.
BLOCK, MORE, HELD = 64, 10, 8
#: The residual, relative to the largest strength, at which rounds end, and the rounds after which directions that have not settled are an error.
SETTLED, ROUNDS = 1e-4, 200

#: Terms, those used most, whose weights are multiplied as a matrix, and its rows; those of the others are multiplied one by one.
OFTEN, AT_ONCE = 1024, 1024


#: Terms whose inverse document frequencies go to all tasks, those that most texts have; the others are joined.
FREQUENT = 1 << 16


def once(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and text, where rows with equal keys, if there are any, have become one with all their texts. Whether there are, the first key tells."""
    if docs.groupBy(keys[0]).count().where("count > 1").isEmpty():
        return docs.select(*keys, "text")
    return docs.groupBy(*keys).agg(F.array_join(F.collect_list("text"), "\n").alias("text"))


def tfidf(docs: DataFrame, key: str) -> DataFrame:
    """The ``raw`` weights, those of a text of length one: key, term, weight. A weight is shuffled once, for the length of its text."""
    w = raw(docs, key)
    return w.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).select(key, "term", "weight")


def strongest(docs: DataFrame, key: str) -> DataFrame:
    """key, terms (how many) and top, the highest weight that ``tfidf`` gives one of them: added up before anything is shuffled."""
    return raw(docs, key).groupBy(key).agg(F.count("*").alias("terms"), (F.max("w") / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("top"))


def raw(docs: DataFrame, key: str) -> DataFrame:
    """Sublinear term weights with smooth inverse document frequency: key, term, w. Rows with one key are one text.

    Terms are counted where the text is read, texts of a term added up by batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            words, text, word, n = _counts(b.column("t"))
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(text)), words.take(pa.array(word)), pa.array(n.astype(np.int64))], [key, "term", "n"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            words, _, word, _ = _counts(b.column("t"))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(word, minlength=len(words)).astype(np.int64))], ["term", "df"])

    n = docs.agg(F.count("*").alias("docs"))
    t = once(docs, key).select(key, F.coalesce(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), F.array()).alias("t"))
    df = t.select("t").mapInArrow(texts, "term string, df long").where(F.length("term") > 1).groupBy("term").agg(F.sum("df").alias("df")).join(F.broadcast(n))
    idf = cut(df.select("term", "df", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf")))
    top = cut(idf.orderBy(F.desc("df"), "term").limit(FREQUENT).select("term", F.col("idf").alias("frequent")))
    tf = t.mapInArrow(count, f"{key} {docs.select(key).schema[0].dataType.simpleString()}, term string, n long").where(F.length("term") > 1)
    tf = tf.select(key, "term", (1 + F.log("n")).alias("tf")).join(F.broadcast(top), "term", "left")
    w = tf.where("frequent IS NOT NULL").select(key, "term", (F.col("tf") * F.col("frequent")).alias("w"))
    return w.unionByName(tf.where("frequent IS NULL").join(idf.join(F.broadcast(top), "term", "left_anti"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w")))


def _tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and t, the words of each text, with their accents, which ``_bare`` takes from the distinct ones: marks stay in words here."""
    return docs.select(*keep, F.coalesce(F.split(F.lower("text"), r"[^\p{L}\p{N}\p{Mn}_]+"), F.array()).alias("t"))


def _bare(words: pa.Array) -> pa.Array:
    """Lower-case words without accents, as ``strip_accents`` does it before a text is lowered and split. All marks in them are accents."""
    table = str.maketrans(BARE)
    accented = pc.invert(pc.string_is_ascii(words))
    plain = ["".join(c for c in w.translate(table) if unicodedata.category(c)[0] != "M") for w in words.filter(accented).to_pylist()]
    return pc.replace_with_mask(words, accented, pa.array(plain, words.type))


def _slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most about ``most`` words of ``t``, or one text: what a task holds does not grow with the rows of a batch."""
    for b in batches:
        ends, at = b.column("t").offsets.to_numpy(), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def _counts(tokens: pa.Array, bare: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a batch's texts, without accents if ``bare``, and of each word of a text: the text, the word's place among them, how often."""
    words = tokens.flatten().dictionary_encode()
    if bare:
        merged = _bare(words.dictionary).dictionary_encode()
        words = pa.DictionaryArray.from_arrays(merged.indices.take(words.indices), merged.dictionary)
    text = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
    many = max(1, len(words.dictionary))
    pairs, n = np.unique(text * many + words.indices.to_numpy(), return_counts=True)
    return words.dictionary, pairs // many, pairs % many, n


def vocabulary(docs: DataFrame, terms: int = 8000) -> DataFrame:
    """term, i and idf of the ``terms`` words that occur most, without accents. Each batch of texts hands on its sums by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            words, _, word, n = _counts(b.column("t"), bare=True)
            uses, df = np.zeros(len(words), np.int64), np.bincount(word, minlength=len(words))
            np.add.at(uses, word, n)
            yield pa.RecordBatch.from_arrays([words, pa.array(uses), pa.array(df.astype(np.int64))], ["term", "uses", "df"])

    n = docs.agg(F.count("*").alias("docs"))
    each = _tokens(docs).mapInArrow(count, "term string, uses long, df long").where(F.length("term") > 1).groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("df").alias("df"))
    top = each.orderBy(F.desc("uses"), "term").limit(terms).join(F.broadcast(n))
    i = (F.row_number().over(Window.orderBy(F.desc("uses"), "term")) - 1).alias("i")  # at most ``terms`` rows
    return top.select("term", i, (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(docs: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """key, i and w: the indices and weights of a text's terms that the model (term, i, idf) has, of length one, computed where the text
    is read. Texts without any have no row. The model's terms, see ``vocabulary``, go to all tasks."""
    shared = docs.sparkSession.sparkContext.broadcast({r["term"]: (r["i"], r["idf"]) for r in model.select("term", "i", "idf").collect()})
    kind = docs.select(key).schema[0].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            words, text, word, n = _counts(b.column("t"), bare=True)
            known = [shared.value.get(x, (-1, 0.0)) for x in words.to_pylist()]
            place, idf = np.array([x[0] for x in known], np.int32), np.array([x[1] for x in known])
            mine = place[word] >= 0
            text, word, n = text[mine], word[mine], n[mine]
            order = np.lexsort((place[word], text))
            text, word, n = text[order], word[order], n[order]
            w = (1 + np.log(n)) * idf[word]
            w /= np.sqrt(np.bincount(text, w * w, minlength=b.num_rows))[text]
            has, sizes = np.unique(text, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(has)), pa.ListArray.from_arrays(ends, pa.array(place[word])), pa.ListArray.from_arrays(ends, pa.array(w))], [key, "i", "w"])

    return _tokens(docs, key).mapInArrow(weigh, f"{key} {kind}, i array<int>, w array<double>")


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and weight of the entries of a batch."""
    sizes = np.diff(b.column("i").offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), sizes), b.column("i").flatten().to_numpy(), b.column("w").flatten().to_numpy()


def _sums(to: np.ndarray, v: np.ndarray, at: np.ndarray, w: np.ndarray, out: np.ndarray) -> None:
    """Adds ``v[at] * w`` to the rows ``to`` of ``out``; ``to`` ascends."""
    step = max(1, (1 << 17) // v.shape[1])  # what stays in a core's cache
    for s in range(0, len(to), step):
        t = to[s : s + step]
        first = np.flatnonzero(np.diff(t, prepend=-1))
        out[t[first]] += np.add.reduceat(v[at[s : s + step]] * w[s : s + step, None], first)


def _project(b: pa.RecordBatch, v: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """Rows times directions. If there is a ``total``, the rows' terms times these are added to it."""
    row, term, w = _rows(b)
    out, often = np.zeros((b.num_rows, v.shape[1])), term < OFTEN
    (row, term, w), (r, t, u) = ([x[m] for x in (row, term, w)] for m in (~often, often))
    for at in range(0, b.num_rows, AT_ONCE):
        y, x = out[at : at + AT_ONCE], np.zeros((min(AT_ONCE, b.num_rows - at), min(OFTEN, len(v))))
        of, other = (slice(*np.searchsorted(a, (at, at + AT_ONCE))) for a in (r, row))
        x[r[of] - at, t[of]] = u[of]
        np.matmul(x, v[:OFTEN], out=y)
        _sums(row[other], v, term[other], w[other], out)
        if total is not None:
            total[:OFTEN] += x.T @ y
    if total is not None:
        order = np.argsort(term, kind="stable")
        _sums(term[order], out, row[order], w[order], total)
    return out


def _gram_times(rows: DataFrame, v: np.ndarray) -> np.ndarray:
    """The weights' Gram matrix times ``v``."""
    shared = rows.sparkSession.sparkContext.broadcast(v)
    step = max(1, (1 << 20) // (8 * v.shape[1]))  # terms of a piece: partial products are added up by pieces, in as many tasks

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total = np.zeros_like(v)
        for b in batches:
            _project(b, v, total)
        starts = range(0, len(v), step)
        yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int64()), pa.array([total[s : s + step].tobytes() for s in starts], pa.binary())], ["piece", "y"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"piece": t.column("piece")[:1], "y": pa.array([sum(np.frombuffer(y.as_buffer()) for y in t.column("y")).tobytes()], pa.binary())})

    parts = rows.mapInArrow(partial, "piece long, y binary").groupBy("piece").applyInArrow(add, "piece long, y binary").collect()
    out = np.zeros_like(v)
    for r in parts:
        y = np.frombuffer(r["y"]).reshape(-1, v.shape[1])
        out[r["piece"] : r["piece"] + len(y)] = y
    shared.destroy()
    return out


def fit(docs: DataFrame, terms: int = 8000, k: int = 128, seed: int = 42) -> DataFrame:
    """A model of the texts: term, i, idf and v, the term's part in each of the (at most ``k``) strongest directions, strongest first."""
    words = cut(vocabulary(docs, terms))
    v = _directions(cut(weights(docs.select(F.monotonically_increasing_id().alias("doc"), "text"), "doc", words)), words.count(), k, seed)
    if not len(v):
        return words.withColumn("v", F.array().cast("array<double>"))
    known = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "i int, v array<double>")
    return cut(words.join(known, "i").select("term", "i", "idf", "v"))


def _directions(rows: DataFrame, m: int, k: int, seed: int) -> np.ndarray:
    """The (at most ``k``) strongest directions of the ``weights`` of all texts in ``m`` terms, terms x directions.

    Rounds go on until the directions have settled. When the driver holds as many as it may, it goes on from the best that are in them.
    Tasks are no more than the cores, and fewer where a task's partial product would outweigh its texts."""
    if not m:
        return np.zeros((0, 0))
    d, most = min(m, BLOCK), max(BLOCK, HELD * (k + MORE))
    most = m if m < most + d else most
    basis, image, inner, n = np.empty((m, most), order="F"), np.empty((m, most), order="F"), np.zeros((most, most)), 0
    rows = rows.coalesce(max(1, min(rows.sparkSession.sparkContext.defaultParallelism, 4 * rows.count() // m)))
    v, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, d)))
    for _ in range(ROUNDS):
        end = n + v.shape[1]
        basis[:, n:end], image[:, n:end] = v, _gram_times(rows, v)
        inner[:end, n:end] = basis[:, :end].T @ image[:, n:end]
        inner[n:end, :end] = inner[:end, n:end].T
        n = end
        strength, turn = np.linalg.eigh(inner[:n, :n])
        strength, turn = strength[::-1], np.ascontiguousarray(turn[:, ::-1])
        if n >= min(k, m):
            found = basis[:, :n] @ turn[:, :k]
            rest = np.linalg.norm(image[:, :n] @ turn[:, :k] - found * strength[:k], axis=0).max()
            if rest <= SETTLED * max(strength[0], 1e-300) or n == m:
                return found
        v = image[:, n - v.shape[1] : n]
        for _ in range(2):  # once more, for the digits
            v, _r = np.linalg.qr(v - basis[:, :n] @ (basis[:, :n].T @ v))
        v = v[:, : m - n]
        if n + v.shape[1] > most:
            for x in (basis, image):
                x[:, : k + MORE] = x[:, :n] @ turn[:, : k + MORE]
            n = k + MORE
            inner[:n, :n] = np.diag(strength[:n])
    raise ValueError(f"the directions have not settled after {ROUNDS} rounds: {rest / strength[0]:.1e}")


def save(model: DataFrame, path: str) -> None:
    model.coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def transform(docs: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """key and v, of length one, of texts that have any of the model's terms; the model, terms x directions, goes to all tasks."""
    known = model.select("i", "v").collect()
    table = np.zeros((len(known), len(known[0]["v"]) if known else 0))
    for r in known:
        table[r["i"]] = r["v"]
    return _placed(weights(docs, key, model), key, table)


def embed(docs: DataFrame, key: str, terms: int = 8000, k: int = 128, seed: int = 42) -> DataFrame:
    """``transform`` of the texts by the model that ``fit`` makes of them: their weights, computed once, serve both."""
    words = cut(vocabulary(docs, terms))
    rows = cut(weights(docs, key, words))
    return _placed(rows, key, _directions(rows, words.count(), k, seed))


def _placed(rows: DataFrame, key: str, table: np.ndarray) -> DataFrame:
    """key and v of each row of ``weights``, by the model's terms x directions."""
    if not len(table):
        return rows.limit(0).select(key, F.array().cast("array<double>").alias("v"))
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _project(b, shared.value)
            y /= np.linalg.norm(y, axis=1, keepdims=True) + 1e-9
            offsets = np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(offsets, y.ravel())], [key, "v"])

    kind = rows.select(key).schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, v array<double>")
