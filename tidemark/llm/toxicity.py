"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, written in numpy.

A word's input is its own hashed embedding beside the mean of its hashed character trigrams' and fourgrams'. Windows
of ``WINDOW`` words that overlap by half are read in both directions by gated recurrent units; attention pools a
window's states into one log odds, and a document's score is that of its highest window. Labels belong to whole
documents, so training first takes any window of a toxic document as toxic, and then the one that the network itself
rates highest. All settings were chosen by cross-validation inside the documents that are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordstream import pieces, split

#: Words in a window, and between the starts of two; units of each direction; width of each embedding.
WINDOW, STRIDE, UNITS, WIDTH = 24, 12, 16, 8
#: Rows of the word and the character tables.
WORD_ROWS, GRAM_ROWS = 1 << 17, 1 << 17
#: Texts of the sample that a word must be in to have an embedding of its own.
COMMON = 8
#: The training sample: at most so many labelled documents of each class, and so much text in each half of it.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 2_000_000
#: Epochs on any window of a toxic text, and then on its highest; windows of a step; learning rates of the network and
#: of the tables; windows of an epoch besides each text's highest, and copies of a toxic one in it.
WARM, EPOCHS, BATCH, RATE, TABLE_RATE, OTHERS, COPIES = 6, 6, 128, 0.03, 0.5, 12000, 2
#: Share of the toxic windows in the loss; taken off the log odds of a text, which are the highest of many windows'.
POSITIVE, CALM = 0.25, 1.35

Params = dict[str, np.ndarray]


class Inputs:
    """Words of texts, as rows of the two embedding tables."""

    def __init__(self, texts: pa.Array):
        bare = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=r"[!-/:-@\[-`{-~]+", replacement=" ")  # marks part words
        self.codes, self.offsets, words = split(bare)
        data = [b"<" + w + b">" for w in words.cast(pa.binary()).to_pylist()]
        size = np.fromiter(map(len, data), np.int64, len(data))
        b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
        start = np.cumsum(size) - size
        word = np.repeat(np.arange(len(data)), size)
        place = np.arange(len(b)) - start[word] if len(data) else np.zeros(0, np.int64)
        hashed = lambda x, n: ((x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % n
        back = lambda k: np.concatenate([np.zeros(k, np.uint64), b[: max(0, len(b) - k)]])[: len(b)]
        three = b | back(1) << np.uint64(8) | back(2) << np.uint64(16)
        grams, owners = [], []
        for n, x in ((3, three), (4, three | back(3) << np.uint64(24))):
            full = place >= n - 1
            grams.append(hashed(x[full] + np.uint64(n << 40), GRAM_ROWS))
            owners.append(word[full])
        order = np.argsort(np.concatenate(owners), kind="stable")
        self.grams, self.owner = np.concatenate(grams)[order], np.concatenate(owners)[order]
        self.first = np.searchsorted(self.owner, np.arange(len(data) + 1))
        power = np.full(int(size.max()) + 1 if len(data) else 1, 0x100000001B3, np.uint64)
        power[:1] = 1
        power = np.multiply.accumulate(power)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * power[place], dtype=np.uint64)])
        self.word_row = hashed(total[start + size] - total[start], WORD_ROWS) if len(data) else np.zeros(0, np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and length of each window; a text without words has none."""
        n = np.diff(self.offsets)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(n)), count)
        start = self.offsets[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
        return doc, start, np.minimum(WINDOW, self.offsets[doc + 1] - start)

    def means(self, table: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Mean of the table's rows of the words' grams."""
        n = self.first[words + 1] - self.first[words]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[words], n)
        mean = np.zeros((len(words), table.shape[1]), np.float32)
        if len(at):
            some = n > 0
            mean[some] = np.add.reduceat(table[self.grams[at]], (np.cumsum(n) - n)[some]) / n[some, None]
        return mean

    def vectors(self, p: Params, words: np.ndarray | None = None) -> np.ndarray:
        """Input vectors of the distinct words, or of some of them."""
        words = np.arange(len(self.word_row)) if words is None else words
        rows = self.word_row[words]
        return np.concatenate([p["words"][rows] * p["common"][rows, None], self.means(p["grams"], words)], 1)

    def texts_with(self) -> np.ndarray:
        """In how many of the texts each row of the word table is found."""
        pairs = np.unique(np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets)) * WORD_ROWS + self.word_row[self.codes]) if len(self.codes) else np.zeros(0, np.int64)
        return np.bincount(pairs % WORD_ROWS, minlength=WORD_ROWS)


def start_params(seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    p = {"words": rng.normal(0, 0.05, (WORD_ROWS, WIDTH)), "grams": rng.normal(0, 0.05, (GRAM_ROWS, WIDTH)), "common": np.zeros(WORD_ROWS)}
    for d in "fb":
        p[f"w{d}"], p[f"u{d}"], p[f"c{d}"] = rng.normal(0, 0.25, (2 * WIDTH, 3 * UNITS)), rng.normal(0, 0.2, (UNITS, 3 * UNITS)), np.zeros(3 * UNITS)
    p["look"], p["out"], p["bias"] = rng.normal(0, 0.2, 2 * UNITS), rng.normal(0, 0.3, 2 * UNITS), np.array([-2.0])
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(gates: np.ndarray, at: np.ndarray, live: np.ndarray, u: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    """States (window, place, unit) of one direction; gates: input part by distinct word; at: words of the windows."""
    n, k = at.shape[0], UNITS
    h, states, memo = np.zeros((n, k), np.float32), np.empty((n, at.shape[1], k), np.float32), []
    for t in reversed(range(at.shape[1])) if back else range(at.shape[1]):
        x, y = gates[at[:, t]], h @ u
        zr = _sigmoid(x[:, : 2 * k] + y[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        c = np.tanh(x[:, 2 * k :] + r * y[:, 2 * k :])
        new = c + z * (h - c)
        new = np.where(live[:, t, None], new, h)
        if keep:
            memo.append((t, h, z, r, c, y[:, 2 * k :]))
        h = new
        states[:, t] = h
    return states, memo


def forward(p: Params, gates: dict[str, np.ndarray], at: np.ndarray, live: np.ndarray, keep: bool = False):
    """Log odds of the windows, and what backward() needs."""
    hf, mf = _run(gates["f"], at, live, p["uf"], False, keep)
    hb, mb = _run(gates["b"], at, live, p["ub"], True, keep)
    h = np.concatenate([hf, hb], 2)
    look = np.where(live, h @ p["look"], -1e9)
    a = np.exp(look - look.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    pooled = np.einsum("nt,ntk->nk", a, h)
    return pooled @ p["out"] + p["bias"][0], (h, a, pooled, mf, mb)


def backward(p: Params, error: np.ndarray, memo, live: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients, and those of the distinct words' input vectors ``x``."""
    h, a, pooled, mf, mb = memo
    g = {"out": error @ pooled, "bias": np.array([error.sum()], np.float32)}
    dp = error[:, None] * p["out"]
    da = np.einsum("nk,ntk->nt", dp, h)
    dl = a * (da - (a * da).sum(1, keepdims=True))
    g["look"] = np.einsum("nt,ntk->k", dl, h)
    dh = a[:, :, None] * dp[:, None] + dl[:, :, None] * p["look"]
    dx, k, flat = np.zeros_like(x), UNITS, at.ravel()
    order = np.argsort(flat, kind="stable")
    for d, m, part in (("f", mf, slice(0, k)), ("b", mb, slice(k, 2 * k))):
        du, each, carry = np.zeros_like(p[f"u{d}"]), np.empty((*at.shape, 3 * k), np.float32), np.zeros((len(error), k), np.float32)
        for t, before, z, r, c, yc in reversed(m):
            on = live[:, t, None]
            total = dh[:, t, part] + carry
            dn = np.where(on, total, 0)
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (before - c) * z * (1 - z)
            dr = dc * yc * r * (1 - r)
            dy = np.concatenate([dz, dr, dc * r], 1)
            each[:, t] = np.concatenate([dz, dr, dc], 1)
            du += before.T @ dy
            carry = np.where(on, dn * z + dy @ p[f"u{d}"].T, total)
        by_word = np.add.reduceat(each.reshape(-1, 3 * k)[order], np.searchsorted(flat[order], np.arange(len(x))))
        g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = du, x.T @ by_word, by_word.sum(0)
        dx += by_word @ p[f"w{d}"].T
    return g, dx


def gates_of(p: Params, x: np.ndarray) -> dict[str, np.ndarray]:
    return {d: x @ p[f"w{d}"] + p[f"c{d}"] for d in "fb"}


def _places(start: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    live = np.arange(WINDOW) < size[:, None]
    return codes[np.minimum(start[:, None] + np.arange(WINDOW), len(codes) - 1)], live


def log_odds(p: Params, inputs: Inputs, each: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Text and log odds of every window."""
    doc, start, size = inputs.windows()
    if not len(doc):
        return doc, np.zeros(0, np.float32)
    gates = gates_of(p, inputs.vectors(p))
    out = np.empty(len(doc), np.float32)
    for i in range(0, len(doc), each):
        out[i : i + each] = forward(p, gates, *_places(start[i : i + each], size[i : i + each], inputs.codes))[0]
    return doc, out


def _highest(doc: np.ndarray, odds: np.ndarray) -> np.ndarray:
    order = np.lexsort((odds, doc))
    return order[np.append(doc[order][1:] != doc[order][:-1], True)]


def train(texts: list[str], labels: list[int], warm: int = WARM, epochs: int = EPOCHS, seed: int = 7) -> Params:
    """Fit the network to labelled texts by Adagrad on windows, as the module's text says."""
    p, rng = start_params(seed), np.random.default_rng(seed)
    inputs, y = Inputs(pa.array(texts, pa.string())), np.array(labels, np.float32)
    doc, start, size = inputs.windows()
    if not len(doc) or y.min() == y.max():
        return p
    p["common"] = (inputs.texts_with() >= COMMON).astype(np.float32)
    label = y[doc].astype(int)
    toxic, clean = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    squares = {k: np.full_like(v, 1e-3) for k, v in p.items()}
    for epoch in range(warm + epochs):
        others = rng.choice(clean, min(len(clean), OTHERS), replace=False)
        if epoch < warm:  # any window of a toxic text may be the one
            use = np.concatenate([rng.choice(toxic, min(len(toxic), OTHERS), replace=False), others])
        else:
            top = _highest(doc, log_odds(p, inputs)[1])
            use = np.concatenate([np.repeat(top[label[top] == 1], COPIES), top[label[top] == 0], others])
        share = label[use].mean()
        for b in np.array_split(rng.permutation(len(use)), -(-len(use) // BATCH)):
            mine = use[b]
            at, live = _places(start[mine], size[mine], inputs.codes)
            words, at = np.unique(at, return_inverse=True)
            at = at.reshape(-1, WINDOW)
            x = inputs.vectors(p, words)
            now, memo = forward(p, gates_of(p, x), at, live, True)
            c = label[mine]
            weight = np.where(c == 1, POSITIVE / share, (1 - POSITIVE) / (1 - share))
            g, dx = backward(p, ((_sigmoid(now) - c) * weight / len(b)).astype(np.float32), memo, live, at, x)
            for k, v in g.items():
                squares[k] += v * v
                p[k] -= RATE * v / np.sqrt(squares[k])
            m = inputs.first[words + 1] - inputs.first[words]
            of = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - inputs.first[words], m)
            rows = inputs.word_row[words]
            for k, rows, v in (("words", rows, dx[:, :WIDTH] * p["common"][rows, None]), ("grams", inputs.grams[of], np.repeat(dx[:, WIDTH:] / np.maximum(m, 1)[:, None], m, axis=0))):
                some, where = np.unique(rows, return_inverse=True)
                total = np.stack([np.bincount(where, v[:, j], minlength=len(some)) for j in range(WIDTH)], 1).astype(np.float32)
                squares[k][some] += total * total
                p[k][some] -= TABLE_RATE * total / np.sqrt(squares[k][some])
    return p


def sample(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Labelled training texts: of each class those with the lowest hashes, at most ``each`` and together ``chars`` characters.

    Only documents with crc32(doc_id as text) mod 3 other than 1 are taken. A text that would pass ``chars`` is passed
    over and the next one is tried. A document with several labels counts as toxic if one is, and of several texts
    of one doc_id the longest is taken.
    """
    y = labels.where("toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # the rows are picked by id and length; only theirs are read as texts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(docs["text"].cast("string")).alias("n")).where((key % 3 != 1) & (F.col("n") > 0)).groupBy("doc_id").agg(F.max("n").alias("n")).join(y, "doc_id")
    found: dict[int, int] = {}
    for toxic in (0, 1):
        total = 0
        for r in rows.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each).collect():
            if total + r.n <= chars:
                total += r.n
                found[r.doc_id] = toxic
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where(F.col("doc_id").isin(list(found)))
    rows = picked.groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text")).orderBy("doc_id").collect()
    return [r.text for r in rows], [found[r.doc_id] for r in rows]


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Toxicity of each row of ``docs``.

    Returns doc_id, held_out (crc32(doc_id as text) mod 3 is 1), score (0 to 1, of the highest window), predicted
    (1 from ``threshold`` on) and n_windows. Only the text is scored. The network learns from a bounded sample of
    labelled documents that are not held out, see ``sample``.

    Null and empty texts have no window and score 0; without labels of both classes the untrained network scores;
    a null doc_id is not held out; repeated rows score alike; an empty table gives no rows. Other columns don't matter.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(*sample(docs, labels)))  # tables of fixed size, 7 MB

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                doc, odds = log_odds(model.value, Inputs(piece.column("text")))
                best = np.full(piece.num_rows, -np.inf)
                np.maximum.at(best, doc, odds)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(1 / (1 + np.exp(CALM - best))), pa.array(np.bincount(doc, minlength=piece.num_rows).astype(np.int64))], ["doc_id", "score", "n_windows"])

    t = docs.select(F.col("doc_id").cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return t.mapInArrow(scored, "doc_id long, score double, n_windows long").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_windows")
