"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Items and texts are sequences of normalised words. A window as long as an item counts as a leak of it if at most a
fifth of the item's words need be inserted, deleted or replaced to turn one into the other. The CGK random walk maps
such a sequence to symbols so that edit distance becomes Hamming distance; only the first half of the walk is sampled,
where it is still inside the sequence. Walks and samples are repeated as often as a trial on edited random items of
the same length needs to find ``recall`` of them. Keys of windows and items meet in a Spark join, and an exact edit
distance decides.

Windows that cannot be leaks are left out before the walk by a bound that loses none: k edits leave at least
n - g + 1 - g k of an item's grams of g words in place. The grams of items, marked with the item's length and, for a
first look, with its class of lengths, and the items' keys are held as bit sets, eight bits or more for each mark up to
sets of 256 MB (268 million marks, some millions of items); fuller sets only prune less.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .wordstream import pieces, split

#: Edits allowed for each word of an item; share of leaks at that limit to be found; symbols in a sample; samples from one
#: walk; samples that a trial begins with and may come to; least and most bits of a bit set, as powers of two; edited items of a trial.
EDITS, RECALL, SAMPLED, PER_WALK, TRIED, MOST, SET_BITS, SET_MOST, TRIAL = 0.2, 0.995, 2, 8, 128, 4096, 25, 31, 400

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts and the texts' offsets. Letters are lower-cased; what is neither letter nor digit is dropped, and words without any."""
    codes, offsets, words = split(texts)
    plain = ["".join(filter(str.isalnum, w)).lower() if not w.isalnum() else w.lower() for w in words.to_pylist()]
    h = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) if w else 0 for w in plain], np.uint64)
    flat = h[codes] if len(codes) else np.zeros(0, np.uint64)
    there = flat != 0
    return flat[there], np.concatenate([[0], np.cumsum(there)])[offsets]


def limit(n: int) -> int:
    """Edits that a window may have against an item of n words."""
    return math.floor(n * EDITS + 1e-9)


def gram_size(n: int) -> int:
    """Words in the grams that bound an item of n words: three, or as many as leave one in place."""
    return 3 if n in (3, 4) or n > 5 else min(n, 2)


def grams_needed(n: int) -> int:
    """How many of the item's grams a window has at least."""
    return n - gram_size(n) + 1 - gram_size(n) * limit(n)


def length_class(n: int) -> int:
    """Lengths within a quarter of each other, roughly, are one class."""
    return math.floor(math.log(n) / math.log(1.25))


def keys(flat: np.ndarray, starts: np.ndarray, n: int, count: int) -> np.ndarray:
    """LSH keys, ``count`` for each of the windows of n words at ``starts``, as unsigned 64-bit integers.

    A window that reaches past the end of ``flat`` is filled up like a shorter one.
    """
    out = np.zeros((len(starts), count), np.uint64)
    steps = max(1, 3 * n // 2)
    for walk in range(-(-count // PER_WALK)):
        rng = np.random.default_rng([walk, n])
        want = [rng.choice(steps, min(SAMPLED, steps), replace=False) for _ in range(min(PER_WALK, count - walk * PER_WALK))]
        last = max(int(w.max()) for w in want)
        held, i = {}, np.zeros(len(starts), np.int64)
        for j in range(last + 1):
            at = np.minimum(starts + i, len(flat) - 1)
            s = np.where((i < n) & (starts + i < len(flat)), flat[at], np.uint64(1))
            if any(j in w for w in want):
                held[j] = s
            i += (_mix(s + np.uint64(((walk << 20) + j) * int(_ODD) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63)).astype(np.int64)
        for r, w in enumerate(want):
            k = np.full(len(starts), walk * PER_WALK + r + (n << 16), np.uint64)
            for j in w:
                k = _mix(k ^ held[int(j)]) + _ODD
            out[:, walk * PER_WALK + r] = k
    return out


@functools.lru_cache(maxsize=4096)
def repeats(n: int, recall: float = RECALL) -> int:
    """Samples that items of n words need: as many as find ``recall`` of ``TRIAL`` random items with as many edits as allowed.

    ValueError if ``MOST`` samples do not.
    """
    rng, k = np.random.default_rng(n), limit(n)
    if not k:
        return 1
    whole, edited = [], []
    for _ in range(TRIAL):
        item = rng.integers(2, 1 << 62, n).tolist()
        window = list(item)
        for _ in range(k):
            at, kind = int(rng.integers(len(window))), int(rng.integers(3))
            window[at : at + (kind != 0)] = [] if kind == 1 else [int(rng.integers(2, 1 << 62))]
        whole.append(item)
        edited.append((window + rng.integers(2, 1 << 62, n).tolist())[:n])
    count = TRIED
    while count <= MOST:
        a, b = (keys(np.array(x, np.uint64).ravel(), np.arange(TRIAL) * n, n, count) for x in (whole, edited))
        found = np.logical_or.accumulate(a == b, axis=1).mean(0)
        if found[-1] >= recall:
            return int(np.argmax(found >= recall)) + 1
        count *= 2
    raise ValueError(f"{MOST} samples find {found[-1]:.4f} of the edited items of {n} words, not {recall}")


def distances(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the fewest edits that turn the item into some part of the text, and where the first such part ends.

    Items (rows, n) and texts (rows, m), these filled up with a word that is in no item.
    """
    at = np.arange(texts.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(texts), len(at)), np.int32)
    for i in range(items.shape[1]):
        up = np.empty_like(row)
        up[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (texts != items[:, i, None]), out=up[:, 1:])
        row = np.minimum.accumulate(up - at, axis=1) + at
    return row.min(1), row.argmin(1)


def set_bits(marks: int) -> int:
    """Size of a bit set of so many marks, as a power of two: eight bits a mark within the bounds."""
    return min(max(SET_BITS, (8 * max(marks, 1) - 1).bit_length()), SET_MOST)


def _bitset(h: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(1 << (size - 3), np.uint8)
    place = h >> np.uint64(64 - size)
    np.bitwise_or.at(out, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    return out


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _grams(flat: np.ndarray, g: int) -> np.ndarray:
    """Hashes of the grams of g words that start at each place."""
    h = np.full(max(0, len(flat) - g + 1), g, np.uint64)
    for i in range(g):
        h = _mix(h * np.uint64(5) + flat[i : len(flat) - g + 1 + i])
    return h


def _marked(grams: np.ndarray, mark: int) -> np.ndarray:
    return _mix(grams + np.uint64(mark))


def _marks(grams: np.ndarray, n: int) -> np.ndarray:
    """A gram as it stands, with its item's class of lengths, and with its length."""
    return np.concatenate([grams, _marked(grams, (1 << 40) + length_class(n)), _marked(grams, n)])


def _candidates(hits: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of n words that hold enough of the sorted places of grams."""
    need, width = grams_needed(n), n + limit(n) - gram_size(n)
    if len(hits) < need:
        return hits[:0]
    first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
    low, high = np.maximum(last - width, 0), first + 1
    # neighbouring ranges of starts overlap; each start comes once
    low = np.maximum(low, np.concatenate([[0], np.maximum.accumulate(high)[:-1]]))
    size = np.maximum(high - low, 0)
    return np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _items(items: DataFrame, recall: float) -> DataFrame:
    """item, n, words (hashes as bytes), grams and keys (longs) of each item with a word."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = symbols(b.column("text"))
            rows = []
            for item, x, y in zip(b.column("item_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                if y > x:
                    w, n = flat[x:y], y - x
                    rows.append((item, n, w.tobytes(), _marks(_grams(w, gram_size(n)), n).view(np.int64).tolist(), keys(w, np.zeros(1, np.int64), n, repeats(n, recall))[0].view(np.int64).tolist()))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["item_id", "n", "words", "grams", "keys"])

    return cut(items.select(F.col("item_id").cast("long"), items["text"].cast("string").alias("text")).mapInArrow(made, "item_id long, n long, words binary, grams array<long>, keys array<long>"))


def _union(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bit set of the longs in ``hashes.h``: each partition's own set, joined block by block."""
    size = 1 << 12

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            own |= _bitset(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64), bits)
        blocks = own.reshape(-1, size)
        some = np.flatnonzero(blocks.any(1))
        for i in range(0, len(some), 4096):
            part = some[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([blocks[j].tobytes() for j in part], pa.binary())], ["block", "bits"])

    def joined(table: pa.Table) -> pa.Table:
        x = functools.reduce(np.bitwise_or, (np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()))
        return pa.table([table.column("block").slice(0, 1).combine_chunks(), pa.array([x.tobytes()], pa.binary())], ["block", "bits"])

    out = np.zeros(1 << (bits - 3), np.uint8).reshape(-1, size)
    for r in hashes.mapInArrow(local, "block long, bits binary").groupBy("block").applyInArrow(joined, "block long, bits binary").toLocalIterator():  # 256 MB at most
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def leaks(docs: DataFrame, items: DataFrame, recall: float = RECALL) -> DataFrame:
    """Which documents hold which benchmark items, exactly or nearly.

    Returns doc_id, item_id, end (where the best passage ends, in normalised words from 0), n_words (of the item) and
    edits (the smallest number of word edits found, at most a fifth of n_words), one row for each pair.

    Null and empty texts hold nothing, and items without a word match nothing; those of up to four words match only
    exactly, a single word wherever it stands; rows with equal doc_id or item_id are joined to one pair; empty tables
    give no rows. Other columns don't matter.
    """
    spark = docs.sparkSession
    listed = _items(items, recall)
    lengths = spark.sparkContext.broadcast(sorted(r.n for r in listed.select("n").distinct().collect()))  # the distinct item lengths
    marks = listed.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0)).alias("grams"), F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("keys")).first()
    gram_set, key_set = (spark.sparkContext.broadcast(_union(listed.select(F.explode(c).alias("h")), set_bits(marks[c]))) for c in ("grams", "keys"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[tuple[int, int], list[int]] = {}
        for n in lengths.value:
            classes.setdefault((gram_size(n), length_class(n)), []).append(n)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            for piece in pieces(batch):
                flat, offsets = symbols(piece.column("text"))
                ids, held = piece.column("doc_id").to_pylist(), {}
                out: list[tuple] = []
                for g in sorted({g for g, _ in classes}):
                    grams = _grams(flat, g)
                    some = np.flatnonzero(_in(gram_set.value, grams))
                    some = some[np.searchsorted(offsets, some, "right") == np.searchsorted(offsets, some + g - 1, "right")]
                    held[g] = some, grams[some]
                for (g, c), ns in classes.items():
                    some, grams = held[g]
                    alike = _in(gram_set.value, _marked(grams, (1 << 40) + c))
                    some, grams = some[alike], grams[alike]
                    if len(some) < min(map(grams_needed, ns)):
                        continue
                    for n in ns:
                        start = _candidates(some[_in(gram_set.value, _marked(grams, n))], n)
                        for begin in range(0, len(start), 20_000):
                            out += found_at(flat, offsets, ids, start[begin : begin + 20_000], n)
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], ["doc_id", "start", "n", "words", "keys"])

    def found_at(flat: np.ndarray, offsets: np.ndarray, ids: list, mine: np.ndarray, n: int) -> Iterator[tuple]:
        """Passages around the windows at these starts that share a key with some item."""
        doc = np.searchsorted(offsets, mine, "right") - 1
        end = np.minimum(mine + n + limit(n), offsets[doc + 1])
        found = keys(flat, mine, n, repeats(n, recall))
        met = _in(key_set.value, found.ravel()).reshape(found.shape)
        rows = np.flatnonzero(met.any(axis=1))
        # windows that start within an item's length of each other in a document are one passage
        run: list[int] = []
        for r in [*rows.tolist(), -1]:
            if run and (r < 0 or doc[r] != doc[run[0]] or mine[r] - mine[run[0]] > n):
                first, some = run[0], np.array(run)
                yield ids[doc[first]], int(mine[first] - offsets[doc[first]]), n, flat[mine[first] : end[some].max()].tobytes(), np.unique(found[some][met[some]]).view(np.int64).tolist()
                run = []
            run.append(r)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, start = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "start"))
            own, text = ([np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("item_words", "words"))
            edits, ends = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for k in np.unique(n):
                rows = np.flatnonzero(n == k)
                for i in range(0, len(rows), 512):
                    r = rows[i : i + 512]
                    wide = np.zeros((len(r), max(len(text[j]) for j in r)), np.uint64)
                    for w, j in zip(wide, r):
                        w[: len(text[j])] = text[j]
                    edits[r], ends[r] = distances(np.stack([own[j] for j in r]), wide)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("item_id"), pa.array(start + ends), b.column("n"), pa.array(edits)], ["doc_id", "item_id", "end", "n_words", "edits"])

    t = docs.select(F.col("doc_id").cast("long"), docs["text"].cast("string").alias("text"))
    near = t.mapInArrow(windows, "doc_id long, start long, n long, words binary, keys array<long>")
    near = near.select("doc_id", "start", "n", "words", F.explode(F.array_distinct("keys")).alias("key"))
    of = listed.select("item_id", F.col("n").alias("item_n"), F.col("words").alias("item_words"), F.explode(F.array_distinct("keys")).alias("key"))
    met = near.join(of, "key").where("n = item_n").groupBy("doc_id", "item_id", "start", "n", "words", "item_words").agg(F.lit(1).alias("one"))
    kind = "doc_id long, item_id long, end long, n_words long, edits long"
    sure = met.select("doc_id", "item_id", "start", "n", "words", "item_words").mapInArrow(verified, kind)
    best = sure.where(F.col("edits") <= F.floor(F.col("n_words") * EDITS + 1e-9)).groupBy("doc_id", "item_id", "n_words").agg(F.min(F.struct("edits", "end")).alias("x"))
    return best.select("doc_id", "item_id", "x.end", "n_words", "x.edits")


def clean(docs: DataFrame, items: DataFrame, recall: float = RECALL) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay. Rows without doc_id stay unless one of them does."""
    bad = leaks(docs, items, recall).select(F.col("doc_id").alias("__leaks")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__leaks"]), "left_anti")
