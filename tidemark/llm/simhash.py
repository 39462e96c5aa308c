"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are cut into a ring of four 16-bit segments. If two fingerprints differ in at most three bits, some
segment starts a chain whose running differences stay within the proportional budgets 3/4, 6/4, 9/4, 3, that is
0, 1, 2 and 3 bits. The first two budgets are a Spark shuffle key (a segment, and the next one with at most one bit
cleared), the third and the whole distance are checked inside the key's group. Only distinct fingerprints are
compared, and a group hands on just enough links to keep its parts connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small

SEGMENTS, WIDTH, MAX_BITS = 4, 16, 3
#: Rows of one key that are compared in one piece; a key with more is dealt out as pairs of blocks of half that.
PIECE = 8192

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the three-word shingles of a text, ASCII letters lower-cased; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3 else [b" ".join(words)]
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    lanes = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(f)], ["doc_id", "text_hash", "fp"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each key's rows; the rows come sorted by key and piece."""

    def held(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, piece, fp, own, side = rows
        a, b = _pairs(key, piece, fp.view(np.uint64), own, side)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    rest = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        key, piece = rows[0], rows[1]
        last = int(np.flatnonzero((key != key[-1]) | (piece != piece[-1]))[-1]) + 1 if len(key) and ((key != key[-1]) | (piece != piece[-1])).any() else 0
        rest = [x[last:] for x in rows]
        if last:
            yield held([x[:last] for x in rows])
    if rest is not None and len(rest[0]):
        yield held(rest)


def _pairs(key: np.ndarray, piece: np.ndarray, fp: np.ndarray, own: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(key)
    group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (piece[1:] != piece[:-1]))])
    end = np.searchsorted(group, group, "right")
    first = np.arange(n)  # the row whose part of the group a row has joined
    segment = (key >> 32).astype(np.uint64)
    out_a, out_b = [], []
    rows, d = np.arange(n), 1
    while True:
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            break
        x, y = rows, rows + d
        go = (own[x] | own[y]) & (fp[x] != fp[y]) & (first[x] != first[y]) & ((side[x] != side[y]) | (side[x] == 0))
        x, y = x[go], y[go]
        if len(x):
            diff = fp[x] ^ fp[y]
            turned = (diff >> (segment[x] * np.uint64(WIDTH))) | (diff << ((np.uint64(64) - segment[x] * np.uint64(WIDTH)) & np.uint64(63)))
            near = (np.bitwise_count(turned & np.uint64(0xFFFFFFFFFFFF)) <= 2) & (np.bitwise_count(diff) <= MAX_BITS)
            x, y = x[near], y[near]
        if len(x):
            out_a.append(np.minimum(fp[x], fp[y]))
            out_b.append(np.maximum(fp[x], fp[y]))
            while True:  # the parts that have met take the smaller row
                low = np.minimum(first[x], first[y])
                was = first.copy()
                np.minimum.at(first, first[x], low)
                np.minimum.at(first, first[y], low)
                first = first[first]
                if (first == was).all():
                    break
        d += 1
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    both = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0)
    return both[:, 0].copy(), both[:, 1].copy()


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in ``prints.fp`` that differ in at most three bits.

    Not every such pair comes out: each key's group gives those that join parts of it, so that the connected
    components are those of all pairs.
    """
    p = prints.select("fp").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))))
    part = lambda i: f"(shiftrightunsigned(fp, cast(({i}) * {WIDTH} as int)) & 65535)"
    p = p.withColumn("x", F.expr(part("i"))).withColumn("y", F.expr(part(f"(i + 1) % {SEGMENTS}")))
    p = p.withColumn("j", F.expr(f"explode(concat(array(-1), filter(sequence(0, {WIDTH - 1}), j -> (shiftright(y, j) & 1) = 1)))"))
    p = p.select(F.expr("(cast(i as bigint) << 32) | (x << 16) | if(j < 0, y, y - shiftleft(1L, greatest(j, 0)))").alias("key"), "fp", (F.col("j") < 0).alias("own"))
    p = cut(p)
    heavy = cut(p.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PIECE).withColumn("g", F.ceil(F.col("n") * 2 / PIECE).cast("long")))
    flat = p.join(small(heavy), "key", "left_anti").select("key", F.lit(0).cast("long").alias("piece"), "fp", "own", F.lit(0).alias("side"))
    h = p.join(small(heavy), "key").withColumn("block", F.expr("pmod(xxhash64(fp, own), g)")).withColumn("other", F.expr("explode(sequence(0L, g - 1))"))
    h = h.select("key", (F.least("block", "other") * F.col("g") + F.greatest("block", "other")).alias("piece"), "fp", "own", F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))
    rows = flat.unionByName(h).repartition("key", "piece").sortWithinPartitions("key", "piece", "fp")
    return rows.mapInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of each node of the links (a, b), by alternating large and small stars."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of each row of ``docs``.

    Returns doc_id, text_hash (xxhash64 of the text), fp (the fingerprint as a signed long), fingerprint (16
    lower-case hexadecimal digits) and component_id (the smallest doc_id of all rows reachable over fingerprints
    that differ in at most three bits).

    Null and empty texts have fingerprint zero, which links like any other; rows with equal texts share a
    fingerprint and cost one comparison; a component whose ids are all null has a null id; an empty table gives no
    rows. Other columns don't matter.
    """
    t = docs.select("doc_id", docs["text"].cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    rows = cut(t.select("doc_id", "text_hash", "text").mapInArrow(_fingerprints, f"doc_id {kind}, text_hash long, fp long"))
    roots = components(links(rows))
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    of = first.join(roots, first["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = cut(of.join(least, "root").select("fp", "component_id"))
    return rows.join(of, "fp").select("doc_id", "text_hash", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
