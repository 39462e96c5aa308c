"""Prefix trie of conversations in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns, known by the chained digest of their role and text. Nodes that many
conversations share are few (a bounded number, see ``heavy``), and everything below them falls apart into subtrees that few
share. Those are dealt out to shards whole. A shard enumerates its distinct prefix digests, gives each a slot by a
minimal perfect hash (the digest kept in the slot tells a stranger's), scatters counts into flat arrays by slot and
adds them up through the array of the parents' slots, the deepest first. The few shared nodes are one more such
table, which takes what the shards hand up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, blocks, cut

#: Most nodes of the shared table; fewest conversations that make a node shared; rows of a shard; bytes of ids hashed at a time.
MOST_SHARED, LEAST_SHARED, SHARD_ROWS, PIECE = 1 << 18, 64, 200_000, 1 << 16

ROOT = bytes(16)
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "prefix binary, conv_id long, depth long, parent binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def steps(turns: DataFrame) -> DataFrame:
    """conv_id, turn, step (digest of role and text, null ones empty) and words (of the text) of each turn; rows without conv_id go."""
    part = lambda c: F.coalesce(turns[c].cast("string"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(part("role")).cast("string"), F.lit(":"), part("role"), part("text")), 256)), 1, 16)
    return turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("step"), F.regexp_count(part("text"), F.lit(WORD)).cast("long").alias("words"))


def prefixes(steps: DataFrame) -> DataFrame:
    """conv_id, depth, prefix, parent, words and last of every prefix of every conversation, depth 0 included.

    ``steps`` has conv_id, turn, step and words, in the order of turn (null first) and of step among equal turns; a row without step
    stands for its conversation alone. Rows of a conversation are together and in order.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, None
        for b in batches:
            out = []
            for c, step, words in zip(*(b.column(k).to_pylist() for k in ("conv_id", "step", "words"))):
                if c != conv:
                    if held:
                        out.append((*held, True))
                    conv, held = c, (c, 0, ROOT, None, 0)
                if step is not None:
                    out.append((*held, False))
                    held = (c, held[1] + 1, hashlib.blake2b(held[2] + step, digest_size=16).digest(), held[2], words)
            yield _batch(out)
        if held:
            yield _batch([(*held, True)])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["conv_id", "depth", "prefix", "parent", "words", "last"])

    rows = steps.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "step")
    return rows.mapInArrow(chain, "conv_id long, depth long, prefix binary, parent binary, words long, last boolean")


class Slots:
    """Minimal perfect hash of distinct 16-byte digests: a slot from 0 to n - 1 for each, -1 for all others.

    Levels of bits: a digest that has a bit of its level to itself stays there, the others go on to the next level.
    A digest's slot is the rank of its bit. As the digests are kept by slot, one that isn't among them is told.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        left = keys
        while len(left):
            size = 2 * len(left) + 1
            at = self._hash(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            left = left[~alone[at]]
        self.ranks = np.cumsum(np.concatenate([np.zeros(1, bool), *self.levels]))[:-1] if self.levels else np.zeros(0, np.int64)
        self.keys = np.zeros((0, 2), np.uint64)
        slots = self._find(keys)
        self.keys = np.empty_like(keys)
        self.keys[slots] = keys

    @staticmethod
    def _hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys[:, 0] + np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (2**64 - 1)) * (keys[:, 1] | np.uint64(1))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(size)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(keys), -1), np.arange(len(keys)), 0
        for k, bits in enumerate(self.levels):
            at = self._hash(keys[left], k, len(bits))
            here = bits[at]
            out[left[here]] = self.ranks[base + at[here]]
            left, base = left[~here], base + len(bits)
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self._find(keys)
        known = slot >= 0
        known[known] = (self.keys[slot[known]] == keys[known]).all(1)
        return np.where(known, slot, -1)


def _words(column: pa.Array) -> np.ndarray:
    """16-byte values as pairs of integers; null ones as zeros."""
    data = b"".join(x or ROOT for x in column.to_pylist())
    return np.frombuffer(data, np.uint64).reshape(-1, 2)


def _accumulate(depth: np.ndarray, parent: np.ndarray, children: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> None:
    """Adds children, leaves and saved tokens of the slots to those of their parents', the deepest slots first."""
    order = np.argsort(-depth, kind="stable")
    ends = np.flatnonzero(np.diff(depth[order])) + 1
    for at in np.split(order, ends):
        leaves[at] += children[at] == 0
        up = at[parent[at] >= 0]
        np.add.at(children, parent[up], 1)
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])


def _table(t: pa.Table) -> pa.Table:
    """The nodes of a shard, from a row for each conversation and prefix."""
    keys, ids = _words(t.column("prefix")), t.column("conv_id").to_numpy()
    own = np.unique(keys, axis=0)
    slots = Slots(own)
    at = slots.of(keys)
    n = len(own)
    count = np.bincount(at, minlength=n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, at, ids)
    depth, words, parent = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
    depth[at], words[at], parent[at] = t.column("depth").to_numpy(), t.column("words").to_numpy(), _words(t.column("parent"))
    up = slots.of(parent)
    up[depth == 0] = -1
    children, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), (count - 1) * words
    _accumulate(depth, up, children, leaves, saved)
    ends: dict[int, list[int]] = {}
    last = np.flatnonzero(t.column("last").to_numpy(zero_copy_only=False))
    for s, c in zip(at[last].tolist(), ids[last].tolist()):
        ends.setdefault(s, []).append(c)
    digests = [hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest() if s in ends else _EMPTY for s in range(n)]
    parent_conv = pa.array(least[up], mask=up < 0) if n else pa.array([], pa.int64())
    parent_key = pa.array([None if d == 0 else p.tobytes() for d, p in zip(depth.tolist(), parent)], pa.binary())
    return pa.table([pa.array([k.tobytes() for k in slots.keys], pa.binary()), least, depth, parent_key, parent_conv, count, children, leaves, saved, pa.array(digests, pa.string())], names=[x.split()[0] for x in _NODE.split(", ")])


def _shared_table(t: pa.Table) -> pa.Table:
    """The shared nodes, from a row for each with what the shards hand up to it."""
    keys = _words(t.column("prefix"))
    slots = Slots(keys)
    at = slots.of(keys)
    get = lambda c: t.column(c).to_numpy()[np.argsort(at)]
    n = len(keys)
    count, least, depth, words = get("n_convs"), get("conv_id"), get("depth"), get("words")
    parent = _words(t.column("parent"))[np.argsort(at)]
    up = slots.of(parent)
    up[depth == 0] = -1
    children, leaves, saved = get("n_children").copy(), get("n_leaves").copy(), get("saved_tokens") + (count - 1) * words
    _accumulate(depth, up, children, leaves, saved)
    parent_key = pa.array([None if d == 0 else p.tobytes() for d, p in zip(depth.tolist(), parent)], pa.binary())
    return pa.table([pa.array([k.tobytes() for k in slots.keys], pa.binary()), least, depth, parent_key, pa.array(least[up], mask=up < 0) if n else pa.array([], pa.int64()), count, children, leaves, saved], names=[x.split()[0] for x in _NODE.split(", ")][:-1])


def _ends(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """prefix and ends_sha256 of the ids (prefix, conv_id), however many a prefix has.

    Sorted ranges of ids are joined to pieces of text where they are; the pieces of a prefix, sorted, are then hashed in a stream.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(held):
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.binary()), pa.array([held[1]], pa.int64()), pa.array([",".join(held[2])], pa.string())], ["prefix", "first", "ids"])

        held, size = None, 0
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (held[0] != p or size > piece):
                    yield give(held)
                    held = None
                if not held:
                    held, size = (p, c, []), 0
                held[2].append(str(c))
                size += len(held[2][-1]) + 1
        if held:
            yield give(held)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, done = None, None, []
        give = lambda d: pa.RecordBatch.from_arrays([pa.array([x[0] for x in d], pa.binary()), pa.array([x[1] for x in d], pa.string())], ["prefix", "ends_sha256"])
        for b in batches:
            for p, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if p != now:
                    if h is not None:
                        done.append((now, h.hexdigest()))
                    now, h = p, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield give(done)
            done = []
        if h is not None:
            yield give([(now, h.hexdigest())])

    order = ["prefix", "conv_id"]
    p = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "prefix binary, first long, ids string")
    return p.repartition("prefix").sortWithinPartitions("prefix", "first").mapInArrow(digests, "prefix binary, ends_sha256 string")


def trie(steps: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """The nodes of the trie of all conversations.

    ``steps`` comes from ``steps()``: conv_id, turn, step, words. Returns, a row for each distinct sequence of first turns: prefix (the chained digest),
    conv_id (the smallest of its conversations, the members), depth, parent_conv_id (the smallest of its parent's; null at the root), n_convs, n_children, n_leaves (nodes
    without children in its subtree, itself included), saved_tokens (over its subtree, the members of each node but one times
    the words of its last turn) and ends_sha256 (of the comma-joined ids, in ascending order, of the members that have no more turns).

    Null roles and texts are empty ones; rows without conv_id are left out; rows of the same conversation and turn, repeated
    ones too, are turns in the order of their digests; null turns come first; an empty table gives no rows; other columns don't matter.
    A conversation is read by one task, as a stream; a subtree that at most ``heavy`` conversations share is held by one.
    """
    p = cut(prefixes(steps))
    total = p.count()
    heavy = max(least_shared, blocks(total, MOST_SHARED))  # so at most MOST_SHARED prefixes have as many conversations
    shared = cut(p.groupBy("prefix").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.any_value("depth").alias("depth"), F.any_value("parent").alias("parent"), F.any_value("words").alias("words")).where(F.col("n_convs") >= heavy))
    known = {bytes(r[0]) for r in shared.select("prefix").collect()}

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the first prefix that isn't shared; the rows of a conversation follow each other."""
        conv = top = None
        for b in batches:
            tops = []
            for c, x in zip(b.column("conv_id").to_pylist(), b.column("prefix").to_pylist()):
                if c != conv:
                    conv, top = c, None
                if top is None and x not in known:
                    top = x
                tops.append(top)
            yield b.append_column("top", pa.array(tops, pa.binary()))

    rows = cut(p.mapInArrow(below, "conv_id long, depth long, prefix binary, parent binary, words long, last boolean, top binary"))
    shards = blocks(total, SHARD_ROWS)
    light = rows.where("top IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("top"), F.lit(max(shards, int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
    light = cut(light.groupBy("shard").applyInArrow(_table, _NODE))
    up = light.where("parent_conv_id IS NULL AND depth > 0").groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    given = shared.join(up, "prefix", "left").select(*shared.columns, *(F.coalesce(c, zero).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    # one table of at most MOST_SHARED rows
    given = given.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda t: _shared_table(t.drop_columns(["one"])), _NODE.rpartition(",")[0])
    given = cut(given)
    ends = _ends(rows.where("top IS NULL AND last"))
    given = given.join(ends, "prefix", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    over = F.broadcast(given.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("over")))  # at most MOST_SHARED rows of 24 bytes
    light = light.join(over, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over"))
    columns = ["prefix", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return light.select(*columns).unionByName(given.select(*columns))


def grafted(steps: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Steps of rebuilt conversations: of conversation c, the first h of conversation ``c - c % every``, then its own after the first
    h, where h is crc32 of c as decimal text, modulo ``most + 1``. Each conversation also has a row without step."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "step")
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    own = steps.withColumn("i", F.row_number().over(w).cast("long"))
    mine = own.where(F.col("i") > h).select("conv_id", F.col("i").alias("turn"), "step", "words")
    convs = steps.select("conv_id").distinct()
    asks = convs.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("donor")).where("h > 0")
    lent = own.where((F.col("i") <= most) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("donor"), "i", "step", "words").join(asks, "donor").where("i <= h")
    lent = lent.select("conv_id", (F.col("i") - most - 1).alias("turn"), "step", "words")
    alone = convs.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("step"), F.lit(0).cast("long").alias("words"))
    return mine.unionByName(lent).unionByName(alone)
