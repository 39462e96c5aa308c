"""Merkle manifest of a dataset by bitmap-rank indexing.

Each task gathers the doc_ids it reads in compressed bitmaps, one for each source and range of ids; they are merged,
and a directory adds up how many rows stand before each. A leaf's place in its source is then a rank query on the
bitmap of its range, whose popcount directory counts the bits before it: leaves are not sorted. Places key slot arrays
of 3^LEVELS leaves, whose levels are reduced in one task; the blocks' roots are leaves of the next round, until one node
is left, and what a leaf needs from the rounds above comes back down by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.numbering import numbered

from .common import cut

#: Nodes that become one, ids (2^CHUNK) of a bitmap, levels that a task reduces, leaves of such a block.
RUN, CHUNK, LEVELS = 3, 13, 7
#: Ids of a bitmap that one count of the popcount directory covers; bitmaps that a task holds before it hands them on.
STEP, HELD = 512, 1 << 15


def field(value: Column) -> Column:
    """A value of a leaf: its UTF-8 length, a colon and itself, or ``-`` for null."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(docs: DataFrame, **instead: Column) -> Column:
    """SHA-256, as bytes, of a row's doc_id, source, lang, n_chars and text; ``instead`` has other values for some."""
    return F.unhex(F.sha2(F.concat(*(field(instead.get(c, docs[c])) for c in ("doc_id", "source", "lang", "n_chars", "text"))), 256))


def _hash(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the ids read, and how many rows each stands for."""
    held: dict[tuple[str | None, int], list] = {}

    def packed() -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(1).compress
        rows = [(s, c, press(np.packbits(bits, bitorder="little").tobytes()), n) for (s, c), (bits, n) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.int64()))], ["source", "chunk", "bitmap", "rows"])

    for b in batches:
        if not b.num_rows:
            continue
        names = b.column("source").dictionary_encode()
        ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, code))
        ids, code = ids[order], code[order]
        ends = [*(np.flatnonzero((np.diff(ids >> CHUNK) != 0) | (np.diff(code) != 0)) + 1).tolist(), len(ids)]
        at = 0
        for end in ends:
            key = (names.dictionary[int(code[at])].as_py() if code[at] >= 0 else None, int(ids[at] >> CHUNK))
            have = held.setdefault(key, [np.zeros(1 << CHUNK, bool), 0])
            have[0][ids[at:end] & ((1 << CHUNK) - 1)] = True
            have[1] += end - at
            at = end
        if len(held) > HELD // 4:
            yield packed()
    yield packed()


def _merge(table: pa.Table) -> pa.Table:
    """One bitmap of those of a source and range: the tasks' bitmaps or-ed."""
    unpress = zstandard.ZstdDecompressor().decompress
    bits = np.zeros(1 << CHUNK >> 3, np.uint8)
    for x in table.column("bitmap").to_pylist():
        bits |= np.frombuffer(unpress(x), np.uint8)
    packed = zstandard.ZstdCompressor(3).compress(bits.tobytes())
    n = int(np.bitwise_count(bits).sum())
    return pa.table({"source": table.column("source")[:1], "chunk": table.column("chunk")[:1], "bitmap": pa.array([packed], pa.binary()), "ids": [n], "rows": [sum(table.column("rows").to_pylist())]})


def bitmaps(rows: DataFrame) -> DataFrame:
    """source, chunk, bitmap, ids (its bits) and rows (of these ids) of the rows' non-null doc_ids."""
    parts = rows.where("doc_id IS NOT NULL").select("source", "doc_id").mapInArrow(_gather, "source string, chunk long, bitmap binary, rows long")
    # a task hands on a bitmap for each source and range it read, so a group has a row for each task at most, but for those handed on early
    return parts.groupBy("source", "chunk").applyInArrow(_merge, "source string, chunk long, bitmap binary, ids long, rows long")


def ranks(bitmap: bytes, low: np.ndarray) -> np.ndarray:
    """How many ids of the bitmap are below each of ``low``: the directory's count and the bits after it."""
    bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(bitmap), np.uint8)
    directory = np.concatenate([[0], np.cumsum(np.bitwise_count(bits.reshape(-1, STEP // 8)).sum(1, dtype=np.int64))])
    inside = np.cumsum(np.bitwise_count(bits).reshape(-1, STEP // 8), 1, dtype=np.int64).ravel() - np.bitwise_count(bits)
    byte = low >> 3
    return directory[low // STEP] + inside[byte] + np.bitwise_count(bits[byte] & ((1 << (low & 7)) - 1).astype(np.uint8))


def _place(rows: pa.Table, found: pa.Table) -> pa.Table:
    """Places of the rows of one source and range; rows of a repeated id come once, with ``times``."""
    low = rows.column("doc_id").to_numpy() & ((1 << CHUNK) - 1)
    at = ranks(found.column("bitmap")[0].as_py(), low)
    times = rows.column("times").to_numpy()
    if (times > 1).any():  # rows of smaller ids beyond the first of each
        more = np.zeros(1 << CHUNK, np.int64)
        more[low] = times - 1
        at = at + (np.cumsum(more) - more)[low]
    one = lambda c: pa.array(np.full(len(low), found.column(c)[0].as_py()))
    return rows.drop_columns(["source", "chunk"]).append_column("g", one("source_no")).append_column("n", one("source_rows")).append_column("idx", pa.array(at + found.column("before")[0].as_py()))


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (source, doc_id, digest, more) with g (the source's number), n (its leaves) and idx (the leaf's place in it), and
    the number of sources.

    Null ids come first; rows of one id are ordered by digest. Both are rare: they are found by the bitmaps, which have
    fewer ids than rows then, collapsed where they are equal, and numbered by a range sort of their own.
    """
    from pyspark.sql import Window

    maps = cut(bitmaps(leaves))
    nulls = leaves.where("doc_id IS NULL").groupBy("source").agg(F.count("*").alias("nulls"))
    sizes = maps.groupBy("source").agg(F.sum("rows").alias("rows")).unionByName(nulls.select("source", F.col("nulls").alias("rows"))).groupBy("source").agg(F.sum("rows").alias("source_rows"))
    names = cut(numbered(sizes, [F.asc_nulls_first("source")], "source_no"))
    total = names.count()
    null_at = nulls.withColumnRenamed("source", "s")
    names = names.join(null_at, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_no", "source_rows", F.coalesce("nulls", F.lit(0).cast("long")).alias("nulls"))
    w = Window.partitionBy("source").orderBy("chunk")  # a row for 2^CHUNK ids
    m = maps.withColumn("before", F.sum("rows").over(w) - F.col("rows"))
    s = names.withColumnRenamed("source", "s")
    m = cut(m.join(s, m["source"].eqNullSafe(s["s"])).select("source", "chunk", "bitmap", "ids", "rows", (F.col("before") + F.col("nulls")).alias("before"), "source_no", "source_rows"))

    rows = leaves.withColumn("chunk", F.shiftright(F.col("doc_id").cast("long"), CHUNK))
    more = [c for c in leaves.columns if c not in ("source", "doc_id")]
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
    schema = ", ".join([f"doc_id {kinds['doc_id']}", *(f"{c} {kinds[c]}" for c in more), "times long, g long, n long, idx long"])
    doubtful = m.where("rows > ids").select("source", "chunk")
    if doubtful.isEmpty() and nulls.isEmpty():
        one = rows.where("doc_id IS NOT NULL").withColumn("times", F.lit(1).cast("long"))
        return one.groupBy("source", "chunk").cogroup(m.groupBy("source", "chunk")).applyInArrow(_place, schema).drop("times"), total
    d = doubtful.withColumnsRenamed({"source": "s", "chunk": "c"})
    ids = rows.where("doc_id IS NOT NULL").join(d, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")), "left_semi").groupBy("source", "doc_id").agg(F.count("*").alias("times")).where("times > 1")
    ids = cut(ids.select(F.col("source").alias("s"), F.col("doc_id").alias("i"), "times"))
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("i"))
    single = rows.where("doc_id IS NOT NULL").join(ids, same, "left_anti").withColumn("times", F.lit(1).cast("long"))
    entry = ids.select(F.col("s").alias("source"), F.col("i").alias("doc_id"), *(F.lit(None).cast(kinds[c]).alias(c) for c in more), F.shiftright(F.col("i").cast("long"), CHUNK).alias("chunk"), "times")
    at = cut(single.unionByName(entry).groupBy("source", "chunk").cogroup(m.groupBy("source", "chunk")).applyInArrow(_place, schema))
    # the rows of repeated ids and null ids, equal ones apart by the number of the copy
    ties = rows.join(ids, same, "left_semi").unionByName(rows.where("doc_id IS NULL")).drop("chunk")
    ties = ties.groupBy(*ties.columns).agg(F.count("*").alias("k")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "k"))).drop("k")
    t = cut(numbered(ties, ["source", F.asc_nulls_first("doc_id"), "digest", "copy"], "row"))
    first = t.groupBy("source", "doc_id").agg(F.min("row").alias("first"))
    start = at.where("times > 1").select("g", "n", "idx", F.col("doc_id").alias("i"))
    gs = names.select(F.col("source").alias("s"), F.col("source_no").alias("sg"), F.col("source_rows").alias("sn"))
    first = first.join(gs, F.col("source").eqNullSafe(F.col("s"))).join(start, (F.col("sg") == F.col("g")) & (F.col("doc_id") == F.col("i")), "left")
    first = first.select(F.col("source").alias("s"), F.col("doc_id").alias("i"), "first", F.col("sg").alias("g"), F.col("sn").alias("n"), F.coalesce("idx", F.lit(0).cast("long")).alias("idx"))
    t = t.join(first, same).select("doc_id", *more, "g", "n", (F.col("idx") + F.col("row") - F.col("first")).alias("idx"))
    return at.where("times = 1").drop("times").unionByName(t), total


def _levels(n: int) -> int:
    k = 0
    while n > 1:
        n, k = -(-n // RUN), k + 1
    return k


def _tree(nodes: list[bytes], n: int, levels: int) -> list[list[bytes]]:
    """The levels of a block's nodes, of a group of ``n``, up to the root of the block or of the group."""
    out = [nodes]
    for _ in range(min(levels, _levels(n))):
        x = out[-1]
        out.append([_hash(x[i : i + RUN]) for i in range(0, len(x), RUN)])
    return out


def blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """g, block, n, node (its root) and the other columns of ``nodes`` (g, idx, n, digest, more) as arrays, a row for each 3^levels places."""

    def pack(table: pa.Table) -> pa.Table:
        start = pa.compute.min(table.column("idx")).as_py()
        slots = np.empty(table.num_rows, np.int64)
        slots[table.column("idx").to_numpy() - start] = np.arange(table.num_rows)
        t = table.combine_chunks().take(pa.array(slots))
        keys = {c: t.column(c)[:1] for c in ("g", "block", "n")}
        lists = {c: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks()) for c in t.column_names if c not in ("g", "block", "n", "idx")}
        node = _tree(t.column("digest").to_pylist(), t.column("n")[0].as_py(), levels)[-1][0]
        return pa.table(keys | {"node": pa.array([node], pa.binary())} | lists)

    b = nodes.withColumn("block", F.floor(F.col("idx") / F.lit(RUN**levels)).cast("long"))
    rest = [f for f in nodes.schema if f.name not in ("g", "idx", "n")]
    schema = "g long, block long, n long, node binary, " + ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in rest)
    return cut(b.groupBy("g", "block").applyInArrow(pack, schema))


def upward(packed: DataFrame, levels: int) -> DataFrame:
    """g, block, path and top of packed blocks: the siblings from a block's root to that of its group, and the latter."""
    size = RUN**levels
    more = packed.where(F.col("n") > size)
    alone = packed.where(F.col("n") <= size).select("g", "block", F.lit(b"").alias("path"), F.col("node").alias("top"))
    if more.isEmpty():
        return alone
    nodes = more.select("g", F.col("block").alias("idx"), F.ceil(F.col("n") / F.lit(size)).cast("long").alias("n"), F.col("node").alias("digest"))
    b = blocks(nodes, levels)
    return alone.unionByName(downward(b, upward(b, levels), levels).select("g", F.col("idx").alias("block"), "path", "top"))


def downward(packed: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The nodes of packed blocks again, each with idx, its path (the siblings up to the top, left to right, in 32 bytes each) and what else ``above`` has by g and block."""
    kinds = {f.name: f.dataType for f in packed.schema}
    lists = [c for c in packed.columns if c not in ("g", "block", "n", "node")]
    over = [f for f in above.schema if f.name not in ("g", "block", "path")]
    schema = ", ".join(["g long, idx long, n long, path binary", *(f"{c} {kinds[c].elementType.simpleString()}" for c in lists), *(f"{f.name} {f.dataType.simpleString()}" for f in over)])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(c)[k].as_py()  # noqa: E731, B023
                n, block, path = get("n"), get("block"), get("path")
                tree = _tree(get("digest"), n, levels)
                size = len(tree[0])
                paths = []
                for i in range(size):
                    parts = []
                    for level in tree[:-1]:
                        at = i - i % RUN
                        parts += level[at:i] + level[i + 1 : at + RUN]
                        i //= RUN
                    paths.append(b"".join([*parts, path]))
                same = lambda f: pa.array([get(f.name)] * size, batch.column(f.name).type)
                arrays = [pa.array([get("g")] * size, pa.int64()), pa.array(range(block * RUN**levels, block * RUN**levels + size), pa.int64()), pa.array([n] * size, pa.int64()), pa.array(paths, pa.binary()), *(batch.column(c)[k].values for c in lists), *(same(f) for f in over)]
                yield pa.RecordBatch.from_arrays(arrays, ["g", "idx", "n", "path", *lists, *(f.name for f in over)])

    return packed.join(above, ["g", "block"]).mapInArrow(unpack, schema)


def manifest(docs: DataFrame, levels: int = LEVELS, **carried: Column) -> DataFrame:
    """Every row's leaf and its way to the root.

    In each source, leaves ascend by doc_id (null first; of one id by leaf); while there are several nodes, every three
    become the SHA-256 of their hexadecimal digests; the last run may have fewer. The sources' roots, null first
    and then by UTF-8 bytes, make a tree of the same kind.

    Returns doc_id, digest (the leaf), the ``carried`` columns, g and groups (number of the source, and of all), idx and n (number of the leaf in
    it, and of all), path (the siblings up to the root, 32 bytes each), subroot and root, a row for each row of ``docs``, repeated ones included. Null
    values and empty texts have leaves like others; an empty table gives no rows; other columns don't matter.
    """
    rows = docs.select(docs["source"].cast("string").alias("source"), "doc_id", leaf(docs).alias("digest"), *(c.alias(k) for k, c in carried.items()))
    nodes, total = placed(rows)
    packed = blocks(nodes, levels)
    up = cut(upward(packed, levels))
    tops = up.where("block = 0").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(total).cast("long").alias("n"), F.col("top").alias("digest"))
    b = blocks(tops, levels)
    over = downward(b, upward(b, levels), levels).select(F.col("idx").alias("g"), F.col("path").alias("rest"), F.col("digest").alias("subroot"), F.col("top").alias("root"))
    above = up.join(over, "g").select("g", "block", F.concat("path", "rest").alias("path"), "subroot", "root")
    return downward(packed, above, levels).withColumn("groups", F.lit(total).cast("long"))


def fold(digest: bytes, idx: int, n: int, g: int, groups: int, path: bytes) -> bytes:
    """The root that follows from a leaf, its place and its siblings."""
    at = 0
    for place, size in ((idx, n), (g, groups)):
        while size > 1:
            start = place - place % RUN
            others = min(RUN, size - start) - 1
            sibs = [path[at + 32 * i : at + 32 * (i + 1)] for i in range(others)]
            digest, at = _hash([*sibs[: place - start], digest, *sibs[place - start :]]), at + 32 * others
            place, size = place // RUN, -(-size // RUN)
    return digest


def folded(rows: DataFrame, candidate: str) -> DataFrame:
    """``rows`` of a manifest with folded_root, the root that the leaf in the column ``candidate`` gives with the row's siblings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = [fold(*x) for x in zip(*(b.column(c).to_pylist() for c in (candidate, "idx", "n", "g", "groups", "path")))]
            yield b.append_column("folded_root", pa.array(roots, pa.binary()))

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", folded_root binary")
