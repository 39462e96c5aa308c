"""Removal of repeated passages: windows of consecutive words that also start earlier in the corpus.

Documents are dealt into blocks. The first pass makes a count-min sketch of each block's windows, ``ROWS`` rows of
cells that are one or two, for two or more; only the set cells are sent, in ranges of cells. The sketches of all
blocks are added range by range into the merged one, and each block gets back, for the cells it has set, whether the
merged count is two or more. A window's estimate is the least of its cells' counts. It is never too low, so no
repeated window is lost. In the second pass only windows estimated repeated are sent, once for each block with the
document of their first place in it, to chunks of the hash space, and grouped exactly; the reply names those that start earlier
elsewhere. Blocks, ranges, chunks and messages are bounded and their number follows the input. Text is dealt out once
for all passes, and a window with very many copies costs a chunk one entry for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks
from .wordstream import owner, split

#: Words in a window; characters of text in a block; windows in a chunk of the hash space.
WINDOW, BLOCK_CHARS, CHUNK_WINDOWS = 20, 8_000_000, 1_000_000
#: The sketch has ROWS rows of at least FACTOR cells for each 6 characters of text, in ranges of 2^RANGE_BITS cells.
ROWS, FACTOR, RANGE_BITS = 2, 2, 24

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes: the bytes of equal weight together, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(1).compress(b"".join(planes))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, s in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).view(k).reshape(-1))
        at += n * s
    return out


class Block:
    """The windows of a block's documents, in the order of doc_id, then text, then place."""

    def __init__(self, table: pa.Table, window: int):
        self.rows = table
        if table.num_rows:
            key = table.append_column("key", pc.fill_null(table.column("doc_id"), np.iinfo(np.int64).min))
            self.rows = key.sort_by([("key", "ascending"), ("text", "ascending")])
        codes, self.offsets, words = split(self.rows.column("text"))
        digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.cast(pa.binary()).to_pylist())), ">u8").astype(np.uint64).reshape(-1, 2)
        doc = owner(self.offsets)
        self.starts = np.flatnonzero(np.arange(len(codes)) + window <= self.offsets[1:][doc]) if len(codes) else np.zeros(0, np.int64)
        power, back = _powers(_BASE, len(codes)), _powers(_INVERSE, len(codes))
        h = []
        for k in range(2):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digest[codes, k] * back, dtype=np.uint64)])
            h.append((sums[self.starts + window] - sums[self.starts]) * power[self.starts])
        self.h1, self.h2 = _mixed(h[0]), (_mixed(h[1]) >> np.uint64(32)).astype(np.uint32)

    def cells(self, row: int, bits: int) -> np.ndarray:
        """The cell of each window in a row of 2^bits cells."""
        return (self.h1 * np.uint64(_MIX[row])) >> np.uint64(64 - bits)

    def alike(self, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The windows (or some of them) in the order of their hashes, and whether each is the first of its words."""
        among = np.arange(len(self.h1)) if among is None else among
        order = among[np.argsort(self.h1[among], kind="stable")]
        a, b = self.h1[order], self.h2[order]
        return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)


def _runs(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """key, from and to of the runs of sorted keys."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [(int(keys[i]), int(i), int(j)) for i, j in zip(edge, np.append(edge[1:], len(keys)))]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _rows(kinds: str, rows: list[tuple]) -> pa.Table:
    types = {"long": pa.int64(), "binary": pa.binary()}
    named = [x.split() for x in kinds.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], types[k]) for i, (_, k) in enumerate(named)], [n for n, _ in named])


_MESSAGE = "block long, chunk long, entries binary"


def _key(table: pa.Table, name: str) -> int:
    return table.column(name)[0].as_py()


def dedup(docs: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, chunk_windows: int = CHUNK_WINDOWS, range_bits: int = RANGE_BITS) -> DataFrame:
    """Texts without the words of windows that also start earlier.

    A window is ``window`` consecutive words of one document, as they stand. Each word that some window covers whose
    words also start earlier (smaller doc_id, or same document and earlier place) goes; windows are judged on the
    input. Returns doc_id, n_words, n_removed and kept (the other words, joined by one space), a row for each row
    of ``docs``.

    Null and empty texts have no words. Of rows with equal doc_id that in the block with the smaller number, and in
    one block that with the smaller text, counts as earlier; a null doc_id is the smallest. Equal rows are in one
    block. An empty table gives no rows. Other columns don't matter. Windows are compared by 96-bit hashes of their
    words' 128-bit hashes.
    """
    t = docs.select(F.col("doc_id").cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    chars = t.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = (blocks(chars, 6 * chunk_windows) - 1).bit_length()
    wide = max(range_bits, (FACTOR * blocks(chars, 6) - 1).bit_length())
    ranges = 1 << (wide - range_bits)
    t = t.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks(chars, block_chars))).alias("block"), "doc_id", "text")

    def sketch(table: pa.Table) -> pa.Table:
        b, out = Block(table, window), []
        for row in range(ROWS):
            cells = np.sort(b.cells(row, wide))
            new = np.concatenate([[True], cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            more, cells = (np.diff(np.append(at, len(cells))) > 1).astype(np.uint8), cells[at]
            for part, i, j in _runs(cells >> np.uint64(range_bits)):
                inside = (cells[i:j] & np.uint64((1 << range_bits) - 1)).astype(np.uint32)
                out.append((_key(table, "block"), row * ranges + part, pack(np.diff(inside, prepend=np.uint32(0)), more[i:j])))
        return _rows(_MESSAGE, out)

    def merge(table: pa.Table) -> pa.Table:
        merged, parts = np.zeros(1 << range_bits, np.uint8), []
        for data in table.column("entries").to_pylist():
            step, more = unpack(data, "u4", "u1")
            cells = np.cumsum(step, dtype=np.uint32)
            merged[cells] = np.minimum(merged[cells] + 1 + more, 2)  # a block names a cell once
            parts.append(cells)
        again = [np.packbits(merged[cells] >= 2).tobytes() for cells in parts]
        return _rows(_MESSAGE, [(block, _key(table, "chunk"), x) for block, x in zip(table.column("block").to_pylist(), again)])

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(_MESSAGE, [])
        b, bit = Block(table, window), dict(zip(replies.column("chunk").to_pylist(), replies.column("entries").to_pylist()))
        often = np.ones(len(b.h1), bool)
        for row in range(ROWS):
            cells, where = np.unique(b.cells(row, wide), return_inverse=True)
            again = [np.unpackbits(np.frombuffer(bit[row * ranges + part], np.uint8), count=j - i) for part, i, j in _runs(cells >> np.uint64(range_bits))]
            often &= np.concatenate([np.zeros(0, np.uint8), *again])[where] > 0
        order, first = b.alike(np.flatnonzero(often))
        w, ids = order[first], b.rows.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        doc, out = np.searchsorted(b.offsets, b.starts[w], "right") - 1, []
        for chunk, i, j in _runs((b.h1[w] >> np.uint64(63 - bits)) >> np.uint64(1)):
            x = w[i:j]
            out.append((_key(table, "block"), chunk, pack(b.h1[x], b.h2[x], ids[doc[i:j]], x.astype(np.uint32))))
        return _rows(_MESSAGE, out)

    def group(table: pa.Table) -> pa.Table:
        names = table.column("block").to_numpy()
        parts = [unpack(x, "u8", "u4", "i8", "u4") for x in table.column("entries").to_pylist()]
        h1, h2, doc, at = (np.concatenate([p[k] for p in parts]) for k in range(4))
        message = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.lexsort((names[message], doc, h2, h1))  # a block names a window once
        a, b = h1[order], h2[order]
        later = order[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])]
        later = later[np.argsort(message[later], kind="stable")]
        return _rows(_MESSAGE, [(int(names[m]), _key(table, "chunk"), pack(at[later[i:j]])) for m, i, j in _runs(message[later])])

    def cover(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])
        b = Block(table, window)
        order, first = b.alike()
        gone = np.ones(len(b.starts), bool)
        gone[order[first]] = False  # all but the first place of a window in the block
        for entries in replies.column("entries").to_pylist():
            gone[unpack(entries, "u4")[0]] = True
        starts = b.starts[gone]
        edge = np.zeros(int(b.offsets[-1]) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        kept = np.cumsum(edge[:-1]) == 0
        left = np.add.reduceat(np.append(kept, False).astype(np.int64), b.offsets[:-1]) if len(b.offsets) > 1 else np.zeros(0, np.int64)
        n = np.diff(b.offsets)
        left = np.where(n > 0, left, 0)
        texts = []
        for i, text in enumerate(b.rows.column("text").to_pylist()):
            words = text.encode("utf-8", "surrogatepass").split()
            if left[i] < n[i]:
                words = [w for w, k in zip(words, kept[b.offsets[i] : b.offsets[i + 1]].tolist()) if k]
            texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return pa.table([b.rows.column("doc_id").combine_chunks(), pa.array(n), pa.array(n - left), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    merged = t.groupBy("block").applyInArrow(sketch, _MESSAGE).groupBy("chunk").applyInArrow(merge, _MESSAGE)
    later = t.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(send, _MESSAGE).groupBy("chunk").applyInArrow(group, _MESSAGE)
    return t.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(cover, "doc_id long, n_words long, n_removed long, kept string")
