"""Token ids in wavelet-matrix shards.

A shard holds the ids of consecutive documents as one wavelet matrix: for each bit of the ids, highest first, a
plane with that bit of all ids, after which the ids are parted into those with 0 and those with 1. Rank and select
on the planes give access to any token, the count of an id, and its occurrences, from one compressed file, of which
only the blocks that a query comes to are decoded. Shards are rows of a Parquet table (part, seq, n_tokens, matrix), written by Spark into any store it can write to.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .wordstream import pieces, split

#: Tokens in a shard, but for its last document; words that a worker keeps encoded.
SHARD_TOKENS, KNOWN_WORDS = 1 << 21, 800_000

_MAGIC, _HEAD = b"WMX2", "<4sQIIQ"
#: Bytes of a plane that are compressed together, and that an access decodes.
BLOCK = 4096


class WaveletMatrix:
    """A sequence of ids with access, rank, count and select, answered from the bytes of its file.

    The file: a head (magic, ids, planes, documents, bytes of the packed document lengths), the zeros of each plane,
    for each plane the ones before each of its blocks, the ends of the compressed blocks, the lengths, the blocks. A
    query reads the two directories and decodes the blocks it comes to, two for each plane and rank, not the file.
    """

    def __init__(self, data: bytes):
        magic, self.n, self.bits, docs, packed = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        at, self.blocks = struct.calcsize(_HEAD), -(-(-(-self.n // 8)) // BLOCK)
        parts = []
        for kind, count in (("<u8", self.bits), ("<u8", self.bits * (self.blocks + 1)), ("<u8", self.bits * self.blocks)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        self.zeros, self.ends, self.data, self.begin = parts[0].tolist(), parts[2], data, at + packed
        self.ones = parts[1].reshape(self.bits, self.blocks + 1)
        self.lengths = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + packed]), "<u4", docs) if docs else np.zeros(0, np.uint32)
        self._held: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
        """The file of ids, those of all documents in turn, of which ``lengths`` has the numbers of ids."""
        now = ids.astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32)
        bits, blocks = max(1, int(now.max()).bit_length() if len(now) else 1), -(-(-(-len(now) // 8)) // BLOCK)
        parted, press = np.empty_like(now), zstandard.ZstdCompressor(1).compress
        zeros, ones, frames = [], np.zeros((bits, blocks + 1), "<u8"), []
        for k, b in enumerate(reversed(range(bits))):
            one = ((now >> now.dtype.type(b)) & now.dtype.type(1)).astype(bool)
            at = np.flatnonzero(one)
            zeros.append(len(now) - len(at))
            ones[k] = np.searchsorted(at, np.arange(blocks + 1) * (8 * BLOCK))
            plane = np.packbits(one, bitorder="little").tobytes()
            frames += [press(plane[i : i + BLOCK]) for i in range(0, len(plane), BLOCK)]
            np.compress(~one, now, out=parted[: zeros[-1]])
            np.take(now, at, out=parted[zeros[-1] :])
            now, parted = parted, now
        packed = press(lengths.astype("<u4").tobytes())
        head = struct.pack(_HEAD, _MAGIC, len(ids), bits, len(lengths), len(packed))
        return b"".join([head, np.array(zeros, "<u8").tobytes(), ones.tobytes(), np.cumsum([len(f) for f in frames], dtype="<u8").tobytes(), packed, *frames])

    def _block(self, plane: int, block: int) -> np.ndarray:
        key = (plane, block)
        if key not in self._held:
            if len(self._held) >= 1024:
                self._held.clear()
            i = plane * self.blocks + block
            start = self.begin + (int(self.ends[i - 1]) if i else 0)
            self._held[key] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[start : self.begin + int(self.ends[i])]), np.uint8)
        return self._held[key]

    def _rank(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        byte, n = i >> 3, int(self.ones[plane, (i >> 3) // BLOCK])
        if i & (8 * BLOCK - 1):
            p, inside = self._block(plane, byte // BLOCK), byte % BLOCK
            n += int(np.bitwise_count(p[:inside]).sum())
            n += int(p[inside] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0
        return n

    def _place(self, plane: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) ``bit`` of a plane is."""
        before = self.ones[plane].astype(np.int64) if bit else np.minimum(np.arange(self.blocks + 1) * (8 * BLOCK), self.n) - self.ones[plane].astype(np.int64)
        block = int(np.searchsorted(before, k, "right")) - 1
        left = min(8 * BLOCK, self.n - block * 8 * BLOCK)
        same = np.unpackbits(self._block(plane, block), count=left, bitorder="little") == bit
        return block * 8 * BLOCK + int(np.flatnonzero(same)[k - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for p in range(self.bits):
            bit = int(self._block(p, (i >> 3) // BLOCK)[(i >> 3) % BLOCK] >> (i & 7)) & 1
            ones = self._rank(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            v = v << 1 | bit
        return v

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the symbol's occurrences before place i lie in the last order."""
        a, b = 0, i
        if symbol < 0 or symbol >> self.bits:
            return 0, 0
        for p in range(self.bits):
            ra, rb = self._rank(p, a), self._rank(p, b)
            a, b = (self.zeros[p] + ra, self.zeros[p] + rb) if symbol >> (self.bits - 1 - p) & 1 else (a - ra, b - rb)
        return a, b

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of the symbol among the first i tokens."""
        a, b = self._range(symbol, i)
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Where the k-th (from 0) occurrence of the symbol is."""
        a, b = self._range(symbol, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in reversed(range(self.bits)):
            bit = symbol >> (self.bits - 1 - p) & 1
            i = self._place(p, bit, i - self.zeros[p] if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def ids(self) -> np.ndarray:
        """All ids, by undoing the partings from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        v, unpress = np.zeros(self.n, kind), zstandard.ZstdDecompressor().decompress
        ends = [0, *self.ends.tolist()]
        for b, p in enumerate(reversed(range(self.bits))):
            frames = range(p * self.blocks, (p + 1) * self.blocks)
            plane = np.frombuffer(b"".join(unpress(self.data[self.begin + ends[i] : self.begin + ends[i + 1]]) for i in frames), np.uint8)
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            at = np.flatnonzero(one)
            up = np.empty_like(v)
            up[np.flatnonzero(~one)] = v[: self.zeros[p]]
            up[at] = v[self.zeros[p] :] | kind(1 << b)
            v = up
        return v


#: How the tokenizers file of lower-cased words with word ends parts a text.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w]|_)+")
#: Words for which that holds without the library: printable ASCII and the letters of Latin-1 and Latin Extended-A.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
#: Most of these: letters, and a mark after them.
_COMMON = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+[,.]?$"


class Encoder:
    """Encodes texts word by word with a tokenizers file, keeping the ids of words it has seen.

    The file's pre-tokenizer never joins characters across white space, so a text's ids are those of its words. Of
    a file that normalises by NFC, white space and lower case and parts words by the pattern above, common words
    are parted here and only their pieces go through the model; all others go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        stages = [str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)]
        self.parts = stages[0] == 'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])' and "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in stages[1]
        self.bytes = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known, self.pieces, self.ids, self.begin = {}, {}, array("I"), array("q", [0])

    def _learn(self, words: list[str]) -> None:
        """Add words as they stand to those known."""
        rest, known, get, ids, begin = [], self.known, self.pieces.get, self.ids, self.begin
        token, letters = self.tokenizer.model.tokenize, self.bytes

        def new(piece: str) -> list[int]:
            text = piece if piece.isascii() else "".join([letters[b] for b in piece.encode()])
            got = self.pieces[piece] = [x.id for x in token(text)]
            return got

        for w in words:
            if self.parts and _PLAIN.fullmatch(w) and "<|" not in w:
                for piece in _PIECES.findall(w.lower()):
                    ids.extend(get(piece) or new(piece))
                known[w] = len(begin) - 1
                begin.append(len(ids))
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            ids.extend(e.ids)
            known[w] = len(begin) - 1
            begin.append(len(ids))

    def _learn_common(self, words: list[str]) -> None:
        """Add words of lower-case letters alone, which are pieces as they stand."""
        known, ids, begin, token, letters = self.known, self.ids, self.begin, self.tokenizer.model.tokenize, self.bytes
        for w in words:
            ids.extend([x.id for x in token(w if w.isascii() else "".join([letters[b] for b in w.encode()]))])
            known[w] = len(begin) - 1
            begin.append(len(ids))

    def _places(self, words: pa.Array, learn) -> np.ndarray:
        """Where the ids of each word begin, in ``begin``."""
        words = words.to_numpy(zero_copy_only=False).tolist()
        at = list(map(self.known.get, words))
        if None in at:
            learn([w for w, i in zip(words, at) if i is None])
            at = list(map(self.known.get, words))
        return np.array(at, np.int64)

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end`` after it, and their numbers."""
        codes, offsets, words = split(texts)
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        common = pc.match_substring_regex(words, _COMMON) if self.parts else pa.array(np.zeros(len(words), bool))
        there, mark = common.to_numpy(zero_copy_only=False), np.zeros(len(words), np.int64)
        at = np.zeros(len(words), np.int64)
        at[~there] = self._places(words.filter(pc.invert(common)), self._learn)
        if there.any():
            mine = words.filter(common)
            letters = pc.utf8_lower(pc.ascii_rtrim(mine, ",.")).dictionary_encode()
            at[there] = self._places(letters.dictionary, self._learn_common)[letters.indices.to_numpy()]
            mark[there] = np.where(pc.ends_with(mine, ",").to_numpy(zero_copy_only=False), 1, np.where(pc.ends_with(mine, ".").to_numpy(zero_copy_only=False), 2, 0))
        marks = [self._places(pa.array([m]), self._learn)[0] for m in ",."]
        flat, begin = np.append(np.frombuffer(self.ids, np.uint32), np.uint32(end)), np.append(np.frombuffer(self.begin, np.int64), len(self.ids) + 1)
        # a word is up to two runs of known ids: its own, and that of a mark after it
        run = np.concatenate([at[codes], np.array(marks, np.int64)[mark[codes[mark[codes] > 0]] - 1], np.full(len(offsets) - 1, len(begin) - 2)])
        order = np.argsort(np.concatenate([2 * np.arange(len(codes)), 2 * np.flatnonzero(mark[codes] > 0) + 1, 2 * offsets[1:] - 1]), kind="stable") if len(run) else run
        run = run[order]
        n = begin[run + 1] - begin[run]
        total = np.concatenate([[0], np.cumsum(n)])
        places = np.arange(total[-1]) + np.repeat(begin[run] - total[:-1], n)
        ends = np.flatnonzero(order >= len(run) - (len(offsets) - 1))
        return flat[places], np.diff(total[ends + 1], prepend=0)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode the documents and write them as shards, in ascending order of doc_id, under ``path``.

    ``tokenizer`` is the path of a tokenizers file on every executor. Documents are dealt out by ranges of doc_id;
    a task cuts its range into shards. Rows with one doc_id (or none) are dealt on by the hashes of their texts. Null texts count as empty; a null doc_id comes first; rows with equal
    doc_id follow each other in the order of their texts' hashes.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def full() -> pa.RecordBatch:
            ids, lengths = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            doc_ids = pa.concat_arrays([x[2] for x in held])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([doc_ids.to_pylist()], pa.list_(pa.int64())), pa.array([WaveletMatrix.pack(ids, lengths)], pa.binary())], ["part", "seq", "n_tokens", "doc_ids", "matrix"])

        for batch in batches:
            for piece in pieces(batch, limit=6_000_000):
                ids, lengths = _encoders[tokenizer](piece.column("text"), end_id)
                held.append((ids, lengths, piece.column("doc_id")))
                if sum(len(x[0]) for x in held) >= shard_tokens:
                    yield full()
                    seq, held = seq + 1, []
        if held:
            yield full()

    t = docs.select(F.col("doc_id").cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    t = t.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")  # ranges are sampled by hash, not by text
    t.mapInArrow(shards, "part int, seq int, n_tokens long, doc_ids array<long>, matrix binary").write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the shards under ``path``."""
    shards = spark.read.schema("part int, seq int, n_tokens long, doc_ids array<long>, matrix binary").parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, doc_ids, data in zip(*(batch.column(c) for c in ("part", "seq", "doc_ids", "matrix"))):
                m = WaveletMatrix(data.as_py())
                ids, ends = m.ids().astype("<u4"), np.cumsum(m.lengths, dtype=np.int64)
                starts = ends - m.lengths
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, seq.as_py(), np.int32)), doc_ids.values, pa.array(starts), pa.array(m.lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("base"))  # a row for each of the writer's tasks
    each = shards.select("part", "seq", F.col("n_tokens").alias("n")).join(parts, "part")
    each = each.select("part", "seq", (F.col("base") + before(Window.partitionBy("part").orderBy("seq"))).alias("base"))
    docs = shards.select("part", "seq", "doc_ids", "matrix").mapInArrow(documents, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(each, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def store(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the documents as shards under ``path`` (by default a new folder in the shared one) and read them back.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the end id) and ids_crc32 (CRC-32 of the
    ids as little-endian unsigned 32-bit integers). An empty table gives no rows. Other columns don't matter.
    """
    from uuid import uuid4

    from .common import shared_dir

    path = path or f"{shared_dir(docs.sparkSession)}/tidemark-shards-{uuid4().hex}"
    write_shards(docs, path, tokenizer, end_id, shard_tokens)
    return read_shards(docs.sparkSession, path)
