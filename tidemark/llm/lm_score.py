"""Language-model scores by online logistic context mixing, beside an add-one unigram score.

A text is a sequence of lower-cased words and an end. The most frequent words have binary codes, whose bits are
predicted from the words before (``wordmix``); a word without a code costs the escape's and is spelled: the bits of its
bytes and of a space after it are predicted from its last one to four bytes and from all since its start. In both
parts each bit's predictions come from counts in hashed contexts; their log odds are mixed with weights that a gate
picks, and a last table, also learnt online, corrects the mixed probability. A word without a code that was seen in
training also has a share of the escape by its exact count, less a discount that is left for new words (Ney, Essen and
Kneser, 1994); its probability is the sum of that share and of its spelling's part of what is left.

Documents are dealt into blocks and words into chunks. A block sends each chunk its distinct words with their
training counts, which the chunk adds up. The word model reads the training texts of each block in turn: each bit is
predicted from what the block has counted so far, the weights learn from it, and then it is counted. The blocks'
counts are added and their weights averaged. A row's block follows from its id and text, and a block is read in the
order of its rows' hashes, so that the scores don't depend on how the table is partitioned. A word without a code costs
the same wherever it stands, so Spark prices each distinct one once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordmix
from .common import blocks, written
from .wordstream import owner, pieces, split

BLOCK_CHARS, CHUNK_CHARS = 8_000_000, 12_000_000
#: Contexts; slots of each context's table; slots in a range that is summed together; smoothing of a counter.
CONTEXTS, SLOTS, RANGE, PRIOR = 5, 1 << 20, 1 << 15, 0.1
#: Gates: 8 places by 5 levels of the longest context's count. Steps of the correcting table, and its bit contexts.
PLACES, LEVELS, STEPS, LIMIT = 8, 5, 33, 12.0
#: Learning rate of the weights, and bits in a step of learning.
RATE, BATCH = 0.005, 8192
#: Words with codes: those with the highest training counts, which are at least two.
CODED = 1 << 14
#: Tokens after which a block's counts start anew, so that 32-bit floats count them exactly.
FRESH = 1 << 23
SPACE, END = 32, 10


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Words:
    """Bytes of coded words one after another, with the hashed contexts of each byte."""

    def __init__(self, words: list[bytes]):
        coded = [w + b" " if w != b"\n" else w for w in words]
        self.size = np.fromiter(map(len, coded), np.int64, len(coded))
        self.bytes = np.frombuffer(b"".join(coded), np.uint8)
        start = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(coded)), self.size)
        self.place = np.arange(len(self.bytes)) - start[self.word]
        b = self.bytes.astype(np.uint64)
        back = [np.where(self.place >= k, np.concatenate([np.zeros(k, np.uint64), b[:-k]])[: len(b)], np.uint64(0)) for k in (1, 2, 3, 4)]
        # hash of all bytes since the word's start: a difference of sums of b * base^i, brought back to the start
        base = np.uint64(0x9E3779B97F4A7C15)
        power = np.full(int(self.size.max()) + 1 if len(words) else 1, base, np.uint64)
        power[:1] = 1
        power = np.multiply.accumulate(power)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * power[self.place], dtype=np.uint64)])
        prefix = sums[:-1] - sums[start][self.word]
        self.near = np.minimum(self.place, PLACES - 1)
        three = back[0] | back[1] << np.uint64(8) | back[2] << np.uint64(16)
        contexts = [back[0] + np.uint64(256), back[0] | back[1] << np.uint64(8) | np.uint64(1 << 24), three | np.uint64(2 << 24), (three | back[3] << np.uint64(24)) * np.uint64(8) + np.uint64(5), prefix * np.uint64(2) + np.uint64(1)]
        self.contexts = [_mix(c) for c in contexts]

    def bit(self, k: int, at: slice | np.ndarray = slice(None)) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of bit ``k`` of the bytes ``at``: the bits known before with a one in front, the bit, and the slot of each context."""
        byte = self.bytes[at]
        known = (np.uint16(1) << np.uint16(k)) | (byte >> np.uint8(8 - k) if k else np.zeros(len(byte), np.uint8)).astype(np.uint16)
        salt, slots = known.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), []
        for c in self.contexts:
            slot = c[at] + salt
            slot *= np.uint64(0x9E3779B97F4A7C15)
            slot >>= np.uint64(44)
            slots.append(slot.view(np.int64))
        return known, (byte >> np.uint8(7 - k)) & 1, slots

    def bits(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """bit number, the bits known before with a one in front, the bit, and the slot of each context."""
        for k in range(8):
            yield k, *self.bit(k)

    def sources(self) -> np.ndarray:
        """Of each byte the first one in a run of consecutive words that all begin with the same bytes up to it."""
        start = np.cumsum(self.size) - self.size
        before = np.concatenate([np.zeros(1, np.int64), self.size])[:-1]
        last = np.repeat(start - before, self.size) + self.place  # the same place of the word before
        differs = (self.place >= before[self.word]) | (self.bytes != self.bytes[np.minimum(last, len(self.bytes) - 1)])
        so_far = np.cumsum(differs)
        fresh = so_far > (so_far - differs)[start][self.word]
        by_place = np.argsort(self.place, kind="stable")
        out = np.empty(len(self.bytes), np.int64)
        out[by_place] = by_place[np.maximum.accumulate(np.where(fresh[by_place], np.arange(len(by_place)), 0))]
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(30))


def _odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + PRIOR) / (n0 + PRIOR))


def _level(n: np.ndarray) -> np.ndarray:
    return sum((n >= x).view(np.uint8) for x in (1, 2, 5, 30))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Mixer:
    """Weights by gate, and a table that corrects the mixed probability by step and known bits."""

    def __init__(self, weights: np.ndarray | None = None, table: np.ndarray | None = None, gates: int = PLACES * LEVELS, contexts: int = CONTEXTS):
        self.weights = np.full((gates, contexts), 0.3) if weights is None else weights
        grid = _squash(np.linspace(-LIMIT, LIMIT, STEPS))
        self.table = np.stack([np.repeat(grid[:, None], 256, 1) * 2, np.full((STEPS, 256), 2.0)]) if table is None else table  # ones seen, all seen

    def mixed(self, gate: np.ndarray, odds: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", self.weights[gate], odds), -LIMIT, LIMIT)

    def final(self, x: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Probability of a one: the mean of the mixed one and the table's, between two steps."""
        at = (x + LIMIT) * ((STEPS - 1) / (2 * LIMIT))
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        part, cell = at - low, low * 256 + known
        rate = (self.table[0] / self.table[1]).ravel()
        p = (_squash(x) + rate[cell] * (1 - part) + rate[cell + 256] * part) / 2
        return np.clip(p, 1e-6, 1 - 1e-6)

    def learn(self, gate: np.ndarray, odds: np.ndarray, known: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        for i in range(0, len(bit), BATCH):
            s = slice(i, i + BATCH)
            x = self.mixed(gate[s], odds[s])
            error = (bit[s] - _squash(x)) * weight[s]
            step = np.stack([np.bincount(gate[s], error * odds[s, i], minlength=len(self.weights)) for i in range(self.weights.shape[1])], 1)
            mass = np.bincount(gate[s], weight[s], minlength=len(self.weights))
            self.weights += RATE * step / np.maximum(mass, 1e-9)[:, None] * (mass > 0)[:, None]
            at = np.rint((x + LIMIT) * ((STEPS - 1) / (2 * LIMIT))).astype(np.int64)
            cell = at * 256 + known[s]
            self.table[0] += np.bincount(cell, weight[s] * bit[s], minlength=STEPS * 256).reshape(STEPS, 256)
            self.table[1] += np.bincount(cell, weight[s], minlength=STEPS * 256).reshape(STEPS, 256)


def _prices(words: list[bytes], n0: np.ndarray, n1: np.ndarray, mixer: Mixer) -> np.ndarray:
    """Bits that each word costs. What a word's beginning costs is taken over from the word before if it has it too."""
    out, table, level = np.zeros(len(words)), _odds(n0, n1), _level(n0[-1] + n1[-1])
    for i in range(0, len(words), 50_000):
        w = Words(words[i : i + 50_000])
        source, chance = w.sources(), np.ones(len(w.bytes))
        fresh = np.flatnonzero(source == np.arange(len(source)))
        for j in range(0, len(fresh), BATCH):
            at = fresh[j : j + BATCH]
            near, p = w.near[at] * LEVELS, np.ones(len(at))
            for k in range(8):
                known, bit, slots = w.bit(k, at)
                one = mixer.final(mixer.mixed(near + level[slots[-1]], np.stack([table[c][s] for c, s in enumerate(slots)], 1)), known)
                p *= np.abs(one - (1 - bit))  # of a zero, what is left of one
            chance[at] = p
        out[i : i + len(w.size)] = np.bincount(w.word, -np.log2(chance)[source], minlength=len(w.size))
    return out


class WordModel:
    """Codes, counts (zeros and ones of a slot side by side) and mixer of the word model."""

    def __init__(self, code: wordmix.Code, counts: np.ndarray | None = None, mixer: Mixer | None = None):
        self.code, self.counts = code, np.zeros((wordmix.CONTEXTS, 2 * wordmix.SLOTS), np.float32) if counts is None else counts
        self.mixer = mixer or Mixer(gates=wordmix.GATES, contexts=wordmix.CONTEXTS)
        self.ready: tuple[np.ndarray, np.ndarray] | None = None
        self.seen, self.total = 0, None

    def fold(self) -> None:
        """Add the counts to the total and start them anew."""
        self.total = self.counts.astype(np.uint32) if self.total is None else self.total + self.counts.astype(np.uint32)
        self.counts[:], self.seen = 0, 0

    def finish(self) -> None:
        """Log odds and levels of all slots instead of the counts, for costs alone."""
        zeros, ones = self.counts[:, ::2], self.counts[:, 1::2]
        self.ready = np.log((ones + wordmix.PRIOR) / (zeros + wordmix.PRIOR)).astype(np.float32), wordmix.levels(zeros[1:3] + ones[1:3])

    def _inputs(self, depth: np.ndarray, slots: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Gate and log odds of each bit."""
        if self.ready is not None:
            return wordmix.gates(self.ready[1][0][slots[1]], self.ready[1][1][slots[2]], depth), [self.ready[0][c][x] for c, x in enumerate(slots)]
        prior, nodes = np.float32(wordmix.PRIOR), len(self.code.words) + 1
        zeros, ones = self.counts[0, : 2 * nodes : 2], self.counts[0, 1 : 2 * nodes : 2]
        odds, seen = [np.log((ones + prior) / (zeros + prior))[slots[0]]], []  # of all nodes, which are fewer than the bits
        for c, x in enumerate(slots[1:], 1):
            both = self.counts[c].view(np.complex64)[x]  # a slot's zeros and ones in one look
            zeros, ones = both.real, both.imag
            odds.append(np.log((ones + prior) / (zeros + prior)))
            seen.append(wordmix.levels(zeros + ones))
        return wordmix.gates(*seen, depth), odds

    def _mixed(self, gate: np.ndarray, odds: list[np.ndarray]) -> np.ndarray:
        w = np.ascontiguousarray(self.mixer.weights.T, np.float32)
        return np.clip(sum(w[c][gate] * x for c, x in enumerate(odds)), -LIMIT, LIMIT)

    def read(self, symbol: np.ndarray, context: np.ndarray, first: np.ndarray) -> None:
        """Learn from texts in turn: predict, adapt the weights, count."""
        one, two = wordmix.before(context, first)
        m, scale = self.mixer, np.float32((STEPS - 1) / (2 * LIMIT))
        for i in range(0, len(symbol), wordmix.TOKENS):
            s = slice(i, i + wordmix.TOKENS)
            _, depth, bit, slots = wordmix.events(self.code, symbol[s], one[s], two[s])
            gate, odds = self._inputs(depth, slots)
            for j in range(0, len(bit), 8 * BATCH):
                b = slice(j, j + 8 * BATCH)
                g, o = gate[b], [x[b] for x in odds]
                x = self._mixed(g, o)
                error = bit[b] - 1 / (1 + np.exp(-x))
                cell = np.rint((x + np.float32(LIMIT)) * scale).astype(np.int64) * 256 + g
                seen = np.bincount(2 * cell + bit[b], minlength=2 * STEPS * 256).reshape(STEPS, 256, 2)
                both = seen.sum(2)
                mass = both.sum(0)[: len(m.weights)]
                # as many steps as the batch has parts of BATCH bits
                step = np.stack([np.bincount(g, error * v, minlength=len(m.weights)) for v in o], 1) / np.maximum(mass, 1)[:, None]
                m.weights += RATE * (len(x) / BATCH) * step
                m.table[1] += both
                m.table[0] += seen[..., 1]
            for c, x in enumerate(slots):
                at = 2 * x + bit
                if c:
                    np.add.at(self.counts[c], at, np.float32(1))
                else:
                    nodes = 2 * (len(self.code.words) + 1)
                    self.counts[c, :nodes] += np.bincount(at, minlength=nodes)
            self.seen += len(symbol[s])
            if self.seen >= FRESH:
                self.fold()

    def costs(self, symbol: np.ndarray, context: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bits that each token's code costs."""
        one, two = wordmix.before(context, first)
        out, rate = np.zeros(len(symbol)), (self.mixer.table[0] / self.mixer.table[1]).astype(np.float32).ravel()
        for i in range(0, len(symbol), wordmix.TOKENS):
            s = slice(i, i + wordmix.TOKENS)
            token, depth, bit, slots = wordmix.events(self.code, symbol[s], one[s], two[s])
            gate, odds = self._inputs(depth, slots)
            x = self._mixed(gate, odds)
            at = (x + np.float32(LIMIT)) * np.float32((STEPS - 1) / (2 * LIMIT))
            low = np.minimum(at.astype(np.int64), STEPS - 2)
            part, cell = at - low.astype(np.float32), low * 256 + gate
            p = (1 / (1 + np.exp(-x)) + rate[cell] * (1 - part) + rate[cell + 256] * part) / 2
            p = np.clip(np.abs(p - (1 - bit)), np.float32(1e-6), np.float32(1 - 1e-6))  # of a zero, what is left of one
            out[s] = np.bincount(token, -np.log(p), minlength=len(symbol[s]))
        return out / np.log(2)


def _with_ends(x: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all texts' tokens with that of the end after each text, and where the texts start."""
    return np.insert(x, offsets[1:], end), offsets[:-1] + np.arange(len(offsets) - 1)


_MESSAGE = "block long, chunk long, words binary, counts binary"
_TABLE = "chunk long, words binary, counts binary, n long, v long, once long, twice long"
_SUMS = "part int, task int, sums binary"


def _plain(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _chunk_of(words: list[bytes], chunks: int) -> np.ndarray:
    return (np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)) % np.uint64(chunks)).astype(np.int64)


def _arrow(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}
    named = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(named)], [n for n, _ in named])


def _list(data: bytes) -> list[bytes]:
    return [b"\n" if w == b"" else w for w in _unzip(data).split(b" ")]


def _text(words: list[bytes]) -> bytes:
    return _zip(b" ".join(b"" if w == b"\n" else w for w in words))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows of one block, of which there are about BLOCK_CHARS characters."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        ends = [*(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for start, end in zip([0, *ends], ends):
            if held and end > start and held[-1].column("block")[0].as_py() != block[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _added(sums: DataFrame, tasks: int) -> DataFrame:
    """The tasks' sums of each part, added up in two steps, so that no group has more rows than about the root of the tasks' number."""

    def add(parts: pa.Table) -> pa.Table:
        part, task = (parts.column(c)[0].as_py() for c in ("part", "task"))
        total = sum(np.frombuffer(_unzip(x), np.float64) for x in parts.column("sums").to_pylist())
        return _arrow(_SUMS, [(part, task, _zip(total.tobytes()))])

    fan = max(1, int(np.sqrt(tasks)))
    return sums.withColumn("task", F.col("task") % fan).groupBy("part", "task").applyInArrow(add, _SUMS).groupBy("part").applyInArrow(add, _SUMS)


def _sums(sums: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    yield from _arrow(_SUMS, [(part, task, _zip(x.astype(np.float64).tobytes())) for part, x in sums]).to_batches()


def _blend(spelled: np.ndarray, count: np.ndarray, mass: int, kinds: int, discount: float) -> np.ndarray:
    """Bits after the escape: a share by the training count, less the discount, and the spelling's part of the rest.

    ``mass`` and ``kinds`` are the occurrences and the number of words without codes in training.
    """
    if not mass:
        return spelled
    with np.errstate(divide="ignore"):
        known = np.log2(np.maximum(count - discount, 0) / mass)
    return -np.logaddexp2(known, np.log2(discount * kinds / mass) - spelled)


def _tally(table: pa.Table) -> tuple[list[list[bytes]], list[np.ndarray], pa.Array]:
    """Words of each message, their codes among the distinct words, and these."""
    lists = [_list(x) for x in table.column("words").to_pylist()]
    coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum([len(x) for x in lists])
    return lists, np.split(codes, ends[:-1]), coded.dictionary


def score(docs: DataFrame, block_chars: int = BLOCK_CHARS, chunk_chars: int = CHUNK_CHARS, model_to: list | None = None) -> DataFrame:
    """Unigram and context-mixing scores of each row of ``docs``.

    Learns from the documents with crc32(doc_id as text) mod 7 other than 2. Returns doc_id, held_out, n_tokens
    (words, lower-cased in A-Z, and one end), n_known (tokens with a training count), train_tokens (N), base_score
    (sum of log10((c + 1) / (N + V + 1)) over the tokens), score (log10 of the model's probability of the text),
    bits and bytes (of the coded text; their ratio is the bits per byte). ``model_to`` gets the word model, the tables
    of zeros and ones for spelling, their mixer, and what ``_blend`` is given of the words without codes.

    Null and empty texts are one end token; a null doc_id counts as training; equal rows count as often as they
    occur; an empty table gives no rows. Other columns don't matter.
    """
    spark = docs.sparkSession
    t = docs.select(F.col("doc_id").cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    chars = t.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = blocks(chars, chunk_chars)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    t = t.select(F.pmod(F.xxhash64("doc_id", F.length("text"), "text"), F.lit(blocks(chars, block_chars))).alias("block"), "doc_id", held.alias("held_out"), "text")

    def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes], dict[int, np.ndarray]]:
        """Codes of the words, offsets, distinct words, and the numbers of each chunk's words in their order."""
        codes, offsets, words = split(pc.ascii_lower(table.column("text")))
        words = pa.concat_arrays([words.cast(pa.binary()), pa.array([b"\n"])])
        by_name, words = pc.sort_indices(words).to_numpy().astype(np.int64), _plain(words)
        chunk = _chunk_of(words, chunks)[by_name]
        by_chunk = np.argsort(chunk, kind="stable")
        chunk, parts = chunk[by_chunk], by_name[by_chunk]
        ends = np.flatnonzero(np.diff(chunk)) + 1
        return codes, offsets, words, dict(zip(chunk[np.concatenate([[0], ends])].tolist(), np.split(parts, ends)))

    def send(table: pa.Table) -> pa.Table:
        codes, offsets, words, parts = tokens(table)
        learnt = ~table.column("held_out").to_numpy()
        count = np.bincount(codes[learnt[owner(offsets)]], minlength=len(words))
        count[-1] = learnt.sum()
        out = []
        for c, mine in parts.items():
            out.append((table.column("block")[0].as_py(), c, _text([words[i] for i in mine.tolist()]), _zip(count[mine].astype(np.uint32).tobytes())))
        return _arrow(_MESSAGE, out)

    def add(table: pa.Table) -> pa.Table:
        _, codes, words = _tally(table)
        total = np.zeros(len(words))
        for c, x in zip(codes, table.column("counts").to_pylist()):
            total[c] += np.frombuffer(_unzip(x), np.uint32)
        by_name = pc.sort_indices(words).to_numpy()  # the order of messages is left to chance
        words, total = words.take(pa.array(by_name)), total[by_name]
        return _arrow(_TABLE, [(table.column("chunk")[0].as_py(), _text(_plain(words)), total.astype(np.int64).tobytes(), int(total.sum()), *(int(x.sum()) for x in (total > 0, total == 1, total == 2)))])

    sent = written(t.groupBy("block").applyInArrow(send, _MESSAGE), "lm-words")
    table = written(sent.groupBy("chunk").applyInArrow(add, _TABLE), "lm-counts")
    n, v, once, twice = (x or 0 for x in table.agg(*(F.sum(c) for c in ("n", "v", "once", "twice"))).first())

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                words, count = _list(words), np.frombuffer(counts, np.int64)
                top = [i for i in np.argsort(-count, kind="stable")[:CODED].tolist() if count[i] > 1]
                yield from _arrow("word binary, n long", [(words[i], int(count[i])) for i in top]).to_batches()

    coded = table.select("words", "counts").mapInArrow(frequent, "word binary, n long").orderBy(F.desc("n"), "word").limit(CODED).collect()  # the dictionary, of a fixed size
    code = wordmix.Code([bytes(r.word) for r in coded], [r.n for r in coded], int(n) - sum(r.n for r in coded))
    rare = (int(n) - sum(r.n for r in coded), int(v) - len(coded), once / (once + 2 * twice) if once else 0.5)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, first = WordModel(code), Mixer(gates=wordmix.GATES, contexts=wordmix.CONTEXTS)
        weights, table, mass = np.zeros_like(first.weights), np.zeros_like(first.table), 0
        for run in _runs(batches):
            model.mixer, tokens = Mixer(gates=wordmix.GATES, contexts=wordmix.CONTEXTS), 0
            for piece in pieces(run):
                codes, offsets, words = split(pc.ascii_lower(piece.column("text")))
                symbol, context = code.ids([*_plain(words.cast(pa.binary())), b"\n"])
                word, starts = _with_ends(codes, offsets, len(words))
                model.read(symbol[word], context[word], starts)
                tokens += len(word)
            model.fold()
            weights, table, mass = weights + model.mixer.weights * tokens, table + model.mixer.table - first.table, mass + tokens
        if mass:
            flat = model.total.ravel()
            yield from _sums([*((r, flat[r * RANGE : (r + 1) * RANGE]) for r in range(len(flat) // RANGE)), (-1, np.concatenate([weights.ravel(), table.ravel(), [mass]]))])

    # The word model is of fixed size: 2^20 pairs of counts for each context, 48 MB.
    words_model = WordModel(code, np.zeros((wordmix.CONTEXTS, 2 * wordmix.SLOTS)))
    flat = words_model.counts.ravel()
    streams = t.where(~F.col("held_out")).select("block", F.xxhash64("doc_id", "text").alias("at"), "doc_id", "text").repartition("block").sortWithinPartitions("block", "at", "doc_id", "text").select("block", "text")
    for r in _added(streams.mapInArrow(read, _SUMS), blocks(chars, block_chars)).toLocalIterator():
        if r.part >= 0:
            flat[r.part * RANGE : (r.part + 1) * RANGE] = np.frombuffer(_unzip(r.sums), np.float64)
        else:
            x, m = np.frombuffer(_unzip(r.sums), np.float64), words_model.mixer
            m.table = m.table + x[m.weights.size : -1].reshape(m.table.shape)
            m.weights = (x[: m.weights.size] / x[-1]).reshape(m.weights.shape)
    words_model.finish()
    if model_to is None:
        words_model.counts = words_model.counts[:, :0]
    spoken = spark.sparkContext.broadcast(words_model)

    def seen(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
        """Training words, in a fixed random order. Each counts once, for what is spelled are mostly new words."""
        for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
            words = [w for w, c in zip(_list(words), np.frombuffer(counts, np.int64).tolist()) if c > 0]
            words = [words[i] for i in np.random.default_rng(len(words)).permutation(len(words))]
            for i in range(0, len(words), 50_000):
                yield words[i : i + 50_000]

    def counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(2 * CONTEXTS * SLOTS)
        for batch in batches:
            for words in seen(batch):
                for _, _, bit, slots in Words(words).bits():
                    of_bit = bit * np.int64(CONTEXTS * SLOTS)
                    for c, s in enumerate(slots):
                        np.add.at(flat, s + (of_bit + c * SLOTS), 1.0)
        if flat.any():
            flat = flat.reshape(2, -1)
            yield from _sums([(r, flat[:, r * RANGE : (r + 1) * RANGE]) for r in range(CONTEXTS * SLOTS // RANGE)])

    # The model is a table of fixed size: CONTEXTS * SLOTS pairs of 32-bit counts, 40 MB.
    n0, n1 = np.zeros((2, CONTEXTS * SLOTS), np.float32)
    for r in table.select("words", "counts").transform(lambda d: _added(d.mapInArrow(counters, _SUMS), chunks)).toLocalIterator():
        n0[r.part * RANGE : (r.part + 1) * RANGE], n1[r.part * RANGE : (r.part + 1) * RANGE] = np.frombuffer(_unzip(r.sums), np.float64).reshape(2, -1)
    tables = spark.sparkContext.broadcast((n0.reshape(CONTEXTS, SLOTS), n1.reshape(CONTEXTS, SLOTS)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n0, n1 = tables.value
        both, first, mass = np.empty(n0.shape, np.complex64), Mixer(), 0  # a slot's zeros and ones in one look
        both.real, both.imag = n0, n1
        weights, table = np.zeros_like(first.weights), np.zeros_like(first.table)
        for batch in batches:
            for row in range(batch.num_rows):
                mixer, learnt = Mixer(), 0
                for words in seen(batch.slice(row, 1)):
                    w = Words(words)
                    for k in range(8):
                        for i in range(0, len(w.bytes), BATCH):
                            at = slice(i, i + BATCH)
                            known, bit, slots = w.bit(k, at)
                            # what is known of the other words: one count less for the bit that comes
                            zero, pairs = bit == 0, [both[c][s] for c, s in enumerate(slots)]
                            zeros, ones = [np.maximum(x.real - zero, 0) for x in pairs], [np.maximum(x.imag - bit, 0) for x in pairs]
                            gate = w.near[at] * LEVELS + _level(zeros[-1] + ones[-1])
                            mixer.learn(gate, np.stack([_odds(a, b) for a, b in zip(zeros, ones)], 1), known, bit, np.ones(len(bit)))
                    learnt += len(words)
                weights, table, mass = weights + mixer.weights * learnt, table + mixer.table - first.table, mass + learnt
        if mass:
            yield from _sums([(0, np.concatenate([weights.ravel(), table.ravel(), [mass]]))])

    model = Mixer()
    for r in _added(table.select("words", "counts").mapInArrow(learn, _SUMS), chunks).collect():  # one row of a fixed number of parameters
        x, k = np.frombuffer(_unzip(r.sums), np.float64), model.weights.size
        model.weights, model.table = (x[:k] / x[-1]).reshape(model.weights.shape), model.table + x[k:-1].reshape(model.table.shape)
    weights = (model.weights, model.table)

    def reply(messages: pa.Table, own: pa.Table) -> pa.Table:
        if not messages.num_rows:
            return _arrow("block long, chunk long, counts binary, prices binary", [])
        words = _list(own.column("words")[0].as_py())
        count = np.frombuffer(own.column("counts")[0].as_py(), np.int64)
        price = _blend(_prices(words, *tables.value, Mixer(*weights)), count, *rare).astype(np.float32)
        at = {w: i for i, w in enumerate(words)}
        out = []
        for block, chunk, data in zip(*(messages.column(c).to_pylist() for c in ("block", "chunk", "words"))):
            mine = np.array([at[w] for w in _list(data)])
            out.append((block, chunk, _zip(count[mine].tobytes()), _zip(price[mine].tobytes())))
        return _arrow("block long, chunk long, counts binary, prices binary", out)

    def total(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, bits double, bytes long"
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())], [x.split()[0] for x in names.split(", ")])
        codes, offsets, words, parts = tokens(table)
        count, price = np.zeros(len(words)), np.zeros(len(words))
        for c, counts, prices in zip(*(replies.column(x).to_pylist() for x in ("chunk", "counts", "prices"))):
            mine = parts[c]
            count[mine], price[mine] = np.frombuffer(_unzip(counts), np.int64), np.frombuffer(_unzip(prices), np.float32)
        doc, rows = owner(offsets), table.num_rows
        symbol, context = code.ids(words)
        word, starts = _with_ends(codes, offsets, len(words) - 1)
        cost = spoken.value.costs(symbol[word], context[word], starts) + np.where(symbol[word] == code.escape, price[word], 0)
        bits = np.bincount(np.repeat(np.arange(rows), np.diff(offsets) + 1), cost, minlength=rows)
        size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        sums = lambda x, end: np.bincount(doc, x[codes], minlength=rows) + end
        columns = [table.column("doc_id"), table.column("held_out"), pa.array(np.diff(offsets) + 1), pa.array(sums(count > 0, count[-1] > 0).astype(np.int64)), pa.array(sums(np.log10(count + 1), np.log10(count[-1] + 1))), pa.array(bits), pa.array(sums(size, 1).astype(np.int64))]
        return pa.table(columns, [x.split()[0] for x in names.split(", ")])

    replies = sent.select("block", "chunk", "words").groupBy("chunk").cogroup(table.groupBy("chunk")).applyInArrow(reply, "block long, chunk long, counts binary, prices binary")
    out = t.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, bits double, bytes long")
    unit = float(np.log10(float(n) + float(v) + 1))
    if model_to is not None:
        model_to += [words_model, *tables.value, Mixer(*weights), rare]
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("bits") * F.lit(-float(np.log10(2.0)))).alias("score"), "bits", "bytes",
    )
