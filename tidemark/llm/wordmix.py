"""A word model for running text: bits of dictionary codes, mixed from contexts of the words before.

The most frequent words have Huffman codes; all others share the escape symbol. Each bit of a code is predicted from
counts in three contexts: the place in the code alone, with the word before, and with the two words before; a word
outside the dictionary stands for its last two bytes there. A mixer weighs the predictions' log
odds; a gate picks the weights by how often the longer contexts have been seen.
"""

from __future__ import annotations

import heapq
from itertools import repeat

import numpy as np

#: Contexts; slots of each one's table; levels of a context's count that the gate tells apart; smoothing of a counter.
CONTEXTS, SLOTS, LEVELS, PRIOR = 3, 1 << 20, np.array([1, 3, 12, 60]), 0.15
#: Ids of words outside the dictionary, by their last two bytes; the id before a text's first word.
ENDINGS, START = 1 << 16, (1 << 16) + 1
#: Tokens that are taken at a time.
TOKENS = 1 << 16
GATES = (len(LEVELS) + 1) ** 2 * 4


class Code:
    """Huffman codes of the words with counts; the last symbol is the escape."""

    def __init__(self, words: list[bytes], counts: list[int], escapes: int):
        self.words, n = words, len(words) + 1
        heap = [(c, i) for i, c in enumerate([*counts, max(1, escapes)])]
        heapq.heapify(heap)
        parent, side, at = {}, {}, n
        while len(heap) > 1:
            (x, i), (y, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i], side[i], parent[j], side[j] = at, 0, at, 1
            heapq.heappush(heap, (x + y, at))
            at += 1
        paths = []
        for i in range(n):
            path = []
            while i in parent:
                path.append((parent[i] - n, side[i]))
                i = parent[i]
            paths.append(path[::-1])
        self.size = np.array([len(p) for p in paths])
        self.start = np.cumsum(self.size) - self.size
        # all codes one after another: node, place in the code (0 to 3 and further) and bit in one number
        self.flat = np.array([x << 3 | min(i, 3) << 1 | b for p in paths for i, (x, b) in enumerate(p)], np.int32)

    @property
    def escape(self) -> int:
        return len(self.words)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and the id that stands for it as a context."""
        at = {w: i for i, w in enumerate(self.words)}
        symbol = np.fromiter(map(at.get, words, repeat(self.escape)), np.int64, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        text, end = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(size)
        ending = (text[end - 1] << 8) | np.where(size > 1, text[end - 2], 0)
        return symbol, np.where(symbol == self.escape, ending, ENDINGS + 2 + symbol)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def events(code: Code, symbol: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each bit of the symbols' codes: token, place in the code (0 to 3 and further), bit, and the slot of each context."""
    n = code.size[symbol]
    token, end = np.repeat(np.arange(len(symbol)), n), np.cumsum(n)
    at = np.arange(len(token))
    at += np.repeat(code.start[symbol] - end + n, n)
    found = code.flat[at]
    node = (found >> 3).astype(np.int64)
    a, b = _mix(one.astype(np.uint64) + np.uint64(1)), _mix(two.astype(np.uint64) + np.uint64(1 << 40))
    salt, slots = node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), [node]
    for x in (a, a * np.uint64(3) + b):
        slot = np.repeat(x, n)
        slot += salt
        slot *= np.uint64(0xD6E8FEB86659FD93)
        slot >>= np.uint64(44)
        slots.append(slot.view(np.int64))
    return token, (found >> 1) & 3, (found & 1).astype(np.uint8), slots


def levels(seen: np.ndarray) -> np.ndarray:
    """How often a context has been seen, as a level."""
    return sum((seen >= x).view(np.uint8) for x in LEVELS.tolist())


def gates(first: np.ndarray, second: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The gate of each bit from the levels of its second and third context."""
    return ((first * np.uint8(len(LEVELS) + 1) + second) * np.uint8(4) + depth).astype(np.int64)


def before(context: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the contexts of the token before and the one before that; ``first``: where texts start."""
    one, two = np.roll(context, 1), np.roll(context, 2)
    one[first] = two[first] = START
    second = first[first + 1 < len(context)] + 1
    two[second] = START
    return one, two
