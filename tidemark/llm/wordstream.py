"""Texts as flat numpy arrays of words, for functions that run inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that are taken at a time.
PIECE = 6_000_000


def pieces(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch | pa.Table]:
    """``batch`` in runs of rows with about ``limit`` bytes of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: code of each word, offsets of the texts in the codes, the distinct words.

    Null texts have no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    if len(flat) == 0:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), pa.array([], pa.string())
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    before = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])
    coded = (flat if full.all() else flat.filter(pa.array(full))).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), before[ends], coded.dictionary


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
