"""Words of many texts at once: where they are, and a code for each different one."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words `[^\x20\x09-\x0D]+`, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NOT_SPACE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTERS = (np.arange(256) >= 128) | np.isin(np.arange(256), [*range(48, 58), *range(97, 123)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are worked on together.
BATCH = 2 << 20


class Words(NamedTuple):
    """data: all bytes; bounds: of texts, in bytes; first: of texts, in words; starts, ends: of words;
    codes: of words, into forms."""

    data: np.ndarray
    bounds: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    forms: pa.BinaryArray


def batches(texts: list[bytes], size: int = BATCH):
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= size):
            held += len(texts[j])
            j += 1
        yield i, j
        i = j


def sliced(batch: pa.RecordBatch, size: int = BATCH):
    """Ids and texts, the first two columns of an Arrow batch, as batches cuts them: no more than a cut is copied at once."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
        yield tuple(batch.column(k).slice(i, j - i).to_pylist() for k in (0, 1))
        i = j


def words(texts: list[bytes], kind: np.ndarray, lower: bool) -> Words:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if lower:
        data = LOWER[data]
    inside = kind[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    heads, tails = bounds[:-1][bounds[:-1] < bounds[1:]], bounds[1:][bounds[:-1] < bounds[1:]] - 1
    begin[heads], end[tails] = inside[heads], inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, bounds)
    cuts = np.empty(2 * len(starts) + 1, np.int32)
    cuts[:-1:2], cuts[1::2], cuts[-1] = starts, ends, len(data)
    every = pa.BinaryArray.from_buffers(pa.binary(), 2 * len(starts), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
    coded = every.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
    codes = coded.indices.to_numpy() if len(starts) else np.zeros(0, np.int32)
    return Words(data, bounds, first, starts, ends, codes, coded.dictionary)


def by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values from each bound to the next."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]
