"""Word shingles of whole texts as 64-bit hashes, in numpy over Arrow batches.

A batch's texts are one byte array with offsets, so bytes are classified, words
found and hashed, and shingles formed for many documents at once; only the
sorting into a set runs document by document. Memory follows ``CHUNK`` bytes of
text (or one longer document), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_RADIX = _U(0x2545F4914F6CDD1D)

_byte = np.arange(256)
GAP_BYTE = (_byte == 32) | ((_byte >= 9) & (_byte <= 13))
#: A-Z lower-cased, other bytes as they are.
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _K2
    x = (x ^ (x >> _U(27))) * _K3
    return x ^ (x >> _U(31))


#: A fixed random number for each byte, of its lower-case form.
BYTE_HASH = mix((LOWER.astype(_U) + _U(1)) * _K1)


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows of about ``size`` bytes;
    null texts are empty."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, end, data[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each document the index of its first word
    (one more entry than documents)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    word = ~GAP_BYTE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    first = np.flatnonzero(word & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    last = np.flatnonzero(word & (~after | edge[1:])) + 1
    length = last - first
    if len(first) == 0:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(word)
    ends = np.cumsum(length)
    place = np.arange(len(at)) - np.repeat(ends - length, length)
    power = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(int(length.max()) - 1, _RADIX, _U)]))
    h = np.add.reduceat(BYTE_HASH[data[at]] * power[place], ends - length)
    return mix(h + length.astype(_U) * _K1), np.searchsorted(first, offsets)


def shingle_hashes(words: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    """For each document its sorted distinct shingles of ``width`` words; with
    fewer words the whole sequence is one; without words none."""
    n = len(words) - width + 1
    if n > 0:
        s = np.zeros(n, _U)
        for j in range(width):
            s = mix(s * _K1 + words[j:j + n] + _U(width))
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= width:
            out.append(np.unique(s[a:b - width + 1]))
        elif b > a:
            one = np.zeros(1, _U)
            for j in range(a, b):
                one = mix(one * _K1 + words[j] + _U(b - a))
            out.append(one)
        else:
            out.append(np.zeros(0, _U))
    return out


def document_sets(batch: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, end row, shingle sets) over the rows of a batch."""
    for first, end, data, offsets in chunks(batch, column):
        words, starts = word_hashes(data, offsets)
        yield first, end, shingle_hashes(words, starts, width)
