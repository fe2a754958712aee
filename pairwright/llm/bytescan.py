"""Words, shingles and lines of many texts at once, as numpy passes over one UTF-8 buffer.

Hashes are 64-bit: a polynomial over a word's bytes with a fixed odd base, then a
mixer. All functions take and return whole-batch arrays with offsets; none loops over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed odd base of the polynomial, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, np.bool_)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept for later batches."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have, size = np.ones(1, np.uint64), 1
        while size < n:
            have = np.concatenate([have, have * np.uint64(pow(base, size, 1 << 64))])
            size *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and len + 1 offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64, count=len(texts) + 1 + texts.offset)[texts.offset:]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[starts[i]:ends[i]] for each i."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(BASE, len(data)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power_table(INVERSE, len(data))[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch of texts.

    starts, ends: places of the words in data; first: len(texts) + 1 word numbers.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~SPACE[data]
        if len(data):
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            stops = inside.copy()
            stops[:-1] &= ~inside[1:]
            edge = offsets[1:-1]
            edge = edge[(edge > 0) & (edge < len(data))]
            begins[edge] = inside[edge]
            stops[edge - 1] = inside[edge - 1]
            self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets, side="left")
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words within a text, and len(texts) + 1 offsets of them."""
    counts = np.diff(first)
    held = np.maximum(counts - (n - 1), 0)
    offsets = np.concatenate([[0], np.cumsum(held)])
    if offsets[-1] == 0:
        return np.zeros(0, np.uint64), offsets
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total *= np.uint64(0xFF51AFD7ED558CCD)
        total += hashes[k:len(hashes) - n + 1 + k]
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], held)
    return mix(total[at]), offsets


def shingle_sets(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingles of each text and their offsets.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    hashes = words.hashes()
    all_, offsets = windows(hashes, words.first, n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        one = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            value = int(words.counts[d]) * 0x2545F4914F6CDD1D
            for h in hashes[words.first[d]:words.first[d + 1]]:
                value = (value * 0xFF51AFD7ED558CCD + int(h) + 1) & _MASK
            one[i] = value
        sizes = np.diff(offsets)
        sizes[short] = 1
        merged = np.empty(int(sizes.sum()), np.uint64)
        new = np.concatenate([[0], np.cumsum(sizes)])
        single = np.zeros(len(merged), np.bool_)
        single[new[:-1][short]] = True
        merged[single], merged[~single] = mix(one), all_
        all_, offsets = merged, new
    parts, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for d in np.flatnonzero(np.diff(offsets)):
        own = np.sort(all_[offsets[d]:offsets[d + 1]])
        keep = np.empty(len(own), np.bool_)
        keep[0] = True
        np.not_equal(own[1:], own[:-1], out=keep[1:])
        own = own[keep]
        parts.append(own)
        sizes[d] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", max_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about max_bytes of text; one longer text stays whole.

    A pass holds some 100 bytes for each of these. At the end the worker gives unused memory back.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(text_col))
        ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop
    give_back()


#: What a worker keeps between batches and tasks, by operator: how to drop it.
_kept: dict[str, list] = {"": [_powers.clear]}
_claimed = [""]


def keeps(operator: str, drop) -> None:
    """Says how to drop what an operator keeps in a worker."""
    _kept.setdefault(operator, []).append(drop)


def claim(operator: str) -> None:
    """The worker works for this operator from now on: what it has kept for others goes."""
    if _claimed[0] != operator:
        for name, drops in _kept.items():
            for drop in drops if name != operator else ():
                drop()
        _claimed[0] = operator
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
