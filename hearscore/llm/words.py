"""Words of whole texts as numpy arrays.

A batch of texts is one UTF-8 buffer.  Words are found by a table over bytes,
so any word pattern made of ASCII separators fits: every byte of a longer
UTF-8 sequence counts as part of a word.  Words and runs of words get 64-bit
hashes from prefix sums of a polynomial modulo 2**64, which costs a few numpy
operations per byte and none per word in Python.  Hashes are the same in
every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Odd multipliers of the polynomials over bytes and over words.
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASES = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)

# Texts of a slice, in bytes: what one numpy step holds at once is a small
# multiple of it.  A single longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def _table(separators: bytes) -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    return inside


#: ``[^\x20\x09-\x0D]+``
SPACED = _table(bytes([0x20, *range(0x09, 0x0E)]))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (of lower-cased text)
ALNUM = _table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# Powers of each base: one table, as long as the longest slice has needed.
_POWERS: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) <= n:
        steps = np.full(1 << max(16, int(n).bit_length()), base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[base][: n + 1]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of ``values[start:end]`` for every range, the same wherever the
    range lies."""
    n = len(values)
    up = _power_table(base, n)
    down = _power_table(pow(base, -1, 1 << 64), n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Words:
    """Words of several texts: ``offsets[i]:offsets[i + 1]`` are those of the
    i-th; ``starts`` and ``ends`` are positions in ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def texts(self) -> np.ndarray:
        """For every word, the number of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of ``size`` words that lie in one text, and
        the offsets of each text's windows."""
        counts = np.maximum(self.counts - size + 1, 0)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        shift = np.repeat(self.offsets[:-1] - offsets[:-1], counts)
        return np.arange(offsets[-1]) + shift, offsets

    def run_hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the word sequence from ``starts`` to ``ends``."""
        return range_hashes(self.hashes, starts, ends, _WORD_BASES[which])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other and the n + 1 offsets of the
    texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, where, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(where, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return bytes_, offsets - offsets[0]


def words_of(texts: pa.Array, inside: np.ndarray = SPACED, lower: bool = False) -> Words:
    """The words of every text.  A text without words, an empty one and a
    null have none."""
    data, offsets = text_buffer(texts)
    return words_in(data, offsets, inside, lower)


def words_in(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    word = np.zeros(n + 2, dtype=bool)
    word[1:-1] = inside[data]
    # A word never runs on into the next text.
    first = np.zeros(n + 2, dtype=bool)
    first[offsets[:-1][offsets[:-1] < n] + 1] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | first[1:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | first[2:])) + 1
    hashes = range_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends, _BYTE_BASE)
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes)


def spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, each followed by one space, and where they start and end."""
    size = words.ends - words.starts
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    source = np.arange(len(out)) + np.repeat(words.starts - starts, size + 1)
    out[inside] = words.data[source[inside]]
    return out, starts, ends


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES):
    """``batch`` in runs of rows whose texts have about ``size`` bytes."""
    texts = batch.column(column)
    _, offsets = text_buffer(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield batch.slice(start, stop - start)
        start = stop


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours (log2(width) passes)."""
    span, lows = 1, values
    while span * 2 <= width:
        lows = np.minimum(lows[:-span], lows[span:])
        span *= 2
    rest = width - span
    return np.minimum(lows[: len(lows) - rest], lows[rest:]) if rest else lows
