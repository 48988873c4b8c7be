"""Words of whole texts as arrays: spans, hashes and windows of words, for Arrow batches.

A block is a run of rows of one batch, about ``BLOCK_BYTES`` of text, so the arrays of a task stay
small however many rows a batch has; a longer text is a block of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
# Odd multipliers, modulo 2^64.
OF_BYTES = 0x9E3779B97F4A7C15
OF_WORDS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

# Bytes that separate words: space, tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Bytes of a word whose numbers are looked up.
SHORT = 64
_short: dict[int, np.ndarray] = {}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 to base^n and their inverses, modulo 2^64; kept for the next block."""
    known = _powers.get(base)
    if known is None or len(known[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            pair.append(np.cumprod(table, dtype=np.uint64))
        known = _powers[base] = (pair[0], pair[1])
    return known


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as strings without nulls: a null has no words."""
    return batch.column(name).cast(pa.large_string()).fill_null("")


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds of the rows in them)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, all_bytes[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(buf: np.ndarray, bounds: np.ndarray, space: np.ndarray = IS_SPACE):
    """(start, end, row) of every word; a word does not go over the end of its row."""
    inside = ~space[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[bounds] = True
    starts = np.flatnonzero(edge[:-1] & inside)
    ends = np.flatnonzero(edge[1:] & inside) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def _of_bytes(placed: np.ndarray, seed: int) -> np.ndarray:
    """64 bits for a byte and its place in a word."""
    return mixed(placed * np.uint64(OF_BYTES) + np.uint64(OF_WORDS[seed]))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans come in order and do not overlap. Hashes of the
    two seeds are independent of each other.

    Every byte is mixed with its place in the span before it is added. Sums of powers of one number
    would not do: texts that collide for every such number can be written down."""
    if seed not in _short:
        _short[seed] = _of_bytes(np.arange(SHORT << 8, dtype=np.uint64), seed)
    if not len(starts):
        return np.empty(0, np.uint64)
    # The bytes between spans count on in the one before and are left out of its sum.
    whole = buf[starts[0] :]
    begin = (starts - starts[0]).astype(np.int32 if len(whole) < 1 << 22 else np.int64)
    place = np.arange(len(whole), dtype=begin.dtype)
    place -= np.repeat(begin, np.diff(np.append(begin, begin.dtype.type(len(whole)))))
    lengths = ends - starts
    late = np.flatnonzero(place >= SHORT) if int(lengths.max()) > SHORT else ()
    placed = place << 8
    placed |= whole
    sums = np.empty(len(whole) + 1, np.uint64)
    sums[0] = 0
    of_each = _short[seed][placed & ((SHORT << 8) - 1)]
    if len(late):
        of_each[late] = _of_bytes(placed[late].astype(np.uint64), seed)
    np.cumsum(of_each, out=sums[1:])
    found = sums[ends - starts[0]] - sums[begin]
    return mixed(found + lengths.astype(np.uint64) * np.uint64(OF_WORDS[seed]))


def window_hashes(words: np.ndarray, k: int, base: int = OF_WORDS[0]) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive words, by the place of the first."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = powers(base, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * inverse[:n])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
