"""Rolling hashes over Arrow string columns with numpy: all words or bytes of a batch of documents at once.

A hash of a run is a polynomial over the ring of 64-bit integers, taken from prefix sums, then mixed.
Two bases give 128 bits where equality decides a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[tuple[int, int], np.ndarray] = {}
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def powers(n: int, base: int, sign: int) -> np.ndarray:
    """base ** (sign * i) for i < n, in the ring of 64-bit integers."""
    have = _POWERS.get((base, sign))
    if have is None or len(have) < n:
        step = _BASES[base] if sign > 0 else pow(_BASES[base], -1, 1 << 64)
        have = np.full(max(n, 1 << 16), step, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base, sign] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string or binary column: first row, last row + 1, their bytes, offsets into these. A run ends at about `most` bytes; a longer text is a run of its own. Nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and for each document the number of words before it (one more entry than documents)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~SPACE[data]
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1]
    end[:-1] &= ~ink[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    start[edge] = ink[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    end[edge] = ink[edge]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n, base, 1), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(n, base, -1)[starts] + (ends - starts).astype(np.uint64))


def run_hashes(items: np.ndarray, length: int, base: int = 0) -> np.ndarray:
    """The hash of items[i : i + length] for each i; runs may cross documents, the caller leaves those out."""
    n = len(items)
    if n < length:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(items * powers(n, base, 1), out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * powers(n, base, -1)[: n - length + 1])


def span_hashes(items: np.ndarray, first: np.ndarray, last: np.ndarray, base: int = 0) -> np.ndarray:
    """The hash of items[f:l] for each pair of bounds."""
    n = len(items)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(items * powers(n, base, 1), out=sums[1:])
    return mix((sums[last] - sums[first]) * powers(max(n, 1) + 1, base, -1)[first] + (last - first).astype(np.uint64))


def halves(digests: list) -> list[pa.Array]:
    """The first 128 bits of hashlib digests as two columns of 64-bit integers."""
    raw = np.frombuffer(b"".join(x.digest()[:16] for x in digests), "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(raw[:, i])) for i in (0, 1)]


def slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of values[i : i + width] for each i, by doubling."""
    pick, out, have = (np.minimum if least else np.maximum), values, 1
    while 2 * have <= width:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        gap = width - have
        out = pick(out[: len(out) - gap], out[gap:])
    return out


def whole(bounds: np.ndarray, total: int, length: int) -> np.ndarray:
    """For each start i <= total - length: whether items i .. i + length - 1 are of one document; bounds has each document's first item, and at last the total."""
    ok = np.ones(max(0, total - length + 1), dtype=bool)
    if length > 1:
        inner = bounds[1:-1]
        for first in np.unique(inner):
            ok[max(0, first - length + 1) : first] = False
    return ok


def anchors(items: np.ndarray, bounds: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions chosen by content alone, and the hashes of the k items there: in any k + width - 1 items of one document, the least k-gram hash is chosen. Equal runs of that length choose equal positions."""
    n = len(items)
    if n < k + width - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = run_hashes(items, k)
    grams = np.where(whole(bounds, n, k), grams, _TOP)
    low = slide(grams, width, True)
    low = np.where(whole(bounds, n, k + width - 1), low, np.uint64(0))
    padded = np.zeros(len(grams) + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(low)] = low
    at = np.flatnonzero((slide(padded, width, False) == grams) & (grams != _TOP))
    return at, grams[at]
