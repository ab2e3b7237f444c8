"""Words, lines and hashes of many texts at once, on the UTF-8 bytes of an Arrow column.

Every function works on a *block*: the bytes of some rows laid end to end, and ``bounds``, the
offset at which each row begins, with the total length last. A block holds about ``BLOCK`` bytes,
and one row at least; no text is ever cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 2 << 20
# Longer segments are hashed one by one with XXH64, shorter ones all at once. A polynomial modulo a power
# of two has fixed collisions among texts of a thousand letters and more, whatever its base.
LONG_SEGMENT = 64

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(predicate) -> np.ndarray:
    """A look-up table over byte values."""
    return np.array([predicate(i) for i in range(256)])


SPACE = table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
NOT_SPACE = ~SPACE
# Digits, lower-case letters and every byte of a character beyond ASCII.
ALPHANUMERIC = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
CONTINUATION = table(lambda b: 0x80 <= b < 0xC0)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of each block; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def release() -> None:
    """Give memory that this worker has freed back to the system; a worker is used again and again, and its pools would keep it."""
    pa.default_memory_pool().release_unused()
    # Only the GNU C library has this one.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what earlier tasks and each batch have left is given back before the next one."""
    release()
    for batch in batches:
        yield batch
        del batch
        release()


def spans(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes, and the first run of each row."""
    return runs(member[data], bounds)


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true items, and the first run of each row; rows cut runs."""
    n = len(inside)
    padded = np.zeros(n + 2, dtype=bool)
    padded[1:-1] = inside
    first, last = inside & ~padded[:-2], inside & ~padded[2:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between line feeds, and the first line of each row."""
    feeds = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([bounds[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([feeds, bounds[1:]]), kind="stable")
    firsts = np.searchsorted(feeds, bounds) + np.arange(len(bounds))
    return starts, ends, firsts


def owners(firsts: np.ndarray) -> np.ndarray:
    """The row of each item, from the first item of each row."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power(size: int) -> list[np.ndarray]:
    if len(_powers[0]) < size:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(size, base, dtype=_U)
                steps[0] = 1
                _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, in this order."""
    with np.errstate(over="ignore"):
        return mix(a * _U(0xD6E8FEB86659FD93) + b)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment ``data[start:end]``; segments come in rising order."""
    out = np.zeros(len(starts), dtype=_U)
    lengths = ends - starts
    for i in np.flatnonzero(lengths > LONG_SEGMENT):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    short = lengths <= LONG_SEGMENT
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        part = np.flatnonzero(short[i:j]) + i
        if len(part):
            low, high = int(starts[part[0]]), int(ends[part].max())
            power, inverse = _power(high - low + 1)
            total = np.zeros(high - low + 1, dtype=_U)
            with np.errstate(over="ignore"):
                np.cumsum((data[low:high].astype(_U) + _U(1)) * power[: high - low], out=total[1:], dtype=_U)
                s, e = starts[part] - low, ends[part] - low
                out[part] = mix((total[e] - total[s]) * inverse[s] + lengths[part].astype(_U))
        i = j
    return out


def windows(h: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each window of ``width`` items within one row."""
    count = len(h) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    row = owners(firsts)
    starts = np.flatnonzero(row[:count] == row[width - 1 :])
    out = h[starts]
    for k in range(1, width):
        out = pair(out, h[starts + k])
    return starts, out


def per_row(positions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the rising positions lie in each row."""
    return np.diff(np.searchsorted(positions, bounds))


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments with one space after each: the bytes, each segment's start there, and the place in ``data`` that each byte came from."""
    lengths = ends - starts
    after = np.concatenate([[0], np.cumsum(lengths + 1)])
    begin = after[:-1]
    origin = np.arange(int(after[-1])) + np.repeat(starts - begin, lengths + 1)
    out = data[np.minimum(origin, len(data) - 1)] if len(data) else np.zeros(0, np.uint8)
    out[begin + lengths] = 0x20
    return out, begin, origin
