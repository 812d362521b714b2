"""Words and window hashes of whole texts, vectorised over Arrow buffers.

All helpers work on UTF-8 bytes.  A word is a run of bytes whose entry in a 256-entry class table is
true, so one pass over the buffer finds the words of a whole slice of documents.  Hashes are 64-bit
and position-independent: the same word gives the same value wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; temporary arrays are about 40 times as large.
SLICE_BYTES = 1 << 18
#: Bytes, or words, of a longer text that temporary arrays are made of; what stays of such a text are the places and hashes of its words.
RUN = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=_U), np.ones(1, dtype=_U)


def not_space() -> np.ndarray:
    """Class table of ``[^\\x20\\x09-\\x0D]``."""
    table = np.ones(256, dtype=bool)
    table[[32, *range(9, 14)]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Class table of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` on lower-cased bytes."""
    table = np.zeros(256, dtype=bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null counts as empty."""
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count and np.diff(offsets)[column.is_null().to_numpy(zero_copy_only=False)].any():  # nulls with bytes: a copy without
        return buffers(pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""))
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    data, offsets = buffers(column)
    low, n = 0, len(column)
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def spans(column: pa.Array, limit: int = 4 * SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of runs of whole rows of about ``limit`` bytes."""
    for low, high, _, _ in slices(column, limit):
        yield low, high


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more than rows)."""
    starts, ends, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.int32 if RUN < len(data) < 1 << 31 else np.int64
    for a in range(0, len(data), RUN):
        b = min(a + RUN, len(data))
        inside = np.zeros(b - a + 2, dtype=bool)  # with the byte before and the byte after
        inside[1 - (a > 0) : len(inside) - (b == len(data))] = table[data[max(a - 1, 0) : b + 1]]
        first = np.zeros(b - a + 1, dtype=bool)
        first[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a] = True
        starts.append((np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1])) + a).astype(place))
        ends.append((np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + a + 1).astype(place))
    starts, ends = (np.concatenate(x[1:] or x) for x in (starts, ends))
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, a run of them at a time."""
    if len(data) <= RUN:
        return _hashes(data, starts, ends)
    out, low = np.empty(len(starts), dtype=_U), 0
    while low < len(starts):
        a = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, a + RUN, "right")))
        if ends[low] - a > RUN:
            out[low] = _long_hash(data[a : ends[low]])
        else:
            out[low:high] = _hashes(data[a : ends[high - 1]], starts[low:high] - a, ends[low:high] - a)
        low = high
    return out


def _long_hash(word: np.ndarray) -> np.uint64:
    """The hash of a word of more than ``RUN`` bytes: sums of its runs, moved to their places."""
    _grow_powers(RUN)
    total = 0
    for a in range(0, len(word), RUN):
        part = word[a : a + RUN].astype(_U) + _U(1)
        total += int((part * _powers[0][: len(part)]).sum(dtype=_U)) * pow(_BASE, a, 1 << 64)
    return mix(np.array([(total + len(word) * 0xD6E8FEB86659FD93) % (1 << 64)], dtype=_U))[0]


def _grow_powers(length: int) -> None:
    global _powers
    if len(_powers[0]) <= length:
        n = max(2 * SLICE_BYTES, length + 1)
        up, down = (np.full(n, p, dtype=_U) for p in (_BASE, _INVERSE))
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _grow_powers(len(data))
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * _powers[0][: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * _powers[1][starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of each run of ``width`` words, also of runs that cross rows: see ``inside_rows``."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = np.empty(n, dtype=_U)
    for a in range(0, n, RUN):
        b = min(a + RUN, n)
        part = hashes[a:b].copy()
        for k in range(1, width):
            part *= _U(seed)
            part += hashes[a + k : b + k]
        out[a:b] = mix(part + _U(seed))
    return out


def row_of(first: np.ndarray) -> np.ndarray:
    """For each word the row it belongs to."""
    return np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))


def inside_rows(rows: np.ndarray, width: int) -> np.ndarray:
    """For each window whether its words are of one row."""
    n = len(rows) - width + 1
    return rows[:n] == rows[width - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def cover(mask: np.ndarray, width: int, n: int) -> np.ndarray:
    """Of ``n`` words, those inside a window of ``width`` words that starts where ``mask`` is true."""
    change = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(mask)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return np.cumsum(change[:-1]) > 0
