"""Vectorised work on the bytes of Arrow string columns: word spans and word hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: list[np.ndarray] = []

#: Byte tables. SPACED: words are runs without ASCII white space. ALNUM: ASCII letters and digits and all bytes beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; lengths stay the same."""
    out = LOWER[buf]
    wide = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    out[wide] += 32
    return out


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(buf: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about limit bytes; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of bytes that the table holds; no run goes over the end of a row."""
    m = table[buf]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    full = off[1:] > off[:-1]
    at = off[:-1][full]
    first[at] = m[at]
    at = off[1:][full] - 1
    last[at] = m[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse up to n at least; those of a chunk are kept, those of a longer text are not."""
    size = max(n, CHUNK_BYTES) + 1
    if _tables and len(_tables[0]) >= size:
        return _tables
    made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)])) for p in (_P, _P_INV)]
    if n <= CHUNK_BYTES:
        _tables[:] = made
    return made


def running_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial, for hashing many spans of one buffer with spans_from."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(len(buf))[0][: len(buf)], out=total[1:])
    return total


def spans_from(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans starts:ends of the buffer with that running hash."""
    return mix((total[ends] - total[starts]) * _powers(len(total) - 1)[1][starts] + (ends - starts).astype(np.uint64))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[starts:ends], from one running polynomial over the whole buffer."""
    return spans_from(running_hash(buf), starts, ends)


def gather_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, and their offsets."""
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)])
    return buf[np.repeat(starts - off[:-1], size) + np.arange(off[-1])], off


def find_sorted(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in the sorted keys, -1 if it isn't there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)
