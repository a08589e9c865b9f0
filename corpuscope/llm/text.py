"""Words of Arrow text columns as numpy arrays: places and 64-bit hashes, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def table(members: bytes | range) -> np.ndarray:
    """A look-up array over byte values: True for the members."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: words are everything but ASCII white space
NOT_SPACE = ~table(b" \t\n\x0b\x0c\r")
#: words are ASCII digits, lower-case letters and everything beyond ASCII
ALPHANUMERIC = table(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process and doubled when too short."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """Words of several texts: byte places, text number, first word of each text, 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, members: np.ndarray):
        inside = members[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        self.data, self.starts, self.ends = data, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # words of text i: bounds[i] to bounds[i + 1]
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * powers(BASE, max(1, len(self.data))), out=sums[1:])
        x = (sums[self.ends] - sums[self.starts]) * powers(INVERSE, len(self.data) + 1)[self.starts]
        return mix(x + (self.ends - self.starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside one text, and the number of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    x = np.zeros(n, U64)
    for i in range(k):
        x = x * U64(BASE) + hashes[i : i + n]
    ok = np.ones(n, bool)
    for b in range(1, k):
        cut = bounds[1:-1] - b
        ok[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(ok)
    return mix(x[at]), at


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, at least one row each, so that temporary arrays stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes of their differences, which compress well."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=U64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)
