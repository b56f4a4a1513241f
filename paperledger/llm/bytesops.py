"""Vectorised work on the bytes of many texts at once: words, rolling hashes, packed entries.

Everything here runs inside tasks on one bounded slice of rows; Spark deals the slices out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U = np.uint64
#: Bytes of text that are worked on at once.
SLICE_BYTES = (2 << 20) - 64

#: The bytes that end a word: blank and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: ASCII upper case to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_CHECK_BASE = 0xBB67AE8584CAA73B


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A random-looking value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x632BE59BD9B4E019))

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, n + n // 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


class Rolling:
    """Polynomial hashes of any stretch of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        n = len(values)
        self.base = base
        p, _ = powers(base, n + 1)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(values * p[:n], out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end]: equal stretches have equal hashes wherever they stand."""
        _, inv = powers(self.base, len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * inv[start] + (end - start).astype(U))

    def every(self, width: int) -> np.ndarray:
        """Hash of each stretch of ``width`` values, in order of their starts."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=U)
        _, inv = powers(self.base, len(self.sums))
        return mix((self.sums[width:] - self.sums[:n]) * inv[:n] + U(width))


def rolling_bytes(data: np.ndarray) -> Rolling:
    return Rolling(BYTE_VALUE[data], _BYTE_BASE)


def check_bytes(data: np.ndarray) -> Rolling:
    """Hashes independent of rolling_bytes': both together are 128 bits."""
    return Rolling(mix(BYTE_VALUE ^ U(_CHECK_BASE))[data], _CHECK_BASE)


def rolling_words(hashes: np.ndarray) -> Rolling:
    return Rolling(hashes, _WORD_BASE)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``most`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a slice of texts: start, end (bytes), text number, and a 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        if lower:
            data = LOWER[data]
        n = len(data)
        self.data, self.offsets = data, offsets
        inside = ~SPACE[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | first[1:n]
            ends[:-1] &= ~inside[1:] | first[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        edges = np.searchsorted(self.start, offsets)
        self.counts = np.diff(edges)  # words of each text
        self.first = edges[:-1]  # number of each text's first word
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.hash = rolling_bytes(data).stretch(self.start, self.end)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all stretches of ``width`` words inside one text, and the numbers of their first words."""
        h = rolling_words(self.hash).every(width)
        if not len(h):
            return h, np.zeros(0, np.int64)
        ok = self.text[: len(h)] == self.text[width - 1 :]
        return h[ok], np.flatnonzero(ok)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket number from the high bits: hashes in ascending order have buckets in ascending order."""
    return ((hashes >> U(32)) * U(n)) >> U(32)


def pack(*columns: np.ndarray) -> bytes:
    """Equally long columns of 64-bit integers as byte planes, compressed."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(np.ascontiguousarray(c, dtype="<u8" if c.dtype == U else "<i8").view(np.uint8).reshape(n, 8).T) for c in columns]
    return n.to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    """Inverse of pack; kinds holds u or i for each column."""
    n = int.from_bytes(blob[:4], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8).reshape(len(kinds), 8, n)
    return [np.ascontiguousarray(raw[k].T).view("<u8" if kind == "u" else "<i8").ravel() for k, kind in enumerate(kinds)]


def unpack_all(blobs: Iterable[bytes], kinds: str) -> list[np.ndarray]:
    parts = [unpack(b, kinds) for b in blobs]
    if not parts:
        return [np.zeros(0, U if k == "u" else np.int64) for k in kinds]
    return [np.concatenate([p[k] for p in parts]) for k in range(len(kinds))]


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def ends(starts: np.ndarray, n: int) -> np.ndarray:
    """Ends of the runs that begin at ``starts`` in ``n`` values."""
    return np.append(starts[1:], n) if len(starts) else starts


def binary_rows(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary value for each run of ``values`` (any fixed-size dtype), which begin at ``starts``."""
    values = np.ascontiguousarray(values)
    offsets = np.concatenate((starts, [len(values)])).astype(np.int64) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())
