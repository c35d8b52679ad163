"""Words of Arrow text batches as numpy arrays (shared by the shingle and word operators).

A batch's UTF-8 bytes are lower-cased (A-Z only), split at separator bytes and every word
gets a 64-bit hash, without a Python object per word. Separators are bytes below 0x80, so
multi-byte characters are never cut.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18          # bytes hashed at once (the temporary arrays stay in the cache)
BATCH_BYTES = 1 << 22          # text bytes handled at once by the operators
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D     # odd, so it has an inverse modulo 2**64


def _separators(ranges) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        t[lo:hi + 1] = True
    return t


SPACE_SEPARATED = _separators([(0x20, 0x20), (0x09, 0x0D)])
ALNUM_WORDS = _separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * _MULT) | np.uint64(1)


@lru_cache(4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:            # doubling: out[done:2*done] = out[:done] * base**done
        take = min(done, n - done)
        out[done:done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


@dataclass
class Words:
    """``start``/``end``: byte positions in ``buf``; ``first``: index of each text's first
    word (one more entry than texts); ``hash``: uint64 per word."""
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.end[i]].tobytes()


def string_buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls read as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + n + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def words_of(arr, separators: np.ndarray = SPACE_SEPARATED) -> Words:
    raw, off = string_buffers(arr)
    buf = raw.copy()
    upper = (buf >= 65) & (buf <= 90)
    buf[upper] += 32
    n = len(buf)
    inside = ~separators[buf]
    edge = np.zeros(n + 1, dtype=bool)         # a text starts here
    edge[off] = True
    prev = np.zeros(n, dtype=bool)
    if n:
        prev[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~prev | edge[:n]))
    nxt = np.zeros(n, dtype=bool)
    if n:
        nxt[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~nxt | edge[1:])) + 1
    first = np.searchsorted(start, off).astype(np.int64)
    return Words(buf, start, end, first, _hashes(buf, start, end))


def _hashes(buf, start, end) -> np.ndarray:
    out = np.empty(len(start), dtype=np.uint64)
    values, i = _byte_values(), 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + CHUNK_BYTES, side="right")))
        hi = end[j - 1]
        n = int(hi - lo)
        size = 1 << max(18, (n - 1).bit_length())
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[buf[lo:hi]] * _powers(size, False)[:n], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * _powers(size, True)[s]
        i = j
    return mix64(out + np.uint64(1))


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries (callers mask runs over text ends)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for i in range(1, k):
        acc = acc * _MULT + h[i:i + n]
    return mix64(acc)


def batches(it, column: str, limit: int = BATCH_BYTES):
    """Slices of Arrow record batches whose text column holds about ``limit`` bytes."""
    for batch in it:
        col = batch.column(batch.schema.get_field_index(column))
        n = batch.num_rows
        if n == 0:
            continue
        _, off = string_buffers(col)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
