"""Texts of an Arrow batch as numpy bytes: words, hashes of words, rolling hashes.

All functions work on the UTF-8 bytes of many documents at once, without a Python object
per word. Hashes are sums of byte codes times powers of an odd number, modulo 2^64, so the
hash of any slice is a difference of two running sums; they are mixed before use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21  # texts are taken in slices of about this size; a text is never cut
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_1
    h ^= h >> np.uint64(33)
    h = h * MIX_2
    return h ^ (h >> np.uint64(33))


_CODE = mix(np.arange(1, 257, dtype=np.uint64))  # of each byte, none of them 0


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets between them; a null text is empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``size`` bytes of text each."""
    _, offsets = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def running_hash(data: np.ndarray) -> np.ndarray:
    """n+1 running sums of byte codes times powers of BASE."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODE[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever the slice stands."""
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def inverse_powers(n: int) -> np.ndarray:
    return powers(_INVERSE, n)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, ...]:
    """Start, end and hash of each run of bytes that are no white space (0x20, 0x09-0x0D).

    A word never crosses two texts. The fourth array has the first word of each text, and
    the number of words at its end. A-Z are lower-cased before hashing.
    """
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    filled = ~_SPACE[data]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    opens = filled.copy()
    opens[1:] &= ~filled[:-1] | border[1:-1]
    closes = filled.copy()
    closes[:-1] &= ~filled[1:] | border[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums = running_hash(_LOWER[data] if lower else data)
    hashes = slice_hash(sums, start, end, inverse_powers(len(data)))
    return start, end, hashes, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each text, and the first run of each text.

    A text with fewer words gives its whole sequence as one run; one without words none.
    """
    n_words = np.diff(first)
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    here = np.repeat(np.minimum(n_words, size), counts)
    out = here.astype(np.uint64)
    for k in range(size):
        more = here > k
        value = out * BASE + np.take(hashes, np.minimum(at + k, max(len(hashes) - 1, 0))) if len(hashes) else out
        out = np.where(more, mix(value), out)
    return out, begin


def longs(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(values.view(np.int64))
