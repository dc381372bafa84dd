"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.  A word's hash is a polynomial over its
bytes, taken as the difference of two prefix sums (modulo 2**64) over the whole buffer, so the cost is a few array
operations a byte and none a word in Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are hashed together: the arrays stay in the cache.
CHUNK = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: Separators of words without marks: every ASCII byte that is no letter or digit.
MARKS = np.ones(256, dtype=bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_STEP = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n-1), modulo 2**64."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:  # doubling: the second half is the first times base ** done
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 2**64))
            done *= 2
        if n <= CHUNK * 4:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text is alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_spans(texts: list[bytes], between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of all words, and each text's range of words as n+1 offsets.

    ``between`` tells the bytes that part words.  Bytes count in the texts joined by one space.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = ~between[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        edge = np.concatenate(([0], edge))
    first, end = edge[0::2], edge[1::2]
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * _power(_P, len(raw)), out=sums[1:])
    hashed = mix((sums[end] - sums[first]) * _power(_P_INV, len(raw))[first])
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return hashed, first, end, np.searchsorted(first, begin)


def shingle_hashes(hashed: np.ndarray, bounds: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``n`` words of each text, in order, and their n+1 offsets by text.

    A text with fewer words has its whole sequence as one shingle; a text without words has none.
    """
    counts = np.diff(bounds)
    many = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    offsets = np.zeros(len(bounds), dtype=np.int64)
    np.cumsum(many, out=offsets[1:])
    step = _STEP if n <= len(_STEP) else mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(max(0, len(hashed) - n + 1), dtype=np.uint64)
    for k in range(n):
        full += hashed[k : k + len(full)] * step[k]
    text = np.repeat(np.arange(len(counts)), many)
    at = bounds[:-1][text] + (np.arange(offsets[-1]) - offsets[:-1][text])
    out = np.zeros(len(text), dtype=np.uint64)
    long = counts[text] >= n
    out[long] = full[at[long]]
    with np.errstate(over="ignore"):
        for i in np.flatnonzero((counts > 0) & (counts < n)):
            own = hashed[bounds[i] : bounds[i + 1]]
            out[offsets[i]] = (own * step[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own) * 0xA0761D6478BD642F % 2**64)
    return mix(out), offsets


def batches(rows: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of record batches with about CHUNK bytes of text, each with its texts."""
    for batch in rows:
        texts = text_bytes(batch.column(batch.schema.get_field_index(text)))
        for a, b in chunks(texts):
            yield batch.slice(a, b - a), texts[a:b]
