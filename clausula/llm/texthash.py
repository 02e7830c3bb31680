"""Hashing of whole batches of texts with numpy: words and word shingles, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multiplier of chained hashes.
_BASE = 0x9E3779B97F4A7C15
#: Bytes that separate words: space and the characters 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A fixed random value for each byte at each of the first places of a word, and for each byte at later ones.
_PLACES = 64
_AT = np.random.default_rng(20240229).integers(0, 1 << 64, (_PLACES + 1, 256), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on every bit of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, and where each text starts and ends in them. Nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], (at - at[0]) if len(at) else np.zeros(1, np.int64)


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    gap = _SPACE[raw]
    start = ~gap
    start[1:] &= gap[:-1]
    first = at[:-1][(at[:-1] < at[1:])]
    start[first] = ~gap[first]  # a text begins a word whatever stands before it
    end = ~gap
    end[:-1] &= gap[1:]
    last = at[1:][(at[:-1] < at[1:])] - 1
    end[last] = ~gap[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def run_hashes(letters: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of adjoining runs of bytes: the sum of a random value for each byte and its place (tabulation),
    mixed. Beyond the table, a place is mixed into the byte's value, so that no sum over places follows from another. An
    empty run's hash is 0."""
    first = np.cumsum(length) - length
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(first, length)
    value = _AT.ravel()[np.minimum(place, _PLACES) * 256 + letters]
    far = np.flatnonzero(place >= _PLACES)
    out = np.zeros(len(length), np.uint64)
    some = length > 0
    with np.errstate(over="ignore"):
        if len(far):
            value[far] = mix(value[far] + place[far].astype(np.uint64) * np.uint64(_BASE))
        if some.any():
            out[some] = np.add.reduceat(value, first[some])
        return mix(out + length.astype(np.uint64))


def word_hashes(raw: np.ndarray, at: np.ndarray, spans: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z lowered, and for each text the place of its first word (one more at the end)."""
    s, e = word_spans(raw, at) if spans is None else spans
    return run_hashes(_LOWER[raw[~_SPACE[raw]]], e - s), np.searchsorted(s, at)


def shingle_hashes(words: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text (a shorter text is one run), and the place of each text's first run."""
    count = np.diff(of)
    runs = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    place = np.zeros(len(of), np.int64)
    np.cumsum(runs, out=place[1:])
    total = int(place[-1])
    begin = np.repeat(of[:-1] - place[:-1], runs) + np.arange(total)
    length = np.repeat(np.minimum(count, k), runs)
    out = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            has = length > j
            w = words[np.minimum(begin + j, max(len(words) - 1, 0))] if len(words) else np.zeros(total, np.uint64)
            out = np.where(has, mix(out * np.uint64(_BASE) + w + np.uint64(j + 1)), out)
    return out, place


def pieces(texts: pa.Array, limit: int = 4_000_000):
    """Slices of a batch of at most so many bytes (one text at least), to bound memory: (first row, slice)."""
    size = np.diff(buffers(texts)[1]) if len(texts) else np.zeros(0)
    i = 0
    while i < len(texts):
        j, held = i + 1, size[i]
        while j < len(texts) and held + size[j] <= limit:
            held += size[j]
            j += 1
        yield i, texts.slice(i, j - i)
        i = j
