"""Simple-8b word-aligned coding of id arrays.

A 64-bit word holds a selector in its top 4 bits and, below, as many ids as fit at one width:

    selector   0    1    2   3   4   5   6   7   8   9  10  11  12  13  14      15
    ids      240  120   60  30  20  15  12  10   8   7   6   5   4   3   2       1
    bits       0    0    1   2   3   4   5   6   7   8  10  12  15  20  30  escape

Selectors 0 and 1 are runs of zeros. Selector 15 is an escape for an id of more than 30 bits: its
payload is a place in a list of 64-bit values at the block's end. A last word may be filled up with
zeros; the block's header has the number of ids. Every WORDS words the header notes how many ids
came before, so a part of a block can be decoded alone. Decoding works on all words of a selector
at once.

Block: magic `S8B1`, ids (u64), words (u32), escapes (u32), notes (u32); notes (u64 each); words
(u64 each); escapes (u64 each). Little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

# Ids and bits of the selectors 0 to 14.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
ESCAPE = 15
WORDS = 1024
_HEAD = struct.Struct("<4sQIII")


def encode(values: np.ndarray) -> bytes:
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    chosen = np.full(n, ESCAPE, np.int64)
    bits = np.zeros(n + 240, np.uint8)  # past the end are zeros, which may fill up a last word
    bits[:n] = np.where(v >> np.uint64(30) != 0, 31, np.frexp(v.astype(float))[1])
    most, have = bits[:n].copy(), 1  # the most bits of the next `have` ids of each place
    for selector in range(14, -1, -1):
        count = int(COUNTS[selector])
        for k in range(have, count):
            np.maximum(most, bits[k : k + n], out=most)
        have = count
        fits = most <= BITS[selector]
        if selector < 2:  # runs of zeros are whole
            fits[max(0, n - count + 1) :] = False
        if not fits.any():
            break
        chosen[fits] = selector
    step, at, i = COUNTS[chosen].tolist(), [], 0
    while i < n:
        at.append(i)
        i += step[i]
    start = np.array(at, np.int64)
    used = chosen[start] if n else chosen
    words = used.astype(np.uint64) << np.uint64(60)
    padded = np.r_[v, np.zeros(240, np.uint64)]
    for s in np.unique(used):
        w = np.flatnonzero(used == s)
        if s in (0, 1):
            continue
        if s == ESCAPE:
            words[w] |= np.arange(len(w), dtype=np.uint64)
            continue
        for k in range(COUNTS[s]):
            words[w] |= padded[start[w] + k] << np.uint64(k * BITS[s])
    escapes = v[start[used == ESCAPE]] if n else v
    notes = start[::WORDS].astype("<u8")
    return _HEAD.pack(b"S8B1", n, len(words), len(escapes), len(notes)) + notes.tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def _unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    used = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[used]
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    start = ends - count
    for s in np.unique(used):
        w = np.flatnonzero(used == s)
        if s in (0, 1):
            continue
        if s == ESCAPE:
            out[start[w]] = escapes[(words[w] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        low = np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]):
            out[start[w] + k] = (words[w] >> np.uint64(k * BITS[s])) & low
    return out[:n]


def _parts(block: bytes):
    magic, n, words, escapes, notes = _HEAD.unpack_from(block)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b block")
    at = _HEAD.size
    return (n, np.frombuffer(block, "<u8", notes, at), np.frombuffer(block, "<u8", words, at + 8 * notes), np.frombuffer(block, "<u8", escapes, at + 8 * (notes + words)))


def decode(block: bytes) -> np.ndarray:
    n, _, words, escapes = _parts(block)
    return _unpack(words, escapes, n)


def decode_range(block: bytes, start: int, stop: int) -> np.ndarray:
    """Ids start to stop, reading only the words between two notes."""
    n, notes, words, escapes = _parts(block)
    start, stop = max(0, min(start, n)), max(0, min(stop, n))
    if start >= stop:
        return np.zeros(0, np.uint64)
    first = int(np.searchsorted(notes, start, side="right")) - 1
    last = int(np.searchsorted(notes, stop, side="left"))
    base = int(notes[first])
    part = words[first * WORDS : last * WORDS]
    return _unpack(part, escapes, min(n, base + int(COUNTS[(part >> np.uint64(60)).astype(np.int64)].sum())) - base)[start - base : stop - base]
