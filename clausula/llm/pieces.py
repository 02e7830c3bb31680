"""Encoding with unigram pieces: the best segmentation by Viterbi, over a double-array trie.

Reads a SentencePiece model file. Scores are the file's where its kind is unigram; a file of merge
ranks has no probabilities, and rank r scores log(1 / (r + 10)), as word frequencies fall (Zipf).
A space is written as the marker U+2581, one stands before the text if the file says so. A
character that no piece of its own covers scores 10 below the least score and is given as its UTF-8
bytes. Of segmentations that score alike, the one whose last piece starts first is taken.

Where no piece has a marker after another character, a text may be cut before each marker that
follows another character, and around each line feed if no piece has one: pieces never cross there.
Each distinct part is segmented once a process. All parts of a batch are walked through the trie
together, a byte at a time for every start, then segmented together, a start position at a time.

Defined results: a null text is empty and has no pieces. Undecodable bytes become U+FFFD. A null
doc_id and repeated rows are rows of their own. Other columns are not looked at. An empty table
gives an empty table.
"""

from __future__ import annotations

import dataclasses
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.llm.shared import id_text

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_BYTES = 120_000_000
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(raw: bytes):
    """(number, value) of a protobuf message; length-delimited values are bytes."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, raw[at : at + n]
            at += n


@dataclasses.dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    prefix: bool  # a space is put before the text


def read_vocabulary(raw: bytes) -> Vocabulary:
    pieces, scores, kinds, unigram, prefix = [], [], [], True, True
    for field, value in _fields(raw):
        if field == 1:
            p = dict(_fields(value))
            pieces.append(p.get(1, b"").decode())
            scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
            kinds.append(p.get(3, NORMAL))
        elif field == 2:
            unigram = dict(_fields(value)).get(3, 1) == 1
        elif field == 3:
            spec = dict(_fields(value))
            if spec.get(2):
                raise ValueError("files with a table of character changes are not read")
            prefix = bool(spec.get(3, 1))
    kinds = np.array(kinds)
    scores = np.array(scores, np.float32)
    if not unigram:
        rank = np.cumsum(kinds == NORMAL) - 1
        scores = np.where(kinds == NORMAL, -np.log(rank + 10.0), 0).astype(np.float32)
    return Vocabulary(pieces, scores, kinds, prefix)


class Trie:
    """A double array over bytes: the child of s by byte c is base[s] + c, if check of it is s. value: the piece that ends there, or -1."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for w, piece in sorted(words.items()):
            node = 0
            for c in w:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                node = nxt
            ends[node] = piece
        size = 4 * len(children) + 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        place, least = {0: 0}, 1
        for node, kids in sorted(((n, k) for n, k in enumerate(children) if len(k) > 1), key=lambda x: -len(x[1])):  # most children first, while there is room
            labels = np.array(sorted(kids))
            b = max(1, least - int(labels[0]))
            while True:
                window = np.arange(b, min(b + 4096, size - 256))
                ok = free[window[:, None] + labels[None, :]].all(1)
                if ok.any():
                    b = int(window[ok.argmax()])
                    break
                b += len(window)
            free[b + labels] = False
            for c in labels.tolist():
                place[kids[c]] = b + c
            place[~node] = b
            while not free[least]:
                least += 1
        open_ = iter(np.flatnonzero(free[257:]) + 257)
        for node, kids in enumerate(children):
            if len(kids) == 1:
                (c, kid), at = next(iter(kids.items())), int(next(open_))
                place[kid], place[~node] = at, at - c
        for node, kids in enumerate(children):
            here = place[node]
            if kids:
                self.base[here] = place[~node]
                for k in kids.values():
                    self.check[place[k]] = here
            if node in ends:
                self.value[here] = ends[node]

    def matches(self, text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces in the bytes; a piece that starts at i ends at stop[i] at most."""
        start, state, out = np.arange(len(text)), np.zeros(len(text), np.int64), []
        depth = 0
        while len(start):
            ok = start + depth < stop[start]
            start, state = start[ok], state[ok]
            to = self.base[state] + text[start + depth].astype(np.int64)
            ok = self.check[to] == state
            start, state = start[ok], to[ok]
            depth += 1
            hit = self.value[state] >= 0
            out.append((start[hit], start[hit] + depth, self.value[state[hit]]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


class Pieces:
    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        usable = (v.kinds == NORMAL) | (v.kinds == USER)
        self.trie = Trie({p.encode(): i for i, p in enumerate(v.pieces) if usable[i] and p})
        self.unknown = np.float32(min(v.scores[usable].tolist(), default=0.0) - UNKNOWN_PENALTY)
        self.bytes = np.array([next((i for i in np.flatnonzero(v.kinds == BYTE) if v.pieces[i] == f"<0x{b:02X}>"), -1) for b in range(256)])
        self.unk_id = next(iter(np.flatnonzero(v.kinds == UNKNOWN)), 0)
        text = [p for i, p in enumerate(v.pieces) if usable[i]]
        self.cut_marks = not any(MARK in p.lstrip(MARK) for p in text)
        self.cut_lines = not any("\n" in p for p in text)
        self.spelled = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.encode() for p, k in zip(v.pieces, v.kinds)]
        self.held: dict[str, bytes] = {}
        self.size = 0

    def segment(self, parts: list[str]) -> list[bytes]:
        """Ids (unsigned 32-bit) of each part, each segmented as a whole."""
        raws = [p.encode() for p in parts]
        length = np.array([len(r) for r in raws])
        ends = np.cumsum(length)
        text = np.frombuffer(b"".join(raws), np.uint8)
        n = len(text)
        if not n:
            return [b""] * len(parts)
        begin = np.repeat(ends - length, length)
        stop = np.repeat(ends, length)
        lead = (text & 0xC0) != 0x80
        start, end, piece = self.trie.matches(text, stop)
        width = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        own = np.zeros(n, bool)
        own[start[end - start == width[start]]] = True
        lone = np.flatnonzero(lead & ~own)
        start, end = np.r_[start, lone], np.r_[end, lone + width[lone]]
        score = np.r_[self.v.scores[piece], np.full(len(lone), self.unknown, np.float32)]
        piece = np.r_[piece, np.full(len(lone), -1)]
        # Positions of a part have a place each, and one for its end.
        part = np.repeat(np.arange(len(parts)), length)
        s, e = start + part[start], end + part[start]
        order = np.lexsort((end, start - begin[start]))
        s, e, score, piece, at = s[order], e[order], score[order], piece[order], (start - begin[start])[order]
        best = np.full(n + len(parts), -np.inf, np.float32)
        first = ends - length + np.arange(len(parts))
        best[first] = 0
        back = np.full(n + len(parts), -1)
        bounds = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
        for i, j in zip(bounds[:-1], bounds[1:]):
            to, gain = e[i:j], best[s[i:j]] + score[i:j]
            better = gain > best[to]
            best[to[better]] = gain[better]
            back[to[better]] = np.arange(i, j)[better]
        # Walk back from all ends at once.
        now, whose, found = first + length, np.arange(len(parts)), []
        while True:
            live = now > first[whose]
            now, whose = now[live], whose[live]
            if not len(now):
                break
            m = back[now]
            found.append((whose, m))
            now = s[m]
        who = np.concatenate([w for w, _ in found]) if found else np.zeros(0, np.int64)
        m = np.concatenate([x for _, x in found]) if found else who
        order = np.lexsort((s[m], who))
        who, m = who[order], m[order]
        ids = piece[m]
        if (ids < 0).any():
            many = np.where(ids < 0, (e - s)[m], 1) if self.bytes.min() >= 0 else np.ones(len(ids), np.int64)
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            spelled = self.bytes[text[np.minimum(np.repeat((s - 0)[m] - who, many) + within, n - 1)]] if self.bytes.min() >= 0 else np.full(many.sum(), self.unk_id)
            ids, who = np.where(np.repeat(ids < 0, many), spelled, np.repeat(ids, many)), np.repeat(who, many)
        raw = ids.astype("<u4").tobytes()
        cut = np.searchsorted(who, np.arange(len(parts) + 1))
        return [raw[4 * a : 4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def parts(self, text: str) -> list[str]:
        text = (MARK if self.v.prefix and text else "") + text.replace(" ", MARK)
        if self.cut_lines:
            text = text.replace("\n", "\0\n\0") if "\0" not in text else text
        if self.cut_marks and "\0" not in text.replace("\0\n\0", "") and MARK * 2 not in text:
            text = text.replace(MARK, "\0" + MARK)
        elif "\0" in text.replace("\0\n\0", ""):
            return [text.replace("\0\n\0", "\n")]
        return [p for p in text.split("\0") if p]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.parts(t) for t in texts]
        if self.size > CACHE_BYTES:
            self.held.clear()
            self.size = 0
        new = list({p for parts in cut for p in parts}.difference(self.held))
        new.sort(key=len)  # parts of like length are walked together
        at = 0
        while at < len(new):
            to, size = at, 0
            while to < len(new) and (to == at or size + len(new[to]) < 200_000):
                size += len(new[to])
                to += 1
            self.held.update(zip(new[at:to], self.segment(new[at:to])))
            at = to
        self.size += sum(len(p) + 150 for p in new)
        return [b"".join(map(self.held.__getitem__, parts)) for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.v.prefix and text[:1] == " " else text


_HELD: dict[int, Pieces] = {}


def pieces_of(raw: bytes) -> Pieces:
    """This process's encoder for a model file's bytes."""
    key = zlib.crc32(raw)
    if key not in _HELD:
        _HELD[key] = Pieces(read_vocabulary(raw))
    return _HELD[key]


def shared_pieces(key: int, sent: Pieces) -> Pieces:
    """This process's copy of an encoder that was sent to it; what it has segmented stays for later tasks."""
    return _HELD.setdefault(key, sent)


def encoded(docs: DataFrame, model: str, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, n_bytes (pieces of byte fallback), ids_crc32, round_trip (decoding gives the text); and ids and decoded."""
    raw = Path(model).read_bytes()
    key, held = zlib.crc32(raw), docs.sparkSession.sparkContext.broadcast(Pieces(read_vocabulary(raw)))

    def rows(batches):
        p = shared_pieces(key, held.value)
        lone = np.zeros(len(p.v.pieces), bool)
        lone[p.bytes[p.bytes >= 0]] = True
        for b in batches:
            for i in range(0, b.num_rows, 256):
                texts = [t or "" for t in b["text"].slice(i, 256).to_pylist()]
                raws = p.encode(texts)
                ids = [np.frombuffer(r, "<u4") for r in raws]
                back = [p.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(i, 256), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(lone[x].sum()) for x in ids], pa.int64()), pa.array(list(map(zlib.crc32, raws)), pa.int64()), pa.array([t == u for t, u in zip(texts, back)]), pa.array(raws if with_text else [None] * len(raws), pa.binary()), pa.array(back if with_text else [None] * len(raws), pa.string())],
                    ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip", "ids", "decoded"])

    out = id_text(docs).mapInArrow(rows, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean, ids binary, decoded string")
    return out if with_text else out.drop("ids", "decoded")
