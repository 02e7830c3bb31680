"""Language-model scoring with a nested hierarchical Pitman-Yor model.

Tokens are words and one end a document; before a text are two ends. The two words before a token
are a context with a restaurant of the words that follow; its parent is the restaurant of the word
before, which all contexts that end in this word share; the parent of these is a word restaurant,
and its base is a spelling model: restaurants of letters, each context of up to 3 letters a
restaurant whose parent is the context without its first letter. Tables of a restaurant are
customers of its parent; discounts come from counts of counts. A Gibbs sweep takes out the
customers of each dish and seats them anew given all others (pitman_yor.reseat): word triples, then
pairs, then words in passes over the vocabulary table, then letters (at most 47**4 counts, whatever
the corpus) on the driver. Dishes are seated side by side: the other dishes of a restaurant stand
as the sweep before has left them, and in the word restaurant a dish's own tables count as one.
Probabilities are averaged over several seatings. A document's score is the sum of log10 of its
tokens' probabilities; perplexity is 10**(-score/tokens).

Plan: texts are read once, in blocks of bounded size that hold each distinct word once, in order of
the words' hashes (`codes` are places in that list). Blocks and parts of the hash range exchange
packed arrays, a row a block and part: the hashes of a block's distinct triples go to the parts and
the corpus's counts come back in the same order, and likewise for pairs and words with their
tables and customers. Of equal triples or pairs, one block owns it and hands its tables up; seating
draws by the hash, so all blocks that hold it, and tasks that run again, find the same tables. What
a block knows goes along as rows of the same tables. Every training document counts, and nothing
that grows with the corpus is broadcast or collected. Grams of equal 56-bit hashes count as one.

Defined results: a null or empty text is the end alone. A null doc_id is not held out. Repeated
rows are documents of their own. Other columns are not looked at. Without training documents N and
V are 0 and all words are spelled with even letters. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.llm import pitman_yor as py
from clausula.llm.shared import bucketed, delete, hand_back, id_text, scratch
from clausula.llm.texthash import _BASE, _LOWER, buffers, mix, pieces, run_hashes, word_hashes, word_spans

BLOCK_BYTES = 11_000_000
#: Sweeps of triples and pairs (the first has one table a gram), of words and of letters in each of them, and seatings that probabilities are averaged over.
SWEEPS, WORD_SWEEPS, LETTER_SWEEPS, DRAWS, GRAM_DRAWS = 2, 2, 4, 3, 2
END = b""
#: Hashes have 56 bits, at the top.
BITS = np.uint64(0xFFFFFFFFFFFFFF00)


def is_held_out(doc_id: int | None, modulus: int = 7, remainder: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


BLOCKS = "block long, doc_id array<long>, held_out array<boolean>, n array<int>, codes binary, words binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers (none below 0) in as few bytes as the largest needs; bytes of equal weight stand together, which packs small numbers best. First the widths."""
    out, widths = [], []
    for a in arrays:
        if a.dtype.kind != "f":
            top = int(a.max()) if len(a) else 0
            a = a.astype(next(k for k in ("u1", "u2", "u4", "u8") if top <= np.iinfo(k).max))
        widths.append(a.itemsize)
        a = np.ascontiguousarray(a).view(f"u{a.itemsize}")
        out += [(a >> (8 * i)).astype(np.uint8).tobytes() for i in range(a.itemsize)]
    return bytes(widths) + pa.compress(b"".join(out), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    widths = packed[: len(kinds)]
    raw = np.frombuffer(pa.decompress(memoryview(packed)[len(kinds) :], n * sum(widths), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for k, w in zip(kinds, widths):
        a = raw[at : at + n].astype(k if k[0] != "f" else f"u{w}")
        for i in range(1, w):
            a |= raw[at + i * n : at + (i + 1) * n].astype(a.dtype) << (8 * i)
        out.append(a.view(k))
        at += n * w
    return out


def _list(a: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)


def _blocks(batches):
    part, k, held_words, ids, held, n, codes, size = TaskContext.get().partitionId(), 0, [], [], [], [], [], 0

    def out():
        _, place, at = distinct(np.concatenate([np.zeros(1, np.uint64), *(x for x, _ in held_words)]))  # the end's hash is 0, so its code is 0
        at[0] = 0
        words = pa.concat_arrays([pa.array([""]), *(x for _, x in held_words)]).take(pa.array(at))
        ends = np.cumsum([1, *(len(x) for x, _ in held_words)])
        code = np.concatenate([np.r_[np.int32(0), place[ends[i] : ends[i + 1]]][c] for i, c in enumerate(codes)])
        return pa.RecordBatch.from_arrays([pa.array([(part << 24) + k]), _list(pa.array(ids, pa.int64())), _list(pa.array(held, pa.bool_())), _list(pa.array(n, pa.int32())), pa.array([_pack(code.astype("<u4"))], pa.binary()), pa.array([_packed_words(words)], pa.binary())], ["block", "doc_id", "held_out", "n", "codes", "words"])

    for b in batches:
        for first, texts in pieces(b["text"], BLOCK_BYTES // 6):
            raw, at = buffers(texts)
            s, e = word_spans(raw, at)
            h, of = word_hashes(raw, at, (s, e))
            key, place, one = distinct(h & BITS)
            s, length = s[one], (e - s)[one]
            offsets = np.r_[0, np.cumsum(length)]
            letters = _LOWER[raw[np.repeat(s - offsets[:-1], length) + np.arange(offsets[-1])]]
            held_words.append((key, pa.StringArray.from_buffers(len(key), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes()))))
            count = np.diff(of)
            code = np.zeros(len(h) + len(count), np.int32)
            inside = np.ones(len(code), bool)
            inside[np.cumsum(count + 1) - 1] = False
            code[inside] = place + 1
            codes.append(code)
            docs = b["doc_id"].slice(first, len(texts)).to_pylist()
            ids += docs
            held += [is_held_out(x) for x in docs]
            n += (count + 1).tolist()
            size += len(raw)
            if size >= BLOCK_BYTES:
                yield out()
                k, held_words, ids, held, n, codes, size = k + 1, [], [], [], [], [], 0
    if ids:
        yield out()


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at[1:] - at[0]


def _packed_words(words: pa.Array) -> bytes:
    """One value for a block's words, which Spark then does not take apart: their number, bytes of the lengths, bytes in all; lengths; letters."""
    raw, ends = _bytes_of(words)
    lengths = _pack(np.diff(ends, prepend=0))
    return np.array([len(ends), len(lengths), len(raw)], "<u8").tobytes() + lengths + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _unpacked_words(packed: bytes) -> pa.Array:
    n, size, letters = np.frombuffer(packed, "<u8", 3).tolist()
    ends = np.cumsum(_unpack(packed[24 : 24 + size], n, "i8")[0])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.r_[0, ends].astype(np.int64).tobytes()), pa.decompress(memoryview(packed)[24 + size :], letters, codec="zstd")).cast(pa.string())


def hashes(words: pa.Array) -> np.ndarray:
    """The hash of each word; that of the end is 0."""
    raw, ends = _bytes_of(words)
    return run_hashes(raw, np.diff(ends, prepend=0)) & BITS


# Spelling


@functools.lru_cache(2)
def _floats(packed: bytes) -> np.ndarray:
    return _unpack(packed, py.SYMBOLS ** (py.DEPTH + 1), "f4")[0]


class Spelling:
    """log of the probability of each gram, of a byte within its class, and the class of each byte."""

    def __init__(self, gram: np.ndarray, log_byte: np.ndarray, of: np.ndarray):
        self.packed, self.log_byte, self.of = _pack(np.log(gram).astype("<f4")), log_byte, of

    def log(self, words: pa.Array) -> np.ndarray:
        return self.log_of(*py.grams(*_bytes_of(words), self.of))

    def log_of(self, gram: np.ndarray, byte: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.add.reduceat(_floats(self.packed)[gram].astype(float) + self.log_byte[byte], place) if len(place) else np.zeros(0)


def _byte_counts(vocabulary: DataFrame) -> np.ndarray:
    def rows(batches):
        n = np.zeros(256, np.int64)
        for b in batches:
            n += np.bincount(_bytes_of(b["word"])[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(n)], ["byte", "n"])

    got = vocabulary.select("word").mapInArrow(rows, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).toArrow()  # 256 rows
    out = np.zeros(256, np.int64)
    out[got["byte"].to_numpy()] = got["n"].to_numpy()
    return out


def _sweep(vocabulary: DataFrame, sweep: int, spelling, d: float, tables: int, of: np.ndarray):
    """Seat the words' customers once; counts of grams and bytes over the tables' spellings, and the number of tables."""
    held = vocabulary.sparkSession.sparkContext.broadcast((spelling, d, tables, of))
    size = py.SYMBOLS ** (py.DEPTH + 1)

    def rows(batches):
        spell, disc, others, cls = held.value
        total, bytes_, made = np.zeros(size, np.int32), np.zeros(257, np.int64), 0
        for b in batches:
            if not b.num_rows:
                continue
            words, c = b["word"], b["c"].to_numpy()
            raw, ends = _bytes_of(words)
            gram, byte, place = py.grams(raw, ends, cls)
            t = np.ones(len(c), np.int64) if spell is None else word_tables(c, np.exp(spell.log_of(gram, byte, place)), disc, others, b["h"].to_numpy().view(np.uint64), sweep)
            each = np.repeat(t, np.diff(np.r_[place, len(gram)]))
            np.add.at(total, gram, each.astype(np.int32))
            bytes_ += np.bincount(byte, each, 257).astype(np.int64)
            made += int(t.sum())
        at, more = np.flatnonzero(total), np.flatnonzero(bytes_)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1 - more, -1000].astype(np.int32)), pa.array(np.r_[total[at].astype(np.int64), bytes_[more], made])], ["gram", "n"])

    got = vocabulary.mapInArrow(rows, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # SYMBOLS**4 + 258 rows at most
    held.destroy()
    gram, n = got["gram"].to_numpy(), got["n"].to_numpy()
    counts, bytes_ = np.zeros(size, np.int64), np.zeros(257)
    counts[gram[gram >= 0]] = n[gram >= 0]
    low = (gram < 0) & (gram > -1000)
    bytes_[-1 - gram[low]] = n[low]
    return counts, bytes_, int(n[gram == -1000].sum())


def _log_byte(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    of = np.r_[of, 0]
    total, members = np.bincount(of, n + 0.5, py.SYMBOLS), np.bincount(of, minlength=py.SYMBOLS)
    return np.log((n + 0.5) / np.where(members > 0, total, 1)[of])


def train(vocabulary: DataFrame, ones: int, twos: int):
    """(spelling, discount, tables) of a table of words (with hashes h) and their customers c."""
    d, of = py.discount(ones, twos), py.classes(_byte_counts(vocabulary))
    letters, spelling, tables = py.Letters(5), None, 0
    for sweep in range(WORD_SWEEPS):
        counts, bytes_, tables = _sweep(vocabulary, sweep, spelling, d, tables, of)
        kept = np.zeros(len(counts), np.float32)
        for k in range(2 * LETTER_SWEEPS):
            p = letters.sweep(counts)
            if k >= LETTER_SWEEPS:
                kept += p / LETTER_SWEEPS
        spelling = Spelling(kept, _log_byte(bytes_, of), of)
    return spelling, d, tables


def word_tables(c: np.ndarray, base: np.ndarray, d: float, tables: int, h: np.ndarray, draw: int) -> np.ndarray:
    return py.reseat(c, (py.STRENGTH + d * max(tables - 1, 0)) * base, d * base, d, py.uniform(h, draw))


def word_probability(c: np.ndarray, words: pa.Array, h: np.ndarray, spelling, d: float, tables: int, customers: int) -> np.ndarray:
    """Of the word restaurant, averaged over seatings."""
    base = np.exp(spelling.log(words))
    t = sum(word_tables(c, base, d, tables, h, 100 + k) for k in range(DRAWS)) / DRAWS
    return (np.maximum(c - d * t, 0) + (py.STRENGTH + d * tables) * base) / (py.STRENGTH + customers)


# Blocks and parts


def _packed_hashes(ascending: np.ndarray) -> bytes:
    """Ascending hashes as differences, of five bytes each where these are enough: all low four bytes, then the others."""
    d = np.diff(ascending >> np.uint64(8), prepend=np.uint64(0))
    first, d[:1] = d[:1].copy(), 0
    width = 5 if not len(d) or int(d.max()) < 1 << 40 else 7
    return b"".join([first.astype("<u8").tobytes(), d.astype("<u4").tobytes(), *((d >> np.uint64(8 * i)).astype(np.uint8).tobytes() for i in range(4, width))])


def _unpacked_hashes(packed: bytes, n: int) -> np.ndarray:
    width = (len(packed) - 8) // n
    d = np.frombuffer(packed, "<u4", n, 8).astype(np.uint64)
    for i in range(4, width):
        d |= np.frombuffer(packed, np.uint8, n, 8 + i * n).astype(np.uint64) << np.uint64(8 * i)
    d[0] = np.frombuffer(packed, "<u8", 1)[0]
    return np.cumsum(d, dtype=np.uint64) << np.uint64(8)


def _cuts(ascending: np.ndarray, bits: int):
    """(part, first, end) of each part of the hash range that has hashes."""
    if not len(ascending):
        return []
    part = (ascending >> np.uint64(64 - bits)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return list(zip(part[start].tolist(), start.tolist(), [*start[1:].tolist(), len(part)]))


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, the place of each key among them, and where each of them stands in `key` once. Sorts keys with their places in the low bits."""
    low = np.uint64(max(1, len(key)).bit_length())
    order = key >> low
    order <<= low
    order |= np.arange(len(key), dtype=np.uint64)
    order.sort()
    order &= (np.uint64(1) << low) - np.uint64(1)
    order = order.view(np.int64)
    k = key[order]
    for at in np.flatnonzero(k[1:] < k[:-1]):  # a few keys that are equal but for the low bits
        x, y = np.searchsorted(k >> low, [k[at] >> low, (k[at] >> low) + np.uint64(1)])
        order[x:y] = order[x:y][np.argsort(key[order[x:y]], kind="stable")]
        k[x:y] = key[order[x:y]]
    new = np.r_[True, k[1:] != k[:-1]][: len(k)]
    place = np.empty(len(key), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return k[new], place, order[new]


class Block:
    """A row of the table of blocks. Positions are tokens and, before each document, one end that is not scored."""

    def __init__(self, b, i: int = 0):
        self.number = b["block"][i].as_py()
        self.words, self.n = _unpacked_words(b["words"][i].as_py()), b["n"][i].values.to_numpy()
        held = b["held_out"][i].values.to_numpy(zero_copy_only=False)
        size = int(self.n.sum())
        first = np.r_[0, np.cumsum(self.n + 1)[:-1]].astype(np.int64)
        self.real = np.ones(size + len(self.n), bool)
        self.real[first] = False
        self.word = np.zeros(len(self.real), np.int32)
        self.word[self.real] = _unpack(b["codes"][i].as_py(), size, "u4")[0]
        self.train = np.repeat(~held, self.n + 1) & self.real

    @functools.cached_property
    def hash(self) -> np.ndarray:
        return hashes(self.words)

    @functools.cached_property
    def _pairs(self):
        """Distinct pairs, the pair at each position, each pair's word and the one before, hashes of pairs by position."""
        own = self.hash[self.word]
        with np.errstate(over="ignore"):
            pair = mix(np.r_[np.uint64(0), own[:-1]] * np.uint64(_BASE) + own) & BITS
        key, place, at = distinct(pair)
        return key, place, self.word[at], np.where(at > 0, self.word[at - 1], 0), pair

    @functools.cached_property
    def _triples(self):
        """Distinct triples, the triple of each token, each triple's last pair and its first."""
        with np.errstate(over="ignore"):
            triple = mix(np.r_[np.uint64(0), self._pairs[4][:-1]] * np.uint64(_BASE) + self.hash[self.word]) & BITS
        triple = triple[self.real]
        self.__dict__["_pairs"] = (*self._pairs[:4], None)  # nothing else needs the hashes by position
        key, place, at = distinct(triple)
        at = np.flatnonzero(self.real)[at]
        return key, place, self.pair[at], self.pair[at - 1]

    key2 = property(lambda self: self._pairs[0])
    pair = property(lambda self: self._pairs[1])
    word2 = property(lambda self: self._pairs[2])
    context2 = property(lambda self: self._pairs[3])
    key3 = property(lambda self: self._triples[0])
    triple = property(lambda self: self._triples[1])
    pair3 = property(lambda self: self._triples[2])
    context3 = property(lambda self: self._triples[3])

    def triple_counts(self) -> np.ndarray:
        return np.bincount(self.triple, self.train[self.real], len(self.key3)).astype(np.int64)

    def pair_contexts(self) -> np.ndarray:
        """Training tokens after each pair."""
        return np.bincount(self.pair[np.flatnonzero(self.train) - 1], minlength=len(self.key2)).astype(np.int64)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.word[self.train], minlength=len(self.words)).astype(np.int64)


#: Kinds of rows of what is known. From the parts: TRIPLE_COUNTS (twice the corpus's count and 1 if the block owns the triple), PAIR_COUNTS (tokens after it in the
#: corpus, and 1 if the block owns it and 2 more if no other block has it), PAIR_SUMS (tables as a context, customers), WORDS (tokens, customers and tables as a
#: context, probability), WORD_SUMS (a part's words). From a block itself: TRIPLE_TABLES, PAIR_TABLES, and SOLE_SUMS (as PAIR_SUMS, of pairs that no other block has).
TRIPLE_COUNTS, TRIPLE_TABLES, PAIR_COUNTS, PAIR_SUMS, SOLE_SUMS, PAIR_TABLES, WORDS, WORD_SUMS = range(1, 9)
ROWS = "kind int, block long, part int, n int, hashes binary, data binary, ones long, twos long"
TYPE = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("data", pa.binary()), ("ones", pa.int64()), ("twos", pa.int64())])


def _row(kind, block, part, n, data, hashes=None, ones=0, twos=0):
    return {"kind": kind, "block": block, "part": part, "n": n, "hashes": hashes, "data": data, "ones": ones, "twos": twos}


def _messages(kind: int, block: int, key: np.ndarray, bits: int, *arrays: np.ndarray) -> list[dict]:
    return [_row(kind, block, part, y - x, _pack(*(a[x:y] for a in arrays)), _packed_hashes(key[x:y])) for part, x, y in _cuts(key, bits)]


def _send_triples(batches, bits: int):
    for b in batches:
        for i in range(b.num_rows):
            block = Block(b, i)
            yield from pa.Table.from_pylist(_messages(TRIPLE_COUNTS, block.number, block.key3, bits, block.triple_counts()), TYPE).to_batches()


#: Arrays that a block sends of a gram.
SENT = {TRIPLE_COUNTS: 1, PAIR_COUNTS: 3, PAIR_SUMS: 2, WORD_SUMS: 3}


def _at_part(t: pa.Table) -> pa.Table:
    """Sums over the blocks of what they sent to a part: back to each block, but for words. Rows that a block keeps pass. ones, twos: grams of one and two customers."""
    kind = t["kind"][0].as_py()
    if kind not in SENT:
        return t.cast(TYPE)
    t = t.sort_by("block")
    n, part = t["n"].to_numpy(), t["part"][0].as_py()
    key = np.concatenate([_unpacked_hashes(k, m) for k, m in zip(t["hashes"].to_pylist(), n.tolist())])
    sent = [np.concatenate(x) for x in zip(*(_unpack(d, m, *["i8"] * SENT[kind]) for d, m in zip(t["data"].to_pylist(), n.tolist())))]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    start, group = np.flatnonzero(new), np.empty(len(key), np.int64)
    sums = [np.add.reduceat(x[order], start) for x in sent]
    if kind == WORD_SUMS:
        return pa.Table.from_pylist([_row(kind, part, part, len(start), _pack(*sums), _packed_hashes(key[start]))], TYPE)
    group[order] = np.cumsum(new) - 1
    own = np.zeros(len(key), np.int64)
    own[order[start]] = 1  # the first block that has the gram
    own[order[start[np.diff(np.r_[start, len(key)]) == 1]]] = 3
    back = [x[group] for x in sums]
    held = {TRIPLE_COUNTS: lambda: {TRIPLE_COUNTS: (2 * back[0] + (own & 1),)}, PAIR_COUNTS: lambda: {PAIR_COUNTS: (4 * back[0] + own,), PAIR_SUMS: back[1:]}, PAIR_SUMS: lambda: {PAIR_SUMS: back}}[kind]()
    ends, rows, few = np.cumsum(n), [], (int((sums[-1] == 1).sum()), int((sums[-1] == 2).sum()))
    for k, (block, m) in enumerate(zip(t["block"].to_pylist(), n.tolist())):
        for what, arrays in held.items():
            rows.append(_row(what, block, part, m, _pack(*(x[ends[k] - m : ends[k]] for x in arrays)), None, *((0, 0) if k or what == PAIR_COUNTS else few)))
    return pa.Table.from_pylist(rows, TYPE)


def _narrow(kind: str, width: int) -> str:
    """Whole numbers stored in at most two bytes are held in four, not eight: results do not depend on it, a block's memory does."""
    return "i4" if kind == "i8" and width <= 2 else kind


class Known:
    """What came to a block, in order of its hashes; None where it is not there yet."""

    def __init__(self, rows: pa.Table):
        got: dict[int, list] = {}
        for r in rows.select(["kind", "part", "n", "data"]).sort_by([("kind", "ascending"), ("part", "ascending")]).to_pylist():
            got.setdefault(r["kind"], []).append(r)

        def read(kind, *types):
            if kind not in got:
                return [None] * len(types)
            return [np.concatenate(x) for x in zip(*(_unpack(r["data"], r["n"], *map(_narrow, types, r["data"])) for r in got.pop(kind)))]

        (both,), (self.t3,), (self.t2,) = read(TRIPLE_COUNTS, "i8"), read(TRIPLE_TABLES, "i8"), read(PAIR_TABLES, "i8")
        if both is not None:
            self.c3, self.own3 = both >> 1, (both & 1).astype(bool)
            self.t3 = np.minimum(self.c3, 1) if self.t3 is None else self.t3
        (both,) = read(PAIR_COUNTS, "i8")
        self.own2 = self.sole2 = None
        if both is not None:
            self.n2, self.own2, self.sole2 = both >> 2, (both & 1).astype(bool), (both & 2).astype(bool)
            sums = read(PAIR_SUMS, "i8", "i8")
            if SOLE_SUMS in got:
                parted, sole = sums, read(SOLE_SUMS, "i8", "i8")
                sums = [np.empty(len(both), np.result_type(*(x for x in (a, b) if x is not None))) for a, b in zip(parted, sole)]
                for x, a, b in zip(sums, parted, sole):
                    x[self.sole2] = b
                    if a is not None:
                        x[~self.sole2] = a
            self.tables2, self.c2 = sums
            self.t2 = np.minimum(self.c2, 1) if self.t2 is None else np.clip(self.t2, np.minimum(self.c2, 1), self.c2)  # customers may have come and gone
        self.tokens, self.customers1, self.tables1, self.p1 = read(WORDS, "i8", "i8", "i8", "f4")


def _some(t: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    t = t.copy()
    t[at] = new
    return t


def pair_tables(block: Block, k: Known, d: float, draw: int) -> np.ndarray:
    """Pairs of one customer or none have as many tables; the others are seated anew."""
    at = np.flatnonzero(k.c2 > 1)
    p, others = k.p1[block.word2[at]].astype(float), k.tables1[block.context2[at]] - k.t2[at]
    return _some(k.t2, at, py.reseat(k.c2[at], (py.STRENGTH + d * others) * p, d * p, d, py.uniform(block.key2[at], draw)))


def pair_probability(block: Block, k: Known, t: np.ndarray, d: float) -> np.ndarray:
    up = (py.STRENGTH + d * k.tables1[block.context2]) * k.p1[block.word2].astype(float)
    return (np.maximum(k.c2 - d * t, 0) + up) / (py.STRENGTH + k.customers1[block.context2])


def triple_tables(block: Block, k: Known, p2: np.ndarray, d: float, draw: int) -> np.ndarray:
    at = np.flatnonzero(k.c3 > 1)
    p, others = p2[block.pair3[at]], k.tables2[block.context3[at]] - k.t3[at]
    return _some(k.t3, at, py.reseat(k.c3[at], (py.STRENGTH + d * others) * p, d * p, d, py.uniform(block.key3[at], draw)))


def _kept(block: int, kind: int, arrays: list[np.ndarray], ones: int = 0, twos: int = 0) -> dict:
    """A row that a block keeps; its part is a number of its own."""
    return _row(kind, block, -1 - block % (1 << 31), len(arrays[0]), _pack(*arrays), None, ones, twos)


def _with_triples(row: pa.Table) -> Block:
    """The block with its triples found, which needs room of its own, before what is known of it is read."""
    block = Block(row)
    _ = block.key3
    return block


def _seat_triples(left: pa.Table, right: pa.Table, d3: float, d2: float, sweep: int, bits: int) -> pa.Table:
    """Seat a block's triples; what they say of pairs goes to the parts, but for pairs that no other block has."""
    block, k = _with_triples(left), Known(right)
    t = k.t3 if not sweep else triple_tables(block, k, pair_probability(block, k, k.t2, d2), d3, sweep)
    own, size = k.own3, len(block.key2)
    sums = [np.bincount(x[own], t[own], size).astype(np.int64) for x in (block.context3, block.pair3)]
    if not sweep:
        return pa.Table.from_pylist(_messages(PAIR_COUNTS, block.number, block.key2, bits, block.pair_contexts(), *sums), TYPE)
    sole = [x[k.sole2] for x in sums]
    rows = [_kept(block.number, TRIPLE_TABLES, [t]), _kept(block.number, SOLE_SUMS, sole, int((sole[1] == 1).sum()), int((sole[1] == 2).sum()))]
    return pa.Table.from_pylist(rows + _messages(PAIR_SUMS, block.number, block.key2[~k.sole2], bits, *(x[~k.sole2] for x in sums)), TYPE)


def _seat_pairs(left: pa.Table, right: pa.Table, d2: float, sweep: int, bits: int) -> pa.Table:
    """Seat a block's pairs; what they say of words goes to the parts."""
    block, k = Block(left), Known(right)
    t = pair_tables(block, k, d2, sweep) if sweep else k.t2
    own, size = k.own2, len(block.words)
    sums = [np.bincount(at[own], x[own], size).astype(np.int64) for at, x in ((block.context2, k.c2), (block.context2, t), (block.word2, t))]
    rows = [_kept(block.number, PAIR_TABLES, [t])] if sweep else []
    return pa.Table.from_pylist(rows + _messages(WORD_SUMS, block.number, block.hash, bits, *sums), TYPE)


WORD_LISTS = "part int, hashes binary, size int, n binary, words binary"
TRAINING = "part int, h long, word string, n long"
VOCABULARY = TRAINING + ", customers long, tables long, c long"


def _send_training_words(batches, bits: int):
    for b in batches:
        for i in range(b.num_rows):
            block = Block(b, i)
            n = block.word_counts()
            some = np.flatnonzero(n > 0)
            h, n, words = block.hash[some], n[some], block.words.take(pa.array(some))
            for part, x, y in _cuts(h, bits):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed_hashes(h[x:y])], pa.binary()), pa.array([y - x], pa.int32()), pa.array([_pack(n[x:y])], pa.binary()), pa.array([_packed_words(words.slice(x, y - x))], pa.binary())], ["part", "hashes", "size", "n", "words"])


def _training_words(t: pa.Table) -> pa.Table:
    """A part's words of the training texts, in order of their hashes, and how often they occur."""
    size = t["size"].to_pylist()
    h = np.concatenate([_unpacked_hashes(x, m) for x, m in zip(t["hashes"].to_pylist(), size)])
    n = np.concatenate([_unpack(x, m, "i8")[0] for x, m in zip(t["n"].to_pylist(), size)])
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(h[order]) > 0])
    words = pa.concat_arrays([_unpacked_words(x) for x in t["words"].to_pylist()]).take(pa.array(order[start]))
    return pa.table({"part": pa.array([t["part"][0].as_py()] * len(words), pa.int32()), "h": pa.array(h[order][start].view(np.int64)), "word": words, "n": pa.array(np.add.reduceat(n[order], start))})


def _with_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """A part's training words with their customers and tables as a context, and their customers in the word restaurant."""
    if not left.num_rows:
        return pa.table({x: [] for x in ("part", "h", "word", "n", "customers", "tables", "c")}, pa.schema([("part", pa.int32()), ("h", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("customers", pa.int64()), ("tables", pa.int64()), ("c", pa.int64())]))
    r = right.to_pylist()[0]
    h, sums = _unpacked_hashes(r["hashes"], r["n"]), _unpack(r["data"], r["n"], "i8", "i8", "i8")
    at = np.searchsorted(h, left["h"].to_numpy().view(np.uint64))
    for name, x in zip(("customers", "tables", "c"), sums):
        left = left.append_column(name, pa.array(x[at]))
    return left


def _send_words(batches, bits: int):
    for b in batches:
        for i in range(b.num_rows):
            yield from pa.Table.from_pylist(_messages(WORDS, b["block"][i].as_py(), hashes(_unpacked_words(b["words"][i].as_py())), bits), TYPE).to_batches()


def _words_of(held):
    """Answers of a part to the blocks: tokens, customers and tables as a context and probability of each of their words; 0 where it is not in the training texts."""

    def words_of(left: pa.Table, right: pa.Table) -> pa.Table:
        spelling, d, tables, customers = held.value
        h = right["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, known = h[order], [right[x].to_numpy()[order] for x in ("n", "customers", "tables")]
        known.append((word_probability(right["c"].to_numpy()[order], right["word"].combine_chunks().take(pa.array(order)), h, spelling, d, tables, customers) if len(h) else np.zeros(0)).astype("<f4"))
        rows = []
        for r in left.to_pylist():
            own = _unpacked_hashes(r["hashes"], r["n"])
            at = np.minimum(np.searchsorted(h, own), max(len(h) - 1, 0))
            there = h[at] == own if len(h) else np.zeros(len(own), bool)
            rows.append(_row(WORDS, r["block"], r["part"], r["n"], _pack(*(np.where(there, x[at], 0).astype(x.dtype) if len(h) else np.zeros(len(own), x.dtype) for x in known))))
        return pa.Table.from_pylist(rows, TYPE)

    return words_of


def _scored(left: pa.Table, right: pa.Table, held, d3: float, d2: float, total: int, words: int) -> pa.Table:
    spelling, d, tables, customers = held.value
    block, k = _with_triples(left), Known(right)
    lost = np.flatnonzero(k.tokens == 0)
    if len(lost):
        k.p1 = k.p1.astype(float)
        k.p1[lost] = (py.STRENGTH + d * tables) * np.exp(spelling.log(block.words.take(pa.array(lost)))) / (py.STRENGTH + customers)
    # Probabilities are linear in the numbers of tables, so these are averaged: the last sweep's, and those of more seatings.
    t3, p2 = k.t3, pair_probability(block, k, k.t2, d2)
    for draw in range(1, GRAM_DRAWS):
        t3 = t3 + triple_tables(block, k, p2, d3, 100 + draw)
    t2 = k.t2
    for draw in range(1, GRAM_DRAWS):
        t2 = t2 + pair_tables(block, k, d2, 100 + draw)
    p2 = pair_probability(block, k, t2 / GRAM_DRAWS, d2)
    after = np.maximum(k.c3 - d3 * (t3 / GRAM_DRAWS), 0)
    del t2, t3, k.c3, k.t3, k.own3
    strength = py.STRENGTH + k.n2
    after /= strength[block.context3]
    after += ((py.STRENGTH + d3 * k.tables2) / strength)[block.context3] * p2[block.pair3]
    after = np.log10(np.maximum(after, 1e-300))
    at = np.r_[0, np.cumsum(block.n)[:-1]]
    add = lambda x: np.add.reduceat(x, at)
    whole = add(after[block.triple])
    base, code, n = np.log10((k.tokens + 1) / (total + words + 1)), block.word[block.real], block.n
    return pa.table({"doc_id": left["doc_id"].combine_chunks().flatten(), "held_out": left["held_out"].combine_chunks().flatten(), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(add((k.tokens > 0).astype(np.int64)[code])), "train_tokens": pa.array(np.full(len(n), total, np.int64)), "base_score": pa.array(add(base[code])), "score": pa.array(whole), "perplexity": pa.array(10 ** np.minimum(-whole / n, 300))})


def _given_back(fn, *tables: pa.Table) -> pa.Table:
    """fn of the tables; what it took besides its result goes back to the system, as both workers of an executor and its JVM share the memory."""
    try:
        return fn(*tables)
    finally:
        hand_back()


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark, paths = docs.sparkSession, {}

    def put(df: DataFrame, *gone: DataFrame | None, compression: str = "none", dealt: bool = False) -> DataFrame:
        """df in the shared folder, dealt by block as the blocks are or as it is. The tables `gone` and shuffle files of plans that have ended go."""
        path = scratch(spark, "lm")
        if dealt:
            got = bucketed(df.repartition(tasks, "block"), "block", tasks, path, compression)
        else:
            df.write.option("compression", compression).parquet(path)
            got = spark.read.schema(df.schema).parquet(path)
        drop(*gone)
        paths[id(got)] = path, got
        return got

    def drop(*gone: DataFrame) -> None:
        for df in gone:
            if df is not None:
                delete(spark, paths.pop(id(df))[0])
        gc.collect()
        spark.sparkContext._jvm.System.gc()

    def first(df: DataFrame, *sums: str):
        return df.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in sums], F.count("*").alias("rows")).first()

    def discount_of(rows: DataFrame) -> float:
        got = first(rows, "ones", "twos")
        return py.discount(got.ones, got.twos)

    read = put(id_text(docs).mapInArrow(_blocks, BLOCKS))
    count = read.select("block").count()
    bits = int(np.clip(np.ceil(np.log2(max(1, count))), 3, 16))
    tasks = max(8, -(-count // 4))
    blocks = bucketed(read, "block", tasks, scratch(spark, "lm"), "none")
    drop(read)
    left = blocks.select("block", "held_out", "n", "codes", "words")

    def with_known(known: list[DataFrame], fn, schema: str = ROWS, own: DataFrame = left) -> DataFrame:
        known = functools.reduce(DataFrame.unionAll, known)  # all dealt by block, so that none of their rows moves
        return own.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda a, b: _given_back(fn, a, b), schema)

    def at_parts(sent: DataFrame) -> DataFrame:
        return sent.groupBy("part").applyInArrow(lambda t: _given_back(_at_part, t), ROWS)

    def of(df: DataFrame | None, *kinds: int) -> list[DataFrame]:
        return [] if df is None else [df.where(F.col("kind").isin(*kinds))]

    training = put(left.mapInArrow(lambda it: _send_training_words(it, bits), WORD_LISTS).groupBy("part").applyInArrow(_training_words, TRAINING), compression="zstd")
    triples = put(at_parts(left.mapInArrow(lambda it: _send_triples(it, bits), ROWS)), dealt=True)
    d3, d2 = discount_of(triples), 0.5
    asked = blocks.select("block", "words").mapInArrow(lambda it: _send_words(it, bits), ROWS)
    counted = pairs = words = answers = None
    for sweep in range(SWEEPS):
        known = [triples, *of(counted, PAIR_COUNTS), *(of(pairs, PAIR_SUMS, SOLE_SUMS, TRIPLE_TABLES)), *of(words, PAIR_TABLES), *of(answers, WORDS)]
        pairs = put(at_parts(with_known(known, lambda a, b: _seat_triples(a, b, d3, d2, sweep, bits))), pairs if sweep > 1 else None, dealt=True)  # noqa: B023
        counted = counted or pairs
        d2 = discount_of(pairs)
        known = [*of(counted, PAIR_COUNTS), *of(pairs, PAIR_SUMS, SOLE_SUMS), *of(words, PAIR_TABLES), *of(answers, WORDS)]
        words = put(at_parts(with_known(known, lambda a, b: _seat_pairs(a, b, d2, sweep, bits))), words, dealt=True)  # noqa: B023
        vocabulary = put(training.groupBy("part").cogroup(words.where(F.col("kind") == WORD_SUMS).groupBy("part")).applyInArrow(_with_sums, VOCABULARY), answers, compression="zstd")
        total = first(vocabulary.withColumns({"ones": (F.col("c") == 1).cast("long"), "twos": (F.col("c") == 2).cast("long")}), "n", "c", "ones", "twos")
        held = spark.sparkContext.broadcast((*train(vocabulary.select("h", "word", "c"), total.ones, total.twos), total.c))
        answers = put(asked.groupBy("part").cogroup(vocabulary.groupBy("part")).applyInArrow(_words_of(held), ROWS), vocabulary, dealt=True)
        if sweep < SWEEPS - 1:
            held.destroy()
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    known = [triples, *of(counted, PAIR_COUNTS), *of(pairs, PAIR_SUMS, SOLE_SUMS, TRIPLE_TABLES), *of(words, PAIR_TABLES), answers]
    n, v = total.n, total.rows
    return with_known(known, lambda a, b: _scored(a, b, held, d3, d2, n, v), schema, blocks)
