"""Kernels: coding, trees, restaurants, tries, search."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausula.llm import boost, hamming_search, pieces, pitman_yor, queries, simple8b
from clausula.llm.tokens import encoder


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**17), st.integers(0, 2**64 - 1)), max_size=600))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    block = simple8b.encode(v)
    assert (simple8b.decode(block) == v).all()
    a, b = len(v) // 3, len(v) - len(v) // 4
    assert (simple8b.decode_range(block, a, b) == v[a:b]).all()


def test_simple8b_parts_and_zeros():
    v = np.r_[np.zeros(5000), np.arange(20000) % 49000, [2**63]].astype(np.uint64)
    block = simple8b.encode(v)
    for a, b in ((0, 1), (4990, 5010), (20000, 25001), (25000, 25001), (7, 7)):
        assert (simple8b.decode_range(block, a, b) == v[a:b]).all()
    assert len(simple8b.encode(np.zeros(2400, np.uint64))) < 150
    with pytest.raises(ValueError):
        simple8b.decode(b"x" * 40)


def test_encoder_gives_the_library_ids():
    odd = ["", " ", "\n", "a  b", " a b", "a b ", "it's\tyou'll <|endoftext|> x", "a <b> c<|startoftext|>d", "é é x", "İstanbul ΣΑΣ", "a\n\nb", "a\x1cb c", "don't don 't 's", "a b c", "x\x85y z", "日本語 テキスト\nおわり"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = encoder(queries.tokenizer_file(name))
        for t in odd:
            assert np.frombuffer(e.encode(t), "<u4").tolist() == e.plain.encode(t, add_special_tokens=False).ids, (name, t)


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0) | (x[:, 2] > 1.5)).astype(float)
    trees = boost.fit(x[:3000], y[:3000])
    assert ((trees.raw(x[3000:]) > 0) == y[3000:]).mean() > 0.97
    knots = boost.isotonic(trees.raw(x[3000:]), y[3000:])
    p = boost.calibrated(np.linspace(-9, 9, 50), knots)
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1


def test_seating_counts_and_probabilities():
    rng = np.random.default_rng(1)
    c = np.array([0, 1, 2, 50, 1000, 100000])
    t = np.mean([pitman_yor.reseat(c, np.full(6, 3.0), np.zeros(6), 0.5, rng.random(6)) for _ in range(300)], 0)
    assert t[0] == 0 and t[1] == 1 and (np.diff(t) > 0).all() and (t <= c).all()
    letters = pitman_yor.Letters(0)
    counts = np.zeros(pitman_yor.SYMBOLS**4, np.int64)
    counts[rng.integers(0, len(counts), 5000)] = rng.integers(1, 40, 5000)
    for _ in range(3):
        p = letters.sweep(counts)
    assert np.allclose(p.reshape(-1, pitman_yor.SYMBOLS).sum(1), 1)


def test_search_against_all_codes():
    rng = np.random.default_rng(2)
    codes = np.unique(np.r_[rng.integers(0, 1 << 63, 3000, dtype=np.uint64), rng.integers(0, 1 << 12, 300, dtype=np.uint64)])
    index, sizes = hamming_search.Index(codes), rng.integers(1, 4, len(codes))
    for q in np.r_[codes[:20], rng.integers(0, 1 << 12, 20, dtype=np.uint64)]:
        d = np.bitwise_count(codes ^ q).astype(int)
        at, got = index.search(q, sizes, 11)
        order = np.argsort(d, kind="stable")
        enough = d[order][np.searchsorted(np.cumsum(sizes[order]), 11)]
        assert set(at.tolist()) == set(np.flatnonzero(d <= enough).tolist()) and (d[at] == got).all()


def test_search_of_equal_null_and_odd_vectors(spark):
    rows = [(i, [1.0] * 64) for i in range(30)] + [(40, [-1.0] * 64), (41, None), (None, [1.0]), (42, [None, float("nan")] + [1.0] * 62), (43, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hamming_search.top_k(df, queries.F.col("id") % 20 == 0, 3).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    assert by == {0: [(1, 0), (2, 0), (3, 0)], 20: [(0, 0), (1, 0), (2, 0)], 40: [(43, 0), (42, 62), (0, 64)]}  # neither a null nor NaN is positive
    assert hamming_search.top_k(df.limit(0), queries.F.col("id") % 20 == 0).count() == 0


def _varint(n):
    out = b""
    while True:
        b, n = n & 127, n >> 7
        out += bytes([b | 128] if n else [b])
        if not n:
            return out


def _field(n, b):
    return _varint(n << 3 | 2) + _varint(len(b)) + b


def as_unigram(raw, scores):
    """The file as one of unigram kind with these scores, for the library."""
    out, i = b"", 0
    for f, v in pieces._fields(raw):
        if f == 1:
            d = dict(pieces._fields(v))
            out += _field(1, _field(1, d.get(1, b"")) + _varint(2 << 3 | 5) + struct.pack("<f", float(scores[i])) + (_varint(3 << 3) + _varint(d[3]) if 3 in d else b""))
            i += 1
        elif f == 2:
            out += _field(2, b"".join(_varint(g << 3) + _varint(1 if g == 3 else w) for g, w in pieces._fields(v) if isinstance(w, int)))
        elif f == 3:
            out += _field(3, b"".join(_varint(g << 3) + _varint(w) if isinstance(w, int) else _field(g, w) for g, w in pieces._fields(v)))
    return out


def test_pieces_against_the_library(spark, small, odd, empty):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    raw = open(path, "rb").read()
    p = pieces.pieces_of(raw)
    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(raw, p.v.scores))
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + ["", "  a  b ", "日本語 テキスト\n\nfoo", "a\0b c", " lead", "tab\tx", "😀😀 x", "\n"]
    same = 0
    for t, mine in zip(texts, p.encode(texts)):
        ids, theirs = np.frombuffer(mine, "<u4").tolist(), library.encode(t)
        score = lambda x: sum(float(p.v.scores[i]) if p.v.kinds[i] == pieces.NORMAL else 0.0 for i in x)
        assert abs(score(ids) - score(theirs)) < 1e-2 and len(ids) == len(theirs)  # equal scores may be split another way
        same += ids == theirs
        assert p.decode(np.array(ids)) == t
    assert same > 0.9 * len(texts)
    rows = pieces.encoded(odd, path).collect()
    assert len(rows) == 15 and all(r.round_trip for r in rows)
    assert pieces.encoded(empty, path).count() == 0


def test_wider_vectors_are_an_error(spark):
    wide = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 65)], "vec_id long, embedding array<double>")
    assert hamming_search.codes(wide.where("vec_id = 1"), "vec_id", "embedding").count() == 1
    with pytest.raises(Exception, match="65 dimensions"):
        hamming_search.codes(wide, "vec_id", "embedding").collect()


def test_plain_words_are_encoded_without_marks(monkeypatch):
    from tokenizers import Tokenizer

    from clausula.llm import tokens

    path = queries.tokenizer_file("word_bpe_49k.json")
    held, seen, whole = tokens.Encoder(path), [], tokens.Encoder._whole
    monkeypatch.setattr(tokens.Encoder, "_whole", lambda self, text: seen.append(text) or whole(self, text))
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    ids = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    text = "Straßenbau miuear, Ñandú; encorres ÀÉ ostamente.\nJaieos! a b? déjà"
    assert held.encode(text) == ids(text)
    assert seen and not any(tokens.MARK in x for x in seen)
    odd = "don't it's 'S e\u0301a x1 12, a.b c... (d) \u0130x \ufb01n \u6f22\u5b57, \x01 a\x01b \u00d7 \u00f7a <|endoftext|> q,\n  r :"
    assert held.encode(odd) == ids(odd)
    assert held.encode(f"{text} {odd} {text}") == ids(f"{text} {odd} {text}")


def test_words_go_to_the_library_once(monkeypatch):
    """Whatever their case and the marks around them, over all texts of a batch; and batches give the library's ids."""
    from clausula.llm import tokens

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = tokens.Encoder(queries.tokenizer_file(name))
        texts = ["Miuear miuear, (MIUEAR) x$$$", None, "miuear!! ~Miuear~ *** don't 12 miu\u0301ear", "", "\u212a \u212b \u1e9e \u0178 \u0130 a\tb", "  two  blanks", "one\nline two", "<|endoftext|> \x01"] * 2
        monkeypatch.setattr(tokens, "BATCH_BYTES", 40)
        want = [e.plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(pa.array(texts))] == want
        monkeypatch.setattr(tokens, "CACHE_BYTES", 200)  # generations turn over
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(pa.array(texts).slice(1))] == want[1:]
        monkeypatch.undo()
    e, seen, whole = tokens.Encoder(queries.tokenizer_file("word_bpe_49k.json")), [], tokens.Encoder._whole
    monkeypatch.setattr(tokens.Encoder, "_whole", lambda self, text: seen.append(text) or whole(self, text))
    assert len(list(e.encode_all(pa.array(["Miuear miuear, (MIUEAR) x$$$", "miuear!! ~Miuear~"])))) == 2
    assert " ".join(seen).split().count("miuear") == 1 and "".join(seen).lower().count("miuear") == 1


def test_words_of_byte_level_files_go_to_the_library_once(monkeypatch):
    """Whatever marks stand around them; and runs of letters, marks and blanks in any order give the library's ids."""
    from clausula.llm import tokens

    path = queries.tokenizer_file("byte_bpe_50k.json")
    e, rng = tokens.Encoder(path), np.random.default_rng(8)
    runs = ["Straße", "miuear", "THAT", ",", "***", "(", "'", "'s", "12", "_", "<|endoftext|>", "\x01", "e\u0301", "\u00d7", "\u6f22", "\u0130x", "\u00b2"]
    texts = [blank.join("".join(rng.choice(runs, rng.integers(1, 5))) for _ in range(30)) for blank in (" ", "\n") * 40]
    texts += [" ".join(x.replace("\n", " ") if i % 7 else x for i, x in enumerate(t.split(" "))) for t in texts]
    want = [e.plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(pa.array(texts))] == want
    e, seen, whole = tokens.Encoder(path), [], tokens.Encoder._whole
    monkeypatch.setattr(tokens.Encoder, "_whole", lambda self, text: seen.append(text) or whole(self, text))
    assert len(list(e.encode_all(pa.array(["x miuear, miuear!! miuear. a", "y miuear$$$ miuear?! a"])))) == 2
    assert "".join(seen).count("miuear") == 1


def test_seating_of_sizes_together_follows_the_recurrence():
    """Sizes that are seated in one array give the tables that each would have alone."""
    rng = np.random.default_rng(3)
    c = rng.integers(3, 257, 3000)
    a, b, u, d = rng.random(3000) * 20, rng.random(3000) * 0.1, rng.random(3000), 0.6
    s = pitman_yor.log_stirling(d)
    want = []
    for n, mass, more, x in zip(c.tolist(), a, b, u):
        w = s[n, 1 : n + 1] + np.cumsum(np.log(mass + more * np.arange(n)))
        w = np.cumsum(np.exp(w - w.max()))
        want.append(1 + int((w < x * w[-1]).sum()))
    assert pitman_yor.reseat(c, a, b, d, u).tolist() == want


def test_grams_of_words_by_a_walk_and_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(11)
    of = pitman_yor.classes(np.bincount(rng.integers(97, 123, 1000), minlength=256))
    length = rng.integers(0, 9, 20_000)
    words, ends = rng.integers(60, 140, int(length.sum())).astype(np.uint8), np.cumsum(length)
    tracemalloc.start()
    gram, byte, place = pitman_yor.grams(words, ends, of)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want, bytes_, places = [], [], []
    for s, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
        places.append(len(want))
        before = [0] * pitman_yor.DEPTH
        for b in [*words[s:e].tolist(), 256]:
            symbol = 0 if b == 256 else int(of[b])
            want.append(symbol + sum(x * pitman_yor.SYMBOLS ** (k + 1) for k, x in enumerate(before)))
            bytes_.append(b)
            before = [symbol, *before[:-1]]
    assert (gram.tolist(), byte.tolist(), place.tolist()) == (want, bytes_, places)
    assert peak < 36 * len(gram)


def test_encoders_keep_as_little_as_asked(spark):
    """A small cache turns its generations over and gives the same ids; and packing passes its size on."""
    from clausula.llm import packing, tokens

    rng = np.random.default_rng(5)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(40)) for _ in range(30)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = queries.tokenizer_file(name)
        want = list(tokens.Encoder(path).encode_all(pa.array(texts)))
        e = tokens.encoder(path, cache_bytes=20_000)
        assert [x for t in texts for x in e.encode_all(pa.array([t]))] == want
        assert len(e.held) + len(e.older) < 600 and e.older
        assert tokens.encoder(path).cache_bytes is None
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [packing.token_pieces(docs, path, 0, 64, cache_bytes=x).orderBy("doc_id", "piece").collect() for x in (None, 20_000)]
    assert rows[0] == rows[1]


def test_tasks_hand_back_memory(monkeypatch):
    """When their last batch is done, and also when nobody reads on."""
    from clausula.llm import near_dedup, shared

    given = []
    monkeypatch.setattr(shared, "hand_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["a b c", "d e f"]})
    assert sum(b.num_rows for b in near_dedup._sets([batch], 2)) == 2 and len(given) == 1
    rows = near_dedup._sets([batch], 2)
    next(rows)
    rows.close()
    assert len(given) == 2
    monkeypatch.undo()
    shared.hand_back()


def test_what_a_block_knows_takes_four_bytes_a_small_number():
    """Numbers of more than two bytes keep eight; both read alike."""
    from clausula.llm import lm

    counts = [np.array([3, 0, 1, 700]), np.array([1 << 40, 5, 0, 2])]
    for parts, kind in (((0,), np.int32), ((1,), np.int64), ((0, 1), np.int64)):
        rows = [lm._row(lm.TRIPLE_COUNTS, 7, i, 4, lm._pack(2 * counts[i] + 1)) for i in parts]
        k = lm.Known(pa.Table.from_pylist(rows, lm.TYPE))
        assert k.c3.dtype == kind and k.own3.all()
        assert k.c3.tolist() == [x for i in parts for x in counts[i].tolist()]
