"""Operators on vectors against brute force."""

import hashlib
import math

import numpy as np
import pytest

from clausula.llm import embedding_dedup, hard_negatives, part_codes
from clausula.llm.embedding_dedup import near_vectors
from clausula.llm.hard_negatives import Block
from clausula.llm.part_codes import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, node long, cell string, id long, digest string, x double"


def table(spark, rows):
    """Rows of (vec_id, vector, label) with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], l, 5, "c", 6, None, 0.5) for i, v, l in rows], SCHEMA)


def clusters(n, seed, width=16, groups=7, noise=0.05):
    """Groups of near vectors, one of them with a third of all rows, among others without neighbours."""
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, width))
    out = []
    for i in range(n):
        kind = r.integers(0, 9)
        v = centre[0] if kind < 3 else centre[r.integers(1, groups)] if kind < 6 else r.normal(size=width)
        v = v + (0 if i % 5 == 0 and kind < 3 else noise * r.normal(size=width))
        out.append((i * 3 + 1, (v * r.uniform(0.1, 9)).astype(np.float32), int(r.integers(0, 4))))
    return out


def links_of(rows, threshold):
    """n_links and component_id by all pairs."""
    sound = [k for k, (i, v, _) in enumerate(rows) if i is not None and v is not None and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)]
    x = np.array([rows[k][1] for k in sound], float)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    least = np.array([rows[k][0] for k in sound])
    while True:
        lower = np.array([min([m, *least[near[j]]]) for j, m in enumerate(least)])
        if (lower == least).all():
            break
        least = lower
    out = {k: (0, rows[k][0]) for k in range(len(rows))}
    out.update({k: (int(near[j].sum()), int(least[j])) for j, k in enumerate(sound)})
    return sorted(((rows[k][0], *out[k]) for k in out), key=repr)


@pytest.mark.parametrize("threshold, block", [(0.95, 8192), (0.9, 64)])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, threshold, block):
    """Recall is 1: links, components and counts are those of all pairs, with lists in one cell and large lists in many."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = clusters(700, int(block))
    got = near_vectors(table(spark, rows), threshold).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == links_of(rows, threshold)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_with_a_poor_index(spark, monkeypatch):
    """What the sample and the codes are decides costs, not results."""
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 12)
    monkeypatch.setattr(embedding_dedup, "LISTS", 5)
    rows = clusters(300, 3)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in near_vectors(table(spark, rows)).collect()), key=repr) == links_of(rows, 0.95)


def test_near_vectors_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [2.0, 0.01, 0.0]
    rows = [(1, a, 0), (2, b, 0), (2, b, 0), (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [1.0, None, 0.0], 0), (6, [math.nan, 1, 1], 0), (7, [math.inf, 1, 1], 0), (8, [1e30, 0, 0], 0), (9, [1e-38, 0, 0], None), (None, a, 0), (10, [0.0, 1.0, 0.0], 1), (10, [0.0, 0.0, 1.0], 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(table(spark, [*rows, (11, [1.0], 0)])).collect()), key=repr)
    want = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (8, 4, 1, False), (9, 4, 1, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 10, 10, 11, None)]
    assert got == sorted(want, key=repr)
    assert near_vectors(table(spark, [])).collect() == []
    assert [tuple(r) for r in near_vectors(table(spark, [(3, None, 0)])).collect()] == [(3, 0, 3, True)]


def mined(rows, anchors, k=5, m=3, least=50, most=95, scale=256):
    """Hard negatives by all scores."""
    held = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and None not in list(v) and np.isfinite(np.array(v, float)).all():
            key = (label, tuple(np.floor(scale * np.array(v, np.float32).astype(float)).astype(int)))
            held[i] = min(held.get(i, key), key, key=lambda x: (x[0], np.array(x[1], np.int32).tobytes()))
    out = []
    for a, (label, x) in held.items():
        if not anchors(a):
            continue
        scored = sorted((-int(np.dot(x, y)), i, other) for i, (other, y) in held.items() if i != a)
        for s, p, _ in [t for t in scored if t[2] == label][:k]:
            fits = [t for t in scored if t[2] != label and -least * s <= -100 * t[0] <= -most * s]
            out += [(a, p, r, n, -s, -q) for r, (q, n, _) in enumerate(fits[:m], 1)]
    return sorted(out)


@pytest.mark.parametrize("rows_a_block", [None, 40])
def test_hard_negatives_equal_all_scores(spark, monkeypatch, rows_a_block):
    if rows_a_block:
        monkeypatch.setattr(hard_negatives, "block_rows", lambda n: rows_a_block)
    r = np.random.default_rng(5)
    centre = r.normal(size=(6, 15))
    rows = [(i, (centre[r.integers(0, 6)] + r.normal(size=15) * 0.6) / 4, int(r.choice([0, 0, 0, 1, 2, -3]))) for i in range(400)]
    rows += [(i, rows[i - 400][1], int(r.integers(0, 3))) for i in range(400, 430)]  # ties
    from pyspark.sql import functions as F

    got = hard_negatives.hard_negatives(table(spark, rows), F.col("id") % 10 == 0).collect()
    want = mined(rows, lambda a: a % 10 == 0)
    assert len(want) > 100 and sorted(tuple(r) for r in got) == want


def test_bounds_hold_and_leave_out(spark):
    """Bounds of the approximation contain the scores and are tight enough to leave most rows out."""
    import pyarrow as pa

    x = np.random.default_rng(2).normal(size=(3000, 31)) * 30
    x = np.floor(x).astype(np.int32)
    block = Block(pa.table({"id": np.arange(3000), "label": np.zeros(3000, np.int64), "x": pa.array([v.tobytes() for v in x], pa.binary())}), 31)
    for q, (lower, upper) in zip(x[:20], block.bounds(x[:20].astype(np.int64))):
        score = x.astype(np.int64) @ q
        assert (lower <= score).all() and (score <= upper).all()
        assert (upper >= np.sort(lower)[-5]).mean() < 0.5


def test_hard_negatives_odd_rows(spark):
    from pyspark.sql import functions as F

    v = [1.0, 0.5]
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (2, [0.8, 0.1], 2), (3, [0.8, 0.1], 2), (4, None, 1), (5, v, None), (6, [1.0, None], 1), (7, [math.nan, 1.0], 2), (None, v, 1), (8, [1.0], 1), (9, [0.9, 0.1], 3), (10, [-1.0, -1.0], 4), (11, [0.9, 0.2], 4), (20, [0.0, 0.0], 5), (21, [0.0, 0.0], 5)]
    got = hard_negatives.hard_negatives(table(spark, rows), F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined([r for r in rows if r[0] != 8], lambda a: a % 10 == 0)
    assert hard_negatives.hard_negatives(table(spark, []), F.col("id") % 10 == 0).collect() == []
    with pytest.raises(Exception, match="integer components"):
        hard_negatives.hard_negatives(table(spark, [(1, [1e9, 0.0], 1)]), F.col("id") >= 0).collect()


def coded(rows, rounds=2, entries=64, parts=16):
    """Codes and errors by full search."""
    held = [(i, l, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).reshape(parts, -1)) for i, v, l in rows]
    held.sort(key=lambda t: (t[0] is None, t[0], t[2].astype(np.int32).tobytes()))
    x = np.array([t[2] for t in held])
    books = x[:entries].transpose(1, 0, 2).copy()
    assign = lambda: np.array([((x[:, p, None, :] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)]).T
    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (code[:, p] == e).any():
                    books[p, e] = np.floor_divide(x[code[:, p] == e, p].sum(0), (code[:, p] == e).sum())
    code = assign()
    error = [sum(int(((x[k, p] - books[p, code[k, p]]) ** 2).sum()) for p in range(parts)) for k in range(len(x))]
    total = {}
    for t, e in zip(held, error):
        total[t[1]] = total.get(t[1], 0) + e
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((t[0], "".join(f"{c:02x}" for c in code[k]), error[k], total[t[1]], sha) for k, t in enumerate(held)), key=repr)


def test_partial_distance_search_equals_full_search():
    r = np.random.default_rng(1)
    for width in (1, 2, 4, 9):
        x, book = r.integers(-40, 40, (500, width)), r.integers(-40, 40, (64, width))
        book[10] = book[40]  # ties
        entry, distance = nearest(x, book)
        full = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (entry == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_part_codes_equal_full_search(spark):
    rows = clusters(300, 9, width=48)
    rows += [(i, v, None) for i, v, _ in rows[:20]] + [(None, rows[3][1], 2)]
    got = part_codes.part_codes(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == coded(rows)


def test_part_codes_odd_rows(spark):
    v = [0.1 * i for i in range(16)]
    rows = [(1, v, 1), (1, v[::-1], 1), (2, v, None), (None, v, None)]
    odd = [(3, None, 1), (4, [*v[:-1], None], 1), (5, [*v[:-1], math.inf], 1), (6, [1.0], 1), (7, [], 1)]
    assert sorted((tuple(r) for r in part_codes.part_codes(table(spark, rows + odd)).collect()), key=repr) == coded(rows)
    assert part_codes.part_codes(table(spark, [])).collect() == []
    with pytest.raises(ValueError, match="do not divide"):
        part_codes.part_codes(table(spark, [(1, [1.0, 2.0], 1)]))
