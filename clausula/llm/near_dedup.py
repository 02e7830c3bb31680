"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

Each text's signature is HASHES symbols of b = 16 bits, the low bits of the minima of its shingle
hashes under HASHES functions. Two sets of similarity s differ in a symbol with probability 1 - s;
at 0.8 the distance passes DISTANCE = 25 of 64 with probability 1.5e-4. The join finds every pair
within DISTANCE for certain: the signature is split into CHUNKS = 13 chunks; 25 errors leave at
least one chunk with at most one error (pigeonhole: 13 * 2 > 25), and enumerating the place of that
error (each chunk with each one of its symbols left out) makes such chunks meet in an equal key.

Links are then confirmed on full shingle sets. No bucket emits all its pairs:
  1. equal sets are one class, and only one text of a class goes on;
  2. in each bucket every member is compared with the bucket's first member; links give components;
  3. where a bucket holds several components with members within DISTANCE of each other, a forest of
     edges joins these components to clusters, and all members of a cluster's components are
     compared, but for members of one large component with each other.
After step 3 no pair of different components within DISTANCE is left uncompared, so the components
are those of all links. Comparisons run in cells: a block of about BLOCK members is held, as
postings of their shingles, while another block streams past it; blocks are dealt by hash, so a
group may hold any share of the rows. A visitor gives one link for each other component it meets.

Defined results: a text without words (or null) has an empty set, is linked with nothing and is its
own component. Rows that repeat a doc_id share one component. A null doc_id gets no component and
is kept. Other columns are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.llm import bloom
from clausula.llm.components import components
from clausula.llm.shared import files_for, id_text, tidy, written
from clausula.llm.texthash import buffers, mix, pieces, shingle_hashes, word_hashes

HASHES, DISTANCE, CHUNKS = 64, 25, 13
BLOCK, VISITORS = 512, 4096
#: Texts that a file of an intermediate table says something of.
TEXTS = 10_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int):
    """For each slice of a batch: its first row, all shingle hashes, and where each text's begin."""
    for first, part in pieces(texts, 2_000_000):
        yield first, *shingle_hashes(*word_hashes(*buffers(part)), k)


def signatures(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Signature of each set; of an empty set, zeros."""
    out = np.zeros((len(place) - 1, HASHES), np.uint16)
    some = place[:-1] < place[1:]
    if some.any():
        at, turned = place[:-1][some], np.empty_like(hashes)
        with np.errstate(over="ignore"):
            for j, a in enumerate(_multipliers()):
                np.multiply(hashes, a, out=turned)
                out[some, j] = (np.minimum.reduceat(turned, at) >> np.uint64(8)).astype(np.uint16)
    return out


def keys(sig: np.ndarray) -> np.ndarray:
    """HASHES keys of each signature: each chunk with each one of its symbols left out."""
    n, out = len(sig), np.empty((len(sig), HASHES), np.uint64)
    ends = np.round(np.linspace(0, HASHES, CHUNKS + 1)).astype(int)
    wide = sig.astype(np.uint64)
    with np.errstate(over="ignore"):
        for c in range(CHUNKS):
            for left_out in range(ends[c], ends[c + 1]):
                h = np.full(n, left_out + 1, np.uint64)
                for q in range(ends[c], ends[c + 1]):
                    if q != left_out:
                        h = mix(h * _BASE + wide[:, q] + np.uint64(1))
                out[:, left_out] = h
    return out


@tidy
def _sets(batches, k: int):
    for b in batches:
        for first, h, place in shingle_sets(b["text"], k):
            n = len(place) - 1
            count, one, two = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            with np.errstate(over="ignore"):
                for i in range(n):
                    u = np.unique(h[place[i] : place[i + 1]])
                    count[i], one[i], two[i] = len(u), u.sum(dtype=np.uint64), mix(u ^ _BASE).sum(dtype=np.uint64)
            sig = signatures(h, place).tobytes()
            yield pa.RecordBatch.from_arrays([b["doc_id"].slice(first, n), pa.array(count), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([sig[2 * HASHES * i : 2 * HASHES * (i + 1)] for i in range(n)], pa.binary())], ["doc_id", "n_shingles", "one", "two", "sig"])


def _as_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


@tidy
def _emit_keys(batches):
    for b in batches:
        for i in range(0, b.num_rows, 2000):
            part = b.slice(i, 2000)
            k = keys(_as_matrix(part["sig"]))
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(np.repeat(part["rep"].to_numpy(), HASHES))], ["key", "rep"])


@tidy
def _shared_keys(batches):
    """Of rows sorted by key and rep: those whose key another row has, with the first rep of the key."""
    held_key = held_rep = pivot = None
    for b in batches:
        k, r = b["key"].to_numpy(), b["rep"].to_numpy()
        if not len(k):
            continue
        if held_key is not None:
            k, r = np.r_[held_key, k], np.r_[held_rep, r]
        new = np.r_[True, k[1:] != k[:-1]]
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        first = r[start][run]
        many = np.diff(np.r_[start, len(k)])[run] > 1
        if pivot is not None:  # the first row goes on with a run that has been seen in part
            first[run == 0], many[run == 0] = pivot, True
        last = int(start[-1])
        # The last row is held, as its run may go on; its run's pivot too, if the run has two rows by now.
        emit = many.copy()
        emit[-1] = False
        if emit.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[emit]), pa.array(r[emit]), pa.array(first[emit])], ["key", "rep", "pivot"])
        pivot = first[-1] if last < len(k) - 1 or (pivot is not None and run[-1] == 0) else None
        held_key, held_rep = k[-1:], r[-1:]
    if held_key is not None and pivot is not None:
        yield pa.RecordBatch.from_arrays([pa.array(held_key), pa.array(held_rep), pa.array([pivot])], ["key", "rep", "pivot"])


@tidy
def _near(batches):
    for b in batches:
        if b.num_rows:
            yield b.filter(pa.array((_as_matrix(b["sig_a"]) != _as_matrix(b["sig_b"])).sum(1) <= DISTANCE)).select(["a", "b"])


def _runs(batches, key: str):
    """Whole runs of equal keys in sorted batches, one table each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        k = b[key].to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        for i, j in zip(start, np.r_[start[1:], len(k)]):
            if held and held[-1][key][0].as_py() != k[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


@tidy
def _meetings(batches):
    """Of each bucket of several components: pairs of components that join all those with members near each other (a forest)."""
    seen: set[tuple[int, int]] = set()

    def out():
        return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in seen], pa.int64()), "b": pa.array([c for _, c in seen], pa.int64())})

    for t in _runs(batches, "key"):
        comp, sig = t["comp"].to_numpy(), _as_matrix(t["sig"])
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for i in range(0, len(comp), 256):
            for j in range(i, len(comp), 256):
                if comp[i] == comp[min(j + 255, len(comp) - 1)]:  # rows are sorted by component
                    continue
                near = (sig[i : i + 256, None, :] != sig[None, j : j + 256, :]).sum(2) <= DISTANCE
                x, y = np.nonzero(near & (comp[i : i + 256, None] < comp[None, j : j + 256]))
                for a, c in set(zip(comp[i + x].tolist(), comp[j + y].tolist())):
                    a, c = find(a), find(c)
                    if a != c:
                        root[max(a, c)] = min(a, c)
                        seen.add((min(a, c), max(a, c)))
        if len(seen) > 100_000:
            yield out()
            seen.clear()
    if seen:
        yield out()


@tidy
def _confirm(batches, k: int, percent: int):
    """In rows sorted by cell and side: links of each visitor with one similar member of each other component."""
    now, members, ready = None, [], None
    for b in batches:
        cell, side, ident, comp = (b[c].to_pylist() for c in ("cell", "side", "id", "comp"))
        found = []
        for first, h, place in shingle_sets(b["text"], k):
            for i in range(len(place) - 1):
                r = first + i
                if cell[r] != now:
                    now, members, ready = cell[r], [], None
                u = np.unique(h[place[i] : place[i + 1]])
                if side[r] == 0:
                    members.append((ident[r], comp[r], u))
                    continue
                if ready is None:  # all members have come: postings of their shingles
                    sizes = np.array([len(m) for *_, m in members], np.int64)
                    every = np.concatenate([m for *_, m in members]) if members else np.zeros(0, np.uint64)
                    o = np.argsort(every, kind="stable")
                    ready = sizes, every[o], np.repeat(np.arange(len(members)), sizes)[o], np.array([c for _, c, _ in members], np.int64)
                sizes, every, whose, comps = ready
                if not len(every):
                    continue
                lo, hi = np.searchsorted(every, u, "left"), np.searchsorted(every, u, "right")
                n = hi - lo
                at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                both = np.bincount(whose[at], minlength=len(members))
                ok = np.flatnonzero((100 * both >= percent * (sizes + len(u) - both)) & (comps != comp[r]))
                if len(ok):
                    found += [(members[m][0], ident[r]) for m in ok[np.unique(comps[ok], return_index=True)[1]]]
        if found:
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def _confirmed(rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links found in cells. rows: cell, side (0 held, 1 streamed past), id, comp (the component so far)."""
    dealt = rows.join(texts, "id").select("cell", "side", "id", "comp", "text")
    return dealt.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(lambda it: _confirm(it, k, percent), "a long, b long")


def _star_cells(near: DataFrame) -> DataFrame:
    """Cells of one first member each; where many are near it, several cells."""
    parts = near.groupBy("a").agg(F.ceil(F.count("*") / VISITORS).alias("parts"))
    held = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select(F.xxhash64("a", "part").alias("cell"), F.lit(0).alias("side"), F.col("a").alias("id"))
    past = near.join(parts, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), "parts")).alias("cell"), F.lit(1).alias("side"), F.col("b").alias("id"))
    return held.unionByName(past).withColumn("comp", F.col("id"))


def _cluster_cells(meetings: DataFrame, comp: DataFrame, files: int) -> DataFrame:
    """Cells that bring all members of components that meet together, in pairs of blocks; blocks of one large component meet only others."""
    cluster = components(meetings, files=files).select(F.col("node").alias("comp"), F.col("component").alias("cluster"))
    inside = cluster.join(comp.select(F.col("component").alias("comp"), F.col("node").alias("id")), "comp", "left").withColumn("id", F.coalesce("id", "comp"))
    large = inside.groupBy("cluster", "comp").count().withColumn("own", F.when(F.col("count") > BLOCK, F.col("comp")).otherwise(-1)).withColumn("large", F.col("count") > BLOCK).drop("count")
    grouped = written(inside.join(large, ["cluster", "comp"]), "clusters", files=files)
    parts = grouped.groupBy("cluster", "own", "large").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks = parts.select("cluster", "own", "large", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block"))
    a, b = blocks.toDF("cluster", "own_a", "large_a", "block_a"), blocks.drop("large").toDF("cluster", "own_b", "block_b")
    ordered = "(own_a < own_b OR (own_a = own_b AND block_a <= block_b)) AND NOT (large_a AND own_a = own_b)"
    cells = a.join(b, "cluster").where(ordered).withColumn("cell", F.xxhash64("cluster", "own_a", "block_a", "own_b", "block_b"))
    placed = grouped.join(parts.drop("large"), ["cluster", "own"]).select("cluster", "own", F.pmod(F.xxhash64("id"), "parts").alias("block"), "id", "comp")
    sides = [cells.select("cluster", F.col(f"own_{x}").alias("own"), F.col(f"block_{x}").alias("block"), "cell", F.lit(i).alias("side")) for i, x in enumerate("ab")]
    return placed.join(sides[0].unionByName(sides[1]), ["cluster", "own", "block"]).select("cell", "side", "id", "comp")


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. k: words a shingle; percent: least similarity, 80 or more, for which DISTANCE is meant."""
    if percent < 80:
        raise ValueError("the signature distance is meant for similarities of 80 percent and more")
    docs = id_text(docs)
    sets = written(docs.mapInArrow(lambda it: _sets(it, k), "doc_id long, n_shingles long, one long, two long, sig binary"), "sets")
    named = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    files = files_for(sets.count(), TEXTS)
    classes = written(named.groupBy("one", "two", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("m")).select("one", "two", "n_shingles", F.col("m.doc_id").alias("rep"), F.col("m.sig").alias("sig")), "classes", files=files)
    shared = written(classes.select("rep", "sig").mapInArrow(_emit_keys, "key long, rep long").repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_shared_keys, "key long, rep long, pivot long"), "shared", files=files)
    stars = shared.where("pivot <> rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    sig = classes.select("rep", "sig")
    wanted = shared.select(F.col("rep").alias("id")).distinct()
    many = wanted.count()
    few = files_for(many, TEXTS)
    near = written(stars.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").mapInArrow(_near, "a long, b long"), "near", files=few)

    bits = bloom.bits_for(many)
    maybe = docs.where(bloom.may_contain(docs, F.col("doc_id"), bloom.filter_of(wanted, F.col("id"), bits)))
    texts = written(maybe.join(wanted, maybe.doc_id == wanted.id, "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts", files=few)

    first = written(_confirmed(_star_cells(near), texts, k, percent), "links", files=few)
    comp = written(components(first, files=few), "components", files=few)
    at = shared.select("key", "rep").join(comp.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    mixed = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    meetings = at.join(mixed, "key").join(sig, "rep").select("key", "comp", "sig").repartition("key").sortWithinPartitions("key", "comp").mapInArrow(_meetings, "a long, b long").distinct()
    second = _confirmed(_cluster_cells(meetings, comp, few), texts, k, percent)
    links = written(first.unionByName(second), "links", files=2 * few)
    final = components(links, files=few).select(F.col("node").alias("rep"), "component")
    labelled = classes.join(final, "rep", "left").select("one", "two", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = named.drop("sig").join(labelled, ["one", "two", "n_shingles"]).select("doc_id", "n_shingles", "component")
    rest = sets.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return out.unionByName(rest).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the smallest doc_id."""
    gone = near_duplicates(docs, k, percent).where("NOT kept").select(F.col("doc_id").alias("_near_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_near_id"], "left_anti")
