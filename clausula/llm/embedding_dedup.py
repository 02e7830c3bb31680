"""Near-duplicate vectors by product quantisation.

Coarse inverted lists: spherical k-means over a bounded sample (at most SAMPLE distinct vectors) gives about sqrt(n)
unit centroids, at most LISTS. Every vector lies in the list of its nearest centroid, and its residual from the centroid
is coded by PARTS subspace codebooks of 256 entries, trained on the same sample.

Sufficient probes: let a lie in list A and b in list B, and let their cosine be at least the threshold, so that
|a - b| <= d = sqrt(2 - 2 * threshold). The plane midway between both centroids parts them, so their distances from it
add up to d at most and one of the two is within d / 2 of it. A vector therefore probes each list whose midway plane to its
own list is within d / 2: of each such pair one end probes the other's list, whatever the sample was. A pair that both
ends find is counted at the smaller list.

Asymmetric distances: for a probing vector q and a stored x with the decoded x' = centroid + codes, the cosine of q and x'
comes from table lookups (q against all codebook entries, once a vector). x keeps its own angle to x', so the angle of q
and x is at least angle(q, x') - angle(x, x'); what may reach the threshold goes on to the exact cosine in double
precision. No pair at or above the threshold is lost and none below it is linked: recall is 1 by construction, and the tests
measure it against brute force.

Equal vectors are one class, of which one goes on with the class's size. Stored vectors lie in cells of about BLOCK (small
lists together, large ones split by hash); a task holds one cell while the vectors that probe it stream past. It gives
each vector's number of links and a forest of edges, so rows made grow with vectors and cells, not with links.

Defined results: one row per row of the input. A vector that is null, zero, or holds a null, NaN or infinite component, one
of another length than the most common, and one of a null id link with nothing: n_links 0, component_id their own id,
kept true. Rows that repeat an id are vectors of their own, each with its links and component. Equal vectors link with each
other. Other columns are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.llm.components import components
from clausula.llm.shared import written
from clausula.llm.vectors import blobs, finite, matrix, packed, passed_by, usual_length

SAMPLE, LISTS, PARTS, ENTRIES, BLOCK = 1 << 16, 4096, 8, 256, 8192
#: Bounds from float32 tables are widened by this much.
SLACK = 1e-4


def units(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that no square leaves the range of numbers."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _means(rows: np.ndarray, n: int, rounds: int, spherical: bool) -> np.ndarray:
    """k-means of rows; the first n rows begin, and a centroid without rows stays."""
    at = rows[:n].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(rows[i : i + 4096] @ at.T - (0 if spherical else (at * at).sum(1) / 2), 1) for i in range(0, len(rows), 4096)])
        order = np.argsort(own, kind="stable")
        some, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(rows[order], first)
        if spherical:
            length = np.sqrt((sums * sums).sum(1))
            some, sums, count = some[length > 0], sums[length > 0], length[length > 0]
        else:
            count = np.diff(np.r_[first, len(rows)])
        at[some] = sums / count[:, None]
    return at


class Model:
    """Centroids (unit) and, for each part of the dimensions, codebook entries."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.width = sample.shape[1]
        self.centroids = _means(sample, min(lists, len(sample)), 6, True)
        own = np.concatenate([np.argmax(sample[i : i + 4096] @ self.centroids.T, 1) for i in range(0, len(sample), 4096)])
        rest = sample - self.centroids[own]
        self.parts = [p for p in np.array_split(np.arange(self.width), PARTS) if len(p)]
        self.books = [_means(rest[:, p], min(ENTRIES, len(sample)), 4, False) for p in self.parts]

    def coded(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and what they decode to."""
        codes, back = np.empty((len(rest), len(self.parts)), np.uint8), np.empty_like(rest)
        for m, (p, book) in enumerate(zip(self.parts, self.books)):
            codes[:, m] = np.argmax(rest[:, p] @ book.T - (book * book).sum(1) / 2, 1)
            back[:, p] = book[codes[:, m]]
        return codes, back

    def tables(self, rows: np.ndarray) -> list[np.ndarray]:
        """For each part, the inner products of rows with all entries."""
        return [(rows[:, p] @ book.T).astype(np.float32) for p, book in zip(self.parts, self.books)]


def _packed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["id"], packed(b["vector"])], ["id", "vector"])


ASSIGNED = "node long, size long, list int, code binary, scale double, bound double, probes binary, vector binary"


def _assigned(batches, model: Model, threshold: float):
    half, angle = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2, math.acos(threshold)
    step = max(16, 1_000_000 // len(model.centroids))
    near = np.sqrt(np.maximum(0, 2 - 2 * model.centroids @ model.centroids.T)).astype(np.float32) if len(model.centroids) <= 1024 else None
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            b = batch.slice(i, step)
            x = units(matrix(b["vector"], np.float64, model.width))
            cos = x @ model.centroids.T
            own = np.argmax(cos, 1)
            apart = near[own] if near is not None else np.sqrt(np.maximum(0, 2 - 2 * model.centroids[own] @ model.centroids.T))
            mask = cos[np.arange(len(x)), own][:, None] - cos <= half * apart + 1e-6
            mask[np.arange(len(x)), own] = True
            probes, n = np.nonzero(mask)[1].astype(np.int32), mask.sum(1)
            codes, back = model.coded(x - model.centroids[own])
            back += model.centroids[own]
            length = np.sqrt((back * back).sum(1))
            scale = np.where(length > 0, 1 / np.maximum(length, 1e-300), 0.0)
            off = np.arccos(np.clip((x * back).sum(1) * scale, -1, 1)) + angle
            bound = np.where((length > 0) & (off < math.pi), np.cos(np.minimum(off, math.pi)), -2.0)
            ends = np.r_[0, np.cumsum(n)] * 4
            lists = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(probes)])
            yield pa.RecordBatch.from_arrays([b["node"], b["size"], pa.array(own.astype(np.int32)), blobs(codes), pa.array(scale), pa.array(bound), lists, b["vector"]], ["node", "size", "list", "code", "scale", "bound", "probes", "vector"])


def in_line(points: np.ndarray) -> np.ndarray:
    """An order of points in which neighbours tend to be near: halves by the direction from a point far out, again and again."""
    todo, out = [np.arange(len(points))], []
    while todo:
        some = todo.pop()
        if len(some) <= 2:
            out.append(some)
            continue
        far = points[some[np.argmin(points[some] @ points[some[0]])]]
        some = some[np.argsort(points[some] @ far, kind="stable")]
        todo += [some[len(some) // 2 :], some[: len(some) // 2]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def layout(model: Model, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """First cell and number of cells of each list: small lists share a cell of about BLOCK vectors, large ones have several."""
    first, parts, cell, held = np.zeros(len(model.centroids), np.int64), np.ones(len(model.centroids), np.int64), 0, 0
    for a in in_line(model.centroids).tolist():
        n = counts.get(a, 0)
        if held and held + n > BLOCK:
            cell, held = cell + 1, 0
        first[a], parts[a] = cell, max(1, -(-n // BLOCK))
        if n > BLOCK:
            cell, held = cell + int(parts[a]), 0
        else:
            held += n
    return first, parts


DEALT = "cell int, side int, " + ASSIGNED


def _dealt(batches, first: np.ndarray, parts: np.ndarray):
    """Each vector once as stored in its cell, and once as a visitor of each cell that its probes lie in."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            b = batch.slice(i, 2000)
            node, own = b["node"].to_numpy(), b["list"].to_numpy()
            with np.errstate(over="ignore"):
                salt = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((first[own] + salt % parts[own]).astype(np.int32)), pa.array(np.zeros(len(node), np.int32)), *b.columns], ["cell", "side", *b.schema.names])
            lists = [np.frombuffer(p, np.int32) for p in b["probes"].to_pylist()]
            who, lists = np.repeat(np.arange(len(node)), [len(p) for p in lists]), np.concatenate(lists)
            n = parts[lists]
            cell = np.repeat(first[lists] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            who, lists = np.repeat(who, n), np.repeat(lists, n)
            order = np.lexsort((lists, cell, who))
            who, lists, cell = who[order], lists[order], cell[order]
            new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (cell[1:] != cell[:-1])])
            ends = np.r_[new, len(who)] * 4
            for j in range(0, len(new), 20_000):
                at = new[j : j + 20_000]
                rows = pa.array(who[at])
                asked = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((ends[j : j + len(at) + 1] - ends[j]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(lists[at[0] : ends[j + len(at)] // 4]))])
                empty = pa.array([b""] * len(at), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell[at].astype(np.int32)), pa.array(np.ones(len(at), np.int32)), b["node"].take(rows), b["size"].take(rows), b["list"].take(rows), empty, pa.nulls(len(at), pa.float64()), pa.nulls(len(at), pa.float64()), asked, b["vector"].take(rows)], ["cell", "side", *b.schema.names])


class Cell:
    """The stored vectors of a cell by list, their links so far, and the smallest vector each is known to be joined with."""

    def __init__(self, t: pa.Table, model: Model):
        t = t.take(pa.array(np.argsort(t["list"].to_numpy(), kind="stable")))
        self.node, self.size, self.list = (t[c].to_numpy() for c in ("node", "size", "list"))
        self.codes = [np.ascontiguousarray(c) for c in matrix(t["code"], np.uint8, len(model.parts)).T]
        self.scale, self.bound = t["scale"].to_numpy().astype(np.float32), t["bound"].to_numpy().astype(np.float32) - np.float32(SLACK)
        self.x = units(matrix(t["vector"], np.float64, model.width))
        probes = [np.frombuffer(p, np.int32) for p in t["probes"].to_pylist()]
        n = len(model.centroids)
        self.probes = np.sort(np.repeat(np.arange(len(probes)), [len(p) for p in probes]) * n + np.concatenate(probes))
        lists, start = np.unique(self.list, return_index=True)
        self.ranges = list(zip(lists.tolist(), start.tolist(), np.r_[start[1:], len(self.list)].tolist()))
        self.links, self.least, self.model = np.zeros(len(self.node), np.int64), self.node.copy(), model


def _visit(cell: Cell, b: pa.RecordBatch, threshold: float):
    model = cell.model
    node, size, own = (b[c].to_numpy() for c in ("node", "size", "list"))
    q = units(matrix(b["vector"], np.float64, model.width))
    tables = model.tables(q)
    asked = [np.frombuffer(p, np.int32) for p in b["probes"].to_pylist()]
    who, asked = np.repeat(np.arange(len(node)), [len(p) for p in asked]), np.concatenate(asked)
    found_v, found_h = [], []
    for list_, lo, hi in cell.ranges:
        v = who[asked == list_]
        if not len(v):
            continue
        cos = np.repeat((q[v] @ model.centroids[list_]).astype(np.float32)[:, None], hi - lo, 1)
        for table, codes in zip(tables, cell.codes):
            cos += np.take(table[v], codes[lo:hi], axis=1)
        at, h = np.nonzero(cos * cell.scale[lo:hi] >= cell.bound[lo:hi])
        v, h = v[at], h + lo
        mine = own[v]
        key = h * len(model.centroids) + mine
        place = np.minimum(np.searchsorted(cell.probes, key), len(cell.probes) - 1)
        keep = np.where(mine == list_, node[v] < cell.node[h], (mine > list_) | (cell.probes[place] != key))
        v, h = v[keep], h[keep]
        for i in range(0, len(v), 100_000):
            a, c = v[i : i + 100_000], h[i : i + 100_000]
            ok = np.einsum("ij,ij->i", q[a], cell.x[c]) >= threshold
            found_v.append(a[ok])
            found_h.append(c[ok])
    v, h = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_v, found_h))
    if not len(v):
        return None
    links = np.bincount(v, cell.size[h], len(node)).astype(np.int64)
    cell.links += np.bincount(h, size[v], len(cell.node)).astype(np.int64)
    least, joined = node.copy(), []
    while True:
        np.minimum.at(least, v, cell.least[h])
        lower = cell.least.copy()
        np.minimum.at(lower, h, least[v])
        changed = np.flatnonzero(lower != cell.least)
        if not len(changed):
            break
        joined.append(np.unique(np.c_[cell.least[changed], lower[changed]], axis=0))
        cell.least = lower
    some = np.flatnonzero(links)
    joined = np.concatenate(joined) if joined else np.zeros((0, 2), np.int64)
    return _links(np.r_[node[some], joined[:, 0]], np.r_[links[some], np.zeros(len(joined), np.int64)], np.r_[least[some], joined[:, 1]])


def _links(node: np.ndarray, links: np.ndarray, joined: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(joined)], ["node", "links", "joined"])


def _left(cell: Cell):
    some = np.flatnonzero(cell.links)
    return _links(cell.node[some], cell.links[some], cell.least[some]) if len(some) else None


def trained(classes: DataFrame, n: int, width: int) -> Model:
    """A model of a sample of at most SAMPLE of n vectors, chosen by a hash of their ids. It decides costs, not results."""
    share = min(1.0, SAMPLE / 2 / max(n, 1)) if n > SAMPLE else 1.0
    some = classes.where(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).select("node", "vector").limit(SAMPLE).toArrow()
    order = np.argsort(some["node"].to_numpy())
    rows = units(matrix(some["vector"], np.float64, width))[order]
    rows = rows[np.random.default_rng(11).permutation(len(rows))]
    return Model(rows, min(LISTS, max(1, math.isqrt(n))))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept. threshold: the least cosine of a link, above 0 and below 1."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    sound = finite(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull()
    width = usual_length(rows.where(sound), "vector")
    sound = sound & (F.size("vector") == width)
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    held = rows.where(sound).mapInArrow(_packed, "id long, vector binary").withColumn("digest", F.unhex(F.sha2("vector", 256)))
    grouped = held.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.any_value("vector").alias("vector"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    if not n:
        return alone
    model = trained(classes, n, width)
    assigned = written(classes.select("node", "size", "vector").mapInArrow(lambda it: _assigned(it, model, threshold), ASSIGNED), "assigned")
    counts = {r.list: r["count"] for r in assigned.groupBy("list").count().collect()}  # at most LISTS rows
    first, parts = layout(model, counts)
    cells = int((first + parts).max())
    dealt = assigned.mapInArrow(lambda it: _dealt(it, first, parts), DEALT).repartition(min(cells, 20_000), "cell").sortWithinPartitions("cell", "side")
    met = dealt.mapInArrow(lambda it: passed_by(it, lambda t: Cell(t, model), lambda c, b: _visit(c, b, threshold), _left), "node long, links long, joined long")
    found = written(met, "links")
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    member = written(components(found, "node", "joined"), "components").withColumnRenamed("component", "root")
    least = member.join(classes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    linked = links.join(member, "node").join(least, "root").select("node", "links", "component")
    of_class = classes.join(linked, "node", "left").select("digest", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    out = held.select("id", "digest").join(of_class, "digest").select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone)
