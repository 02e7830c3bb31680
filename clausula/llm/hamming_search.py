"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is one bit a dimension (positive or not), 64 bits in 4 segments of 16. A block of
the index holds up to BLOCK distinct codes and, for each segment, the codes in order of the
segment's value. A query looks up all values of segment j within radius r of its own, one (r, j)
after the other, and verifies whole codes. After radius r in the segments 0 to j, an unseen code
differs in at least 4 r + j + 1 bits: the search stops once the k-th verified distance is at most
4 r + j, when the k nearest, ties included, are surely among those seen. Radii grow to 16 if need
be, so nothing is capped. The result equals a search of all codes.

Equal codes are one entry with their k + 1 smallest ids, of which each partition keeps as many
before the shuffle; a common vector costs no more than others. Each block is held by a task while
queries stream past it; a block gives k + 1 rows a query, and these are ranked over the blocks.

Defined results: neighbours of a query are other ids, nearest first, then smallest id; fewer than k
if there are fewer. A null id or null vector is left out; neither null elements nor NaN are positive; missing
dimensions are zero bits; a vector of more than 64 is an error. Rows that repeat an id: the one with
the smallest code. Other columns are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausula.llm.near_dedup import _runs
from clausula.llm.shared import written

BLOCK, QUERIES, SEGMENTS, WIDTH = 1 << 20, 256, 4, 16
_POPULATION = np.array([bin(x).count("1") for x in range(1 << WIDTH)])
#: All masks of 16 bits by the number of bits set.
MASKS = [np.flatnonzero(_POPULATION == r) for r in range(WIDTH + 1)]


def _codes(batches):
    for b in batches:
        out = []
        for v in b["vector"].to_pylist():
            bits = np.zeros(64, np.uint8)
            if len(v) > 64:
                raise ValueError(f"a vector of {len(v)} dimensions: codes have 64")
            v = [x is not None and x > 0 for x in v]
            bits[: len(v)] = v
            out.append(int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True))
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(out, pa.int64())], ["id", "code"])


def codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    return rows.mapInArrow(_codes, "id long, code long").groupBy("id").agg(F.min("code").alias("code"))


class Index:
    """One block: distinct codes, with the codes of each segment value."""

    def __init__(self, block: np.ndarray):
        self.codes = block
        self.order, self.starts = [], []
        for j in range(SEGMENTS):
            value = (block >> np.uint64(WIDTH * j)).astype(np.int64) & 0xFFFF
            self.order.append(np.argsort(value, kind="stable"))
            self.starts.append(np.searchsorted(value[self.order[-1]], np.arange((1 << WIDTH) + 1)))

    def search(self, code: np.uint64, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of codes that hold, with `sizes` ids each, at least the k nearest ids, by distance."""
        seen = np.zeros(len(self.codes), bool)
        held = np.zeros(65, np.int64)  # ids by distance
        places, distances = [], []
        for r in range(WIDTH + 1):
            for j in range(SEGMENTS):
                value = (int(code) >> (WIDTH * j) & 0xFFFF) ^ MASKS[r]
                lo, n = self.starts[j][value], self.starts[j][value + 1] - self.starts[j][value]
                some = n > 0
                lo, n = lo[some], n[some]
                if len(n):
                    at = self.order[j][np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                    at = at[~seen[at]]
                    seen[at] = True
                    d = np.bitwise_count(self.codes[at] ^ code).astype(np.int64)
                    places.append(at)
                    distances.append(d)
                    held += np.bincount(d, sizes[at], 65).astype(np.int64)
                if held[: SEGMENTS * r + j + 1].sum() >= k:
                    return self._first(places, distances, sizes, held, k)
        return self._first(places, distances, sizes, held, k)

    @staticmethod
    def _first(places, distances, sizes, held, k):
        at, d = (np.concatenate(places), np.concatenate(distances)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        enough = int(np.searchsorted(np.cumsum(held), k))  # the distance at which k ids are reached
        near = d <= enough
        return at[near], d[near]


def _search(batches, k: int):
    """In rows sorted by block, salt and side (0: the block's codes, 1: queries): k + 1 nearest ids of each query in the block."""
    for t in _runs(batches, "cell"):
        side, code = t["side"].to_numpy(), t["code"].to_numpy().view(np.uint64)
        own = np.flatnonzero(side == 0)
        ids = [t["ids"][int(i)].as_py() for i in own]
        index, sizes = Index(code[own]), np.array([len(x) for x in ids], np.int64)
        for q in np.flatnonzero(side == 1):
            at, d = index.search(code[q], sizes, k + 1)
            best = sorted((int(n), i) for p, n in zip(at.tolist(), d.tolist()) for i in ids[p])[: k + 1]
            if best:
                yield pa.RecordBatch.from_pydict({"code": pa.array([int(t["code"][int(q)].as_py())] * len(best)), "distance": pa.array([n for n, _ in best], pa.int32()), "vec_id": pa.array([i for _, i in best], pa.int64())})


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, distance. is_query: a condition on the column `id`."""
    coded = written(codes(vectors, id_col, vector_col), "codes")
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    classes = written(coded.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    blocks = max(1, -(-classes.count() // BLOCK))
    queries = coded.where(is_query).select("code").distinct()
    salts = max(1, min(10_000, -(-queries.count() // QUERIES)))
    block, every = F.pmod(F.xxhash64("code", F.lit(2)), F.lit(blocks)), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("block") * 10_000 + F.col("salt")).alias("cell")
    held = classes.withColumns({"block": block, "salt": every(salts)}).select(cell, F.lit(0).alias("side"), "code", "ids")
    asked = queries.withColumns({"salt": F.pmod(F.xxhash64("code", F.lit(3)), F.lit(salts)), "block": every(blocks)}).select(cell, F.lit(1).alias("side"), "code", F.array().cast("array<long>").alias("ids"))
    near = held.unionByName(asked).repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(lambda it: _search(it, k), "code long, distance int, vec_id long")
    order = Window.partitionBy("code").orderBy("distance", "vec_id")
    best = written(near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1), "nearest")
    found = coded.where(is_query).select(F.col("id").alias("query_id"), "code").join(best, "code").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("nth"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
