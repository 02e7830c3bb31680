"""Hard negatives by a vector-approximation file.

Components become integers floor(scale * x), the score of two rows is their integer inner product, and higher scores come
first (ties: smaller id). For each anchor its first `positives` other rows of its label are positives; for each positive of score p
the first `negatives` rows of other labels whose score s has least * p <= 100 * s <= most * p are returned.

A block of rows is a vector-approximation file: the values of each dimension in the block are cut into 16 cells at their
quantiles, a row keeps its cell of each dimension, and cells keep the least and greatest value in them. For an anchor a table
holds the least and greatest product of each cell (of two dimensions at a time, 256 entries), so that lookups and sums give each row a
lower and an upper bound of its score, without its vector. Then
  * a positive must have an upper bound not below the k-th highest lower bound of the anchor's label, and
  * a row may enter a window if its bounds meet the window, and its upper bound is not below the k-th highest lower bound of
    the rows whose bounds lie wholly inside the window.
Only such rows are scored exactly. Bounds are of whole numbers, so nothing is lost: results equal those of all scores.

Two passes: positives are searched in blocks of one label (large labels in several), merged over the blocks; then the windows go
to all blocks. A task holds one block while anchors stream past and gives a few rows an anchor, so rows made grow with anchors
and blocks. Blocks have about 32 * sqrt(n) rows, from 1,024 to 65,536.

Defined results: rows with a null id or label, a null vector, a null, NaN or infinite component, or another length than the most
common take no part. Rows that repeat an id: the one of the smallest label, then the first vector in byte order. An anchor without
other rows of its label, or without rows in a window, has no result there; fewer rows than asked for are all returned. An integer component beyond
2^22 is an error. Other columns are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausula.llm.shared import written
from clausula.llm.vectors import blobs, finite, matrix, packed, passed_by, usual_length

CELLS, LIMIT = 16, 1 << 22


def whole(column: pa.Array, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of all components."""
    rows = np.floor(scale * matrix(packed(column), np.float64, width))
    if len(rows) and np.abs(rows).max() > LIMIT:
        raise ValueError(f"integer components go to {LIMIT} at most")
    return rows.astype(np.int32)


def _whole(batches, scale: float, width: int):
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], blobs(whole(b["vector"], scale, width))], ["id", "label", "x"])


class Block:
    """A vector-approximation file: integer rows, their cells of two dimensions at a time, and the bounds of cells."""

    def __init__(self, t: pa.Table, width: int):
        self.id, self.label = t["id"].to_numpy(), t["label"].to_numpy()
        self.x = matrix(t["x"], np.int32, width).astype(np.int64)
        padded = np.c_[self.x, np.zeros((len(self.x), width % 2), np.int64)]
        self.low, self.high = np.zeros((padded.shape[1], CELLS), np.int64), np.zeros((padded.shape[1], CELLS), np.int64)
        cells = np.empty(padded.shape, np.uint8)
        for d in range(padded.shape[1]):
            values = np.sort(padded[:, d])
            edges = values[np.arange(1, CELLS) * len(values) // CELLS]
            cells[:, d] = np.searchsorted(edges, padded[:, d], "right")
            place = np.r_[0, np.searchsorted(values, edges, "left"), len(values)]
            for c in np.flatnonzero(place[1:] > place[:-1]).tolist():
                self.low[d, c], self.high[d, c] = values[place[c]], values[place[c + 1] - 1]
        self.cells = np.ascontiguousarray((cells[:, 0::2] * CELLS + cells[:, 1::2]).T)

    def bounds(self, q: np.ndarray):
        """For each anchor of q: a lower and an upper bound of the score of each row."""
        q = np.c_[q, np.zeros((len(q), q.shape[1] % 2), np.int64)][:, :, None]
        a, b = q * self.low, q * self.high
        tables = [(t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, CELLS * CELLS) for t in (np.minimum(a, b), np.maximum(a, b))]
        for low, high in zip(*tables):
            lower, upper = low[0][self.cells[0]], high[0][self.cells[0]]
            for j in range(1, len(self.cells)):
                lower += low[j][self.cells[j]]
                upper += high[j][self.cells[j]]
            yield lower, upper

    def first(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k of scored rows."""
        order = np.lexsort((self.id[at], -scores))[:k]
        return at[order], scores[order]


def _highest(bounds: np.ndarray, k: int) -> int | None:
    """The k-th highest, or None of fewer."""
    return int(np.partition(bounds, len(bounds) - k)[len(bounds) - k]) if len(bounds) >= k else None


def _positives(block: Block, b: pa.RecordBatch, width: int, k: int):
    ids, labels, q = b["id"].to_numpy(), b["label"].to_numpy(), matrix(b["x"], np.int32, width).astype(np.int64)
    out = []
    for i, (lower, upper) in enumerate(block.bounds(q)):
        mine = (block.label == labels[i]) & (block.id != ids[i])
        least = _highest(lower[mine], k)
        at = np.flatnonzero(mine if least is None else mine & (upper >= least))
        at, scores = block.first(at, block.x[at] @ q[i], k)
        out.append((np.full(len(at), ids[i]), block.id[at], scores))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["anchor_id", "positive_id", "positive_score"])


def _negatives(block: Block, b: pa.RecordBatch, width: int, k: int, least: int, most: int):
    ids, labels, q = b["id"].to_numpy(), b["label"].to_numpy(), matrix(b["x"], np.int32, width).astype(np.int64)
    asked, out = b["scores"].to_pylist(), []
    for i, (lower, upper) in enumerate(block.bounds(q)):
        other = block.label != labels[i]
        lower, upper = 100 * lower, 100 * upper
        may = np.zeros(len(other), bool)
        for p in asked[i]:
            enters = other & (upper >= least * p) & (lower <= most * p)
            inside = lower[enters & (lower >= least * p) & (upper <= most * p)]
            floor = _highest(inside, k)
            may |= enters if floor is None else enters & (upper >= floor)
        at = np.flatnonzero(may)
        if not len(at):
            continue
        scores = block.x[at] @ q[i]
        for p in asked[i]:
            fits = (100 * scores >= least * p) & (100 * scores <= most * p)
            found, s = block.first(at[fits], scores[fits], k)
            out.append((np.full(len(found), ids[i]), np.full(len(found), p), block.id[found], s))
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["anchor_id", "positive_score", "negative_id", "negative_score"])


def block_rows(n: int) -> int:
    return min(1 << 16, max(1024, 32 * math.isqrt(n)))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: a condition on the column `id`; least and most: percent of a positive's score."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.where(finite(F.col("vector")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    width = usual_length(rows, "vector")
    packed_rows = rows.where((F.size("vector") == width) & (F.size("vector") > 0)).mapInArrow(lambda it: _whole(it, scale, width), "id long, label long, x binary")
    held = written(packed_rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("m")).select("id", "m.label", "m.x"), "rows")
    n = held.count()
    size = block_rows(n)
    none = F.array().cast("array<long>").alias("scores")
    columns = ("cell", "side", "id", "label", "x", "scores")

    labels = written(held.groupBy("label").agg(F.ceil(F.count("*") / size).cast("int").alias("parts")), "labels")
    cells = labels.agg(F.sum("parts")).first()[0] or 1
    of_label = held.join(labels, "label")
    cell = lambda part: F.xxhash64("label", part).alias("cell")
    stored = of_label.select(cell(F.pmod(F.xxhash64("id"), "parts").cast("int")), F.lit(0).alias("side"), "id", "label", "x", none)
    asking = of_label.where(is_anchor).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(cell(F.col("part")), F.lit(1).alias("side"), "id", "label", "x", none)
    met = _met(stored.unionByName(asking).select(*columns), cells).mapInArrow(lambda it: passed_by(it, lambda t: Block(t, width), lambda k, b: _positives(k, b, width, positives), most=128), "anchor_id long, positive_id long, positive_score long")
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = written(met.withColumn("nth", nth).where(F.col("nth") <= positives).drop("nth"), "positives")

    blocks = max(1, -(-n // size))
    windows = best.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))  # at most `positives` a group
    stored = held.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("cell"), F.lit(0).alias("side"), "id", "label", "x", none)
    asking = held.where(is_anchor).join(windows, F.col("id") == F.col("anchor_id")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("side", F.lit(1)).select(*columns)
    met = _met(stored.unionByName(asking).select(*columns), blocks).mapInArrow(lambda it: passed_by(it, lambda t: Block(t, width), lambda k, b: _negatives(k, b, width, negatives, least, most), most=128), "anchor_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    found = met.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return best.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _met(rows: DataFrame, cells: int) -> DataFrame:
    return rows.repartition(min(cells, 20_000), "cell").sortWithinPartitions("cell", "side")
