"""Vector codes of 16 codebook indexes, by partial-distance search.

Components become integers floor(scale * x), and vectors are cut into PARTS equal consecutive parts. Each part position's
codebook starts as that part of the first ENTRIES rows in order of id. A round assigns every part to the nearest entry (squared
Euclidean distance, ties to the lower index) and replaces each entry by its parts' componentwise floor of the mean; an entry
without parts stays. After the rounds all parts are assigned once more.

Partial-distance search: dimensions come in order of descending variance of the codebook. After the first, the entry of
the least partial distance is completed: the current best complete distance. Then, a dimension at a time, entries are masked
out whose accumulated distance strictly exceeds the best, the rest are accumulated, and the most promising one is completed to lower the
best. All distances are whole numbers, so ties and results equal those of a full search.

Rows are packed once; each round is one scan that adds up sums and counts within a task, of which PARTS * ENTRIES rows a task shuffle.
The driver holds the codebooks alone. Sums by label are folded before their shuffle.

Defined results: one row per kept row. Rows with a null vector or a null, NaN or infinite component are dropped, and those of another
length than the most common, or of length 0. A null id stays and comes last in order of id; rows that repeat an id all
stay, ordered by their vectors' bytes. With fewer than ENTRIES rows codebooks have as many entries as rows. A most common length that PARTS does not divide
and an integer component beyond 2^22 are errors. Other columns are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.llm.hard_negatives import whole
from clausula.llm.shared import written
from clausula.llm.vectors import blobs, finite, matrix, usual_length

PARTS, ENTRIES, ROWS = 16, 64, 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of its nearest entry and the squared distance, by partial-distance search."""
    order = np.argsort(-book.var(0), kind="stable")
    accumulated = (x[:, None, order[0]] - book[None, :, order[0]]) ** 2
    guess = accumulated.argmin(1)
    best = ((x - book[guess]) ** 2).sum(1)
    row, entry = np.nonzero(accumulated <= best[:, None])
    accumulated = accumulated[row, entry]
    for i, d in enumerate(order[1:].tolist(), 2):
        accumulated += (x[row, d] - book[entry, d]) ** 2
        alive = accumulated <= best[row]
        row, entry, accumulated = row[alive], entry[alive], accumulated[alive]
        if i < len(order):
            guess = entry[_least(row, accumulated)]
            best = np.minimum(best, ((x - book[guess]) ** 2).sum(1))
    at = _least(row, accumulated)
    return entry[at], accumulated[at]


def _least(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Of each row (rows ascend and none is missing) the place of its first least value."""
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(value, start)
    at = np.flatnonzero(value == least[row])
    return at[np.r_[True, row[at[1:]] != row[at[:-1]]]]


def _blocks(batches, width: int):
    """Slices of batches with their rows as (rows, parts, components)."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            yield part, matrix(part["x"], np.int32, width).astype(np.int64).reshape(part.num_rows, PARTS, -1)


def _sums(batches, width: int, books: np.ndarray):
    """Counts and sums of the parts that each entry is nearest to: a row an entry that has some."""
    count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for _, x in _blocks(batches, width):
        for p in range(PARTS):
            entry, _ = nearest(x[:, p], books[p])
            count[p] += np.bincount(entry, minlength=books.shape[1])
            np.add.at(total[p], entry, x[:, p])
    part, entry = np.nonzero(count)
    if len(part):
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), *(pa.array(total[part, entry, d]) for d in range(books.shape[2]))], ["part", "entry", "n", *(f"s{d}" for d in range(books.shape[2]))])


def _coded(batches, width: int, books: np.ndarray):
    for b, x in _blocks(batches, width):
        code, error = np.empty((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
        for p in range(PARTS):
            code[:, p], distance = nearest(x[:, p], books[p])
            error += distance
        hexes = code.tobytes().hex()
        yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array([hexes[i : i + 2 * PARTS] for i in range(0, len(hexes), 2 * PARTS)], pa.string()), pa.array(error)], ["id", "label", "code", "error"])


def _whole(batches, scale: float, width: int):
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], blobs(whole(b["vector"], scale, width))], ["id", "label", "x"])


def codebooks(rows: DataFrame, width: int, rounds: int) -> np.ndarray:
    """(parts, entries, components) after the rounds; rows: id, label, x."""
    first = rows.orderBy(F.asc_nulls_last("id"), "x").select("x").limit(ENTRIES).toArrow()
    books = matrix(first["x"], np.int32, width).astype(np.int64).reshape(-1, PARTS, width // PARTS).transpose(1, 0, 2).copy()
    components = [f"s{d}" for d in range(width // PARTS)]
    for _ in range(rounds):
        now = books.copy()
        found = rows.select("x").mapInArrow(lambda it: _sums(it, width, now), ", ".join(f"{c} long" for c in ["part", "entry", "n", *components]))
        for r in found.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *components])).collect():  # a row an entry
            books[r.part, r.entry] = [r[c] // r.n for c in components]
    return books


def digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def part_codes(vectors: DataFrame, rounds: int = 2, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    label = F.col(f"`{label_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.where(finite(F.col("vector")) & (F.size("vector") > 0))
    width = usual_length(rows, "vector")
    if width % PARTS:
        raise ValueError(f"{PARTS} parts do not divide {width} components")
    if not width:
        return rows.where(F.lit(False)).select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    label_type = rows.schema["label"].dataType.simpleString()
    held = written(rows.where(F.size("vector") == width).mapInArrow(lambda it: _whole(it, scale, width), f"id long, label {label_type}, x binary"), "rows")
    books = codebooks(held, width, rounds)
    coded = written(held.mapInArrow(lambda it: _coded(it, width, books), f"id long, label {label_type}, code string, error long"), "coded")
    of_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
