"""Best-fit packing of token sequences by minimum bin slack.

Each document's ids (and an end id) are cut into pieces of at most `capacity` tokens; only the
first piece may be shorter. Pieces of one length are alike, so bins are found on the counts by
length (at most `capacity` numbers, whatever the corpus): the longest open length is placed, a
bitset subset-sum over the other open lengths finds the fullest completion, and that combination is
taken as often as the counts allow, then removed. Each combination uses up at least one length's
last copies, so there are few of them, and their table is small.

Pieces then get their place by number: pieces of one length are numbered within hashed slices
(as many as its count asks for), the slices' counts are added up, and number r of a length belongs to one combination, bin and offset.
A length may hold any share of all pieces; no step gathers a length in one task.

Defined results: a null or empty text is the end id alone. A null doc_id and repeated rows are
documents of their own (equal rows get places of their own). Other columns are not looked at. An
empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausula.llm.shared import id_text, tidy, written
from clausula.llm.tokens import encoder

#: Pieces of one length that one task numbers; a length has as many slices as its count asks for.
SLICE = 100_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, within their counts, of the largest sum that is at most room: subset sums as bits of one integer."""
    if room <= 0:
        return []
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:  # copies in parts of 1, 2, 4, ..., so that every number of copies is a sum of parts
            part = min(part, left)
            before = reach
            reach |= (reach << (part * length)) & mask
            if reach != before:
                steps.append((length, part, before))
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            out += [length] * part
            total -= part * length
    return out


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), using up all counts."""
    left, out = {k: int(v) for k, v in counts.items() if v}, []
    while left:
        top = max(left)
        left[top] -= 1
        bin_ = [top, *fullest({k: v for k, v in left.items() if v}, capacity - top)]
        left[top] += 1
        need = {k: bin_.count(k) for k in set(bin_)}
        times = min(left[k] // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((bin_, times))
    return out


def allocation(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first number, copies a bin, first bin, offset of the first copy; one entry a combination."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, times in bins:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            n = lengths.count(length)
            rows.setdefault(length, []).append((used.get(length, 0), n, base, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        base += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in rows.items()}


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, with_ids: bool = False, cache_bytes: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of docs (doc_id, text)."""

    @tidy
    def rows(batches):
        encode, end = encoder(path, cache_bytes).encode_all, np.array([end_id], "<u4").tobytes()
        for b in batches:
            texts = zip(b["doc_id"].to_pylist(), encode(b["text"]))
            while some := list(itertools.islice(texts, 256)):
                out = []
                for doc, ids in some:
                    raw = ids + end
                    out += [(doc, k, s, n, zlib.crc32(x := raw[4 * s : 4 * (s + n)]), x if with_ids else None) for k, (s, n) in enumerate(cut(len(raw) // 4, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    out = docs.mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32), written, with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    held = spark.sparkContext.broadcast(allocation(combinations(counts, capacity)))
    slices = spark.createDataFrame([(n, -(-c // SLICE)) for n, c in counts.items()], "length long, slices long")  # at most capacity rows
    hashed = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("slices"))
    sliced = pieces.join(F.broadcast(slices), "length").withColumn("slice", hashed).drop("slices")
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("length", "slice").count().select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32"))
    numbered = sliced.withColumn("nth", nth).join(starts, ["length", "slice"]).withColumn("number", F.col("first") + F.col("nth") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def at(length, number):
        ln, r = length.to_numpy(), number.to_numpy()
        seq, off = np.empty(len(ln), np.int64), np.empty(len(ln), np.int64)
        for k in np.unique(ln):
            w = np.flatnonzero(ln == k)
            first, copies, base, offset = held.value[int(k)]
            c = np.searchsorted(first, r[w], side="right") - 1
            rest = r[w] - first[c]
            seq[w], off[w] = base[c] + rest // copies[c], offset[c] + rest % copies[c] * k
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    put = numbered.withColumn("at", at("length", "number"))
    return put.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


def packed(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, cache_bytes: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. cache_bytes: as for `encoder`."""
    pieces = token_pieces(id_text(docs), path, end_id, capacity, cache_bytes=cache_bytes)
    return place(written(pieces, "pieces"), capacity)


def packed_sequences(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """The packed ids themselves: sequence_id, ids (little-endian unsigned 32-bit), doc_ids. A sequence is at most capacity ids."""
    pieces = written(token_pieces(id_text(docs), path, end_id, capacity, with_ids=True), "pieces")
    put = place(pieces.drop("ids"), capacity)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    named = put.select(*[F.col(c).alias(f"put_{c}") for c in key], "sequence_id", "offset")
    same = [F.col(c).eqNullSafe(F.col(f"put_{c}")) for c in key]
    whole = pieces.join(named, same).dropDuplicates(["sequence_id", "offset"])  # equal rows meet each other's places
    return whole.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts")).select("sequence_id", F.expr("aggregate(parts, cast('' AS binary), (s, x) -> concat(s, x.ids))").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
