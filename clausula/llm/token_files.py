"""Token ids of documents in files: blocks of Simple-8b words in ascending doc_id order.

Documents are dealt by ranges of doc_id and sorted, then encoded and written in blocks of whole
documents of BLOCK_IDS ids or more. A file is one Spark partition's blocks, a Parquet table with a
row a block (part, block, first_id: ids of the part before it, docs: (doc_id, n_ids) of its
documents, payload: simple8b.encode of all its ids), so that Spark's committer keeps files whole
when an executor is lost. Parts follow each other in doc_id order; a reader adds up the parts' ids.

Defined results: a null or empty text is the end id alone. A null doc_id comes first. Rows that
repeat a doc_id follow each other by text. Other columns are not looked at. An empty table writes
no block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausula.llm import simple8b
from clausula.llm.shared import id_text, scratch
from clausula.llm.tokens import encoder

BLOCK_IDS = 1 << 16
SCHEMA = "part int, block int, first_id long, n_ids long, docs array<struct<doc_id:long,n_ids:long>>, payload binary"


def write_tokens(docs: DataFrame, tokenizer: str, out: str, end_id: int = 1) -> None:
    """Write the files of docs under a new folder."""
    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches):
        encode, end = encoder(tokenizer).encode_all, np.array([end_id], "<u4").tobytes()
        part, block, before, n, held, names, lengths = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def out():
            ids = np.frombuffer(b"".join(held), "<u4")
            d = pa.array([{"doc_id": i, "n_ids": n} for i, n in zip(names, lengths)], pa.struct([("doc_id", pa.int64()), ("n_ids", pa.int64())]))
            listed = pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), d)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before]), pa.array([len(ids)]), listed, pa.array([simple8b.encode(ids)], pa.binary())], ["part", "block", "first_id", "n_ids", "docs", "payload"])

        for b in batches:
            for doc, ids in zip(b["doc_id"].to_pylist(), encode(b["text"])):
                held += ids, end
                names.append(doc)
                lengths.append(len(ids) // 4 + 1)
                n += lengths[-1]
                if n >= BLOCK_IDS:
                    yield out()
                    block, before, n, held, names, lengths = block + 1, before + n, 0, [], [], []
        if held:
            yield out()

    ordered.mapInArrow(blocks, SCHEMA).write.option("compression", "none").parquet(out)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (and ids, little-endian unsigned 32-bit)."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one number a file
    starts = np.r_[0, np.cumsum([n for _, n in sizes])].tolist()
    held = spark.sparkContext.broadcast(dict(zip([p for p, _ in sizes], starts)))

    def rows(batches):
        for b in batches:
            for part, first, docs, payload in zip(b["part"].to_pylist(), b["first_id"].to_pylist(), b["docs"].to_pylist(), b["payload"].to_pylist()):
                raw = simple8b.decode(payload).astype("<u4").tobytes()
                n = np.array([d["n_ids"] for d in docs], np.int64)
                at = np.r_[0, np.cumsum(n)]
                texts = [raw[4 * i : 4 * j] for i, j in zip(at.tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in docs], pa.int64()), pa.array(at[:-1] + first + held.value[part]), pa.array(n), pa.array(list(map(zlib.crc32, texts)), pa.int64()), pa.array(texts if with_ids else [None] * len(docs), pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    out = files.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write docs to a new folder of the shared one and read the files back."""
    out = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, out, end_id)
    return read_tokens(docs.sparkSession, out)
