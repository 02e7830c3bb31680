"""Exact dedup by two-pass Bloom filtering.

Pass 1 hashes every normalised text and builds a filter of the cells that two or more rows set.
Pass 2 tests each row: where one of its cells is set once only, no other row has its text, and it
passes straight through. Only the other rows (all copies, and a few false positives) shuffle, and
are resolved exactly by SHA-256 of the normalised text. Groups are folded by a partial aggregation
before the shuffle, and their result is joined back by a join that adaptive execution may split,
so one group may hold any share of the rows.

Defined results: a null text is empty; all empty or blank texts are equal. Of equal texts the one
with the most code points, then the smallest doc_id stays (a null doc_id is the last). Rows that
repeat a doc_id with an equal text: the longest of them, one of equally long ones. Other columns,
under any name, are carried and not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausula.llm import bloom
from clausula.llm.shared import apart, written

_P = "_dedup_"
SPACE = r"[\x20\x09-\x0D]+"


def text_sha256(text: Column) -> Column:
    """SHA-256 of the text without white space, lowercase hex."""
    return F.sha2(F.regexp_replace(text, SPACE, ""), 256)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.withColumns({f"{_P}id": F.col(f"`{id_col}`").cast("long"), f"{_P}sha": F.unhex(text_sha256(text)), f"{_P}chars": F.char_length(text)})


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash and length of every row, written once so that the texts are read once."""
    return written(keyed(docs, id_col, text_col).select(f"{_P}id", f"{_P}sha", f"{_P}chars"), "digests")


def resolve(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """rows (as keyed() or digests() gives them) with _dedup_keep, _dedup_size and _dedup_kept.

    of: the digests of the same rows, if rows carry more columns than these.
    """
    of = rows if of is None else of
    sha, ident, chars = F.col(f"{_P}sha"), F.col(f"{_P}id"), F.col(f"{_P}chars")
    packed = bloom.filter_of(of, sha, bloom.bits_for(of.count()), times=2)
    repeated = bloom.may_contain(rows, sha, packed)
    tested = rows.withColumn(f"{_P}maybe", repeated)
    alone = tested.where(~F.col(f"{_P}maybe")).drop(f"{_P}maybe").withColumns({f"{_P}keep": ident, f"{_P}size": F.lit(1).cast("long"), f"{_P}kept": F.lit(True)})
    maybe = tested.where(F.col(f"{_P}maybe")).drop(f"{_P}maybe")
    small = of.where(bloom.may_contain(of, sha, packed))
    first = F.struct(chars.alias("chars"), ident.isNotNull().alias("known"), F.coalesce(F.bitwise_not(ident), F.lit(0)).alias("back"))
    best = small.groupBy(f"{_P}sha").agg(F.max(first).alias("best"), F.count("*").alias(f"{_P}size")).select(
        f"{_P}sha", F.when(F.col("best.known"), F.bitwise_not("best.back")).alias(f"{_P}keep"), f"{_P}size")
    nth = F.row_number().over(Window.partitionBy(f"{_P}sha", f"{_P}id").orderBy(chars.desc()))
    shuffled = maybe.withColumn(f"{_P}nth", nth).join(best, f"{_P}sha")
    kept = (F.col(f"{_P}nth") == 1) & ident.eqNullSafe(F.col(f"{_P}keep"))
    return alone.unionByName(shuffled.withColumn(f"{_P}kept", kept).drop(f"{_P}nth"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return resolve(digests(docs, id_col, text_col)).select(
        F.col(f"{_P}id").alias("doc_id"), F.col(f"{_P}keep").alias("keep_id"), F.col(f"{_P}size").alias("group_size"),
        F.col(f"{_P}kept").alias("kept"), F.lower(F.hex(f"{_P}sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; only possibly repeated texts shuffle."""
    docs, as_they_were = apart(docs, _P)
    return as_they_were(resolve(keyed(docs, id_col, text_col), digests(docs, id_col, text_col)).where(f"{_P}kept"))
