"""Relations that rules are made of: repeats, references, first declarations, owners, sets, bounds, coverage. Keys may be any columns; a null key equals no other but in sets.

Each is one shuffle on its keys at most. Repeats rank rows of one key, so a key with very many rows is one sorted group; what needs no
rank (first declarations, owners, counts) is folded before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeats(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of each key but the first in order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth > 1").drop("_nth")


def repeat_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that repeat and how often they do after the first: no rank and no order needed."""
    return rows.groupBy(*keys).agg((F.count("*") - 1).alias("repeats")).where("repeats > 0")


def unresolved(references: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """References whose keys nothing declares."""
    return references.join(declared.select(*keys), keys, "left_anti")


def resolved(references: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """References whose keys something declares, each once however often that is."""
    return references.join(declared.select(*keys), keys, "left_semi")


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of each key the first row by columns, which come before the others in a comparison of rows."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    found = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return found.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)])


def shared_members(rows: DataFrame, member: list[str], owner: str) -> DataFrame:
    """Members with more than one owner, and how many."""
    return rows.groupBy(*member).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def union_of(*sets: DataFrame) -> DataFrame:
    """Everything in any of the sets, once."""
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def common_to(a: DataFrame, b: DataFrame) -> DataFrame:
    """What both sets have, once."""
    return a.intersect(b)


def outside_bounds(rows: DataFrame, bounds: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value lies outside what their key's row of bounds (key, lower, upper) admits; a null upper admits all. Both bounds come along."""
    x = rows.join(bounds.select(key, "lower", "upper"), key)
    return x.where((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))


def coverage(rows: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """Of each key how many rows meet each condition, and how many there are."""
    return rows.groupBy(*keys).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()], F.count("*").alias("total"))


def score(counts: DataFrame, met: str, digits: int = 9) -> DataFrame:
    """counts with the share of one condition."""
    return counts.withColumn("score", F.round(F.col(met) / F.col("total"), digits))
