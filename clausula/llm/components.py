"""Connected components of an edge table, by alternating large-star and small-star steps.

All steps are joins and aggregations of edges; nothing is collected but two numbers a round. The
minimum of a vertex's neighbours is folded before its shuffle, and the join back may be split by
adaptive execution, so a vertex may have any number of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.llm.shared import files_for, written

#: Edges of a file.
EDGES = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """(node, component) of every vertex of the edges: component is the smallest vertex that it reaches. files: of the edges, where their number is known to be small."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges", files=files)
    before = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == sign or not sign.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = sign
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = written(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges", files=files_for(sign.n, EDGES))
