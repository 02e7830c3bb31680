"""A corpus of conformance cases: case files, the documents they start from, and what a rule set should say about them.

A case names a base document and a patch that makes the case of it; compatibility cases name a second pair for the version before. Files are read by
Spark's own text reader, so that a corpus may lie in any store, as a table or as a stream of new files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausula.functions import documents as D

CASE = "struct<id:string,title:string,family:string,`class`:string,kind:string,base:string,ops:string,beforeBase:string,beforeOps:string,covers:array<string>,decidedBy:string,expected:struct<resultState:string,diagnostics:array<struct<code:string,pointer:string,severity:string>>,classification:string>>"


def read_texts(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """path, text of every file below a folder; a stream takes files as they come."""
    reader = (spark.readStream if stream else spark.read).option("wholetext", True).option("recursiveFileLookup", True)
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def cases(texts: DataFrame) -> DataFrame:
    """texts (path, text) as cases: path, well_formed, case_id, title, family, class, kind, base, ops, before_base, before_ops, covers, decided_by, state, diagnostics, classification. A text that is no object or has no id is not well formed."""
    c = texts.select("path", F.from_json("text", CASE).alias("c"), F.json_object_keys("text").isNotNull().alias("_o"))
    return c.select(
        "path", (F.col("_o") & F.col("c.id").isNotNull()).alias("well_formed"), F.col("c.id").alias("case_id"), "c.title", "c.family", "c.class", "c.kind", "c.base", F.coalesce("c.ops", F.lit("[]")).alias("ops"), F.col("c.beforeBase").alias("before_base"),
        F.coalesce("c.beforeOps", F.lit("[]")).alias("before_ops"), "c.covers", F.col("c.decidedBy").alias("decided_by"), F.col("c.expected.resultState").alias("state"), F.col("c.expected.diagnostics").alias("diagnostics"), F.col("c.expected.classification").alias("classification"),
    )


def listed(cases_: DataFrame, family: str | None = None, class_: str | None = None, kind: str | None = None, covers: str | None = None) -> DataFrame:
    """Cases of a family, class and kind that cover a requirement; what is not given admits all."""
    for c, v in (("family", family), ("class", class_), ("kind", kind)):
        if v is not None:
            cases_ = cases_.where(F.col(c) == v)
    return cases_ if covers is None else cases_.where(F.array_contains("covers", covers))


def materialised(cases_: DataFrame, bases: DataFrame) -> DataFrame:
    """case_id, side (after, before), text, problem of each case: its base (base, text) with its patch applied. problem: MISSING_BASE, PATCH_FAILED or null."""
    side = lambda name, base, ops: F.struct(F.lit(name).alias("side"), F.col(base).alias("base"), F.col(ops).alias("ops"))
    both = F.array_compact(F.array(side("after", "base", "ops"), F.when(F.col("before_base").isNotNull(), side("before", "before_base", "before_ops"))))
    x = cases_.where("well_formed").select("case_id", F.explode(both).alias("s")).select("case_id", "s.*")
    x = x.join(bases.select("base", F.col("text").alias("_text"), F.lit(True).alias("_has")), "base", "left").withColumn("text", D.patched("_text", "ops"))
    return x.select("case_id", "side", "text", F.when(F.col("_has").isNull(), "MISSING_BASE").when(F.col("text").isNull(), "PATCH_FAILED").alias("problem"))


def expected(cases_: DataFrame) -> DataFrame:
    """case_id, pointer, code of the findings that cases expect."""
    return cases_.where("well_formed").select("case_id", F.explode("diagnostics").alias("d")).select("case_id", "d.pointer", "d.code")
