"""Declared transformations of a mapping: eight kinds, each with the members it must name, and their execution.

A declaration is checked before it runs; a kind that leaves out rows, columns or precision must say so.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The members that each kind must name.
OBLIGED = {
    "codec": ("encoding", "decodePolicy"),
    "lens": ("getPutLaws", "conflictPolicy"),
    "projection": ("selectedIdentities", "preservation"),
    "extraction": ("sourceLoci", "preservation"),
    "rendering": ("presentationMediaType", "preservation"),
    "aggregation": ("groupingKeys", "window", "ordering", "lateDataPolicy", "aggregateSemantics"),
    "enrichment": ("provenanceSources",),
    "materialization": ("lifetime",),
}


def declaration_faults(mappings: DataFrame) -> DataFrame:
    """mapping, code, member of declarations (mapping, kind, members: array, effectful, lossy) that lack what they must name."""
    obliged = F.create_map(*[x for k, v in OBLIGED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    need = F.coalesce(obliged[F.col("kind")], F.array().cast("array<string>"))
    need = F.concat(need, F.when(F.col("effectful"), F.array(F.lit("provenanceSources"))).otherwise(F.array().cast("array<string>")), F.when(F.col("lossy"), F.array(F.lit("omittedIdentities"))).otherwise(F.array().cast("array<string>")))
    lacking = mappings.select("mapping", F.explode(F.array_except(need, "members")).alias("member"))
    unknown = mappings.where(~F.col("kind").isin(*OBLIGED)).select("mapping", F.lit("UNKNOWN_KIND").alias("code"), F.col("kind").alias("member"))
    return lacking.select("mapping", F.lit("SCHEMA_VIOLATION").alias("code"), "member").unionByName(unknown)


def unknown_targets(mappings: DataFrame, declared: DataFrame) -> DataFrame:
    """Mappings (mapping, target) whose target (identity) is not declared."""
    return mappings.join(declared.select(F.col("identity").alias("target")).distinct(), "target", "left_anti").select("mapping", F.lit("UNKNOWN_MAPPING_TARGET").alias("code"), F.col("target").alias("member"))


def undeclared_losses(exports: DataFrame, realised: DataFrame, omitted: DataFrame) -> DataFrame:
    """Exports (mapping, identity) that a mapping neither realises nor says it omits."""
    key = ["mapping", "identity"]
    return exports.join(realised.select(*key), key, "left_anti").join(omitted.select(*key), key, "left_anti").select("mapping", F.lit("UNDECLARED_LOSS").alias("code"), F.col("identity").alias("member"))


def unknown_extensions(required: DataFrame, admitted: DataFrame, policy: str = "reject") -> DataFrame:
    """Required extensions (doc_id, name) that a rejecting consumer (name) does not admit."""
    lost = required.join(admitted.select("name").distinct(), "name", "left_anti")
    return lost.where(F.lit(policy == "reject")).select("doc_id", F.lit("UNKNOWN_REQUIRED_EXTENSION").alias("code"), F.col("name").alias("member"))


# Execution


def encode(df: DataFrame, key: list[str]) -> DataFrame:
    """Codec: the other columns as JSON text, members in name order."""
    rest = sorted(c for c in df.columns if c not in key)
    return df.select(*key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("encoded"))


def decode(df: DataFrame, schema: str, strict: bool = True) -> DataFrame:
    """The columns back; strict refuses a text that does not parse, else it gives nulls."""
    value = F.from_json("encoded", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return df.select(*[c for c in df.columns if c != "encoded"], value.alias("v")).select(*[c for c in df.columns if c != "encoded"], "v.*")


def put(source: DataFrame, view: DataFrame, key: list[str], conflict: str = "view") -> DataFrame:
    """Lens: changes of a view of some columns put back into its source; rows not in the view stay. conflict: whose value stands where both differ."""
    shown = [c for c in view.columns if c not in key]
    v = view.select(*key, *[F.col(c).alias(f"_v_{c}") for c in shown], F.lit(True).alias("_in"))
    new = {c: F.when(F.col("_in") & F.lit(conflict == "view"), F.col(f"_v_{c}")).otherwise(F.col(c)) for c in shown}
    return source.join(v, key, "left").withColumns(new).select(*source.columns)


def project(df: DataFrame, selected: list[str], preserve: bool = False) -> DataFrame:
    """Projection: the selected columns; preserved others go along as a map of texts."""
    rest = [c for c in df.columns if c not in selected]
    if not preserve:
        return df.select(*selected)
    return df.select(*selected, F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]).alias("preserved"))


def render(df: DataFrame, template: str) -> Column:
    """Rendering: {column} in a template replaced by the column's text."""
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(head), F.col(name).cast("string")]
    return F.concat(*parts, F.lit(rest))


def enrich(df: DataFrame, source: DataFrame, on: list[str], name: str) -> DataFrame:
    """Enrichment: a source's columns joined on, and `provenance`: its name where it had the row. Which side is broadcast is left to its size."""
    s = source.withColumn("_from", F.lit(name))
    return df.join(s, on, "left").withColumn("provenance", F.col("_from")).drop("_from")


@dataclasses.dataclass
class Materialized:
    path: str

    def write(self, df: DataFrame, by: list[str] | None = None) -> None:
        (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(self.path)
