"""Constraint rows compiled to column predicates, and the finding rows of their violations.

A constraint names a field, one of eleven keywords and its operands. The rows are contract data and
few, so the driver compiles them; the data are read once whatever the number of constraints.
"""

from __future__ import annotations

import dataclasses
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausula.functions import scalars as S

# Keywords and the subjects they apply to.
APPLIES = {
    "min": "ordered", "max": "ordered", "exclusiveMin": "ordered", "exclusiveMax": "ordered", "minLength": "sized", "maxLength": "sized",
    "pattern": "string", "enumValues": "scalar", "nonEmpty": "sized", "unique": "collection", "format": "string",
}
ORDERED = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz", "string")


@dataclasses.dataclass(frozen=True)
class Constraint:
    field: str
    keyword: str
    operand: Any = None
    code: str | None = None

    @property
    def diagnostic(self) -> str:
        return self.code or f"{self.field}_{self.keyword}".upper()


def subject_kind(kind: str) -> set[str]:
    """What a column of this type may be subject to."""
    base = kind.split("(")[0].split("<")[0]
    if base == "array":
        return {"collection", "sized"}
    if base == "map":
        return {"sized"}
    found = {"scalar"} | ({"ordered"} if base in ORDERED else set())
    return found | ({"string", "sized"} if base in ("string", "binary") else set())


def applies(c: Constraint, kind: str) -> bool:
    return APPLIES.get(c.keyword, "") in subject_kind(kind)


def length(c: Column, kind: str) -> Column:
    """Code points, octets, items or keys."""
    base = kind.split("<")[0]
    return {"array": F.size(c), "map": F.size(c), "binary": F.octet_length(c)}.get(base, F.char_length(c))


def holds(c: Constraint, kind: str) -> Column:
    """Whether a value meets the constraint; null for a null value."""
    x, v = F.col(f"`{c.field}`"), c.operand
    if c.keyword == "min":
        return x >= F.lit(v)
    if c.keyword == "max":
        return x <= F.lit(v)
    if c.keyword == "exclusiveMin":
        return x > F.lit(v)
    if c.keyword == "exclusiveMax":
        return x < F.lit(v)
    if c.keyword == "minLength":
        return length(x, kind) >= v
    if c.keyword == "maxLength":
        return length(x, kind) <= v
    if c.keyword == "nonEmpty":
        return length(x, kind) > 0
    if c.keyword == "pattern":
        return x.rlike(v)
    if c.keyword == "enumValues":
        return x.isin(*v)
    if c.keyword == "unique":
        return F.size(F.array_distinct(x)) == F.size(x)
    if c.keyword == "format":
        return S.matches_format(x, v)
    raise ValueError(f"no such keyword: {c.keyword}")


def compiled(df: DataFrame, rules: list[Constraint]) -> list[tuple[Constraint, Column]]:
    """Each rule with the column that is true where it is broken. A rule that does not apply is refused."""
    kinds = dict(df.dtypes)
    out = []
    for c in rules:
        if c.field not in kinds or not applies(c, kinds[c.field]):
            raise ValueError(f"CONSTRAINT_NOT_APPLICABLE: {c.keyword} on {c.field} ({kinds.get(c.field)})")
        out.append((c, F.coalesce(~holds(c, kinds[c.field]), F.lit(False))))
    return out


def findings(df: DataFrame, rules: list[Constraint], key: list[str]) -> DataFrame:
    """A row for each broken rule of each row: the key, code, field. One pass, one array a row, exploded."""
    broken = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(c.diagnostic).alias("code"), F.lit(c.field).alias("field"))) for c, bad in compiled(df, rules)]))
    return df.select(*key, F.explode(broken).alias("_f")).select(*key, "_f.code", "_f.field")


def violation_counts(df: DataFrame, rules: list[Constraint]) -> DataFrame:
    """Violations by code, folded in one pass before any shuffle; codes without one count 0."""
    sums = df.agg(*[F.count_if(bad).alias(c.diagnostic) for c, bad in compiled(df, rules)])
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, sums.columns)), F.array(*[F.col(f"`{c}`") for c in sums.columns]))).alias("code", "n"))


def admitted(df: DataFrame, rules: list[Constraint], required: list[str] = ()) -> DataFrame:
    """df with `verdict`: the first failing code in the order of the rules, nulls of required fields first, else OK."""
    nulls = [F.when(F.col(f"`{f}`").isNull(), F.lit(f"{f}_required".upper())) for f in required]
    codes = [F.when(bad, F.lit(c.diagnostic)) for c, bad in compiled(df, rules)]
    return df.withColumn("verdict", F.coalesce(*nulls, *codes, F.lit("OK")))


def effective_range(rules: DataFrame, owner: str = "owner") -> DataFrame:
    """Tightest whole-number bounds of each owner: rows owner, keyword, value -> lower, upper, empty. Exclusive bounds move by one."""
    lower = F.max(F.when(F.col("keyword") == "min", F.col("value")).when(F.col("keyword") == "exclusiveMin", F.col("value") + 1))
    upper = F.min(F.when(F.col("keyword") == "max", F.col("value")).when(F.col("keyword") == "exclusiveMax", F.col("value") - 1))
    return rules.groupBy(owner).agg(lower.alias("lower"), upper.alias("upper")).withColumn("empty", F.coalesce(F.col("lower") > F.col("upper"), F.lit(False)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
