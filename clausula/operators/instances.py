"""Checks of record instances: presence, nulls, unknown members, defaults, unions, sequences, maps."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Field:
    name: str
    required: bool = False
    nullable: bool = True
    default: str | None = None


def members(json: Column) -> Column:
    """Names present in a JSON object; null if it is none. Tells an absent member from one that is null."""
    return F.json_object_keys(json)


def presence(df: DataFrame, json: str, field: str) -> DataFrame:
    """df with `state`: absent, null or value."""
    has = F.array_contains(members(F.col(json)), field)
    value = F.get_json_object(F.col(json), f"$.{field}")
    return df.withColumn("state", F.when(~F.coalesce(has, F.lit(False)), "absent").when(value.isNull(), "null").otherwise("value"))


def record_codes(json: Column, fields: list[Field], unknown_policy: str = "reject") -> Column:
    """Codes of a JSON record in declared order, unknown members last."""
    has = lambda f: F.coalesce(F.array_contains(members(json), f.name), F.lit(False))
    codes = []
    for f in fields:
        null = has(f) & F.get_json_object(json, f"$.{f.name}").isNull()
        codes.append(F.when(F.lit(f.required) & ~has(f), F.lit(f"MISSING_{f.name}".upper())).when(F.lit(not f.nullable) & null, F.lit(f"NULL_{f.name}".upper())))
    found = F.array_compact(F.array(*codes))
    if unknown_policy == "reject":
        return F.concat(found, F.transform(unknown_members(json, fields), lambda m: F.concat(F.lit("UNKNOWN_"), F.upper(m))))
    return found


def unknown_members(json: Column, fields: list[Field]) -> Column:
    return F.array_sort(F.array_except(F.coalesce(members(json), F.array().cast("array<string>")), F.array(*[F.lit(f.name) for f in fields])))


def prepared(df: DataFrame, json: str, fields: list[Field]) -> DataFrame:
    """A column for each field with defaults of absent members, and `unknown`: a map of the others as they came."""
    c = F.col(json)
    value = lambda f: F.when(F.array_contains(members(c), f.name), F.get_json_object(c, f"$.{f.name}")).otherwise(F.lit(f.default))
    every = F.from_json(c, "map<string,string>")
    return df.withColumns({f.name: value(f) for f in fields}).withColumn("unknown", F.map_filter(every, lambda k, _: ~k.isin(*[f.name for f in fields])))


def union_code(tag: Column, payloads: dict[str, Column]) -> Column:
    """OK, UNKNOWN_VARIANT, or PAYLOAD_MISMATCH: just the payload that the tag names is there."""
    out = F.when(~F.coalesce(tag.isin(*payloads), F.lit(False)), F.lit("UNKNOWN_VARIANT"))
    for name, payload in payloads.items():
        others = [p for n, p in payloads.items() if n != name]
        wrong = payload.isNull()
        for p in others:
            wrong |= p.isNotNull()
        out = out.when((tag == name) & wrong, F.lit("PAYLOAD_MISMATCH"))
    return out.otherwise(F.lit("OK"))


def sequence_faults(items: Column, ok) -> Column:
    """Places, from 0, of items that fail a predicate."""
    return F.filter(F.transform(items, lambda x, i: F.when(ok(x), F.lit(-1)).otherwise(i)), lambda i: i >= 0)


def map_faults(entries: Column, ok_key, ok_value) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(entries, lambda k, v: ~(ok_key(k) & F.coalesce(ok_value(v), F.lit(True))))))


def multiplicity_faults(children: DataFrame, parents: DataFrame, key: str, parent_key: str, lower: int, upper: int | None) -> DataFrame:
    """Parents whose number of children is out of bounds: parent_key, n."""
    n = children.groupBy(F.col(key).alias(parent_key)).agg(F.count("*").alias("n"))
    joined = parents.select(parent_key).join(n, parent_key, "left").select(parent_key, F.coalesce("n", F.lit(0)).alias("n"))
    bad = F.col("n") < lower
    return joined.where(bad if upper is None else bad | (F.col("n") > upper))
