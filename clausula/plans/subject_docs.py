"""Queries of constraint subjects and decimal policies over documents that are made from the part table; the SQL states the findings of the bad forms."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.operators import closure, subjects
from clausula.plans.tables import cut, load, spread
from clausula.sources import trees


def ix(name: str) -> str:
    return f"ix://p/{name}"


def native(name: str) -> str:
    return f"ix://kernel/{name}"


def scalar(name: str, kind: str, **more) -> dict:
    return {"identity": ix(name), "kind": "scalar", "scalar": kind, **more}


def alias(name: str, to: str, **more) -> dict:
    return {"identity": ix(name), "kind": "alias", "target": to, **more}


def record(name: str, to: str, *held: dict, **more) -> dict:
    """A record of one field with constraints."""
    return {"identity": ix(name), "kind": "record", "fields": [{"identity": ix(f"{name}/f"), "name": "f", "typeRef": to, "constraints": list(held), **more}]}


def rule(keyword: str, value=None, **more) -> dict:
    return {"keyword": keyword, **({} if value is None else {"operands": {"value": value}}), **more}


POLICY = {"decimal": {"precision": 5, "scale": 2}}
COMMON = [scalar("Text", "string"), scalar("Int", "integer"), scalar("Dec", "decimal"), alias("A1", ix("Int")), alias("A2", ix("A1")), alias("D1", ix("Dec"), **POLICY), {"identity": ix("Opt"), "kind": "option", "inner": ix("Int")}, {"identity": ix("Seq"), "kind": "sequence", "items": ix("Text")}]
#: (good types, bad types, findings of the bad ones). Types are named once in all.
FAULTS = [
    ([record("B1", ix("A2"), rule("min", "3"))], [record("B1", ix("A2"), rule("minLength", 3))], [(0, "/fields/0/constraints/0", "CONSTRAINT_NOT_APPLICABLE")]),
    ([record("B2", ix("Text"), rule("pattern", "a"))], [record("B2", ix("Opt"), rule("pattern", "a"))], [(0, "/fields/0/constraints/0", "CONSTRAINT_NOT_APPLICABLE")]),
    ([alias("B3", ix("A2"), constraints=[rule("max", "9")])], [alias("B3", ix("A2"), constraints=[rule("unique")])], [(0, "/constraints/0", "CONSTRAINT_NOT_APPLICABLE")]),
    ([record("B4", ix("Seq"), rule("unique"), rule("nonEmpty"))], [record("B4", ix("Text"), rule("unique"), rule("nonEmpty"))], [(0, "/fields/0/constraints/0", "CONSTRAINT_NOT_APPLICABLE")]),
    ([record("B5", ix("Text"), rule("min", "1", appliesTo=ix("A1")))], [record("B5", ix("Int"), rule("min", "1", appliesTo=ix("Text")))], [(0, "/fields/0/constraints/0", "CONSTRAINT_NOT_APPLICABLE")]),
    ([record("C1", ix("A2"), rule("min", "-7"))], [record("C1", ix("A2"), rule("min", 7))], [(0, "/fields/0/constraints/0/operands/value", "INVALID_OPERAND")]),
    ([record("C2", native("Integer"), rule("max", "170141183460469231731687303715884105727"))], [record("C2", native("Integer"), rule("max", "170141183460469231731687303715884105728"))], [(0, "/fields/0/constraints/0/operands/value", "INTEGER_OUTSIDE_I128")]),
    ([record("C3", ix("D1"), rule("max", "999.99"))], [record("C3", ix("D1"), rule("max", "1000"))], [(0, "/fields/0/constraints/0/operands/value", "INVALID_OPERAND")]),
    ([record("C4", native("Float64"), rule("min", 1.5))], [record("C4", native("Float64"), rule("min", "1.5"))], [(0, "/fields/0/constraints/0/operands/value", "INVALID_OPERAND")]),
    ([record("C5", native("Float32"), rule("min", 0.5))], [record("C5", native("Float32"), rule("min", 0.1))], [(0, "/fields/0/constraints/0/operands/value", "INVALID_OPERAND")]),
    ([record("E1", native("Clock"), rule("min", "1/3"))], [record("E1", native("Clock"), rule("min", "-1/3"), rule("exclusiveMin", "1"))], [(0, "/fields/0/constraints/0/operands/value", "INVALID_OPERAND"), (0, "/fields/0/constraints/1/keyword", "CONSTRAINT_NOT_APPLICABLE")]),
    ([record("E2", native("unit/m"), rule("max", "-2/3"))], [record("E2", native("unit/m"), rule("max", "2/4"))], [(0, "/fields/0/constraints/0/operands/value", "INVALID_OPERAND")]),
    ([alias("G1", ix("Dec"), **POLICY), record("G2", ix("G1"))], [alias("G1", ix("Dec")), record("G2", ix("G1"))], [(0, "", "DECIMAL_POLICY_MISSING"), (1, "/fields/0", "DECIMAL_POLICY_MISSING")]),
    ([record("G3", native("Decimal"), **POLICY)], [record("G3", ix("D1"), **POLICY)], [(0, "/fields/0", "DECIMAL_POLICY_CONFLICT")]),
    ([record("G4", ix("A2"))], [record("G4", ix("A2"), **POLICY)], [(0, "/fields/0", "DECIMAL_POLICY_CONFLICT")]),
    ([alias("G5", ix("D1")), alias("G6", ix("G5"))], [alias("G5", ix("G6")), alias("G6", ix("G5"), **POLICY)], []),
]


def condition(n: int) -> str:
    return f"(p_partkey * {n + 2} + p_size) % {7 + n % 6} = 1"


def documents(parts: DataFrame) -> DataFrame:
    join = lambda values: ",".join(json.dumps(v, separators=(",", ":")) for v in values)
    body = F.concat_ws(",", F.lit(join(COMMON)), *[F.when(F.expr(condition(n)), F.lit(join(bad))).otherwise(F.lit(join(good))) for n, (good, bad, _) in enumerate(FAULTS)])
    return parts.select(F.col("p_partkey").cast("string").alias("doc_id"), F.concat(F.lit('{"ir":{"types":['), body, F.lit("]}}")).alias("text"))


def subject_findings(spark, sf) -> DataFrame:
    return subjects.findings(cut(trees.entries(documents(spread(load(spark, sf, "part"))), "types"), "subject-tree")).select("doc_id", "pointer", "code")


def carried_values(spark, sf) -> DataFrame:
    """Of all orders: a chain to the order of half the key; every seventh order has a value. Where each ends, how many values lie on it, and the nearest."""
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("node")).distinct()
    refs = o.where("node > 3").select(F.col("node").alias("src"), F.expr("node div 2").alias("dst"))
    values = o.where("node % 7 = 0").select("node", (F.col("node") * 10).alias("value"))
    return closure.carried(refs, values, o)


def _findings_sql() -> str:
    at, rows = len(COMMON), []
    for n, (good, _, found) in enumerate(FAULTS):
        rows += [f"SELECT CAST(p_partkey AS VARCHAR) AS doc_id, '/ir/types/{at + k}{rest}' AS pointer, '{code}' AS code FROM part WHERE {condition(n)}" for k, rest, code in found]
        at += len(good)
    rows.append("SELECT CAST(p_partkey AS VARCHAR), '/ir/types/2', 'NONE' FROM part WHERE false")
    return " UNION ALL ".join(rows)


QUERIES: dict[str, Callable] = {f.__name__: f for f in (subject_findings, carried_values)}
SQL: dict[str, str] = {
    "subject_findings": _findings_sql(),
    "carried_values": """
WITH RECURSIVE o AS (SELECT DISTINCT o_orderkey AS node FROM orders),
w(node, place, step) AS (
  SELECT node, node, 0 FROM o
  UNION ALL SELECT w.node, w.place // 2, step + 1 FROM w JOIN o ON o.node = w.place WHERE w.place > 3),
e AS (SELECT node, arg_max(place, step) AS last, count(*) FILTER (WHERE place % 7 = 0 AND place IN (SELECT node FROM o)) AS n, arg_min(place, step) FILTER (WHERE place % 7 = 0 AND place IN (SELECT node FROM o)) AS near FROM w GROUP BY node)
SELECT node, CASE WHEN last <= 3 AND last IN (SELECT node FROM o) THEN last END AS terminal, n, near * 10 AS "first" FROM e""",
}
