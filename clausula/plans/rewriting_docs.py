"""Queries of rewritten documents: normal forms, residues and comparisons of contracts that are made from the part table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.operators import rewriting
from clausula.plans.tables import cut, load
from clausula.sources import trees

#: Members of a record that rules of change look at; the rest is residue.
MODELLED = ("identity", "kind", "fields", "origin")
#: Spellings of nullable and what they mean, by part: true alone is true.
NULLABLE = ["true", "false", "null", "1", '"true"', "[]", '{"a":1}', None]


def _text(order: bool) -> str:
    """SQL (of both engines) of a part's document, its members in one order or another."""
    nullable = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{'' if v is None else f',"nullable":{v}'}'" for i, v in enumerate(NULLABLE)) + " END"
    number = "CASE p_size % 4 WHEN 0 THEN '1.50' WHEN 1 THEN '1e2' WHEN 2 THEN '-0' ELSE '10' END"
    field = f"""'{{"name":"x"' || {nullable} || ',"origin":{{"line":' || p_size || '}}}}'"""
    note = "CASE WHEN p_partkey % 6 = 0 THEN 'other' ELSE 'same' END" if order else "'same'"
    parts = [f"""'"identity":"ix://p/' || p_partkey || '"'""", """'"kind":"record"'""", f"""'"fields":[' || {field} || ',null]'""", f"""'"origin":{{"path":"{'b' if order else 'a'}"}}'""", f"""'"weight":' || {number}""", f"""'"note":"q\\"' || {note} || '\\u0001é"'"""]
    parts = parts[::-1] if order else parts
    return "'{\"ir\":{\"types\":[{' || " + " || ',' || ".join(parts) + """ || '}],"zeta":[],"alpha":{}}}'"""


def _tree(spark, sf, order: bool) -> DataFrame:
    sql = _text(order).replace("\\", "\\\\")  # Spark's string literals read backslashes
    docs = load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.expr(sql).alias("text"))
    return cut(trees.nodes(docs), "rewriting-tree")


def normal_forms(spark, sf) -> DataFrame:
    return rewriting.normalised(_tree(spark, sf, True))


def residues(spark, sf) -> DataFrame:
    return rewriting.residue(_tree(spark, sf, True), "ir.types.*", MODELLED)


def same_in_normal_form(spark, sf) -> DataFrame:
    """Documents of other order and origins are the same; those with another note are not."""
    return rewriting.compared(_tree(spark, sf, False), _tree(spark, sf, True))


QUERIES: dict[str, Callable] = {f.__name__: f for f in (normal_forms, residues, same_in_normal_form)}
_DOC = "CAST(p_partkey AS VARCHAR) AS doc_id"
_NUMBER = "CASE p_size % 4 WHEN 0 THEN '1.5' WHEN 1 THEN '100' WHEN 2 THEN '0' ELSE '10' END"
_NOTE = "CASE WHEN p_partkey % 6 = 0 THEN 'other' ELSE 'same' END"
_REST = f"""'"note":"q\\"' || {_NOTE} || '\\u0001é"'"""
SQL: dict[str, str] = {
    "normal_forms": f"""SELECT {_DOC}, '{{"ir":{{"alpha":{{}},"canonicalization":{{"algorithm":"rfc8785-v1"}},"types":[{{"fields":[{{"name":"x","nullable":' || CASE WHEN p_partkey % 8 = 0 THEN 'true' ELSE 'false' END || ',"origin":{{"line":' || p_size || '}}}},null],"identity":"ix://p/' || p_partkey || '","kind":"record",' || {_REST} || ',"origin":{{"path":"b"}},"weight":' || {_NUMBER} || '}}],"zeta":[]}}}}' AS text FROM part""",
    "residues": f"""SELECT {_DOC}, '/ir/types/0' AS pointer, '{{' || {_REST} || ',"weight":' || {_NUMBER} || '}}' AS text FROM part""",
    "same_in_normal_form": f"SELECT {_DOC}, p_partkey % 6 <> 0 AS same FROM part",
}
