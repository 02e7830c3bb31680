"""Queries of the JSON Schema source over bundles that are made from the part table.

Each part is a bundle of two files: Item, an object of three properties, and Kind, an enumeration. The part's columns choose each
property's form among FORMS and the faults of the files. What a form means is stated beside it, and the SQL reads it from there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.operators import rules
from clausula.plans.tables import cut, load, spread
from clausula.sources import bundles, json_schema, trees


@dataclass
class Form:
    """A property's schema and what it becomes. In types and variants a name that starts with + stands below the property's own name."""

    text: str
    types: list[tuple[str, str, str | None]] = field(default_factory=list)  # name, kind, scalar
    variants: list[tuple[str, str, str | None]] = field(default_factory=list)  # name, owner, payload; in order
    ref: str = "+"
    lower: tuple[int, int] = (0, 1)  # optional, required
    upper: int | None = 1
    bounds: dict[str, str] = field(default_factory=dict)
    loss: str | None = None
    fault: str | None = None  # place below the property
    early: str | None = None  # place below the property of a fault that hides the others; its code is of keywords but for oneOf
    untagged: bool = False
    policy: str = "reject"


_CLOSED = '"unevaluatedProperties":{"not":{}}'


def _tagged(name: str, value: str | None = None) -> str:
    """A closed branch of a constant kind, with a payload if given."""
    payload, required = (f',"value":{value}', '["kind","value"]') if value else ("", '["kind"]')
    return f'{{"type":"object","properties":{{"kind":{{"const":"{name}"}}{payload}}},"required":{required},{_CLOSED}}}'


_UNION = f"[{_tagged('plain')},{_tagged('many', '{"type":"integer"}')}]"
_BOTH = {"types": [("+", "union", None), ("+Many", "scalar", "integer")], "variants": [("plain", "+", None), ("many", "+", "+Many")]}
FORMS = [
    Form('{"type":"string"}', [("+", "scalar", "string")]),
    Form('{"type":"string","pattern":"^a","minLength":2}', [("+", "scalar", "string")]),
    Form('{"type":"number"}', [("+", "scalar", "float64")]),
    Form('{"type":"boolean","x-semantic-id":"q"}', [("+", "scalar", "boolean")]),
    Form('{"type":"integer","minimum":1,"maximum":10.0}', [("+", "scalar", "integer")], bounds={"min": "1", "max": "10"}),
    Form('{"$ref":"https://x/1.0.0/Kind.json"}', ref="Kind"),
    Form('{"$ref":"Gone.json"}', ref="Gone"),
    Form('{"type":"string","const":"one"}', [("+", "enum", None)], [("one", "+", None)]),
    Form('{"type":"string","enum":["x","y"]}', [("+", "enum", None)], [("x", "+", None), ("y", "+", None)]),
    Form('{"type":"array","items":{"$ref":"Kind.json"},"minItems":2}', ref="Kind", lower=(2, 2), upper=None),
    Form('{"type":"array","items":{"type":"number"}}', [("+", "scalar", "float64")], lower=(0, 0), upper=None, loss="required-collection-presence"),
    Form('{"type":"array","minItems":1,"items":{"anyOf":[{"type":"string"},{"type":"boolean"}]}}', [("+", "union", None), ("+String", "scalar", "string"), ("+Boolean", "scalar", "boolean")], [("string", "+", "+String"), ("boolean", "+", "+Boolean")], lower=(1, 1), upper=None, untagged=True),
    Form(f'{{"type":"array","minItems":1,"items":{{"oneOf":{_UNION}}}}}', lower=(1, 1), upper=None, **_BOTH),
    Form(f'{{"oneOf":{_UNION}}}', **_BOTH),
    Form('{"anyOf":[{"$ref":"Kind.json"},{"$ref":"Item.json"}]}', [("+", "union", None)], [("Kind", "+", "Kind"), ("Item", "+", "Item")], untagged=True),
    Form('{"anyOf":[{"type":"integer"},{"type":"string"}]}', [("+", "union", None), ("+Integer", "scalar", "integer"), ("+String", "scalar", "string")], [("integer", "+", "+Integer"), ("string", "+", "+String")], untagged=True),
    Form("{}", [("+", "record", None)], loss="unconstrained-value", policy="preserve"),
    Form('{"anyOf":[{"$ref":"Kind.json"},{"type":"string"}]}', fault=""),
    Form(f'{{"oneOf":{_UNION},"description":"d"}}', fault="/oneOf"),
    Form(f'{{"oneOf":[{_tagged('a')},{_tagged('a')}]}}', fault="/oneOf"),
    Form('{"type":"array","items":{"type":"string","minLength":1}}', fault=""),
    Form('{"type":"object"}', fault=""),
    Form('{"type":"string","format":"date"}', early="/format"),
    Form('{"type":"string","not":{"oneOf":[]}}', early="/not/oneOf"),
]
SLOTS = {"a": "p_partkey", "b": "p_partkey * 3 + p_size", "c": "p_size"}
#: Faults of the files, in SQL of both engines: Kind of no kind, Kind of another identity, no version in the first $id.
ODD_KIND, OTHER_ID, NO_VERSION = "p_partkey % 11 = 3", "p_partkey % 11 = 5", "p_partkey % 17 = 6"


def files(parts: DataFrame) -> DataFrame:
    """bundle, file, text of all parts."""
    form = lambda e: F.element_at(F.array(*[F.lit(f.text) for f in FORMS]), (F.expr(e) % len(FORMS) + 1).cast("int"))
    properties = F.concat_ws(",", *[F.concat(F.lit(f'"{slot}":'), form(e)) for slot, e in SLOTS.items()])
    ident = F.when(F.expr(NO_VERSION), "https://x/Item.json").otherwise("https://x/1.0.0/Item.json")
    item = F.concat(F.lit('{"$id":"'), ident, F.lit('","type":"object","properties":{'), properties, F.lit(f'}},"required":["a","c"],{_CLOSED},"x-semantic-id":"ix://kernel/Item"}}'))
    kind = F.concat(F.lit('{"$id":"https://x/1.0.0/Kind.json","x-semantic-id":"ix://kernel/'), F.when(F.expr(OTHER_ID), "Other").otherwise("Kind"), F.lit('",'), F.when(F.expr(ODD_KIND), '"type":"number"}').otherwise('"type":"string","enum":["low","high"]}'))
    both = F.explode(F.array(F.struct(F.lit("Item.json").alias("file"), item.alias("text")), F.struct(F.lit("Kind.json").alias("file"), kind.alias("text"))))
    return parts.select(F.col("p_partkey").alias("bundle"), both.alias("f")).select("bundle", "f.*")


def _lowered(spark, sf) -> json_schema.Lowered:
    return json_schema.lower(files(spread(load(spark, sf, "part"))))


def _register() -> list[tuple[str, str]]:
    """Constructs whose loss the register declares: any value at a and c, possibly empty collections at a."""
    return [("Item.a", "unconstrained-value"), ("Item.c", "unconstrained-value"), ("Item.a", "required-collection-presence")]


def json_schema_types(spark, sf) -> DataFrame:
    return _lowered(spark, sf).types


def json_schema_fields(spark, sf) -> DataFrame:
    return _lowered(spark, sf).fields


def json_schema_variants(spark, sf) -> DataFrame:
    return _lowered(spark, sf).variants.drop("identity")


def json_schema_bounds(spark, sf) -> DataFrame:
    return _lowered(spark, sf).constraints


def json_schema_findings(spark, sf) -> DataFrame:
    return _lowered(spark, sf).findings


def json_schema_losses(spark, sf) -> DataFrame:
    return json_schema.decided(_lowered(spark, sf).losses, spark.createDataFrame(_register(), "construct string, loss string"))


def json_schema_documents(spark, sf) -> DataFrame:
    """References of the contract documents that sound bundles become, and faults of their shape."""
    docs = cut(bundles.parsed(json_schema.assembled(_lowered(spark, sf))), "parsed")
    return rules.unresolved_references(docs).unionByName(rules.shape(docs)).select("doc_id", "code", F.regexp_extract("pointer", r"^/ir/types/\d+(.*)$", 1).alias("member"))


def json_schema_references(spark, sf) -> DataFrame:
    tree = cut(trees.nodes(files(spread(load(spark, sf, "part"))), ("bundle", "file")), "nodes")
    return json_schema.references(tree).select("bundle", "pointer", "target", "local")


def _rows(name: str, rows: list[tuple], columns: str) -> str:
    """A common table of fixed rows."""
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)})"


def _with() -> str:
    """Slots of all parts with their form, what forms mean, and the sound bundles."""
    slots = " UNION ALL ".join(f"SELECT p_partkey AS bundle, '{s}' AS slot, '{s in 'ac'}' = 'True' AS named, {i} AS pos, ({e}) % {len(FORMS)} AS form FROM part" for i, (s, e) in enumerate(SLOTS.items()))
    n = list(enumerate(FORMS))
    return ",\n".join([
        f"WITH s AS ({slots})",
        _rows("t", [(i, x[0][1:], x[1], x[2], f.policy if x[0] == "+" else "reject", f.untagged and x[0] == "+") for i, f in n for x in f.types], "form, suffix, kind, scalar, policy, untagged"),
        _rows("v", [(i, k, x[0], x[2]) for i, f in n for k, x in enumerate(f.variants)], "form, pos, name, payload"),
        _rows("f", [(i, f.ref, *f.lower, f.upper) for i, f in n if f.fault is None and f.early is None], "form, ref, lower_optional, lower_required, upper"),
        _rows("b", [(i, k, v) for i, f in n for k, v in f.bounds.items()], "form, keyword, value"),
        _rows("l", [(i, f.loss) for i, f in n if f.loss], "form, loss"),
        _rows("e", [(i, f.early, "UNSUPPORTED_SCHEMA_SHAPE" if f.early.endswith("oneOf") else "UNSUPPORTED_SCHEMA_KEYWORD") for i, f in n if f.early], "form, place, code"),
        _rows("w", [(i, f.fault) for i, f in n if f.fault is not None], "form, place"),
        "early AS (SELECT bundle, 'Item.json' AS file, code, 'Item.json/properties/' || slot || place AS locus FROM s JOIN e USING (form))",
        f"""late AS (SELECT * FROM (
          SELECT bundle, 'Item.json' AS file, 'UNSUPPORTED_SCHEMA_SHAPE' AS code, '/properties/' || slot || place AS locus FROM s JOIN w USING (form)
          UNION ALL SELECT p_partkey, 'Kind.json', 'UNSUPPORTED_SCHEMA_SHAPE', CASE WHEN {ODD_KIND} THEN 'Kind.json' ELSE 'Kind.json/x-semantic-id' END FROM part WHERE {ODD_KIND} OR {OTHER_ID})
          WHERE bundle NOT IN (SELECT bundle FROM early))""",
        f"last AS (SELECT p_partkey AS bundle, '' AS file, 'UNSUPPORTED_SCHEMA_SHAPE' AS code, '/documents' AS locus FROM part WHERE {NO_VERSION} AND p_partkey NOT IN (SELECT bundle FROM early UNION SELECT bundle FROM late))",
        "found AS (SELECT * FROM early UNION ALL SELECT * FROM late UNION ALL SELECT * FROM last)",
        "ok AS (SELECT p_partkey AS bundle FROM part WHERE p_partkey NOT IN (SELECT bundle FROM found))",
        "o AS (SELECT *, 'Item' || upper(slot) AS own FROM s JOIN ok USING (bundle))\n",
    ])


def _name(column: str) -> str:
    return f"CASE WHEN {column} LIKE '+%' THEN own || substr({column}, 2) ELSE {column} END"


QUERIES: dict[str, Callable] = {f.__name__: f for f in (json_schema_types, json_schema_fields, json_schema_variants, json_schema_bounds, json_schema_findings, json_schema_losses, json_schema_documents, json_schema_references)}
SQL: dict[str, str] = {
    "json_schema_types": _with() + """
SELECT bundle, own || suffix AS name, 'ix://kernel/' || own || suffix AS identity, kind, scalar, policy AS unknown_policy, untagged FROM o JOIN t USING (form)
UNION ALL SELECT bundle, n, 'ix://kernel/' || n, k, NULL, 'reject', false FROM ok, (VALUES ('Item', 'record'), ('Kind', 'enum')) x(n, k)""",
    "json_schema_fields": _with() + f"""
SELECT bundle, 'Item' AS owner, CAST(pos AS INTEGER) AS pos, slot AS name, 'ix://kernel/Item/' || slot AS identity, 'ix://kernel/' || {_name('ref')} AS type_ref,
  CASE WHEN CASE WHEN named THEN lower_required ELSE lower_optional END >= 1 THEN 'required' ELSE 'optional' END AS presence,
  CAST(CASE WHEN named THEN lower_required ELSE lower_optional END AS BIGINT) AS lower, CAST(upper AS BIGINT) AS upper FROM o JOIN f USING (form)""",
    "json_schema_variants": _with() + f"""
SELECT bundle, own AS owner, CAST(v.pos AS INTEGER) AS pos, name, 'ix://kernel/' || {_name('payload')} AS payload FROM o JOIN v USING (form)
UNION ALL SELECT bundle, 'Kind', p, n, NULL FROM ok, (VALUES (0, 'low'), (1, 'high')) x(p, n)""",
    "json_schema_bounds": _with() + "SELECT bundle, own AS owner, keyword, value, 'kernel.' || upper(keyword) AS diagnostic_code FROM o JOIN b USING (form)",
    "json_schema_findings": _with() + "SELECT * FROM found",
    "json_schema_losses": _with() + f""",
{_rows('r', _register(), 'construct, loss')},
{_rows('c', [(k, v[0]) for k, v in json_schema.LOSSES.items()], 'loss, code')}
SELECT bundle, 'Item.' || slot AS construct, CASE WHEN r.construct IS NULL THEN 'refused' ELSE 'declared-loss' END AS outcome, CASE WHEN r.construct IS NULL THEN 'UNSUPPORTED_LOSS' ELSE code END AS code
FROM o JOIN l USING (form) JOIN c USING (loss) LEFT JOIN r ON r.construct = 'Item.' || slot AND r.loss = l.loss WHERE l.loss <> 'required-collection-presence' OR named""",
    "json_schema_documents": _with() + "SELECT CAST(bundle AS VARCHAR) AS doc_id, 'UNRESOLVED_TYPE_REF' AS code, '/fields/' || pos || '/typeRef' AS member FROM o JOIN f USING (form) WHERE ref = 'Gone'",
    "json_schema_references": _with() + f""",
{_rows('x', [(i, p, t) for i, f in enumerate(FORMS) for p, t in [("/$ref", f.ref)] * (f.ref[0] != "+" and f.upper == 1) + [("/items/$ref", f.ref)] * (f.ref[0] != "+" and f.upper is None) + [(f"/anyOf/{k}/$ref", n) for k, n in enumerate(["Kind", "Item"]) if f.text.startswith('{"anyOf":[{"$ref"') and (k == 0 or n + ".json" in f.text)]], 'form, place, target')}
SELECT bundle, '/properties/' || slot || place AS pointer, target, CASE WHEN target <> 'Gone' THEN target || '.json' END AS local FROM s JOIN x USING (form)""",
}
