"""Queries of lowering Markdown bundles that are made from the part table.

Each part is a bundle: a root, an entity whose fields' form, multiplicity and type follow from the part's columns, an
enumeration with payloads, a tuple, a state machine, and a document for each fault of FAULTS that is faulty by a condition. The SQL states the
results from the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.plans.tables import load
from clausula.sources import artifacts

LINKS = ["owns", "contains", "mends"]
KINDS = [("entity", "record"), ("enumeration", "enumeration"), ("pair", "tuple"), ("machine", "state_machine")]
VERBS = [("owns", "ownership", "owned_by"), ("contains", "structure", "part_of")]


def front(ident: str, title: str, kind: str, *more: str) -> str:
    return "\n".join(["---", f"id: {ident}", f'title: "{title}"', f"object: {kind}", *more, "---", f"# {ident}", ""])


def fields(*rows: str) -> str:
    return "\n".join(["## Properties", "", "| Field | Type | Multiplicity | Constraints |", "|-|-|-|-|", *(f"| {r} |" for r in rows), ""])


HEAD = 8  # lines of front() and an empty one before the section
#: (number, document without fault or None, faulty document, line, code, severity). A fault's document is f<number>.md.
FAULTS = [
    (None, front("FR-001", "Again", "entity") + fields("id | UUID | 1 | identity"), 1, "DUPLICATE_ARTIFACT_ID", "error"),
    (None, front("W-1", "Widget", "widget") + fields("id | UUID | 1 |"), 1, "UNKNOWN_OBJECT_TYPE", "error"),
    (front("N-1", "Fine", "entity") + fields("id | UUID | 1 |"), front("N-1", "Not fine", "entity") + fields("id | UUID | 1 |"), 1, "UNNAMEABLE_ARTIFACT", "error"),
    (None, front("T-1", "Status", "entity") + fields("id | UUID | 1 |"), 1, "DUPLICATE_TYPE_NAME", "error"),
    (None, front("E-1", "Hollow", "enumeration") + "## Values\n\nnone\n", 1, "ARTIFACT_NOT_LOWERED", "error"),
    (None, front("L-1", "Legacy", "entity") + "## Properties\n\n| Name | Meaning |\n|-|-|\n| a | b |\n", 1, "ARTIFACT_NOT_LOWERED", "warning"),
    (None, front("B-1", "Both", "entity") + fields("id | UUID | 1 |") + "\n```sysml\nattribute id : UUID[1]\n```\n", 1, "ARTIFACT_NOT_LOWERED", "error"),
    (None, front("U-1", "Unknown", "entity") + fields("id | UUID | 1 |", "x | Lost | 1 |"), 12, "UNRESOLVED_TYPE_TOKEN", "error"),
    (None, front("I-1", "Foreign", "entity") + fields("x | ix://other/pack/FR-1 | 1 |"), 11, "IMPORT_UNSUPPORTED", "error"),
    (None, front("D-1", "Money", "entity") + fields("x | Decimal [USD] | 1 |"), 11, "DECIMAL_POLICY_MISSING", "error"),
    (None, front("C-1", "Twice", "entity") + fields("x | Integer | 1 | min: 1, min: 2"), 11, "DUPLICATE_CONSTRAINT", "error"),
    (None, front("C-2", "Unfit", "entity") + fields("x | String | 1 | pattern: /a,b/, min: 1"), 11, "CONSTRAINT_NOT_APPLICABLE", "error"),
    (None, front("M-1", "Bag", "entity") + fields("x | String | 0..* |"), 11, "DECLARED_LOSS", "info"),
    (None, front("M-2", "Duration", "entity") + fields("x | String | 1 |"), 1, "KERNEL_NAME_SHADOWED", "warning"),
    (None, front("R-1", "Verbless", "entity", "relationships:", "  - target: EN_1", "    type: mends", "  - target: EN_1", "    type: not_listed") + fields("x | String | 1 |"), 1, "UNKNOWN_EDGE_VERB", "error"),
    (None, front("R-2", "Targetless", "entity", "relationships:", "  - target: Nobody", "    type: owns") + fields("x | String | 1 |"), 1, "UNRESOLVED_RELATIONSHIP_TARGET", "error"),
    (None, front("E-2", "Marks", "enumeration") + "## Values\n\n| Value |\n|-|\n| _ |\n| ok |\n", 11, "UNSLUGGABLE_NAME", "error"),
    (None, front("E-3", "Stray", "enumeration") + "## Values\n\n| Value |\n|-|\n| ok |\n\n## Payloads\n\n| Value | Payload |\n|-|-|\n| gone | Integer |\n", 17, "ARTIFACT_NOT_LOWERED", "error"),
    (None, front("S-1", "Loose", "machine") + "## States\n\n| State |\n|-|\n| a |\n\n## Transitions\n\n| From | To | Trigger |\n|-|-|-|\n| a | z | go |\n", 17, "UNRESOLVED_FEATURE_REF", "error"),
]
#: Types of the faults' documents that stand in sound bundles: number, whether faulty, id, display name.
MILD_TYPES = [(2, False, "N-1", "Fine"), (12, True, "M-1", "Bag"), (13, True, "M-2", "Duration")]
NAMELESS = "(p_partkey + p_size) % 31 = 3"
#: Forms of the entity's second field: type cell, reference, precision, scale, unit, and the constraint it may carry.
TYPES = [("String", "ix://kernel/String", None, None, None, "maxLength: 9"), ("Integer", "ix://kernel/Integer", None, None, None, "min: -2"), ("Decimal(10,2) [USD]", "ix://kernel/Decimal", 10, 2, "USD", "max: 1.5"), ("Status", "ix://acme/shop/EN_1", None, None, None, "enumValues: a\\|b"), ("FR-001", "ix://acme/shop/FR-001", None, None, None, "")]
MULTIPLICITIES = [("1", 1, 1), ("0..1", 0, 1), ("1..*", 1, None), ("2..5", 2, 5), ("", 1, 1)]
RULE = "p_size % 3 = 0"  # whether the second field carries its constraint
FENCED = "p_partkey % 2 = 1"


def condition(n: int) -> str:
    return f"(p_partkey * {n + 2} + p_size) % {23 + n} = 1"


STATUS = front("EN_1", "Order Status", "enumeration", "name: Status") + "```\n## Values\n| Value |\n```\n\n## Values\n\n| Value | Description |\n|-|-|\n| a | first |\n| b | with \\| a bar |\n\n## Payloads\n\n| Value | Payload |\n|-|-|\n| b | Integer |\n"
PAIR = front("P-1", "Pair", "pair") + "## Positions\n\n| Type |\n|-|\n| Integer |\n| Status |\n"
MACHINE = front("SM-1", "Machine", "machine") + "## States\n\n| State | Description |\n|-|-|\n| on | |\n| off | |\n\n## Transitions\n\n| From | To | Trigger | Guard |\n|-|-|-|-|\n| on | off | press | |\n| off | on | press | awake |\n"
TAIL = """
## Invariants

### awake

```ocl
context Order inv awake:
  self.on
```

## Operations

### add

| Param | Type | Multiplicity | Constraints |
|-|-|-|-|
| line | Status | 1 | |
| n | Integer | 1 | |

Returns: FR-001 [1]
Pre: awake
Post: awake, awake

### clear

Post: awake
"""


def files(parts: DataFrame) -> DataFrame:
    """bundle, path, text of all parts."""
    pick = lambda values, e: F.element_at(F.array(*map(F.lit, values)), (F.expr(e) + 1).cast("int"))
    cell, rule = pick([t[0] for t in TYPES], "p_partkey % 5"), F.when(F.expr(RULE), pick([t[5] for t in TYPES], "p_partkey % 5")).otherwise("")
    many = pick([m[0] for m in MULTIPLICITIES], "p_size % 5")
    ends = ("relationships:", '  - target: "ix://acme/shop/EN_1"', "    type: contains", "  - target: Status", "    type: contains", "  - target: SM-1", "    type: owns")
    order = front("FR-001", "Order", "entity", *ends)
    table = F.concat(F.lit(fields("id | UUID | 1 | identity")), F.lit("| f | "), cell, F.lit(" | "), many, F.lit(" | "), rule, F.lit(" |\n"))
    bare = F.replace(rule, F.lit("\\|"), F.lit("|"))
    fence = F.concat(F.lit("## Properties\n\n```sysml\n  attribute id : UUID[1] { identity }\n  ref item f : "), cell, F.when(many != "", F.concat(F.lit("["), many, F.lit("]"))).otherwise(""), F.when(bare != "", F.concat(F.lit(" { "), bare, F.lit(" }"))).otherwise(""), F.lit("\n```\n"))
    entity = F.concat(F.lit(order), F.when(F.expr(FENCED), fence).otherwise(table), F.lit(TAIL))
    root = F.concat(F.lit("---\ntype: master-requirements\nname: shop\n"), F.when(F.expr(NAMELESS), "").otherwise("org: acme\n"), F.lit("---\n"))
    each = [("a.md", root), ("b.md", entity), ("c.md", F.lit(STATUS)), ("d.md", F.lit(PAIR)), ("e.md", F.lit(MACHINE))]
    each += [(f"f{n:02}.md", F.when(F.expr(condition(n)), F.lit(bad)).otherwise(F.lit(good))) for n, (good, bad, *_) in enumerate(FAULTS)]
    both = F.explode(F.array(*[F.struct(F.lit(path).alias("path"), text.alias("text")) for path, text in each]))
    return parts.select(F.col("p_partkey").alias("bundle"), both.alias("f")).select("bundle", "f.*").where("text IS NOT NULL")


def _lowered(spark, sf) -> artifacts.Lowered:
    kinds = spark.createDataFrame([(o, s, "acme-objects-shop", ["core"], LINKS) for o, s in KINDS], "object string, shape string, module string, roles array<string>, links array<string>")
    return artifacts.lower(files(load(spark, sf, "part")), kinds, spark.createDataFrame(VERBS, "verb string, category string, inverse string"))


def markdown_findings(spark, sf) -> DataFrame:
    return _lowered(spark, sf).findings


def markdown_types(spark, sf) -> DataFrame:
    return _lowered(spark, sf).types.withColumn("roles", F.array_join("roles", " "))


def markdown_members(spark, sf) -> DataFrame:
    """Fields of the entity, variants, states and positions: bundle, id, what, pos, name, to, detail."""
    x = _lowered(spark, sf)
    text = lambda *cs: F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cs])
    rules = x.constraints.where("id = 'FR-001'").select("bundle", "id", F.col("field").alias("name"), F.concat_ws(" ", "keyword", "operand", "diagnostic_code").alias("rule"))
    of_field = x.fields.where("id = 'FR-001'").join(rules, ["bundle", "id", "name"], "left")
    parts = [
        of_field.select("bundle", "id", F.lit("field").alias("what"), "pos", "name", F.col("type_ref").alias("to"), text("presence", "lower", "upper", "is_identity", "precision", "scale", "unit", "line", "column", "rule").alias("detail")),
        x.variants.select("bundle", "id", F.when(F.col("states"), "state").otherwise("variant").alias("what"), "pos", "name", F.col("payload").alias("to"), F.col("identity").alias("detail")),
        x.positions.select("bundle", "id", F.lit("position").alias("what"), "pos", F.lit("").alias("name"), F.col("type_ref").alias("to"), F.lit("").alias("detail")),
    ]
    return reduce(DataFrame.unionByName, parts)


def markdown_behaviour(spark, sf) -> DataFrame:
    """Operations, clauses, transitions and relationships: bundle, id, what, name, detail."""
    x = _lowered(spark, sf)
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), p["typeRef"])), ",")
    parts = [
        x.operations.select("bundle", "id", F.lit("operation").alias("what"), "name", F.concat_ws(" ", params, F.coalesce("returns", F.lit("-")), F.array_join("pre", ","), F.array_join("post", ",")).alias("detail")),
        x.clauses.select("bundle", "id", F.lit("clause").alias("what"), F.col("clause_id").alias("name"), F.concat_ws(" ", "language", "text").alias("detail")),
        x.transitions.select("bundle", "id", F.lit("transition").alias("what"), F.concat("from_state", F.lit(">"), "to_state").alias("name"), F.concat_ws(" ", F.coalesce("trigger", F.lit("-")), F.coalesce("guard", F.lit("-"))).alias("detail")),
        x.relationships.select("bundle", "id", F.lit("relationship").alias("what"), F.concat("verb", F.lit(">"), "target").alias("name"), F.concat_ws(" ", "category", F.col("composite").cast("string")).alias("detail")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _text(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)


_ERRORS = " OR ".join([NAMELESS, *[condition(n) for n, f in enumerate(FAULTS) if f[4] == "error"]])
_OK = f"ok AS (SELECT p_partkey AS bundle, p_partkey, p_size FROM part WHERE NOT ({_ERRORS}))"
_PATH = lambda n: f"f{n:02}.md"
#: A nameless bundle has no package, and so none of the findings that need identities.
_NEEDS_PACKAGE = {"UNRESOLVED_TYPE_TOKEN", "IMPORT_UNSUPPORTED", "DECIMAL_POLICY_MISSING", "DUPLICATE_CONSTRAINT", "CONSTRAINT_NOT_APPLICABLE", "DECLARED_LOSS", "UNKNOWN_EDGE_VERB", "UNRESOLVED_RELATIONSHIP_TARGET", "UNSLUGGABLE_NAME", "UNRESOLVED_FEATURE_REF"}
_BASE = [
    ("FR-001", "Order", "record", "shop:core shop:entity"), ("EN_1", "Status", "enum", "shop:core shop:enumeration"),
    ("P-1", "Pair", "tuple", "shop:core shop:pair"), ("SM-1", "Machine", "record", "shop:core shop:machine"),
]


def _findings_sql() -> str:
    rows = [f"SELECT p_partkey AS bundle, '' AS path, 1 AS line, 'BUNDLE_UNIDENTIFIED' AS code, 'error' AS severity FROM part WHERE {NAMELESS}"]
    for n, (_, _, line, code, severity) in enumerate(FAULTS):
        named = f" AND NOT ({NAMELESS})" if code in _NEEDS_PACKAGE or (code == "ARTIFACT_NOT_LOWERED" and line > 1) else ""
        rows.append(f"SELECT p_partkey, '{_PATH(n)}', {line}, '{code}', '{severity}' FROM part WHERE {condition(n)}{named}")
    return " UNION ALL ".join(rows)


def _types_sql() -> str:
    rows = [f"SELECT bundle, id, 'ix://acme/shop/' || id AS identity, display_name, kind, roles FROM ok, ({_values(_BASE)}) b(id, display_name, kind, roles)"]
    rows += [f"SELECT bundle, '{i}', 'ix://acme/shop/{i}', '{name}', 'record', 'shop:core shop:entity' FROM ok WHERE {'' if bad else 'NOT '}({condition(n)})" for n, bad, i, name in MILD_TYPES]
    return f"WITH {_OK} " + " UNION ALL ".join(rows)


_RULES = {0: "maxLength 9 shop.ORDER_F_MAXLENGTH", 1: "min -2 shop.ORDER_F_MIN", 2: "max 1.5 shop.ORDER_F_MAX", 3: "enumValues a|b shop.ORDER_F_ENUMVALUES"}
_MEMBERS_SQL = f"""
WITH {_OK},
t(k, ref, ps, rule) AS ({_values([(k, t[1], f"{t[2] or '-'} {t[3] or '-'} {t[4] or '-'}", _RULES.get(k, "-")) for k, t in enumerate(TYPES)])}),
m(k, lower, upper) AS ({_values([(k, m[1], "-" if m[2] is None else str(m[2])) for k, m in enumerate(MULTIPLICITIES)])})
SELECT bundle, 'FR-001' AS id, 'field' AS what, 0 AS pos, 'id' AS name, 'ix://kernel/UUID' AS "to", 'required 1 1 true - - - ' || CASE WHEN {FENCED} THEN '17 3' ELSE '18 3' END || ' -' AS detail FROM ok
UNION ALL SELECT bundle, 'FR-001', 'field', 1, 'f', ref, CASE WHEN lower > 0 THEN 'required' ELSE 'optional' END || ' ' || lower || ' ' || upper || ' false ' || ps || CASE WHEN {FENCED} THEN ' 18 3 ' ELSE ' 19 3 ' END || CASE WHEN {RULE} THEN rule ELSE '-' END
  FROM ok JOIN t ON t.k = p_partkey % 5 JOIN m ON m.k = p_size % 5
UNION ALL SELECT bundle, id, what, pos, name, "to", detail FROM ok, ({_values([("EN_1", "variant", 0, "a", None, "ix://acme/shop/EN_1/a"), ("EN_1", "variant", 1, "b", "ix://kernel/Integer", "ix://acme/shop/EN_1/b"), ("SM-1", "state", 0, "on", None, "ix://acme/shop/SM-1/on"), ("SM-1", "state", 1, "off", None, "ix://acme/shop/SM-1/off"), ("P-1", "position", 0, "", "ix://kernel/Integer", ""), ("P-1", "position", 1, "", "ix://acme/shop/EN_1", "")])}) x(id, what, pos, name, "to", detail)"""
_BEHAVIOUR = [
    ("FR-001", "operation", "add", "line:ix://acme/shop/EN_1,n:ix://kernel/Integer ix://acme/shop/FR-001 awake awake,awake"), ("FR-001", "operation", "clear", " -  awake"),
    ("FR-001", "clause", "awake", "ocl context Order inv awake:\n  self.on"), ("SM-1", "transition", "on>off", "press -"), ("SM-1", "transition", "off>on", "press awake"),
    ("FR-001", "relationship", "contains>ix://acme/shop/EN_1", "structure true"), ("FR-001", "relationship", "owns>ix://acme/shop/SM-1", "ownership false"),
]
QUERIES: dict[str, Callable] = {f.__name__: f for f in (markdown_findings, markdown_types, markdown_members, markdown_behaviour)}
SQL: dict[str, str] = {
    "markdown_findings": _findings_sql(),
    "markdown_types": _types_sql(),
    "markdown_members": _MEMBERS_SQL,
    "markdown_behaviour": f"WITH {_OK} SELECT bundle, id, what, name, detail FROM ok, ({_values(_BEHAVIOUR)}) x(id, what, name, detail)",
}
