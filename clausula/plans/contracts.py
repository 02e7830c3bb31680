"""Rule queries over contract documents that are made from the part table.

Each part gives one document. Every fault of FAULTS has nodes of its own in the document, in a good
or a bad form by a condition on the part's columns; the SQL states the findings of the bad forms
from the same columns. A query takes the faults of one group of rules, so that its documents are
short; validate_documents takes all.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausula.operators import rules, verdict
from clausula.plans.tables import cut, load, spread
from clausula.sources import bundles

MULTIPLICITY = {"lower": 1, "upper": 1, "ordered": False, "unique": False}


def ix(name: str) -> str:
    return f"ix://p/{name}"


def scalar(name: str, kind: str = "string", **more) -> dict:
    return {"identity": ix(name), "kind": "scalar", "scalar": kind, **more}


def of(name: str, kind: str, **more) -> dict:
    return {"identity": ix(name), "kind": kind, **more}


def member(owner: str, name: str, place: str, to: str = "Text", **more) -> dict:
    return {"identity": ix(f"{owner}.{place}"), "name": name, "typeRef": ix(to), "presence": "required", "nullable": False, "multiplicity": MULTIPLICITY, **more}


def record(name: str, *fields: dict, **more) -> dict:
    return of(name, "record", fields=list(fields), **more)


def relation(owner: str, to: str, composite: bool = False, **more) -> list[dict]:
    return [{"identity": ix(f"{owner}.r"), "category": "c", "composite": composite, "target": ix(to), **more}]


def constraint(owner: str, keyword: str, operands: str = "1") -> list[dict]:
    return [{"identity": ix(f"{owner}.c"), "keyword": keyword, "operands": operands}]


@dataclass
class Fault:
    """One or more types in their good and bad form, and the findings (place among these types, rest of the pointer, code) of the bad one."""

    group: str
    good: list[dict]
    bad: list[dict]
    findings: list[tuple[int | None, str, str]] = field(default_factory=list)
    severity: str = "error"


def _faults() -> list[Fault]:
    op = lambda owner, params=("a", "b"), pre=(): [{"identity": ix(f"{owner}.o"), "name": "o", "params": [{"name": p, "typeRef": ix("Text")} for p in params], "pre": list(pre)}]
    clause = lambda *ids: [{"id": i, "language": "l"} for i in ids]
    state = lambda **x: [{"from": "a", "to": "b", **x}]
    enum = lambda name, **x: of(name, "enum", variants=[{"identity": ix(f"{name}.a"), "name": "a"}, {"identity": ix(f"{name}.b"), "name": "b"}], **x)
    one = lambda group, good, bad, rest, code, **x: Fault(group, [good], [bad], [(0, rest, code)], **x)
    return [
        # identities and names
        Fault("names", [scalar("IdA"), scalar("IdB")], [scalar("IdA"), scalar("IdA")], [(1, "/identity", "DUPLICATE_IDENTITY")]),
        one("names", record("Fn", member("Fn", "x", "0"), member("Fn", "y", "1")), record("Fn", member("Fn", "x", "0"), member("Fn", "x", "1")), "/fields/1", "DUPLICATE_FIELD_NAME"),
        one("names", record("Pn", operations=op("Pn")), record("Pn", operations=op("Pn", ("a", "a"))), "/operations/0/params/1", "DUPLICATE_PARAM"),
        one("names", record("Cn", clauses=clause("k1", "k2")), record("Cn", clauses=clause("k1", "k1")), "/clauses/1", "DUPLICATE_CLAUSE_ID"),
        # references
        one("references", record("Rf", member("Rf", "x", "0")), record("Rf", member("Rf", "x", "0", "Lost")), "/fields/0/typeRef", "UNRESOLVED_TYPE_REF"),
        one("references", record("Rs", supertypes=[ix("Rec")]), record("Rs", supertypes=[ix("Lost")]), "/supertypes/0", "UNRESOLVED_TYPE_REF"),
        one("references", of("Se", "sequence", items=ix("Text")), of("Se", "sequence", items=ix("Lost")), "/items", "UNRESOLVED_ELEMENT_TYPE"),
        one("references", of("Mk", "map", keys=ix("Text"), values=ix("Rec")), of("Mk", "map", keys=ix("Lost"), values=ix("Rec")), "/keys", "UNRESOLVED_MAP_KEY"),
        one("references", of("Oi", "option", inner=ix("Text")), of("Oi", "option", inner=ix("Lost")), "/inner", "UNRESOLVED_OPTION_INNER"),
        one("references", of("Un", "union", variants=[{"identity": ix("Un.a"), "name": "a", "payload": ix("Rec")}]), of("Un", "union", variants=[{"identity": ix("Un.a"), "name": "a", "payload": ix("Lost")}]), "/variants/0/payload", "UNRESOLVED_VARIANT_PAYLOAD"),
        one("references", record("Rr", relationships=relation("Rr", "Rec")), record("Rr", relationships=relation("Rr", "Lost")), "/relationships/0/target", "UNRESOLVED_RELATIONSHIP_TARGET"),
        one("references", record("Rx", relationships=relation("Rx", "Rec", sourceEnd={"typeRef": ix("Rx")})), record("Rx", relationships=relation("Rx", "Rec", sourceEnd={"typeRef": ix("Rec")})), "/relationships/0/sourceEnd/typeRef", "INVALID_RELATIONSHIP_SOURCE"),
        one("references", record("Dc", operations=op("Dc", pre=["k1"]), clauses=clause("k1")), record("Dc", operations=op("Dc", pre=["k9"]), clauses=clause("k1")), "/operations/0", "DANGLING_CLAUSE_REF"),
        # chains and cycles
        Fault("cycles", [of("Al", "alias", target=ix("Am")), of("Am", "alias", target=ix("Text"))], [of("Al", "alias", target=ix("Am")), of("Am", "alias", target=ix("Al"))], [(0, "/target", "ALIAS_CYCLE"), (1, "/target", "ALIAS_CYCLE")]),
        Fault("cycles", [record("Co", relationships=relation("Co", "Cp", True)), record("Cp")], [record("Co", relationships=relation("Co", "Cp", True)), record("Cp", relationships=relation("Cp", "Co", True))], [(None, "/ir/types", "COMPOSITE_CYCLE")]),
        Fault("cycles", [record("Su", supertypes=[ix("Sv")]), record("Sv")], [record("Su", supertypes=[ix("Sv")]), record("Sv", supertypes=[ix("Su")])], [(None, "/ir/types", "SUPERTYPE_CYCLE")]),
        # fields and types
        one("members", record("Mu", member("Mu", "x", "0")), record("Mu", member("Mu", "x", "0", multiplicity={**MULTIPLICITY, "upper": 0})), "/fields/0/multiplicity", "INVALID_MULTIPLICITY"),
        one("members", record("Ut", member("Ut", "x", "0", "Int", unit=ix("m"))), record("Ut", member("Ut", "x", "0", "Rec", unit=ix("m"))), "/fields/0/unit", "UNIT_ON_NON_SCALAR"),
        one("members", record("Op", member("Op", "x", "0", "Opt")), record("Op", member("Op", "x", "0", "Opt", presence="optional")), "/fields/0/presence", "INVALID_OPTION_PRESENCE"),
        one("members", of("Ik", "map", keys=ix("Text"), values=ix("Rec")), of("Ik", "map", keys=ix("Rec"), values=ix("Rec")), "/keys", "INVALID_MAP_KEY"),
        one("members", of("Ii", "option", inner=ix("Text")), of("Ii", "option", inner=ix("Opt")), "/inner", "INVALID_OPTION_INNER"),
        one("members", scalar("De", "decimal", decimal={"precision": 9, "scale": 2}), scalar("De", "decimal"), "", "DECIMAL_POLICY_MISSING"),
        one("members", scalar("Dd", "decimal", decimal={"precision": 9, "scale": 2}), scalar("Dd", "decimal", decimal={"precision": 2, "scale": 9}), "/decimal", "DECIMAL_POLICY_CONFLICT"),
        Fault("members", [record("To", member("To", "x", "0")), record("Lo", member("Lo", "x", "0"), supertypes=[ix("To")])], [record("To", member("To", "x", "0")), record("Lo", member("Lo", "x", "0", multiplicity={**MULTIPLICITY, "upper": 5}), supertypes=[ix("To")])], [(1, "/fields/0", "INVALID_REDEFINITION")]),
        # constraints
        one("constraints", scalar("Ko", constraints=constraint("Ko", "minLength")), scalar("Ko", constraints=constraint("Ko", "odd")), "/constraints/0/keyword", "SCHEMA_VIOLATION"),
        one("constraints", scalar("Kl", constraints=constraint("Kl", "minLength")), scalar("Kl", constraints=constraint("Kl", "minLength", "x")), "/constraints/0/operands", "INVALID_OPERAND"),
        one("constraints", record("Kn", member("Kn", "x", "0", "Int", constraints=constraint("Kn", "min"))), record("Kn", member("Kn", "x", "0", "Int", constraints=constraint("Kn", "pattern", "a"))), "/fields/0/constraints/0", "CONSTRAINT_NOT_APPLICABLE"),
        one("constraints", scalar("Kw", "integer", constraints=constraint("Kw", "max", "170141183460469231731687303715884105727")), scalar("Kw", "integer", constraints=constraint("Kw", "max", "170141183460469231731687303715884105728")), "/constraints/0/operands", "INTEGER_OUTSIDE_I128"),
        one("constraints", scalar("Kp", constraints=constraint("Kp", "pattern", "a[b]")), scalar("Kp", constraints=constraint("Kp", "pattern", "a(b")), "/constraints/0/operands", "INVALID_PATTERN"),
        # structures
        one("structures", of("Tu", "tuple", positions=[{"name": "p0", "typeRef": ix("Text")}]), of("Tu", "tuple", positions=[]), "", "INVALID_TUPLE"),
        one("structures", of("Tp", "tuple", positions=[{"name": "p0", "typeRef": ix("Text")}]), of("Tp", "tuple", positions=[{"name": "q", "typeRef": ix("Text")}]), "/positions/0/name", "INVALID_TUPLE_POSITION"),
        one("structures", of("Tr", "tuple", positions=[{"name": "p0", "typeRef": ix("Text")}]), of("Tr", "tuple", positions=[{"name": "p0", "typeRef": ix("Lost")}]), "/positions/0/typeRef", "UNRESOLVED_POSITION_TYPE"),
        one("structures", of("Mb", "map", keys=ix("Text"), values=ix("Text"), bound={"lower": 1, "upper": 2}), of("Mb", "map", keys=ix("Text"), values=ix("Text"), bound={"lower": 3, "upper": 2}), "/bound", "INVALID_MAP_BOUND"),
        one("structures", enum("En", transitions=state()), enum("En", transitions=state(to="z")), "/transitions/0/to", "UNRESOLVED_FEATURE_REF"),
        one("structures", enum("Eg", transitions=state(guard="k"), clauses=clause("k")), enum("Eg", transitions=state(guard="g"), clauses=clause("k")), "/transitions/0/guard", "DANGLING_CLAUSE_REF"),
        one("structures", record("Cl", clauses=clause("k")), record("Cl", clauses=[{"id": "k"}]), "/clauses/0", "CLAUSE_LANGUAGE_UNCHECKED", severity="warning"),
        # shape: a document with one of these is not looked at further
        one("shape", scalar("Si"), {"kind": "scalar", "scalar": "string"}, "/identity", "SCHEMA_VIOLATION"),
        one("shape", of("Sa", "alias", target=ix("Text")), of("Sa", "alias"), "/target", "SCHEMA_VIOLATION"),
    ]


FAULTS = _faults()
COMMON = [scalar("Text"), scalar("Int", "integer"), record("Rec"), of("Opt", "option", inner=ix("Text"))]
#: Members of the document beside its types: (group, path, good, bad, findings). Later ones come into the same lists.
BESIDE = [
    ("references", "occurrences", [{"identity": ix("occ"), "definition": ix("Rec")}], [{"identity": ix("occ"), "definition": ix("Lost")}], [("/ir/occurrences/0/definition", "UNRESOLVED_OCCURRENCE_DEFINITION")]),
    ("references", "populations", [{"identity": ix("q0"), "members": [ix("Rec")]}, {"identity": ix("q1"), "members": [ix("Int")]}], [{"identity": ix("q0"), "members": [ix("Rec"), ix("Gone")]}, {"identity": ix("q1"), "members": [ix("Rec")]}],
     [("/ir/populations/0/members/1", "UNRESOLVED_CONSTRUCT_REF"), ("/ir/populations/0", "MULTIPLE_DOMAIN_MEMBERSHIP")]),
    ("packages", "packageGraph", {"packages": [{"identity": "a", "imports": [{"identity": "b", "names": ["f"]}]}, {"identity": "b", "imports": [], "exports": ["f"]}]},
     {"packages": [{"identity": "a", "imports": [{"identity": "b", "names": ["f", "g"]}, {"identity": "q"}]}, {"identity": "b", "imports": [{"identity": "a"}], "exports": ["f"]}]},
     [("/packageGraph/packages/0/imports/0", "UNRESOLVED_IMPORT"), ("/packageGraph/packages/0/imports/1", "UNRESOLVED_IMPORT"), ("/packageGraph/packages", "PACKAGE_CYCLE")]),
]
#: Texts that are no JSON objects.
BROKEN = "p_partkey % 53 = 52"


def condition(n: int) -> str:
    """When the fault of this number is in a part's document; SQL of both engines."""
    return f"(p_partkey * {n + 2} + p_size) % {7 + n % 6} = 1"


def _parts(group: str | None):
    """(fault, number, place of its first type) of the types of a group's documents; the same of members beside them."""
    at, types = len(COMMON), []
    for n, f in enumerate(FAULTS):
        if group in (None, f.group):
            types.append((f, n, at))
            at += len(f.good)
    beside = [(b, len(FAULTS) + i) for i, b in enumerate(BESIDE) if group in (None, b[0])]
    return types, beside


def _text(values) -> str:
    return json.dumps(values, separators=(",", ":"))


def texts(parts: DataFrame, group: str | None = None) -> DataFrame:
    """doc_id, text of the documents of all parts."""
    types, beside = _parts(group)
    inner = lambda ts: ",".join(map(_text, ts))
    either: Callable[[int, str, str], Column] = lambda n, good, bad: F.when(F.expr(condition(n)), F.lit(bad)).otherwise(F.lit(good))
    body = F.concat_ws(",", F.lit(inner(COMMON)), *[either(n, inner(f.good), inner(f.bad)) for f, n, _ in types])
    more = [F.concat(F.lit(f',"{b[1]}":'), either(n, _text(b[2]), _text(b[3]))) for b, n in beside]
    whole = F.concat(F.lit('{"ir":{"types":['), body, F.lit("]"), *more, F.lit("}}"))
    return parts.select(F.col("p_partkey").cast("string").alias("doc_id"), F.when(F.expr(BROKEN), F.lit("{")).otherwise(whole).alias("text"))


def _shapeless() -> str:
    return " OR ".join([BROKEN, *[condition(n) for n, f in enumerate(FAULTS) if f.group == "shape"]])


def findings_sql(group: str | None, columns: str = "doc_id, pointer, code") -> str:
    """The findings of a group's documents. With all groups together, documents of a bad shape have no findings of other groups."""
    types, beside = _parts(group)
    rows = []
    row = lambda pointer, code, severity, when: f"SELECT CAST(p_partkey AS VARCHAR) AS doc_id, '{pointer}' AS pointer, '{code}' AS code, '{severity}' AS severity FROM part WHERE {when}"
    for f, n, at in types:
        limit = f"NOT ({BROKEN})" if f.group == "shape" or group else f"NOT ({_shapeless()})"
        rows += [row(rest if k is None else f"/ir/types/{at + k}{rest}", code, f.severity, f"{condition(n)} AND {limit}") for k, rest, code in f.findings]
    for b, n in beside:
        limit = f"NOT ({BROKEN if group else _shapeless()})"
        rows += [row(pointer, code, "error", f"{condition(n)} AND {limit}") for pointer, code in b[4]]
    if group in (None, "shape"):
        rows.append(row("", "INVALID_DOCUMENT", "error", BROKEN))
    return f"SELECT {columns} FROM ({' UNION ALL '.join(rows)})"


GROUPS: dict[str, list[Callable[[DataFrame], DataFrame]]] = {
    "shape": [rules.shape],
    "names": [rules.duplicate_identities, rules.duplicate_names],
    "references": [rules.unresolved_references, rules.unresolved_members, rules.multiple_membership, rules.relationship_sources],
    "cycles": [rules.alias_cycles, rules.composite_cycles, rules.supertype_cycles],
    "members": [rules.field_rules, rules.type_rules, rules.redefinition_rules],
    "constraints": [rules.constraint_rules, rules.operand_rules],
    "structures": [rules.structure_rules],
    "packages": [rules.package_rules],
}


def _group(name: str) -> Callable:
    def run(spark, sf) -> DataFrame:
        docs = cut(bundles.parsed(texts(spread(load(spark, sf, "part")), name)), "parsed")
        return reduce(DataFrame.unionByName, [rule(docs) for rule in GROUPS[name]]).select("doc_id", "pointer", "code")

    return run


def validate_findings(spark, sf) -> DataFrame:
    """All findings of documents with all faults."""
    return rules.validated(bundles.parsed(texts(spread(load(spark, sf, "part"))))).select("doc_id", "pointer", "code")


def validate_documents(spark, sf) -> DataFrame:
    """The verdict on every document: success where nothing was found. A document's types are those of the structures group."""
    docs = bundles.parsed(texts(spread(load(spark, sf, "part")), "structures"))
    return verdict.result_state(rules.validated(docs), "doc_id", docs)


VERDICT_SQL = f"""
WITH f AS ({findings_sql("structures", "doc_id, severity")} UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'error' FROM part WHERE {BROKEN})
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN bool_or(f.severity = 'error') THEN 'invalid' WHEN bool_or(f.severity = 'warning') THEN 'lossy' ELSE 'success' END AS state
FROM part LEFT JOIN f ON f.doc_id = CAST(p_partkey AS VARCHAR) GROUP BY 1"""


def inexact_number_findings(spark, sf) -> DataFrame:
    """Whole numbers of an order past 2**53 by its key, and 20-digit fractions."""
    o = load(spark, sf, "orders")
    text = F.concat(F.lit('{"n":'), F.when(F.col("o_orderkey") % 3 == 0, "9007199254740993").otherwise("9007199254740992"), F.lit(',"m":['), F.when(F.col("o_orderkey") % 5 == 0, "0.12345678901234567891").otherwise("0.5"), F.lit("]}"))
    return rules.exact_numbers(o.select(F.col("o_orderkey").cast("string").alias("doc_id"), text.alias("text"))).select("doc_id", "pointer", "code")


def limit_findings(spark, sf) -> DataFrame:
    d = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rules.over_limits(d, max_bytes=2000, max_documents=10).select("doc_id", "code", "message")


def remote_references(spark, sf) -> DataFrame:
    p = load(spark, sf, "pages")
    text = F.concat(F.lit('{"$ref": "'), F.when(F.col("page_id") % 4 == 0, "https://json-schema.org/x").when(F.col("page_id") % 4 == 1, "#/x").otherwise("https://h.example/x"), F.lit('"}'))
    return rules.unsafe_references(p.select(F.col("page_id").cast("string").alias("doc_id"), text.alias("text"))).select("doc_id", "code")


def effective_fields(spark, sf) -> DataFrame:
    """Own and inherited fields of the members group's types."""
    docs = cut(bundles.parsed(texts(spread(load(spark, sf, "part")), "members")), "parsed")
    return rules.effective_fields(docs).select("doc_id", "owner", "name", "origin")


def contract_summary(spark, sf) -> DataFrame:
    docs = cut(bundles.parsed(texts(spread(load(spark, sf, "part")), "cycles")), "parsed")
    return rules.summary(docs).select("doc_id", "kind", "types", "relationships")


def owner_assignment(spark, sf) -> DataFrame:
    """Composite children of the cycles group's documents."""
    docs = cut(bundles.parsed(texts(spread(load(spark, sf, "part")), "cycles")), "parsed")
    return rules.owner_assignment(docs)


def name_resolution(spark, sf) -> DataFrame:
    """What the names that suppliers' rows use stand for, among artifacts made of nations."""
    n = load(spark, sf, "nation").select(F.concat(F.lit("FR-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 0, "enumeration").otherwise("object").alias("kind"))
    s = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    target = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("FR-"), F.col("n_nationkey").cast("string"))).when(F.col("s_suppkey") % 4 == 1, F.col("n_name")).when(F.col("s_suppkey") % 4 == 2, "String").otherwise("ix://q/x")
    return rules.resolve_names(s.select(F.col("s_suppkey").alias("use"), target.alias("target")), n, package="p")


def _number(code: str) -> int:
    return next(n for n, f in enumerate(FAULTS) if any(c == code for _, _, c in f.findings))


QUERIES: dict[str, Callable] = {f"findings_{g}": _group(g) for g in GROUPS} | {
    f.__name__: f for f in (validate_findings, validate_documents, inexact_number_findings, limit_findings, remote_references, effective_fields, contract_summary, owner_assignment, name_resolution)
}

_C = condition(_number("COMPOSITE_CYCLE"))
SQL: dict[str, str] = {f"findings_{g}": findings_sql(g) for g in GROUPS} | {
    "validate_findings": findings_sql(None),
    "validate_documents": VERDICT_SQL,
    "inexact_number_findings": """
SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, '/n' AS pointer, 'INEXACT_INTEGER' AS code FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '/m/0', 'INEXACT_NUMBER' FROM orders WHERE o_orderkey % 5 = 0""",
    "limit_findings": """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'DOCUMENT_TOO_LARGE' AS code, CAST(octet_length(encode(text)) AS VARCHAR) AS message FROM documents WHERE octet_length(encode(text)) > 2000
UNION ALL SELECT '', 'TOO_MANY_DOCUMENTS', CAST(count(*) AS VARCHAR) FROM documents HAVING count(*) > 10""",
    "remote_references": "SELECT CAST(page_id AS VARCHAR) AS doc_id, 'REMOTE_REFERENCE' AS code FROM pages WHERE page_id % 4 > 1",
    "effective_fields": f"""
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, owner, 'x' AS name, owner AS origin FROM part, (VALUES {", ".join(f"('{t['identity']}')" for f in FAULTS if f.group == 'members' for t in f.good if t.get('fields'))}) x(owner) WHERE NOT ({BROKEN})""",
    "contract_summary": f"""
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, kind, CAST(types AS BIGINT) AS types, CAST(relationships AS BIGINT) AS relationships FROM (
  SELECT p_partkey, unnest(['scalar', 'record', 'option', 'alias']) AS kind, unnest([2, 5, 1, 2]) AS types, unnest([0, CASE WHEN {_C} THEN 2 ELSE 1 END, 0, 0]) AS relationships FROM part WHERE NOT ({BROKEN}))""",
    "owner_assignment": f"""
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'ix://p/Cp' AS child, 'ix://p/Co' AS owner, 'owned' AS state FROM part WHERE NOT ({BROKEN})
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'ix://p/Co', 'ix://p/Cp', 'owned' FROM part WHERE {_C} AND NOT ({BROKEN})""",
    "name_resolution": """
SELECT s_suppkey AS "use", CASE s_suppkey % 4 WHEN 0 THEN 'FR-' || n_nationkey WHEN 1 THEN n_name WHEN 2 THEN 'String' ELSE 'ix://q/x' END AS target,
  CASE s_suppkey % 4 WHEN 0 THEN CASE WHEN n_regionkey = 0 THEN 'enumeration' ELSE 'object' END || '-by-id' WHEN 1 THEN CASE WHEN n_regionkey = 0 THEN 'enumeration' ELSE 'object' END || '-by-name' WHEN 2 THEN 'scalar' ELSE 'import' END AS how
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
}
