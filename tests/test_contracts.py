"""Rules, closures, evolution, packages, units and sources on small documents of their own."""

import json
import random

import pytest

from clausula.operators import closure, constraints, evolution, instances, packages, rules, transformations, units, verdict
from clausula.sources import bundles, markdown, registry


def ix(name):
    return f"ix://p/{name}"


M = {"lower": 1, "upper": 1, "ordered": False, "unique": False}
TEXT = {"identity": ix("Text"), "kind": "scalar", "scalar": "string"}


def record(name, *fields, **more):
    return {"identity": ix(name), "kind": "record", "displayName": name, "fields": [{"identity": ix(f"{name}.{n}.{i}"), "name": n, "typeRef": ix(t), "presence": "required", "nullable": False, "multiplicity": M, **x} for i, (n, t, x) in enumerate(fields)], **more}


def docs(spark, **bodies):
    rows = [(k, v if isinstance(v, str) else json.dumps({"ir": v})) for k, v in bodies.items()]
    return bundles.parsed(spark.createDataFrame(rows, "doc_id string, text string"))


def codes(df):
    return sorted((r.doc_id, r.code, r.pointer) for r in df.collect())


def test_findings(spark):
    good = {"types": [TEXT, record("A", ("x", "Text", {}))]}
    bad = {
        "types": [
            TEXT, {"identity": ix("Int"), "kind": "scalar", "scalar": "integer"}, {"identity": ix("Text"), "kind": "scalar", "scalar": "string"},
            record("A", ("x", "Text", {}), ("x", "Lost", {}), ("y", "Text", {"multiplicity": {**M, "upper": 0}}), ("z", "A", {"unit": "ix://p/m"}), ("w", "Int", {"constraints": [{"identity": ix("c"), "keyword": "pattern", "operands": "a"}, {"identity": ix("c2"), "keyword": "odd"}]})),
            {"identity": ix("P"), "kind": "alias", "target": ix("Q")}, {"identity": ix("Q"), "kind": "alias", "target": ix("P")}, {"identity": ix("R"), "kind": "alias", "target": ix("Text")},
            {"identity": ix("Map"), "kind": "map", "keys": ix("A"), "values": ix("Text")}, {"identity": ix("O"), "kind": "option", "inner": ix("O2")}, {"identity": ix("O2"), "kind": "option", "inner": ix("Text")},
            {"identity": ix("D"), "kind": "scalar", "scalar": "decimal"}, {"identity": ix("D2"), "kind": "scalar", "scalar": "decimal", "decimal": {"precision": 2, "scale": 3}},
            record("B", relationships=[{"identity": ix("r1"), "category": "c", "composite": True, "target": ix("C")}], supertypes=[ix("C")]),
            record("C", relationships=[{"identity": ix("r2"), "category": "c", "composite": True, "target": ix("B")}, {"identity": ix("r3"), "category": "c", "composite": False, "target": ix("None")}], supertypes=[ix("B")],
                   operations=[{"identity": ix("op"), "name": "op", "params": [{"name": "a", "typeRef": ix("Text")}, {"name": "a", "typeRef": ix("Text")}], "pre": ["k9"]}], clauses=[{"id": "k1", "language": "l"}, {"id": "k1", "language": "l"}]),
        ],
        "occurrences": [{"identity": ix("occ"), "definition": ix("Nope")}],
        "populations": [{"identity": ix("pop"), "members": [ix("A"), ix("Gone")]}, {"identity": ix("pop2"), "members": [ix("A")]}],
    }
    d = docs(spark, good=good, bad=bad, broken="{", shapeless={"types": [{"identity": ix("S"), "kind": "alias"}]}, none={})
    found = codes(rules.validated(d))
    assert {f[0] for f in found} == {"bad", "broken", "shapeless", "none"}
    assert ("broken", "INVALID_DOCUMENT", "") in found and ("none", "SCHEMA_VIOLATION", "/ir/types") in found and ("shapeless", "SCHEMA_VIOLATION", "/ir/types/0/target") in found
    of_bad = {(c, p) for i, c, p in found if i == "bad"}
    assert of_bad == {
        ("DUPLICATE_IDENTITY", "/ir/types/2/identity"), ("DUPLICATE_FIELD_NAME", "/ir/types/3/fields/1"), ("UNRESOLVED_TYPE_REF", "/ir/types/3/fields/1/typeRef"), ("INVALID_MULTIPLICITY", "/ir/types/3/fields/2/multiplicity"),
        ("UNIT_ON_NON_SCALAR", "/ir/types/3/fields/3/unit"), ("CONSTRAINT_NOT_APPLICABLE", "/ir/types/3/fields/4/constraints/0"), ("SCHEMA_VIOLATION", "/ir/types/3/fields/4/constraints/1/keyword"),
        ("ALIAS_CYCLE", "/ir/types/4/target"), ("ALIAS_CYCLE", "/ir/types/5/target"), ("INVALID_MAP_KEY", "/ir/types/7/keys"), ("INVALID_OPTION_INNER", "/ir/types/8/inner"), ("DECIMAL_POLICY_MISSING", "/ir/types/10"), ("DECIMAL_POLICY_CONFLICT", "/ir/types/11/decimal"),
        ("COMPOSITE_CYCLE", "/ir/types"), ("SUPERTYPE_CYCLE", "/ir/types"), ("UNRESOLVED_RELATIONSHIP_TARGET", "/ir/types/13/relationships/1/target"), ("DUPLICATE_PARAM", "/ir/types/13/operations/0/params/1"), ("DANGLING_CLAUSE_REF", "/ir/types/13/operations/0"), ("DUPLICATE_CLAUSE_ID", "/ir/types/13/clauses/1"),
        ("UNRESOLVED_OCCURRENCE_DEFINITION", "/ir/occurrences/0/definition"), ("UNRESOLVED_CONSTRUCT_REF", "/ir/populations/0/members/1"), ("MULTIPLE_DOMAIN_MEMBERSHIP", "/ir/populations/0"),
    }
    owners = rules.composite_owners(d).collect()
    assert owners == [] and {(r.kind, r.types) for r in rules.summary(d.where("doc_id = 'good'")).collect()} == {("scalar", 1), ("record", 1)}


def test_effective_fields_and_schema_text(spark, tmp_path):
    d = docs(spark, a={"types": [TEXT, record("Top", ("x", "Text", {}), ("y", "Text", {})), record("Mid", ("x", "Text", {}), supertypes=[ix("Top")]), record("Low", ("z", "Text", {}), supertypes=[ix("Mid")])]})
    got = {(r.owner[7:], r.name, r.origin[7:]) for r in rules.effective_fields(d).collect()}
    assert got == {("Top", "x", "Top"), ("Top", "y", "Top"), ("Mid", "x", "Mid"), ("Mid", "y", "Top"), ("Low", "z", "Low"), ("Low", "x", "Mid"), ("Low", "y", "Top")}
    texts = {r.identity: json.loads(r.schema) for r in bundles.json_schema_of(bundles.types(d), bundles.fields(d)).collect()}
    assert texts[ix("Top")]["properties"] == {"x": {"type": "string"}, "y": {"type": "string"}} and texts[ix("Top")]["required"] == ["x", "y"]
    bundles.write_canonical(spark.createDataFrame([(1, "x")], "b int, a string"), f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ['{"a":"x","b":1}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"types": [TEXT]}))
    assert bundles.parsed(bundles.read_documents(spark, f"{tmp_path}/in")).select("ir.types").first()[0][0].identity == ix("Text")


def reachable(edges):
    """Brute force: component of each node on a cycle."""
    to, far = {}, {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    for start in to:
        seen, open_ = set(), list(to[start])
        while open_:
            n = open_.pop()
            if n not in seen:
                seen.add(n)
                open_ += to.get(n, ())
        far[start] = seen
    return {(n, min(m for m in far[n] if n in far.get(m, ()))) for n in far if n in far[n]}


def test_components(spark):
    e = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (0, 1), (5, 9)]
    df = spark.createDataFrame([*e, (None, 1), (2, None)], "src long, dst long")
    assert {tuple(r) for r in closure.strong_components(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}
    assert closure.strong_components(df.limit(0)).count() == 0
    # A ring of 300, chains between two branches both ways, a chain that leads on, a branch with a loop through a chain of lesser names.
    e = [(i, i + 1) for i in range(1000, 1299)] + [(1299, 1000)] + [(50, 7), (7, 8), (8, 60), (60, 3), (3, 50), (50, 60), (60, 70), (70, 71), (71, 72), (72, 71), (72, 80), (80, 80)]
    e += [(90, 91), (91, 95), (95, 90), (90, 20), (20, 21), (21, 90)]
    assert {tuple(r) for r in closure.strong_components(spark.createDataFrame(e, "src long, dst long")).collect()} == reachable(e)


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    e = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)]
    assert {tuple(r) for r in closure.strong_components(spark.createDataFrame(e, "src long, dst long")).collect()} == reachable(e)


def test_constraint_changes(spark):
    s = "owner string, keyword string, value string, scalar string, code string"
    b = [("a", "min", "10", "integer", "C"), ("b", "min", "10", "integer", "C"), ("c", "max", "0.5", "decimal", "C"), ("d", "max", "9" * 60, "integer", "C"), ("e", "max", "-2.5", "decimal", "C"), ("f", "pattern", "a", "string", "C"), ("g", "min", "1", "integer", "C"), ("h", "pattern", "a", "string", "C"), ("i", "max", "x", "integer", "C"), ("j", "min", "1", "integer", "C")]
    a = [("a", "min", "9", "integer", "C"), ("b", "min", "11", "integer", "C"), ("c", "max", "0.50", "decimal", "C"), ("d", "max", "9" * 59 + "8", "integer", "C"), ("e", "max", "-2.25", "decimal", "C"), ("f", "pattern", "b", "string", "C"), ("i", "max", "y", "integer", "C"), ("j", "min", "1", "integer", "D"), ("k", "min", "1", "integer", "C")]
    got = {tuple(r) for r in evolution.diff_constraints(spark.createDataFrame(b, s), spark.createDataFrame(a, s)).collect()}
    assert got == {("a", "min", "operand", "conditional"), ("b", "min", "operand", "breaking"), ("c", "max", "operand", "breaking"), ("d", "max", "operand", "breaking"), ("e", "max", "operand", "conditional"), ("f", "pattern", "operand", "breaking"), ("g", "min", "removed", "conditional"), ("h", "pattern", "removed", "breaking"), ("i", "max", "operand", "breaking"), ("j", "min", "member", "patch"), ("k", "min", "added", "breaking")}


def test_result_state_of_all_documents(spark):
    d = docs(spark, good={"types": [TEXT]}, bad="{", warned={"types": [record("A", clauses=[{"id": "k"}])]})
    assert {tuple(r) for r in verdict.result_state(rules.validated(d), "doc_id", d).collect()} == {("good", "success"), ("bad", "invalid"), ("warned", "lossy")}


def test_chains_and_closure(spark):
    n = 600
    refs = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (1002, 1000), (2000, 9999)]
    nodes = sorted({i for i, _ in refs} | {n})
    got = {r.node: r for r in closure.resolve_chain(spark.createDataFrame(refs, "src long, dst long"), spark.createDataFrame([(i,) for i in nodes], "node long")).collect()}
    assert got[500].terminal == n and got[500].hops == 100 and got[500].status == "resolved"
    assert got[0].status == "depth" and got[1002].status == got[1000].status == "cycle" and got[2000].status == "unresolved"
    near = closure.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "src long, dst long")).collect()
    assert {tuple(r) for r in near} == {(1, 2, 1), (1, 3, 1), (2, 3, 1), (3, 1, 1), (2, 1, 2), (3, 2, 2), (1, 1, 2), (2, 2, 3), (3, 3, 2)}
    up = closure.ancestors(spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "b")], "src string, dst string")).collect()
    assert {tuple(r) for r in up} == {("d", "b", 2), ("d", "c", 1), ("d", "a", 3), ("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}


def test_verdict(spark):
    f = spark.createDataFrame([("d", "/a", "X", "", "error"), ("d", "/a/1", "Y", "", "warning"), ("d", "/a/10", "Z", "", "info"), ("d", "/b", "X", "", "info")], "doc_id string, pointer string, code string, message string, severity string")
    assert {r.pointer for r in verdict.deepest(f).collect()} == {"/a/1", "/a/10", "/b"}
    nodes = spark.createDataFrame([("d", "", "root"), ("d", "/a", "A")], "doc_id string, pointer string, identity string")
    assert {(r.pointer, r.owner) for r in verdict.with_owner(f, nodes).collect()} == {("/a", "A"), ("/a/1", "A"), ("/a/10", "A"), ("/b", "root")}
    assert verdict.result_state(f, "doc_id").first().state == "invalid"
    assert [r.code for r in verdict.limited(f.select("pointer", "code", "message"), 2).collect()] == ["X", "Y", "DIAGNOSTIC_LIMIT"]


def test_evolution(spark):
    schema = "identity string, kind string, scalar string, display_name string, unknown_policy string"
    b = spark.createDataFrame([("a", "scalar", "date", "A", "preserve"), ("b", "record", None, "B", "preserve"), ("c", "record", None, "C", "reject"), ("e", "scalar", "string", "E", "preserve")], schema)
    a = spark.createDataFrame([("a", "scalar", "datetime", "A", "preserve"), ("b", "enum", None, "B2", "reject"), ("d", "record", None, "D", "reject"), ("e", "scalar", "integer", "E", "preserve")], schema)
    got = {tuple(r) for r in evolution.diff_types(b, a).collect()}
    assert got == {("a", "scalar", "conditional"), ("b", "kind", "breaking"), ("b", "display_name", "patch"), ("b", "unknown_policy", "breaking"), ("c", "removed", "breaking"), ("d", "added", "additive"), ("e", "scalar", "breaking")}
    worst = {tuple(r) for r in evolution.worst(evolution.diff_types(b, a), "identity").collect()}
    assert ("b", "breaking") in worst and ("a", "conditional") in worst


def test_packages(spark):
    p = spark.createDataFrame([("a", "1.0.0", 0), ("b", "1.0.0", 1), ("b", "1.1.0", 2), ("b", "2.0.0", 3), ("c", "1.0.0", 4), ("c", "1.5.0", 5)], "identity string, version string, ord long")
    imports = spark.createDataFrame([("a", "1.0.0", "b", "^1.0.0"), ("a", "1.0.0", "c", "^1.0.0"), ("b", "1.1.0", "c", "1.0.0"), ("c", "1.0.0", "lost", "^1.0.0")], "identity string, version string, target string, range string")
    roots = spark.createDataFrame([("a", "^1.0.0")], "identity string, range string")
    assert {tuple(r) for r in packages.resolve(p, imports, roots).collect()} == {("a", "1.0.0", "resolved"), ("b", "1.1.0", "resolved"), ("c", "1.0.0", "resolved"), ("lost", None, "missing")}
    more = roots.union(spark.createDataFrame([("b", "2.0.0")], "identity string, range string"))
    assert ("b", None, "conflict") in {tuple(r) for r in packages.resolve(p, imports, more).collect()}
    ring = packages.package_cycles(spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("q", "x")], "identity string, target string")).collect()
    assert [(r.component, r.members) for r in ring] == [("x", ["x", "y", "z"])]


def test_units(spark):
    u = spark.createDataFrame([("K", None, 1.0, 0.0, "t"), ("C", "K", 1.0, 273.15, "t"), ("F", "C", 0.5, -10.0, "t"), ("x", "y", 1.0, 0.0, "t"), ("y", "x", 1.0, 0.0, "l"), ("w", "none", 1.0, 0.0, "m")], "unit string, target string, scale double, offset double, dimension string")
    got = {r.unit: r for r in units.to_root(u.drop("dimension")).collect()}
    assert (got["F"].root, got["F"].scale, round(got["F"].offset, 2)) == ("K", 0.5, 263.15) and got["x"].status == "cycle" and got["w"].status == "unresolved"
    bad = {tuple(r) for r in units.dimension_mismatches(u, spark.createDataFrame([("t",), ("l",)], "dimension string")).collect()}
    assert bad == {("x", "INVALID_UNIT_GRAPH"), ("y", "INVALID_UNIT_GRAPH"), ("w", "UNRESOLVED_DIMENSION_REF")}


def test_markdown(spark):
    text = "---\nid: FR-1\ntitle: A thing\nrelationships:\n- target: FR-2\n  type: uses\n- target: FR-3\n---\n# Head\n## Properties\n| Field | Type | Multiplicity | Constraints |\n|---|---|---|---|\n| a | Text | 1 | - |\n| b | Text | 0..* | x |\n## Values\n| v |\n"
    df = spark.createDataFrame([("d", text), ("e", "plain"), ("f", None)], "doc_id string, text string")
    assert {(r.name, r.value) for r in markdown.front_matter(df).collect()} >= {("id", "FR-1"), ("title", "A thing")}
    assert {(r.target, r.verb) for r in markdown.edges(df).collect()} == {("FR-2", "uses"), ("FR-3", "references")}
    assert [(r.name, r.type_ref, r.lower, r.upper) for r in markdown.properties(df).orderBy("line").collect()] == [("a", "Text", 1, 1), ("b", "Text", 0, None)]
    assert [r.cells for r in markdown.table_rows(df, "Values").collect()] == [["v"]]
    assert [(r.level, r.title) for r in markdown.headings(df).orderBy("line").collect()] == [(1, "Head"), (2, "Properties"), (2, "Values")]


def test_constraints_and_instances(spark):
    df = spark.createDataFrame([(1, "ab", [1, 1], {"k": 1}), (2, None, [1], {})], "id int, s string, a array<int>, m map<string,int>")
    rows = constraints.findings(df, [constraints.Constraint("a", "unique"), constraints.Constraint("m", "nonEmpty"), constraints.Constraint("s", "minLength", 3)], ["id"]).collect()
    assert {(r.id, r.code) for r in rows} == {(1, "A_UNIQUE"), (2, "M_NONEMPTY"), (1, "S_MINLENGTH")}
    with pytest.raises(ValueError):
        constraints.findings(df, [constraints.Constraint("a", "pattern", "x")], ["id"])
    assert [r.verdict for r in constraints.admitted(df, [], ["s"]).orderBy("id").collect()] == ["OK", "S_REQUIRED"]
    j = spark.createDataFrame([('{"a":1,"c":null,"z":2}',), ("{}",), (None,)], "j string")
    fields = [instances.Field("a", required=True), instances.Field("c", nullable=False)]
    got = [r[0] for r in j.select(instances.record_codes(j.j, fields)).collect()]
    assert got[0] == ["NULL_C", "UNKNOWN_Z"] and got[1] == ["MISSING_A"]
    assert [r.state for r in instances.presence(j, "j", "c").collect()] == ["null", "absent", "absent"]
    assert instances.prepared(j, "j", [instances.Field("b", default="7")]).first().b == "7"


def test_declared_transformations(spark):
    m = spark.createDataFrame([("a", "codec", ["encoding"], False, False), ("b", "projection", ["selectedIdentities", "preservation"], True, True), ("c", "odd", [], False, False)], "mapping string, kind string, members array<string>, effectful boolean, lossy boolean")
    assert {tuple(r) for r in transformations.declaration_faults(m).collect()} == {("a", "SCHEMA_VIOLATION", "decodePolicy"), ("b", "SCHEMA_VIOLATION", "provenanceSources"), ("b", "SCHEMA_VIOLATION", "omittedIdentities"), ("c", "UNKNOWN_KIND", "odd")}
    t = spark.createDataFrame([("a", "x"), ("b", "y")], "mapping string, target string")
    assert [tuple(r) for r in transformations.unknown_targets(t, spark.createDataFrame([("x",)], "identity string")).collect()] == [("b", "UNKNOWN_MAPPING_TARGET", "y")]
    e = spark.createDataFrame([("d", "p"), ("d", "q")], "doc_id string, name string")
    known = spark.createDataFrame([("p",)], "name string")
    assert [r.member for r in transformations.unknown_extensions(e, known).collect()] == ["q"] and transformations.unknown_extensions(e, known, "surface").count() == 0
    df = spark.createDataFrame([(1, "a", None)], "k int, x string, y int")
    assert transformations.decode(transformations.encode(df, ["k"]), "x string, y int").collect() == df.collect()
    assert transformations.put(df, df.select("k", "x"), ["k"]).collect() == df.collect()  # get, then put changes nothing


def test_registry(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"types": [TEXT]}))
    assert registry.run_frontend(spark, "json", str(tmp_path)).count() == 1
    with pytest.raises(KeyError):
        registry.run_frontend(spark, "none", str(tmp_path))
    own = registry.Registry({"json": lambda s, p: s.range(1)})
    with pytest.raises(ValueError):
        registry.run_frontend(spark, "json", str(tmp_path), own)
    with pytest.raises(KeyError):
        own.register("json", print)


def test_more_findings(spark):
    body = {
        "types": [
            TEXT, {"identity": ix("Int"), "kind": "scalar", "scalar": "integer", "constraints": [{"identity": ix("c"), "keyword": "max", "operands": "170141183460469231731687303715884105728"}]},
            {"identity": ix("Str"), "kind": "scalar", "scalar": "string", "constraints": [{"identity": ix("d"), "keyword": "pattern", "operands": "a(b"}]},
            {"identity": ix("T0"), "kind": "tuple", "positions": []}, {"identity": ix("T1"), "kind": "tuple", "positions": [{"name": "p0", "typeRef": ix("Text")}, {"name": "q", "typeRef": ix("Lost")}]},
            {"identity": ix("M"), "kind": "map", "keys": ix("Text"), "values": ix("Text"), "bound": {"lower": 3, "upper": 2}},
            {"identity": ix("E"), "kind": "enum", "variants": [{"identity": ix("E.a"), "name": "a"}, {"identity": ix("E.b"), "name": "b"}], "transitions": [{"from": "a", "to": "b"}, {"from": "a", "to": "z", "guard": "g"}], "clauses": [{"id": "k"}]},
            record("Top", ("x", "Text", {}), ("y", "Text", {})), record("Low", ("x", "Text", {"multiplicity": {**M, "upper": 5}}), ("y", "Text", {}), supertypes=[ix("Top")]),
        ],
        "packageGraph": {"packages": [{"identity": "a", "version": "1.0.0", "imports": [{"identity": "b", "names": ["f", "g"]}, {"identity": "q"}]}, {"identity": "b", "version": "1.0.0", "imports": [{"identity": "a"}], "exports": ["f"]}]},
    }
    got = {(c, p) for _, c, p in codes(rules.validated(docs(spark, d=body)))}
    assert got == {
        ("INTEGER_OUTSIDE_I128", "/ir/types/1/constraints/0/operands"), ("INVALID_PATTERN", "/ir/types/2/constraints/0/operands"), ("INVALID_TUPLE", "/ir/types/3"), ("INVALID_TUPLE_POSITION", "/ir/types/4/positions/1/name"), ("UNRESOLVED_POSITION_TYPE", "/ir/types/4/positions/1/typeRef"),
        ("INVALID_MAP_BOUND", "/ir/types/5/bound"), ("UNRESOLVED_FEATURE_REF", "/ir/types/6/transitions/1/to"), ("DANGLING_CLAUSE_REF", "/ir/types/6/transitions/1/guard"), ("CLAUSE_LANGUAGE_UNCHECKED", "/ir/types/6/clauses/0"), ("INVALID_REDEFINITION", "/ir/types/8/fields/0"),
        ("UNRESOLVED_IMPORT", "/packageGraph/packages/0/imports/0"), ("UNRESOLVED_IMPORT", "/packageGraph/packages/0/imports/1"), ("PACKAGE_CYCLE", "/packageGraph/packages"),
    }


def test_owners_names_and_limits(spark):
    r = lambda o, *ts: record(o, relationships=[{"identity": ix(f"{o}{t}"), "category": "c", "composite": True, "target": ix(t)} for t in ts])
    d = docs(spark, d={"types": [r("A", "B", "C"), r("X", "B"), r("B", "D"), r("D", "E"), r("C", "F"), r("E"), r("F")]})
    assert {(x.child[7:], x.owner and x.owner[7:], x.state) for x in rules.owner_assignment(d).collect()} == {("B", None, "refused"), ("C", "A", "owned"), ("D", None, "refused"), ("E", None, "refused"), ("F", "C", "owned")}
    uses = spark.createDataFrame([(1, "String"), (2, "FR-1"), (3, "Thing"), (4, "Colour"), (5, "ix://q/x"), (6, "None")], "use int, target string")
    arts = spark.createDataFrame([("FR-1", "Thing", "object"), ("EN-1", "Colour", "enumeration"), ("EN-2", "Thing", "enumeration")], "id string, name string, kind string")
    assert {x.use: x.how for x in rules.resolve_names(uses, arts, package="p").collect()} == {1: "scalar", 2: "object-by-id", 3: "object-by-name", 4: "enumeration-by-name", 5: "import", 6: "unknown"}
    t = spark.createDataFrame([("a", "x" * 50), ("b", '{"$ref": "https://evil.example/x"}'), ("c", '{"$schema": "https://json-schema.org/x"}')], "doc_id string, text string")
    assert [x.doc_id for x in rules.unsafe_references(t).collect()] == ["b"]
    assert {x.code for x in rules.over_limits(t, max_bytes=45, max_documents=2).collect()} == {"DOCUMENT_TOO_LARGE", "TOO_MANY_DOCUMENTS"}


def test_exact_numbers_and_ends(spark):
    t = spark.createDataFrame([("a", '{"x": 9007199254740993, "y": [1.5, 0.1234567890123456789, 1e400], "z~/": 9007199254740991}'), ("b", "nope")], "doc_id string, text string")
    assert {(r.code, r.pointer) for r in rules.exact_numbers(t).collect()} == {("INEXACT_INTEGER", "/x"), ("INEXACT_NUMBER", "/y/1"), ("INEXACT_INTEGER", "/y/2")}  # 1e400 is whole
    d = docs(spark, d={"types": [record("A", relationships=[{"identity": ix("r"), "category": "c", "composite": False, "target": ix("A"), "sourceEnd": {"typeRef": ix("B")}}])]})
    assert [(r.code, r.pointer) for r in rules.relationship_sources(d).collect()] == [("INVALID_RELATIONSHIP_SOURCE", "/ir/types/0/relationships/0/sourceEnd/typeRef")]


def test_changes_of_members(spark):
    s = "owner string, name string, params array<string>, returns string"
    b = spark.createDataFrame([("A", "f", ["x"], "y"), ("A", "g", [], "y")], s)
    a = spark.createDataFrame([("A", "f", ["z"], "y"), ("A", "h", [], None)], s)
    assert {tuple(r) for r in evolution.diff_operations(b, a).collect()} == {("A", "f", "signature", "breaking"), ("A", "g", "removed", "breaking"), ("A", "h", "added", "additive")}
    assert {tuple(r) for r in evolution.diff_variants(b, a).collect()} == {("A", "g", "removed", "breaking"), ("A", "h", "added", "conditional")}
    r = "owner string, identity string, target string"
    rows = evolution.diff_relationships(spark.createDataFrame([("A", "1", "B"), ("A", "2", "B")], r), spark.createDataFrame([("A", "1", "C"), ("A", "3", "B")], r)).collect()
    assert {(x.identity, x.change, x.classification) for x in rows} == {("1", "changed", "breaking"), ("2", "removed", "breaking"), ("3", "added", "conditional")}


def test_rounds_end_only_when_nothing_changes(spark):
    r = lambda o, *ts: record(o, relationships=[{"identity": ix(f"{o}{t}"), "category": "c", "composite": True, "target": ix(t)} for t in ts])
    d = docs(spark, d={"types": [r("A", "C"), r("X", "C"), r("C", "D"), r("D", "E"), r("E", "F"), r("F")]})
    assert {x.state for x in rules.owner_assignment(d).collect()} == {"refused"}
    with pytest.raises(ValueError):
        rules.owner_assignment(d, rounds=2)
    p = spark.createDataFrame([(x, "1.0.0", i) for i, x in enumerate("abcd")], "identity string, version string, ord long")
    imports = spark.createDataFrame([(a, "1.0.0", b, "^1.0.0") for a, b in ("ab", "bc", "cd")], "identity string, version string, target string, range string")
    with pytest.raises(ValueError):
        packages.resolve(p, imports, spark.createDataFrame([("a", "^1.0.0")], "identity string, range string"), rounds=2)
