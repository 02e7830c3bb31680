"""The JSON Schema source on texts of its own: nodes, keywords, shapes, names, references, whole bundles."""

import json

import pytest

from clausula.operators import rules
from clausula.sources import bundles, json_schema, trees

SEAL = {"unevaluatedProperties": {"not": {}}}


TAG = lambda n: {"type": "object", "properties": {"kind": {"const": n}}, "required": ["kind"], **SEAL}
ONE = {"oneOf": [TAG("p"), TAG("q")]}
FAULTS = {
    "open": ({"type": "object"}, "/unevaluatedProperties"),
    "half-open": ({"type": "object", "unevaluatedProperties": {"not": {"type": "string"}}}, "/unevaluatedProperties"),
    "identity": ({"type": "string", "x-semantic-id": "ix://kernel/Z"}, "/x-semantic-id"),
    "beside": ({"oneOf": [], "type": "object"}, "/oneOf"),
    "branches": ({"oneOf": [{"type": "string"}, {"type": "number"}]}, "/oneOf"),
    "any": ({"anyOf": [{"$ref": "B.json"}, {}]}, "/anyOf"),
    "kind": ({"type": "number"}, ""),
    "broken": ("{", ""),
    "null": (None, ""),
    "list": ("[]", ""),
    "repeated": ('{"type":"string","type":"string"}', ""),
}
BUNDLES = {
    "keywords": {"A": {"type": "object", "properties": {"format": {"type": "string"}, "x": {"format": "date", "type": "string"}}, "default": {"deep": 1}, **SEAL}},
    "places": {"A": {"type": "object", "properties": {"oneOf": {"type": "string"}, "u": ONE, "l": {"type": "array", "items": ONE}}, **SEAL}, "B": ONE},
    "misplaced": {"A": {"type": "object", "properties": {"u": {"type": "string", "items": ONE}, "v": {"not": ONE}}, **SEAL}},
    "names": {"Own": {"type": "object", "properties": {"ßa": {"type": "number"}, "😀x": {"type": "boolean"}, "Up": {"type": "string", "const": "c", "description": "d"}}, **SEAL}},
    "versionless": {"A": {"$id": "https://x/A.json", "type": "string"}},
    "whole": {"A": {"type": "object", "properties": {"n": {"type": "integer", "minimum": -3}, "b": {"$ref": "https://x/1.0.0/B.json"}, "any": {}}, "required": ["n"], **SEAL}, "B": {"type": "string", "enum": ["x", "y"]}},
    **{name: {"A": {"type": "string"}, "B": schema} for name, (schema, _) in FAULTS.items()},
}


@pytest.fixture(scope="module")
def files(spark):
    """All bundles; a schema gets $id and identity unless it states them. Columns of other names come along."""
    rows = []
    for name, schemas in BUNDLES.items():
        for file, s in schemas.items():
            if isinstance(s, dict):
                s = json.dumps({"$id": f"https://x/1.0.0/{file}.json", "x-semantic-id": f"ix://kernel/{file}", **s}, ensure_ascii=False)
            rows.append((name, f"{file}.json", s, "other", 1))
    return spark.createDataFrame(rows, "bundle string, file string, text string, name string, pos int")


@pytest.fixture(scope="module")
def lowered(files):
    return json_schema.lower(files)


@pytest.fixture(scope="module")
def loci(lowered):
    rows = lowered.findings.collect()
    return lambda name: sorted((r.code, r.locus) for r in rows if r.bundle == name)


def rows_of(df, name, *columns):
    return {tuple(r) for r in df.where(df.bundle == name).select(*columns).collect()}


def test_nodes(spark):
    texts = spark.createDataFrame([("a", '{"x/y":[1.50,{"~":null}],"t":true,"n":12345678901234567890}', 7), ("b", "{", 7), ("c", None, 7), ("d", '"s"', 7), ("e", "[NaN]", 7)], "doc_id string, text string, pointer int")
    got = {(r.doc_id, r.pointer): (r.kind, r.value, r.pos, r.parent) for r in trees.nodes(texts).collect()}
    assert got == {
        ("a", ""): ("object", None, 0, None), ("a", "/x~1y"): ("array", None, 0, ""), ("a", "/x~1y/0"): ("number", "1.50", 0, "/x~1y"), ("a", "/x~1y/1"): ("object", None, 1, "/x~1y"),
        ("a", "/x~1y/1/~0"): ("null", None, 0, "/x~1y/1"), ("a", "/t"): ("boolean", "true", 1, ""), ("a", "/n"): ("number", "12345678901234567890", 2, ""),
        ("b", ""): ("malformed", None, 0, None), ("c", ""): ("malformed", None, 0, None), ("d", ""): ("string", "s", 0, None), ("e", ""): ("malformed", None, 0, None),
    }
    assert trees.nodes(texts.limit(0)).count() == 0


def test_deep_and_wide_texts(spark):
    deep = "[" * 900 + "]" * 900
    wide = json.dumps({str(i): i for i in range(30_000)})
    tree = trees.nodes(spark.createDataFrame([("deep", deep), ("wide", wide)], "doc_id string, text string"))
    assert {r.doc_id: r["count"] for r in tree.groupBy("doc_id").count().collect()} == {"deep": 900, "wide": 30_001}


def test_keywords_and_names_of_members(lowered, loci):
    assert loci("keywords") == [("UNSUPPORTED_SCHEMA_KEYWORD", "A.json/default"), ("UNSUPPORTED_SCHEMA_KEYWORD", "A.json/properties/x/format")]
    assert not rows_of(lowered.types, "keywords", "name") and not rows_of(lowered.fields, "keywords", "name")


def test_one_of_has_three_places(lowered, loci):
    assert loci("places") == []
    assert rows_of(lowered.types, "places", "name", "kind") == {("A", "record"), ("AOneOf", "scalar"), ("AU", "union"), ("AL", "union"), ("B", "union")}
    assert loci("misplaced") == [("UNSUPPORTED_SCHEMA_SHAPE", "A.json/properties/u/items/oneOf"), ("UNSUPPORTED_SCHEMA_SHAPE", "A.json/properties/v/not/oneOf")]


def test_faults_of_files(loci):
    assert {name: loci(name) for name in FAULTS} == {name: [("UNSUPPORTED_SCHEMA_SHAPE", f"B.json{place}")] for name, (_, place) in FAULTS.items()}


def test_names_come_from_owner_and_property_alone(lowered):
    assert rows_of(lowered.types, "names", "name") == {("Own",), ("OwnSSa",), ("Own😀x",), ("OwnUp",)}
    assert rows_of(lowered.fields, "names", "pos", "name") == {(0, "ßa"), (1, "😀x"), (2, "Up")}


def test_no_version(loci):
    assert loci("versionless") == [("UNSUPPORTED_SCHEMA_SHAPE", "/documents")]


def test_empty_table(files):
    nothing = json_schema.lower(files.limit(0))
    assert nothing.types.count() == nothing.findings.count() == 0


def test_documents_are_validated(spark, lowered):
    docs = bundles.parsed(json_schema.assembled(lowered).where("doc_id = 'whole'"))
    assert rules.validated(docs).count() == 0
    assert [(r.identity, r.kind) for r in bundles.types(docs).orderBy("pos").collect()] == [("ix://kernel/A", "record"), ("ix://kernel/AAny", "record"), ("ix://kernel/AN", "scalar"), ("ix://kernel/B", "enum")]
    assert [(r.name, r.type_ref, r.presence) for r in bundles.fields(docs).orderBy("pos").collect()] == [("n", "ix://kernel/AN", "required"), ("b", "ix://kernel/B", "optional"), ("any", "ix://kernel/AAny", "optional")]
    register = spark.createDataFrame([("A.other", "unconstrained-value")], "construct string, loss string")
    assert rows_of(json_schema.decided(lowered.losses, register), "whole", "construct", "outcome", "code") == {("A.any", "refused", "UNSUPPORTED_LOSS")}


def test_references_become_local(spark):
    files = spark.createDataFrame([("b", "A.json", '{"$ref": "https://x/1.0.0/B.json", "y": {"$ref":"https://other/C.json"}, "z": {"$ref":"https://x/D.json"}}')], "bundle string, file string, text string")
    got = json_schema.localised(files, "https://x").first()
    assert json.loads(got.text) == {"$ref": "B.json", "y": {"$ref": "https://other/C.json"}, "z": {"$ref": "D.json"}} and got.n_rewritten == 2
