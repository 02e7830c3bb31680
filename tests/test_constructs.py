"""Construct rules on documents of their own."""

import json

from clausula.operators import constructs
from clausula.sources import trees


def found(spark, *docs, **more):
    rows = [(str(i), d if isinstance(d, str) or d is None else json.dumps({"ir": d}), 1) for i, d in enumerate(docs)]
    texts = spark.createDataFrame(rows, "doc_id string, text string, entry int")
    package = texts.selectExpr("doc_id", "'p' AS package")
    return {(r.doc_id, r.pointer, r.code) for r in constructs.findings(trees.nodes(texts), package, **more).collect()}


def test_odd_documents(spark):
    kind = {"kind": {"module": "m", "name": "k"}, "construct": {"identity": "none", "shape": "record", "members": {}, "meaning": "x"}}
    odd = {"constructs": [kind, kind], "types": [None, 5, [], {}, {"kind": {"module": "m"}}, {"identity": "ix://p/a", "kind": {"module": "m", "name": "k"}, "fields": "none", "supertypes": ["ix://p/a"], "operations": [None, {"frame": []}]}]}
    faulty = {"constructs": [{"kind": {"module": "m", "name": "k"}, "construct": {"identity": "none"}}], "types": [{"identity": "ix://p/a", "kind": {"module": "m", "name": "k"}, "owner": "ix://p/b"}]}
    assert found(spark, None, "{", "[]", {}, {"types": []}, odd, faulty) == {
        ("5", "/ir/types/4/kind", "SCHEMA_VIOLATION"),
        ("5", "/ir/types/5/supertypes", "SUPERTYPE_CYCLE"),
        ("6", "/ir/constructs/0/construct", "SCHEMA_VIOLATION"),  # others of this document are not looked at
    }


def test_empty_table(spark):
    texts = spark.createDataFrame([], "doc_id string, text string")
    assert constructs.findings(trees.nodes(texts), texts.selectExpr("doc_id", "text AS package")).count() == 0


def test_paths_of_a_vocabulary():
    assert constructs.vocabulary({"owner": (), "steps": ("emits",)}) == {"owner": "owner", "owner.*": "owner", "steps.*.emits": "steps", "steps.*.emits.*": "steps", "steps.emits": "steps", "steps.emits.*": "steps"}


def test_unenforced_members(spark):
    doc = {"ir": {"types": [{"identity": "ix://p/a", "clauses": [{"clauseId": "k"}]}, {"identity": "ix://p/b", "clauses": [{"clauseId": "k"}], "operations": [{"frame": {"modifies": []}}], "transitions": [{"guard": "g"}]}]}}
    texts = spark.createDataFrame([("d", json.dumps(doc))], "doc_id string, text string")
    got = {(r.member, r.pointer) for r in constructs.unenforced(constructs.Contract(trees.nodes(texts))).collect()}
    assert got == {("clauses", "/ir/types/0/clauses"), ("frames", "/ir/types/1/operations/0/frame"), ("transitions", "/ir/types/1/transitions"), ("guards", "/ir/types/1/transitions/0/guard")}


def test_opened_trees_are_whole_trees(spark):
    """Entries of collections as the rules see them, from a tree opened in one walk and from the whole node table; odd texts and names too."""
    from clausula.operators.constructs import _below
    from clausula.sources import trees

    odd = {"a.b": [{"c~/d": 1.50}], "": None, "members": {"x/y": ["r", True, {}]}, "list": [[], [[2]]], "0": 0}
    texts = [
        json.dumps({"ir": {"types": [odd, "s", None, [1, {"k": "v"}], 7], "constructs": [{"construct": {"references": {"o~w/n": ["a"]}}}], "other": [1]}}),
        '{"ir":{"types":{"0":{"kind":"x"}},"constructs":[]}}', '{"ir":[{"types":[1]}]}', '[{"types":[1]}]', "{", "7", None, '{"ir":{"types":[{"a":1,"a":2}]}}', '{"ir":null}',
    ]
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    for name in ("types", "constructs"):
        a, b = (sorted(_below(t, name).collect(), key=repr) for t in (trees.nodes(texts), trees.entries(texts, "types", "constructs")))
        assert a == b and len(a) >= 5


def test_documents_of_a_small_table_go_to_all_cores(spark, small):
    """A part becomes a document of hundreds of nodes: one file of parts must not be one task."""
    from clausula.plans import construct_docs

    for query in construct_docs.QUERIES.values():
        got = []
        real, construct_docs.trees.entries = construct_docs.trees.entries, lambda texts, *names: got.append(texts.rdd.getNumPartitions()) or real(texts, *names)
        try:
            query(spark, small)
        finally:
            construct_docs.trees.entries = real
        assert got and min(got) >= spark.sparkContext.defaultParallelism
