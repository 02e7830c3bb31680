"""Rewritten node tables against rewritten values."""

import json
import random

from clausula.functions.documents import canonical
from clausula.operators import rewriting
from clausula.sources import trees


def value(r, depth=0):
    kind = r.randrange(9 if depth < 4 else 6)
    if kind == 0:
        return r.choice([None, True, False])
    if kind in (1, 2):
        return r.choice([0, -0.0, 1.5, 1e21, 123456789, -2.5e-7, 100, 1e-6, 5e-324])
    if kind < 6:
        return "".join(r.choice('aé😀"\\/~\n\t\u0001 z') for _ in range(r.randrange(5)))
    if kind < 8:
        return {"".join(r.choice("ab/~é😀Z") for _ in range(r.randrange(3))): value(r, depth + 1) for _ in range(r.randrange(5))}
    return [value(r, depth + 1) for _ in range(r.randrange(14))]


def table(spark, values):
    return trees.nodes(spark.createDataFrame([(str(i), v if isinstance(v, str) else json.dumps(v), "x") for i, v in enumerate(values)], "doc_id string, text string, kind string"))


def test_texts_are_canonical(spark):
    r = random.Random(7)
    values = [{"v": value(r)} for _ in range(150)] + [[], {}, [[]], {"": {}}]
    got = {x.doc_id: x.text for x in rewriting.texts(table(spark, values)).collect()}
    assert got == {str(i): canonical(v) for i, v in enumerate(values)}
    assert rewriting.texts(table(spark, ["{", "5", '"s"', "null"])).orderBy("doc_id").collect() == [("1", "5"), ("2", '"s"'), ("3", "null")]


def test_members_go_everywhere_or_in_one_place(spark):
    doc = {"ir": {"origin": 1, "types": [{"origin": {"a": 1}, "doc": "d", "fields": [{"origin": 2, "doc": "e", "name": "origin"}]}], "doc": "f"}}
    tree = table(spark, [doc])
    assert json.loads(rewriting.texts(rewriting.dropped(tree, "origin")).first().text) == {"ir": {"types": [{"doc": "d", "fields": [{"doc": "e", "name": "origin"}]}], "doc": "f"}}
    assert json.loads(rewriting.texts(rewriting.dropped(tree, "doc", below=r"ir\.types\.\*(?:\.fields\.\*)?")).first().text) == {"ir": {"origin": 1, "types": [{"origin": {"a": 1}, "fields": [{"origin": 2, "name": "origin"}]}], "doc": "f"}}


def test_parameters_and_odd_members(spark):
    doc = {"ir": {"types": [{"operations": [{"params": [{"name": "p", "nullable": True}, 5, {"nullable": [1, {"x": 2}]}]}, None], "fields": {"nullable": 3}}], "canonicalization": {"old": [1]}}}
    want = {"ir": {"types": [{"operations": [{"params": [{"name": "p", "nullable": True}, 5, {"nullable": False}]}, None], "fields": {"nullable": 3}}], "canonicalization": {"algorithm": "rfc8785-v1"}}}
    assert rewriting.normalised(table(spark, [doc])).first().text == canonical(want)


def test_lists_in_order_of_identity(spark):
    doc = {"types": [{"identity": "b", "fields": [{"identity": "z"}, {"identity": "é"}, {"identity": "a", "v": [3, 1]}]}, {"none": 1}, {"identity": "a", "fields": []}, {"identity": ""}, {"identity": "😀"}]}
    tree = rewriting.ordered_by(rewriting.ordered_by(table(spark, [doc]), ["doc_id"], "types"), ["doc_id"], "types.*.fields")
    want = {"types": [{"identity": "a", "fields": []}, {"identity": "b", "fields": [{"identity": "a", "v": [3, 1]}, {"identity": "z"}, {"identity": "é"}]}, {"identity": "😀"}, {"identity": ""}, {"none": 1}]}
    assert rewriting.texts(tree).first().text == canonical(want)


def test_residue_and_comparison(spark):
    tree = table(spark, [{"types": [{"identity": "a", "kind": "k", "x": {"kind": 1}}, 7, {"kind": "k"}]}])
    assert {(r.pointer, r.text) for r in rewriting.residue(tree, "types.*", ("identity", "kind")).collect()} == {("/types/0", '{"x":{"kind":1}}'), ("/types/1", "7"), ("/types/2", "{}")}
    a, b = table(spark, [{"ir": {"a": 1, "origin": 2}}, {"ir": {"a": 1}}, {"ir": {"a": 1}}]), table(spark, [{"ir": {"a": 1.0}}, {"ir": {"a": 2}}])
    assert {(r.doc_id, r.same) for r in rewriting.compared(a, b).collect()} == {("0", True), ("1", False), ("2", None)}
