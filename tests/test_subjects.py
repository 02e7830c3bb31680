"""Subjects through long chains, and documents of no use."""

import json

from clausula.operators import closure, subjects
from clausula.sources import trees


def tree(spark, *docs):
    return trees.nodes(spark.createDataFrame([(str(i), d if isinstance(d, str) or d is None else json.dumps({"ir": d}), 1) for i, d in enumerate(docs)], "doc_id string, text string, entry int"))


def found(df):
    return {(r.doc_id, r.pointer, r.code) for r in df.collect()}


def test_policy_at_the_end_of_a_long_chain(spark):
    n = 2000
    chain = [{"identity": f"ix://p/a{i}", "kind": "alias", "target": f"ix://p/a{i + 1}"} for i in range(n)]
    end = {"identity": f"ix://p/a{n}", "kind": "scalar", "scalar": "decimal", "decimal": {"precision": 4, "scale": 1}}
    field = {"identity": "ix://p/r", "kind": "record", "fields": [{"identity": "ix://p/r/f", "typeRef": "ix://p/a0", "constraints": [{"keyword": "max", "operands": {"value": "1000"}}]}]}
    assert found(subjects.findings(tree(spark, {"types": [*chain, end, field]}))) == {("0", f"/ir/types/{n + 1}/fields/0/constraints/0/operands/value", "INVALID_OPERAND")}
    again = {"types": [*chain[:-1], {**chain[-1], "decimal": {"precision": 4, "scale": 1}}, end]}
    got = found(subjects.findings(tree(spark, again)))
    assert len(got) == n and {c for *_, c in got} == {"DECIMAL_POLICY_CONFLICT"}


def test_carried_stops_at_cycles_and_lost_ends(spark):
    refs = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 9), (7, 7)], "src long, dst long")
    values = spark.createDataFrame([(2, "two"), (3, "three"), (6, "six")], "node long, value string")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 8)], "node long")
    got = {r.node: (r.terminal, r.n, r.first) for r in closure.carried(refs, values, nodes).collect()}
    assert {k: got[k] for k in (1, 2, 3, 6, 8)} == {1: (3, 2, "two"), 2: (3, 2, "two"), 3: (3, 1, "three"), 6: (None, 1, "six"), 8: (8, 0, None)}
    assert all(got[k][0] is None for k in (4, 5, 7))


def test_odd_documents(spark):
    odd = {"types": [None, 3, {}, {"identity": 5, "target": "x"}, {"identity": "ix://p/r", "kind": "record", "fields": [None, {"typeRef": "ix://p/none", "constraints": [None, {}, {"keyword": "min"}]}]}]}
    assert found(subjects.findings(tree(spark, None, "{", "[]", {}, odd))) == set()
    assert found(subjects.findings(tree(spark, {}).limit(0))) == set()
