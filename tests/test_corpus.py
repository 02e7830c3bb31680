"""A corpus of case files, its documents, and a run of two adapters over it."""

import json

import pytest

from clausula.operators import differential
from clausula.sources import corpus

BASE = {"ir": {"types": [{"identity": "ix://p/T", "kind": "scalar"}]}}
LOOP = {"op": "add", "path": "/ir/types/-", "value": {"identity": "ix://p/L", "kind": "alias", "target": "ix://p/L"}}
CASES = {
    "r/1.json": {"id": "R1", "family": "recursion", "class": "negative", "kind": "document", "base": "core", "ops": [LOOP], "covers": ["C1", "C2"], "expected": {"resultState": "invalid", "diagnostics": [{"code": "ALIAS_CYCLE", "pointer": "/ir/types/1/target"}]}},
    "r/2.json": {"id": "R2", "family": "recursion", "class": "positive", "kind": "document", "base": "core", "expected": {"resultState": "success", "diagnostics": []}},
    "c/3.json": {"id": "C3", "family": "compatibility", "class": "positive", "kind": "diff", "base": "core", "ops": [LOOP], "beforeBase": "core", "expected": {"resultState": "success", "classification": "equal"}},
    "c/4.json": {"id": "C4", "family": "compatibility", "kind": "document", "base": "none"},
    "c/5.json": {"id": "C5", "kind": "document", "base": "core", "ops": [{"op": "remove", "path": "/ir/gone"}]},
    "c/6.json": "{",
    "c/7.json": {"title": "no id"},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("cases")
    for name, case in CASES.items():
        (at / name).parent.mkdir(exist_ok=True)
        (at / name).write_text(case if isinstance(case, str) else json.dumps(case))
    return str(at)


def test_cases(spark, folder):
    found = corpus.cases(corpus.read_texts(spark, folder)).cache()
    assert sorted(r.case_id for r in found.where("well_formed").collect()) == ["C3", "C4", "C5", "R1", "R2"] and found.count() == 7
    ids = lambda **k: sorted(r.case_id for r in corpus.listed(found, **k).collect())
    assert ids(family="recursion") == ["R1", "R2"] and ids(class_="negative") == ["R1"] and ids(kind="diff") == ["C3"] and ids(covers="C2") == ["R1"]
    bases = spark.createDataFrame([("core", json.dumps(BASE))], "base string, text string")
    docs = {(r.case_id, r.side): (r.text and len(json.loads(r.text)["ir"]["types"]), r.problem) for r in corpus.materialised(found, bases).collect()}
    assert docs == {("R1", "after"): (2, None), ("R2", "after"): (1, None), ("C3", "after"): (2, None), ("C3", "before"): (1, None), ("C4", "after"): (None, "MISSING_BASE"), ("C5", "after"): (None, "PATCH_FAILED")}
    assert [tuple(r) for r in corpus.expected(found).collect()] == [("R1", "/ir/types/1/target", "ALIAS_CYCLE")]


def test_a_stream_of_case_files(spark, folder, tmp_path):
    q = corpus.cases(corpus.read_texts(spark, folder, stream=True)).where("well_formed").select("case_id").writeStream.format("memory").queryName("case_stream").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.case_id for r in spark.table("case_stream").collect()) == ["C3", "C4", "C5", "R1", "R2"]


def test_run(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    cases = frame([("1", "invalid"), ("2", "success"), ("3", None)], "case_id string, state string")
    expected = frame([("1", "/a", "X"), ("1", None, "Y")], "case_id string, pointer string, code string")
    answers = frame([("a", "1", "invalid"), ("a", "2", "success"), ("a", "3", None), ("b", "1", "invalid"), ("b", "2", "invalid"), ("b", "9", "success"), ("z", "1", "invalid")], "adapter string, case_id string, state string")
    findings = frame([("a", "1", None, "Y"), ("a", "1", "/a", "X"), ("a", "1", "/a", "X"), ("b", "1", "/a", "Z"), ("z", "1", "/a", "X")], "adapter string, case_id string, pointer string, code string")
    r = differential.run(cases, expected, answers, findings, frame([("a",), ("b",)], "adapter string")).cache()
    got = {(x.adapter, x.case_id): (x.status, x.missing, x.extra) for x in r.collect()}
    assert got == {("a", "1"): ("matched", [], []), ("a", "2"): ("matched", [], []), ("a", "3"): ("matched", [], []), ("b", "1"): ("findings", [" Y", "/a X"], ["/a Z"]), ("b", "2"): ("state", [], []), ("b", "3"): ("unanswered", [], []), ("b", "9"): ("unknown", [], []), ("z", "1"): ("unknown", [], [])}
    kinds = {tuple(x) for x in differential.unmet(r, frame([("b", "1"), ("a", "1")], "adapter string, case_id string")).collect()}
    assert kinds == {("b", "1", "findings", "declared"), ("b", "2", "state", "new"), ("b", "3", "unanswered", "new"), ("a", "1", None, "stale")}
    assert {(x.case_id, x.verdicts, x.adapters) for x in differential.disagreements(answers, findings).collect()} == {("1", 3, 3), ("2", 2, 2)}
    assert differential.run(cases.limit(0), expected.limit(0), answers.limit(0), findings.limit(0), frame([], "adapter string")).count() == 0
