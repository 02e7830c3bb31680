"""Lowering of Markdown bundles on texts of its own."""

import pytest

from clausula.operators import rules
from clausula.sources import artifacts, bundles

ROOT = "---\ntype: master-requirements\nname: shop\norg: acme\n---\n"
TABLE = "\n## Properties\n\n| Field | Type | Multiplicity | Constraints |\n|---|---|---|---|\n"


def entity(ident, name, *rows, kind="entity", extra="", edges=()):
    more = "".join(f"\n  - target: {t}\n    type: {v}" for t, v in edges)
    return f"---\nid: {ident}\ntitle: {name}\nobject: {kind}\n{f'relationships:{more}' if edges else ''}\n---\n# {ident}\n{TABLE}" + "".join(f"| {r} |\n" for r in rows) + extra


BUNDLES = {
    "ends": {"a.md": ROOT.replace("\n", "\r\n"), "b.md": entity("A", "Alpha", "x | String | 1 | nonEmpty", "y | Beta | 0..1 | nullable").replace("\n", "\r\n"), "c.md": entity("B", "Beta", "z | Alpha | * |").replace("\n", "\r")},
    "fences": {"a.md": ROOT, "b.md": "---\nid: A\ntitle: Alpha\nobject: entity\n---\n```\n## Properties\n| Field | Type |\n```\n~~~text\n### x\n~~~\n" + TABLE + "| x | Bytes | 1 | minLength: 2, nonEmpty |\n\n```\n| no | row |\n```\n\n## Properties\n\n| Field | Type |\n|-|-|\n| second | Lost |\n"},
    "cells": {"a.md": ROOT, "b.md": entity("A", "Alpha", "x | String | 1 | pattern: /^a\\|b,c$/, maxLength: 3", "short | String", "y | Decimal( 9 , 3 ) [EUR] | 2..4 | min: 0.5")},
    "names": {"a.md": ROOT, "b.md": entity("A", "Alpha", "x | Second Title | 1 |", "y | B | 1 |", "z | ix://acme/shop/B | 1 |", "w | Beta | 1 |"), "c.md": entity("B", "Second Title\nname: Beta", "k | UUID | 1 | identity")},
    "edges": {"a.md": ROOT, "b.md": entity("A", "Alpha", "x | String | 1 |", edges=[("B", "owns"), ("Beta", "owns"), ("B", "contains"), ("B", "unlisted")]), "c.md": entity("B", "Beta", "x | String | 1 |")},
    "two-roots": {"a.md": ROOT, "b.md": ROOT, "c.md": entity("A", "Alpha", "x | Lost | 1 |")},
    "no-text": {"a.md": ROOT, "b.md": None, "c.md": ""},
    "no-id": {"a.md": ROOT, "b.md": "---\ntitle: Alpha\nobject: entity\n---\n" + TABLE + "| x | String | 1 | |\n"},
    "many": {"a.md": ROOT, "b.md": entity("A", "Alpha", *[f"f{i} | String | 1 |" for i in range(6)])},
    "clauses": {"a.md": ROOT, "b.md": entity("A", "Alpha", "x | String | 1 |", extra="\n## Invariants\n\n### long\n\n```ocl\n" + "z" * 90 + "\n```\n")},
    "lines": {"a.md": ROOT, "b.md": entity("A", "Alpha", "x | String | 1 |", extra="\n## Invariants\n\n### k\n\n```ocl\n  one\n\n\ttwo\n```\n\n```ocl\nother\n```\n\n## Operations\n\n### go\n\nPre: k\n\n```\nReturns: Lost [1]\n```\n\nReturns: Decimal(4,1) [1]\n" + "\ntext of the description" * 500)},
    "stale": {"a.md": ROOT, "b.md": entity("A", "Alpha", "x | Old | 1 |"), "c.md": "---\nid: O\ntitle: Old\nobject: entity\n---\n## Properties\n\n- a list\n\n| Name | Type of it |\n|-|-|\n| a | b |\n"},
    "twin": {"a.md": ROOT, "b.md": entity("A-1", "Alpha", "x | String | 1 |"), "c.md": entity("A.1", "Beta", "x | String | 1 |"), "d.md": entity("?", "Gamma", "x | String | 1 |")},
}


@pytest.fixture(scope="module")
def lowered(spark):
    rows = [(b, path, text, 1, "k") for b, docs in BUNDLES.items() for path, text in docs.items()]
    files = spark.createDataFrame(rows, "bundle string, path string, text string, line int, kind string")
    kinds = spark.createDataFrame([("entity", "record", "shop", ["r"], ["owns", "contains"])], "object string, shape string, module string, roles array<string>, links array<string>")
    verbs = spark.createDataFrame([("owns", "o", "owned_by"), ("contains", "s", "part_of")], "verb string, category string, inverse string")
    return artifacts.lower(files, kinds, verbs, max_fields=5, max_clause_bytes=80)


@pytest.fixture(scope="module")
def of(lowered):
    cache = {}

    def rows(table, bundle, *columns):
        if table not in cache:
            cache[table] = getattr(lowered, table).collect()
        return sorted((tuple(r[c] for c in columns) for r in cache[table] if r.bundle == bundle), key=repr)

    return rows


def test_findings(of):
    got = {b: of("findings", b, "path", "line", "code") for b in BUNDLES}
    assert {b: f for b, f in got.items() if f} == {
        "ends": [("c.md", 13, "DECLARED_LOSS")],
        "two-roots": [("", 1, "BUNDLE_UNIDENTIFIED")],
        "no-id": [("b.md", 1, "BUNDLE_UNIDENTIFIED")],
        "many": [("b.md", 1, "LIMIT_MAX_FIELDS_PER_RECORD")],
        "clauses": [("b.md", 17, "LIMIT_MAX_CLAUSE_BYTES")],
        "stale": [("b.md", 13, "STALE_TYPE_TOKEN"), ("c.md", 1, "ARTIFACT_NOT_LOWERED")],
        "twin": [("c.md", 1, "UNSLUGGABLE_NAME"), ("d.md", 1, "UNSLUGGABLE_NAME")],
    }
    for b in ("two-roots", "no-id", "many", "clauses", "stale", "twin"):
        assert not of("types", b, "id") and not of("fields", b, "id")


def test_line_ends_and_references_both_ways(of):
    assert of("fields", "ends", "id", "name", "type_ref", "lower", "upper", "nullable") == [("A", "x", "ix://kernel/String", 1, 1, False), ("A", "y", "ix://acme/shop/B", 0, 1, True), ("B", "z", "ix://acme/shop/A", 0, None, False)]


def test_text_in_fences_is_no_structure(of):
    assert of("fields", "fences", "name", "line") == [("x", 18)]
    assert of("constraints", "fences", "keyword", "operand") == [("minLength", "2"), ("nonEmpty", "")]


def test_cells(of):
    assert of("constraints", "cells", "field", "keyword", "operand") == [("x", "maxLength", "3"), ("x", "pattern", "/^a|b,c$/"), ("y", "min", "0.5")]
    assert of("fields", "cells", "name", "lower", "upper", "precision", "scale", "unit") == [("short", 1, 1, None, None, None), ("x", 1, 1, None, None, None), ("y", 2, 4, 9, 3, "EUR")]


def test_an_artifact_goes_by_name_title_id_and_identity(of):
    assert [r[0] for r in of("fields", "names", "type_ref")] == ["ix://acme/shop/B"] * 4 + ["ix://kernel/UUID"]


def test_relationships(of):
    assert of("relationships", "edges", "id", "verb", "target", "composite") == [("A", "contains", "ix://acme/shop/B", True), ("A", "owns", "ix://acme/shop/B", False)]


def test_clauses_and_operations(of):
    assert of("clauses", "lines", "clause_id", "language", "text") == [("k", "ocl", "  one\n\n\ttwo")]
    assert of("operations", "lines", "name", "returns", "pre") == [("go", "ix://kernel/Decimal", ["k"])]


def test_documents_are_validated(lowered):
    docs = bundles.parsed(artifacts.assembled(lowered).where("doc_id IN ('ends', 'names', 'edges')"))
    assert rules.unresolved_references(docs).count() == rules.shape(docs).count() == rules.duplicate_identities(docs).count() == 0
    assert {(r.doc_id, r.display_name) for r in bundles.types(docs).where("kind = 'record'").collect()} == {(b, n) for b in ("ends", "names", "edges") for n in ("Alpha", "Beta")}


def test_empty_tables(spark):
    none = artifacts.lower(
        spark.createDataFrame([], "bundle string, path string, text string"),
        spark.createDataFrame([], "object string, shape string, module string, roles array<string>, links array<string>"),
        spark.createDataFrame([], "verb string, category string, inverse string"),
    )
    assert none.types.count() == none.findings.count() == 0
