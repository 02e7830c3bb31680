"""Queries of the surface of change, over pairs of documents that are made from the part table.

A pair's documents hold a fixed type and two more, whose forms (what stands before and after) the part's columns choose independently, and
an envelope. What a form changes is stated beside it, by places below its type; where a type comes or goes, the places of the next one move. The SQL joins these statements.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from clausula.operators import surface
from clausula.plans.tables import cut, load, spread


@dataclass
class Form:
    """Texts before and after (None: not there; @ is the identity of its own) and what changes: place, subject, kind, and the class where the kind alone does not say it."""

    before: str | None
    after: str | None
    changes: tuple[tuple, ...] = ()
    renamed: tuple[str, str] | None = None


def _type(members: str = "", identity: str = "@") -> str:
    return f'{{"identity":"{identity}","kind":"record"{"," if members else ""}{members}}}'


def _of(before: str, after: str, *changes: tuple) -> Form:
    return Form(_type(before), _type(after), changes)


def _field(before: str, after: str, *changes: tuple) -> Form:
    """A form of the second of two fields."""
    text = lambda m: _type('"fields":[{"identity":"@#w"},{"identity":"@#x"' + ("," if m else "") + m + "}]")
    return Form(text(before), text(after), tuple((f"/fields/1{at}", "@#x", kind) for at, kind in changes))


_REF, _E, _V, _O, _R, _C = '{"identity":"@#x","presence":"required"}', '{"identity":"e"}', '{"identity":"v","name":"a"}', '{"identity":"o","name":"go"}', '{"identity":"r","to":"w"}', '{"identity":"c","min":"1"}'
FORMS = [
    _of('"n":1.50', '"n":15e-1'),
    _of('"fields":[{"identity":"@#w"},{"identity":"@#w","unit":"m"}]', '"fields":[{"identity":"@#w"}]'),
    Form(None, _type(), (("", "@", "type-added"),)),
    Form(_type(), None, (("", "@", "type-removed"),)),
    Form(_type('"fields":[{"identity":"@.old#x"}]', "@.old"), _type('"fields":[{"identity":"@.new#x"}]', "@.new"), (("", "@.old", "type-removed"), ("", "@.new", "type-added")), ("@.old", "@.new")),
    Form(_type('"scalar":"x"', "@.old"), _type('"scalar":"y"', "@.new"), (("", "@.old", "type-removed"), ("", "@.new", "type-added"))),
    Form(_type(), _type().replace("record", "entity"), (("/kind", "@", "type-kind-changed"),)),
    _of('"scalar":"date"', '"scalar":"datetime"', ("/scalar", "@", "type-representation-changed")),
    _of('"target":"a","items":"b"', '"target":null,"items":"c"', ("/target", "@", "type-representation-changed"), ("/items", "@", "type-representation-changed")),
    _of('"displayName":"A"', '"displayName":"B"', ("/displayName", "@", "type-display-name-changed")),
    _of('"unknownPolicy":"surface"', '"unknownPolicy":"reject"', ("/unknownPolicy", "@", "type-unknown-policy-tightened")),
    _of('"unknownPolicy":"reject"', "", ("/unknownPolicy", "@", "type-unknown-policy-changed")),
    _of('"origin":{"line":1}', '"origin":{"line":2}', ("/origin", "@", "type-origin-changed")),
    _of('"clauses":["a"]', '"clauses":["b"]', (None, "@", "unmodelled")),
    _of("", f'"fields":[{_REF}]', ("/fields/0", "@#x", "field-added-required")),
    _of("", '"fields":[{"identity":"@#x"},{"none":1},{"identity":"@#y","presence":"optional"}]', ("/fields/0", "@#x", "field-added-required"), ("/fields/2", "@#y", "field-added-optional")),
    _of(f'"fields":[7,{_REF}]', '"fields":5', ("/fields/1", "@#x", "field-removed")),
    _field('"presence":"optional"', '"presence":"required"', ("/presence", "field-became-required")),
    _field('"presence":"required"', "", ("/presence", "field-became-optional")),
    _field('"nullable":1', '"nullable":true', ("/nullable", "field-nullability-changed")),
    _field('"nullable":null', '"nullable":false'),
    _field('"defaultKind":"literal","defaultValue":"1"', '"defaultKind":"literal","defaultValue":1', ("/defaultKind", "field-default-changed")),
    _field('"unit":"m"', '"unit":"ft"', ("/unit", "field-unit-changed")),
    _field('"name":"a"', '"name":"b"', ("/name", "field-name-changed")),
    _field('"typeRef":"w"', '"typeRef":"w.two"', ("/typeRef", "field-type-ref-rerepresented")),
    _field('"typeRef":"w"', '"typeRef":"gone"', ("/typeRef", "field-type-ref-retargeted")),
    _field('"typeRef":"gone"', '"typeRef":"w.gone"', ("/typeRef", "field-type-ref-rerepresented")),
    _field('"typeRef":"w.ring"', "", ("/typeRef", "field-type-ref-rerepresented")),
    _field('"multiplicity":{"lower":0,"upper":1}', '"multiplicity":{"lower":1,"upper":null}', ("/multiplicity/upper", "field-cardinality-changed")),
    _field('"multiplicity":{"unique":true}', '"multiplicity":{"ordered":true}', ("/multiplicity", "field-collection-flags-changed")),
    _field('"origin":1', '"origin":2', ("/origin", "field-origin-changed")),
    _of("", f'"variants":[{_V}]', ("/variants/0", "v", "variant-added")),
    _of(f'"variants":[{_V}]', '"variants":[]', ("/variants/0", "v", "variant-removed")),
    _of(f'"variants":[{_V}]', '"variants":[{"identity":"v","payloadType":"w","name":"b","note":1}]', ("/variants/0/payloadType", "v", "variant-payload-changed"), ("/variants/0/name", "v", "variant-name-changed")),
    _of("", f'"relationships":[{_R}]', ("/relationships/0", "r", "relationship-added")),
    _of(f'"relationships":[{_R}]', "", ("/relationships/0", "r", "relationship-removed")),
    _of(f'"relationships":[{_R}]', '"relationships":[{"identity":"q"},{"to":"v","identity":"r"}]', ("/relationships/0", "q", "relationship-added"), ("/relationships/1", "r", "relationship-changed")),
    _of("", f'"operations":[{_O}]', ("/operations/0", "o", "operation-added")),
    _of(f'"operations":[{_O}]', "", ("/operations/0", "o", "operation-removed")),
    _of(f'"operations":[{_O}]', '"operations":[{"identity":"o","name":"went","returns":{"a":1},"origin":1}]', ("/operations/0/returns", "o", "operation-changed"), ("/operations/0", "o", "operation-changed"), ("/operations/0/origin", "o", "field-origin-changed")),
    _of('"operations":[{"identity":"o","params":[{"identity":"p","unit":"m"},{"identity":"q"}]}]', '"operations":[{"identity":"o","params":[{"identity":"n","presence":"optional"},{"identity":"p","unit":"s"}]}]', ("/operations/0/params/0", "n", "field-added-optional"), ("/operations/0/params/1/unit", "p", "field-unit-changed"), ("/operations/0/params/1", "q", "field-removed")),
    _of("", f'"constraints":[{_C}]', ("/constraints/0", "c", "constraint-added")),
    _of(f'"constraints":[{_C}]', "", ("/constraints/0", "c", "constraint-removed")),
    _of(f'"constraints":[{_C}]', '"constraints":[{"min":"2","identity":"c"}]', ("/constraints/0", "c", "constraint-operands-changed")),
    _of("", '"extensions":[{"identity":"e","required":true},{"identity":"f"}]', ("/extensions/0", "e", "extension-added-required"), ("/extensions/1", "f", "extension-added-optional")),
    _of(f'"extensions":[{_E}]', "", ("/extensions/0", "e", "extension-removed")),
    _of(f'"extensions":[{_E}]', '"extensions":[{"identity":"e","x":1}]', ("/extensions/0", "e", "extension-changed")),
    _of(f'"extensions":[{_E}]', '"extensions":[{"identity":"e","required":true}]', ("/extensions/0", "e", "extension-changed", "breaking")),
    _of(f'"fields":[{{"identity":"@#x","extensions":[{_E}]}}]', '"fields":[{"identity":"@#x"}]', ("/fields/0/extensions/0", "e", "extension-removed")),
]
#: Forms of the envelope: members before and after, and changes by whole pointers.
ENVELOPES = [
    Form("", ""),
    Form('"source":{"identity":"s","version":"1"}', '"source":{"version":"2","identity":"t"}', (("/source/identity", "", "source-identity-changed"), ("/source", "", "source-provenance-changed"))),
    Form('"package":{"identity":"p","profileVersions":{"a":1}}', '"package":{"identity":"q","profileVersions":{"a":2}}', (("/package/identity", "", "package-identity-changed"), ("/package", "", "package-provenance-changed"))),
    Form('"package":{"note":1},"source":{"note":1}', '"package":{"note":2},"source":{"note":2}', (("", "", "unmodelled"),)),
    Form("", '"extensions":[{"identity":"d","required":true}]', (("/extensions/0", "d", "extension-added-required"),)),
    Form('"contractVersion":"1","zeta":null', '"contractVersion":"2"', (("", "", "unmodelled"),)),
    Form("", None, (("", "", "pair-inadmissible"),)),
]
_FIXED = ",".join(['{"identity":"w","kind":"scalar","scalar":"integer"}', '{"identity":"w.two","kind":"alias","target":"w.one"}', '{"identity":"w.one","kind":"alias","target":"w"}', '{"identity":"w.gone","kind":"alias","target":"gone"}', '{"identity":"w.ring","kind":"alias","target":"w.ring"}'])
_BASE = _FIXED.count('"kind"')
_N, _M = len(FORMS), len(ENVELOPES)
# What chooses the forms, in the words of both engines.
_I0, _I1, _ENV = f"(p_partkey % {_N})", f"(CAST(floor(p_partkey / {_N}) AS BIGINT) + p_size) % {_N}", f"(p_size % {_M})"
_POLICY = "CASE p_partkey % 5 WHEN 0 THEN 'preserve' WHEN 1 THEN 'surface' WHEN 2 THEN 'reject' END"


def _chosen(index: str, texts: list[str | None]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts) if t is not None) + " END"


def _pairs(spark, sf) -> DataFrame:
    def text(side: str) -> str:
        slot = lambda k, index: _chosen(index, [t and t.replace("@", f"s{k}") for t in (getattr(f, side) for f in FORMS)])
        return f"""concat('{{"types":[', concat_ws(',', '{_FIXED}', {slot(0, _I0)}, {slot(1, _I1)}), ']', {_chosen(_ENV, [t and "," + t if t is not None else None for t in (getattr(f, side) for f in ENVELOPES)])}, '}}')"""

    return spread(load(spark, sf, "part")).selectExpr("CAST(p_partkey AS BIGINT) AS pair_id", f"{text('before')} AS before", f"{text('after')} AS after", f"{_POLICY} AS policy")


def surface_changes(spark, sf) -> DataFrame:
    return surface.changes(_pairs(spark, sf))


def surface_changes_strict(spark, sf) -> DataFrame:
    """Variants added for consumers that admit no unknown ones break them."""
    return surface.changes(_pairs(spark, sf), closed="breaking")


def surface_verdicts(spark, sf) -> DataFrame:
    pairs = _pairs(spark, sf)
    return surface.verdicts(pairs, cut(surface.changes(pairs), "surface-changes"))


def surface_renames(spark, sf) -> DataFrame:
    return surface.renames(_pairs(spark, sf))


QUERIES: dict[str, Callable] = {f.__name__: f for f in (surface_changes, surface_changes_strict, surface_verdicts, surface_renames)}


def _rows(forms: list[Form]) -> str:
    rows = []
    for i, f in enumerate(forms):
        for at, subject, kind, *cls in f.changes:
            # a type that left stands at its place before, all else at places after
            side = "b" if kind == "type-removed" else "a"
            place = "NULL" if at is None else f"'{at}'"
            rows.append(f"({i}, {place}, '{subject}', '{kind}', '{cls[0] if cls else surface.KINDS[kind]}', '{side}')")
    return ", ".join(rows)


def _sql(closed: str) -> str:
    there = lambda side: f"CASE WHEN i0 IN ({', '.join(str(i) for i, f in enumerate(FORMS) if getattr(f, side) is None)}) THEN 0 ELSE 1 END"
    return f"""
WITH f(i, place, who, kind, cls, side) AS (VALUES {_rows(FORMS)}), g(i, place, who, kind, cls, side) AS (VALUES {_rows(ENVELOPES)}),
p AS (SELECT p_partkey AS pair_id, {_I0} AS i0, {_I1} AS i1, {_ENV} AS env, {_POLICY} AS policy FROM part),
s AS (SELECT *, 0 AS slot, i0 AS i, 0 AS b, 0 AS a FROM p UNION ALL SELECT *, 1, i1, {there("before")}, {there("after")} FROM p),
r AS (
  SELECT pair_id, policy, CASE WHEN place IS NULL THEN '/types' ELSE '/types/' || ({_BASE} + CASE side WHEN 'b' THEN b ELSE a END) || place END AS pointer, replace(who, '@', 's' || slot) AS subject, kind, cls FROM s JOIN f USING (i) WHERE env <> {_M - 1}
  UNION ALL SELECT pair_id, policy, place, who, kind, cls FROM p JOIN g ON p.env = g.i),
c AS (SELECT pair_id, pointer, subject, kind, CASE WHEN cls NOT IN ('optional', 'variant') THEN cls WHEN coalesce(policy IN ('preserve', 'surface'), false) THEN 'additive' WHEN cls = 'optional' THEN 'conditional' ELSE '{closed}' END AS classification FROM r)"""


# A plain type that left one slot and one that came in the other are the same type by another name.
_LEFT, _CAME = next(i for i, f in enumerate(FORMS) if f.after is None), next(i for i, f in enumerate(FORMS) if f.before is None)
_RENAMED = [(i, *f.renamed) for i, f in enumerate(FORMS) if f.renamed]
SQL: dict[str, str] = {
    "surface_changes": _sql("conditional") + " SELECT * FROM c",
    "surface_changes_strict": _sql("breaking") + " SELECT * FROM c",
    "surface_verdicts": _sql("conditional") + """, k(classification, n) AS (VALUES ('patch', 1), ('additive', 2), ('conditional', 3), ('unknown', 4), ('breaking', 5), ('invalid', 6)),
m AS (SELECT pair_id, max(n) AS n, count(*) AS changes FROM c JOIN k USING (classification) GROUP BY 1)
SELECT pair_id, coalesce(k.classification, 'patch') AS classification, coalesce(changes, 0) AS changes FROM p LEFT JOIN m USING (pair_id) LEFT JOIN k ON k.n = m.n""",
    "surface_renames": _sql("conditional") + f""", w(i, was, now) AS (VALUES {', '.join(str(x) for x in _RENAMED)})
SELECT pair_id, replace(was, '@', 's' || slot) AS before, replace(now, '@', 's' || slot) AS after FROM s JOIN w USING (i) WHERE i0 <> i1 AND env <> {_M - 1}
UNION ALL SELECT pair_id, CASE i0 WHEN {_LEFT} THEN 's0' ELSE 's1' END, CASE i0 WHEN {_LEFT} THEN 's1' ELSE 's0' END FROM p WHERE env <> {_M - 1} AND (i0, i1) IN (({_LEFT}, {_CAME}), ({_CAME}, {_LEFT}))""",
}
