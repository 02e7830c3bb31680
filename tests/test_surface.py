"""The surface of pairs of documents against a walk over the two values."""

import copy
import json
import random

from clausula.functions.documents import canonical
from clausula.operators import surface

GONE = object()


def field(r, i):
    return {"identity": f"f{i}", "name": f"n{i}", "typeRef": r.choice("abcdex"), "presence": r.choice(["required", "optional"]), "nullable": r.choice([True, False, None, 1]), "multiplicity": {"upper": r.choice([1, None, 2]), "ordered": r.choice([True, False])}}


def kind(r, i):
    t = {"identity": "abcdefg"[i], "displayName": f"T{i}", "kind": r.choice(["record", "alias", "alias", "scalar"]), "target": r.choice("abcdex"), "scalar": r.choice(["integer", "decimal"])}
    t["fields"] = [field(r, r.randrange(4)) for _ in range(r.randrange(4))]
    t["operations"] = [{"identity": f"o{j}", "name": "go", "params": [field(r, r.randrange(3)) for _ in range(2)], "returns": r.choice([None, "a"])} for j in range(r.randrange(3))]
    for name in ("variants", "relationships", "constraints", "extensions"):
        t[name] = [{"identity": f"{name[0]}{r.randrange(3)}", "required": r.choice([True, False]), "name": r.choice("xy")} for _ in range(r.randrange(3))]
    return t


def document(r):
    return {"source": {"identity": "s", "version": "1"}, "package": {"identity": "p", "version": "1"}, "extensions": [{"identity": "e", "required": False}], "types": [kind(r, i) for i in range(r.randrange(1, 6))] + [5, {"kind": "record"}]}


def mutate(r, x):
    """One change somewhere in a value."""
    places = []

    def walk(v):
        for k in v if isinstance(v, dict) else range(len(v)):
            places.append((v, k))
            if isinstance(v[k], (dict, list)):
                walk(v[k])

    walk(x)
    v, k = r.choice(places)
    how = r.randrange(4)
    if how == 0:
        del v[k]
    elif how == 1 and isinstance(v, dict):
        v[r.choice(["extra", "origin", "unit", "defaultValue", "unknownPolicy", "required", "mappingVersions", "pre", "returns", "payloadType"])] = r.choice([1, 1.0, "reject", "preserve", None, {"a": [1]}])
    elif isinstance(v, list):
        v.insert(r.randrange(len(v) + 1), copy.deepcopy(r.choice(v)))
        r.shuffle(v) if how == 2 else None
    else:
        v[k] = r.choice(["a", "b", "required", "optional", True, False, 3, None, [], {}])


def walked(before, after, policy, closed):
    """(pointer, subject, kind, classification) of a pair, as a list in order."""
    if not (isinstance(before, dict) and isinstance(after, dict)):
        return [("", "", "pair-inadmissible", "invalid")]
    out = []
    same = lambda x, y: x is y or (x is not GONE and y is not GONE and canonical(x) == canonical(y))
    get = lambda v, k: v.get(k, GONE) if isinstance(v, dict) else GONE
    admits = policy in ("preserve", "surface")

    def put(at, who, name, cls=None):
        cls = cls or surface.KINDS[name]
        cls = ("additive" if admits else "conditional" if cls == "optional" else closed) if cls in ("optional", "variant") else cls
        out.append((at, who, name, cls))

    def listed(v, name):
        found = {}
        for i, x in enumerate(get(v, name) if isinstance(get(v, name), list) else []):
            if isinstance(x, dict) and isinstance(x.get("identity"), str):
                found.setdefault(x["identity"], (i, x))
        return found

    kinds = [{k: x for k, (_, x) in listed(v, "types").items()} for v in (before, after)]

    def shape(side, ref):
        seen = set()
        while isinstance(ref, str) and ref not in seen:
            seen.add(ref)
            if ref not in kinds[side]:
                return "unresolved"
            t = kinds[side][ref]
            if get(t, "kind") != "alias":
                return canonical([None if get(t, m) is GONE else t[m] for m in surface.SHAPE])
            ref = get(t, "target")
        return "cyclic"

    def rest(role, b, a):
        lists = surface.LISTS.get(role, {})
        own = [k for k in {*b, *a} if k not in surface.MODELLED[role] and k not in lists]
        return any(not same(get(b, k), get(a, k)) for k in own)

    def compare(role, b, a, at, who):
        differ = lambda *names: any(not same(get(b, n), get(a, n)) for n in names)
        if role == "type":
            for members, name in ((("kind",), "type-kind-changed"), *(((m,), "type-representation-changed") for m in surface.SHAPE[1:]), (("displayName",), "type-display-name-changed"), (("origin",), "type-origin-changed")):
                if differ(*members):
                    put(f"{at}/{members[0]}", who, name)
            if differ("unknownPolicy"):
                put(f"{at}/unknownPolicy", who, "type-unknown-policy-tightened" if get(a, "unknownPolicy") == "reject" else "type-unknown-policy-changed")
        if role in ("field", "parameter"):
            if differ("presence"):
                put(f"{at}/presence", who, "field-became-required" if get(a, "presence") == "required" else "field-became-optional")
            if (get(b, "nullable") is True) != (get(a, "nullable") is True):
                put(f"{at}/nullable", who, "field-nullability-changed")
            for members, name in ((("defaultKind", "defaultValue"), "field-default-changed"), (("unit",), "field-unit-changed"), (("name",), "field-name-changed"), (("origin",), "field-origin-changed")):
                if differ(*members):
                    put(f"{at}/{members[0]}", who, name)
            if differ("typeRef"):
                put(f"{at}/typeRef", who, "field-type-ref-rerepresented" if shape(0, get(b, "typeRef")) == shape(1, get(a, "typeRef")) else "field-type-ref-retargeted")
            m, n = get(b, "multiplicity"), get(a, "multiplicity")
            if not same(get(m, "upper"), get(n, "upper")):
                put(f"{at}/multiplicity/upper", who, "field-cardinality-changed")
            if not same(get(m, "ordered"), get(n, "ordered")) or not same(get(m, "unique"), get(n, "unique")):
                put(f"{at}/multiplicity", who, "field-collection-flags-changed")
        if role == "variant":
            if differ("payloadType"):
                put(f"{at}/payloadType", who, "variant-payload-changed")
            if differ("name"):
                put(f"{at}/name", who, "variant-name-changed")
        if role == "operation":
            if differ("returns"):
                put(f"{at}/returns", who, "operation-changed")
            if differ("name", "pre", "post"):
                put(at, who, "operation-changed")
            if differ("origin"):
                put(f"{at}/origin", who, "field-origin-changed")
        if role in ("constraint", "relationship") and not same(b, a):
            put(at, who, f"{role}-{'operands-' if role == 'constraint' else ''}changed")
        if role == "extension" and not same(b, a):
            put(at, who, "extension-changed", "breaking" if get(b, "required") is not True and get(a, "required") is True else None)
        if role in ("type", "field") and rest(role, b, a):
            put("/types", who, "unmodelled")
        for name, inner in surface.LISTS.get(role, {}).items():
            x, y = listed(b, name), listed(a, name)
            noun = "field" if inner == "parameter" else inner
            for k in {*x, *y}:
                if k not in y:
                    put(f"{at}/{name}/{x[k][0]}", k, f"{noun}-removed")
                elif k not in x:
                    i, v = y[k]
                    optional = get(v, "presence") == "optional" if noun == "field" else get(v, "required") is not True
                    put(f"{at}/{name}/{i}", k, f"{noun}-added" + (f"-{'optional' if optional else 'required'}" if noun in ("field", "extension") else ""))
                else:
                    compare(inner, x[k][1], y[k][1], f"{at}/{name}/{y[k][0]}", k)

    odd = rest("document", before, after)
    for part, members in (("source", ("version",)), ("package", ("version", "mappingVersions", "profileVersions"))):
        b, a = (get(v, part) if isinstance(get(v, part), dict) else GONE for v in (before, after))
        odd |= (b is GONE) != (a is GONE)
        b, a = {} if b is GONE else b, {} if a is GONE else a
        odd |= rest(part, b, a)
        if not same(get(b, "identity"), get(a, "identity")):
            put(f"/{part}/identity", "", f"{part}-identity-changed")
        if any(not same(get(b, m), get(a, m)) for m in members):
            put(f"/{part}", "", f"{part}-provenance-changed")
    if odd:
        put("", "", "unmodelled")
    compare("document", before, after, "", "")
    return sorted(out)


def pairs(spark, rows):
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return spark.createDataFrame([(i, text(b), text(a), p, "x") for i, (b, a, p) in enumerate(rows)], "pair_id long, before string, after string, policy string, side string")


def test_changes_are_those_of_a_walk(spark):
    r = random.Random(11)
    rows = []
    for i in range(400):
        b = document(r)
        a = copy.deepcopy(b)
        for _ in range(r.randrange(5)):
            mutate(r, a)
        rows.append((b, a, r.choice([None, "preserve", "surface", "reject"])))
    for was, now in ((None, {"identity": "e", "required": True}), ({"identity": "e", "required": False}, {"identity": "e", "required": True})):
        side = lambda x, policy: {"types": [{"identity": "t", "unknownPolicy": policy, "extensions": [x] if x else []}]}
        rows.append((side(was, "preserve"), side(now, "reject"), None))
    got = {i: [] for i in range(len(rows))}
    for x in surface.changes(pairs(spark, rows), "breaking").collect():
        got[x.pair_id].append((x.pointer, x.subject, x.kind, x.classification))
    want = {i: walked(b, a, p, "breaking") for i, (b, a, p) in enumerate(rows)}
    assert {i: sorted(v) for i, v in got.items()} == want
    kinds = {k for v in want.values() for _, _, k, _ in v}
    assert kinds >= {*surface.KINDS} - {"pair-inadmissible"}


def test_odd_pairs(spark):
    rows = [("{", {}, None), (None, {}, None), ({}, [], None), ({}, {}, None), ({"types": 5}, {"types": []}, None), ({"x": 1.50}, {"x": 15e-1}, None), ({"x": None}, {}, None), ({"source": 1}, {"source": {}}, None)]
    df = pairs(spark, rows)
    found = surface.changes(df)
    got = {x.pair_id: (x.kind, x.classification) for x in found.collect()}
    bad, odd = ("pair-inadmissible", "invalid"), ("unmodelled", "unknown")
    assert got == {0: bad, 1: bad, 2: bad, 6: odd, 7: odd}
    assert {x.pair_id: x.classification for x in surface.verdicts(df, found).collect()} == {0: "invalid", 1: "invalid", 2: "invalid", 3: "patch", 4: "patch", 5: "patch", 6: "unknown", 7: "unknown"}
    assert surface.changes(df.limit(0)).count() == 0
    refused = df.selectExpr("*", "pair_id <> 3 AS admissible")
    assert {x.pair_id for x in surface.changes(refused).where("classification = 'invalid'").collect()} == {0, 1, 2, 3}


def test_renames_by_structure(spark):
    t = lambda i, extra=0: {"identity": i, "displayName": i.upper(), "kind": "record", "fields": [{"identity": f"{i}#x", "v": extra}]}
    rows = [
        ({"types": [t("aa"), t("k", 9)]}, {"types": [t("k", 9), t("bb")]}, None),
        ({"types": [t("aa"), t("cc")]}, {"types": [t("bb")]}, None),
        ({"types": [t("aa")]}, {"types": [t("bb", 1)]}, None),
        ({"types": [t("aa"), t("dd", 1)]}, {"types": [t("ee", 1), t("bb")]}, None),
    ]
    got = {(x.pair_id, x.before, x.after) for x in surface.renames(pairs(spark, rows)).collect()}
    assert got == {(0, "aa", "bb"), (3, "aa", "bb"), (3, "dd", "ee")}


def test_a_long_list_and_a_long_chain_of_aliases(spark):
    many = [{"identity": f"f{i}", "typeRef": "t0"} for i in range(3000)]
    chain = [{"identity": f"t{i}", "kind": "alias", "target": f"t{i + 1}"} for i in range(500)] + [{"identity": "t500", "kind": "scalar", "scalar": "integer"}]
    owner = lambda fields: {"types": [{"identity": "o", "kind": "record", "fields": fields}, *chain]}
    moved = [{**f, "typeRef": "t250" if i else "gone"} for i, f in enumerate(many)]
    got = [(x.kind, x["count"]) for x in surface.changes(pairs(spark, [(owner(many), owner(moved), None)])).groupBy("kind").count().collect()]
    assert sorted(got) == [("field-type-ref-rerepresented", 2999), ("field-type-ref-retargeted", 1)]
