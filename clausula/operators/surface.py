"""The whole change between two documents: nodes paired by structural keys, and a table of change kinds that decides.

A document opens into its nodes by four explodes, without a shuffle: each node has a key, the lists and identities on its way, and its
facts, a map of the canonical texts of its own members (so an absent member and a null one differ). Only facts shuffle, once, by
pair and key. Nodes that one side lacks are reported where their owner is on both sides. Whatever no kind looks at is `unmodelled`.

Defined results: a pair with a text that is null, malformed or no object, or whose column `admissible` is false, is one change
`pair-inadmissible`. Of entries of a list with the same identity the first counts; entries without one have no key and are not seen.
Members that name lists but hold none count as empty lists. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausula.functions import documents as D
from clausula.operators import closure, evolution
from clausula.plans.tables import cut
from clausula.sources import trees

# The change kinds and their classes; `optional` and `variant` depend on the consumer's policy.
KINDS = {
    "package-identity-changed": "breaking",
    "package-provenance-changed": "patch",
    "source-identity-changed": "breaking",
    "source-provenance-changed": "patch",
    "type-added": "additive",
    "type-removed": "breaking",
    "type-kind-changed": "breaking",
    "type-representation-changed": "breaking",
    "type-display-name-changed": "breaking",
    "type-unknown-policy-tightened": "breaking",
    "type-unknown-policy-changed": "conditional",
    "type-origin-changed": "patch",
    "field-added-required": "breaking",
    "field-added-optional": "optional",
    "field-removed": "breaking",
    "field-became-required": "breaking",
    "field-became-optional": "additive",
    "field-nullability-changed": "breaking",
    "field-default-changed": "conditional",
    "field-unit-changed": "breaking",
    "field-name-changed": "breaking",
    "field-type-ref-retargeted": "breaking",
    "field-type-ref-rerepresented": "patch",
    "field-cardinality-changed": "breaking",
    "field-collection-flags-changed": "conditional",
    "field-origin-changed": "patch",
    "variant-added": "variant",
    "variant-removed": "breaking",
    "variant-payload-changed": "breaking",
    "variant-name-changed": "breaking",
    "relationship-added": "conditional",
    "relationship-removed": "breaking",
    "relationship-changed": "breaking",
    "operation-added": "additive",
    "operation-removed": "breaking",
    "operation-changed": "breaking",
    "constraint-added": "conditional",
    "constraint-removed": "conditional",
    "constraint-operands-changed": "conditional",
    "extension-added-required": "breaking",
    "extension-added-optional": "additive",
    "extension-removed": "breaking",
    "extension-changed": "conditional",
    "unmodelled": "unknown",
    "pair-inadmissible": "invalid",
}
# Policies of a consumer that admit members it does not know.
ADMIT = ("preserve", "surface")

#: The lists of each kind of node and what their entries are.
LISTS = {
    "document": {"types": "type", "extensions": "extension"},
    "type": {"extensions": "extension", "constraints": "constraint", "fields": "field", "variants": "variant", "relationships": "relationship", "operations": "operation"},
    "operation": {"params": "parameter"},
    "field": {"extensions": "extension"},
    "parameter": {"extensions": "extension"},
}
#: Objects of a document that are nodes of their own.
PARTS = ("source", "package")
#: Members, beside lists, whose change has a kind or means nothing; others are unmodelled. Nodes that are not named here are compared as a whole or by their rules alone.
MODELLED = {
    "document": ("contractVersion", "canonicalization", *PARTS),
    "source": ("identity", "version", "dialect"),
    "package": ("identity", "version", "mappingVersions", "profileVersions"),
    "type": ("identity", "displayName", "kind", "scalar", "target", "items", "values", "unknownPolicy", "origin"),
    "field": ("identity", "name", "typeRef", "presence", "nullable", "defaultKind", "defaultValue", "unit", "origin", "multiplicity"),
}
SHAPE = ("kind", "scalar", "target", "items", "values")
_FACTS = "map<string,string>"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _entries(node: Column, name: str) -> Column:
    """The first entry of each identity in a list: name, kind, identity, pos, node. Found by sorting, not by comparing all."""

    def of(items):
        places = F.transform(items, lambda x, i: F.struct(trees.text_at(x, "$.identity").alias("identity"), i.alias("pos")))
        ordered = F.array_sort(F.filter(places, lambda p: p["identity"].isNotNull()))
        first = lambda all_: F.filter(all_, lambda p, i: (i == 0) | (F.get(all_, i - 1)["identity"] != p["identity"]))
        return F.transform(_let(ordered, first), lambda p: F.struct(p["identity"], p["pos"], F.get(items, p["pos"]).alias("node")))

    return F.coalesce(_let(trees.items(trees.at(node, f"$.{name}")), of), F.array())


_ENTRY = "array<struct<role:string,list:string,identity:string,pos:int,node:variant>>"


def _labelled(role: str, name: str):
    return lambda e: F.struct(F.lit(role), F.lit(name), e["identity"], e["pos"], e["node"])


def _opened(nodes: DataFrame, *owners: str) -> DataFrame:
    """The nodes and the entries of the lists of those that are new and have one of these roles."""
    found = []
    for owner in owners:
        for name, role in LISTS[owner].items():
            inner = F.transform(_entries(F.col("node"), name), _labelled(role, name))
            found.append(F.when(F.col("fresh") & (F.col("role") == owner), inner.cast(_ENTRY)).otherwise(F.array().cast(_ENTRY)))
    for name in PARTS if "document" in owners else ():
        at = trees.at(F.col("node"), f"$.{name}")
        one = F.array(F.struct(F.lit(name), F.lit(name), F.lit(""), F.lit(None).cast("int"), at)).cast(_ENTRY)
        found.append(F.when(F.col("fresh") & (F.col("role") == "document") & trees.is_object(at), one).otherwise(F.array().cast(_ENTRY)))
    self = F.array(F.struct(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("variant"))).cast(_ENTRY)
    x = nodes.withColumn("e", F.explode(F.concat(self, *found)))
    new = F.col("e.role").isNotNull()
    place = F.concat(F.lit("/"), F.col("e.list"), F.when(F.col("e.pos").isNotNull(), F.concat(F.lit("/"), F.col("e.pos").cast("string"))).otherwise(""))
    return x.select(
        "pair_id", "side",
        F.when(new, F.concat("key", F.array(F.col("e.list"), F.col("e.identity")))).otherwise(F.col("key")).alias("key"),
        F.when(new, F.col("e.role")).otherwise(F.col("role")).alias("role"),
        F.when(new, F.concat("at", place)).otherwise(F.col("at")).alias("at"),
        F.when(new, place).otherwise(F.col("place")).alias("place"),
        F.when(new, F.col("e.node")).otherwise(F.col("node")).alias("node"),
        new.alias("fresh"),
    )


def _facts(node: Column, role: Column) -> Column:
    """Canonical texts of a node's members but for those that are nodes of their own."""

    def own(k, v):
        lists = _any((role == owner) & k.isin(*names) for owner, names in LISTS.items())
        return ~(lists | ((role == "document") & k.isin(*PARTS)))

    members = F.try_variant_get(node, "$", "map<string,variant>")
    return F.coalesce(F.transform_values(F.map_filter(members, own), lambda k, v: F.coalesce(F.to_json(v), F.lit("null"))), F.create_map().cast(_FACTS))


def nodes(pairs: DataFrame) -> DataFrame:
    """pair_id, key, role, b, a: the nodes of both documents of each pair; b and a hold at, place, facts and a digest of the body, null where the side lacks the node."""
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col({"b": "before", "a": "after"}[name]).alias("text"))
    texts = pairs.select("pair_id", F.explode(F.array(side("b"), side("a"))).alias("s")).select("pair_id", "s.side", D.canonical_json("s.text").alias("text"))
    root = texts.select("pair_id", "side", F.array().cast("array<string>").alias("key"), F.lit("document").alias("role"), F.lit("").alias("at"), F.lit("").alias("place"), F.try_parse_json("text").alias("node"), F.lit(True).alias("fresh"))
    x = root.where(trees.is_object(F.col("node")))
    for owners in (("document",), ("type",), ("operation", "field"), ("parameter",)):  # lists lie no deeper
        x = _opened(x, *owners)
    whole = F.map_filter(F.try_variant_get("node", "$", "map<string,variant>"), lambda k, v: ~k.isin("identity", "displayName"))
    body = F.array_join(F.transform(F.map_entries(whole), lambda m: F.concat(m["key"], F.lit(":"), F.coalesce(F.to_json(m["value"]), F.lit("null")))), ",")
    own = F.element_at("key", -1)
    digest = F.when(F.col("role") == "type", F.sha2(F.when(own == "", body).otherwise(F.replace(body, own, F.lit(""))), 256))
    x = x.select("pair_id", "side", "key", "role", F.struct("at", "place", _facts(F.col("node"), F.col("role")).alias("facts"), digest.alias("body")).alias("n"))
    pick = lambda name: F.first(F.when(F.col("side") == name, F.col("n")), ignorenulls=True).alias(name)
    return x.groupBy("pair_id", "key", "role").agg(pick("b"), pick("a"))


def _event(kind: str, when: Column, below: str = "") -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(below).alias("below")))


def _within(c: Column, name: str) -> Column:
    """The canonical text of a member of an object that is given as text; null if absent."""
    return F.to_json(trees.at(F.try_parse_json(c), f"$.{name}"))


def _events(role: Column, b: Column, a: Column) -> Column:
    """Changes of a node that both documents have, by its role."""
    differ = lambda *names: _any(~b[n].eqNullSafe(a[n]) for n in names)
    now = lambda name, text: F.coalesce(a[name] == F.lit(f'"{text}"'), F.lit(False))
    true = lambda m, name: F.coalesce(m[name] == "true", F.lit(False))
    whole = ~F.map_entries(b).eqNullSafe(F.map_entries(a))
    many = lambda name: ~_within(b["multiplicity"], name).eqNullSafe(_within(a["multiplicity"], name))
    field = [
        _event("field-became-required", differ("presence") & now("presence", "required"), "/presence"),
        _event("field-became-optional", differ("presence") & ~now("presence", "required"), "/presence"),
        _event("field-nullability-changed", true(b, "nullable") != true(a, "nullable"), "/nullable"),
        _event("field-default-changed", differ("defaultKind", "defaultValue"), "/defaultKind"),
        _event("field-unit-changed", differ("unit"), "/unit"),
        _event("field-name-changed", differ("name"), "/name"),
        _event("field-type-ref-retargeted", differ("typeRef"), "/typeRef"),
        _event("field-cardinality-changed", many("upper"), "/multiplicity/upper"),
        _event("field-collection-flags-changed", many("ordered") | many("unique"), "/multiplicity"),
        _event("field-origin-changed", differ("origin"), "/origin"),
    ]
    by_role = {
        "source": [_event("source-identity-changed", differ("identity"), "/identity"), _event("source-provenance-changed", differ("version"))],
        "package": [_event("package-identity-changed", differ("identity"), "/identity"), _event("package-provenance-changed", differ("version", "mappingVersions", "profileVersions"))],
        "type": [
            _event("type-kind-changed", differ("kind"), "/kind"),
            *[_event("type-representation-changed", differ(m), f"/{m}") for m in SHAPE[1:]],
            _event("type-display-name-changed", differ("displayName"), "/displayName"),
            _event("type-unknown-policy-tightened", differ("unknownPolicy") & now("unknownPolicy", "reject"), "/unknownPolicy"),
            _event("type-unknown-policy-changed", differ("unknownPolicy") & ~now("unknownPolicy", "reject"), "/unknownPolicy"),
            _event("type-origin-changed", differ("origin"), "/origin"),
        ],
        "field": field,
        "parameter": field,
        "variant": [_event("variant-payload-changed", differ("payloadType"), "/payloadType"), _event("variant-name-changed", differ("name"), "/name")],
        "relationship": [_event("relationship-changed", whole)],
        "constraint": [_event("constraint-operands-changed", whole)],
        "extension": [_event("extension-changed", whole)],
        "operation": [_event("operation-changed", differ("returns"), "/returns"), _event("operation-changed", differ("name", "pre", "post")), _event("field-origin-changed", differ("origin"), "/origin")],
    }
    for name, members in MODELLED.items():
        by_role[name] = [*by_role.get(name, []), _event("unmodelled", ~_but(b, members).eqNullSafe(_but(a, members)))]
    out = F.array().cast("array<struct<kind:string,below:string>>")
    for name, events in by_role.items():
        out = F.when(role == name, F.array_compact(F.array(*events))).otherwise(out)
    return out


def _but(facts: Column, names: tuple[str, ...]) -> Column:
    return F.map_entries(F.map_filter(facts, lambda k, v: ~k.isin(*names)))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _shapes(paired: DataFrame, wanted: DataFrame) -> DataFrame:
    """pair_id, side, ref, shape: what each wanted reference (pair_id, side, ref: canonical text) stands for at the end of its aliases."""
    name = lambda pair, side, ref: F.to_json(F.array(pair.cast("string"), side, ref))
    types = paired.where("role = 'type'").join(wanted.select("pair_id").distinct(), "pair_id", "left_semi")
    each = types.select("pair_id", F.to_json(F.array(F.element_at("key", -1))).alias("id"), F.explode(F.array(F.struct(F.lit("b").alias("side"), F.col("b.facts").alias("f")), F.struct(F.lit("a").alias("side"), F.col("a.facts").alias("f")))).alias("x"))
    each = each.where("x.f IS NOT NULL").select("pair_id", "x.side", F.expr("substring(id, 2, length(id) - 2)").alias("id"), "x.f")
    each = each.withColumn("node", name(F.col("pair_id"), F.col("side"), F.col("id")))
    to = F.col("f")["target"]
    target = F.when(to.startswith('"') & (to != F.col("id")), name(F.col("pair_id"), F.col("side"), to)).otherwise("cyclic")  # no declaration has this name
    ends = closure.resolve_chain(each.where(F.col("f")["kind"] == '"alias"').select(F.col("node").alias("src"), target.alias("dst")), each.select("node"), 1 << 60)
    shape = F.to_json(F.array(*[F.coalesce(F.col("f")[m], F.lit("null")) for m in SHAPE]))
    shapes = each.select(F.col("node").alias("terminal"), shape.alias("shape"))
    known = ends.withColumn("ends", F.col("terminal")).join(shapes, "terminal", "left").select("node", F.when(F.col("status") == "resolved", F.col("shape")).otherwise(F.when((F.col("status") == "cycle") | (F.col("ends") == "cyclic"), "cyclic").otherwise("unresolved")).alias("shape"))
    asked = wanted.withColumn("node", F.when(F.col("ref").startswith('"'), name(F.col("pair_id"), F.col("side"), F.col("ref"))))
    return asked.join(known, "node", "left").select("pair_id", "side", "ref", F.when(F.col("node").isNull(), "cyclic").otherwise(F.coalesce("shape", F.lit("unresolved"))).alias("shape")).distinct()


def _classed(kind: Column, policy: Column, closed: str) -> Column:
    """The class of a kind; closed: the class of a new variant where the consumer admits no unknown ones."""
    admits = F.coalesce(policy.isin(*ADMIT), F.lit(False))
    out = F.lit(None).cast("string")
    for name, cls in KINDS.items():
        got = F.when(admits, "additive").otherwise("conditional" if cls == "optional" else closed) if cls in ("optional", "variant") else F.lit(cls)
        out = F.when(kind == name, got).otherwise(out)
    return out


def changes(pairs: DataFrame, closed: str = "conditional") -> DataFrame:
    """pair_id, pointer, subject, kind, classification: the changes of pairs (pair_id: unique; before, after: texts; policy: of the consumer,
    may be null; admissible: optional). closed: class of a variant added for a consumer without a policy that admits it
    (`conditional`, or `breaking` for the stricter reading)."""
    paired = cut(nodes(pairs), "surface")
    refused = pairs.select("pair_id", ~F.coalesce(F.col("admissible"), F.lit(False)) if "admissible" in pairs.columns else F.lit(False).alias("x")).toDF("pair_id", "refused")
    roots = paired.where("role = 'document' AND b IS NOT NULL AND a IS NOT NULL").select("pair_id", F.lit(True).alias("fit"))
    fit = cut(refused.join(roots, "pair_id", "left").select("pair_id", (F.coalesce("fit", F.lit(False)) & ~F.col("refused")).alias("fit")), "surface-fit")
    live = paired.join(fit.where("fit").select("pair_id"), "pair_id", "left_semi")
    subject = F.coalesce(F.element_at(F.when(F.size("key") > 0, F.col("key")), -1), F.lit(""))
    missing = F.create_map().cast(_FACTS)

    # Nodes of both sides. Parts of the envelope count as empty where a side lacks them.
    part = F.col("role").isin(*PARTS)
    both = live.where(part | (F.col("b").isNotNull() & F.col("a").isNotNull()))
    b, a = F.coalesce(F.col("b.facts"), missing), F.coalesce(F.col("a.facts"), missing)
    one_sided = F.when(part & (F.col("b").isNull() | F.col("a").isNull()), F.array(F.struct(F.lit("unmodelled").alias("kind"), F.lit("").alias("below"))))
    events = F.concat(_events(F.col("role"), b, a), F.coalesce(one_sided, F.array().cast("array<struct<kind:string,below:string>>")))
    place = F.coalesce("a.at", "b.at")
    kept = both.select("pair_id", "role", subject.alias("subject"), place.alias("at"), b["typeRef"].alias("was"), a["typeRef"].alias("is"), (~F.coalesce(a["required"], F.lit("")).eqNullSafe("true")).alias("free"), (F.coalesce(b["required"] == "true", F.lit(False))).alias("bound"), F.explode(events).alias("e"))
    pointer = F.when((F.col("e.kind") == "unmodelled") & F.col("role").isin("document", *PARTS), "").when(F.col("e.kind") == "unmodelled", "/types").otherwise(F.concat("at", "e.below"))
    kept = cut(kept.select("pair_id", "role", "subject", "was", "is", (F.col("role") == "extension").alias("ext"), (~F.col("free") & ~F.col("bound")).alias("tightened"), pointer.alias("pointer"), F.col("e.kind").alias("kind")), "surface-kept")

    # References that moved: only what they stand for counts.
    moved = kept.where("kind = 'field-type-ref-retargeted'")
    wanted = moved.select("pair_id", F.explode(F.array(F.struct(F.lit("b").alias("side"), F.col("was").alias("ref")), F.struct(F.lit("a").alias("side"), F.col("is").alias("ref")))).alias("w")).select("pair_id", "w.side", "w.ref").distinct()
    shapes = cut(_shapes(paired, wanted), "surface-shapes")
    side = lambda s, ref, out: shapes.where(F.col("side") == s).select(F.col("pair_id").alias(f"_{s}"), F.col("ref").alias(f"_{ref}"), F.col("shape").alias(out))
    seen = moved.join(side("b", "was", "x"), (F.col("pair_id") == F.col("_b")) & F.col("was").eqNullSafe(F.col("_was")), "left").join(side("a", "is", "y"), (F.col("pair_id") == F.col("_a")) & F.col("is").eqNullSafe(F.col("_is")), "left")
    seen = seen.withColumn("kind", F.when(F.col("x") == F.col("y"), "field-type-ref-rerepresented").otherwise(F.col("kind"))).select(kept.columns)
    kept = kept.where("kind <> 'field-type-ref-retargeted'").unionByName(seen)

    # Nodes of one side, below an owner that both have.
    alone = live.where(~part & (F.size("key") > 0) & (F.col("b").isNull() | F.col("a").isNull())).withColumn("up", F.slice("key", F.lit(1), F.size("key") - 2))
    owner = live.where("b IS NOT NULL AND a IS NOT NULL").select("pair_id", F.col("key").alias("up"), F.col("a.at").alias("owner"))
    new = F.col("a").isNotNull()
    facts = F.col("a.facts")
    noun = F.when(F.col("role") == "parameter", "field").otherwise(F.col("role"))
    how = F.when(~new, "removed").when(noun == "field", F.when(F.coalesce(facts["presence"] == '"optional"', F.lit(False)), "added-optional").otherwise("added-required"))
    how = how.when(noun == "extension", F.when(F.coalesce(facts["required"] == "true", F.lit(False)), "added-required").otherwise("added-optional")).otherwise("added")
    single = alone.join(owner, ["pair_id", "up"]).select("pair_id", F.concat("owner", F.coalesce("a.place", "b.place")).alias("pointer"), subject.alias("subject"), F.concat_ws("-", noun, how).alias("kind"), F.lit(False).alias("tightened"))

    found = kept.select("pair_id", "pointer", "subject", "kind", (F.col("ext") & F.col("tightened")).alias("tightened")).unionByName(single)
    envelope = F.col("kind").eqNullSafe("unmodelled") & (F.col("pointer") == "")
    found = found.withColumn("subject", F.when(envelope, "").otherwise(F.col("subject")))
    twice = found.where(envelope).distinct()
    found = found.where(~envelope).unionByName(twice).join(pairs.select("pair_id", "policy"), "pair_id")
    cls = F.when((F.col("kind") == "extension-changed") & F.col("tightened"), "breaking").otherwise(_classed(F.col("kind"), F.col("policy"), closed))
    unfit = fit.where("NOT fit").select("pair_id", F.lit("").alias("pointer"), F.lit("").alias("subject"), F.lit("pair-inadmissible").alias("kind"), F.lit("invalid").alias("classification"))
    return found.select("pair_id", "pointer", "subject", "kind", cls.alias("classification")).unionByName(unfit)


def verdicts(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pair_id, classification, changes: the most restrictive class of each pair, patch where nothing changed."""
    most = found.groupBy("pair_id").agg(F.max(evolution.rank(F.col("classification"))).alias("r"), F.count("*").alias("n"))
    return pairs.select("pair_id").join(most, "pair_id", "left").select("pair_id", F.coalesce(evolution.rank_name(F.col("r")), F.lit("patch")).alias("classification"), F.coalesce("n", F.lit(0)).cast("long").alias("changes"))


def renames(pairs: DataFrame) -> DataFrame:
    """pair_id, before, after: identities of types that left and came with the same body, where only one left and one came with it.

    The body is all of a type but its identity and display name, with its own identity taken out of the names in it.
    """
    types = nodes(pairs).where("role = 'type' AND (b IS NULL OR a IS NULL)")
    one = types.select("pair_id", F.element_at("key", -1).alias("id"), F.coalesce("b.body", "a.body").alias("body"), F.col("b").isNotNull().alias("left"))
    ids = lambda left: F.min(F.when(F.col("left") == left, F.col("id")))
    met = one.groupBy("pair_id", "body").agg(ids(True).alias("before"), ids(False).alias("after"), F.count_if("left").alias("b"), F.count_if(~F.col("left")).alias("a"))
    return met.where("b = 1 AND a = 1").select("pair_id", "before", "after")
