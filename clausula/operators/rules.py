"""Rules over the node tables of contract documents: one finding table for each code.

A rule is a filter, an anti-join, a duplicate count or a closure over node tables; findings share
one schema and are put together by union, so each rule is planned and distributed on its own.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausula.functions import documents as D
from clausula.functions import scalars as S
from clausula.operators import closure, relations
from clausula.plans.tables import cut
from clausula.sources import bundles as B

# Scalars of the kernel, map keys among them, and the members each kind must have.
SCALARS = ("boolean", "integer", "decimal", "float32", "float64", "string", "bytes", "date", "datetime", "duration", "uuid", "any")
KEY_SCALARS = ("string", "integer", "uuid", "date", "boolean")
REQUIRED_MEMBERS = {"scalar": "scalar", "alias": "target", "sequence": "items", "reference": "target", "option": "inner", "record": "fields", "union": "variants", "enum": "variants"}
KEYWORDS = ("min", "max", "exclusiveMin", "exclusiveMax", "minLength", "maxLength", "pattern", "enumValues", "nonEmpty", "unique", "format")
SCHEMA = ("doc_id", "pointer", "code", "severity", "message")


def finding(df: DataFrame, code: str, pointer: str | Column = "pointer", message: str | Column = "", severity: str = "error") -> DataFrame:
    p = F.col(pointer) if isinstance(pointer, str) else pointer
    return df.select("doc_id", p.alias("pointer"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Shape


def shape(docs: DataFrame) -> DataFrame:
    """Documents that are no JSON objects or have no types; types without an identity, a known kind, or what their kind needs."""
    t = B.types(docs.where("well_formed"))
    bad = finding(docs.where("NOT well_formed"), "INVALID_DOCUMENT", F.lit(""))
    empty = finding(docs.where("well_formed AND ir.types IS NULL"), "SCHEMA_VIOLATION", F.lit("/ir/types"), "types is missing")
    no_id = finding(t.where("identity IS NULL OR NOT " + f"identity rlike '{S.IDENTITY}'"), "SCHEMA_VIOLATION", F.concat("pointer", F.lit("/identity")), "not an identity")
    needs = F.lit(None).cast("string")
    for kind, member in REQUIRED_MEMBERS.items():
        needs = F.when((F.col("kind") == kind) & F.col(f"`{member}`").isNull(), F.lit(member)).otherwise(needs)
    lacking = finding(t.withColumn("_m", needs).where("_m IS NOT NULL"), "SCHEMA_VIOLATION", F.concat("pointer", F.lit("/"), F.col("_m")), "a member of this kind is missing")
    return together([bad, empty, no_id, lacking])


# Identities and names


def duplicate_identities(docs: DataFrame) -> DataFrame:
    """Every occurrence of an identity but the first in document order."""
    return finding(relations.repeats(B.identities(docs), ["doc_id", "identity"], "ord"), "DUPLICATE_IDENTITY", message=F.col("identity"))


def _duplicates(df: DataFrame, by: list[str], code: str, name: str) -> DataFrame:
    return finding(relations.repeats(df, ["doc_id", *by], "pointer"), code, message=F.col(name))


def duplicate_names(docs: DataFrame) -> DataFrame:
    f, c, o = B.fields(docs), B.clauses(docs), B.operations(docs)
    params = o.select("doc_id", F.col("pointer").alias("_o"), F.posexplode("params").alias("_i", "p")).select("doc_id", "_o", F.format_string("%s/params/%d", "_o", "_i").alias("pointer"), F.col("p.name").alias("name"))
    return together([
        _duplicates(f.where("name IS NOT NULL"), ["owner", "name"], "DUPLICATE_FIELD_NAME", "name"),
        _duplicates(params.where("name IS NOT NULL"), ["_o", "name"], "DUPLICATE_PARAM", "name"),
        _duplicates(c.where("id IS NOT NULL"), ["owner", "id"], "DUPLICATE_CLAUSE_ID", "id"),
    ])


# References


def declared(docs: DataFrame) -> DataFrame:
    return B.types(docs).where("identity IS NOT NULL").select("doc_id", "identity").distinct()


# Codes by the place of the reference.
REFERENCE_CODES = {"items": "UNRESOLVED_ELEMENT_TYPE", "keys": "UNRESOLVED_MAP_KEY", "inner": "UNRESOLVED_OPTION_INNER", "payload": "UNRESOLVED_VARIANT_PAYLOAD"}


def unresolved_references(docs: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """References to what neither the document nor an imported package (identity) declares."""
    refs = B.references(docs)
    lost = relations.unresolved(refs, declared(docs).withColumnRenamed("identity", "ref"), ["doc_id", "ref"])
    if exported is not None:
        lost = lost.join(exported.select(F.col("identity").alias("ref")).distinct(), "ref", "left_anti")
    code = F.lit("UNRESOLVED_TYPE_REF")
    for position, name in REFERENCE_CODES.items():
        code = F.when(F.col("position") == position, F.lit(name)).otherwise(code)
    relation = F.col("pointer").rlike("/relationships/[0-9]+/target$")
    return lost.select("doc_id", "pointer", F.when(relation, "UNRESOLVED_RELATIONSHIP_TARGET").otherwise(code).alias("code"), F.lit("error").alias("severity"), F.col("ref").alias("message"))


def unresolved_members(docs: DataFrame) -> DataFrame:
    """Occurrences of no declared type, population members that are no types, conditions that are no clauses of their type."""
    known = declared(docs)
    occ = B.occurrences(docs).join(known.withColumnRenamed("identity", "definition"), ["doc_id", "definition"], "left_anti")
    pop = B.populations(docs).select("doc_id", F.col("pointer").alias("_p"), F.posexplode("members").alias("_i", "identity")).withColumn("pointer", F.format_string("%s/members/%d", "_p", "_i")).join(known, ["doc_id", "identity"], "left_anti")
    ops = B.operations(docs).select("doc_id", "owner", F.col("pointer").alias("_p"), F.explode(F.concat(F.coalesce("pre", F.array()), F.coalesce("post", F.array()))).alias("id")).where(~F.startswith("id", F.lit("{")))  # a condition written in place names no clause
    dangling = ops.join(B.clauses(docs).select("doc_id", "owner", "id").distinct(), ["doc_id", "owner", "id"], "left_anti")
    return together([
        finding(occ, "UNRESOLVED_OCCURRENCE_DEFINITION", F.concat("pointer", F.lit("/definition")), F.col("definition")),
        finding(pop, "UNRESOLVED_CONSTRUCT_REF", message=F.col("identity")),
        finding(dangling, "DANGLING_CLAUSE_REF", "_p", F.col("id")),
    ])


def multiple_membership(docs: DataFrame) -> DataFrame:
    """Types that several populations name."""
    m = B.populations(docs).select("doc_id", "pointer", F.explode("members").alias("member"))
    return finding(m.groupBy("doc_id", "member").agg(F.count_distinct("pointer").alias("n"), F.min("pointer").alias("pointer")).where("n > 1"), "MULTIPLE_DOMAIN_MEMBERSHIP", message=F.col("member"))


# Chains and cycles


def alias_edges(docs: DataFrame) -> DataFrame:
    """Alias steps within documents; nodes are doc_id and identity, joined by a line feed."""
    return B.types(docs).where("kind = 'alias' AND target IS NOT NULL").select("doc_id", "pos", "pointer", F.concat_ws("\n", "doc_id", "identity").alias("src"), F.concat_ws("\n", "doc_id", "target").alias("dst"))


def resolved_types(docs: DataFrame) -> DataFrame:
    """node, terminal, hops, status of every declared type."""
    e = alias_edges(docs).groupBy("src").agg(F.min_by("dst", "pos").alias("dst"))  # of one identity the first declaration
    return closure.resolve_chain(e, declared(docs).select(F.concat_ws("\n", "doc_id", "identity").alias("node")))


def alias_cycles(docs: DataFrame) -> DataFrame:
    bad = resolved_types(docs).where("status IN ('cycle', 'depth')")
    hit = alias_edges(docs).join(bad.withColumnRenamed("node", "src"), "src")
    return hit.select("doc_id", F.concat("pointer", F.lit("/target")).alias("pointer"), F.when(F.col("status") == "cycle", "ALIAS_CYCLE").otherwise("DEPTH_LIMIT_EXCEEDED").alias("code"), F.lit("error").alias("severity"), F.lit("").alias("message"))


def _ring(edges: DataFrame, code: str) -> DataFrame:
    """A finding at the least member of each cycle."""
    ring = closure.cycle_heads(edges.select(F.concat_ws("\n", "doc_id", "a").alias("src"), F.concat_ws("\n", "doc_id", "b").alias("dst")))
    parts = F.split("component", "\n")
    return ring.select(parts[0].alias("doc_id"), F.lit("/ir/types").alias("pointer"), F.lit(code).alias("code"), F.lit("error").alias("severity"), parts[1].alias("message"))


def composite_cycles(docs: DataFrame) -> DataFrame:
    return _ring(B.relationships(docs).where("composite").select("doc_id", F.col("owner").alias("a"), F.col("target").alias("b")), "COMPOSITE_CYCLE")


def supertype_cycles(docs: DataFrame) -> DataFrame:
    return _ring(B.types(docs).select("doc_id", F.col("identity").alias("a"), F.explode("supertypes").alias("b")), "SUPERTYPE_CYCLE")


def composite_owners(docs: DataFrame) -> DataFrame:
    """Types with several composite owners: doc_id, child, owners."""
    r = B.relationships(docs).where("composite")
    return r.groupBy("doc_id", F.col("target").alias("child")).agg(F.sort_array(F.collect_set("owner")).alias("owners")).where("size(owners) > 1")


# Fields, constraints, maps, options


def field_rules(docs: DataFrame) -> DataFrame:
    f = B.fields(docs)
    m = F.col("multiplicity")
    bad = f.where((m["upper"] < m["lower"]) | (m["lower"] < 0) | (m.isNotNull() & (m["lower"].isNull() | m["ordered"].isNull() | m["unique"].isNull())))
    kinds = B.types(docs).select("doc_id", F.col("identity").alias("type_ref"), "kind", "scalar").dropDuplicates(["doc_id", "type_ref"])
    united = f.where("unit IS NOT NULL").join(kinds, ["doc_id", "type_ref"]).where("kind NOT IN ('scalar', 'alias')")
    option = f.where("presence = 'optional'").join(kinds, ["doc_id", "type_ref"]).where("kind = 'option'")
    plain = f.where("presence = 'required' AND nullable = false AND lower(default) = 'null'")
    return together([
        finding(bad, "INVALID_MULTIPLICITY", F.concat("pointer", F.lit("/multiplicity"))),
        finding(united, "UNIT_ON_NON_SCALAR", F.concat("pointer", F.lit("/unit"))),
        finding(option, "INVALID_OPTION_PRESENCE", F.concat("pointer", F.lit("/presence"))),
        finding(plain, "INVALID_DEFAULT_VALUE", F.concat("pointer", F.lit("/default"))),
    ])


def type_rules(docs: DataFrame) -> DataFrame:
    t = B.types(docs)
    kinds = t.select("doc_id", F.col("identity").alias("ref"), F.col("kind").alias("ref_kind"), F.col("scalar").alias("ref_scalar")).dropDuplicates(["doc_id", "ref"])
    keys = t.where("kind = 'map'").withColumn("ref", F.col("keys")).join(kinds, ["doc_id", "ref"]).where((F.col("ref_kind") != "scalar") | ~F.col("ref_scalar").isin(*KEY_SCALARS))
    inner = t.where("kind = 'option'").withColumn("ref", F.col("inner")).join(kinds, ["doc_id", "ref"]).where("ref_kind = 'option'")
    decimal = t.where("scalar = 'decimal'")
    return together([
        finding(keys, "INVALID_MAP_KEY", F.concat("pointer", F.lit("/keys"))),
        finding(inner, "INVALID_OPTION_INNER", F.concat("pointer", F.lit("/inner"))),
        finding(decimal.where("decimal IS NULL"), "DECIMAL_POLICY_MISSING"),
        finding(decimal.where("decimal.scale > decimal.precision OR decimal.precision > 38 OR decimal.precision < 1"), "DECIMAL_POLICY_CONFLICT", F.concat("pointer", F.lit("/decimal"))),
    ])


def constraint_rules(docs: DataFrame) -> DataFrame:
    """Keywords that are none, operands that are no numbers where numbers must stand, and subjects that a keyword does not fit."""
    c = B.constraints(docs)
    number = F.coalesce(F.get_json_object("operands", "$.value"), F.col("operands"))
    ordered = c.where(F.col("keyword").isin("minLength", "maxLength") & (number.isNull() | ~number.rlike(r"^\d+$")))
    kinds = B.types(docs).select("doc_id", F.col("identity").alias("type_ref"), "scalar").dropDuplicates(["doc_id", "type_ref"])
    subject = c.join(kinds, ["doc_id", "type_ref"])
    misfit = subject.where((F.col("keyword").isin("pattern", "format") & (F.col("scalar") != "string")) | (F.col("keyword").isin("min", "max", "exclusiveMin", "exclusiveMax") & F.col("scalar").isin("boolean", "any", "bytes", "uuid")))
    return together([
        finding(c.where(~F.col("keyword").isin(*KEYWORDS)), "SCHEMA_VIOLATION", F.concat("pointer", F.lit("/keyword"))),
        finding(ordered, "INVALID_OPERAND", F.concat("pointer", F.lit("/operands"))),
        finding(misfit, "CONSTRAINT_NOT_APPLICABLE"),
    ])


def operand_rules(docs: DataFrame) -> DataFrame:
    """Whole operands outside 128 bits, and patterns that do not compile."""
    c = B.constraints(docs)
    number = F.coalesce(F.get_json_object("operands", "$.value"), F.col("operands"))
    wide = c.where(F.col("keyword").isin("min", "max", "exclusiveMin", "exclusiveMax") & S.is_canonical_integer(number) & ~S.fits_i128(number))
    pattern = c.where(F.col("keyword") == "pattern").withColumn("_ok", D.pattern_compiles(number)).where("NOT _ok")
    return together([finding(wide, "INTEGER_OUTSIDE_I128", F.concat("pointer", F.lit("/operands"))), finding(pattern, "INVALID_PATTERN", F.concat("pointer", F.lit("/operands")))])


def structure_rules(docs: DataFrame) -> DataFrame:
    """Tuples without positions or with wrong names, map bounds, transitions to no state, opaque clauses without a language."""
    t, p = B.types(docs), B.positions(docs)
    bound = t.where("kind = 'map' AND (bound.lower < 0 OR bound.upper < bound.lower)")
    states = B.variants(docs).select("doc_id", "owner", F.col("name").alias("state")).distinct()
    x = B.transitions(docs)
    ends = x.select("doc_id", "owner", F.concat("pointer", F.lit("/from")).alias("pointer"), F.col("src").alias("state")).unionByName(x.select("doc_id", "owner", F.concat("pointer", F.lit("/to")).alias("pointer"), F.col("dst").alias("state")))
    guards = x.where("guard IS NOT NULL").select("doc_id", "owner", F.concat("pointer", F.lit("/guard")).alias("pointer"), F.col("guard").alias("id"))
    return together([
        finding(t.where("kind = 'tuple' AND coalesce(size(positions), 0) < 1"), "INVALID_TUPLE"),
        finding(p.where("name <> concat('p', pos)"), "INVALID_TUPLE_POSITION", F.concat("pointer", F.lit("/name")), F.col("name")),
        finding(p.join(declared(docs).withColumnRenamed("identity", "type_ref"), ["doc_id", "type_ref"], "left_anti"), "UNRESOLVED_POSITION_TYPE", F.concat("pointer", F.lit("/typeRef")), F.col("type_ref")),
        finding(bound, "INVALID_MAP_BOUND", F.concat("pointer", F.lit("/bound"))),
        finding(ends.join(states, ["doc_id", "owner", "state"], "left_anti"), "UNRESOLVED_FEATURE_REF", message=F.col("state")),
        finding(guards.join(B.clauses(docs).select("doc_id", "owner", "id").distinct(), ["doc_id", "owner", "id"], "left_anti"), "DANGLING_CLAUSE_REF", message=F.col("id")),
        finding(B.clauses(docs).where("language IS NULL"), "CLAUSE_LANGUAGE_UNCHECKED", severity="warning"),
    ])


def exact_numbers(documents: DataFrame) -> DataFrame:
    """Numbers of document texts (doc_id, text) that lose digits as doubles."""
    found = documents.select("doc_id", F.explode(D.inexact_numbers("text")).alias("f"))
    return found.select("doc_id", F.regexp_replace("f", "^[A-Z_]+ ", "").alias("pointer"), F.substring_index("f", " ", 1).alias("code"), F.lit("error").alias("severity"), F.lit("").alias("message"))


def relationship_sources(docs: DataFrame) -> DataFrame:
    """Relationships whose source end is not the type that holds them."""
    r = B.relationships(docs).where("sourceEnd.typeRef IS NOT NULL AND sourceEnd.typeRef <> owner")
    return finding(r, "INVALID_RELATIONSHIP_SOURCE", F.concat("pointer", F.lit("/sourceEnd/typeRef")), F.col("sourceEnd.typeRef"))


def redefinition_rules(docs: DataFrame) -> DataFrame:
    """Fields that have the name of an inherited one and do not narrow it: its type kept, its bounds within."""
    t = B.types(docs).select("doc_id", "identity", F.explode("supertypes").alias("super"))
    up = closure.ancestors(t.select(F.concat_ws("\n", "doc_id", "identity").alias("src"), F.concat_ws("\n", "doc_id", "super").alias("dst")))
    above = up.select(F.split("node", "\n")[0].alias("doc_id"), F.split("node", "\n")[1].alias("owner"), F.split("ancestor", "\n")[1].alias("origin"))
    f = B.fields(docs)
    old = f.select("doc_id", F.col("owner").alias("origin"), "name", F.col("type_ref").alias("old_type"), F.col("multiplicity.lower").alias("old_lower"), F.coalesce("multiplicity.upper", F.lit(1 << 62)).alias("old_upper"))
    both = f.join(above, ["doc_id", "owner"]).join(old, ["doc_id", "origin", "name"])
    wider = (F.col("multiplicity.lower") < F.col("old_lower")) | (F.coalesce(F.col("multiplicity.upper"), F.lit(1 << 62)) > F.col("old_upper")) | (F.col("type_ref") != F.col("old_type"))
    return finding(both.where(wider).dropDuplicates(["doc_id", "pointer"]), "INVALID_REDEFINITION", message=F.col("name"))


def package_rules(docs: DataFrame) -> DataFrame:
    """Imports of packages or names that the graph does not give, and rings of imports."""
    p = B.package_rows(docs)
    i = p.select("doc_id", F.col("identity").alias("src"), F.col("pointer").alias("_p"), F.posexplode("imports").alias("_i", "x")).select("doc_id", "src", F.format_string("%s/imports/%d", "_p", "_i").alias("pointer"), F.col("x.identity").alias("identity"), F.col("x.names").alias("names"))
    lost = i.join(p.select("doc_id", "identity").distinct(), ["doc_id", "identity"], "left_anti")
    exported = p.select("doc_id", "identity", F.explode("exports").alias("name")).distinct()
    names = i.join(p.select("doc_id", "identity").distinct(), ["doc_id", "identity"], "left_semi").select("doc_id", "identity", "pointer", F.explode("names").alias("name")).join(exported, ["doc_id", "identity", "name"], "left_anti")
    ring = _ring(i.select("doc_id", F.col("src").alias("a"), F.col("identity").alias("b")), "PACKAGE_CYCLE").withColumn("pointer", F.lit("/packageGraph/packages"))
    return together([finding(lost, "UNRESOLVED_IMPORT", message=F.col("identity")), finding(names, "UNRESOLVED_IMPORT", message=F.col("name")), ring])


def owner_assignment(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """doc_id, child, owner, state of composite children: owned by just one owner that itself stands; refused else.

    Each refusal can orphan others, so refused owners are taken away in rounds until none is new. More than
    `rounds`, if given, is an error.
    """
    r = B.relationships(docs).where("composite").select("doc_id", F.col("target").alias("child"), "owner").distinct()
    several = r.groupBy("doc_id", "child").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "child")
    refused = cut(several, "refused")
    for n in itertools.count():
        if n == rounds:
            raise ValueError(f"refusals go on after {rounds} rounds")
        more = r.join(refused.withColumnRenamed("child", "owner"), ["doc_id", "owner"], "left_semi").select("doc_id", "child").unionByName(refused).distinct()
        new = cut(more, "refused")
        if new.count() == refused.count():
            break
        refused = new
    out = r.join(refused.withColumn("refused", F.lit(True)), ["doc_id", "child"], "left")
    return out.groupBy("doc_id", "child").agg(F.when(F.bool_or("refused"), F.lit(None).cast("string")).otherwise(F.min("owner")).alias("owner"), F.when(F.bool_or("refused"), "refused").otherwise("owned").alias("state"))


def resolve_names(uses: DataFrame, artifacts: DataFrame, kernel: tuple[str, ...] = SCALARS, package: str | None = None) -> DataFrame:
    """uses (use, target) with `how`: kernel scalar, own identity, foreign import, object by id, object by name, enumeration, or unknown.

    artifacts: id, name, kind (object or enumeration). One join on id, one on name; ids win.
    """
    by_id = artifacts.select(F.col("id").alias("target"), F.col("kind").alias("id_kind")).distinct()
    rank = F.when(F.col("kind") == "object", 0).otherwise(1)
    by_name = artifacts.groupBy(F.col("name").alias("target")).agg(F.min_by("kind", rank).alias("name_kind"))
    foreign = F.col("target").startswith("ix://") & ~F.col("target").startswith(f"ix://{package}/" if package else "ix://\0")
    how = F.when(F.lower("target").isin(*kernel), "scalar").when(foreign, "import").when(F.col("id_kind").isNotNull(), F.concat("id_kind", F.lit("-by-id"))).when(F.col("name_kind").isNotNull(), F.concat("name_kind", F.lit("-by-name"))).otherwise("unknown")
    return uses.join(by_id, "target", "left").join(by_name, "target", "left").select("use", "target", how.alias("how"))


def over_limits(documents: DataFrame, max_bytes: int = 4_194_304, max_documents: int = 4_096) -> DataFrame:
    """Texts (doc_id, text) over the size limit, and one row for a bundle of too many documents."""
    long = documents.where(F.octet_length("text") > max_bytes).select("doc_id", F.lit("").alias("pointer"), F.lit("DOCUMENT_TOO_LARGE").alias("code"), F.lit("error").alias("severity"), F.octet_length("text").cast("string").alias("message"))
    many = documents.agg(F.count("*").alias("n")).where(F.col("n") > max_documents).select(F.lit("").alias("doc_id"), F.lit("").alias("pointer"), F.lit("TOO_MANY_DOCUMENTS").alias("code"), F.lit("error").alias("severity"), F.col("n").cast("string").alias("message"))
    return long.unionByName(many)


def unsafe_references(documents: DataFrame) -> DataFrame:
    """JSON Schema texts (doc_id, text) that refer to other hosts."""
    return documents.where(F.col("text").rlike(r'"\$(ref|dynamicRef|schema)"\s*:\s*"https?://(?!json-schema\.org/)')).select("doc_id", F.lit("").alias("pointer"), F.lit("REMOTE_REFERENCE").alias("code"), F.lit("error").alias("severity"), F.lit("").alias("message"))


def effective_fields(docs: DataFrame) -> DataFrame:
    """doc_id, owner, name, origin, distance: own and inherited fields, of one name the nearest (redefined) one."""
    t = B.types(docs).select("doc_id", "identity", F.explode_outer("supertypes").alias("super"))
    e = t.where("super IS NOT NULL").select(F.concat_ws("\n", "doc_id", "identity").alias("src"), F.concat_ws("\n", "doc_id", "super").alias("dst"))
    up = closure.ancestors(e).select(F.split("node", "\n")[0].alias("doc_id"), F.split("node", "\n")[1].alias("owner"), F.split("ancestor", "\n")[1].alias("origin"), "distance")
    f = B.fields(docs).select("doc_id", F.col("owner").alias("origin"), "name", "pos")
    own = f.select("doc_id", F.col("origin").alias("owner"), "origin", F.lit(0).alias("distance"), "name", "pos")
    every = own.unionByName(up.join(f, ["doc_id", "origin"]))
    nth = F.row_number().over(Window.partitionBy("doc_id", "owner", "name").orderBy("distance", "origin"))
    return every.withColumn("_n", nth).where("_n = 1").select("doc_id", "owner", "name", "origin", "distance", "pos")


def validated(docs: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """All findings of documents. Documents that fail the shape rules are not looked at further. Documents are parsed once and written; rules read the members they need."""
    docs = cut(docs, "parsed")
    first = cut(shape(docs), "shape")
    rest = docs.where("well_formed").join(first.select("doc_id").distinct(), "doc_id", "left_anti")
    rest = cut(rest, "shaped")
    return together([first, duplicate_identities(rest), duplicate_names(rest), unresolved_references(rest, exported), unresolved_members(rest), multiple_membership(rest), alias_cycles(rest), composite_cycles(rest), supertype_cycles(rest), field_rules(rest), type_rules(rest), constraint_rules(rest), operand_rules(rest), structure_rules(rest), redefinition_rules(rest), package_rules(rest), relationship_sources(rest)])


def summary(docs: DataFrame) -> DataFrame:
    """Types of each kind with their members: doc_id, kind, types, fields, relationships."""
    t = B.types(docs)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return t.groupBy("doc_id", "kind").agg(F.count("*").alias("types"), F.sum(F.greatest(size("fields"), F.lit(0))).alias("fields"), F.sum(F.greatest(size("relationships"), F.lit(0))).alias("relationships"))
