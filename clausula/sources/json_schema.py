"""JSON Schema bundles as declarations.

A bundle is a set of schema documents (bundle, file, text). Each file declares a type, and what stands anonymous at a
property becomes a type of its own, named after owner and property alone. Schemas are VARIANT values, and every row of the table
that gives a schema its kind is a column expression, so lowering is one pass over the files without a shuffle; only the
verdict on a bundle, which is all or nothing, meets by bundle.

Findings: UNSUPPORTED_SCHEMA_KEYWORD (a keyword outside the closed set, by the node table of the text) and UNSUPPORTED_SCHEMA_SHAPE
(keywords that are known, arranged in a way that no kind covers). A bundle with findings of keywords or of misplaced oneOf has no
others; a bundle with any finding declares nothing. What a type cannot say goes to a ledger of losses, which a closed
register either declares or refuses (UNSUPPORTED_LOSS).

Defined results: a text that is null, no JSON object or repeats a member is a shape finding of its file. Members keep the order of the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausula.plans.tables import cut
from clausula.sources.trees import at, has, is_array, is_number, is_object, items, kind, members, nodes, only, text_at

#: The keywords that have a meaning here, beside the member that carries a type's identity.
KEYWORDS = ("$schema", "$id", "$ref", "type", "properties", "required", "unevaluatedProperties", "not", "description", "const", "enum", "anyOf", "oneOf", "items", "minItems", "pattern", "minLength", "minimum", "maximum")
#: The scalar of a plain type.
SCALARS = {"string": "string", "number": "float64", "integer": "integer", "boolean": "boolean"}
#: What a type cannot say, and the code that declares it.
LOSSES = {
    "unconstrained-value": ("KERNEL_UNCONSTRAINED_VALUE", "any JSON value narrowed to any JSON object"),
    "required-collection-presence": ("KERNEL_REQUIRED_COLLECTION_PRESENCE", "required but possibly empty collapsed to optional"),
}
KEYWORD, SHAPE = "UNSUPPORTED_SCHEMA_KEYWORD", "UNSUPPORTED_SCHEMA_SHAPE"
#: A variant: its name, the name of the type it carries, and that type's scalar where it is a type of its own.
VARIANTS = "array<struct<name:string,payload:string,scalar:string>>"


@dataclass(frozen=True)
class Naming:
    """How identities are spelled: their prefix, the member that states them, and the prefix of diagnostic codes."""

    prefix: str = "ix://kernel"
    member: str = "x-semantic-id"
    codes: str = "kernel"

    def identity(self, name) -> Column:
        return F.concat(F.lit(self.prefix + "/"), name)


@dataclass
class Lowered:
    """types, fields, variants, constraints and losses of the sound bundles, and the findings of the others."""

    types: DataFrame
    fields: DataFrame
    variants: DataFrame
    constraints: DataFrame
    losses: DataFrame
    findings: DataFrame


def segment(c) -> Column:
    """A name with its first code point in upper case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def name_of(url) -> Column:
    """The type name that a $ref or $id stands for."""
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.json$", "")


def _scalar(word: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SCALARS.items() for x in pair])[word]


def _bare(v: Column, naming: Naming) -> Column:
    """Whether v states a plain type and nothing else."""
    return only(v, "type", naming.member) & F.coalesce(text_at(v, "$.type").isin(*SCALARS), F.lit(False))


def _all(values: Column, test) -> Column:
    return F.coalesce(F.forall(values, test), F.lit(False))


def _branch(b: Column, owner: Column, naming: Naming) -> Column:
    """The variant that a closed branch {kind: constant, value: payload} states; null for other branches."""
    properties, tag, payload = at(b, "$.properties"), at(b, "$.properties.kind"), at(b, "$.properties.value")
    names, required = members(properties), F.try_variant_get(b, "$.required", "array<string>")
    to_type = only(payload, "$ref", naming.member) & text_at(payload, '$["$ref"]').isNotNull()
    sound = (
        (text_at(b, "$.type") == "object") & has(properties, "kind") & only(properties, "kind", "value")
        & text_at(tag, "$.const").isNotNull() & only(tag, "const", "type") & (~has(tag, "type") | (text_at(tag, "$.type") == "string"))
        & (F.size(required) == F.size(names)) & (F.size(F.array_except(names, required)) == 0)
        & (F.to_json(at(b, "$.unevaluatedProperties")) == '{"not":{}}') & only(b, "type", "properties", "required", "unevaluatedProperties", "description")
        & (~has(properties, "value") | to_type | _bare(payload, naming))
    )
    name, scalar = text_at(tag, "$.const"), F.when(_bare(payload, naming), _scalar(text_at(payload, "$.type")))
    return F.when(F.coalesce(sound, F.lit(False)), F.struct(name.alias("name"), F.when(scalar.isNotNull(), F.concat(owner, segment(name))).otherwise(name_of(text_at(payload, '$["$ref"]'))).alias("payload"), scalar.alias("scalar")))


def _adjacent(v: Column, owner: Column, naming: Naming) -> Column:
    """Variants of an array of two or more closed branches of different names; null for others."""
    found = F.transform(items(v), lambda b: _branch(b, owner, naming))
    names = F.transform(found, lambda x: x["name"])
    return F.when((F.size(found) >= 2) & F.forall(found, lambda x: x.isNotNull()) & (F.size(F.array_distinct(names)) == F.size(names)), found.cast(VARIANTS))


def _named(values: Column) -> Column:
    """Variants that only have names."""
    return F.transform(values, lambda x: F.struct(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("null")).alias("name"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("string").alias("scalar"))).cast(VARIANTS)


def _refs(v: Column) -> Column:
    """Variants of branches that all are $refs; null for others."""
    target = lambda b: name_of(F.try_variant_get(b, '$["$ref"]', "string"))
    return F.when(_all(items(v), lambda b: has(b, "$ref")), F.transform(items(v), lambda b: F.struct(target(b).alias("name"), target(b).alias("payload"), F.lit(None).cast("string").alias("scalar"))).cast(VARIANTS))


def _primitives(v: Column, owner: Column, naming: Naming) -> Column:
    """Variants of branches that all are plain types; null for others."""
    word = lambda b: text_at(b, "$.type")
    return F.when(_all(items(v), lambda b: _bare(b, naming)), F.transform(items(v), lambda b: F.struct(word(b).alias("name"), F.concat(owner, segment(word(b))).alias("payload"), _scalar(word(b)).alias("scalar"))).cast(VARIANTS))


def _shape(code: str | None = None, ref: Column | None = None, kind: str | None = None, scalar: Column | None = None, variants: Column | None = None, untagged: bool = False, policy: str = "reject") -> Column:
    """What a schema is: a fault's place below it, or a named type, or a type of its own."""
    return F.struct(
        F.lit(code).cast("string").alias("fault"), F.lit(ref).cast("string").alias("ref"), F.lit(kind).cast("string").alias("kind"), F.lit(scalar).cast("string").alias("scalar"),
        F.lit(variants).cast(VARIANTS).alias("variants"), F.lit(untagged).alias("untagged"), F.lit(policy).alias("policy"),
    )


def _property_shape(s: Column, minted: Column, naming: Naming) -> Column:
    """The table of kinds at a property."""
    one, any_, element = at(s, "$.oneOf"), at(s, "$.anyOf"), at(s, "$.items")
    word = text_at(s, "$.type")
    misused = lambda v: has(v, "oneOf") & ~(is_array(at(v, "$.oneOf")) & only(v, "oneOf", naming.member))
    scalar = lambda v: _scalar(text_at(v, "$.type"))
    adjacent, within = _adjacent(one, minted, naming), _adjacent(at(s, "$.items.oneOf"), minted, naming)
    refs, primitives, inner = _refs(any_), _primitives(any_, minted, naming), _primitives(at(s, "$.items.anyOf"), minted, naming)
    return (
        F.when(misused(s), _shape("/oneOf"))
        .when(has(s, "$ref"), _shape(ref=name_of(F.try_variant_get(s, '$["$ref"]', "string"))))
        .when(is_array(one), F.when(adjacent.isNull(), _shape("/oneOf")).otherwise(_shape(kind="union", variants=adjacent)))
        .when(is_array(any_), F.when(primitives.isNotNull(), _shape(kind="union", variants=primitives, untagged=True)).when(refs.isNotNull(), _shape(kind="union", variants=refs, untagged=True)).otherwise(_shape("")))
        .when((word == "string") & text_at(s, "$.const").isNotNull(), _shape(kind="enum", variants=_named(F.array(at(s, "$.const")))))
        .when((word == "string") & is_array(at(s, "$.enum")), _shape(kind="enum", variants=_named(items(at(s, "$.enum")))))
        .when(word == "integer", _shape(kind="scalar", scalar=F.lit("integer")))
        .when(word == "array",
            F.when(misused(element), _shape("/items/oneOf"))
            .when(has(element, "$ref"), _shape(ref=name_of(F.try_variant_get(element, '$["$ref"]', "string"))))
            .when(is_array(at(element, "$.oneOf")), F.when(within.isNull(), _shape("/items/oneOf")).otherwise(_shape(kind="union", variants=within)))
            .when(inner.isNotNull(), _shape(kind="union", variants=inner, untagged=True))
            .when(_bare(element, naming), _shape(kind="scalar", scalar=scalar(element)))
            .otherwise(_shape("")))
        .when(only(s), _shape(kind="record", policy="preserve"))
        .when(_bare(s, naming) | (word == "string"), _shape(kind="scalar", scalar=_scalar(word)))
        .otherwise(_shape(""))
    )


def _file_shape(v: Column, name: Column, naming: Naming) -> Column:
    """The table of kinds of a whole file."""
    one, any_, word = at(v, "$.oneOf"), at(v, "$.anyOf"), text_at(v, "$.type")
    adjacent, refs = _adjacent(one, name, naming), _refs(any_)
    return (
        F.when(~is_object(v), _shape(""))
        .when(F.coalesce(text_at(v, f'$["{naming.member}"]') != naming.identity(name), F.lit(True)), _shape(f"/{naming.member}"))
        .when(has(v, "oneOf") & ~(is_array(one) & only(v, "$schema", "$id", "description", "oneOf", naming.member)), _shape("/oneOf"))
        .when(word == "object", F.when(F.coalesce(F.to_json(at(v, "$.unevaluatedProperties")) == '{"not":{}}', F.lit(False)), _shape(kind="record")).otherwise(_shape("/unevaluatedProperties")))
        .when((word == "string") & is_array(at(v, "$.enum")), _shape(kind="enum", variants=_named(items(at(v, "$.enum")))))
        .when(word == "string", _shape(kind="scalar", scalar=F.lit("string")))
        .when(is_array(one), F.when(adjacent.isNull(), _shape("/oneOf")).otherwise(_shape(kind="union", variants=adjacent)))
        .when(is_array(any_), F.when(refs.isNull(), _shape("/anyOf")).otherwise(_shape(kind="union", variants=refs, untagged=True)))
        .otherwise(_shape(""))
    )


def unknown_keywords(tree: DataFrame, naming: Naming = Naming()) -> DataFrame:
    """bundle, file, keyword, pointer of members outside the closed set. Names below `properties` and `$defs` are data; what stands below an unknown keyword is not looked at.

    One fold along each node's path: 0 a keyword is next, 1 a name is next, 2 this member is unknown, 3 it lies below an unknown one.
    """
    known = F.array(*map(F.lit, (*KEYWORDS, naming.member)))
    step = lambda state, x: (
        F.when(state >= 2, 3).when(state == 1, 0).when(x["indexed"], 0).when(x["path"].isin("properties", "$defs"), 1).when(F.array_contains(known, x["path"]), 0).otherwise(2)
    )
    state = F.aggregate(F.arrays_zip("path", "indexed"), F.lit(0), step)
    return tree.where(state == 2).select("bundle", "file", F.col("key").alias("keyword"), _plain("path").alias("pointer"))


def misplaced_one_of(tree: DataFrame) -> DataFrame:
    """bundle, file, pointer of oneOf members that stand neither at the top, nor at a property, nor at the items of an array property."""
    n, p = F.size("path"), F.col("path")
    below = F.coalesce(F.get(p, F.lit(0)) == "properties", F.lit(False))
    one = tree.where((F.col("key") == "oneOf") & ~F.get("indexed", n - 1) & (n > 1) & ~(below & n.isin(2, 3)))
    array = tree.where((n == 3) & below & (F.col("key") == "type") & (F.col("value") == "array")).select("bundle", "file", F.col("parent").alias("_at"), F.lit(True).alias("_array"))
    owner = F.when(below & (n == 4) & (F.get(p, F.lit(2)) == "items"), F.regexp_replace("pointer", "/items/oneOf$", ""))
    return one.withColumn("_at", owner).join(array, ["bundle", "file", "_at"], "left").where(F.col("_array").isNull()).select("bundle", "file", _plain("path").alias("pointer"))


def _plain(path: str) -> Column:
    """A path as the text that findings show (without escapes)."""
    return F.concat(F.lit("/"), F.array_join(path, "/"))


def references(tree: DataFrame, naming: Naming = Naming()) -> DataFrame:
    """bundle, file, pointer, ref, target, local: every $ref with the type it names and whether the bundle has it. local: the reference as a path among the bundle's files."""
    ids = tree.where((F.size("path") == 0) | (F.col("path") == F.array(F.lit("$id")))).groupBy("bundle", "file").agg(F.max(F.when(F.col("key") == "$id", F.col("value"))).alias("id"))
    have = ids.select("bundle", name_of(F.coalesce("id", "file")).alias("target"), F.lit(True).alias("_has")).distinct()
    refs = tree.where((F.col("key") == "$ref") & (F.col("kind") == "string")).select("bundle", "file", _plain("path").alias("pointer"), F.col("value").alias("ref"), name_of("value").alias("target"))
    return refs.join(have, ["bundle", "target"], "left").select("bundle", "file", "pointer", "ref", "target", F.when(F.col("_has"), F.concat("target", F.lit(".json"))).alias("local"))


def localised(files: DataFrame, base: str) -> DataFrame:
    """bundle, file, text, n_rewritten: absolute references below base (to `Name.json`) become file names of the bundle."""
    found = rf'("\$ref"\s*:\s*")\Q{base.rstrip("/")}\E/(?:[^"/]+/)*([^"/]+\.json")'
    return files.select("bundle", "file", F.regexp_replace("text", found, "$1$2").alias("text"), F.coalesce(F.regexp_count("text", F.lit(found)), F.lit(0)).alias("n_rewritten"))


def _number(v: Column, path: str) -> Column:
    """The number at a path in its shortest decimal form; null for anything else."""
    x, whole = F.try_variant_get(v, path, "double"), F.try_variant_get(v, path, "decimal(38,0)")
    return F.when(is_number(at(v, path)), F.when((x == F.floor(x)) & (F.abs(x) < 1e21), whole.cast("string")).otherwise(x.cast("string")))


def lower(files: DataFrame, naming: Naming = Naming()) -> Lowered:
    """files: bundle, file, text. See the module for findings; tables carry bundle, and names are unique in it unless the bundle repeats them."""
    tree = cut(nodes(files, ("bundle", "file")), "schema-nodes")
    v = F.try_parse_json("text")
    read = cut(files.select("bundle", "file", "text", F.when(is_object(v), v).alias("v")).withColumn("id", text_at(F.col("v"), '$["$id"]')).withColumn("name", name_of(F.coalesce("id", "file"))).select("bundle", "file", "id", "name", "v", F.json_object_keys(F.get_json_object("text", "$.properties")).alias("order")), "schemas")
    shaped = cut(read.withColumn("s", _file_shape(F.col("v"), F.col("name"), naming)), "shapes")

    required = F.coalesce(F.try_variant_get("v", "$.required", "array<string>"), F.array().cast("array<string>"))
    each = shaped.where("s.kind = 'record'").select("bundle", "file", F.col("name").alias("owner"), "order", required.alias("required"), F.explode(F.try_variant_get("v", "$.properties", "map<string,variant>")).alias("property", "p"))
    each = each.withColumn("minted", F.concat("owner", segment("property"))).withColumn("s", _property_shape(F.col("p"), F.col("minted"), naming))
    array = text_at(F.col("p"), "$.type") == "array"
    named = F.array_contains("required", F.col("property"))
    least = F.when(is_number(at(F.col("p"), "$.minItems")), F.try_variant_get("p", "$.minItems", "bigint"))
    lower_ = F.when(F.coalesce(array, F.lit(False)), F.coalesce(least, F.lit(0))).otherwise(named.cast("bigint"))
    properties = cut(each.select(
        "bundle", "file", "owner", "property", "minted", "s", F.array_position("order", F.col("property")).cast("int").alias("pos"), lower_.alias("lower"), F.when(F.coalesce(array, F.lit(False)), F.lit(None)).otherwise(1).cast("bigint").alias("upper"),
        only(F.col("p")).alias("anything"), (F.coalesce(array, F.lit(False)) & named & (lower_ == 0)).alias("may_be_empty"), _number(F.col("p"), "$.minimum").alias("minimum"), _number(F.col("p"), "$.maximum").alias("maximum"),
    ), "properties")

    finding = lambda df, code, place: df.select("bundle", "file", F.lit(code).alias("code"), place.alias("locus"))
    first = finding(unknown_keywords(tree, naming), KEYWORD, F.concat("file", "pointer")).unionByName(finding(misplaced_one_of(tree), SHAPE, F.concat("file", "pointer")))
    first = cut(first, "keywords")
    later = finding(shaped.where("s.fault IS NOT NULL"), SHAPE, F.concat("file", "s.fault")).unionByName(finding(properties.where("s.fault IS NOT NULL"), SHAPE, F.concat(F.lit("/properties/"), "property", "s.fault")))
    version = F.regexp_extract(F.min_by("id", "file"), r"/(\d+\.\d+\.\d+[^/]*)/[^/]+$", 1)
    nameless = read.groupBy("bundle").agg(F.coalesce(version, F.lit("")).alias("version")).where("version = ''")
    later = cut(later.join(first.select("bundle").distinct(), "bundle", "left_anti"), "shapes-found")
    bad = first.select("bundle").union(later.select("bundle")).distinct()
    last = nameless.join(bad, "bundle", "left_anti").select("bundle", F.lit("").alias("file"), F.lit(SHAPE).alias("code"), F.lit("/documents").alias("locus"))
    findings = cut(first.unionByName(later).unionByName(last), "schema-findings")
    bad = findings.select("bundle").distinct()
    sound = lambda df: df.join(bad, "bundle", "left_anti")

    own = shaped.select("bundle", "file", "name", "s")
    minted = properties.where("s.kind IS NOT NULL").select("bundle", "file", F.col("minted").alias("name"), "s")
    both = own.unionByName(minted).where("s.kind IS NOT NULL")
    types = both.select("bundle", "file", "name", naming.identity(F.col("name")).alias("identity"), "s.kind", "s.scalar", F.col("s.policy").alias("unknown_policy"), "s.untagged")
    variants = both.select("bundle", "file", F.col("name").alias("owner"), F.posexplode("s.variants").alias("pos", "x")).select("bundle", "file", "owner", "pos", "x.*")
    payloads = variants.where("scalar IS NOT NULL").select("bundle", "file", F.col("payload").alias("name"), naming.identity(F.col("payload")).alias("identity"), F.lit("scalar").alias("kind"), "scalar", F.lit("reject").alias("unknown_policy"), F.lit(False).alias("untagged"))
    fields = properties.where("s.fault IS NULL").select(
        "bundle", "owner", (F.col("pos") - 1).alias("pos"), F.col("property").alias("name"), naming.identity(F.concat_ws("/", "owner", "property")).alias("identity"),
        naming.identity(F.coalesce("s.ref", "minted")).alias("type_ref"), F.when(F.col("lower") >= 1, "required").otherwise("optional").alias("presence"), "lower", "upper",
    )
    bound = lambda c, keyword: properties.where((F.col("s.scalar") == "integer") & F.col("s.kind").isNotNull() & F.col("upper").isNotNull() & F.col(c).isNotNull()).select("bundle", F.col("minted").alias("owner"), F.lit(keyword).alias("keyword"), F.col(c).alias("value"), F.lit(f"{naming.codes}.{keyword.upper()}").alias("diagnostic_code"))
    loss = lambda c, name: properties.where(F.col(c)).select("bundle", F.concat_ws(".", "owner", "property").alias("construct"), F.lit(name).alias("loss"))
    return Lowered(
        types=sound(types.unionByName(payloads)).drop("file"),
        fields=sound(fields),
        variants=sound(variants.select("bundle", "owner", "pos", "name", naming.identity(F.concat(F.col("owner"), F.lit("/variant/"), F.col("name"))).alias("identity"), naming.identity(F.col("payload")).alias("payload"))),
        constraints=sound(bound("minimum", "min").unionByName(bound("maximum", "max"))),
        losses=sound(loss("anything", "unconstrained-value").unionByName(loss("may_be_empty", "required-collection-presence"))),
        findings=findings,
    )


def decided(losses: DataFrame, register: DataFrame) -> DataFrame:
    """bundle, construct, outcome, code: a loss whose construct the register (construct, loss) names is declared; any other is refused."""
    codes = F.create_map(*[F.lit(x) for name, (code, _) in LOSSES.items() for x in (name, code)])
    found = losses.join(register.select("construct", "loss", F.lit(True).alias("_named")).distinct(), ["construct", "loss"], "left")
    return found.select("bundle", "construct", F.when(F.col("_named"), "declared-loss").otherwise("refused").alias("outcome"), F.when(F.col("_named"), codes[F.col("loss")]).otherwise("UNSUPPORTED_LOSS").alias("code"))


def assembled(lowered: Lowered, naming: Naming = Naming()) -> DataFrame:
    """doc_id (the bundle), text: a contract document of each sound bundle, for bundles.parsed. Types stand in order of name."""
    multiplicity = F.struct("lower", "upper", F.lit(False).alias("ordered"), F.lit(False).alias("unique"))
    field = F.struct("pos", F.struct("identity", "name", F.col("type_ref").alias("typeRef"), "presence", F.lit(False).alias("nullable"), multiplicity.alias("multiplicity")).alias("f"))
    fields = lowered.fields.groupBy("bundle", F.col("owner").alias("name")).agg(F.transform(F.array_sort(F.collect_list(field)), lambda x: x["f"]).alias("fields"))
    variant = F.struct("pos", F.struct("identity", "name", "payload").alias("v"))
    variants = lowered.variants.groupBy("bundle", F.col("owner").alias("name")).agg(F.transform(F.array_sort(F.collect_list(variant)), lambda x: x["v"]).alias("variants"))
    constraint = F.struct(F.concat(naming.identity(F.col("owner")), F.lit("/constraint/"), "keyword").alias("identity"), "keyword", F.col("value").alias("operands"), F.col("diagnostic_code").alias("diagnosticCode"))
    constraints = lowered.constraints.groupBy("bundle", F.col("owner").alias("name")).agg(F.array_sort(F.collect_list(constraint)).alias("constraints"))
    t = reduce(lambda df, more: df.join(more, ["bundle", "name"], "left"), [fields, variants, constraints], lowered.types)
    fitting = lambda c, *kinds: F.when(F.col("kind").isin(*kinds), F.coalesce(F.col(c), F.array().cast(t.schema[c].dataType))).alias(c)
    one = F.struct("name", "identity", F.col("name").alias("displayName"), "kind", "scalar", F.col("unknown_policy").alias("unknownPolicy"), fitting("fields", "record"), fitting("variants", "union", "enum"), "constraints")
    documents = t.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("name", F.to_json(one).alias("j")))).alias("types"))
    body = F.array_join(F.transform("types", lambda x: x["j"]), ",")
    return documents.select(F.col("bundle").cast("string").alias("doc_id"), F.concat(F.lit('{"ir":{"contractVersion":"2.0.0","types":['), body, F.lit("]}}")).alias("text"))
