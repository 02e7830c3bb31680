"""Classification of the change between two versions of a contract, as full joins of node tables.

Ranks, least to most restrictive: patch, additive, conditional, unknown, breaking, invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausula.functions import scalars as S

# The ranks in order, and the scalar changes that widen.
RANKS = ("patch", "additive", "conditional", "unknown", "breaking", "invalid")
WIDENINGS = (("date", "datetime"), ("float32", "float64"))


def rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RANKS)), c).cast("int")


def rank_name(n: Column) -> Column:
    return F.get(F.array(*map(F.lit, RANKS)), n - 1)


def paired(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """A full join with the structs b and a, null where the node is missing."""
    rest = [c for c in before.columns if c not in key]
    b = before.select(*key, F.struct(*rest).alias("b"), F.lit(True).alias("in_b"))
    a = after.select(*key, F.struct(*rest).alias("a"), F.lit(True).alias("in_a"))
    return b.join(a, key, "full_outer")


def scalar_change(b: Column, a: Column) -> Column:
    widened = F.lit(False)
    for x, y in WIDENINGS:
        widened |= (b == x) & (a == y)
    return F.when(b.eqNullSafe(a), F.lit(None).cast("string")).when(widened, "conditional").otherwise("breaking")


def multiplicity_change(b: Column, a: Column) -> Column:
    """Of structs lower, upper, ordered, unique: additive if wider."""
    top = lambda m: F.coalesce(m["upper"], F.lit(1 << 62))
    flags = b["ordered"].eqNullSafe(a["ordered"]) & b["unique"].eqNullSafe(a["unique"])
    same = flags & b["lower"].eqNullSafe(a["lower"]) & b["upper"].eqNullSafe(a["upper"])
    return F.when(same, F.lit(None).cast("string")).when(~flags, "breaking").when((a["lower"] <= b["lower"]) & (top(a) >= top(b)), "additive").otherwise("breaking")


def diff_types(before: DataFrame, after: DataFrame) -> DataFrame:
    """identity, change, classification of types (identity, kind, scalar, display_name, unknown_policy)."""
    p = paired(before, after, ["identity"])
    b, a = F.col("b"), F.col("a")
    one = lambda name, when, cls: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("change"), cls.alias("classification")))
    both = F.col("in_b") & F.col("in_a")
    changed = lambda c: both & ~b[c].eqNullSafe(a[c])
    kept = both & b["kind"].eqNullSafe(a["kind"])
    events = F.array_compact(F.array(
        one("removed", F.col("in_a").isNull(), F.lit("breaking")),
        one("added", F.col("in_b").isNull(), F.lit("additive")),
        one("kind", changed("kind"), F.lit("breaking")),
        one("scalar", kept & changed("scalar"), scalar_change(b["scalar"], a["scalar"])),
        one("display_name", changed("display_name"), F.lit("patch")),
        one("unknown_policy", changed("unknown_policy"), F.when(a["unknown_policy"] == "reject", "breaking").otherwise("conditional")),
    ))
    return p.select("identity", F.explode(events).alias("e")).select("identity", "e.change", "e.classification")


def diff_fields(before: DataFrame, after: DataFrame, policy: str = "reject") -> DataFrame:
    """Changes of fields (owner, name, type_ref, required, nullable, unit, default_value, lower, upper)."""
    p = paired(before, after, ["owner", "name"])
    b, a = F.col("b"), F.col("a")
    both = F.col("in_b") & F.col("in_a")
    one = lambda name, when, cls: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("change"), cls.alias("classification")))
    changed = lambda c: both & ~b[c].eqNullSafe(a[c])
    top = lambda s: F.coalesce(s["upper"], F.lit(1 << 62))
    events = F.array_compact(F.array(
        one("removed", F.col("in_a").isNull(), F.lit("breaking")),
        one("added", F.col("in_b").isNull(), F.when(a["required"], "breaking").otherwise(F.lit("conditional" if policy == "reject" else "additive"))),
        one("type", changed("type_ref"), F.lit("breaking")),
        one("presence", changed("required"), F.when(a["required"], "breaking").otherwise("additive")),
        one("nullable", changed("nullable"), F.when(a["nullable"], "conditional").otherwise("breaking")),
        one("unit", changed("unit"), F.lit("breaking")),
        one("default", changed("default_value"), F.lit("conditional")),
        one("multiplicity", changed("lower") | changed("upper"), F.when((a["lower"] <= b["lower"]) & (top(a) >= top(b)), "additive").otherwise("breaking")),
    ))
    return p.select("owner", "name", F.explode(events).alias("e")).select("owner", "name", "e.change", "e.classification")


def diff_constraints(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of constraints (owner, keyword, value: text, scalar: of the subject, and any other members).

    Added: breaking. Removed: conditional for a bound of an integer or decimal whose scalar stays, else breaking.
    A bound whose operand is written otherwise but equal: patch; loosened: conditional; anything else about
    operands: breaking. Other members alone: patch. Bounds are compared exactly, whatever their length; an
    integer's bound must be canonical integer text, else its direction is not known.
    """
    p = paired(before, after, ["owner", "keyword"])
    b, a, keyword = F.col("b"), F.col("a"), F.col("keyword")
    scalar = F.coalesce(b["scalar"], a["scalar"])
    bound = scalar.isin("integer", "decimal") & keyword.isin("min", "max", "exclusiveMin", "exclusiveMax")
    stays = bound & (b["scalar"].eqNullSafe(a["scalar"]) | ~F.coalesce("in_b", F.lit(False)) | ~F.coalesce("in_a", F.lit(False)))
    form = lambda v: F.when(scalar == "integer", S.is_canonical_integer(v)).otherwise(S.is_canonical_decimal(v))
    order = F.when(form(b["value"]) & form(a["value"]), S.decimal_compare(b["value"], a["value"]))
    looser = F.when(keyword.isin("min", "exclusiveMin"), order > 0).otherwise(order < 0)
    operand = ~b["value"].eqNullSafe(a["value"])
    change = F.when(F.col("in_a").isNull(), "removed").when(F.col("in_b").isNull(), "added").when(operand, "operand").when(~b.eqNullSafe(a), "member")
    moved = F.when(stays & (order == 0), "patch").when(stays & looser, "conditional").otherwise("breaking")
    kind = F.when(F.col("change") == "added", "breaking").when(F.col("change") == "removed", F.when(stays, "conditional").otherwise("breaking")).when(F.col("change") == "member", "patch").otherwise(moved)
    return p.withColumn("change", change).where("change IS NOT NULL").select("owner", "keyword", "change", kind.alias("classification"))


def diff_members(before: DataFrame, after: DataFrame, key: list[str], added: str = "additive", removed: str = "breaking") -> DataFrame:
    """Added and removed rows of a node table: variants, relationships, operations, populations, positions."""
    cols = [F.col(k) for k in key]
    gone = before.join(after.select(*key).distinct(), key, "left_anti").select(*cols, F.lit("removed").alias("change"), F.lit(removed).alias("classification"))
    new = after.join(before.select(*key).distinct(), key, "left_anti").select(*cols, F.lit("added").alias("change"), F.lit(added).alias("classification"))
    return gone.unionByName(new)


def diff_variants(before: DataFrame, after: DataFrame, union: bool = False, rejects: bool = False) -> DataFrame:
    """Changes of variants (owner, name): removed breaking; added to a union additive, to an enumeration conditional, or breaking where a consumer rejects unknown ones."""
    return diff_members(before, after, ["owner", "name"], added="additive" if union else "breaking" if rejects else "conditional")


def diff_operations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of operations (owner, name, params: array, returns): added additive, removed or changed breaking."""
    p = paired(before, after, ["owner", "name"])
    change = F.when(F.col("in_a").isNull(), "removed").when(F.col("in_b").isNull(), "added").when(~F.col("b").eqNullSafe(F.col("a")), "signature")
    return p.withColumn("change", change).where("change IS NOT NULL").select("owner", "name", "change", F.when(F.col("change") == "added", "additive").otherwise("breaking").alias("classification"))


def diff_relationships(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of relationships (owner, identity, ...): added conditional, removed or changed breaking."""
    p = paired(before, after, ["owner", "identity"])
    change = F.when(F.col("in_a").isNull(), "removed").when(F.col("in_b").isNull(), "added").when(~F.col("b").eqNullSafe(F.col("a")), "changed")
    return p.withColumn("change", change).where("change IS NOT NULL").select("owner", "identity", "change", F.when(F.col("change") == "added", "conditional").otherwise("breaking").alias("classification"))


def worst(changes: DataFrame, key: str) -> DataFrame:
    """The most restrictive classification of each key, folded before the shuffle."""
    return changes.groupBy(key).agg(F.max(rank(F.col("classification"))).alias("r")).select(key, rank_name(F.col("r")).alias("classification"))
