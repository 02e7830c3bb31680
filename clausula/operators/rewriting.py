"""Rewriting of JSON documents as node tables: members dropped, defaults written out, lists put in order, and canonical texts made again.

Documents keep every member, known or not, since nothing is read through a schema. A rewriting is a filter, a union or a join on
the node table of sources.trees. Canonical text (sorted members by UTF-16 code units, shortest numbers, few escapes) is made of the nodes in
order of their sort keys: a node writes its separator, its name and its scalar or opening bracket, and closes what ends before the
next node. Depth costs no rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausula.functions import documents as D
from clausula.functions import scalars as S

NODE = ("pointer", "parent", "path", "indexed", "key", "pos", "kind", "value")


def pattern(c: str = "path") -> Column:
    """A node's path with `*` for places in lists."""
    return F.array_join(F.transform(F.arrays_zip(c, "indexed"), lambda x: F.when(x["indexed"], "*").otherwise(x["path"])), ".")


def dropped(tree: DataFrame, *names: str, below: str | None = None) -> DataFrame:
    """Nodes but for members of these names and all below them; below: a pattern of paths that holds them (a regular expression), everywhere if none is given."""
    member = F.exists(F.arrays_zip("path", "indexed"), lambda x: ~x["indexed"] & x["path"].isin(*names))
    if below is not None:
        member = pattern().rlike(rf"^(?:{below})\.(?:{'|'.join(names)})(?:\.|$)")
    return tree.where(~member)


def with_member(tree: DataFrame, keys: list[str], at: str, name: str, kind: Column, value: Column, replace: bool = True) -> DataFrame:
    """tree with a scalar member of each object at a pattern of paths. kind and value may read `old_kind` and `old_value` of the member that is replaced (null if there is none)."""
    objects = tree.where((pattern() == at) & (F.col("kind") == "object")).select(*keys, F.col("pointer").alias("parent"), F.col("path").alias("_path"), F.col("indexed").alias("_indexed"))
    old = tree.where((F.col("key") == name) & ~F.get("indexed", F.size("indexed") - 1))
    old = old.select(*keys, "parent", F.col("kind").alias("old_kind"), F.col("value").alias("old_value"))
    new = objects.join(old, [*keys, "parent"], "left")
    if not replace:
        new = new.where("old_kind IS NULL")
    new = new.select(*keys, F.concat("parent", F.lit("/" + name.replace("~", "~0").replace("/", "~1"))).alias("pointer"), "parent", F.concat("_path", F.array(F.lit(name))).alias("path"), F.concat("_indexed", F.array(F.lit(False))).alias("indexed"), F.lit(name).alias("key"), F.lit(1 << 30).alias("pos"), kind.alias("kind"), value.alias("value"))
    inside = pattern().rlike(rf"^{_literal(at)}\.{_literal(name)}(?:\.|$)") if at else pattern().rlike(rf"^{_literal(name)}(?:\.|$)")
    return (tree.where(~inside) if replace else tree).select(*keys, *NODE).unionByName(new)


def _literal(path: str) -> str:
    return path.replace(".", r"\.").replace("*", r"\*")


def materialised(tree: DataFrame, keys: list[str] = ["doc_id"], under: str = "ir") -> DataFrame:  # noqa: B006
    """`nullable` of fields and parameters as a literal: true only where true is written."""
    for at in ("types.*.fields.*", "types.*.operations.*.params.*"):
        truth = F.when((F.col("old_kind") == "boolean") & (F.col("old_value") == "true"), "true").otherwise("false")
        tree = with_member(tree, keys, f"{under}.{at}" if under else at, "nullable", F.lit("boolean"), truth)
    return tree


def described(tree: DataFrame, keys: list[str] = ["doc_id"], under: str = "ir", algorithm: str = "rfc8785-v1") -> DataFrame:  # noqa: B006
    """The document states how its canonical text is made."""
    name = f"{under}.canonicalization" if under else "canonicalization"
    there = pattern().rlike(rf"^{_literal(name)}(?:\.|$)")
    root = tree.where((pattern() == under) & (F.col("kind") == "object"))
    at, path = F.concat("pointer", F.lit("/canonicalization")), F.concat("path", F.array(F.lit("canonicalization")))
    false = F.array(F.lit(False))
    one = root.select(*keys, at.alias("pointer"), F.col("pointer").alias("parent"), path.alias("path"), F.concat("indexed", false).alias("indexed"), F.lit("canonicalization").alias("key"), F.lit(0).alias("pos"), F.lit("object").alias("kind"), F.lit(None).cast("string").alias("value"))
    two = root.select(*keys, F.concat(at, F.lit("/algorithm")).alias("pointer"), at.alias("parent"), F.concat(path, F.array(F.lit("algorithm"))).alias("path"), F.concat("indexed", false, false).alias("indexed"), F.lit("algorithm").alias("key"), F.lit(0).alias("pos"), F.lit("string").alias("kind"), F.lit(algorithm).alias("value"))
    return tree.where(~there).select(*keys, *NODE).unionByName(one).unionByName(two)


def ordered_by(tree: DataFrame, keys: list[str], at: str, member: str = "identity") -> DataFrame:
    """tree with the entries of the lists at a pattern of paths in order of a member of theirs (UTF-16 code units); entries without it come last, as they stood."""
    depth = len(at.split(".")) + 1
    entry = tree.where((F.size("path") == depth) & (pattern() == f"{at}.*")).select(*keys, F.col("pointer").alias("_e"), "parent", "pos")
    name = tree.where(pattern() == f"{at}.*.{member}").select(*keys, F.col("parent").alias("_e"), S.utf16_key("value").alias("_rank"))
    place = F.row_number().over(Window.partitionBy(*keys, "parent").orderBy(F.asc_nulls_last("_rank"), "pos")) - 1
    moved = entry.join(name, [*keys, "_e"], "left").select(*keys, "_e", place.alias("_to"))
    head = F.array_join(F.slice(F.split("pointer", "/"), 1, depth + 1), "/")
    x = tree.withColumn("_e", F.when(F.size("path") >= depth, head)).join(moved, [*keys, "_e"], "left")
    put = lambda c, n: F.transform(c, lambda v, i: F.when(i == n, F.col("_to").cast("string")).otherwise(v))
    pointer, parent = (F.array_join(put(F.split(c, "/"), depth), "/") for c in ("pointer", "parent"))
    to = F.col("_to").isNotNull()
    own = to & (F.size("path") == depth)
    return x.select(*keys, F.when(to, pointer).otherwise(F.col("pointer")).alias("pointer"), F.when(to & ~own, parent).otherwise(F.col("parent")).alias("parent"), F.when(to, put("path", depth - 1)).otherwise(F.col("path")).alias("path"), "indexed",
                    F.when(own, F.col("_to").cast("string")).otherwise(F.col("key")).alias("key"), F.when(own, F.col("_to")).otherwise(F.col("pos")).alias("pos"), "kind", "value")


def _escaped(c: Column) -> Column:
    """A string as JSON text with the escapes that are needed and no others."""
    named = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    plain = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), named.items(), c)
    rest = reduce(lambda x, i: F.replace(x, F.lit(chr(i)), F.lit(f"\\u{i:04x}")), [i for i in range(32) if chr(i) not in named], plain)
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), rest).otherwise(plain), F.lit('"'))


def texts(tree: DataFrame, keys: list[str] = ["doc_id"], start: int = 0) -> DataFrame:  # noqa: B006
    """keys, text: the canonical text of the nodes of each distinct value of the keys; start: how many parts of their paths lie above the root.

    A container is two tokens, its bracket before and after what it holds, so one sort puts a text together. The nodes of a text meet in one
    group, whose size is the text's own.
    """
    path, listed = F.slice("path", start + 1, 1 << 20), F.slice("indexed", start + 1, 1 << 20)
    order = F.zip_with(path, listed, lambda p, i: F.when(i, F.lpad(p, 10, "0")).otherwise(S.utf16_key(p)))
    x = tree.where((F.size("path") >= start) & (F.col("kind") != "malformed")).select(*keys, "parent", "key", "kind", "value", order.alias("order"), F.size(path).alias("depth"), F.get(listed, F.size(path) - 1).alias("listed"))
    first = F.row_number().over(Window.partitionBy(*keys, "parent", F.col("depth") > 0).orderBy("order")) == 1
    scalar = F.when(F.col("kind") == "string", _escaped(F.col("value"))).when(F.col("kind") == "number", D.canonical_json(F.when(F.col("kind") == "number", F.col("value")))).when(F.col("kind") == "null", "null").otherwise(F.col("value"))
    body = F.when(F.col("kind") == "object", "{").when(F.col("kind") == "array", "[").otherwise(scalar)
    inner = F.col("depth") > 0
    before = F.concat(F.when(inner & ~first, ",").otherwise(""), F.when(inner & ~F.coalesce("listed", F.lit(False)), F.concat(_escaped(F.col("key")), F.lit(":"))).otherwise(""))
    opens = x.select(*keys, "order", F.concat(before, body).alias("token"))
    closes = x.where(F.col("kind").isin("object", "array")).select(*keys, F.concat("order", F.array(F.lit("~"))).alias("order"), F.when(F.col("kind") == "object", "}").otherwise("]").alias("token"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("order", "token"))), lambda t: t["token"])
    return opens.unionByName(closes).groupBy(*keys).agg(F.array_join(ordered, "").alias("text"))


def residue(tree: DataFrame, at: str, modelled: tuple[str, ...]) -> DataFrame:
    """doc_id, pointer, text: of each entry at a pattern of paths, the canonical text of the members that are not modelled."""
    depth = len(at.split("."))
    entry = F.array_join(F.slice(F.split("pointer", "/"), 1, depth + 1), "/")
    prefix = F.array_join(F.transform(F.slice(F.arrays_zip("path", "indexed"), 1, depth), lambda x: F.when(x["indexed"], "*").otherwise(x["path"])), ".")
    below = tree.where((F.size("path") >= depth) & (prefix == at)).withColumn("entry", entry)
    left = below.where((F.size("path") == depth) | ~F.coalesce(F.get("path", F.lit(depth)), F.lit("")).isin(*modelled))
    return texts(left, ["doc_id", "entry"], depth).select("doc_id", F.col("entry").alias("pointer"), "text")


def normalised(tree: DataFrame) -> DataFrame:
    """doc_id, text: the normal form of each document: nullable written out, and how its canonical text is made."""
    return texts(described(materialised(tree)))


def compared(before: DataFrame, after: DataFrame, drop: tuple[str, ...] = ("origin",)) -> DataFrame:
    """doc_id, same: documents of two node tables in normal form, without members that do not count. Null where only one has the document."""
    form = lambda t, name: normalised(dropped(t, *drop)).withColumnRenamed("text", name)
    return form(before, "a").join(form(after, "b"), "doc_id", "full").select("doc_id", (F.col("a") == F.col("b")).alias("same"))
