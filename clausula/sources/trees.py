"""JSON texts of any shape as node tables: a row a value, addressed by its pointer.

Nesting has no bound that columns could be unrolled to, so the walk over one text is a small helper in Arrow batches;
everything after it is columns and joins. Numbers keep the digits they were written with. Of a repeated member the last counts.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "pointer string, parent string, path array<string>, indexed array<boolean>, key string, pos int, kind string, value string"


class _Number(str):
    pass


def _refuse(word: str):
    raise ValueError(word)


def _walk(text: str | None):
    """pointer, parent, path, indexed, key, pos, kind, value of each value of a text, parents first."""
    try:
        root = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
    except (ValueError, TypeError, RecursionError):
        yield "", None, [], [], None, 0, "malformed", None
        return
    todo = [(root, "", None, [], [], None, 0)]
    while todo:
        x, pointer, parent, path, indexed, key, pos = todo.pop()
        if isinstance(x, dict):
            kind, value, inner, index = "object", None, list(x.items()), False
        elif isinstance(x, list):
            kind, value, inner, index = "array", None, [(str(i), y) for i, y in enumerate(x)], True
        else:
            kind = "number" if isinstance(x, _Number) else "string" if isinstance(x, str) else "null" if x is None else "boolean"
            value, inner, index = None if x is None else str(x).lower() if isinstance(x, bool) else str(x), [], False
        yield pointer, parent, path, indexed, key, pos, kind, value
        for i in range(len(inner) - 1, -1, -1):
            k, y = inner[i]
            todo.append((y, f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", pointer, [*path, k], [*indexed, index], k, i))


ENTRY = "collection string, entry int, rel string, pointer string, key string, pos int, kind string, value string"


def _open(text: str | None, collections: tuple[str, ...], out: tuple[list, ...]) -> int:
    """Adds the columns of ENTRY of one text to out; how many rows that are."""
    try:
        root = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
    except (ValueError, TypeError, RecursionError):
        return 0
    ir = root.get("ir") if isinstance(root, dict) else None
    names, places_of, rels, pointers, keys, places, kinds, values = out
    before = len(rels)
    for name in collections if isinstance(ir, dict) else ():
        found = ir.get(name)
        top = f"/ir/{name.replace('~', '~0').replace('/', '~1')}"
        for entry, item in enumerate(found if isinstance(found, list) else ()):
            todo = [(item, None, f"{top}/{entry}", str(entry), entry)]
            start = len(rels)
            while todo:
                x, rel, pointer, key, pos = todo.pop()
                rels.append(rel or "")
                pointers.append(pointer)
                keys.append(key)
                places.append(pos)
                if isinstance(x, dict):
                    kinds.append("object")
                    values.append(None)
                    inner, i = "" if rel is None else f"{rel}.", len(x)
                    for k in reversed(x):
                        i -= 1
                        step = k.replace("~", "~0").replace("/", "~1") if "~" in k or "/" in k else k
                        todo.append((x[k], inner + k, f"{pointer}/{step}", k, i))
                elif isinstance(x, list):
                    kinds.append("array")
                    values.append(None)
                    inner = "*" if rel is None else f"{rel}.*"
                    for i in range(len(x) - 1, -1, -1):
                        todo.append((x[i], inner, f"{pointer}/{i}", str(i), i))
                else:
                    kinds.append("number" if isinstance(x, _Number) else "string" if isinstance(x, str) else "null" if x is None else "boolean")
                    values.append(None if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x))
            places_of.extend([entry] * (len(rels) - start))
            names.extend([name] * (len(rels) - start))
    return len(rels) - before


def entries(texts: DataFrame, *collections: str) -> DataFrame:
    """The nodes of the entries of lists /ir/<collection> of texts (doc_id, text), without lists of steps: doc_id, collection, entry (its place),
    rel (the path below the entry with * for places, joined by dots), and pointer, key, pos, kind, value as in `nodes`. Rules take it as they take a whole node table."""
    schema = T.StructType([*texts.select("doc_id").schema, *T._parse_datatype_string(ENTRY)])
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            at, out = [], tuple([] for _ in types)
            flush = lambda: pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(at, pa.int64())), *map(pa.array, out, types)], schema.names)  # noqa: B023, E731
            for i, value in enumerate(b["text"]):
                at += [i] * _open(value.as_py(), collections, out)
                if len(at) >= 20_000:
                    yield flush()
                    at, out = [], tuple([] for _ in types)
            if at:
                yield flush()

    return texts.select("doc_id", "text").mapInArrow(run, schema)


def nodes(texts: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The keys of each text with its nodes: pointer, parent, path (member names and indexes), indexed (which of the path are
    indexes), key, pos among siblings, kind (object, array, string, number, boolean, null), value (of scalars). A text that is
    no JSON, a null one too, is one node of kind malformed."""
    schema = T.StructType([*texts.select(*keys).schema, *T._parse_datatype_string(NODE)])
    names, columns = list(keys), [f.name for f in T._parse_datatype_string(NODE)]
    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.string(), pa.int32(), pa.string(), pa.string()]

    def batch(b, at, rows):
        return pa.RecordBatch.from_arrays([*(b[k].take(pa.array(at, pa.int64())) for k in names), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [*names, *columns])

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, value in enumerate(b[text]):
                for row in _walk(value.as_py()):
                    at.append(i)
                    rows.append(row)
                    if len(rows) == 20_000:
                        yield batch(b, at, rows)
                        at, rows = [], []
            if rows:
                yield batch(b, at, rows)

    return texts.select(*keys, text).mapInArrow(run, schema)


# Columns over VARIANT values.


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """The type's name (OBJECT..., ARRAY..., STRING, BIGINT...); empty where there is no value."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def is_object(v: Column) -> Column:
    return kind(v).startswith("OBJECT")


def is_array(v: Column) -> Column:
    return kind(v).startswith("ARRAY")


def is_number(v: Column) -> Column:
    return kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")


def text_at(v: Column, path: str) -> Column:
    """The string at a path; null for anything else."""
    return F.when(kind(at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def members(v: Column) -> Column:
    """Names of an object's members; null for anything else."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def items(v: Column) -> Column:
    """An array's elements; null for anything else."""
    return F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>"))


def has(v: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(members(v), name), F.lit(False))


def only(v: Column, *names: str) -> Column:
    """Whether v is an object with no members but these."""
    return F.coalesce(F.size(F.array_except(members(v), F.array(*map(F.lit, names)))) == 0, F.lit(False))
