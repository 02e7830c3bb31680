"""Functions of whole JSON documents that columns cannot express; Arrow-batched pandas UDFs, made when a plan uses them."""

from __future__ import annotations

import json
import math
import re
import struct
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: float) -> str:
    """The shortest spelling that reads back, as ECMAScript writes it."""
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    _, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    d, n = "".join(map(str, digits)), len(digits) + exponent
    if len(d) <= n <= 21:
        body = d + "0" * (n - len(d))
    elif 0 < n <= 21:
        body = f"{d[:n]}.{d[n:]}"
    elif -6 < n <= 0:
        body = "0." + "0" * -n + d
    else:
        body = (d if len(d) == 1 else f"{d[0]}.{d[1:]}") + f"e{'+' if n > 0 else '-'}{abs(n - 1)}"
    return ("-" if x < 0 else "") + body


def canonical(value) -> str:
    """Canonical JSON: members by UTF-16 units, numbers as number_text, no spaces."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number_text(float(value))
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=lambda s: s.encode("utf-16-be", "surrogatepass"))) + "}"


def _or_null(f):
    def g(*args):
        try:
            return None if args[0] is None else f(*args)
        except (ValueError, KeyError, IndexError, TypeError, OverflowError, RecursionError):
            return None

    return g


def _each(f, kind: str, *columns) -> Column:
    """f of each row's values; null where it fails or the first is null."""
    safe = _or_null(f)

    def rows(*series: pd.Series) -> pd.Series:
        return pd.Series([safe(*v) for v in zip(*series)], dtype=object)

    if len(columns) == 1:
        return F.pandas_udf(lambda a: rows(a), kind)(*columns)
    return F.pandas_udf(lambda a, b: rows(a, b), kind)(*columns)


def canonical_json(text) -> Column:
    """Canonical form of a JSON text; null if it is no JSON."""
    return _each(lambda t: canonical(json.loads(t)), "string", text)


class _Repeated(ValueError):
    pass


def _members(pairs):
    names = [k for k, _ in pairs]
    if len(set(names)) < len(names):
        raise _Repeated
    return dict(pairs)


def _has_repeated(text: str) -> bool:
    try:
        json.loads(text, object_pairs_hook=_members)
        return False
    except _Repeated:
        return True


def repeats_member(text) -> Column:
    """Whether an object of a JSON text names a member twice; null if it is no JSON."""
    return _each(_has_repeated, "boolean", text)


def _split(pointer: str) -> list[str]:
    if pointer and pointer[0] != "/":
        raise ValueError("not a pointer")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]


def resolve(document, pointer: str):
    for t in _split(pointer):
        document = document[int(t)] if isinstance(document, list) else document[t]
    return document


def apply_patch(document, ops: list[dict]):
    """RFC 6902 operations one after the other; `x-repeat` applies an operation n times with $i and $n replaced."""
    document = json.loads(json.dumps(document))
    for op in ops:
        n = op.get("x-repeat")
        if n is not None:
            body = json.dumps({k: v for k, v in op.items() if k != "x-repeat"})
            for i in range(n):
                document = apply_patch(document, [json.loads(body.replace("$i", str(i)).replace("$n", str(n)))])
            continue
        kind, path = op["op"], _split(op["path"])
        value = json.loads(json.dumps(op.get("value")))
        if kind in ("copy", "move"):
            value = json.loads(json.dumps(resolve(document, op["from"])))
        if kind == "move":
            document = apply_patch(document, [{"op": "remove", "path": op["from"]}])
        if kind == "test":
            if canonical(resolve(document, op["path"])) != canonical(value):
                raise ValueError("test failed")
            continue
        if not path:
            document = value
            continue
        at = resolve(document, "".join("/" + t.replace("~", "~0").replace("/", "~1") for t in path[:-1]))
        last = path[-1]
        if isinstance(at, list):
            i = len(at) if last == "-" else int(last)
            if i > len(at) or (kind != "add" and kind not in ("copy", "move") and i >= len(at)):
                raise IndexError(last)
            if kind == "remove":
                del at[i]
            elif kind == "replace":
                at[i] = value
            else:
                at.insert(i, value)
        elif kind == "remove":
            del at[last]
        elif kind == "replace" and last not in at:
            raise KeyError(last)
        else:
            at[last] = value
    return document


def patched(text, ops) -> Column:
    """Canonical text of a document after a patch; null if either fails."""
    return _each(lambda t, o: canonical(apply_patch(json.loads(t), json.loads(o))), "string", text, ops)


def at_pointer(text, pointer) -> Column:
    """Canonical text of the value at a pointer; null if there is none."""
    return _each(lambda t, p: canonical(resolve(json.loads(t), p)), "string", text, pointer)


def normal_form(text, form: str) -> Column:
    """Unicode normalisation: NFC, NFD, NFKC or NFKD."""
    return _each(lambda t: unicodedata.normalize(form, t), "string", text)


def count_nodes(value) -> int:
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return 1 + sum(map(count_nodes, inner))


def node_count(text) -> Column:
    return _each(lambda t: count_nodes(json.loads(t)), "long", text)


def _compiles(pattern: str) -> bool:
    # The common part of both dialects; named groups and backreferences to them are spelled another way, code point escapes too.
    text = re.sub(r"\(\?<(?![=!])", "(?P<", pattern)
    text = re.sub(r"\\k<(\w+)>", r"(?P=\1)", text)
    text = re.sub(r"\\u\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), text)
    text = re.sub(r"\\[pP]\{[\w=]+\}", r"\\w", text)
    try:
        re.compile(text)
        return True
    except (re.error, OverflowError, ValueError):
        return False


def pattern_compiles(text) -> Column:
    """Whether a text is a pattern; null for null."""
    return _each(_compiles, "boolean", text)


def locate(text: str, pointer: str) -> tuple[int, int]:
    """Line and column, from 1, at which the value of a pointer starts in a JSON text."""
    decoder, blank = json.JSONDecoder(), re.compile(r"[ \t\r\n]*")
    skip = lambda i: blank.match(text, i).end()
    at = skip(0)
    for token in _split(pointer):
        if text[at] == "{":
            found, i = None, skip(at + 1)
            while text[i] != "}":
                name, i = decoder.raw_decode(text, i)
                value = skip(skip(i) + 1)
                if name == token:
                    found = value  # of repeated names the last
                i = skip(decoder.raw_decode(text, value)[1])
                i = skip(i + 1) if text[i] == "," else i
            if found is None:
                raise KeyError(token)
            at = found
        elif text[at] == "[":
            i = skip(at + 1)
            for n in range(int(token) + 1):
                if text[i] == "]":
                    raise IndexError(token)
                if n < int(token):
                    i = skip(decoder.raw_decode(text, i)[1])
                    i = skip(i + 1) if text[i] == "," else i
            at = i
        else:
            raise KeyError(token)
    before = text[:at]
    return before.count("\n") + 1, at - (before.rfind("\n") + 1) + 1


def position(text, pointer) -> Column:
    """`line:column` of a pointer's value in a JSON text; null if there is none."""
    return _each(lambda t, p: "{}:{}".format(*locate(t, p)), "string", text, pointer)


def next_float32(x: float, up: bool = True) -> float:
    """The single-precision number next to one, where bounds of doubles must be kept in floats."""
    bits = struct.unpack("<i", struct.pack("<f", x))[0]
    if x == 0:
        return struct.unpack("<f", struct.pack("<i", 1))[0] * (1 if up else -1)
    return struct.unpack("<f", struct.pack("<i", bits + (1 if (x > 0) == up else -1)))[0]


class _Spelled(str):
    """A number as it was written."""


def inexact(text: str) -> list[str]:
    """`CODE pointer` of numbers of a JSON text that a double does not hold: whole ones past 2**53 in any spelling, others that are not the shortest spelling's value."""
    out = []

    def walk(value, pointer):
        if isinstance(value, _Spelled):
            exact = Decimal(value)
            whole = exact.as_tuple().exponent >= 0 or exact == exact.to_integral_value()
            if whole and abs(exact) > 9007199254740992:
                out.append(f"INEXACT_INTEGER {pointer}")
            elif not whole and exact != Decimal(repr(float(value))):
                out.append(f"INEXACT_NUMBER {pointer}")
        elif isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}")
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{pointer}/{i}")

    walk(json.loads(text, parse_int=_Spelled, parse_float=_Spelled), "")
    return out


def inexact_numbers(text) -> Column:
    """Array of `CODE pointer`; null if the text is no JSON."""
    return _each(inexact, "array<string>", text)
