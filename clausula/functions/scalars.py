"""Scalar functions of the contract language as Catalyst columns: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text forms of the contract language.
SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*))*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?$"
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
DURATION = r"^P(?!$)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d{1,9})?S)?)?$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
URI = r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"
BASE64 = r"^[A-Za-z0-9+/]*={0,2}$"
CANONICAL_INTEGER = r"^(0|-?[1-9][0-9]*)$"
CANONICAL_DECIMAL = r"^(0|-?(?:[1-9][0-9]*(?:\.[0-9]*[1-9])?|0\.[0-9]*[1-9]))$"
RATIONAL = r"^(0|-?[1-9][0-9]*)(?:/([1-9][0-9]*))?$"
IDENTITY = r"^ix://[A-Za-z0-9._~-]+(?:/[A-Za-z0-9._~-]+)+$"
PACKAGE = r"^[a-z][a-z0-9]*(?:[._-][a-z0-9]+)*$"
I128_MAX, I128_MIN_ABS = "170141183460469231731687303715884105727", "170141183460469231731687303715884105728"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Names and identities


def slug(c) -> Column:
    """Runs of other characters as one hyphen, none at the ends; null if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(col(c), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s != "", s)


def screaming(c) -> Column:
    return F.upper(F.replace(slug(c), F.lit("-"), F.lit("_")))


def member_segment(c) -> Column:
    """The name if it may stand as a member, else null."""
    return F.when(col(c).rlike(r"^[A-Za-z][A-Za-z0-9_]*$"), col(c))


def id_segment(c) -> Column:
    return F.when(col(c).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), col(c))


def mint_identity(package, slot, *parts) -> Column:
    """ix://package/slot/part-..., null if a part has no slug."""
    slugs = [slug(p) for p in parts]
    whole = slugs[0].isNotNull()
    for s in slugs[1:]:
        whole &= s.isNotNull()
    return F.when(whole, F.concat(F.lit("ix://"), col(package), F.lit("/"), col(slot), F.lit("/"), F.concat_ws("/", *slugs)))


def relationship_identity(package, record, verb, target) -> Column:
    return mint_identity(package, F.lit("relationship"), F.concat_ws("-", slug(record), slug(verb), slug(target)))


def constraint_identity(package, record, field, keyword) -> Column:
    return mint_identity(package, F.lit("constraint"), record, field, keyword)


def diagnostic_code(package, record, field, keyword) -> Column:
    return F.concat_ws("_", screaming(package), screaming(record), screaming(field), screaming(keyword))


def is_identity(c) -> Column:
    return col(c).rlike(IDENTITY)


def is_package_identity(c) -> Column:
    return col(c).rlike(PACKAGE)


def truncate_echo(c, limit: int = 64) -> Column:
    s = col(c)
    return F.when(F.char_length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("…"))).otherwise(s)


# Versions


def is_semver(c) -> Column:
    return col(c).rlike(SEMVER)


def _version_parts(c) -> Column:
    """Struct major, minor, patch (digits as text, of any length), pre (array of identifiers); null if no version."""
    s = col(c)
    part = lambda i: F.regexp_extract(s, SEMVER, i)
    pre = F.when(part(4) == "", F.array().cast("array<string>")).otherwise(F.split(part(4), r"\."))
    return F.when(is_semver(s), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), pre.alias("pre")))


def parse_version(c) -> Column:
    """Struct major, minor, patch, pre (array of identifiers); null if no version. A part past 64 bits is null; version_key orders these too."""
    v = _version_parts(c)
    return F.when(v.isNotNull(), F.struct(*[v[k].try_cast("long").alias(k) for k in ("major", "minor", "patch")], v["pre"].alias("pre")))


def _digits_key(c) -> Column:
    """Orders spellings of whole numbers without leading zeros, of any length."""
    return F.struct(F.char_length(c).alias("length"), c.alias("digits"))


def version_key(c) -> Column:
    """A struct that sorts by precedence: a release after its prereleases, numbers before words, fewer identifiers first."""
    v = _version_parts(c)
    each = F.transform(v["pre"], lambda p: F.struct((~p.rlike(r"^\d+$")).alias("word"), F.when(p.rlike(r"^\d+$"), F.char_length(p)).otherwise(F.lit(0)).alias("length"), p.alias("text")))
    return F.struct(_digits_key(v["major"]).alias("major"), _digits_key(v["minor"]).alias("minor"), _digits_key(v["patch"]).alias("patch"), (F.size(v["pre"]) == 0).alias("release"), each.alias("pre"))


def satisfies(version, constraint) -> Column:
    """Exact, or caret: same leftmost number that is not 0, and no lower precedence; prereleases only of the named version."""
    caret, base = F.startswith(col(constraint), F.lit("^")), F.regexp_replace(col(constraint), r"^\^", "")
    v, b = _version_parts(version), _version_parts(base)
    band = F.when(b["major"] != "0", v["major"] == b["major"]).when(b["minor"] != "0", (v["major"] == "0") & (v["minor"] == b["minor"])).otherwise((v["major"] == "0") & (v["minor"] == "0") & (v["patch"] == b["patch"]))
    at_least = version_key(version) >= version_key(base)
    same = (v["major"] == b["major"]) & (v["minor"] == b["minor"]) & (v["patch"] == b["patch"])
    pre_ok = (F.size(v["pre"]) == 0) | (same & (F.size(b["pre"]) > 0))
    return F.coalesce(F.when(caret, band & at_least & pre_ok).otherwise(version_key(version) == version_key(base)), F.lit(False))


# Numbers


def is_canonical_integer(c) -> Column:
    return col(c).rlike(CANONICAL_INTEGER)


def fits_i128(c) -> Column:
    """A canonical integer of at most 128 bits with sign: by length, then digit by digit."""
    s = col(c)
    digits = F.regexp_replace(s, "^-", "")
    most = F.when(F.startswith(s, F.lit("-")), F.lit(I128_MIN_ABS)).otherwise(F.lit(I128_MAX))
    n = F.char_length(digits)
    return is_canonical_integer(s) & ((n < 39) | ((n == 39) & (digits <= most)))


def integer_key(c) -> Column:
    """A struct that sorts canonical integers of any length."""
    s = col(c)
    minus = F.startswith(s, F.lit("-"))
    digits = F.regexp_replace(s, "^-", "")
    n = F.char_length(digits)
    turned = F.translate(digits, "0123456789", "9876543210")
    return F.struct((~minus).alias("sign"), F.when(minus, -n).otherwise(n).alias("length"), F.when(minus, turned).otherwise(digits).alias("digits"))


def is_canonical_decimal(c) -> Column:
    return col(c).rlike(CANONICAL_DECIMAL)


def normal_decimal(c) -> Column:
    """Decimal text without an exponent, leading or trailing zeros, or a sign at zero."""
    s = F.regexp_replace(F.regexp_replace(col(c), r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    s = F.when(F.contains(s, F.lit(".")), F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")).otherwise(s)
    return F.when(s == "-0", F.lit("0")).otherwise(s)


def within_decimal(c, precision: int, scale: int) -> Column:
    """Decimal text of at most `scale` fraction digits and precision - scale others."""
    s = normal_decimal(c)
    whole = F.regexp_replace(F.regexp_extract(s, r"^-?(\d+)", 1), "^0$", "")
    return is_canonical_decimal(s) & (F.char_length(F.regexp_extract(s, r"\.(\d+)$", 1)) <= scale) & (F.char_length(whole) <= precision - scale)


def let(value: Column, then) -> Column:
    """then(value) with value worked out once, however often then names it."""
    return F.get(F.transform(F.array(value), then), 0)


def decimal_compare(a, b) -> Column:
    """-1, 0 or 1, exactly, for decimal texts or whole numbers of any length; null where one is no decimal without an exponent."""
    part = lambda s: F.regexp_extract(s, r"\.(\d+)$", 1)
    whole = lambda s, n: F.regexp_replace(F.concat(F.regexp_extract(s, r"^(-?\d+)", 1), F.rpad(part(s), n, "0")), r"^(-?)0+(?=\d)", "$1")
    level = lambda t: F.greatest(F.char_length(part(t["x"])), F.char_length(part(t["y"])))
    key = lambda c: let(c, integer_key)
    order = lambda t: F.when(t["p"] < t["q"], -1).when(t["p"] > t["q"], 1).otherwise(0)
    both = lambda t: let(level(t), lambda n: let(F.struct(key(whole(t["x"], n)).alias("p"), key(whole(t["y"], n)).alias("q")), order))
    text = lambda c: let(col(c).cast("string"), normal_decimal)
    return let(F.struct(text(a).alias("x"), text(b).alias("y")), lambda t: F.when(is_canonical_decimal(t["x"]) & is_canonical_decimal(t["y"]), both(t)))


def float32_exact(c) -> Column:
    return col(c).cast("float").cast("double") == col(c).cast("double")


def number_parts(c) -> Column:
    """Struct sign, digits, exponent of a JSON number, digits without zeros at either end."""
    s = col(c)
    form = r"^(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?$"
    whole, part = F.regexp_extract(s, form, 2), F.regexp_extract(s, form, 3)
    exponent = F.coalesce(F.when(F.regexp_extract(s, form, 4) != "", F.regexp_extract(s, form, 4).cast("int")), F.lit(0))
    both = F.regexp_replace(F.concat(whole, part), "^0+", "")
    digits = F.regexp_replace(both, "0+$", "")
    shift = exponent - F.char_length(part) + F.char_length(both) - F.char_length(digits)
    zero = digits == ""
    return F.struct(F.when((F.regexp_extract(s, form, 1) == "-") & ~zero, -1).otherwise(F.when(zero, 0).otherwise(1)).alias("sign"), digits.alias("digits"), F.when(zero, 0).otherwise(shift).alias("exponent"))


def exact_number_kind(c) -> Column:
    """INEXACT_INTEGER of whole values past 2**53 in any spelling, INEXACT_NUMBER of others that a double's shortest spelling does not give back, else null."""
    p = number_parts(c)
    size, magnitude = F.char_length(p["digits"]), F.char_length(p["digits"]) + p["exponent"]
    whole = p["exponent"] >= 0
    wide = (magnitude > 16) | ((magnitude == 16) & (F.rpad(p["digits"], 16, "0") > "9007199254740992"))
    read = col(c).try_cast("double")
    back = number_parts(read.cast("string"))
    kept = (size <= 15) & (magnitude > -300)
    kept = kept | F.coalesce((size <= 17) & (back["digits"] == p["digits"]) & (back["exponent"] == p["exponent"]), F.lit(False))
    return F.when((size > 0) & whole & wide, "INEXACT_INTEGER").when((size > 0) & ~kept, "INEXACT_NUMBER")


def gcd(a, b) -> Column:
    """Greatest common divisor of two bigints by Euclid's steps; 92 are enough for 64 bits."""
    start = F.struct(F.abs(col(a)).alias("a"), F.abs(col(b)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))))["a"]


def canonical_rational(c) -> Column:
    """n or n/d in lowest terms, d at least 2; null if no rational."""
    s = col(c)
    ok = s.rlike(RATIONAL)
    n = F.when(ok, F.regexp_extract(s, RATIONAL, 1)).cast("long")
    d = F.when(ok, F.coalesce(F.nullif(F.regexp_extract(s, RATIONAL, 2), F.lit("")), F.lit("1"))).cast("long")
    g = F.greatest(gcd(n, d), F.lit(1))
    p, q = (n - n % g) / g, (d - d % g) / g
    p, q = p.cast("long"), q.cast("long")
    return F.when(ok, F.when(q == 1, p.cast("string")).otherwise(F.concat(p.cast("string"), F.lit("/"), q.cast("string"))))


def is_collection(upper) -> Column:
    return col(upper).isNull() | (col(upper) > 1)


# Text, bytes and times


def code_points(c) -> Column:
    return F.char_length(col(c))


def is_base64(c) -> Column:
    return col(c).rlike(BASE64) & (F.char_length(col(c)) % 4 == 0)


def base64_octets(c) -> Column:
    """Octets of padded base 64; null if it is not canonical."""
    s = col(c)
    ok = is_base64(s) & (F.regexp_replace(F.base64(F.unbase64(s)), r"\s", "") == s)
    return F.when(ok, F.octet_length(F.unbase64(s)))


def matches_format(c, name: str) -> Column:
    """uuid, date, date-time, duration, email or uri."""
    s = col(c)
    if name == "date":
        return s.rlike(DATE) & F.try_to_date(s, "yyyy-MM-dd").isNotNull()
    if name == "date-time":
        return s.rlike(DATE_TIME) & F.try_to_timestamp(F.upper(s)).isNotNull()
    return s.rlike({"uuid": UUID, "duration": DURATION, "email": EMAIL, "uri": URI}[name])


def date_instant(c) -> Column:
    """Nanoseconds since the epoch of a date, as decimal(38,0)."""
    return F.unix_date(F.try_to_date(col(c).cast("string"), "yyyy-MM-dd")).cast("decimal(38,0)") * F.lit(86_400_000_000_000).cast("decimal(38,0)")


def date_time_instant(c) -> Column:
    """Nanoseconds since the epoch of an RFC 3339 date-time: microseconds of the instant and the digits past them."""
    s = col(c)
    ok = s.rlike(DATE_TIME)
    micros = F.unix_micros(F.try_to_timestamp(F.when(ok, F.upper(F.regexp_replace(s, r"(\.\d{1,6})\d*", "$1")))))
    fraction = F.rpad(F.regexp_extract(s, r"\.(\d+)", 1), 9, "0")
    return micros.cast("decimal(38,0)") * 1000 + F.substring(fraction, 7, 3).cast("decimal(38,0)")


def duration_micros(c) -> Column:
    """Microseconds of a day-time duration; null if it has years or months, which have no fixed length."""
    s = col(c)
    n = lambda unit: F.coalesce(F.nullif(F.regexp_extract(s, unit, 1), F.lit("")).cast("decimal(20,9)"), F.lit(0).cast("decimal(20,9)"))
    ok = s.rlike(DURATION) & ~s.rlike(r"^P(\d+Y|\d+M)")
    seconds = n(r"(\d+)W") * 604800 + n(r"(\d+)D") * 86400 + n(r"T.*?(\d+)H") * 3600 + n(r"T.*?(\d+)M") * 60 + n(r"(\d+(?:\.\d+)?)S")
    return F.when(ok, (seconds * 1_000_000).cast("long"))


def digest(c) -> Column:
    return F.sha2(col(c), 256)


# Pointers


def pointer_escape(c) -> Column:
    return F.replace(F.replace(col(c), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_split(c) -> Column:
    """Reference tokens of a pointer, unescaped."""
    parts = F.split(col(c), "/")
    tokens = F.when(col(c) == "", F.array().cast("array<string>")).otherwise(F.slice(parts, F.lit(2), F.size(parts) - 1))
    return F.transform(tokens, lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def pointer_ancestors(c) -> Column:
    """The pointer and all that enclose it, the document ('') first."""
    parts = F.split(col(c), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def line_of(text, offset) -> Column:
    return F.size(F.split(F.substring(col(text), F.lit(1), col(offset)), "\n"))


def column_of(text, offset) -> Column:
    return F.char_length(F.element_at(F.split(F.substring(col(text), F.lit(1), col(offset)), "\n"), -1)) + 1


def utf16_key(c) -> Column:
    """A text that sorts by UTF-16 code units, where plain texts sort by code points."""
    return F.hex(F.encode(col(c), "UTF-16BE"))


def enum_member_equals(value, members: list[str], scalar: str) -> Column:
    """Whether a text is one of an enumeration's, as numbers where the scalar is one: 1.0 and 1 are one decimal."""
    if scalar in ("decimal", "integer"):
        return normal_decimal(value).isin(*members) | normal_decimal(value).isin(*[m.rstrip("0").rstrip(".") if "." in m else m for m in members])
    if scalar in ("float32", "float64"):
        return col(value).cast("double").isin(*[float(m) for m in members])
    return col(value).isin(*members)


def effective_multiplicity(m) -> Column:
    """Lower (1 where absent), upper (null: no bound), ordered, unique (false where absent)."""
    m = col(m)
    return F.struct(F.coalesce(m["lower"], F.lit(1)).alias("lower"), m["upper"].alias("upper"), F.coalesce(m["ordered"], F.lit(False)).alias("ordered"), F.coalesce(m["unique"], F.lit(False)).alias("unique"))
