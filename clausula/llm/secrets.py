"""Secret scan with DataFrame functions only: fixed patterns, and a character Markov model.

Base spans come from three patterns. Further spans come from two first-order character Markov
models, one of random strings and one of ordinary identifiers: of a run of key characters, each
piece of 20 or more that base spans leave is reported (kind `markov`) where the log-likelihood ratio
of the two models is at least MIN_RATIO in all and MIN_MEAN a step. Of any other piece the parts are
that have the greatest sums of ratios less MIN_MEAN along it (a fold that starts again where a sum
is used up or MIN_RATIO below its peak), each widened to the next of `=/_-` on both sides, if 20
characters or more and if it, or the part of CORE or more characters it was widened from, is at
least as likely. So a key is found whatever words are joined to it. Both models are trained here from labelled
samples: SAMPLES random strings (label 1, digests of numbers written in hexadecimal, base 64 or a
cut alphabet) and SAMPLES identifiers (label 0, common words joined in the usual styles). The
samples are made by a rule, so the model is the same for every input; its table has a fixed size.

A kind's matches are leftmost and do not overlap. Positions are code points: the text is split at
the pattern, and lengths of gaps and matches are added up, in blocks of BLOCK and blocks of blocks, so
that no array grows an entry at a time beyond a block. What base spans leave of a run is found by
halving in the sorted gaps between them. Nothing shuffles; each text is read in
one pass, and the steps after the first test run only for texts that match.

Defined results: a null text is empty and has no spans. A null doc_id and repeated rows stay rows
of their own. Other columns are carried by scan() and redacted(). An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausula.llm.shared import apart

SAMPLES = 4000
MIN_RATIO, MIN_MEAN = 12.0, 0.35
LEAST, CORE = 20, 12
BLOCK = 64
_LOW, _WIDE = 43, 80  # the table covers the characters from `+` to `z`

KINDS = ("assign", "access", "hex", "markov")
KEY_NAME = "(?i:password|passwd|secret|token|api_?key)"
#: Each pattern gives the same spans as the plain form; look-arounds only make failing fast.
PATTERNS = {
    "assign": r"(?=[pstaPSTA])(" + KEY_NAME + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",  # of a run, what follows the first AKIA is longest
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "markov": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}",
}
# Words of ordinary identifiers.
WORDS = (
    "account action address admin after agent alert alias allow amount apply archive array assert asset async attach author backup balance base batch before block board body bound branch bridge browser buffer build bundle button cache calendar call cancel channel check child class clean client clone close cluster code collect color column command commit compare compile config connect console container content context control copy count create cursor customer data database date debug decode default define delete deploy describe detail device diff directory disable dispatch display document domain download driver edit element email enable encode engine entry error event example execute export extend factory fetch field file filter find first flag float folder format frame function gateway general generate global group handle handler hash header height help history home host html icon image import index info init input insert install instance integer interface internal invoice item iterator javascript job join json kernel keyboard label language last layer layout length level library license limit line link list listen load local location lock logger login long main manager map mask master match maximum media member memory menu merge message method metric minimum mode model module monitor mount name network node notification number object offset open operation option order output owner package page panel param parent parse partition patch path pattern payment plugin point policy pool port position post preview print private process product profile project prompt property protocol provider proxy public publish query queue quick random range read record redirect reference refresh region register release remote remove render repeat replace report request require reset resource response result return review role root route rule sample scale schedule schema scope screen script scroll search section select send sequence server service session setting shadow shape share shell signal simple size slice socket sort source spec split stack stage standard start state static status step stop storage store stream string style submit subscribe summary support switch symbol sync system table target task template terminal test text theme thread throw time title toggle tool topic total trace track transaction transfer transform tree trigger type unit update upload user util valid value variable vector vendor version view visible wait warning watch web widget width window worker wrapper write zone "
    "und der schaft heit keit lich ung ver ein auf mente cion que est ment eau tion leur"
).split()


def _samples(spark: SparkSession) -> DataFrame:
    """Labelled samples: label (1 random, 0 ordinary), text."""
    i = F.col("id")
    pick = lambda n, *c: F.element_at(F.array(*map(F.lit, c)), (F.pmod(F.xxhash64(i, F.lit(n)), F.lit(len(c))) + 1).cast("int"))
    word = lambda n: F.element_at(F.split(F.lit(" ".join(WORDS)), " "), (F.pmod(F.xxhash64(i, F.lit(n)), F.lit(len(WORDS))) + 1).cast("int"))
    digest = F.sha2(F.concat(F.lit("sample"), i.cast("string")), 256)
    long64 = F.base64(F.unhex(digest))
    kind = F.pmod(i, F.lit(4))
    random = F.when(kind == 0, F.substring(digest, 1, 40)).when(kind == 1, F.upper(F.substring(F.regexp_replace(long64, "[+/=]", ""), 1, 32))).otherwise(F.substring(F.regexp_replace(long64, "[=]", ""), 1, 40))
    title = lambda n: F.initcap(word(n))
    plain = (
        F.when(kind == 0, F.concat(word(1), title(2), title(3), title(4)))
        .when(kind == 1, F.concat_ws("_", word(1), word(2), word(3), pick(9, "id", "v2", "2024", "key", "01")))
        .when(F.pmod(i, F.lit(8)) == 2, F.concat(title(1), word(2), word(3), word(4), pick(9, "", "1", "12", "s")))
        .when(F.pmod(i, F.lit(8)) == 3, F.concat_ws("/", word(1), word(2), F.concat(word(3), pick(9, "-", "_"), word(4))))
        .when(F.pmod(i, F.lit(8)) == 6, F.upper(F.concat_ws("_", word(1), word(2), word(3))))
        .otherwise(F.concat(word(1), pick(9, "-", "--", "=", "/"), word(2), pick(9, "-", "--", "=", "/"), pick(8, "2023", "10", "100", "x"), pick(9, "-", "--", "=", "/"), word(3)))
    )
    ids = spark.range(0, SAMPLES, 1, 1)
    return ids.select(F.lit(1).alias("label"), random.alias("text")).unionByName(ids.select(F.lit(0).alias("label"), plain.alias("text")))


def train(spark: SparkSession) -> list[float]:
    """Log ratio of each step between two characters, by (first - _LOW) * _WIDE + second - _LOW. At most 2 * 80 * 80 rows are collected."""
    codes = F.transform(F.split("text", ""), lambda c: F.ascii(c) - _LOW)
    steps = _samples(spark).select("label", codes.alias("c")).where("size(c) > 1").select("label", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * _WIDE + b)).alias("step"))
    n = np.full((2, _WIDE, _WIDE), 0.3)
    for r in steps.groupBy("label", "step").count().collect():
        n[r["label"], r["step"] // _WIDE, r["step"] % _WIDE] += r["count"]
    p = n / n.sum(2, keepdims=True)
    return np.round(np.log(p[1] / p[0]), 4).ravel().tolist()


def _ratio(word: Column, table: list[float]) -> Column:
    held = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")  # folded to one literal
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c) - _LOW)
    steps = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * _WIDE + b)
    return F.aggregate(steps, F.lit(0.0), lambda s, k: s + F.get(held, k))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _blocks(values: Column) -> Column:
    """An array, which is not empty, in arrays of BLOCK entries."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))


def _before(values: Column, join) -> Column:
    """For each entry of an array of numbers, which is not empty, the sum (or what join makes, from 0) of those before it."""
    zero = F.lit(0).cast("long")
    whole = lambda a: F.aggregate(a, zero, join)

    def plain(a):
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(a, start, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def split(a, rest):
        inner = lambda blocks, so_far: F.flatten(F.transform(blocks, lambda b, i: F.transform(plain(b), lambda x: join(F.get(so_far, i), x))))
        return _let(_blocks(a), lambda blocks: _let(rest(F.transform(blocks, whole)), lambda so_far: inner(blocks, so_far)))

    return _let(values, lambda a: split(a, lambda b: split(b, plain)))


def _count(values: Column, holds) -> Column:
    """How many entries at the head of an array a condition holds for, that holds for a head of it; found by halving."""
    powers = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    return F.aggregate(powers, F.lit(0), lambda n, p: F.when((n + p <= F.size(values)) & F.coalesce(holds(F.get(values, n + p - 1)), F.lit(False)), n + p).otherwise(n))


def _put(out: Column, block: Column, one: Column) -> tuple[Column, Column]:
    """out and block with one more entry: a full block goes to out as one entry."""
    full = F.size(block) >= BLOCK
    return F.when(full, F.concat(out, F.array(block))).otherwise(out), F.when(full, F.array(one)).otherwise(F.concat(block, F.array(one)))


_PARTS = "array<struct<first:int,end:int>>"


def _parts(word: Column, table: list[float]) -> Column:
    """Array of (first, end) of the random parts of a word, which is read as a whole first."""
    held = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    struct = lambda **c: F.struct(*[x.alias(k) for k, x in c.items()])
    likely = lambda ratio, n: ratio >= F.greatest(F.lit(MIN_RATIO), MIN_MEAN * (n - 1))
    zero = F.lit(0.0)
    peak = "array<struct<first:int,end:int,top:double>>"
    start = struct(first=F.lit(0), end=F.lit(0), sum=zero, peak=zero, raw=zero, top=zero, out=F.array().cast(f"array<{peak}>"), block=F.array().cast(peak))

    def put(a):
        """The filled arrays, where the present part has a peak with it."""
        out, block = _put(a["out"], a["block"], struct(first=a["first"], end=a["end"], top=a["top"]))
        return F.when(a["peak"] > 0, out).otherwise(a["out"]), F.when(a["peak"] > 0, block).otherwise(a["block"])

    def step(a, x):
        s, raw, at = a["sum"] + x["k"] - MIN_MEAN, a["raw"] + x["k"], x["at"].cast("int")
        ended, higher = (s <= 0) | (s < a["peak"] - MIN_RATIO), s > a["peak"]
        out, block = put(a)
        new = struct(first=at + 1, end=at + 1, sum=zero, peak=zero, raw=zero, top=zero, out=out, block=block)
        on = struct(first=a["first"], end=F.when(higher, at + 2).otherwise(a["end"]), sum=s, peak=F.greatest(a["peak"], s), raw=raw, top=F.when(higher, raw).otherwise(a["top"]), out=a["out"], block=a["block"])
        return F.when(ended, new).otherwise(on)

    def all_put(a):
        out, block = put(a)
        return F.flatten(F.concat(out, F.array(block)))

    def wider(parts):
        """Parts from the last separator before them to the next one after them; equal neighbours once."""
        sizes = F.transform(F.split(word, "[=/_-]", -1), lambda p: F.char_length(p).cast("long"))
        ends = lambda sizes: F.zip_with(_before(F.transform(sizes, lambda n: n + 1), lambda a, b: a + b), sizes, lambda at, n: struct(first=at.cast("int"), end=(at + n).cast("int")))

        def of(pieces):
            first = lambda x: F.get(pieces, _count(pieces, lambda p: p["first"] <= x["first"]) - 1)["first"]
            end = lambda x: F.get(pieces, _count(pieces, lambda p: p["end"] < x["end"]))["end"]
            return F.transform(parts, lambda x: struct(first=first(x), end=end(x), core=(x["end"] - x["first"] >= CORE) & (x["top"] >= MIN_RATIO)))

        return _let(_let(_let(sizes, ends), of), lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1) != x)))

    def joined(parts):
        """Parts that overlap as one."""
        empty = struct(last=F.lit(None).cast("struct<first:int,end:int>"), out=F.array().cast(f"array<{_PARTS}>"), block=F.array().cast(_PARTS))

        def together(a, x):
            last = a["last"]
            out, block = _put(a["out"], a["block"], last)
            one = struct(last=struct(first=x["first"], end=x["end"]), out=F.when(last.isNull(), a["out"]).otherwise(out), block=F.when(last.isNull(), a["block"]).otherwise(block))
            more = struct(last=struct(first=F.least(last["first"], x["first"]), end=F.greatest(last["end"], x["end"])), out=a["out"], block=a["block"])
            return F.when(last["end"] > x["first"], more).otherwise(one)

        return F.aggregate(parts, empty, together, lambda a: F.flatten(F.concat(a["out"], F.array(F.when(a["last"].isNull(), a["block"]).otherwise(F.concat(a["block"], F.array(a["last"])))))))

    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c) - _LOW)

    def of(codes):
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * _WIDE + b)
        steps = F.transform(pairs, lambda k, at: struct(k=F.get(held, k), at=at))
        wide = _let(F.aggregate(steps, start, step, all_put), wider)
        good = F.filter(wide, lambda x: (x["end"] - x["first"] >= LEAST) & (x["core"] | likely(_ratio(F.substring(word, x["first"] + 1, x["end"] - x["first"]), table), x["end"] - x["first"])))
        return joined(good)

    whole = F.array(struct(first=F.lit(0), end=F.char_length(word))).cast(_PARTS)
    return F.when(likely(_ratio(word, table), F.char_length(word)), whole).otherwise(_let(codes, of))


def _spans(text: str, kind: int, least: int = 0) -> Column:
    """Array of (start, kind, end, word) of a pattern's matches in document order; least: characters of group 2."""
    p, t = F.lit(PATTERNS[KINDS[kind]]), F.col(text)
    whole = F.regexp_extract_all(t, p, F.lit(0))
    value = F.regexp_extract_all(t, p, F.lit(2)) if least else whole
    gaps = F.split(t, PATTERNS[KINDS[kind]], -1)
    rows = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value")), lambda x: F.struct(x["gap"].alias("gap"), x["whole"].alias("whole"), x["value"].alias("value")))
    sizes = lambda rows: F.transform(rows, lambda x: (F.char_length(x["gap"]) + F.char_length(x["whole"])).cast("long"))

    def span(x, at):
        begin = at + F.char_length(x["gap"])
        return F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + F.char_length(x["whole"])).alias("end"), x["whole"].alias("word"), (F.char_length(x["value"]) >= least).alias("ok"))

    placed = _let(rows, lambda rows: F.zip_with(rows, _before(sizes(rows), lambda a, b: a + b), span))
    found = F.filter(placed, lambda x: x["ok"])
    return F.when(t.rlike(PATTERNS[KINDS[kind]]), found).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,word:string,ok:boolean>>"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _secret_base and _secret_all: sorted arrays of (start, kind, end, word, ok)."""
    table = train(docs.sparkSession)
    plain = docs.withColumn("_secret_text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    found = plain.withColumns({f"_secret_{k}": _spans("_secret_text", i, 6 if k == "assign" else 0) for i, k in enumerate(KINDS)})
    based = found.withColumn("_secret_base", F.array_sort(F.concat("_secret_assign", "_secret_access", "_secret_hex")))

    def gaps(base):
        """What base spans, of which there are some, leave of a text, in pieces of LEAST or more characters; the last has no end."""
        far = _let(base, lambda b: F.zip_with(b, _before(F.transform(b, lambda y: y["end"]), lambda p, q: F.greatest(p, q)), lambda y, to: F.struct(to.alias("from"), y["start"].alias("to"))))
        last = F.aggregate(base, F.lit(0).cast("long"), lambda to, y: F.greatest(to, y["end"]))
        return F.filter(F.concat(far, F.array(F.struct(last.alias("from"), F.lit(1 << 40).cast("long").alias("to")))), lambda g: g["to"] - g["from"] >= LEAST)

    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.lit(1 << 40).cast("long").alias("to")))

    def left(x, free):
        """What base spans leave of a run, as spans."""
        skip, upto = _count(free, lambda g: g["to"] <= x["start"]), _count(free, lambda g: g["from"] < x["end"])

        def piece(g):
            a, b = F.greatest(g["from"], x["start"]), F.least(g["to"], x["end"])
            return F.struct(a.alias("start"), b.alias("end"), F.substring(x["word"], (a - x["start"] + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).alias("word"))

        return F.filter(F.transform(F.slice(free, skip + 1, F.greatest(upto - skip, F.lit(0))), piece), lambda p: p["end"] - p["start"] >= LEAST)

    def random(p):
        span = lambda q: F.struct((p["start"] + q["first"]).alias("start"), F.lit(KINDS.index("markov")).alias("kind"), (p["start"] + q["end"]).alias("end"), F.substring(p["word"], q["first"] + 1, q["end"] - q["first"]).alias("word"), F.lit(True).alias("ok"))
        return F.transform(_parts(p["word"], table), span)

    free = F.when(F.size("_secret_base") > 0, gaps(F.col("_secret_base"))).otherwise(whole)
    pieces = _let(free, lambda free: F.flatten(F.transform("_secret_markov", lambda x: left(x, free))))
    added = F.when(F.size("_secret_markov") > 0, F.flatten(F.transform(pieces, random))).otherwise(F.col("_secret_markov"))
    return based.withColumn("_secret_all", F.array_sort(F.concat("_secret_base", added))).drop("_secret_markov", "_secret_text")


def written_out(spans: str) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    s = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = {f"n_{k}": F.size(f"_secret_{k}").cast("long") for k in KINDS[:3]}
    return s.select("doc_id", *[c.alias(k) for k, c in count.items()], (F.size("_secret_all") - F.size("_secret_base")).cast("long").alias("n_markov"), F.sha2(written_out("_secret_base"), 256).alias("base_sha256"), written_out("_secret_all").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs, in whose texts each span (overlapping ones as one) is replaced by the mark. All rows and columns stay; n_chars, if there, follows the text."""
    docs, as_they_were = apart(docs, "_secret_")
    s = scan(docs)
    text = F.col("text").cast("string")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        put = F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"))
        return F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(put)

    done = F.aggregate("_secret_all", start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    changed = F.size("_secret_all") > 0
    new = {"text": F.when(changed, done).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length(done)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return as_they_were(s.withColumns(new))
