"""Toxicity of texts: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of lexicon words by strength, obfuscated lexicon words
(`st*pid`), nearness of a second-person word to a lexicon word, rates of capitals, punctuation,
obfuscation marks and digits, and length. The lexicon is a short fixed list and the words and word
beginnings that labelled toxic texts have more often than others; of each labelled row's features
the lexicon has learned nothing from that row's fold (cross-fitting), so that the trees see them as
they see a new text. Calibration is fitted on scores of trees that did not see the row.

Bound of the sample: the model is fitted on at most SAMPLE_ROWS labelled rows (those of the least
hash of doc_id), its lexicon has at most LEXICON_TERMS terms. Both are broadcast; scoring is one
pass over the whole texts and shuffles nothing.

Defined results: a null or empty text has the features of no words and gets a score too. A null
doc_id matches no label and is not held out. Labels that repeat a doc_id: toxic if one says so;
null labels are left out. Without labels of both kinds every text scores the rate of toxic labels
(0 without labels). An empty table gives an empty table.
"""

from __future__ import annotations

import dataclasses
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.llm import boost
from clausula.llm.shared import id_text, tidy, written
from clausula.llm.texthash import buffers, pieces

SAMPLE_ROWS = 20_000
LEXICON_TERMS = 5_000
FOLDS = 4
CACHE_WORDS = 400_000

# Words that address a reader, in four languages.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur ya youre you're tu te toi ton ta tes vous votre vos du dich dir dein deine deinen euch euer ihr usted ustedes vosotros tus tuyo".split())
# Common insults, in four languages.
INSULTS = frozenset("idiot idiots moron morons stupid dumb scum trash garbage pathetic loser losers worthless disgusting clown clowns filth vermin bastard imbecile fool crap idiote imbécile connard stupide ordure débile nul crétin dummkopf trottel blöd abschaum dreck arschloch estúpido estúpida imbécil basura inútil tonto asqueroso".split())
# Signs written for letters.
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
_MARKS = set("0134578@$!*_.-")
_STRIP = " \t.,;:!?()[]{}\"'`«»¿¡…*|/\\<>-–—_=+#"

#: Classes of words, one byte each: nothing, second person, strong, medium and weak lexicon words, obfuscated lexicon word, fixed insult.
NONE, YOU, STRONG, MEDIUM, WEAK, HIDDEN, FIXED = range(7)
FEATURES = 17


def terms(word: str) -> list[str]:
    """The word and its beginnings of 4, 5 and 6 letters."""
    return [word, *(f"{word[:n]}~" for n in (4, 5, 6) if len(word) >= n)]


@dataclasses.dataclass
class Lexicon:
    classes: dict[str, int]

    def of(self, word: str) -> int:
        w = word.strip(_STRIP)
        if w in SECOND_PERSON:
            return YOU
        if not w:
            return NONE
        found = [k for t in terms(w) if (k := self.classes.get(t))]
        if found:
            return min(found)
        if w in INSULTS:
            return FIXED
        if len(w) > 3 and not _MARKS.isdisjoint(w) and any(c.isalpha() for c in w):
            plain = w.translate(_PLAIN)
            gap = w.replace("*", "?")
            if plain in INSULTS or self.classes.get(plain) == STRONG or "?" in gap and any(w.replace("*", v) in INSULTS or self.classes.get(w.replace("*", v)) == STRONG for v in "aeiou"):
                return HIDDEN
        return NONE


class Classes(dict):
    """Class of each word, remembered; forgotten as a whole when there are too many."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        k = self[word] = self.lexicon.of(word)
        return k


_KIND = np.zeros(256, np.uint8)  # 1 capital, 2 small, 3 digit, 4 stop or shout, 5 other sign, 6 obfuscation mark
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
for _c in b"!?":
    _KIND[_c] = 4
for _c in b".,;:()[]{}\"'|/\\<>=+&%#^~`-":
    _KIND[_c] = 5
for _c in b"*@$_":
    _KIND[_c] = 6


def features(texts: pa.Array, classes: Classes) -> np.ndarray:
    """FEATURES values for each text."""
    out = np.zeros((len(texts), FEATURES))
    for first, part in pieces(texts):
        raw, at = buffers(part)
        kind = _KIND[raw]
        place = at[:-1]
        count = {}
        some = at[:-1] < at[1:]
        for k in range(1, 7):
            c = np.zeros(len(part))
            if some.any():
                c[some] = np.add.reduceat((kind == k).astype(np.int32), place[some])
            count[k] = c
        marked = np.zeros(len(part))
        if some.any() and len(raw) > 2:  # a mark or digit between letters
            inner = np.zeros(len(raw), np.int32)
            letter = (kind == 1) | (kind == 2)
            inner[1:-1] = ((kind[1:-1] == 3) | (kind[1:-1] == 6) | (raw[1:-1] == 33)) & letter[:-2] & letter[2:]
            marked[some] = np.add.reduceat(inner, place[some])
        size = np.maximum(np.diff(at), 1)
        letters = np.maximum(count[1] + count[2], 1)
        x = out[first : first + len(part)]
        x[:, 9], x[:, 10] = count[1] / letters, count[4] / size
        x[:, 11], x[:, 12], x[:, 13] = count[5] / size, count[6] / size, count[3] / size
        x[:, 14] = marked / letters
        for i, text in enumerate(part.to_pylist()):
            words = (text or "").lower().split()
            row = bytes(map(classes.__getitem__, words))
            n = max(len(row), 1)
            strong, medium, weak, hidden, fixed, you = (row.count(k) for k in (STRONG, MEDIUM, WEAK, HIDDEN, FIXED, YOU))
            hits = strong + hidden + fixed
            x[i, :9] = math.log1p(len(row)), min(strong, 12), 1000 * strong / n, min(medium, 12), 1000 * medium / n, 1000 * weak / n, min(hidden, 5), min(fixed, 8), 1000 * you / n
            x[i, 16] = min(hits, 20)
            if you and hits:
                a = np.frombuffer(row, np.uint8)
                addressed, meant = np.flatnonzero(a == YOU), np.flatnonzero((a == STRONG) | (a == HIDDEN) | (a == FIXED))
                k = np.searchsorted(addressed, meant)
                gap = np.minimum(np.abs(meant - addressed[np.maximum(k - 1, 0)]), np.abs(meant - addressed[np.minimum(k, you - 1)]))
                x[i, 15] = min(int((gap <= 5).sum()), 10)
    return out


@tidy
def _counts(batches):
    """By term and fold: in how many toxic and in how many other texts. One row for each term of a bounded run of texts."""
    held: Counter = Counter()

    def out():
        keys = list(held)
        return pa.RecordBatch.from_pydict({"term": [k[0] for k in keys], "fold": pa.array([k[1] for k in keys], pa.int32()), "toxic": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array(list(held.values()), pa.int64())})

    for b in batches:
        for text, fold, toxic in zip(b["text"].to_pylist(), b["fold"].to_pylist(), b["toxic"].to_pylist()):
            words = {w for x in set((text or "").lower().split()) if (w := x.strip(_STRIP)) and not w.isdigit()}
            held.update((t, fold, toxic) for t in {t for w in words for t in terms(w)})
            if len(held) > 500_000:
                yield out()
                held.clear()
    if held:
        yield out()


def lexicon_of(n1: np.ndarray, n0: np.ndarray, names: np.ndarray, rate: float, all_rows: int) -> Lexicon:
    """Terms by the share of toxic texts among those that have them, drawn to the base rate by four texts; in 3 toxic texts at least."""
    p = (n1 + 4 * rate) / (n1 + n0 + 4)
    ok = (n1 >= 3) & (p >= min(0.9, 0.3 + 0.5 * rate))
    order = np.flatnonzero(ok)
    order = order[np.lexsort((names[order], -n1[order] * p[order]))][:LEXICON_TERMS]
    level = np.where(p[order] >= 0.75, STRONG, np.where(p[order] >= 0.5, MEDIUM, WEAK))
    return Lexicon(dict(zip(names[order].tolist(), level.tolist())))


@dataclasses.dataclass
class Model:
    lexicon: Lexicon
    trees: boost.Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    rate: float

    def scores(self, texts: pa.Array, classes: Classes) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        return boost.calibrated(self.trees.raw(features(texts, classes)), self.knots)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic of the rows that may be learned from."""
    spark = docs.sparkSession
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int"))
    rows = written(docs.join(F.broadcast(sample), "doc_id").select("text", "toxic", "fold"), "labelled")  # sample_rows rows at most
    shares = {(r.fold, r.toxic): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    n1, n = sum(v for (_, t), v in shares.items() if t), sum(shares.values())
    rate = n1 / n if n else 0.0
    if not n1 or n1 == n:
        return Model(Lexicon({}), None, None, rate)
    counted = rows.mapInArrow(_counts, "term string, fold int, toxic int, n long")
    by = counted.groupBy("term").agg(*[F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}_{t}") for f in range(FOLDS) for t in (0, 1)])
    by = by.where(" + ".join(f"n{f}_1" for f in range(FOLDS)) + " >= 3").withColumn("all1", sum(F.col(f"n{f}_1") for f in range(FOLDS))).withColumn("all0", sum(F.col(f"n{f}_0") for f in range(FOLDS)))
    top = by.orderBy(F.desc(F.col("all1") * F.col("all1") / (F.col("all1") + F.col("all0"))), "term").limit(4 * LEXICON_TERMS).toPandas()
    names = top["term"].to_numpy(str) if len(top) else np.zeros(0, str)
    got = {(f, t): top[f"n{f}_{t}"].to_numpy(float) for f in range(FOLDS) for t in (0, 1)}
    sums = {t: sum(got[f, t] for f in range(FOLDS)) for t in (0, 1)}
    whole = lexicon_of(sums[1], sums[0], names, rate, n)
    folds = [lexicon_of(sums[1] - got[f, 1], sums[0] - got[f, 0], names, rate, n) for f in range(FOLDS)]
    held = spark.sparkContext.broadcast(folds)

    @tidy
    def feature_rows(batches):
        known = [Classes(x) for x in held.value]
        for b in batches:
            fold = b["fold"].to_numpy()
            for f in np.unique(fold):
                at = np.flatnonzero(fold == f)
                x = features(b["text"].take(pa.array(at)), known[f])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(fold[at]), b["toxic"].take(pa.array(at))], ["x", "fold", "toxic"])

    got = rows.mapInArrow(feature_rows, "x array<double>, fold int, toxic int").toArrow()
    x, fold, y = np.stack(got["x"].to_numpy()), got["fold"].to_numpy(), got["toxic"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y, fold))  # the rows come in no fixed order
    x, fold, y = x[order], fold[order], y[order]
    out = np.zeros(len(y))
    for f in range(FOLDS):
        rest = fold != f
        if (~rest).any():
            out[~rest] = boost.fit(x[rest], y[rest]).raw(x[~rest]) if rest.any() else 0.0
    return Model(whole, boost.fit(x, y), boost.isotonic(out, y), rate)


def score(docs: DataFrame, model: Model, to: dict[str, str] | None = None) -> DataFrame:
    """docs (doc_id, text) with the score of each text: doc_id, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def rows(batches):
        classes = Classes(held.value.lexicon)
        for b in batches:
            s = held.value.scores(b["text"], classes) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(rows, "doc_id long, score double")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def trained_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    return train(id_text(docs), rows.where(~held_out(F.col("doc_id"))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    out = score(id_text(docs), trained_on(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(trained_on(docs, labels))
    local: list[Classes] = []

    @F.pandas_udf("boolean")
    def clean(text):
        if not local:
            local.append(Classes(held.value.lexicon))
        return pd.Series(held.value.scores(pa.array(text, pa.string()), local[0]) < threshold)

    return docs.where(clean(F.coalesce(F.col("text").cast("string"), F.lit(""))))
