"""Word hashes: equal words and only they, whatever stands around them, and no cheap collisions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from clausula.llm import lm, near_dedup
from clausula.llm.texthash import buffers, run_hashes, word_hashes


def thue_morse(n):
    return ["a" if bin(i).count("1") % 2 else "b" for i in range(n)]


def odd_pair(n):
    """A word of n letters that follow the Thue-Morse sequence, and its complement: equal under any polynomial modulo 2**64 once n is large."""
    x = thue_morse(n)
    return "".join(x), "".join("a" if c == "b" else "b" for c in x)


def test_hashes_follow_words():
    r = random.Random(4)
    words = ["".join(r.choice("abAB日é.") for _ in range(r.choice([1, 2, 3, 63, 64, 65, 200]))) for _ in range(400)]
    lower = lambda w: "".join(c.lower() if c in "AB" else c for c in w)
    texts = [" ".join(words[i : i + 7]) for i in range(0, 400, 7)] + ["", " \t", None]
    h, of = word_hashes(*buffers(pa.array(texts)))
    seen = {}
    for i, t in enumerate(texts):
        for j, w in enumerate((t or "").split()):
            seen.setdefault(lower(w), set()).add(int(h[of[i] + j]))
    assert all(len(v) == 1 for v in seen.values()) and len(set.union(*seen.values())) == len(seen)
    assert lm.hashes(pa.array(["", "ab", "a"]))[0] == 0
    assert len(run_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("n", [512, 1024, 2048, 1 << 14])
def test_no_collision_of_thue_morse_words(n):
    h, _ = word_hashes(*buffers(pa.array(list(odd_pair(n)))))
    assert h[0] != h[1]


def test_operators_keep_such_words_apart(spark):
    x, y = odd_pair(1024)
    docs = spark.createDataFrame([(0, f"{x} one"), (1, f"{y} one"), *[(i, f"word{i} one") for i in range(2, 30)]], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, k=2, percent=80).where("doc_id < 2").collect()}
    assert got == {0: (0, True), 1: (1, True)}
    held = [r for r in lm.lm_scores(docs).collect() if r.doc_id == 1]
    assert held[0].held_out and held[0].n_known == 2  # `one` and the end
