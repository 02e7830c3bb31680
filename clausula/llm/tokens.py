"""Encoding of whole texts with a tokenizers file, each distinct piece of a text encoded once.

Both kinds of file known here never join characters across certain blanks, so a text may be cut
there and the cuts' ids joined; the result is what the library gives for the whole text (tests
compare them):
  * files that drop white space: cut at each space and line feed;
  * byte-level files: cut before each space or line feed, if no blank stands next to another.
Other texts and other files go to the library whole. Texts are cut and their distinct pieces found by Arrow, some
megabytes at once. Pieces are encoded together, with a control character between blanks after each, whose id tells where
a piece ends. Where the file ends each word with a suffix, pieces of plain letters between marks are words that go to the
library once each, lower-cased here and parted by blanks alone: the ids of words with the suffix tell where they end.
With byte-level files, runs of plain letters or marks go to it once each, and the ids that begin with a space tell where they start.
Special tokens' strings within a text are ordinary text. Of pieces, the most recent are kept, in two generations.
"""

from __future__ import annotations

import copy
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from clausula.llm.texthash import pieces as slices

#: Of each of the two generations.
CACHE_BYTES = 120_000_000
#: Of texts that are cut at once.
BATCH_BYTES = 4_000_000
MARK = "\x01"
#: The letter that stands for a space in byte-level files.
SPACE = "\u0120"
#: The splitting that PLAIN is known under: letters are one word, and marks before or after them others. An apostrophe may take letters with it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"(?:([!-&(-/:-@\[-`{-~]*)([a-zß-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)|([^ ]+))(?: |\Z)")
#: The same for byte-level files, whose splitting gives a space to the run that follows it.
LED = re.compile(r"(?:( [A-Za-zÀ-ÖØ-öø-ÿ]+| [!-&(-/:-@\[-`{-~]+|\n)([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)(?=[ \n]|\Z))|([ \n][^ \n]*)")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
#: White space other than space and line feed, by Python's or Unicode's reading.
_OTHER_BLANK = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


class Encoder:
    """encode(text): the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        form = json.loads(Path(path).read_text())
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        pre = form.get("pre_tokenizer") or {}
        norm = json.dumps(form.get("normalizer"))
        self.mode = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not form.get("normalizer"):
            self.mode = "led"
        elif pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and '"content": " "' in norm:
            self.mode = "dropped"
        self.ends = self.starts = self.words = None  # whether an id ends a word, or starts one with its space; the library for words that are parted by blanks
        suffix = form["model"].get("end_of_word_suffix")
        if self.mode == "dropped" and suffix and pre["pretokenizers"][0].get("pattern") == {"Regex": SPLIT}:
            vocabulary = self.plain.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
            self.words = copy.copy(self)
            self.words.plain = Tokenizer(self.plain.model)  # which both share
            self.words.plain.encode_special_tokens = True
            self.words.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        if self.mode == "led" and all(x["special"] for x in form.get("added_tokens") or []):
            vocabulary = self.plain.get_vocab()
            self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
            self.starts[[i for w, i in vocabulary.items() if w.startswith(SPACE)]] = True
            self.words = copy.copy(self)
            self.words.plain = Tokenizer(self.plain.model)  # which both share
            self.words.plain.encode_special_tokens = True
            self.words.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=True, use_regex=False)])
        self.mark = np.frombuffer(self._whole(" " + MARK), "<u4")
        self.held: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.size, self.cache_bytes = 0, None

    def _whole(self, text: str) -> bytes:
        return np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not held."""
        self.size += sum(map(len, pieces)) + 150 * len(pieces)
        if self.words is not None:
            pieces = self._learn_led(pieces) if self.mode == "led" else self._learn_plain(pieces)
        self._learn_marked(pieces)

    def _learn_marked(self, pieces: list[str]) -> None:
        blank = "" if self.mode == "led" else " "  # pieces that follow a blank have it
        for i in range(0, len(pieces), 5000):
            part = pieces[i : i + 5000]
            odd = [p for p in part if MARK in p or not blank and p[0] not in " \n"]
            part = [p for p in part if MARK not in p and (blank or p[0] in " \n")]
            for p in odd:
                self.held[p] = self._whole(p)
            if part:
                ids = np.frombuffer(self._whole("".join(f"{blank}{p} {MARK}" for p in part)), "<u4")
                ends = np.flatnonzero(ids == self.mark[-1]) + 1
                raw, at, wide = ids.tobytes(), 0, len(self.mark)
                for p, e in zip(part, ends.tolist(), strict=True):
                    self.held[p] = raw[4 * at : 4 * (e - wide)]
                    at = e

    def _learn_plain(self, pieces: list[str]) -> list[str]:
        """Encode those pieces that are plain when lower-cased; the others."""
        if not pieces:
            return []
        before, letters, after, other = zip(*PLAIN.findall(" ".join(pieces).lower())[: len(pieces)], strict=True)
        words = self._unknown({*before, *letters, *after})
        self.size += sum(map(len, words)) + 150 * len(words)
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            raw = self.words._whole(" ".join(part))
            ends = 4 * np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 4
            if len(ends) != len(part):  # a letter that the file does not know
                self._learn_marked(part)
                continue
            at = 0
            for w, e in zip(part, ends.tolist()):
                self.held[w] = raw[at:e]
                at = e
        held = self.held
        for p, x, y, z, o in zip(pieces, before, letters, after, other, strict=True):
            if not o:
                held[p] = held[x] + held[y] + held[z]
        return [p for p, o in zip(pieces, other) if o]

    def _learn_led(self, pieces: list[str]) -> list[str]:
        """Encode those pieces that are runs of plain letters and marks after a blank; the others."""
        first, pieces = [p for p in pieces if p[0] not in " \n"], [p for p in pieces if p[0] in " \n"]
        if not pieces:
            return first
        one, two, three, four, other = zip(*LED.findall("".join(pieces)), strict=True)
        words = {*one, *two, *three, *four}
        more = self._unknown(words.difference(pieces))
        self.size += sum(map(len, more)) + 150 * len(more)
        words = [*more, *words.intersection(pieces)]
        spaced, bare = [w for w in words if w[0] == " "], [w for w in words if w[0] != " "]
        for i in range(0, len(spaced), 5000):
            part = spaced[i : i + 5000]
            raw = self.words._whole("".join(part))
            at = (4 * np.flatnonzero(self.starts[np.frombuffer(raw, "<u4")])).tolist()
            if len(at) != len(part):  # a byte that the file does not know
                self._learn_marked(part)
                continue
            self.held.update(zip(part, [raw[x:y] for x, y in zip(at, [*at[1:], len(raw)])], strict=True))
        for w, x in zip(bare, self.plain.encode_batch_fast(bare, add_special_tokens=False), strict=True):
            self.held[w] = np.array(x.ids, "<u4").tobytes()
        held = self.held
        for p, w, x, y, z, o in zip(pieces, one, two, three, four, other, strict=True):
            if not o:
                held[p] = held[w] + held[x] + held[y] + held[z] if z else held[w] + held[x] + held[y] if y else held[w] + held[x]
        return first + [p for p, o in zip(pieces, other) if o]

    def _unknown(self, pieces: set[str]) -> list[str]:
        """Those pieces that neither generation holds; from the older one they go over to the present one."""
        new = pieces.difference(self.held)
        known = {p for p in new if p in self.older}  # intersection() would walk all that is held
        self.held.update((p, self.older[p]) for p in known)
        self.size += sum(map(len, known)) + 150 * len(known)
        return list(new - known)

    def _cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct pieces of texts that may be cut, the piece at each place, and where each text's places end."""
        led = self.mode == "led"
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if led else " "), " ")
        coded, at = cut.flatten().dictionary_encode(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        pieces, code = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py().split(" "), coded.indices.to_numpy()
        if led:
            first, code = [pieces[i] for i in code[at[:-1]].tolist()], code.copy()
            code[at[:-1]] = np.arange(len(first)) + len(pieces)
            pieces = [p if p[:1] == "\n" else " " + p for p in pieces] + first
        return pieces, code, at[1:]

    def _joined(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts that may be cut."""
        pieces, code, ends = self._cut(texts)
        if self.size > (self.cache_bytes or CACHE_BYTES):
            self.older, self.held, self.size = self.held, {"": b""}, 0
        self._learn(self._unknown(set(pieces)))
        ids = pa.array(list(map(self.held.__getitem__, pieces)), pa.large_binary()).take(pa.array(code))
        _, at, data = ids.buffers()
        raw = data.to_pybytes() if data is not None else b""
        ends = np.frombuffer(at, np.int64, len(ids) + 1)[ends].tolist()
        return [raw[x:y] for x, y in zip([0, *ends], ends)]

    def _may_be_cut(self, text: str) -> bool:
        """Of a text for a file that is not of the kind that drops white space."""
        return self.mode == "led" and bool(text) and "  " not in text and "\n " not in text and " \n" not in text and "\n\n" not in text and text[-1] not in " \n" and text[0] not in " \n" and not _OTHER_BLANK.search(text)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; a null is empty."""
        for _, part in slices(texts.fill_null(""), BATCH_BYTES):
            if self.mode == "dropped":
                yield from self._joined(part)
                continue
            whole = [None if self._may_be_cut(x) else self._whole(x) if x else b"" for x in part.to_pylist()]
            some = [i for i, x in enumerate(whole) if x is None]
            for i, x in zip(some, self._joined(part.take(pa.array(some, pa.int64()))) if some else []):
                whole[i] = x
            yield from whole

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cache_bytes: int | None = None) -> Encoder:
    """This process's encoder of a file, which from now on keeps so many bytes of pieces in a generation (CACHE_BYTES if not given)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].cache_bytes = cache_bytes
    return _ENCODERS[path]
