"""Encoding with the tokenizers library, one call for each distinct piece of text."""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from public_tokenizers import PATTERN

_LOADED: dict[str, Vocabulary] = {}
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = regex.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_BLANKS = regex.compile("[ \n]")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PIECES = regex.compile(PATTERN)
_SIMPLE = "\u024f"  # up to here (but for one letter) case and classes are the same in every Unicode version


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


SLICE = 1 << 23  # bytes of texts that are cut to chunks together
MEMORY = 80 << 20  # bytes, about, that a generation of a cache may take
_ENTRY = 200  # bytes of an entry besides its key and its ids
_LONG = 512  # characters; longer chunks are not kept


class Cache:
    """Ids by piece of text, in two generations: a full one becomes the last, from which what occurs again is taken over."""

    def __init__(self, most: int = MEMORY):
        self.most, self.size = most, 0
        self.now: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}

    def find(self, key: str) -> bytes | None:
        ids = self.now.get(key)
        if ids is None:
            ids = self.last.get(key)
            if ids is not None:
                self.keep(key, ids)
        return ids

    def keep(self, key: str, ids: bytes) -> None:
        if len(key) > _LONG:
            return
        if self.size > self.most:
            self.now, self.last, self.size = {}, self.now, 0
        self.now[key] = ids
        self.size += len(key) + len(ids) + _ENTRY


class Vocabulary:
    """Ids of whole texts by a vocabulary file, as the library gives them for each text.

    A chunk is what lies between single spaces, with the space before it; the library's
    pre-tokenizers always cut there, so the ids of the chunks, joined, are those of the
    text. Many texts are cut together, and each distinct chunk is looked up once. A chunk not seen before is
    cut into pre-tokens, and a pre-token not seen before
    goes through the library's model (letters beyond Latin go through the whole library,
    chunk by chunk). Texts that hold the string of a special token go through the library as they are.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parsed = json.load(f)
        self.words = bool(parsed["model"]["end_of_word_suffix"])  # lower case, white space dropped
        self.special = [t["content"] for t in parsed["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.space = self.letters[32]
        self.chunks = {before: Cache(memory) for before in ("", " ")}  # by what stands before the key
        self.pieces = Cache(memory)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text."""
        return np.frombuffer(self._alone(text or ""), "<u4")

    def _alone(self, text: str) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.words:
            return b"".join(map(self._look_up, _BLANKS.split(text), repeat("")))
        if "  " in text or text[-1] == " ":
            return b"".join(map(self._look_up, _CHUNK.findall(text), repeat("")))
        head, *rest = text.split(" ")
        return self._look_up(head, "") + b"".join(map(self._look_up, rest, repeat(" ")))

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, null as empty, slice by slice."""
        texts = texts.fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            below = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, below + SLICE, side="right")))
            yield from self._slice(texts.slice(at, stop - at))
            at = stop

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        odd = pc.equal(pc.binary_length(texts), 0)
        for t in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        if not self.words:
            odd = pc.or_(odd, pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " ")))
        plain = texts.filter(pc.invert(odd))
        if self.words:
            plain = pc.replace_substring(plain, "\n", " ")
        together = self._together(plain) if len(plain) else iter(())
        for i, alone in enumerate(odd.to_pylist()):
            yield np.frombuffer(self._alone(texts[i].as_py()), "<u4") if alone else next(together)

    def _together(self, texts: pa.Array) -> Iterator[np.ndarray]:
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy()
        starts, words = starts - starts[0], cut.flatten()
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()
        # no chunk holds a space, so one string carries them all out of the array
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py().split(" ")
        before = "" if self.words else " "
        known = list(map(self.chunks[before].now.get, distinct))
        for i, ids in enumerate(known):
            if ids is None:
                known[i] = self._look_up(distinct[i], before)
        if not self.words:  # the first chunk of a text has no space before it
            first = starts[:-1]
            heads = [distinct[i] for i in which[first].tolist()]
            which = which.copy()
            which[first] = np.arange(len(known), len(known) + len(heads))
            known += map(self._look_up, heads, repeat(""))
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        flat = np.frombuffer(b"".join(known), "<u4")
        place = np.cumsum(size) - size
        n = size[which]
        ends = np.cumsum(n)
        ids = flat[np.repeat(place[which] - ends + n, n) + np.arange(ends[-1])]
        bounds = np.append(0, ends)[starts]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield ids[a:b]

    def _look_up(self, chunk: str, before: str) -> bytes:
        cache = self.chunks[before]
        ids = cache.find(chunk)
        if ids is None:
            ids = self._learn(chunk, before)
            cache.keep(chunk, ids)
        return ids

    def _learn(self, c: str, before: str) -> bytes:
        """Ids of a chunk not seen before. A word, or a word and one mark, needs no pattern."""
        if c.isascii():
            if c.isalpha():  # ASCII letters stand for themselves
                return self._model(c.lower() if self.words else self.space + c if before else c)
            if c[:-1].isalpha() and c[-1] in ".,;:!?":
                return self._look_up(c[:-1], before) + self._piece(c[-1])
            if c.count("\n") == 1:
                head, tail = c.split("\n")
                if head and tail and not (head[-1].isspace() or tail[0].isspace()):
                    return self._look_up(head, before) + self._piece("\n") + self._look_up(tail, "")
        elif not self.words and max(c) <= _SIMPLE:
            if c.isalpha():
                return self._model(self._shown(before + c))
            if c[:-1].isalpha() and c[-1] in ".,;:!?":
                return self._look_up(c[:-1], before) + self._piece(c[-1])
        return self._chunk(before + c)

    def _shown(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.letters)

    def _model(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not chunk.isascii() and (max(chunk) > _SIMPLE or "\u0130" in chunk):
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if self.words:
            # three regular steps of the file: composed form, lower case, words
            if not chunk.isascii():
                chunk = unicodedata.normalize("NFC", chunk)
            parts = _WORDS.findall(chunk.lower())
        else:
            parts = _PIECES.findall(chunk)
        return b"".join(map(self._piece, parts))

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.find(piece)
        if ids is None:
            ids = self._model(self._shown(piece))
            self.pieces.keep(piece, ids)
        return ids


def vocabulary(path: str) -> Vocabulary:
    """A vocabulary file, loaded once in each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]
