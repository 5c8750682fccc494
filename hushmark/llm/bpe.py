"""Byte-level BPE: boundaries from an associative scan of automaton transitions, cached pair merging, decoding by offsets."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCAN = 1 << 20  # code points scanned at a time; one longer text is scanned alone
CACHE = 400_000

LETTER, NUMBER, OTHER, JOIN, LAST, BLANK, SHORT, LONG, BREAK = range(9)
OUT, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, IN_BLANKS, TWO_LEFT, ONE_LEFT = range(8)
#: Contractions after an apostrophe that are tokens of their own.
TAILS = ("s", "t", "m", "d", "re", "ve", "ll")
#: Code points of white space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def class_table() -> np.ndarray:
    """Letter, number, blank or other for every code point.

    Which version of Unicode counts is asked from the tiktoken library, once: an encoding
    of single bytes that matches one property keeps just the code points that have it.
    """
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.full(0x110000, OTHER, np.uint8)
    for property_, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        single = tiktoken.Encoding("single", pat_str=property_, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        having = bytes(single.encode_ordinary(points)).decode()
        table[np.frombuffer(having.encode("utf-32-le"), "<u4")] = kind
    table[list(WHITE)] = BLANK
    return table


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """``next[symbol, state]`` and ``starts[symbol, state]``: does a token start with this symbol?"""
    follow = np.zeros((9, 8), np.uint8)
    starts = np.ones((9, 8), bool)
    for symbol, into, goes_on in (
        (LETTER, IN_LETTERS, {IN_LETTERS: IN_LETTERS, JOINED: IN_LETTERS, TWO_LEFT: ONE_LEFT, ONE_LEFT: OUT}),
        (NUMBER, IN_NUMBERS, {IN_NUMBERS: IN_NUMBERS, JOINED: IN_NUMBERS}),
        (OTHER, IN_OTHERS, {IN_OTHERS: IN_OTHERS, JOINED: IN_OTHERS}),
        (JOIN, JOINED, {}),  # the blank before what is no white space
        (LAST, OUT, {}),
        (BLANK, IN_BLANKS, {IN_BLANKS: IN_BLANKS}),
        (SHORT, ONE_LEFT, {IN_OTHERS: IN_OTHERS, JOINED: IN_OTHERS}),
        (LONG, TWO_LEFT, {IN_OTHERS: IN_OTHERS, JOINED: IN_OTHERS}),
        (BREAK, OUT, {}),
    ):
        follow[symbol] = into
        for state, then in goes_on.items():
            follow[symbol, state] = then
            starts[symbol, state] = False
    return follow, starts


def symbols(codes: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The automaton's symbol at each code point; ``breaks`` are the places between texts."""
    kind = table[codes]
    kind[breaks] = BREAK
    white = kind == BLANK
    after = np.append(kind[1:], BREAK)
    last = white & (after != BLANK) & (after != BREAK)
    kind[last] = np.where(codes[last] == 0x20, JOIN, LAST)
    quote = np.flatnonzero((codes == 0x27) & (kind == OTHER))
    one = np.append(codes[1:], [0, 0])[quote]
    two = np.append(codes[2:], [0, 0, 0])[quote]
    ends = np.append(kind, [BREAK] * 3)
    room = ends[quote + 2] != BREAK  # the second letter lies in the same text
    kind[quote[np.isin(one, [ord(t) for t in TAILS if len(t) == 1]) & (ends[quote + 1] != BREAK)]] = SHORT
    for tail in (t for t in TAILS if len(t) == 2):
        kind[quote[(one == ord(tail[0])) & (two == ord(tail[1])) & room]] = LONG
    return kind


def token_starts(kind: np.ndarray, follow: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where a token (or a break) starts.

    A symbol maps each state to the next one, and such maps compose associatively: all
    blocks compose their maps side by side, one pass over the blocks' maps gives the state
    each block starts in, and all blocks then step through their states side by side.
    """
    n = len(kind)
    block = max(1, int(n**0.5))
    count = -(-n // block)
    grid = np.full(count * block, BREAK, np.uint8)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(count, block).T)
    flat, states = follow.ravel(), follow.shape[1]
    maps = np.tile(np.arange(states, dtype=np.uint8), (count, 1))
    for row in grid:
        maps = flat[row[:, None].astype(np.intp) * states + maps]
    state, at = np.empty(count, np.uint8), OUT
    for i, m in enumerate(maps.tolist()):
        state[i] = at
        at = m[at]
    begins = np.empty(grid.shape, bool)
    fresh = starts.ravel()
    for j, row in enumerate(grid):
        step = row.astype(np.intp) * states + state
        begins[j] = fresh[step]
        state = flat[step]
    return np.flatnonzero(begins.T.ravel()[:n])


class Encoder:
    """Ids of texts by a file of ranks; pieces merged once are kept, up to ``CACHE`` of them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.sizes)])
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)
        self.table = class_table()
        self.follow, self.starts = transitions()
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of least rank, the leftmost first, until none has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 48:
            return self.merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], 1 << 40) for i in range(len(piece) - 1)]
        while pairs:
            least = min(pairs)
            if least == 1 << 40:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
        return [ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
        left = list(range(-1, n - 1))

        def pair(i: int):
            j = end[i]
            return ranks.get(piece[i : end[j]]) if j < n else None

        heap = [(r, i, end[end[i]]) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                left[stop] = i
            for k in (i, left[i]):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k, end[end[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        joined = "\0".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        breaks = (np.cumsum(sizes + 1) - 1)[:-1]
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        if not len(codes):
            return [np.zeros(0, np.int32) for _ in texts]
        begins = token_starts(symbols(codes, breaks, self.table), self.follow, self.starts)
        cuts = np.append(begins, len(codes)).tolist()
        pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
        first = np.searchsorted(begins, np.concatenate([[0], breaks + 1])).tolist()
        last = [*np.searchsorted(begins, breaks).tolist(), len(begins)]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for p in pieces:
            if p not in known:
                known[p] = np.array(self.merge(p.encode()), "<i4").tobytes()
        return [np.frombuffer(b"".join([known[p] for p in pieces[a:b]]), "<i4") for a, b in zip(first, last)]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes start in the text."""
        return np.cumsum(self.sizes[ids]) - self.sizes[ids]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The bytes of some ids, each put at its offset."""
        sizes = self.sizes[ids]
        return self.letters[np.repeat(self.places[ids] - offsets, sizes) + np.arange(int(sizes.sum()))]


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A file of ranks, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def encode(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, offsets``: token ids of each whole text and the byte at which each token starts.

    Every match of the pre-tokenisation pattern is merged on its own; no special tokens.
    Null text is empty and has no ids. Map-only: rows keep their order and repeated rows
    get the same ids; other columns are left behind.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) < SCAN):
                    size += len(texts[j]) + 1
                    j += 1
                ids = enc.encode(texts[i:j])
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
                flat = pa.array(np.concatenate(ids), pa.int32())
                places = pa.array(np.concatenate([enc.offsets(x) for x in ids]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, places)], ["doc_id", "ids", "offsets"]
                )
                i = j

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, offsets array<int>")


def decode(rows: DataFrame, ranks: str) -> DataFrame:
    """``rows`` with ``ids`` and ``offsets`` replaced by ``bytes``, the text they stand for; null ids give null."""
    others = [c for c in rows.columns if c not in ("ids", "offsets")]
    schema = rows.select(*others, F.lit(b"").alias("bytes")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            out = []
            for ids, at in zip(batch.column("ids"), batch.column("offsets")):
                if not ids.is_valid:
                    out.append(None)
                    continue
                numbers, places = (x.values.to_numpy(zero_copy_only=False) for x in (ids, at))
                out.append(enc.decode(numbers, places).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(out, pa.binary())], [*others, "bytes"])

    return rows.select(*others, "ids", "offsets").mapInArrow(run, schema)
