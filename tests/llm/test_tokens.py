"""Byte-level BPE, token files and packing against the public libraries."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from hushmark.llm import bpe, packing, queries, tokenfile, vocab

from .conftest import ROWS

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["don't", "I'LL", "x's", " ", "  ", "\n", "\r\n", "\t", "12345", "½", "éa", "é", "日本", "　", "\x85", "<|endoftext|>", "😀", "\0", "a_b", "!!", "ſ'S", "Z", "İ"]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(2)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(400)] + ["", " ", "a" * 5000, " \n" * 2000, "'s" * 500]


def library_ids(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [np.array([*x.ids, 0], "<u4") for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_bpe_matches_tiktoken_and_decodes(shipped, odd_texts):
    model = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})
    rows = [(i, t) for i, t in enumerate([*odd_texts, None])]
    docs = shipped.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {i: model.encode_ordinary(t or "") for i, t in rows}
    coded = bpe.encode(docs, RANKS)
    for r in coded.collect():
        assert list(r.ids) == want[r.doc_id], rows[r.doc_id]
    for r in bpe.decode(coded, RANKS).collect():
        assert bytes(r.bytes) == (rows[r.doc_id][1] or "").encode()


def test_bpe_offsets_delimit_tokens(shipped, odd_texts):
    docs = shipped.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string")
    sizes = {i: len(b) for b, i in load_tiktoken_bpe(RANKS).items()}
    for r in bpe.encode(docs, RANKS).collect():
        # where each token starts or ends in the text
        ends = np.cumsum([sizes[i] for i in r.ids]).tolist()
        assert list(r.offsets) in (ends, [0, *ends], [0, *ends[:-1]][: len(ends)])


def test_pretokens_match_the_pattern(shipped, odd_texts):
    pattern = regex.compile(public_tokenizers.PATTERN)
    docs = shipped.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string")
    sizes = {i: len(b) for b, i in load_tiktoken_bpe(RANKS).items()}
    for r in bpe.encode(docs, RANKS).collect():
        cuts = set(np.cumsum([sizes[i] for i in r.ids]).tolist())
        assert {len(odd_texts[r.doc_id][: m.end()].encode()) for m in pattern.finditer(odd_texts[r.doc_id])} <= cuts


def test_bpe_query_and_odd_rows(shipped, odd, none, some):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op2_byte_bpe"](shipped, SF).collect()}
    model = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})
    hexed = lambda s: sha256(s).hexdigest()
    for r in some.select("doc_id", "text").collect():
        ids = model.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hexed(",".join(map(str, ids)).encode()), hexed((r.text or "").encode()))
    assert bpe.encode(odd, RANKS).count() == len(ROWS) and bpe.encode(none, RANKS).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 20000])
@pytest.mark.parametrize("bits", [1, 16, 40, 64])
def test_simple8b_round_trip(n, bits):
    rng = np.random.default_rng(n + bits)
    ids = rng.integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True)
    ids[rng.random(n) < 0.3] = 0
    words, offsets, escapes = tokenfile.pack(ids)
    assert (tokenfile.unpack(words, escapes, n) == ids).all()
    for _ in range(5 if n else 0):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (tokenfile.unpack_range(words, offsets, escapes, a, b) == ids[a:b]).all()


def test_token_file_matches_the_library(shipped, odd_texts, tmp_path):
    rows = [(3 * i, t) for i, t in enumerate([None, *odd_texts])]
    docs = shipped.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tokenfile.write_tokens(docs, str(tmp_path / "t"), BYTES)
    got = {r.doc_id: (r.start, bytes(r.ids)) for r in tokenfile.read_tokens(shipped, str(tmp_path / "t")).collect()}
    start = 0
    for (i, _), ids in zip(rows, library_ids(BYTES, [t for _, t in rows])):
        assert got[i] == (start, ids.tobytes()), i
        start += len(ids)


def test_token_file_odd_rows(shipped, odd, none, tmp_path):
    tokenfile.write_tokens(odd, str(tmp_path / "odd"), BYTES)
    found = tokenfile.read_tokens(shipped, str(tmp_path / "odd")).orderBy("start").collect()
    assert len(found) == len(ROWS) and [r.doc_id for r in found] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i))
    ends = np.cumsum([len(r.ids) // 4 for r in found]).tolist()
    assert [r.start for r in found] == [0, *ends[:-1]]
    tokenfile.write_tokens(none, str(tmp_path / "none"), BYTES)
    assert tokenfile.read_tokens(shipped, str(tmp_path / "none")).count() == 0


def check_places(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_matches_the_library(shipped):
    rows = queries.QUERIES["op9_best_fit_packing"](shipped, SF).collect()
    docs = shipped.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d, ids in zip(docs, library_ids(WORDS, [d.text for d in docs])):
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[d.doc_id, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    least = -(-sum(r.length for r in rows) // 2048)
    assert check_places(rows, 2048) <= 1.05 * least + 8


def test_swaps_fill_bins():
    """The search, not the start, does the packing; squares only grow, and every kind of move is made."""
    rng = random.Random(6)
    lengths = [rng.choice([rng.randint(1, 400), rng.randint(1, 2048)]) for _ in range(4000)]
    bins = packing.Bins(lengths, 2048)
    start, squares = bins.count(), bins.squares()
    bins.search()
    assert start > 1.15 * bins.least() and bins.count() <= 1.03 * bins.least()
    assert bins.squares() > squares and all(bins.moves.values())
    assert all(0 <= f for f in bins.free) and sorted(i for h in bins.held for x in h.values() for i in x) == list(range(4000))
    bin_of, offsets = packing.pack_lengths(lengths, 2048)
    places = defaultdict(list)
    for b, o, n in zip(bin_of, offsets, lengths):
        places[b].append((o, n))
    for b in places.values():
        assert [o for o, _ in sorted(b)] == np.cumsum([0, *(n for _, n in sorted(b))]).tolist()[:-1] and sum(n for _, n in b) <= 2048
    assert packing.pack_lengths([], 2048) == ([], [])
    assert len(set(packing.pack_lengths([2048] * 5, 2048)[0])) == 5


def test_every_exchange_raises_the_squares(monkeypatch):
    rng = random.Random(1)
    bins = packing.Bins([rng.randint(1, 90) for _ in range(400)], 100)
    real, seen = packing.Bins._exchange, []

    def watched(self, *args):
        before = self.squares()
        real(self, *args)
        seen.append(self.squares() - before)

    monkeypatch.setattr(packing.Bins, "_exchange", watched)
    bins.search()
    assert seen and min(seen) > 0


def test_columns_of_texts_equal_the_plain_call(odd_texts):
    """Slices, caches that overflow, and the strings of special tokens, against the library's default."""
    texts = [*odd_texts, None, "a <|endoftext|> b", "<|startoftext|>", "<|EndOfText|>", "x\ny z,\nend.", "long " * 50_000]
    for path in (BYTES, WORDS):
        want = library_ids(path, texts)
        words = vocab.Vocabulary(path, memory=20_000)
        for _ in range(2):
            got = list(words.encode_all(pa.array(texts)))
            assert [x.tolist() for x in got] == [w[:-1].tolist() for w in want]
        assert [words.encode(t).tolist() for t in texts] == [w[:-1].tolist() for w in want]


def test_packing_odd_rows(odd, none):
    rows = packing.pack_documents(odd, WORDS, capacity=512).collect()
    assert len([r for r in rows if r.piece == 0]) == len(ROWS)
    check_places(rows, 512)
    assert all(r.length == 512 for r in rows if any(s.doc_id == r.doc_id and s.piece > r.piece for s in rows) and r.doc_id == 9)
    assert packing.pack_documents(none, WORDS).count() == 0
