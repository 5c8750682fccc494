"""Dedup operators against plain Python, and their results on odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushmark.llm import exact, queries, simhash, substrings, vectors

from . import brute
from .conftest import ROWS

SF = "/root/testdata/sf0.001"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_matches_brute_force(some):
    rows = [(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(some).collect()}
    assert got == {i: ((k := min(groups[norm(t)])[1]), len(groups[norm(t)]), k == i) for i, t in rows}


def test_exact_odd_rows(odd, none):
    found = exact.exact_dedup(odd).collect()
    assert len(found) == len(ROWS)
    sizes = Counter(norm(t) for _, t in ROWS)
    assert sorted(r.group_size for r in found) == sorted(sizes[norm(t)] for _, t in ROWS)
    assert sum(r.kept for r in found) == len(sizes)
    assert {r.keep_id for r in found if r.doc_id in (4, 5, 6)} == {6}  # the longest of the blank texts
    left = exact.without_copies(odd)
    assert left.columns == odd.columns and left.count() == len(sizes)
    assert exact.exact_dedup(none).count() == exact.without_copies(none).count() == 0


def test_simhash_matches_brute_force(some):
    rows = [(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "one two"), (10**6 + 3, "One  TWO")]
    docs = some.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(5)
    fps = {i: brute.fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = brute.smallest(ids, links)
    got = {r.doc_id: (r.fp % 2**64, r.component_id, r.kept) for r in simhash.near_dedup(docs).collect()}
    assert got == {i: (fps[i], want[i], want[i] == i) for i in ids}


def test_simhash_links_over_tiles(shipped):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(25)})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    fps = shipped.createDataFrame([(v,) for v in signed], "fp long")
    found = [(r.a, r.b) for r in simhash.links(fps, 3, tile=4).collect()]
    near = [(a, b) for n, a in enumerate(signed) for b in signed[n + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3]
    assert brute.smallest(signed, found) == brute.smallest(signed, near)


def test_simhash_odd_rows(odd, none):
    found = simhash.near_dedup(odd).collect()
    assert len(found) == len(ROWS)
    blank = [r for r in found if r.fp == 0]
    assert len(blank) == 4 and {r.component_id for r in blank} == {4} and sum(r.kept for r in blank) == 1
    left = simhash.without_near_copies(odd)
    assert left.columns == odd.columns and left.count() == sum(r.kept for r in found)
    assert simhash.near_dedup(none).count() == simhash.without_near_copies(none).count() == 0


def cut(docs):
    found = substrings.substring_dedup(docs)
    rows = found.select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnop é\0"])
def test_substrings_match_brute_force(shipped, letters, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 16)  # passages over many chunks
    rng = random.Random(3)
    pool = ["".join(rng.choices(letters, k=rng.randint(60, 400))) for _ in range(10)]
    rows = []
    for i in range(80):
        parts = [rng.choice(pool)[rng.randint(0, 50) :] if rng.random() < 0.6 else "".join(rng.choices(letters, k=rng.randint(0, 200))) for _ in range(rng.randint(0, 4))]
        rows.append((i, "".join(parts) if rng.random() > 0.05 else None))
    docs = shipped.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert cut(docs) == brute.substrings(rows)


def test_suffixes_are_sorted():
    rng = random.Random(4)
    strings = ["".join(rng.choices("ab\0", k=rng.randint(20, 60))).encode() for _ in range(30)]
    s = substrings.Suffixes(strings, 16)
    order = s.array()
    raw = s.data.tobytes()
    windows = [raw[i : i + 16] for i in order.tolist()]
    assert windows == sorted(windows) and len(windows) == sum(len(x) - 15 for x in strings)
    shared = s.common_prefixes(order).tolist()
    for a, b, n in zip(windows, windows[1:], shared[1:]):
        assert n == next((k for k in range(16) if a[k] != b[k]), 16)


def test_substrings_odd_rows(odd, none):
    found = substrings.substring_dedup(odd).collect()
    assert len(found) == len(ROWS)
    kept = {(r.doc_id, bytes(r.kept)) for r in found if r.doc_id in (4, 5, 6, 8)}
    assert kept == {(4, b""), (5, b""), (6, b" \t\n"), (8, b"x")}
    assert sorted(len(r.kept) for r in found if r.doc_id == 2) == [0, 0]  # all of it starts earlier in 1
    assert sorted(len(r.kept) for r in found if r.doc_id is None) == [0, 5]
    assert substrings.substring_dedup(none).count() == 0


def linked(rows, least=0.95):
    good = [k for k, (_, x) in enumerate(rows) if x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    u = np.array([rows[k][1] for k in good], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    pairs = [(ids[good[a]], ids[good[b]]) for a, b in zip(*np.nonzero(near))]
    root, links = brute.smallest(ids, pairs), dict(zip((ids[k] for k in good), near.sum(1).tolist()))
    return {i: (links.get(i, 0), root[i], root[i] == i) for i in ids}


def test_vectors_match_brute_force(shipped):
    rows = [(r.vec_id, r.embedding) for r in shipped.read.parquet(f"{SF}/embeddings.parquet").collect()]
    dim, top = len(rows[0][1]), 10**6
    rows += [(top, None), (top + 1, [0.0] * dim), (top + 2, [float("nan")] * dim), (top + 3, [None] * dim), (top + 4, []), (top + 5, rows[0][1]), (top + 6, rows[0][1]), (top + 7, [2 * x for x in rows[1][1]])]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    df = df.withColumns({c: F.lit(c) for c in ("uid", "raw", "node", "copies", "kept")})
    got = {r[0]: tuple(r[1:]) for r in vectors.vector_dedup(df, tile=97).collect()}
    assert got == linked(rows)
    empty = vectors.vector_dedup(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_vectors_repeated_and_null_ids(shipped):
    rows = [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [0.0, 1.0]), (None, None)]
    got = vectors.vector_dedup(shipped.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in got) == [(-1, 0, -1), (-1, 2, 3), (3, 2, 3), (3, 2, 3), (5, 0, 5)]
    assert sum(r.kept for r in got) == 3


def test_queries_take_the_whole_table(some):
    for name in ("op3_substring_dedup", "op4_simhash_near_dedup", "op8_exact_dedup"):
        assert queries.QUERIES[name](some.sparkSession, SF).count() == some.count()


def test_rows_of_one_id_stay_apart(shipped, monkeypatch):
    """Texts whose hashes clash are other rows all the same: another seed is taken."""
    a, b = "first passage " * 12, "second words. " * 12
    real = substrings.row_hash
    monkeypatch.setattr(substrings, "row_hash", lambda seed: F.lit(0).cast("long") if seed < 2 else real(seed))
    rows = [(None, a), (None, b), (5, a), (5, b), (7, a), (7, b), (7, "short")]
    docs = shipped.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or -1, r.n_bytes, bytes(r.kept)) for r in substrings.substring_dedup(docs).collect())
    assert [(i, n, k) for i, n, k in got if i == -1] == sorted((-1, len(x), substrings_alone(x)) for x in (a, b))
    assert all(k == (b"short" if n == 5 else b"") for i, n, k in got if i > 0)


def substrings_alone(text):
    """What is left of a text that repeats itself only."""
    raw, seen = text.encode(), set()
    gone = bytearray(len(raw))
    for s in range(len(raw) - 99):
        if raw[s : s + 100] in seen:
            gone[s : s + 100] = b"\1" * 100
        seen.add(raw[s : s + 100])
    return bytes(x for x, g in zip(raw, gone) if not g)
