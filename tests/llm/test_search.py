"""Ranked search, sharding and the conversation trie against plain Python, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hushmark.llm import prefixes, ranked, sharding

from .conftest import ROWS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(docs, items, k=10):
    bags = [(i, Counter(cut(t)), len(cut(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in bags:
            score = 0
            for t in cut(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // total)))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return Counter(out)


def ranks(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(ranked, "STEP", 10)
    text = "Ab1 " * 40 + "x" * 50 + "-É_ß  z" * 9
    assert [t.decode() for part in ranked.terms(text.encode()) for t in part] == cut(text)


@pytest.mark.parametrize("block", [1 << 22, 600])
def test_search_matches_brute_force(some, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK_BYTES", block)
    monkeypatch.setattr(ranked, "CELLS", 300)
    docs = [(r.doc_id, r.text) for r in some.collect()]
    docs += [(10**6 + i, docs[3][1]) for i in range(30)]  # a large class
    items = [(0, docs[3][1][:300]), (1, docs[5][1][:200]), (1, docs[5][1][:200]), (2, None), (3, "..."), (4, "zzqqxx"), (None, docs[7][1][:90] * 2)]
    spark = some.sparkSession
    got = ranked.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranks(got) == ranking(docs, items)


def test_a_class_is_scored_once(some, monkeypatch):
    """Copies and documents that differ beyond the items' words only make one class."""
    spark = some.sparkSession
    docs = [(i, f"apple pear filler{i} other{i}") for i in range(50)] + [(100 + i, "pear apple a b") for i in range(50)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    seen = []
    real = ranked.best_classes
    monkeypatch.setattr(ranked, "best_classes", lambda classes, *a: seen.append(classes.count()) or real(classes, *a))
    got = ranked.search(docs, spark.createDataFrame([(1, "apple pear")], "item_id long, text string"))
    assert [r.doc_id for r in got.orderBy("rank").collect()] == list(range(10)) and seen == [1]


def test_whole_sums_beyond_doubles():
    triples = [(t, i, 1 + t * 10**6) for t in range(3) for i in range(4)]
    post = ranked.Postings(triples, __import__("numpy").array([20000, 3, 5]), 4)
    bags = [b"".join(int(x).to_bytes(4, "little") for x in (0, 2, 1, 7, 2, 1))]
    want = sum((10**9 * tf // (1000 * tf + 8 * 30)) * w * (1 + t * 10**6) for t, tf, w in ((0, 2, 20000), (1, 7, 3), (2, 1, 5)))
    for exact in (True, False):
        post.exact = exact
        assert post.scores(bags, __import__("numpy").array([30])).tolist() == [[want] * 4]


def test_search_odd_rows(odd, none):
    items = odd.select(F.col("doc_id").alias("item_id"), "text", "kept", F.lit(1).alias("score"))
    assert ranks(ranked.search(odd, items)) == ranking([(i, t) for i, t in ROWS], [(i, t) for i, t in ROWS])
    assert ranked.search(none, items).count() == 0
    assert ranked.search(odd, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


def sharded(df, n):
    rows = df.collect()
    held, slots, groups = [0] * n, defaultdict(list), defaultdict(set)
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 16 and r.law == "bytes"
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[r.text or ""].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, held, groups


@pytest.mark.parametrize("parts", [3, 400])
def test_shards_are_even(some, parts):
    """Also with a third of the rows equal; ``parts`` asks for several ranges to a shard."""
    spark = some.sparkSession
    rows = [(r.doc_id, r.text) for r in some.collect()]
    rows += [(10**6 + i, "the same text again " * 5) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got, held, groups = sharded(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 40), 40)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    most = max(r.size for r in got)
    assert max(held) - min(held) <= most + 0.002 * sum(held) / 40
    assert sum(len(s) > 1 for s in groups.values()) <= 39


def test_groups_stay_together_within_the_tolerance(shipped):
    rows = [(i, f"text {i // 4} " + "x" * 40) for i in range(8000)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string").repartition(6)
    _, held, groups = sharded(sharding.shard_documents(docs, 10, tolerance=0.02), 10)
    assert all(len(s) == 1 for s in groups.values()) and max(held) - min(held) < 0.05 * sum(held) / 10


def test_splitters_against_sorting(shipped):
    rng = random.Random(3)
    rows = [(rng.choice([5, rng.randrange(-(2**63), 2**63)]), rng.randrange(-(2**63), 2**63), rng.randrange(1, 50)) for _ in range(5000)]
    keys = shipped.createDataFrame(rows, "high long, low long, size long").repartition(6)
    order = sorted((((h % 2**64) << 64) | (l % 2**64), s) for h, l, s in rows)
    total = sum(s for _, s in order)
    targets = [(total * i // 9, 0) for i in range(1, 9)]
    edges = sharding.splitters(keys, targets)
    for (want, _), e in zip(targets, edges):
        below = [s for k, s in order if k < e.key]
        assert (e.bytes, e.rows) == (sum(below), len(below))
        sums = [0]
        for _, s in order:
            sums.append(sums[-1] + s)
        assert abs(e.bytes - want) == min(abs(x - want) for x in sums)


def test_shards_odd_rows(odd, none, shipped, tmp_path):
    got = sharding.shard_documents(odd, 4)
    assert got.columns == [*odd.columns, "size_", "law", "shard", "slot"] and got.count() == len(ROWS)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(ROWS)
    assert sharding.shard_documents(none, 4).count() == 0
    plain = odd.select("doc_id", "text")
    _, held, _ = sharded(sharding.shard_documents(plain, 40), 40)
    assert sum(held) == sum(len((t or "").encode()) + 16 for _, t in ROWS)
    sharding.write_shards(plain, str(tmp_path / "shards"), shards=3)
    back = shipped.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(ROWS) and back.select("shard").distinct().count() <= 3


def trie(turns):
    """Nodes of the rebuilt conversations: key -> the values of a row."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            said = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            own[c].append((turn is not None, turn or 0, hashlib.sha256(said.encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        said = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(said) + 1):
            members[said[:d]].append(c)
        ends[said].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for key in members:
        children[key[:-1]] += bool(key)
    for key, who in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(who) - 1) * (len(key[-1][1].encode()) if key else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter(
        (min(who), len(k), min(members[k[:-1]]) if k else None, len(who), children[k], leaves[k], saved[k], digest(ends[k])) for k, who in members.items()
    )


def nodes(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("convs", [4096, 1, 3])
def test_trie_matches_brute_force(shipped, convs):
    """Shards of three conversations share nodes, so owners and sums over shards matter."""
    rng = random.Random(7)
    turns = []
    for c in rng.sample(range(300), 160):
        same = rng.random() < 0.4
        for t in range(rng.randrange(0, 12)):
            turns.append((c, t, ["user", "assistant"][t % 2], f"same {t}" if same else f"é {rng.randrange(3)}"))
    turns += [(1000, t, "user", f"long {t // 2}") for t in range(400)]
    df = shipped.createDataFrame(rng.sample(turns, len(turns)), TURNS).repartition(8)
    built = prefixes.prefix_trie(prefixes.rebuilt(prefixes.conversations(df)), convs)
    assert nodes(built) == trie(turns)
    assert prefixes.shard_nodes(prefixes.rebuilt(prefixes.conversations(df)), convs).select("shard").distinct().count() >= 150 // convs


def test_trie_of_the_table(shipped):
    df = shipped.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert nodes(prefixes.conversation_trie(df)) == trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_odd_rows(shipped):
    rows = [
        (5, None, None, None), (5, 1, "user", "x" * 300_000), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 0, "", ""),
        (6, 0, "user", None), (6, 0, "us", "er"), (6, 0, "use", "r"), (None, 0, "user", "no conversation"), (7, 3, "a", "b"), (12, 0, "a", "b"), (27, 9, "a", "b"),
        *((31, i, "user", "") for i in range(3)),
    ]
    df = shipped.createDataFrame(rows, TURNS).withColumns({c: F.lit(c) for c in ("said", "key", "bytes", "own", "shard")})
    got = prefixes.conversation_trie(df)
    assert nodes(got) == trie(rows)
    assert got.where("depth = 0").count() == 1
    assert prefixes.conversation_trie(df.where("false")).count() == 0
