"""Conversation prefix trie from vertical bitmaps: which conversations say what at which position."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARD_CONVERSATIONS = 4096  # bits of a bitmap
SHARD_TURNS = 1 << 16  # a shard ends here too; one conversation may be longer
ROOT = bytes(16)
HEAD = 8  # most turns a rebuilt conversation takes from another one
OWN = 5  # every OWN-th conversation lends its first turns to those after it


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, said``: for each id its turns in order, each as a digest of role and text with the bytes of its text."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    sized = F.concat(F.octet_length(parts[0]).cast("string"), F.lit(":"), *parts)
    one = F.struct(
        F.col(turn).isNotNull().alias("placed"), F.col(turn).alias("turn"),
        F.substring(F.unhex(F.sha2(sized, 256)), 1, 16).alias("digest"), F.octet_length(parts[1]).cast("long").alias("bytes"),
    )
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("one"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("said"))
    return listed.select("conv_id", F.transform("said", lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"))).alias("said"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation with its first turns from the ``OWN``-th one at or before it, ``h`` of them, then its own from the ``h``-th on."""
    lent = convs.where(F.col("conv_id") % OWN == 0).select(F.col("conv_id").alias("base"), F.slice("said", 1, HEAD).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    both = convs.withColumn("h", h).join(lent, convs.conv_id - convs.conv_id % OWN == lent.base, "left")
    head = F.expr("slice(coalesce(head, array()), 1, h)")
    return both.select("conv_id", F.concat(head, F.expr("slice(said, h + 1, greatest(size(said) - h, 0))")).alias("said"))


class Shard:
    """Conversations in ascending order of id, one bit each."""

    def __init__(self, most: int = SHARD_CONVERSATIONS) -> None:
        self.most = most
        self.ids: list[int] = []
        self.said: list[list[bytes]] = []
        self.postings: dict[tuple[int, bytes], int] = defaultdict(int)  # (position, turn) -> conversations
        self.ends: dict[int, int] = defaultdict(int)  # number of turns -> conversations
        self.bytes: dict[bytes, int] = {}
        self.turns = 0

    def add(self, conv_id: int, said: list[dict]) -> None:
        bit = 1 << len(self.ids)
        self.ids.append(conv_id)
        self.said.append([x["digest"] for x in said])
        self.ends[len(said)] |= bit
        self.turns += len(said)
        for at, x in enumerate(said):
            self.postings[at, x["digest"]] |= bit
            self.bytes[x["digest"]] = x["bytes"]

    def full(self) -> bool:
        return len(self.ids) >= self.most or self.turns >= SHARD_TURNS

    def nodes(self) -> Iterator[list]:
        """``place, size, up, key, depth, n, conv_id, bytes, ends`` of each node, parents first.

        The bits of a node that go on are taken apart: the lowest names a conversation, its next turn a
        posting, and the node's bits in that posting are a child. ``place`` counts nodes depth first, so a
        subtree is ``size`` places long. ``ends`` lists the conversations that end here, ascending.
        """
        out: list[list] = []
        open_: list[tuple[int, int, bytes, int, bytes | None]] = [((1 << len(self.ids)) - 1, -1, ROOT, 0, None)]
        while open_:
            bits, up, key, depth, turn = open_.pop()
            place = len(out)
            ended = bits & self.ends.get(depth, 0)
            first = self.ids[(bits & -bits).bit_length() - 1]
            ends = ",".join(map(str, self._ids(ended))).encode() if ended else None
            out.append([place, 1, up, key, depth, bits.bit_count(), first, self.bytes[turn] if turn else 0, ends])
            rest = bits ^ ended
            while rest:
                said = self.said[(rest & -rest).bit_length() - 1][depth]
                child = rest & self.postings[depth, said]
                open_.append((child, place, hashlib.blake2b(key + said, digest_size=16).digest(), depth + 1, said))
                rest ^= child
        for node in reversed(out):  # children come after their parent
            if node[2] >= 0:
                out[node[2]][1] += node[1]
        return iter(out)

    def _ids(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield self.ids[low.bit_length() - 1]
            bits ^= low


NODES = "shard long, place long, size long, up long, key binary, depth long, n long, conv_id long, bytes long, ends binary"
_KINDS = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 4 + [pa.binary()]


def shard_nodes(convs: DataFrame, most: int = SHARD_CONVERSATIONS) -> DataFrame:
    """The nodes of every shard's own trie; shards are ranges of ids and numbered in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard(most)

        def emptied() -> Iterator[pa.RecordBatch]:
            rows = [[number, *node] for node in shard.nodes()]
            for a in range(0, len(rows), 10_000):
                columns = zip(*rows[a : a + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], [f.split()[0] for f in NODES.split(", ")])

        for batch in batches:
            for conv_id, said in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(conv_id, said.as_py())
                if shard.full():
                    yield from emptied()
                    number, shard = number + 1, Shard(most)
        if shard.ids:
            yield from emptied()

    ordered = convs.select("conv_id", "said").repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    return ordered.mapInArrow(run, NODES)


def _totals(table: pa.Table) -> pa.Table:
    """Sums over the subtrees of one shard, of what the shard is to count."""
    table = table.sort_by("place")
    place, size, up, n, own, leaf, weight, conv = (table.column(c).to_numpy() for c in ("place", "size", "up", "n", "own", "leaf", "bytes", "first"))
    own = own.astype(np.int64)

    def below(values: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values))
        return total[place + size] - total[place]

    children = np.bincount(up[1:], own[1:], len(place)).astype(np.int64) if len(place) > 1 else np.zeros(len(place), np.int64)
    return pa.table(
        {
            "key": table.column("key"), "own": own, "depth": table.column("depth"), "conv_id": conv, "total": table.column("total"),
            "parent": pa.array(np.where(up >= 0, conv[np.maximum(up, 0)], 0), mask=up < 0),
            "children": children, "leaves": below(own * leaf.astype(np.int64)), "saved": below(n * weight - own * weight),
        }
    )


def end_lists(nodes: DataFrame) -> DataFrame:
    """``key, ends_sha256``: SHA-256 of each node's list of ends, fed piece by piece in the order of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            keys, out = [], []
            for k, ends in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        keys.append(key)
                        out.append(digest.hexdigest())
                    key, digest = k, hashlib.sha256()
                digest.update(ends.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [digest.hexdigest()]})

    pieces = nodes.where("ends IS NOT NULL").select("key", "ends", "shard")
    return pieces.repartition("key").sortWithinPartitions("key", "shard").select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, most: int = SHARD_CONVERSATIONS) -> DataFrame:
    """The trie of ``conversations`` or ``rebuilt``: a row per distinct sequence of first turns.

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``. Shards are ranges of ids, at most ``most`` long, so a first turn or a whole
    conversation that a third of all share is spread over all shards. Each shard builds its trie from bitmaps;
    a node is known by a 128-bit digest of its turns, and meets its twins of other shards as one small row from each.
    The shard of the smallest member owns the node: it alone counts the node as a child, as a leaf and as saved from
    itself. All ancestors of an owned node are in its shard too, so the sums over the parts of a subtree in
    each shard add up to those over the whole. A list of ends is hashed in order from a piece per shard.

    Ids are whole numbers. An empty table has no node, not even the root.
    """
    nodes = written(shard_nodes(convs, most), "nodes")
    twins = Window.partitionBy("key")
    known = nodes.drop("ends").withColumns(
        {
            "own": F.col("shard") == F.min("shard").over(twins), "first": F.min("conv_id").over(twins),
            "total": F.sum("n").over(twins), "leaf": F.max("size").over(twins) == 1,
        }
    )
    schema = "key binary, own long, depth long, conv_id long, total long, parent long, children long, leaves long, saved long"
    parts = known.drop("conv_id").groupBy("shard").applyInArrow(_totals, schema)
    owned = lambda c: F.max(F.when(F.col("own") == 1, F.col(c)))
    whole = parts.groupBy("key").agg(
        F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), owned("parent").alias("parent_conv_id"), F.max("total").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return whole.join(end_lists(nodes), "key", "left").withColumn("ends_sha256", ends)


def conversation_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = SHARD_CONVERSATIONS) -> DataFrame:
    """``prefix_trie`` over the rebuilt conversations of a table of turns.

    Turns are ordered by ``turn``, nulls first, ties by digest. Null role and text are empty. Rows without a
    conversation id belong to none and are left out. Repeated rows are turns of their own. Texts are only read to be
    digested, however long. A conversation is processed whole, 24 bytes a turn. Other columns are ignored, whatever their
    names.
    """
    whole = rebuilt(written(conversations(turns, conv_id, turn, role, text), "turns"))
    return prefix_trie(written(whole, "rebuilt"), most)

