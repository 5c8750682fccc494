"""Ranked lexical search: documents that look the same to the queries are scored once, as a bag class."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# a-z stay, A-Z become a-z, digits and all bytes above 7F stay, anything else parts terms
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
STEP = 1 << 20  # bytes of a text that are cut to terms at a time
BLOCK_BYTES = 1 << 22  # bytes of distinct terms in a block of items, which is what a broadcast may hold
CELLS = 1 << 22  # parts of scores, at most, that are summed at a time
EXACT = 1 << 53  # sums of doubles are exact below


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists that cover about ``STEP`` bytes each."""
    raw = raw.translate(_TERM)
    at = 0
    while len(raw) - at > STEP:
        end = raw.find(b" ", at + STEP)
        if end < 0:
            break
        yield raw[at:end].split()
        at = end
    yield (raw[at:] if at else raw).split()


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``row, item_id, term, times``: one row per item row and distinct term."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                count: Counter = Counter()
                for part in terms(batch.column(2)[i].as_py() or b""):
                    count.update(part)
                n = len(count)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).take(pa.array([i] * n, pa.int64())) for k in (0, 1)]
                    + [pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())],
                    ["row", "item_id", "term", "times"],
                )

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"row long, item_id {kind}, term binary, times long")


def item_blocks(found: DataFrame, most: int) -> int:
    """Into how many blocks the items are dealt so that the terms of none take more than ``most`` bytes.

    A block of one item may be larger, as large as that row. The count doubles until it is enough.
    """
    size = F.octet_length("term") + 16
    total, rows = found.agg(F.coalesce(F.sum(size), F.lit(0)), F.count_distinct("row")).first()
    n = 1
    while n * most < total:
        n *= 2
    while True:
        block = found.groupBy(_block(n).alias("b")).agg(F.sum(size).alias("bytes"), F.count_distinct("row").alias("rows"))
        if n > 64 * max(rows, 1) or not block.where((F.col("bytes") > most) & (F.col("rows") > 1)).head(1):
            return n
        n *= 2


def _block(n: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(n))


def bags(docs: DataFrame, vocabulary: list[bytes], doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, bag`` of every document: its terms, and how often it holds each term of the vocabulary.

    A bag is pairs of little-endian 32-bit integers, term number and count, by term number.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            sizes, out = [], []
            for t in batch.column(1):
                n, count = 0, Counter()
                for part in terms(t.as_py() or b""):
                    n += len(part)
                    count.update(map(number.get, part))
                count.pop(None, None)
                pairs = np.array(sorted(count.items()), "<u4")
                sizes.append(n)
                out.append(pairs.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "bag"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, bag binary")


def holders(classes: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs, summed over classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for bag, n in zip(batch.column(0), batch.column(1).to_pylist()):
                total[np.frombuffer(bag.as_py(), "<u4")[::2]] += n
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    df = np.zeros(size, np.int64)
    for r in classes.select("bag", "size").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r.term] = r.df
    return df


class Postings:
    """The items of a block by term: for each term the items that hold it, with weight times occurrences."""

    def __init__(self, triples: list[tuple[int, int, int]], weights: np.ndarray, n_items: int):
        term, item, times = (np.array(x, np.int64) for x in zip(*sorted(triples), strict=True))
        self.first = np.searchsorted(term, np.arange(len(weights) + 1))
        self.item, self.weight, self.n_items = item, times * weights[term], n_items
        most = np.bincount(item, self.weight.astype(np.float64), n_items).max()
        self.exact = most * 1e6 < EXACT  # a part of a term below is under a million

    def scores(self, bags: list[bytes], m: np.ndarray) -> np.ndarray:
        """Scores of classes (rows) for items (columns), whole numbers."""
        sizes = np.array([len(b) // 8 for b in bags])
        pairs = np.frombuffer(b"".join(bags), "<u4").reshape(-1, 2).astype(np.int64)
        row = np.repeat(np.arange(len(bags)), sizes)
        part = (10**9 * pairs[:, 1]) // (1000 * pairs[:, 1] + 8 * m[row])
        held = self.first[pairs[:, 0] + 1] - self.first[pairs[:, 0]]
        ends = np.cumsum(held)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[pairs[:, 0]] - ends + held, held)
        cell = np.repeat(row, held) * self.n_items + self.item[at]
        value = np.repeat(part, held) * self.weight[at]
        if self.exact:
            flat = np.bincount(cell, value, len(bags) * self.n_items).astype(np.int64)
        else:
            flat = np.zeros(len(bags) * self.n_items, np.int64)
            np.add.at(flat, cell, value)
        return flat.reshape(len(bags), self.n_items)


def best_classes(classes: DataFrame, postings: Postings, k: int) -> DataFrame:
    """``item, score, h, m, bag, first``: of each task the ``k`` best classes of each item.

    Classes are ordered by score, then by their smallest id. A document among the best ``k``
    has fewer than ``k`` documents before it, so fewer than ``k`` classes: no more are needed.
    """
    shared = classes.sparkSession.sparkContext.broadcast(postings)
    order = {f.name: f.dataType.simpleString() for f in classes.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = shared.value
        best: list[list[tuple]] = [[] for _ in range(post.n_items)]
        least = np.ones(post.n_items, np.int64)  # the score that an item's next class needs
        step = max(1, CELLS // len(post.item))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                h, bag, first = (part.column(c).to_pylist() for c in ("h", "bag", "first"))
                m = np.array(part.column("m"), np.int64)
                table = post.scores(bag, m)
                items, rows = np.nonzero((table >= least).T)
                for item, at in zip(*np.unique(items, return_index=True), strict=True):
                    near = rows[at : np.searchsorted(items, item, side="right")].tolist()
                    kept = best[item]
                    kept += [(int(table[r, item]), h[r], int(m[r]), bag[r], first[r]) for r in near]
                    kept.sort(key=lambda x: (-x[0], x[4] is None, x[4] if x[4] is not None else 0))
                    del kept[k:]
                    if len(kept) == k:
                        least[item] = max(1, kept[-1][0])
        for item, rows in enumerate(best):
            if rows:
                score, h, m, bag, first = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(rows), pa.int64()), pa.array(score, pa.int64()), pa.array(h, pa.int64()), pa.array(m, pa.int64()), pa.array(bag, pa.binary()), pa.array(first, batch.schema.field("first").type)],
                    ["item", "score", "h", "m", "bag", "first"],
                )

    return classes.select("h", "m", "bag", "first").mapInArrow(run, f"item long, score long, h long, m long, bag binary, first {order['first']}")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` documents that score highest for each item: ``item_id, rank, doc_id, score``.

    Of each document only how often it holds the items' terms, and its length in the form
    that the score uses, matter. Documents that agree in both are one class: rows are
    dealt by a hash of the two, and grouping compares the two themselves. A class is scored
    once, by the smallest of its ids, and the best classes are expanded to their members by
    ascending id. Items are taken in blocks whose terms are bounded in bytes; each block is
    broadcast and costs a pass over the documents.

    Null texts and texts without a term have no score (and do not count as documents), an
    item without a term gets no rows, and so does a table without documents. Equal scores
    rank by ascending id, null ids last; rows that repeat an id are documents of their own,
    and so are rows that repeat an item. Long texts are cut to terms piece by piece. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    found = written(item_terms(items, item_id, item_text), "items")
    n_blocks = item_blocks(found, BLOCK_BYTES)
    out = None
    for b in range(n_blocks):
        block = found.where(_block(n_blocks) == b).collect()  # at most BLOCK_BYTES of terms
        if block:
            ranked = _search_block(docs, block, found.schema["item_id"].dataType.simpleString(), k, doc_id, text)
            if ranked is not None:
                out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        kinds = (found.schema["item_id"].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString())
        out = spark.createDataFrame([], "item_id {}, rank int, doc_id {}, score long".format(*kinds))
    return out


def _search_block(docs: DataFrame, block: list, item_kind: str, k: int, doc_id: str, text: str) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = sorted({bytes(r.term) for r in block})
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = sorted({r.row for r in block})
    place = {r: i for i, r in enumerate(rows)}
    ids = {place[r.row]: r.item_id for r in block}

    bag = written(bags(docs, vocabulary, doc_id, text), "bags")
    n_docs, n_terms = bag.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    keyed = bag.where("octet_length(bag) > 0").select(
        "doc_id", "bag", F.expr(f"100 - 75 + (75 * n * {n_docs}L) div {n_terms}L").alias("m")
    ).withColumn("h", F.xxhash64("bag", "m"))
    classes = written(keyed.groupBy("h", "m", "bag").agg(F.count("*").alias("size"), F.min("doc_id").alias("first")), "classes")
    df = holders(classes, len(vocabulary))
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    postings = Postings([(number[bytes(r.term)], place[r.row], r.times) for r in block], weights, len(rows))

    nearest = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"))
    best = best_classes(classes, postings, k).withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k).drop("nth", "first")
    best = written(best, "best")
    # at most k classes for each item of the block
    wanted = F.broadcast(best.select("h", "m", "bag").distinct())
    member = Window.partitionBy("h", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    members = keyed.join(wanted, ["h", "m", "bag"]).withColumn("nth", F.row_number().over(member)).where(F.col("nth") <= k).drop("nth")
    place_of = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.join(members, ["h", "m", "bag"]).withColumn("rank", F.row_number().over(place_of)).where(F.col("rank") <= k)
    named = spark.createDataFrame(sorted(ids.items()), f"item long, item_id {item_kind}")
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
