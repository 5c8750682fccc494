"""The registered queries of the package, each an operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, leaks, packing, prefixes, private, quality, ranked, sharding, simhash, spans, substrings, tokenfile, vectors
from .common import shared_folder, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf}/{name}.parquet")


@query
def op1_quality_classifier(spark, sf):
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("k1", "k2")


@query
def op2_byte_bpe(spark, sf, ranks: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")):
    coded = bpe.encode(table(spark, sf, "documents"), ranks)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    counted = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), "ids", "offsets")
    return bpe.decode(counted, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


@query
def op3_substring_dedup(spark, sf):
    found = substrings.substring_dedup(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op4_simhash_near_dedup(spark, sf):
    found = simhash.near_dedup(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept")


@query
def op8_exact_dedup(spark, sf):
    found = exact.exact_dedup(table(spark, sf, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest.sha")).alias("text_sha256"))


ORACLE["op8_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (w ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER w AS group_size,
       row_number() OVER (w ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query
def op7_secret_scan(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return _reported(leaks.find_secrets(docs), leaks.KINDS, 3)


@query
def op10_personal_data(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return _reported(private.find_personal(docs), private.KINDS, 4)


def _reported(found: DataFrame, kinds: tuple[str, ...], n_base: int) -> DataFrame:
    return found.select(
        "doc_id",
        *(F.expr(spans.counted("base", k)).alias(f"n_{kinds[k]}") for k in range(n_base)),
        F.sha2(F.expr(spans.listed("base", kinds)), 256).alias("base_sha256"),
        F.expr(spans.listed("concat(base, extra)", kinds)).alias("spans"),
    )


@query
def op5_embedding_dedup(spark, sf):
    return vectors.vector_dedup(table(spark, sf, "embeddings"))


@query
def op6_token_file(spark, sf, vocab: str = public_tokenizers.path("byte_bpe_50k.json")):
    docs = table(spark, sf, "documents")
    path = shared_folder(spark, "tokens")
    tokenfile.write_tokens(docs, path, vocab)
    found = tokenfile.read_tokens(spark, path)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op9_best_fit_packing(spark, sf, vocab: str = public_tokenizers.path("word_bpe_49k.json")):
    return packing.pack_documents(table(spark, sf, "documents"), vocab)


@query
def op11_ranked_search(spark, sf):
    return ranked.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLE["op11_ranked_search"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
t AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM t JOIN w USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""


@query
def op12_histogram_shards(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    sharded = sharding.shard_documents(docs)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return sharded.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op13_conversation_trie(spark, sf):
    return prefixes.conversation_trie(table(spark, sf, "conversations")).drop("key")


ORACLE["op13_conversation_trie"] = r"""
WITH RECURSIVE step(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
tbl AS (SELECT list(v ORDER BY i) AS tbl FROM step WHERE k = 8),
ids AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(c::VARCHAR) + 1), lambda j: ascii(substr(c::VARCHAR, j, 1))::BIGINT)),
                            lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), tbl),
own AS (
  SELECT conv_id AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said, bytes) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
built AS (
  SELECT ids.c, 0 AS part, pos, said, bytes FROM ids JOIN own ON own.c = ids.c - ids.c % 5 WHERE pos < h
  UNION ALL SELECT c, 1, pos, said, bytes FROM ids JOIN own USING (c) WHERE pos >= h),
path AS (
  SELECT c, bytes, row_number() OVER w AS depth, string_agg(said, '') OVER w AS key
  FROM built WINDOW w AS (PARTITION BY c ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, 0, '' FROM ids),
node AS (
  SELECT key, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         CASE WHEN key <> '' THEN left(key, length(key) - 64) END AS parent
  FROM path GROUP BY key),
child AS (SELECT parent AS key, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY 1),
below AS (
  SELECT left(key, 64 * d) AS key, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
  FROM (SELECT node.*, n_children, unnest(range(0, depth + 1)) AS d FROM node LEFT JOIN child USING (key)) GROUP BY 1),
ends AS (
  SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha
  FROM (SELECT c, arg_max(key, depth) AS key FROM path GROUP BY c) GROUP BY key)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       coalesce(sha, sha256('')) AS ends_sha256
FROM node LEFT JOIN node up ON up.key = node.parent LEFT JOIN child ON child.key = node.key JOIN below ON below.key = node.key LEFT JOIN ends ON ends.key = node.key
"""


# every window of 100 bytes, as hex so that a byte is two characters
ORACLE["op3_substring_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, '')) AS n_bytes FROM documents),
win AS MATERIALIZED (SELECT doc_id, s, md5_number(substr(hx, 2 * s + 1, 200)) AS w FROM (SELECT doc_id, hx, unnest(range(0, n_bytes - 99)) AS s FROM d WHERE n_bytes >= 100)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS nth FROM win) WHERE nth > 1),
island AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (
  SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM (
    SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM late))
  GROUP BY doc_id, i),
cut AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM island
  UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(n_bytes) FROM d LEFT JOIN island USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, sha256(unhex(string_agg(substr(hx, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo, hi))) AS kept_sha256 FROM cut JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM island GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

# all pairs, and what is reachable from each vector
ORACLE["op5_embedding_dedup"] = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(far, vec_id)) AS component_id, vec_id <= coalesce(far, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, min(b) AS far FROM reach GROUP BY a) USING (vec_id)
"""
