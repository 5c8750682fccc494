"""Named queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed
from .functions import keys, pairs, pseudonym, scores, sqlfunctions, tokens
from .operators import baseline, evaluate, jsonleaf, numbers, redaction, ruletable, state, urls, vocabulary
from .options import Options, Rule
from .sources import derived, folders, lines
from .streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

OPTIONS = Options(salt="depot ledger salt, kept for all runs")
SAFE_RULES = (Rule("^Brand#1[0-9]$", "TwoDigitBrand"), Rule("^[A-Z]{6,}$", "Capitals"))
CUSTOM_RULES = (
    Rule("[0-9]+$", "Digits"),
    Rule("^(Brand|BRAND)#", "Brand"),
    Rule("[A-Z]{5,}", "Capitals"),
    Rule("^[a-f0-9]{9,}", "Hex"),
)
RULES = OPTIONS.with_(custom_rules=CUSTOM_RULES, safe_rules=SAFE_RULES)
LOW_LIMIT, HIGH_LIMIT = 3.3, 5.2
PATTERNS = OPTIONS.with_(key_patterns=("^user", "context_?id"))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return lines.spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    rows = lines.split_documents(docs, "doc_id", "text", "source", "lang")
    return rows.withColumn("line_id", F.expr("doc_id * 4294967296 + line_no"))


def order_logs(spark: SparkSession, sf: str) -> DataFrame:
    return derived.order_logs(table(spark, sf, "orders"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return order_logs(spark, sf).select("source", "line_id", "line")


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary of the documents."""
    return vocabulary.vocabulary(doc_lines(spark, sf).select("line"))


def log_words(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary of the log lines."""
    return vocabulary.vocabulary(log_lines(spark, sf).select("line"))


def work_folder(spark: SparkSession, name: str) -> str:
    return folders.shared_folder(spark, name)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    found = redaction.find(doc_lines(spark, sf).select("source", "line_id", "line"), OPTIONS)
    return found.groupBy("source", "kind").agg(F.count("*").alias("n"), F.countDistinct("mark").alias("n_marks"))


# --- sources, sinks ---------------------------------------------------------------


@query
def src1_conversations(spark, sf):
    turns = table(spark, sf, "conversations")
    return lines.from_table(turns, F.col("role"), F.expr("conv_id * 1000 + turn"), F.col("text"))


FILE_BYTES = 1 << 28


def text_folder(spark, sf, folder, file_bytes=FILE_BYTES):
    """The lines of the documents as one text log per language, in files of about ``file_bytes`` that follow each other by name."""
    docs = table(spark, sf, "documents")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = lines.split_documents(docs, "doc_id", "text", "lang")
    order = ("lang", "doc_id", "line_no")
    ordered = rows.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)
    ordered.select("lang", F.col("line").alias("value")).write.partitionBy("lang").text(f"{folder}/in")
    return f"{folder}/in"


LANG = "regexp_extract(source, 'lang=([^/]+)/', 1) AS lang"


@query
def src1_text(spark, sf):
    """Text files read as lines with their numbers."""
    found = lines.from_text(spark, text_folder(spark, sf, work_folder(spark, "src1")))
    return lines.through_folders(found).selectExpr(LANG, "line_id", "line")


@query
def src2_text(spark, sf):
    """The same files as a stream, one file a batch, redacted, with the same ids."""
    folder = work_folder(spark, "src2")
    raw = lines.from_text_stream(spark, text_folder(spark, sf, folder), maxFilesPerTrigger="1")
    stream.numbered_stream(raw, OPTIONS, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return lines.through_folders(spark.read.parquet(f"{folder}/out")).selectExpr(LANG, "line_id", "redacted")


@query
def src2_stream(spark, sf):
    folder = work_folder(spark, "src2")
    schema = spark.read.parquet(f"{sf}/conversations.parquet").schema
    unbounded = spark.readStream.schema(schema).parquet(f"{sf}/conversations*.parquet")
    rows = lines.from_table(unbounded, F.col("role"), F.expr("conv_id * 1000 + turn"), F.col("text"))
    stream.write_stream(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("bytes")
    )


@query
def src3_documents(spark, sf):
    split = lines.split_documents(table(spark, sf, "documents"), "doc_id", "text")
    counts = split.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line") == "").alias("n_blank"))
    joined = lines.join_lines(split, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))
    return counts.join(joined, "doc_id")


@query
def src4_part(spark, sf):
    """A rule list per part type, parsed into the rule table."""
    lists = table(spark, sf, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))
    as_json = lists.select(
        "p_type",
        F.to_json(F.transform("brands", lambda b: F.struct(F.concat(F.lit("^"), b, F.lit("$")).alias("pattern"), b.alias("name")))).alias("rules"),
    )
    return vocabulary.rule_table(as_json, "rules", "custom")


@query
def snk1_documents(spark, sf):
    folder = work_folder(spark, "snk1")
    rows = doc_lines(spark, sf).select("source", "line_id", "line")
    redaction.redact_lines(rows, OPTIONS).drop("line").write.parquet(f"{folder}/out")
    return spark.read.parquet(f"{folder}/out")


@query
def snk2_stream(spark, sf):
    folder = work_folder(spark, "snk2")
    schema = spark.read.parquet(f"{sf}/orders.parquet").schema
    unbounded = spark.readStream.schema(schema).parquet(f"{sf}/orders*.parquet")
    rows = stream.redact_stream(derived.order_logs(unbounded).select("source", "line_id", "line"), OPTIONS)
    stream.write_stream(rows.drop("line"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


# --- tokens -------------------------------------------------------------------------


@query
def tok1_documents(spark, sf):
    rows = doc_lines(spark, sf).withColumn("toks", F.expr(tokens.tokens("line")))
    sep = F.expr(f"filter(toks, t -> {tokens.is_separator('t')})")
    return rows.select(
        "line_id",
        F.size("toks").alias("n_tokens"),
        F.size(sep).alias("n_separators"),
        F.md5(F.array_join("toks", "\n")).alias("tokens_md5"),
        (F.array_join("toks", "") == F.col("line")).alias("lossless"),
    )


@query
def tok1_rebuild(spark, sf):
    tokens_of = vocabulary.token_rows(log_lines(spark, sf))
    return vocabulary.rebuild(tokens_of, "line_id")


@query
def tok2_customer(spark, sf):
    """Names with bad bytes appended: repaired to one replacement character."""
    broken = table(spark, sf, "customer").select(
        "c_custkey", F.expr("CAST(concat(CAST(c_name AS BINARY), X'FFFE', CAST('_End' AS BINARY)) AS STRING)").alias("line")
    )
    return evaluate.utf8_repairs(broken, "c_custkey")


@query
def tok3_logs(spark, sf):
    return log_words(spark, sf).select("token", "n", F.expr(tokens.unquote("token")).alias("unquoted"))


@query
def tok4_logs(spark, sf):
    return log_words(spark, sf).select("token", F.expr(f"lower({tokens.clean('token')})").alias("clean_lower"))


@query
def tok5_logs(spark, sf):
    """Tokens inside quoted tokens, level by level."""
    return vocabulary.nested_tokens(log_lines(spark, sf)).groupBy("level", "token").agg(F.count("*").alias("n"))


# --- scores -----------------------------------------------------------------------


@query
def sco1_documents(spark, sf):
    return words(spark, sf).select("token", "n", F.expr(f"round({scores.entropy('token')}, 6)").alias("entropy"))


@query
def sco2_documents(spark, sf):
    return words(spark, sf).select("token", F.expr(scores.class_bonus("token")).alias("bonus"))


@query
def sco3_documents(spark, sf):
    return words(spark, sf).select("token", F.expr(scores.bigram_adjustment("token", OPTIONS)).alias("bigram"))


@query
def sco4_documents(spark, sf):
    return vocabulary.bigram_counts(words(spark, sf), OPTIONS)


@query
def sco5_documents(spark, sf):
    """Which part of the bigram table the documents use."""
    found = vocabulary.bigram_counts(words(spark, sf), OPTIONS).where("listed")
    return found.groupBy("logp").agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n"))


@query
def sco6_documents(spark, sf):
    rated = vocabulary.with_scores(words(spark, sf), OPTIONS)
    return rated.select("token", "n", F.round("score", 6).alias("score"))


@query
def sco7_documents(spark, sf):
    vocab = vocabulary.vocabulary(doc_lines(spark, sf).select("source", "line"), "line", "source")
    rated = vocabulary.with_scores(vocab, OPTIONS).withColumn("score", F.round("score", 9))
    return rated.withColumn("band", vocabulary.band(F.col("score"))).groupBy("source", "band").agg(
        F.count("*").alias("n_distinct"), F.sum("n").alias("n")
    )


# --- safe shapes ------------------------------------------------------------------


def shape_source(spark, sf):
    """Tokens and pair values of the log lines, and the page URLs."""
    parts = log_words(spark, sf).withColumn("colon", F.expr(pairs.colon_at("token")))
    both = parts.select(
        F.explode(F.expr(f"array_distinct(array_compact(array(token, {pairs.pair_value('token', 'colon')})))")).alias("token"), "n"
    )
    pages = table(spark, sf, "pages").select(F.col("url").alias("token"), F.lit(1).cast("bigint").alias("n"))
    return both.unionByName(pages).groupBy("token").agg(F.sum("n").alias("n"))


@query
def safe_all(spark, sf):
    return vocabulary.with_shape(shape_source(spark, sf)).groupBy("shape").agg(
        F.count("*").alias("n_distinct"), F.sum("n").alias("n")
    )


SHAPE_NAMES = ("scheme", "uuid", "ipv6", "unix_time", "iso_date", "registry", "path", "git_hash", "object_id", "ssh", "user_name")


def _shape_query(number: int, shape: str) -> None:
    def run(spark, sf):
        return vocabulary.shape_members(shape_source(spark, sf), shape)

    run.__name__ = f"safe{number}_{shape}"
    query(run)


for _number, _shape in enumerate(SHAPE_NAMES, 1):
    _shape_query(_number, _shape)


@query
def safe_candidates(spark, sf):
    """Log tokens without a safe shape that score above the threshold."""
    rated = vocabulary.with_scores(vocabulary.with_shape(log_words(spark, sf)).where("shape IS NULL"), OPTIONS)
    return rated.where(f"score > {OPTIONS.entropy_threshold + scores.GUARD}D").select("token", "n")


def brand_words(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("token"))
    kinds = table(spark, sf, "part").select(F.col("p_type").alias("token"))
    priorities = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("token"))
    segments = table(spark, sf, "customer").select(F.col("c_name").alias("token"))
    return brands.unionAll(kinds).unionAll(priorities).unionAll(segments).groupBy("token").agg(F.count("*").alias("n"))


@query
def safe12_part(spark, sf):
    return vocabulary.allowed(brand_words(spark, sf), RULES)


@query
def rul1_part(spark, sf):
    return vocabulary.with_rule(brand_words(spark, sf), RULES).select("token", "n", "rule")


@query
def rul2_logs(spark, sf):
    return vocabulary.with_rule(log_words(spark, sf), RULES)


@query
def rul3_part(spark, sf):
    """Brands against the rule list of their part type, both as tables."""
    words_of = table(spark, sf, "part").groupBy("p_type", F.col("p_brand").alias("token")).agg(F.count("*").alias("n"))
    return ruletable.match_rules(words_of, src4_part(spark, sf).where("ord % 2 = 0"), "p_type")


@query
def rul3_safe(spark, sf):
    """Words that some type's rule list would let through."""
    lists = src4_part(spark, sf).where("name LIKE '%1%'").withColumn("kind", F.lit("safe"))
    return ruletable.allowed_by(brand_words(spark, sf), lists)


@query
def rul3_customers(spark, sf):
    """Lines redacted by rules that a table holds as JSON: some nations are hidden under their number, others may stay."""
    nations = table(spark, sf, "nation").withColumn("kind", F.when(F.col("n_nationkey") % 3 == 0, "safe").otherwise("custom"))
    rule = F.struct(F.concat(F.lit("^"), F.col("n_name"), F.lit("$")).alias("pattern"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("name"))
    listed = nations.groupBy("kind").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", rule.alias("r")))), lambda x: x["r"])).alias("rules"))
    rows = vocabulary.rule_table(listed, "rules", None)
    options = ruletable.options_with_rules(rows, OPTIONS.with_(entropy_threshold=2.0))
    people = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    said = people.select("c_custkey", F.concat(F.lit("row "), F.col("c_custkey"), F.lit(" of "), F.col("n_name")).alias("line"))
    return redaction.redact_lines(said, options).drop("line")


# --- keys and pairs ---------------------------------------------------------------


@query
def key1_logs(spark, sf):
    """Sensitive keys and how often they occur."""
    parts = vocabulary.with_key_parts(log_words(spark, sf), OPTIONS).where("sensitive")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


@query
def key2_logs(spark, sf):
    """Long keys the randomness guard judged."""
    parts = vocabulary.with_key_parts(log_words(spark, sf), OPTIONS)
    long_keys = parts.where(f"octet_length(key) > {fixed.LONG_KEY_LENGTH}")
    return long_keys.where(F.expr(keys.holds_fragment("lower(key)", OPTIONS))).groupBy("key", "sensitive").agg(F.sum("n").alias("n"))


@query
def key3_logs(spark, sf):
    """Keys that only the key patterns make sensitive, in log lines that name user and context."""
    traced = log_lines(spark, sf).selectExpr(f"{derived.TRACED_SQL} AS line")
    parts = vocabulary.with_key_parts(vocabulary.vocabulary(traced), PATTERNS).where("sensitive")
    return parts.where(~F.expr(keys.holds_fragment("lower(key)", OPTIONS))).groupBy("key").agg(F.sum("n").alias("n"))


@query
def key4_logs(spark, sf):
    """Context words per source."""
    return vocabulary.context_words(log_lines(spark, sf)).groupBy("source", "word").agg(F.count("*").alias("n"))


@query
def par1_logs(spark, sf):
    parts = vocabulary.with_key_parts(log_words(spark, sf), OPTIONS).where("form = 'equal'")
    return parts.select("token", "n", "key", "value")


@query
def par2_logs(spark, sf):
    parts = vocabulary.with_key_parts(log_words(spark, sf), OPTIONS).where("form IN ('colon', 'image')")
    return parts.select("token", "form", "key", "value")


def log_state(spark, sf):
    return state.token_state(log_lines(spark, sf).select("line_id", "line"), OPTIONS)


def log_segments(spark, sf):
    return state.segment_state(log_lines(spark, sf).select("line_id", "line"), OPTIONS)


@query
def par3_logs(spark, sf):
    return state.windowed_pairs(log_state(spark, sf)).select("line_id", "seg", "token")


@query
def par4_logs(spark, sf):
    return state.generic_pairs(log_state(spark, sf)).select("line_id", "seg", "token")


def _state_query(number: int, flag: str) -> None:
    def run(spark, sf):
        return state.flag_strings(log_segments(spark, sf), flag)

    run.__name__ = f"st{number}_{flag}"
    query(run)


for _number, _flag in enumerate(("in_value", "context", "forced"), 1):
    _state_query(_number, _flag)


@query
def st4_generic(spark, sf):
    """Key tokens that carry a generic name."""
    keys_only = log_state(spark, sf).where("sensitive").withColumn("clean", F.expr(f"lower({tokens.clean('token')})"))
    return keys_only.where(F.col("clean").isin(*fixed.GENERIC_KEY_NAMES)).select("line_id", "seg", "clean")


_state_query(5, "raised")


@query
def st_conversations(spark, sf):
    """All flags of every line that a conversation holds, with a login put behind it."""
    turns = table(spark, sf, "conversations").where("text IS NOT NULL")
    said = lines.split_documents(turns.withColumn("text", F.concat("text", F.expr("concat('\n', role, ' password: ', left(md5(text), 9), ' card 4012888888881881 key=', turn)"))), "conv_id", "text", "turn")
    found = state.segment_state(said, OPTIONS)
    flagged = state.flag_strings(found, "in_value", "context", "forced", "raised")
    return flagged.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_segments"), *(F.sum(F.length(f) - F.length(F.replace(F.col(f), F.lit("1"), F.lit("")))).alias(f) for f in ("in_value", "context", "forced", "raised"))
    )


# --- URLs and cards -------------------------------------------------------------


def tracked_urls(spark, sf):
    """Page URLs, with a session parameter added so that there is something to mask."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    tail = F.concat(F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("sid="), F.substring(F.sha2("url", 256), 1, 32), F.lit("&auth="), F.col("page_id"))
    return pages.select("page_id", F.concat("url", tail).alias("url"))


@query
def url1_pages(spark, sf):
    return urls.parameters(tracked_urls(spark, sf), "url", OPTIONS)


@query
def url1_masked(spark, sf):
    return urls.masked(tracked_urls(spark, sf), "url", OPTIONS).drop("url")


@query
def url2_logs(spark, sf):
    return log_words(spark, sf).where(F.expr(pairs.is_url_like("token")))


def card_lines(spark, sf):
    docs = doc_lines(spark, sf).select("line_id", "line")
    logs = log_lines(spark, sf).select((-1 - F.col("line_id")).alias("line_id"), "line")
    return docs.unionByName(logs)


@query
def luh1_lines(spark, sf):
    return numbers.candidates(card_lines(spark, sf)).select("line_id", "start", "stop")


@query
def luh2_lines(spark, sf):
    return numbers.candidates(card_lines(spark, sf)).groupBy(F.length("digits").alias("n_digits")).agg(F.count("*").alias("n"))


@query
def luh3_lines(spark, sf):
    return numbers.varied(numbers.candidates(card_lines(spark, sf))).select("line_id", "start", "stop", "n_distinct")


@query
def luh4_lines(spark, sf):
    return numbers.valid(numbers.candidates(card_lines(spark, sf))).select("line_id", "start", "stop", "digits")


@query
def luh5_lines(spark, sf):
    return numbers.merged(card_lines(spark, sf))


# --- redaction ------------------------------------------------------------------


@query
def red1_documents(spark, sf):
    return redaction.find(doc_lines(spark, sf).select("source", "line_id", "line"), OPTIONS).drop("rule")


@query
def red1_logs(spark, sf):
    return redaction.find(log_lines(spark, sf), OPTIONS).drop("rule", "pos")


@query
def red2_customer(spark, sf):
    """Orders and customers pseudonymised on both sides, joined on the placeholder's full key."""
    people = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    hidden = redaction.pseudonymise(people, "c_name", OPTIONS, "name_mark")
    return hidden.drop("c_name")


@query
def red3_logs(spark, sf):
    """Rows whose placeholder had to be quoted."""
    done = redaction.redact_lines(log_lines(spark, sf), OPTIONS)
    return done.where(F.col("redacted").contains('"[HIDDEN')).select("line_id", "redacted")


@query
def red4_documents(spark, sf):
    return redaction.redact_lines(doc_lines(spark, sf).select("line_id", "line"), OPTIONS).drop("line")


@query
def red4_logs(spark, sf):
    return redaction.redact_lines(log_lines(spark, sf), OPTIONS).select("line_id", "redacted")


@query
def red4_texts(spark, sf):
    """Whole documents redacted in place."""
    done = redaction.redact_documents(table(spark, sf, "documents").select("doc_id", "text"), OPTIONS)
    return done.select("doc_id", F.md5("redacted").alias("redacted_md5"))


@query
def red4_rules(spark, sf):
    """With user rules and an allow list."""
    done = redaction.redact_lines(log_lines(spark, sf), RULES)
    return done.select("line_id", "redacted")


def conversation_view(spark, sf):
    """The conversations as a view, with a login and a card put behind each text, and the functions of SQL."""
    sqlfunctions.register(spark, OPTIONS)
    turns = table(spark, sf, "conversations")
    tail = "concat(text, ' password: ', left(md5(text), 9), ' card 4012888888881881 ', left(upper(md5(text)), 4), substr(md5(text), 9, 12))"
    turns.withColumn("text", F.expr(tail)).createOrReplaceTempView("said")


@query
def fn1_conversations(spark, sf):
    """Plain SQL: redaction, scores and card finder as functions."""
    conversation_view(spark, sf)
    return spark.sql("""
        SELECT conv_id, turn, hush_redact(text) AS redacted, size(hush_cards(text)) AS n_cards, hush_mark(role) AS role_mark,
               round(hush_complexity(text), 6) AS complexity, hush_bigram(text) AS bigram
        FROM said WHERE text IS NOT NULL""")


@query
def fn2_conversations(spark, sf):
    """Plain SQL: what is hidden, by role and kind."""
    conversation_view(spark, sf)
    return spark.sql("""
        SELECT role, f.kind, count(*) AS n, count(DISTINCT f.mark) AS n_marks
        FROM (SELECT role, hush_findings(text) AS found FROM said WHERE text IS NOT NULL) LATERAL VIEW explode(found) t AS f
        GROUP BY role, f.kind""")


@query
def red5_stream(spark, sf):
    folder = work_folder(spark, "red5")
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    unbounded = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet")
    rows = lines.split_documents(unbounded, "doc_id", "text").withColumn("line_id", F.expr("doc_id * 4294967296 + line_no"))
    done = stream.redact_stream(rows.select("line_id", "line"), OPTIONS).drop("line")
    stream.write_stream(done, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query
def red6_logs(spark, sf):
    return redaction.correlate(redaction.find(log_lines(spark, sf), OPTIONS))


@query
def red7_orders(spark, sf):
    keyed = table(spark, sf, "lineitem").select(
        F.expr("concat_ws('-', l_orderkey, l_linenumber)").alias("secret")
    )
    return redaction.hash_collisions(redaction.pseudonymise(keyed, "secret", OPTIONS, "mark"), "secret", "mark")


# --- JSON -----------------------------------------------------------------------


def order_json(spark, sf):
    """The JSON log lines."""
    return log_lines(spark, sf).where("startswith(line, '{')").select("line_id", "line")


def tagged_events(spark, sf):
    """Event properties inside an object that names the user, as a tracker sends them."""
    login = "concat('{\"event\":\"', event_type, '\", \"user\": {\"id\": ', user_id, ', \"session_token\": \"', sha2(CAST(event_id AS STRING), 256), '\"}, \"props\" : ', props, '}')"
    return table(spark, sf, "events").selectExpr("event_id", f"{login} AS props")


@query
def jsn1_events(spark, sf):
    return jsonleaf.leaves(table(spark, sf, "events").select("event_id", "props"), "props").drop("parent", "name", "steps")


@query
def jsn1_logs(spark, sf):
    return jsonleaf.leaves(order_json(spark, sf), "line").drop("parent", "name", "steps")


@query
def jsn1_steps(spark, sf):
    """How often each path occurs, paths as arrays of steps."""
    found = jsonleaf.leaves(order_json(spark, sf), "line")
    return found.groupBy(F.to_json("steps").alias("steps"), "type").agg(F.count("*").alias("n"))


@query
def jsn1_encoded(spark, sf):
    """All log lines: JSON objects redacted in place, other lines scanned as lines."""
    done = jsonleaf.redact_json(log_lines(spark, sf), "line", OPTIONS, "encoded")
    return jsonleaf.with_parses(done.select("line_id", "encoded"), "encoded")


@query
def jsn1_events_encoded(spark, sf):
    """Event properties, with the user and a login added to them, redacted in place."""
    return jsonleaf.redact_json(tagged_events(spark, sf), "props", OPTIONS, "encoded").drop("props")


@query
def jsn2_logs(spark, sf):
    """Leaves of objects, masked."""
    return jsonleaf.redact_leaves(order_json(spark, sf), "line", OPTIONS).where("name IS NOT NULL").select("line_id", "path", "type", "masked")


@query
def jsn3_logs(spark, sf):
    """Array cells, masked."""
    return jsonleaf.redact_leaves(order_json(spark, sf), "line", OPTIONS).where("name IS NULL").select("line_id", "path", "type", "masked")


@query
def jsn4_logs(spark, sf):
    return jsonleaf.generic_pairs(order_json(spark, sf), "line", OPTIONS)


@query
def jsn5_customer(spark, sf):
    """Typed nested columns."""
    nested = table(spark, sf, "customer").select(
        "c_custkey",
        F.expr(
            "named_struct('user', c_name, 'api_key', sha2(c_name, 256), 'cvv', c_custkey,"
            " 'pair', named_struct('key', 'password', 'value', c_mktsegment), 'tags', array(c_mktsegment, substr(sha2(c_name, 256), 1, 30)), 'balance', c_acctbal)"
        ).alias("doc"),
    )
    return jsonleaf.redact_struct(nested, "doc", OPTIONS).select(
        "c_custkey", F.col("doc.user").alias("user"), F.col("doc.api_key").alias("api_key"), F.col("doc.cvv").alias("cvv"),
        F.col("doc.pair.key").alias("pair_key"), F.col("doc.pair.value").alias("pair_value"),
        F.array_join("doc.tags", "|").alias("tags"), F.col("doc.balance").alias("balance"),
    )


# --- baseline, evaluation -------------------------------------------------------


def source_lines(spark, sf):
    return doc_lines(spark, sf).select("source", "line_id", "line")


@query
def bas1_documents(spark, sf):
    return baseline.samples(source_lines(spark, sf), OPTIONS).select("source", "rank", "line_id", F.round("score", 6).alias("score"))


@query
def bas2_documents(spark, sf):
    limits = baseline.thresholds(baseline.samples(source_lines(spark, sf), OPTIONS), OPTIONS)
    return limits.where("ready").select("source", F.round("threshold", 6).alias("threshold"))


@query
def bas3_documents(spark, sf):
    rows = source_lines(spark, sf)
    limits = baseline.thresholds(baseline.samples(rows, OPTIONS), OPTIONS)
    return baseline.redact_adaptive(rows, limits, OPTIONS).select("line_id", "redacted")


@query
def bas4_documents(spark, sf):
    limits = baseline.thresholds(baseline.samples(source_lines(spark, sf), OPTIONS), OPTIONS)
    return limits.select("source", "n", "ready")


@query
def bas5_stream(spark, sf):
    """Three batches, every third document in each: what a batch has learnt holds in the next."""
    folder = work_folder(spark, "bas5")
    rows = source_lines(spark, sf).withColumn("part", F.expr("line_id DIV 4294967296 % 3"))
    for part in range(3):  # the stream goes on with the files that have come since it stopped, all in one batch
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
        unbounded = spark.readStream.schema(rows.drop("part").schema).parquet(f"{folder}/in")
        stream.adaptive_stream(unbounded, OPTIONS, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/redacted").select("line_id", "redacted", "batch")


def labelled(spark, sf):
    return redaction.redact_lines(order_logs(spark, sf), OPTIONS)


@query
def evl1_logs(spark, sf):
    return evaluate.confusion(labelled(spark, sf), "source")


@query
def evl2_logs(spark, sf):
    """Leaks and false positives of a run whose limit is too high."""
    done = redaction.redact_lines(order_logs(spark, sf), OPTIONS.with_(entropy_threshold=HIGH_LIMIT))
    return evaluate.mistakes(done).select("line_id", "mistake")


@query
def evl3_documents(spark, sf):
    """A run with a lower limit against a stored golden table of the usual one: every line that differs."""
    folder = work_folder(spark, "evl3")
    rows = doc_lines(spark, sf).select("line_id", "line")
    redaction.redact_lines(rows, OPTIONS, out="expected").drop("line").write.parquet(f"{folder}/golden")
    actual = redaction.redact_lines(rows, OPTIONS.with_(entropy_threshold=LOW_LIMIT)).drop("line")
    return evaluate.golden_mismatches(actual, spark.read.parquet(f"{folder}/golden"), "line_id")


@query
def evl4_logs(spark, sf):
    return evaluate.json_breaks(labelled(spark, sf), "source")


@query
def evl5_documents(spark, sf):
    return evaluate.output_properties(redaction.redact_lines(source_lines(spark, sf), OPTIONS), "source")


@query
def evl6_documents(spark, sf):
    """Lines and bytes in and out of a redacting run, per source."""
    return evaluate.volume(redaction.redact_lines(source_lines(spark, sf), OPTIONS), "source")


@query
def rpt1_documents(spark, sf):
    return redaction.report(redaction.find(source_lines(spark, sf), OPTIONS))


@query
def flagship_documents(spark, sf):
    return flagship(spark, sf)


__all__ = ["QUERIES", "OPTIONS", "flagship", "pseudonym"]
