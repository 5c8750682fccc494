"""Jobs over the token vocabulary: each distinct token is judged once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import keys, pairs, rules, scores, shapes, tokens
from ..functions.sqltext import let
from ..options import Options


def token_rows(lines: DataFrame, column: str = "line") -> DataFrame:
    """Flat token table: all other columns, ``pos``, ``token``, ``is_sep``."""
    others = [c for c in lines.columns if c != column]
    repaired = lines.withColumn(column, F.expr(tokens.repair(column)))
    rows = repaired.select(*others, F.posexplode(F.expr(tokens.tokens(column))).alias("pos", "token"))
    return rows.withColumn("is_sep", F.expr(tokens.is_separator("token")))


def rebuild(token_table: DataFrame, *line_key: str) -> DataFrame:
    """Token table → lines. Groups are single lines."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return token_table.groupBy(*line_key).agg(
        F.array_join(F.transform(ordered, lambda x: x["token"]), "").alias("line")
    )


def vocabulary(lines: DataFrame, column: str = "line", *by: str) -> DataFrame:
    """Distinct tokens and how often they occur. Counted on the map side first,
    so common words and separators do not pile up."""
    words = lines.select(*by, F.explode(F.expr(tokens.tokens(column))).alias("token"))
    words = words.where(~F.expr(tokens.is_separator("token")))
    return words.groupBy(*by, "token").agg(F.count("*").alias("n"))


def with_scores(vocab: DataFrame, options: Options, token: str = "token") -> DataFrame:
    return vocab.withColumns(
        {
            "entropy": F.expr(scores.entropy(token)),
            "bonus": F.expr(scores.class_bonus(token)),
            "bigram": F.expr(scores.bigram_adjustment(token, options)),
        }
    ).withColumn("score", F.col("entropy") + F.col("bonus") + F.col("bigram"))


def band(score: Column) -> Column:
    """Sensitivity band of a score, 0 the lowest."""
    out = F.lit(len(fixed.SENSITIVITY_BANDS))
    for i, upper in reversed(list(enumerate(fixed.SENSITIVITY_BANDS))):
        out = F.when(score < upper, i).otherwise(out)
    return out


def with_shape(vocab: DataFrame, token: str = "token") -> DataFrame:
    """First safe shape of each token, NULL for the others."""
    return vocab.withColumn("shape", F.expr(shapes.first_shape(token)))


def shape_members(vocab: DataFrame, shape: str, token: str = "token") -> DataFrame:
    return vocab.where(F.expr(shapes.shape_flags(token)[shape]))


def allowed(vocab: DataFrame, options: Options, token: str = "token") -> DataFrame:
    """Tokens a user allow-list lets through."""
    return vocab.where(F.expr(shapes.matches_safe_rule(token, options)))


def with_rule(vocab: DataFrame, options: Options, token: str = "token") -> DataFrame:
    """Tokens hit by a user rule with the rule that decides."""
    hit = vocab.withColumn("hit", F.expr(rules.rule_hit(token, options))).where("hit IS NOT NULL")
    return hit.select(*vocab.columns, F.col("hit.pos").alias("rule_pos"), F.col("hit.ord").alias("rule_ord"), F.col("hit.name").alias("rule"))


def rule_table(df: DataFrame, json_column: str, kind: str | None) -> DataFrame:
    """JSON rule lists → rows ``kind, ord, pattern, name``; list order is kept. Without ``kind`` the table has it as a column."""
    parsed = F.from_json(json_column, "ARRAY<STRUCT<pattern: STRING, name: STRING>>", {"mode": "FAILFAST"})
    others = [c for c in df.columns if c != json_column]
    rows = df.select(*others, F.posexplode(parsed).alias("ord", "r"))
    named = [F.lit(kind).alias("kind")] if kind else []
    return rows.select(*others, *named, "ord", F.col("r.pattern").alias("pattern"), F.col("r.name").alias("name"))


def with_key_parts(vocab: DataFrame, options: Options, token: str = "token") -> DataFrame:
    """Pair form, key, value and key sensitivity of each distinct token."""
    at = vocab.withColumn("colon_at", F.expr(pairs.colon_at(token)))
    split = at.withColumns(
        {
            "form": F.expr(f"CASE WHEN {pairs.is_url_like(token)} THEN 'url' ELSE {pairs.pair_form(token, 'colon_at')} END"),
            "key": F.expr(f"CASE WHEN NOT {pairs.is_url_like(token)} THEN {pairs.pair_key(token, 'colon_at')} END"),
            "value": F.expr(f"CASE WHEN NOT {pairs.is_url_like(token)} THEN {pairs.pair_value(token, 'colon_at')} END"),
        }
    ).drop("colon_at")
    return split.withColumn("sensitive", F.expr(f"coalesce({keys.is_sensitive_key('key', options)}, false)"))


def nested_tokens(lines: DataFrame, column: str = "line") -> DataFrame:
    """Tokens of every line and, level by level, of the quoted tokens inside:
    all other columns, ``level`` (0 the line itself), ``token``.

    A level takes a pair of quote marks off a token, so no token of the line has more levels than half its own
    marks: the token with most bounds the rounds, however many quoted tokens a long line holds.
    """
    others = [c for c in lines.columns if c != column]
    inner = f"transform({tokens.tokens(tokens.unquote('x.token'))}, u -> named_struct('level', x.level + 1, 'token', u, 'open', {tokens.is_quoted('u')}))"
    opened = (
        f"CASE WHEN x.open THEN concat(array(named_struct('level', x.level, 'token', x.token, 'open', false)), {inner}) ELSE array(x) END"
    )
    first = f"transform({tokens.tokens(column)}, u -> named_struct('level', 0, 'token', u, 'open', {tokens.is_quoted('u')}))"
    marks = "(octet_length(y.token) - octet_length(translate(y.token, '\"\\'', '')))"
    every = let(
        first,
        lambda top: f"aggregate(sequence(0, coalesce(array_max(transform({top}, y -> CASE WHEN y.open THEN {marks} DIV 2 ELSE 0 END)), 0)), {top},"
        f" (items, r) -> CASE WHEN exists(items, y -> y.open) THEN flatten(transform(items, x -> {opened})) ELSE items END)",
    )
    rows = lines.select(*others, F.explode(F.expr(every)).alias("t"))
    return rows.select(*others, "t.level", "t.token").where(~F.expr(tokens.is_separator("token")))


def bigram_counts(vocab: DataFrame, options: Options, token: str = "token") -> DataFrame:
    """How often each letter pair occurs, with its log-probability or the default.

    The pair table is fixed and small: it is joined by broadcast.
    """
    spark = vocab.sparkSession
    table = spark.createDataFrame(list(fixed.BIGRAMS.items()), "bg STRING, known DOUBLE")
    low = f"lower({token})"
    pairs_of = f"transform(sequence(1, char_length({low}) - 1), i -> substring({low}, i, 2))"
    rows = vocab.where(f"char_length({low}) > 1").select(F.explode(F.expr(pairs_of)).alias("bg"), "n")
    counted = rows.groupBy("bg").agg(F.sum("n").alias("n"))
    joined = counted.join(F.broadcast(table), "bg", "left")
    return joined.select("bg", "n", F.coalesce("known", F.lit(options.bigram_default)).alias("logp"), F.col("known").isNotNull().alias("listed"))


def context_words(lines: DataFrame, column: str = "line") -> DataFrame:
    """Tokens that are context words, in place."""
    rows = token_rows(lines, column).where("NOT is_sep")
    return rows.withColumn("word", F.expr(f"lower({tokens.clean('token')})")).where(F.expr(keys.is_context_word("word")))
