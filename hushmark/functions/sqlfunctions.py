"""The expressions as functions of SQL, for queries that are written in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..options import Options
from ..plans import scan
from . import cards, pseudonym, rules, scores, shapes, tokens
from .pseudonym import IPAD, OPAD

KEY_VIEW = "hush_key"


def register(spark: SparkSession, options: Options) -> tuple[str, ...]:
    """Create temporary functions for this session; the names. They are inlined where they are called: no Python, one plan.

    * ``hush_redact(line)``: the redacted line
    * ``hush_findings(line)``: array of ``pos, kind, rule, mark`` of what is hidden
    * ``hush_mark(secret)``: the placeholder of a secret
    * ``hush_complexity(token)``, ``hush_entropy(token)``, ``hush_bigram(token)``: the score and two of its parts
    * ``hush_cards(line)``: array of ``start, stop`` of card numbers (from 1, stop exclusive)
    * ``hush_shape(token)``: the first safe shape, or null
    * ``hush_tokens(line)``: array of tokens and separators

    The key comes from a one-row view, so neither a function's text nor a plan shows the salt. Null gives null.
    """
    rules.validate_rules(spark, options)
    pseudonym.key_table(spark, options).createOrReplaceTempView(KEY_VIEW)
    key = f"(SELECT first({IPAD}) FROM {KEY_VIEW}), (SELECT first({OPAD}) FROM {KEY_VIEW})"
    keyed = f"{IPAD} BINARY, {OPAD} BINARY"
    found = f"transform({scan.findings('line', options)}, f -> named_struct('pos', f.pos, 'kind', f.kind, 'rule', f.rule, 'mark', f.mark))"
    finding = "ARRAY<STRUCT<pos: INT, kind: STRING, rule: STRING, mark: STRING>>"
    functions = {
        "hush_redact_keyed": (f"line STRING, {keyed}", "STRING", f"CASE WHEN line IS NOT NULL THEN {scan.redact('line', options)} END"),
        "hush_redact": ("line STRING", "STRING", f"hush_redact_keyed(line, {key})"),
        "hush_findings_keyed": (f"line STRING, {keyed}", finding, f"CASE WHEN line IS NOT NULL THEN {found} END"),
        "hush_findings": ("line STRING", finding, f"hush_findings_keyed(line, {key})"),
        "hush_mark_keyed": (f"secret STRING, {keyed}", "STRING", pseudonym.placeholder("secret")),
        "hush_mark": ("secret STRING", "STRING", f"hush_mark_keyed(secret, {key})"),
        "hush_complexity": ("token STRING", "DOUBLE", scores.complexity("token", options)),
        "hush_entropy": ("token STRING", "DOUBLE", scores.entropy("token")),
        "hush_bigram": ("token STRING", "DOUBLE", scores.bigram_adjustment("token", options)),
        "hush_cards": ("line STRING", cards.RANGES, f"CASE WHEN line IS NOT NULL THEN {cards.card_ranges('line')} END"),
        "hush_shape": ("token STRING", "STRING", shapes.first_shape("token")),
        "hush_tokens": ("line STRING", "ARRAY<STRING>", tokens.tokens("line")),
    }
    for name, (given, kind, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")
    return tuple(n for n in functions if not n.endswith("_keyed"))
