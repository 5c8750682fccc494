"""User rules as a table: loaded, checked, and matched against distinct tokens by a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import rules as patterns
from ..functions.sqltext import lit
from ..options import Options, Rule
from ..sources.folders import written

BLOCK = 1024  # rules that are broadcast together
INLINE = 256  # rules that a redaction carries in its own expression


def check_rules(table: DataFrame) -> None:
    """Compile every pattern of a rule table in one job; a bad one raises, with what the compiler says of it."""
    tried = F.expr(f"concat({lit(patterns.DIALECT)}, pattern)")
    try:
        table.where("pattern IS NOT NULL").agg(F.count_if(F.regexp_like(F.lit("x"), tried))).collect()
    except Exception as err:
        raise ValueError(f"invalid rule pattern: {str(err).splitlines()[0]}") from err


def options_with_rules(table: DataFrame, options: Options) -> Options:
    """``options`` with the custom and safe rules of a rule table (``kind, ord, pattern, name``), in list order.

    The rules become part of the plan, so there may be ``INLINE`` of them; a longer table raises, as it is for ``match_rules``.
    """
    check_rules(table)
    found = table.where("pattern IS NOT NULL").select("kind", "ord", "pattern", F.coalesce("name", F.lit("")).alias("name")).limit(INLINE + 1).collect()
    if len(found) > INLINE:
        raise ValueError(f"more than {INLINE} rules: match them as a table")
    kinds = {k: tuple(Rule(r.pattern, r.name) for r in sorted(found, key=lambda r: r.ord) if r.kind == k) for k in ("custom", "safe")}
    return options.with_(custom_rules=options.custom_rules + kinds["custom"], safe_rules=options.safe_rules + kinds["safe"])


def match_rules(vocab: DataFrame, table: DataFrame, *by: str, token: str = "token") -> DataFrame:
    """Tokens hit by a rule of the table, with the rule that decides: ``rule_pos, rule_ord, rule``.

    ``vocab`` holds distinct tokens, so a rule meets each word once however often it occurs. The leftmost match
    decides, at the same place the earlier rule. ``by`` are columns of both sides that have to agree: a
    rule list then only sees the words of its group. Rules are dealt into blocks of ``BLOCK``; a block is broadcast and every token
    keeps its best hit of the block, so neither the size of the table nor the number of hits of a token is a limit.
    Patterns are checked before; null patterns match nothing.
    """
    check_rules(table)
    rules = table.where("pattern IS NOT NULL").select(*by, "ord", "pattern", F.coalesce("name", F.lit("")).alias("name"))
    rules = written(rules.withColumn("block", F.pmod(F.xxhash64(*by, "ord", "pattern"), F.lit(max(1, -(-rules.count() // BLOCK))))), "rules")
    words = vocab.where(F.octet_length(token) >= fixed.MIN_CUSTOM_RULE_LENGTH)
    place = F.expr(f"regexp_instr(w.`{token}`, concat({lit(patterns.DIALECT)}, r.pattern))")
    hits = None
    for (block,) in sorted(rules.select("block").distinct().collect()):
        few = F.broadcast(rules.where(F.col("block") == block).drop("block")).alias("r")
        same = [F.col(f"w.{c}") == F.col(f"r.{c}") for c in by]
        condition = place > 0
        for c in same:
            condition = condition & c
        best = F.min(F.struct(place.alias("pos"), F.col("r.ord").alias("ord"), F.col("r.name").alias("name"))).alias("hit")
        found = words.alias("w").join(few, condition).groupBy(*(F.col(f"w.{c}") for c in (*by, token))).agg(best)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = words.select(*by, token, F.lit(None).cast("struct<pos: int, ord: int, name: string>").alias("hit")).where("false")
    best = hits.groupBy(*by, token).agg(F.min("hit").alias("hit"))
    return vocab.join(best, [*by, token]).select(*vocab.columns, F.col("hit.pos").alias("rule_pos"), F.col("hit.ord").alias("rule_ord"), F.col("hit.name").alias("rule"))


def allowed_by(vocab: DataFrame, table: DataFrame, token: str = "token") -> DataFrame:
    """Tokens that a safe rule of the table lets through (tokens of three bytes or more, any match)."""
    check_rules(table)
    rules = written(table.where("pattern IS NOT NULL").select("pattern").distinct(), "rules")
    rules = rules.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(max(1, -(-rules.count() // BLOCK)))))
    words = vocab.where(F.octet_length(token) >= fixed.MIN_SAFE_RULE_LENGTH)
    hit = F.expr(f"`{token}` RLIKE concat({lit(patterns.DIALECT)}, pattern)")
    found = None
    for (block,) in sorted(rules.select("block").distinct().collect()):
        some = words.join(F.broadcast(rules.where(F.col("block") == block).drop("block")), hit, "left_semi")
        found = some if found is None else found.unionByName(some).distinct()
    return words.where("false") if found is None else found
