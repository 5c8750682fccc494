"""Redaction, findings and what is reported about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pseudonym
from ..functions.rules import validate_rules
from ..functions.sqltext import fresh
from ..options import Options
from ..plans import scan


def once(keyed: DataFrame, kept: list[str], body: str, out: str) -> DataFrame:
    """``kept`` columns and ``out``, worked out once a row.

    The value comes out of a generator. A filter on it stays above, where the optimiser would else move
    copies of the whole expression into the filter and into the join with the key.
    """
    return keyed.select(*(F.col(f"`{c}`") for c in kept if c != out), F.explode(F.array(F.expr(body))).alias(out))


def redact_lines(lines: DataFrame, options: Options, column: str = "line", out: str = "redacted") -> DataFrame:
    """Add the redacted form of a text column. Map-only, batch or streaming. A pattern that does not compile raises here."""
    validate_rules(lines.sparkSession, options)
    return once(pseudonym.with_key(lines, options), lines.columns, scan.redact(column, options), out)


def redact_documents(docs: DataFrame, options: Options, column: str = "text", out: str = "redacted") -> DataFrame:
    """Redact every line of a multi-line column in place: no explode, no regrouping."""
    validate_rules(docs.sparkSession, options)
    ln = fresh("ln")
    body = f"array_join(transform(split({column}, '\\n'), {ln} -> {scan.redact(ln, options)}), '\\n')"
    return once(pseudonym.with_key(docs, options), docs.columns, body, out)


def find(lines: DataFrame, options: Options, column: str = "line", keep_secret: bool = False) -> DataFrame:
    """Findings: one row per hidden stretch, with all other columns of the line.

    ``mark`` is the placeholder. The secret itself is kept on request only.
    """
    validate_rules(lines.sparkSession, options)
    others = [c for c in lines.columns if c != column]
    keyed = pseudonym.with_key(lines, options)
    rows = keyed.select(*others, F.explode(F.expr(scan.findings(column, options))).alias("f"))
    fields = ["pos", "kind", "rule", "mark"] + (["secret"] if keep_secret else [])
    return rows.select(*others, *[F.col(f"f.{c}").alias(c) for c in fields])


def pseudonymise(df: DataFrame, column: str, options: Options, out: str | None = None) -> DataFrame:
    """Replace a column by its keyed hash placeholder (equal values stay equal)."""
    keyed = pseudonym.with_key(df, options)
    return pseudonym.without_key(keyed.withColumn(out or column, F.expr(pseudonym.placeholder(column))))


def correlate(findings: DataFrame) -> DataFrame:
    """Where the same secret shows up: per placeholder, how often and in which sources.

    Two steps: counts per (mark, source) first, so a mark that fills a third of
    all rows is already small when it is brought together.
    """
    per_source = findings.groupBy("mark", "source").agg(
        F.count("*").alias("n"), F.min("line_id").alias("first_line"), F.max("line_id").alias("last_line")
    )
    return per_source.groupBy("mark").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_sources"),
        F.min("first_line").alias("first_line"),
        F.max("last_line").alias("last_line"),
    )


def hash_collisions(secrets: DataFrame, secret: str, mark: str) -> DataFrame:
    """Placeholders shared by different secrets (24 bits do collide). Restricted use."""
    distinct = secrets.select(mark, secret).distinct()
    return distinct.groupBy(mark).agg(F.count("*").alias("n_secrets")).where("n_secrets > 1")


def report(findings: DataFrame) -> DataFrame:
    """Findings by source and kind with subtotals."""
    return (
        findings.rollup("source", "kind")
        .agg(F.count("*").alias("n"))
        .select(F.coalesce("source", F.lit("(all)")).alias("source"), F.coalesce("kind", F.lit("(all)")).alias("kind"), "n")
    )
