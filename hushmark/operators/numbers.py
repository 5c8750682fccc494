"""Card numbers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cards
from ..functions.sqltext import let


def candidates(lines: DataFrame, column: str = "line") -> DataFrame:
    """Every free-standing 13–19 digit window: ``start, stop, digits`` (stop exclusive).

    Lines without a long digit run are dropped before anything is expanded.
    """
    others = [c for c in lines.columns if c != column]
    hit = lines.where(F.expr(cards.may_hold_card(column)))
    runs = hit.select(*others, F.explode(F.expr(cards.runs(column))).alias("g"))
    windows = runs.select(*others, F.explode(F.expr(cards.candidates("g"))).alias("w"))
    return windows.select(*others, "w.start", "w.stop", "w.digits")


def varied(found: DataFrame) -> DataFrame:
    """Enough different digits."""
    return found.withColumn("n_distinct", F.expr(cards.distinct_digits("digits"))).where(f"n_distinct >= {cards.fixed.CARD_MIN_DISTINCT}")


def valid(found: DataFrame) -> DataFrame:
    """Checksum holds."""
    return varied(found).where("luhn_check(digits)")


def merged(lines: DataFrame, column: str = "line") -> DataFrame:
    """Final card ranges of each line."""
    others = [c for c in lines.columns if c != column]
    hit = lines.where(F.expr(cards.may_hold_card(column)))
    found = let(
        cards.chunks(column),
        lambda ch: f"transform({cards.card_ranges(column)}, r -> named_struct('start', r.start, 'stop', r.stop, 'card', {cards.cut(ch, 'r.start', 'r.stop')}))",
    )
    return hit.select(*others, F.explode(F.expr(found)).alias("r")).select(*others, "r.start", "r.stop", "r.card")
