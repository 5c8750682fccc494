"""Tokens with the line state they are judged under."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.sqltext import let
from ..options import Options
from ..plans import scan


def segment_state(lines: DataFrame, options: Options, column: str = "line") -> DataFrame:
    """``seg, toks``: one row per segment of a line, the stretches between card numbers.

    ``toks`` is an array of the segment's tokens with what the line state says of each: ``token, sensitive,
    forced, context, in_value, raised``. The state starts afresh in every segment, as a card says nothing about
    what follows it. Row-local: cards are cut out and the state folded inside one expression.
    """
    flag = lambda bit: f"((ascii(fl) - {scan._FIRST_FLAG}) & {bit}) <> 0"
    token = (
        f"named_struct('token', ft.t, 'sensitive', ft.k, 'forced', {flag(1)}, 'context', {flag(2)}, 'in_value', {flag(4)}, 'raised', {flag(8)})"
    )
    folded = let(
        scan.line_facts("x.c", str(scan.SEGMENT), options),
        lambda v: let(scan._facts(v, options), lambda fs: f"filter(zip_with({fs}, {scan._flags(fs, options)}, (ft, fl) -> {token}), y -> y.token <> '')"),
    )
    open_ = f"x -> x.m = {scan.SEGMENT} AND x.c <> ''"
    segments = f"transform(filter({scan._cut_cards(tokens.repair(column))}, {open_}), x -> {folded})"
    others = [c for c in lines.columns if c != column]
    return lines.select(*others, F.posexplode(F.expr(segments)).alias("seg", "toks"))


def flag_strings(state: DataFrame, *flags: str) -> DataFrame:
    """For each segment and flag a string of one 0 or 1 per token; nothing is taken apart and grouped again."""
    bits = {f: F.expr(f"array_join(transform(toks, y -> CASE WHEN y.{f} THEN '1' ELSE '0' END), '')") for f in flags}
    return state.withColumns(bits).drop("toks")


def token_state(lines: DataFrame, options: Options, column: str = "line") -> DataFrame:
    """One row per token: ``seg, pos, token, sensitive, forced, context, in_value, raised``."""
    state = segment_state(lines, options, column)
    others = [c for c in state.columns if c != "toks"]
    return state.select(*others, F.posexplode("toks").alias("pos", "y")).select(*others, "pos", "y.*")


def windowed_pairs(state: DataFrame) -> DataFrame:
    """``key = value`` and ``"key": value`` spread over tokens: values in value
    position that a sensitive key forces."""
    return state.where("forced AND in_value")


def generic_pairs(state: DataFrame) -> DataFrame:
    """Tokens under a raised flag: after ``"key": "password"`` the next key is sensitive."""
    return state.where("raised")
