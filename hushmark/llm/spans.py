"""Positions of regular-expression matches as Spark SQL expressions."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.sqltext import let, lit

SPAN = "STRUCT<start: INT, kind: INT, end: INT, score: DOUBLE>"
NONE = f"CAST(array() AS ARRAY<{SPAN}>)"
_STRIDE = 128


def _starts(lengths: str) -> str:
    """Sum of all lengths before each element, in strides so that long lists stay near linear."""
    add = "(s, x) -> s + x"
    strides = f"transform(sequence(0, size({lengths}) DIV {_STRIDE}), q -> aggregate(slice({lengths}, q * {_STRIDE} + 1, {_STRIDE}), 0, {add}))"
    totals = let(strides, lambda t: f"transform({t}, (x, q) -> aggregate(slice({t}, 1, q), 0, {add}))")
    return let(totals, lambda t: (
        f"transform({lengths}, (x, i) -> {t}[i DIV {_STRIDE}] +"
        f" aggregate(slice({lengths}, (i DIV {_STRIDE}) * {_STRIDE} + 1, i % {_STRIDE}), 0, {add}))"
    ))


def found(text: str, pattern: str, kind: int, score: Callable[[str, str, str], str], group: int = 0) -> str:
    """ARRAY of spans of the leftmost non-overlapping matches that get a score.

    The pieces between matches and the matches themselves alternate, so their lengths
    add up to code-point positions. ``score(match or group, before, after)`` is the
    score of a match between two such pieces; a match scored NULL is dropped.
    """
    pat = lit(pattern)
    whole = f"regexp_extract_all({text}, {pat}, 0)"
    part = f"regexp_extract_all({text}, {pat}, {group})" if group else None

    def spans(m: str, v: str) -> str:
        def placed(g: str) -> str:
            lengths = f"zip_with(slice({g}, 1, size({m})), {m}, (a, b) -> length(a) + length(b))"
            item = let(
                score(f"{v}[i]", f"{g}[i]", f"{g}[i + 1]"),
                lambda sc: f"named_struct('start', b + length({g}[i]), 'kind', {kind}, 'end', b + length({g}[i]) + length({m}[i]), 'score', CAST({sc} AS DOUBLE))",
            )
            return f"filter(transform({let(lengths, _starts)}, (b, i) -> {item}), p -> p.score IS NOT NULL)"

        return let(f"split({text}, {pat}, -1)", placed)

    def values(m: str) -> str:
        body = let(part, lambda v: spans(m, v)) if part else spans(m, m)
        return f"CASE WHEN size({m}) = 0 THEN {NONE} ELSE {body} END"

    return let(whole, values)


def listed(spans: str, names: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind, then end, comma-joined."""
    kinds = "array(" + ", ".join(map(lit, names)) + ")"
    return f"array_join(transform(array_sort({spans}), p -> concat({kinds}[p.kind], ':', p.start, ':', p.end)), ',')"


def counted(spans: str, kind: int) -> str:
    return f"CAST(size(filter({spans}, p -> p.kind = {kind})) AS BIGINT)"


def replaced(text: str, pattern: str, swap: Callable[[str, str], str], group: int = 0) -> str:
    """``text`` with every match ``m`` (its group ``v``) replaced by ``swap(m, v)``; NULL keeps it."""
    pat = lit(pattern)
    each = lambda m, v: f"zip_with({m}, {v}, (m, v) -> coalesce({swap('m', 'v')}, m))"
    joined = lambda m, v: (
        f"array_join(flatten(zip_with(split({text}, {pat}, -1), {each(m, v)}, (a, b) -> array(a, coalesce(b, '')))), '')"
    )
    part = f"regexp_extract_all({text}, {pat}, {group})"
    return let(f"regexp_extract_all({text}, {pat}, 0)", lambda m: (
        f"CASE WHEN size({m}) = 0 THEN {text} ELSE {let(part, lambda v: joined(m, v))} END"
    ))
