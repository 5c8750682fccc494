"""Small helpers for composing Spark SQL expressions as text."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

_serial = count()


def lit(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fresh(prefix: str = "v") -> str:
    """A lambda variable name no other expression uses."""
    return f"{prefix}_{next(_serial)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it many times in ``body``."""
    v = fresh()
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def any_of(terms: list[str]) -> str:
    """Disjunction; false when there is nothing to test."""
    return "(" + " OR ".join(terms) + ")" if terms else "false"
