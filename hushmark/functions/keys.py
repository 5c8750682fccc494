"""Sensitive keys."""

from __future__ import annotations

from .. import fixed
from ..options import Options
from .scores import exceeds
from .sqltext import any_of, lit


def _shortest(words: tuple[str, ...]) -> list[str]:
    """Words that hold no other word of the list."""
    return [w for w in words if not any(v != w and v in w for v in words)]


def holds_fragment(lowered: str, options: Options) -> str:
    return any_of([f"contains({lowered}, {lit(f)})" for f in options.key_fragments])


def matches_key_pattern(key: str, options: Options) -> str:
    if not options.key_patterns:
        return "false"
    return f"{key} RLIKE {lit('(?id)(?:' + '|'.join(options.key_patterns) + ')')}"


def is_sensitive_key(key: str, options: Options, lowered: str | None = None) -> str:
    """A listed fragment occurs, unless the key is itself a long random string;
    without a fragment the key patterns decide. ``key`` should be a plain column
    or lambda field: it is read several times. ``lowered`` spares lower-casing it."""
    looks_random = exceeds(key, f"{options.entropy_threshold}D", options)
    return (
        f"CASE WHEN {holds_fragment(lowered or f'lower({key})', options)}"
        f" THEN octet_length({key}) <= {fixed.LONG_KEY_LENGTH} OR NOT ({looks_random})"
        f" ELSE {matches_key_pattern(key, options)} END"
    )


def may_hold_key(lowered: str, options: Options) -> str:
    """Cheap test of a lower-cased line: without it no token can be a sensitive key."""
    if options.key_patterns:
        return "true"
    return holds_fragment(lowered, options)


def is_context_word(lowered: str) -> str:
    return f"{lowered} IN ({', '.join(lit(w) for w in fixed.CONTEXT_WORDS)})"


def may_hold_context(lowered: str) -> str:
    return any_of([f"contains({lowered}, {lit(w)})" for w in _shortest(fixed.CONTEXT_WORDS)])


def is_generic_name(lowered: str) -> str:
    return f"{lowered} IN ({', '.join(lit(w) for w in fixed.GENERIC_KEY_NAMES)})"
