"""Tokens: quote-aware splitting and the per-token facts built on it."""

from __future__ import annotations

from .. import fixed
from .sqltext import let, lit

SEP_CLASS = _SEP = r" \t,;\[\]{}()<>"
# A token is a run of plain characters and quoted strings. Inside quotes a
# backslash protects the next character and separators do not split; an
# unclosed quote runs to the end. Every loop is possessive, so matching is
# iterative and linear however long the text is.
_BODY = (
    rf"""(?:[^{_SEP}"']++"""
    r'''|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)'''
    r"""|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?\z))++"""
)
TOKEN_OR_SEPARATOR = rf"(?s)[{_SEP}]|{_BODY}"
PIECE = rf"(?s)[{_SEP}]*+{_BODY}|[{_SEP}]++"  # a token with the separators before it


def repair(text: str) -> str:
    """Valid UTF-8; a run of bad bytes becomes one U+FFFD."""
    fixed_text = f"regexp_replace(make_valid_utf8({text}), '\\uFFFD+', '\\uFFFD')"
    return f"CASE WHEN is_valid_utf8({text}) THEN {text} ELSE {fixed_text} END"


def tokens(text: str) -> str:
    """All tokens and separators in order; joining them gives the text back."""
    return f"regexp_extract_all({text}, {lit(TOKEN_OR_SEPARATOR)}, 0)"


def pieces(text: str) -> str:
    """Tokens with their leading separators attached."""
    return f"regexp_extract_all({text}, {lit(PIECE)}, 0)"


def piece_token(piece: str) -> str:
    return f"trim(LEADING {lit(fixed.SEPARATORS)} FROM {piece})"


def is_separator(token: str) -> str:
    return f"{token} RLIKE {lit(chr(92) + 'A[' + _SEP + ']' + chr(92) + 'z')}"


def starts_quoted(t: str) -> str:
    return f"""(startswith({t}, '"') OR startswith({t}, '\\''))"""


def is_quoted(t: str) -> str:
    """Same quote at both ends."""
    return (
        f"""(octet_length({t}) >= 2 AND (startswith({t}, '"') AND endswith({t}, '"')"""
        f""" OR startswith({t}, '\\'') AND endswith({t}, '\\'')))"""
    )


def unquote(t: str) -> str:
    """Without matching outer quotes."""
    return f"CASE WHEN {is_quoted(t)} THEN substring({t}, 2, char_length({t}) - 2) ELSE {t} END"


def trim_space(t: str) -> str:
    return f"trim(BOTH {lit(fixed.WHITE_SPACE)} FROM {t})"


def ends_with_mark(t: str) -> str:
    return f"(endswith({t}, ':') OR endswith({t}, '='))"


def stem(trimmed: str) -> str:
    """Without one trailing ``:`` or ``=``."""
    return f"CASE WHEN {ends_with_mark(trimmed)} THEN left({trimmed}, char_length({trimmed}) - 1) ELSE {trimmed} END"


def clean(t: str) -> str:
    """Without surrounding space, one trailing ``:`` or ``=``, and outer quotes."""
    return let(stem(trim_space(t)), unquote)
