"""Complexity of a token: entropy + character-class bonus + bigram adjustment."""

from __future__ import annotations

from collections.abc import Callable

from .. import fixed
from ..options import Options
from .sqltext import lit

GUARD = 1e-9  # decisions are strict; rounding noise must not flip exact ties

CLASS_PATTERNS = (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r"[\p{P}\p{S}]")


def character_runs(t: str) -> str:
    """The repeated characters of a token, one string per character.

    The characters are sorted so that repeats stand together: only repeated
    characters cost a term, and the work is n·log n however long the token is.
    """
    return rf"regexp_extract_all(array_join(sort_array(split({t}, '')), ''), '(?s)(.)\\1++', 0)"


def entropy(t: str) -> str:
    """Shannon entropy over characters, in bits."""
    repeats = (
        f"aggregate({character_runs(t)}, 0D, (acc, r) -> acc + char_length(r) * log2(char_length(r)))"
    )
    return f"CASE WHEN {t} = '' THEN 0D ELSE log2(char_length({t})) - {repeats} / char_length({t}) END"


def class_bonus(t: str) -> str:
    """Half a point for every character class after the first."""
    found = " + ".join(f"CAST({t} RLIKE {lit(p)} AS INT)" for p in CLASS_PATTERNS)
    return f"greatest({found} - 1, 0) * {fixed.CLASS_BONUS}D"


def _tenths_table(options: Options) -> str:
    """Ten times (log-probability − default) of every pair of a–z and a–z/_, row after row."""
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    default = round(options.bigram_default * 10, 9)
    cells = (
        round(round(fixed.BIGRAMS[a + b] * 10) - default, 9) if a + b in fixed.BIGRAMS else 0.0
        for a in letters
        for b in [*letters, "_"]
    )
    # One foldable cast: a small plan node that becomes a constant array.
    return f"CAST(split('{' '.join(str(c) for c in cells)}', ' ') AS ARRAY<DOUBLE>)"


def bigram_fold(t: str, options: Options, finish: Callable[[str], str]) -> str:
    """``finish`` of ten times the summed log-probabilities of all byte pairs.

    Pairs outside the table, those of non-ASCII characters included, count as
    the default. Whole tenths keep the sum exact in any order.
    """
    default = round(options.bigram_default * 10, 9)
    cell = (
        "(ascii(bg) - 97) * 27 + CASE WHEN endswith(bg, '_') THEN 26 ELSE ascii(right(bg, 1)) - 97 END"
    )
    return (
        f"aggregate(regexp_extract_all(lower({t}), '(?=([a-z][a-z_]))', 1), {default}D * (octet_length(lower({t})) - 1),"
        f" (acc, bg) -> acc + {_tenths_table(options)}[{cell}], acc -> {finish('acc')})"
    )


def bigram_adjustment(t: str, options: Options) -> str:
    """Lower the score of English-like tokens, raise it for unlikely ones."""
    if not options.bigram_check:
        return "0D"
    likely, unlikely = round(fixed.BIGRAM_LIKELY * 10, 9), round(fixed.BIGRAM_UNLIKELY * 10, 9)
    pairs = f"(octet_length(lower({t})) - 1)"
    decided = bigram_fold(
        t,
        options,
        lambda s: f"CASE WHEN {s} > {likely}D * {pairs} THEN {fixed.BIGRAM_LIKELY_ADJUST}D"
        f" WHEN {s} < {unlikely}D * {pairs} THEN {fixed.BIGRAM_UNLIKELY_ADJUST}D ELSE 0D END",
    )
    return f"CASE WHEN octet_length({t}) <= 3 THEN 0D ELSE {decided} END"


def rare_pairs(options: Options) -> list[str] | None:
    """Pairs without which the bigram part cannot be positive; None when any token can gain."""
    if not options.bigram_check:
        return []
    if options.bigram_default < fixed.BIGRAM_UNLIKELY:
        return None
    return [bg for bg, p in fixed.BIGRAMS.items() if p < fixed.BIGRAM_UNLIKELY]


def _may_gain(t: str, options: Options) -> str:
    rare = rare_pairs(options)
    if rare is None:
        return "true"
    return f"lower({t}) RLIKE '{'|'.join(rare)}'" if rare else "false"


def complexity(t: str, options: Options) -> str:
    """The full score; 0 for the empty token."""
    parts = f"({entropy(t)}) + ({class_bonus(t)}) + ({bigram_adjustment(t, options)})"
    return f"CASE WHEN {t} = '' THEN 0D ELSE {parts} END"


def longest_quiet(classes: int, threshold: float, gain: bool) -> int:
    """Longest token of so many character classes whose score cannot pass ``threshold``:
    entropy is at most log2(length), a gain at most +0.5. Never more than 1000, so
    that it can stand in a pattern; longer tokens are simply scored."""
    room = threshold - (fixed.BIGRAM_UNLIKELY_ADJUST if gain else 0.0) - fixed.CLASS_BONUS * (classes - 1)
    return min(int(2 ** min(room, 10.0) + GUARD), 1000) if room >= 0 else 0


def exceeds(t: str, threshold: str, options: Options) -> str:
    """``complexity(t) > threshold``, computing only what the answer needs.

    Entropy is at most log2(length) and the bigram part at most +0.5 (and that
    only with a rare pair), so short words of few classes are settled before any
    character is counted, and pairs are looked up only when they can change the
    answer.
    """
    limit = f"({threshold} + {GUARD}D)"
    bits = f"b - rep / char_length({t})"
    if options.bigram_check:
        up, down = f"{fixed.BIGRAM_UNLIKELY_ADJUST}D", f"{fixed.BIGRAM_LIKELY_ADJUST}D"
        reachable = f"(b > {limit} OR b + {up} > {limit} AND {_may_gain(t, options)})"
        late = (
            f"CASE WHEN {bits} + {up} <= {limit} THEN false WHEN {bits} + {down} > {limit} THEN true"
            f" ELSE {bits} + {bigram_adjustment(t, options)} > {limit} END"
        )
    else:
        reachable, late = f"b > {limit}", f"{bits} > {limit}"
    counted = (
        f"aggregate({character_runs(t)}, 0D, (acc, r) -> acc + char_length(r) * log2(char_length(r)), rep -> {late})"
    )
    return (
        f"transform(array(CASE WHEN {t} = '' THEN -100D ELSE log2(char_length({t})) + {class_bonus(t)} END),"
        f" b -> CASE WHEN {reachable} THEN {counted} ELSE false END)[0]"
    )
