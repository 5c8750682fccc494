"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sqltext import let, lit
from . import spans
from .common import fresh

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 or more; shorter runs hold no other match
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
MASK = "[SECRET]"

ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_-="
#: Character class of a whole candidate, and the entropy in bits that one of its windows must reach.
CLASSES = (("^[0-9]+$", None), ("^[0-9a-f]+$|^[0-9A-F]+$", 3.0), ("^[A-Za-z0-9]+$", 3.7), (".", 3.9))
#: Candidates that are no secrets: words and paths, UUIDs, dates and times, rules, alphabets, samples.
ALLOWED = (
    r"^[A-Za-z+/_=-]*$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9T_/+-]+Z?$",
    r"(.)\1{7}",
    r"(?i)0123456789|abcdefghij|example|placeholder|changeme",
)


def window_entropy(candidate: str, window: int) -> str:
    """``first, last, best``: hull of the windows that reach the class's bits, and the highest entropy.

    One fold over the characters. A step adds the count of the character that enters
    and takes off the one that leaves, so sum(c log c), from which the entropy of a window
    follows, changes by two terms. The state is one count per symbol whatever the length.
    """
    size = len(ALPHABET) + 1
    bits = "CASE " + " ".join(f"WHEN {candidate} RLIKE {lit(p)} THEN {'CAST(NULL AS DOUBLE)' if b is None else b}" for p, b in CLASSES) + " END"
    term = lambda c: f"CASE WHEN {c} > 1 THEN {c} * log2({c}) ELSE 0D END"

    def fold(sym: str, least: str) -> str:
        zero = (
            f"named_struct('n', array_repeat(0, {size}), 't', 0D, 'first', CAST(NULL AS INT), 'last', CAST(NULL AS INT), 'best', 0D)"
        )

        def step(new: str, old: str) -> str:
            gain = f"{term(f'(s.n[{new}] + 1)')} - {term(f's.n[{new}]')}"
            loss = f"CASE WHEN {old} >= 0 THEN {term(f's.n[{old}]')} - {term(f'(s.n[{old}] - 1)')} ELSE 0D END"
            total = f"CASE WHEN {new} = {old} THEN s.t ELSE s.t + ({gain}) - ({loss}) END"
            counts = f"transform(s.n, (c, k) -> c + CASE WHEN k = {new} THEN 1 ELSE 0 END - CASE WHEN k = {old} THEN 1 ELSE 0 END)"

            def after(t: str) -> str:
                h = f"CASE WHEN i >= {window} THEN log2({window}) - {t} / {window} ELSE 0D END"
                return let(h, lambda v: (
                    f"named_struct('n', {counts}, 't', {t},"
                    f" 'first', CASE WHEN {v} >= {least} THEN coalesce(s.first, i - {window}) ELSE s.first END,"
                    f" 'last', CASE WHEN {v} >= {least} THEN i ELSE s.last END, 'best', greatest(s.best, {v}))"
                ))

            return let(total, after)

        body = let(f"{sym}[i - 1]", lambda new: let(f"CASE WHEN i > {window} THEN {sym}[i - {window} - 1] ELSE -1 END", lambda old: step(new, old)))
        return f"aggregate(sequence(1, size({sym})), {zero}, (s, i) -> {body}, s -> named_struct('first', s.first, 'last', s.last, 'best', s.best))"

    symbols = f"transform(split({candidate}, ''), c -> instr({lit(ALPHABET)}, c))"
    return let(bits, lambda least: let(symbols, lambda sym: fold(sym, least)))


def _suspect(candidate: str) -> str:
    """Worth a fold: in no allow-list, and not reported as a whole by a fixed pattern."""
    calm = " OR ".join(f"{candidate} RLIKE {lit(p)}" for p in (*ALLOWED, f"^{HEX}$", f"^{ACCESS}$"))
    return f"NOT ({calm})"


def _entropic(candidate: str, window: int) -> str:
    fold = let(window_entropy(candidate, window), lambda h: f"CASE WHEN {h}.first IS NOT NULL THEN {h}.best END")
    return f"CASE WHEN {_suspect(candidate)} THEN {fold} END"


def secret_spans(text: str, window: int = 20) -> tuple[str, str]:
    """SQL of two span arrays of a string: fixed patterns, entropy."""
    fixed = (
        spans.found(text, ASSIGN, 0, lambda v, a, b: f"CASE WHEN length({v}) >= 6 THEN 1 END", group=1),
        f"CASE WHEN contains({text}, 'AKIA') THEN {spans.found(text, ACCESS, 1, lambda v, a, b: '1')} ELSE {spans.NONE} END",
        spans.found(text, HEX, 2, lambda v, a, b: "1"),
    )
    # a candidate is reported as a whole; its windows decide
    extra = spans.found(text, CANDIDATE, 3, lambda v, a, b: _entropic(v, window))
    return f"concat({', '.join(fixed)})", extra


def find_secrets(docs: DataFrame, text: str = "text", window: int = 20) -> DataFrame:
    """``docs`` with ``base`` and ``extra``: arrays of ``start, kind, end, score`` (code points, end exclusive).

    ``kind`` counts along ``KINDS``; base spans are those of the fixed patterns, extra
    ones candidates with a window of high entropy for their character class. Null text
    counts as empty and has no spans. Row-local: no exchange; repeated rows
    get the same spans, other columns pass through (a column named ``base`` or ``extra``
    is replaced).
    """
    whole = f"coalesce(`{text}`, '')"
    base, extra = secret_spans(whole, window)
    return docs.withColumns({"base": F.expr(base), "extra": F.expr(extra)})


def mask_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars", window: int = 20) -> DataFrame:
    """``docs`` with the secrets masked in ``text`` and ``length`` counted anew; texts without one stay as they are.

    Of an assignment the value is masked. Kinds are masked in turn on the pieces between
    matches, so a text is walked a fixed number of times however many secrets it holds.
    """
    new = fresh(docs, "masked_")
    mask = lit(MASK)
    steps = (
        (ASSIGN, 1, lambda m, v: f"CASE WHEN length({v}) >= 6 THEN concat(left({m}, length({m}) - length({v})), {mask}) END"),
        (ACCESS, 0, lambda m, v: mask),
        (HEX, 0, lambda m, v: mask),
        (CANDIDATE, 0, lambda m, v: f"CASE WHEN {_entropic(m, window)} IS NOT NULL THEN {mask} END"),
    )
    out = docs.withColumn(new, F.col(text))
    for pattern, group, swap in steps:
        out = out.withColumn(new, F.expr(spans.replaced(f"`{new}`", pattern, swap, group)))
    changed = ~F.col(new).eqNullSafe(F.col(text))
    if length in docs.columns and isinstance(docs.schema[length].dataType, T.IntegralType):
        out = out.withColumn(length, F.when(changed, F.char_length(new).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.withColumn(text, F.col(new)).select(*docs.columns)
