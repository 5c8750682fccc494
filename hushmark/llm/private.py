"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import let, lit
from . import spans

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
# Possessive runs that start at the start of a run (or where the last match ended) find the same
# leftmost matches as the plain patterns and read every character a bounded number of times.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Words near a span that speak for its kind, and the score without and with one.
CONTEXT = {
    "email": ("mail|contact|write|address", 0.9, 1.0),
    "ip": ("ip|host|server|addr|client|login", 0.6, 0.9),
    "card": ("card|visa|master|amex|credit|pay|iban", 0.8, 1.0),
    "phone": ("phone|tel|call|mobile|fax|contact", 0.7, 0.95),
    "iban": ("iban|bank|account|transfer|konto", 0.8, 1.0),
    "ssn": ("ssn|social|security|tax", 0.3, 0.8),
}
NEAR = 48
LEAST = 0.5  # spans the method adds need this score; base spans always stay


def digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def luhn(number: str) -> str:
    """Does a string of digits pass? Every second digit from the right counts double, less 9 above 9."""
    each = "CASE WHEN i % 2 = 1 THEN CASE WHEN x > 4 THEN x * 2 - 9 ELSE x * 2 END ELSE x END"
    return f"aggregate(transform(transform(split(reverse({number}), ''), d -> CAST(d AS INT)), (x, i) -> {each}), 0, (s, x) -> s + x) % 10 = 0"


def mod97(account: str) -> str:
    """Does an account number leave 1: the first four characters last, letters as 10 to 35?"""
    moved = f"split(concat(substring({account}, 5), left({account}, 4)), '')"
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END"
    return f"aggregate(transform({moved}, c -> {value}), 0, (s, x) -> (s * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"


def _score(kind: str, ok: str, before: str, after: str) -> str:
    words, alone, backed = CONTEXT[kind]
    near = f"concat(right({before}, {NEAR}), ' ', left({after}, {NEAR})) RLIKE {lit('(?i)(?<![a-z])(' + words + ')')}"
    return f"CASE WHEN {ok} THEN CASE WHEN {near} THEN {backed} ELSE {alone} END END"


def personal_spans(text: str) -> tuple[str, str]:
    """SQL of two span arrays of a string: base kinds, kinds the method adds."""
    part = "[0-9]+"
    byte = f"forall(regexp_extract_all({{v}}, '{part}', 0), x -> length(ltrim('0', x)) <= 3 AND CAST(right(x, 3) AS INT) <= 255)"
    tests = {
        "email": lambda v: "true",
        "ip": lambda v: byte.format(v=v),
        "card": lambda v: let(digits(v), lambda d: f"length({d}) BETWEEN 14 AND 19 AND {luhn(d)}"),
        "phone": lambda v: f"length({digits(v)}) BETWEEN 10 AND 15",
        "iban": lambda v: let(f"replace({v}, ' ', '')", lambda a: f"length({a}) BETWEEN 15 AND 34 AND {mod97(a)}"),
        "ssn": lambda v: f"NOT {v} RLIKE '^(000|666|9)|-00-|-0000$'",
    }
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, IBAN, SSN), strict=True))

    def of(kind: str) -> str:
        return spans.found(text, patterns[kind], KINDS.index(kind), lambda v, a, b: _score(kind, tests[kind](v), a, b))

    only_if = lambda kind, mark: f"CASE WHEN contains({text}, {lit(mark)}) THEN {of(kind)} ELSE {spans.NONE} END"
    base = f"concat({only_if('email', '@')}, {of('ip')}, {of('card')}, {only_if('phone', '+')})"
    extra = f"filter(concat({of('iban')}, {only_if('ssn', '-')}), p -> p.score >= {LEAST})"
    return base, extra


def find_personal(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``extra``: arrays of ``start, kind, end, score`` (code points, end exclusive).

    ``kind`` counts along ``KINDS``. Base spans are emails, addresses, Luhn-valid cards and
    phones; extra ones are bank accounts (mod 97) and social security numbers that context words back. Null text counts as
    empty. Row-local: no exchange; repeated rows get the same spans, other columns pass
    through (a column named ``base`` or ``extra`` is replaced).
    """
    base, extra = personal_spans(f"coalesce(`{text}`, '')")
    return docs.withColumns({"base": F.expr(base), "extra": F.expr(extra)})
