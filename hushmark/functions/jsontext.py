"""JSON texts read as they stand: one ordered fold over a text's own tokens.

The fold carries a stack of the open objects and arrays and what may come next, so
it checks the grammar and knows the path of every value. Nothing is parsed into
another form: order, repeated keys, blanks and the spelling of numbers stay.
"""

from __future__ import annotations

from .sqltext import let, lit

# A token: white space, a string, a number or word, a mark. What fits nothing is one character.
_TOKEN = r'(?s)[ \t\n\r]++|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[0-9A-Za-z.+-]++|.'
_NUMBER = r"\A-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?\z"
_ESCAPES = r'\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})'
_PLAIN_NAME = r"\A[A-Za-z][A-Za-z0-9_]*+\z"
_STRETCH = 256  # tokens folded in one go

LEVEL = "STRUCT<o: BOOLEAN, id: INT, n: INT, k: STRING>"
ITEM = f"STRUCT<t: STRING, c: STRING, id: INT, st: ARRAY<{LEVEL}>>"
STATE = f"STRUCT<e: STRING, i: INT, st: ARRAY<{LEVEL}>, b: ARRAY<{ITEM}>>"

# Kinds of tokens (c): w blank, s string, n number, l true/false, z null, { } [ ] : , and x for anything else;
# a string that is a key becomes k. What may come next (e): V a value, A a value or ], K a key or },
# N a key, C a colon, E a comma or an end, D nothing more, X never valid again.


def _kind(t: str) -> str:
    sound = (
        f"{t} RLIKE {lit(chr(92) + 'A' + chr(34))} AND octet_length({t}) > 1 AND NOT {t} RLIKE '[\\\\x00-\\\\x1F]'"
        f" AND (NOT contains({t}, '\\\\') OR NOT contains(regexp_replace({t}, {lit(_ESCAPES)}, ''), '\\\\'))"
    )
    return (
        f"CASE WHEN {t} IN ('{{', '}}', '[', ']', ':', ',') THEN {t} WHEN {sound} THEN 's' WHEN {t} IN ('true', 'false') THEN 'l'"
        f" WHEN {t} = 'null' THEN 'z' WHEN {t} RLIKE {lit(_NUMBER)} THEN 'n'"
        f" WHEN left({t}, 1) IN (' ', '\\t', '\\n', '\\r') THEN 'w' ELSE 'x' END"
    )


def _step() -> str:
    """Next state after token ``x`` (t its text, c its kind)."""
    depth = "size(acc.st)"
    top = f"get(acc.st, {depth} - 1)"
    rest = f"slice(acc.st, 1, {depth} - 1)"
    after = f"CASE WHEN {depth} = 1 THEN 'D' ELSE 'E' END"
    # what stands where, given the kind and what may come
    move = (
        "CASE WHEN x.c = 'w' THEN 'w' WHEN acc.e = 'X' THEN 'x'"
        " WHEN acc.e IN ('V', 'A') AND x.c IN ('s', 'n', 'l', 'z') THEN 'v'"
        " WHEN acc.e IN ('V', 'A') AND x.c IN ('{', '[') THEN 'o'"
        " WHEN acc.e IN ('K', 'N') AND x.c = 's' THEN 'k'"
        " WHEN acc.e = 'C' AND x.c = ':' THEN ':'"
        " WHEN acc.e = 'E' AND x.c = ',' THEN ','"
        f" WHEN acc.e IN ('K', 'E') AND x.c = '}}' AND {top}.o OR acc.e IN ('A', 'E') AND x.c = ']' AND NOT {top}.o THEN 'c'"
        " ELSE 'x' END"
    )
    level = "named_struct('o', {o}, 'id', {id}, 'n', {n}, 'k', {k})"
    opened = level.format(o="x.c = '{'", id="acc.i", n="0", k="CAST(NULL AS STRING)")
    keyed = level.format(o="true", id=f"{top}.id", n=f"{top}.n", k="x.t")
    counted = level.format(o="false", id=f"{top}.id", n=f"{top}.n + 1", k="CAST(NULL AS STRING)")
    stack = (
        f"CASE m WHEN 'o' THEN concat(acc.st, array({opened})) WHEN 'k' THEN concat({rest}, array({keyed}))"
        f" WHEN 'c' THEN {rest} WHEN ',' THEN CASE WHEN {top}.o THEN acc.st ELSE concat({rest}, array({counted})) END ELSE acc.st END"
    )
    expect = (
        "CASE m WHEN 'w' THEN acc.e WHEN 'v' THEN 'E' WHEN 'o' THEN CASE WHEN x.c = '{' THEN 'K' ELSE 'A' END WHEN 'k' THEN 'C'"
        f" WHEN ':' THEN 'V' WHEN ',' THEN CASE WHEN {top}.o THEN 'N' ELSE 'V' END WHEN 'c' THEN {after} ELSE 'X' END"
    )
    item = f"named_struct('t', x.t, 'c', CASE WHEN m = 'k' THEN 'k' ELSE x.c END, 'id', {top}.id, 'st', CASE WHEN m = 'v' THEN acc.st END)"
    return (
        f"transform(array({move}), m -> named_struct('e', {expect}, 'i', acc.i + 1, 'st', {stack}, 'b', concat(acc.b, array({item}))))[0]"
    )


def items(text: str) -> str:
    """ARRAY of the tokens of a JSON object text; NULL when it is none.

    Fields: t the token as written, c its kind, id the token number that opened the object or array around it,
    and for values st, the levels above: o whether it is an object, id, n the place in an array, k the key as written.
    Joining t gives the text back. Texts that do not start with a brace are not folded at all.
    """
    kinds = f"transform(regexp_extract_all({text}, {lit(_TOKEN)}, 0), t -> named_struct('t', t, 'c', {_kind('t')}))"
    none = f"CAST(array() AS ARRAY<{ITEM}>)"
    blank = f"CAST(named_struct('e', 'V', 'i', 0, 'st', array(), 'b', array()) AS {STATE})"

    def folded(toks: str) -> str:
        resume = f"CAST(named_struct('e', o.s.e, 'i', o.s.i, 'st', o.s.st, 'b', array()) AS {STATE})"
        stretch = f"aggregate(slice({toks}, j * {_STRETCH} + 1, {_STRETCH}), {resume}, (acc, x) -> CAST({_step()} AS {STATE}))"
        return (
            f"aggregate(sequence(0, (size({toks}) - 1) DIV {_STRETCH}),"
            f" named_struct('s', {blank}, 'd', CAST(array() AS ARRAY<ARRAY<{ITEM}>>)),"
            f" (o, j) -> CASE WHEN o.s.e = 'X' THEN o ELSE named_struct('s', {stretch}, 'd', concat(o.d, array(o.s.b))) END,"
            f" o -> CASE WHEN o.s.e = 'D' THEN flatten(concat(o.d, array(o.s.b))) ELSE CAST(NULL AS ARRAY<{ITEM}>) END)"
        )

    body = let(kinds, lambda k: folded(k))
    return f"CASE WHEN {opens(text)} THEN {body} END"


def opens(text: str) -> str:
    """Does the text start with a brace?"""
    return f"{text} RLIKE {lit(chr(92) + 'A[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]*+' + chr(92) + '{')}"


def decoded(token: str) -> str:
    """Content of a string token."""
    plain = f"substring({token}, 2, char_length({token}) - 2)"
    return f"CASE WHEN contains({token}, '\\\\') THEN get_json_object(concat('[', {token}, ']'), '$[0]') ELSE {plain} END"


def encoded(value: str) -> str:
    """A string token with the given content."""
    return let(f"to_json(array({value}))", lambda j: f"substring({j}, 2, char_length({j}) - 2)")


def is_value(item: str) -> str:
    return f"{item}.st IS NOT NULL"


def parent_level(item: str) -> str:
    return f"get({item}.st, size({item}.st) - 1)"


def name(item: str) -> str:
    """Key of a value, NULL for a cell of an array."""
    return let(parent_level(item), lambda p: f"CASE WHEN {p}.o THEN {decoded(f'{p}.k')} END")


def steps(levels: str) -> str:
    """Path as an array of steps: keys, and places in arrays in brackets are told by ``rendered``."""
    return f"transform({levels}, y -> CASE WHEN y.o THEN {decoded('y.k')} ELSE CAST(y.n AS STRING) END)"


def rendered(levels: str) -> str:
    """Path as text: ``$.a."b.c"[0]``; keys that are no plain names are quoted."""
    quoted = f"replace(replace(k, '\\\\', '\\\\\\\\'), '\"', '\\\\\"')"
    key = f"transform(array({decoded('y.k')}), k -> CASE WHEN k RLIKE {lit(_PLAIN_NAME)} THEN concat('.', k) ELSE concat('.\"', {quoted}, '\"') END)[0]"
    return f"concat('$', array_join(transform({levels}, y -> CASE WHEN y.o THEN {key} ELSE concat('[', y.n, ']') END), ''))"


def type_name(item: str) -> str:
    return f"CASE {item}.c WHEN 's' THEN 'string' WHEN 'n' THEN 'number' WHEN 'l' THEN 'boolean' ELSE 'null' END"


def value(item: str) -> str:
    """Content of a value as text, numbers as written; NULL for null."""
    return f"CASE {item}.c WHEN 's' THEN {decoded(f'{item}.t')} WHEN 'z' THEN NULL ELSE {item}.t END"
