"""JSON columns: leaves of any depth, redaction in place, and redaction of typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsontext, keys, pseudonym, tokens
from ..functions.rules import validate_rules
from ..functions.sqltext import fresh, let, lit
from ..llm.common import ship
from ..options import Options
from ..plans import direct, scan

_SETTLED, _TEXT, _ITEMS, _NAMED, _PARTS, _SCANNED = (f"hush_{c}" for c in ("settled", "text", "items", "named", "parts", "scanned"))


def leaves(df: DataFrame, column: str) -> DataFrame:
    """``path, steps, parent, name, type, value`` of every leaf of a JSON text column.

    ``steps`` is the path as an array of keys and places, ``path`` the same as text. A key that an object
    repeats gives a leaf each time. Texts that are no JSON object have no leaves.
    """
    others = [c for c in df.columns if c != column]
    found = let(jsontext.items(column), lambda its: f"filter({its}, y -> {jsontext.is_value('y')})")
    rows = df.select(*others, F.explode(F.expr(found)).alias("l"))
    return rows.select(*others, *_described())


def _described() -> list:
    parent = "slice(l.st, 1, size(l.st) - 1)"
    return [
        F.expr(jsontext.rendered("l.st")).alias("path"),
        F.expr(jsontext.steps("l.st")).alias("steps"),
        F.expr(jsontext.rendered(parent)).alias("parent"),
        F.expr(jsontext.name("l")).alias("name"),
        F.expr(jsontext.type_name("l")).alias("type"),
        F.expr(jsontext.value("l")).alias("value"),
    ]


def _named_secrets(its: str, options: Options) -> str:
    """ARRAY of the objects that say ``"key": "<a sensitive key>"``: number and that key."""
    said = f"filter({its}, y -> y.c = 's' AND {jsontext.is_value('y')} AND coalesce({jsontext.name('y')} = 'key', false))"
    read = f"transform({said}, y -> named_struct('id', y.id, 'key', {jsontext.decoded('y.t')}))"
    return f"filter({read}, g -> {keys.is_sensitive_key('g.key', options)})"


def _is_secret(y: str, named: str, options: Options) -> str:
    """The value's own key is sensitive, or it is the value that a ``"key"`` beside it names."""
    return let(
        jsontext.name(y),
        lambda k: f"CASE WHEN {k} IS NULL THEN false ELSE {keys.is_sensitive_key(k, options)}"
        f" OR {k} = 'value' AND exists({named}, g -> g.id = {y}.id) END",
    )


def redact_leaves(df: DataFrame, column: str, options: Options) -> DataFrame:
    """Leaves with ``secret`` and ``masked``: sensitive keys and the value of a generic pair hash
    strings and zero numbers; other strings are scanned as lines, other numbers
    are judged as one token. Container elements of an array carry no key.

    A text that is no JSON object is one row of type ``line`` without a path, scanned as a line."""
    others = [c for c in df.columns if c != column]
    line = "array(CAST(named_struct('t', {t}, 'c', 'L', 'id', CAST(NULL AS INT), 'st', NULL) AS {kind}))"
    line = line.format(t=column, kind=jsontext.ITEM)
    flagged = let(
        jsontext.items(column),
        lambda its: f"CASE WHEN {its} IS NULL THEN transform({line}, y -> named_struct('y', y, 'secret', false)) ELSE "
        + let(
            _named_secrets(its, options),
            lambda g: f"transform(filter({its}, y -> {jsontext.is_value('y')}), y -> named_struct('y', y, 'secret', {_is_secret('y', g, options)}))",
        )
        + " END",
    )
    rows = df.select(*others, F.explode(F.expr(flagged)).alias("f")).select(*others, F.col("f.y").alias("l"), F.col("f.secret").alias("secret"))
    is_line = F.col("l.c") == "L"
    described = [F.when(~is_line, c).alias(n) for c, n in zip(_described(), ("path", "steps", "parent", "name"), strict=False)]
    kind = F.when(is_line, "line").otherwise(F.expr(jsontext.type_name("l"))).alias("type")
    text = F.when(is_line, F.col("l.t")).otherwise(F.expr(jsontext.value("l"))).alias("value")
    return _mask(rows.select(*others, *described, kind, text, "secret"), options)


def redact_json(df: DataFrame, column: str, options: Options, out: str = "redacted") -> DataFrame:
    """Add the redacted form of a JSON text column: objects in place, other texts as lines. Map-only, batch or streaming.

    Only the tokens of hidden values change. Everything else, order, repeated keys, blanks and the spelling of
    numbers, stays as written, so the result parses wherever the text did. Null stays null, an empty text empty.

    Texts that plain Python can settle (``plans/direct.py``) are done there, the others by the expressions, with the same result.
    """
    validate_rules(df.sparkSession, options)
    whole = f"array(CAST(named_struct('t', {_TEXT}, 'c', 'L', 'id', CAST(NULL AS INT), 'st', NULL) AS {jsontext.ITEM}))"
    judged = f"y.c IN ('s', 'n') AND {_is_secret('y', _NAMED, options)}"
    content = f"CASE y.c WHEN 'L' THEN y.t WHEN 's' THEN {jsontext.decoded('y.t')} END"
    part = f"named_struct('t', y.t, 'c', y.c, 'secret', {judged}, 'content', {content})"
    number = f"CASE WHEN x.secret OR {number_hidden('x.t', options)} THEN '0' ELSE x.t END"
    put = (
        f"CASE WHEN x.c = 'n' THEN {number} WHEN x.c = 's' AND x.secret THEN concat('\"', {pseudonym.placeholder('x.content')}, '\"')"
        f" WHEN r IS NULL THEN x.t WHEN x.c = 'L' THEN r WHEN r = x.content THEN x.t ELSE {jsontext.encoded('r')} END"
    )
    # step by step, in columns: one expression would nest deeper than the analyser follows
    steps = {
        _TEXT: tokens.repair(f"`{column}`"),
        _ITEMS: f"coalesce({jsontext.items(_TEXT)}, {whole})",
        _NAMED: _named_secrets(_ITEMS, options),
        _PARTS: f"transform({_ITEMS}, y -> {part})",
        _SCANNED: f"transform({_PARTS}, x -> CASE WHEN x.content IS NOT NULL AND NOT x.secret THEN {scan.redact('x.content', options)} END)",
        out: f"CASE WHEN {_TEXT} IS NOT NULL THEN array_join(zip_with({_PARTS}, {_SCANNED}, (x, r) -> {put}), '') END",
    }
    keyed = pseudonym.with_key(df, options)
    if direct.settles(options):
        ship(df.sparkSession)
        keyed = keyed.withColumn(_SETTLED, direct.redacted_json(options, F.col(f"`{column}`"), F.col(pseudonym.IPAD), F.col(pseudonym.OPAD)))
        steps[_TEXT] = f"CASE WHEN {_SETTLED} IS NULL THEN {steps[_TEXT]} END"
        steps[_ITEMS] = f"CASE WHEN {_TEXT} IS NOT NULL THEN {steps[_ITEMS]} END"
        steps[out] = f"coalesce({_SETTLED}, {steps[out]})"
    last = steps.pop(out)
    for name, expression in steps.items():
        keyed = keyed.withColumn(name, F.expr(expression))
    # out of a generator, so that what reads it stays above and does not copy the expression
    keyed = keyed.withColumn(out, F.explode(F.array(F.expr(last))))
    return pseudonym.without_key(keyed).drop(_SETTLED, _TEXT, _ITEMS, _NAMED, _PARTS, _SCANNED)


def with_parses(df: DataFrame, column: str, out: str = "parses") -> DataFrame:
    """Add whether a text is a JSON object, that is, whether ``jsontext.items`` gives its tokens; false for null."""
    ship(df.sparkSession)
    text = f"`{column}`"
    told = df.withColumn(_SETTLED, direct.object_told(F.expr(f"CASE WHEN {jsontext.opens(text)} THEN {text} END")))
    return told.withColumn(out, F.expr(f"coalesce({_SETTLED}, {jsontext.items(text)} IS NOT NULL)")).drop(_SETTLED)


def number_hidden(value: str, options: Options) -> str:
    """Would a bare number be replaced? Judged as one plain token."""
    x = f"named_struct('m', {scan.PLAIN}, 'c', {value}, 'o', {value}, 'a', false)"
    return let(x, lambda v: f"({scan.rule_name(v, options)}) IS NOT NULL OR ({scan._scored_hidden(v, options, None)})")


def _mask(rows: DataFrame, options: Options) -> DataFrame:
    masked = (
        f"CASE WHEN type = 'string' AND secret THEN {pseudonym.placeholder('value')}"
        f" WHEN type IN ('string', 'line') THEN {scan.redact('value', options)}"
        f" WHEN type = 'number' AND (secret OR {number_hidden('value', options)}) THEN '0'"
        " ELSE value END"
    )
    keyed = pseudonym.with_key(rows, options)
    return pseudonym.without_key(keyed.withColumn("masked", F.expr(masked)))


def generic_pairs(df: DataFrame, column: str, options: Options) -> DataFrame:
    """``{"key": …, "value": …}`` objects whose key names a secret: ``parent, key, value_path`` of each such value.

    Where an object repeats ``key``, its first sensitive one counts. Found inside each row: nothing is grouped.
    """
    others = [c for c in df.columns if c != column]
    values = f"coalesce({jsontext.name('y')} = 'value', false) AND y.c IN ('s', 'n', 'l', 'z')"
    found = let(
        jsontext.items(column),
        lambda its: let(
            _named_secrets(its, options),
            lambda g: f"transform(filter({its}, y -> {jsontext.is_value('y')} AND {values} AND exists({g}, h -> h.id = y.id)),"
            f" y -> named_struct('y', y, 'key', filter({g}, h -> h.id = y.id)[0].key))",
        ),
    )
    rows = df.select(*others, F.explode(F.expr(found)).alias("f"))
    parent = "slice(f.y.st, 1, size(f.y.st) - 1)"
    return rows.select(
        *others, F.expr(jsontext.rendered(parent)).alias("parent"), F.col("f.key").alias("key"), F.expr(jsontext.rendered("f.y.st")).alias("value_path")
    )


def redact_struct(df: DataFrame, column: str, options: Options) -> DataFrame:
    """Typed nested columns: the schema stays, string and number leaves are masked.

    The walk follows the schema, so it is unrolled once at planning time. Plain
    strings outside collections are scanned together as one array, which keeps
    the plan small however many fields there are.
    """
    schema = df.schema[column].dataType
    shared: list[str] = []
    walked = _walk(f"`{column}`", schema, "", options, shared)
    keyed = pseudonym.with_key(df, options)
    if shared:
        ln = fresh("ln")
        scanned = f"transform(array({', '.join(shared)}), {ln} -> CASE WHEN {ln} IS NULL THEN NULL ELSE {scan.redact(ln, options)} END)"
        keyed = keyed.withColumn(_SCANNED, F.expr(scanned))
    return pseudonym.without_key(keyed.withColumn(column, F.expr(walked))).drop(_SCANNED)


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _walk(ref: str, kind: T.DataType, name: str, options: Options, shared: list[str] | None) -> str:
    """Masked form of ``ref``; ``shared`` collects plain strings, None inside collections."""
    if isinstance(kind, T.StructType):
        names = {f.name for f in kind.fields}
        parts = []
        for f in kind.fields:
            child = _walk(f"{ref}.`{f.name}`", f.dataType, f.name, options, shared)
            if f.name == "value" and "key" in names and isinstance(kind["key"].dataType, T.StringType):
                secret = keys.is_sensitive_key(f"{ref}.`key`", options)
                child = f"CASE WHEN {secret} THEN {_hide(f'{ref}.`value`', f.dataType, child)} ELSE {child} END"
            parts.append(f"{lit(f.name)}, {child}")
        return f"CASE WHEN {ref} IS NULL THEN NULL ELSE named_struct({', '.join(parts)}) END"
    if isinstance(kind, T.ArrayType):
        el = fresh("el")
        return f"transform({ref}, {el} -> {_walk(el, kind.elementType, '', options, None)})"
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        k, v = fresh("mk"), fresh("mv")
        inner = _walk(v, kind.valueType, "", options, None)
        secret = keys.is_sensitive_key(k, options)
        return f"transform_values({ref}, ({k}, {v}) -> CASE WHEN {secret} THEN {_hide(v, kind.valueType, inner)} ELSE {inner} END)"
    secret = keys.is_sensitive_key(lit(name), options) if name else "false"
    if isinstance(kind, T.StringType) and shared is not None:
        shared.append(ref)
        plain = f"{_SCANNED}[{len(shared) - 1}]"
    else:
        plain = _plain(ref, kind, options)
    return f"CASE WHEN {secret} THEN {_hide(ref, kind, plain)} ELSE {plain} END"


def _hide(ref: str, kind: T.DataType, otherwise: str) -> str:
    if isinstance(kind, T.StringType):
        return f"CASE WHEN {ref} IS NULL THEN NULL ELSE {pseudonym.placeholder(ref)} END"
    if isinstance(kind, _NUMBERS):
        return f"CASE WHEN {ref} IS NULL THEN NULL ELSE CAST(0 AS {kind.simpleString()}) END"
    return otherwise


def _plain(ref: str, kind: T.DataType, options: Options) -> str:
    if isinstance(kind, T.StringType):
        return scan.redact(ref, options)
    if isinstance(kind, _NUMBERS):
        hidden = number_hidden(f"CAST({ref} AS STRING)", options)
        return f"CASE WHEN {hidden} THEN CAST(0 AS {kind.simpleString()}) ELSE {ref} END"
    return ref
