"""User rules: whole-token replacement by name."""

from __future__ import annotations

from .. import fixed
from ..options import Options, Rule
from .sqltext import lit

# (?d): only \n ends a line, so $ and . behave alike on every platform's text.
DIALECT = "(?d)"


def rule_hit(t: str, options: Options) -> str:
    """Struct (pos, ord, name) of the deciding rule, or NULL.

    The leftmost match decides; at the same place the earlier rule does.
    """
    if not options.custom_rules:
        return "CAST(NULL AS STRUCT<pos: INT, ord: INT, name: STRING>)"
    hits = ", ".join(
        f"named_struct('pos', regexp_instr({t}, {lit(DIALECT + r.pattern)}), 'ord', {i}, 'name', {lit(r.name)})"
        for i, r in enumerate(options.custom_rules)
    )
    best = f"array_min(filter(array({hits}), h -> h.pos > 0))"
    return f"CASE WHEN octet_length({t}) >= {fixed.MIN_CUSTOM_RULE_LENGTH} THEN {best} END"


def validate_rules(spark, options: Options) -> None:
    """Compile every user pattern, all in one statement that is worked out while it is planned: no task
    starts. A bad rule raises, a bad key pattern too."""
    given = [r.pattern for r in (*options.custom_rules, *options.safe_rules)]
    given += [f"(?i)(?:{p})" for p in options.key_patterns]
    if not given:
        return
    tried = lambda some: spark.sql("SELECT " + ", ".join(f"x RLIKE {lit(DIALECT + p)}" for p in some) + " FROM VALUES ('x') AS t(x)").collect()
    try:
        tried(given)
    except Exception:
        for p in given:
            try:
                tried([p])
            except Exception as err:
                raise ValueError(f"invalid rule pattern {p!r}") from err
        raise


__all__ = ["Rule", "rule_hit", "validate_rules"]
