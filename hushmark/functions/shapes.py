"""Safe shapes: tokens that look random but are not secrets."""

from __future__ import annotations

from .. import fixed
from ..options import Options
from .sqltext import any_of, lit

# Shape name → Java pattern, in the order the first match is reported.
# Fixed shapes; all are anchored at the start except those named "contains".
SHAPES = (
    ("scheme", r"://"),
    ("uuid", r"\A[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\z"),
    ("ipv6", r"\A[0-9A-Fa-f]*+:[0-9A-Fa-f]*+:[0-9A-Fa-f:]*+\z"),
    ("unix_time", r"\A(?:17|18|19|20)[0-9]{8}\z"),
    ("iso_date", r"\A[0-9]{4}-[0-9]{2}-(?s:..)"),
    ("registry", "(?:" + "|".join(r.replace(".", r"\.") for r in fixed.REGISTRIES) + ")"),
    ("path", r"(?s)\A(?:/|\./|\.\./|[A-Za-z]:\\|\\\\|[^\\]*+\\[^\\]*+\\)"),
    ("git_hash", r"\A[0-9A-Fa-f]{40}\z"),
    ("object_id", r"\A[0-9A-Fa-f]{24}\z"),
    ("ssh", r"\A(?:ssh-|AAAA[0-9A-Za-z+/=]{17,}\z)"),
    ("user_name", r"\Auser_[0-9A-Fa-f_]{1,11}\z"),
)

# ISO dates are measured in bytes: one trailing two-byte character is enough.
_ISO_MULTIBYTE = r"\A[0-9]{4}-[0-9]{2}-[^\x00-\x7f]"


def _test(name: str, pattern: str, t: str) -> str:
    if name == "scheme":
        return f"contains({t}, '://')"
    if name == "iso_date":
        return f"({t} RLIKE {lit(pattern)} OR {t} RLIKE {lit(_ISO_MULTIBYTE)})"
    return f"{t} RLIKE {lit(pattern)}"


def shape_flags(t: str) -> dict[str, str]:
    """One predicate per shape."""
    return {name: _test(name, pattern, t) for name, pattern in SHAPES}


def first_shape(t: str) -> str:
    """Name of the first shape that fits, or NULL."""
    cases = " ".join(f"WHEN {test} THEN {lit(name)}" for name, test in shape_flags(t).items())
    return f"CASE {cases} END"


def has_safe_shape(t: str) -> str:
    """Any shape fits. One alternation for the anchored ones."""
    anchored = [p for n, p in SHAPES if n not in ("scheme", "registry")] + [_ISO_MULTIBYTE]
    either = "|".join(f"(?:{p})" for p in anchored)
    registries = [f"contains({t}, {lit(r)})" for r in fixed.REGISTRIES]
    return any_of([f"contains({t}, '://')", *registries, f"{t} RLIKE {lit(either)}"])


def is_registry_image(t: str) -> str:
    return any_of([f"contains({t}, {lit(r)})" for r in fixed.REGISTRIES])


def matches_safe_rule(t: str, options: Options) -> str:
    """A user allow-list pattern matches; very short tokens are not tested."""
    if not options.safe_rules:
        return "false"
    tests = any_of([f"{t} RLIKE {lit('(?d)' + r.pattern)}" for r in options.safe_rules])
    return f"(octet_length({t}) >= {fixed.MIN_SAFE_RULE_LENGTH} AND {tests})"


def is_safe(t: str, options: Options) -> str:
    return f"({has_safe_shape(t)} OR {matches_safe_rule(t, options)})"
