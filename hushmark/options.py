"""Job options: a frozen value passed to every plan builder."""

from __future__ import annotations

import hashlib
import json
import warnings
from dataclasses import dataclass, field, replace

from . import fixed


@dataclass(frozen=True)
class Rule:
    """One user pattern. ``name`` is what the placeholder shows."""

    pattern: str
    name: str = ""


def rules_from_json(text: str | None) -> tuple[Rule, ...]:
    """``[{"pattern": …, "name": …}]`` → rules, in list order; bad JSON raises."""
    if not text:
        return ()
    parsed = json.loads(text)
    if not isinstance(parsed, list):
        raise ValueError("rule list must be a JSON array")
    return tuple(Rule(r.get("pattern", ""), r.get("name", "")) for r in parsed)


@dataclass(frozen=True)
class Options:
    """All settings of a run.

    The salt has no default: random salts would make placeholders differ from
    run to run (and from retry to retry), so correlation would be lost.
    """

    salt: str | bytes = field(repr=False)
    entropy_threshold: float = fixed.ENTROPY_THRESHOLD
    min_secret_length: int = fixed.MIN_SECRET_LENGTH
    bigram_check: bool = True
    bigram_default: float = fixed.BIGRAM_DEFAULT
    adaptive: bool = False
    adaptive_samples: int = fixed.BASELINE_SAMPLES
    sensitive_keys: tuple[str, ...] = fixed.SENSITIVE_KEYS
    key_patterns: tuple[str, ...] = ()
    custom_rules: tuple[Rule, ...] = ()
    safe_rules: tuple[Rule, ...] = ()

    def __post_init__(self) -> None:
        if not self.salt:
            raise ValueError("a salt is required")
        if len(self.salt_bytes) < 16:
            warnings.warn("salt is shorter than 16 bytes", stacklevel=3)
        keys = tuple(k.strip().lower() for k in self.sensitive_keys)
        object.__setattr__(self, "sensitive_keys", keys)
        patterns = tuple(p.strip() for p in self.key_patterns if p.strip())
        object.__setattr__(self, "key_patterns", patterns)

    @property
    def salt_bytes(self) -> bytes:
        return self.salt.encode() if isinstance(self.salt, str) else bytes(self.salt)

    @property
    def key_fragments(self) -> tuple[str, ...]:
        """Sensitive keys without those that another one already implies."""
        kept: list[str] = []
        for k in sorted(set(self.sensitive_keys), key=lambda s: (len(s), s)):
            if not any(f in k for f in kept):
                kept.append(k)
        return tuple(kept)

    def hmac_pads(self) -> tuple[bytes, bytes]:
        """RFC 2104 inner and outer key blocks for SHA-256."""
        key = self.salt_bytes
        if len(key) > 64:
            key = hashlib.sha256(key).digest()
        key = key.ljust(64, b"\0")
        return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)

    def with_(self, **changes) -> "Options":
        return replace(self, **changes)

    @classmethod
    def from_mapping(cls, settings: dict[str, str]) -> "Options":
        """Read string settings (one per option, lists comma separated, rules as JSON).

        Malformed numbers keep the default and malformed rules raise.
        """
        given: dict = {"salt": settings.get("salt", "")}

        def number(name: str, cast, ok=lambda v: True) -> None:
            if settings.get(name):
                try:
                    value = cast(settings[name])
                except ValueError:
                    return
                if ok(value):
                    given[name] = value

        def truthy(name: str) -> bool:
            return settings.get(name) in ("true", "1")

        number("entropy_threshold", float)
        number("bigram_default", float)
        number("min_secret_length", int)
        given["adaptive"] = truthy("adaptive")
        if given["adaptive"]:
            number("adaptive_samples", int, lambda v: v > 0)
        given["bigram_check"] = not truthy("disable_bigram_check")
        if settings.get("sensitive_keys"):
            given["sensitive_keys"] = tuple(settings["sensitive_keys"].split(","))
        if settings.get("key_patterns"):
            given["key_patterns"] = tuple(settings["key_patterns"].split(","))
        given["custom_rules"] = rules_from_json(settings.get("custom_rules"))
        given["safe_rules"] = rules_from_json(settings.get("safe_rules"))
        return cls(**given)
