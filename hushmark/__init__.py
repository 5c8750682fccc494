"""Sensitive-data detection and redaction as Spark plans."""

from .options import Options, Rule

__all__ = ["Options", "Rule"]
