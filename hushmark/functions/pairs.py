"""Key/value pairs inside one token."""

from __future__ import annotations

from .shapes import is_registry_image
from .tokens import starts_quoted, unquote


def is_url_like(t: str) -> str:
    return f"(contains({t}, '://') OR contains({t}, '?') AND contains({t}, '='))"


def colon_at(t: str) -> str:
    """Place of the splitting colon, 0 when there is none.

    In a token that starts with a quote it is the first colon after the closing
    quote; without a closing quote, the first colon.
    """
    close = f"locate(left({t}, 1), {t}, 2)"
    return (
        f"CASE WHEN NOT contains({t}, ':') THEN 0"
        f" WHEN {starts_quoted(t)} AND {close} > 0 THEN locate(':', {t}, {close} + 1) ELSE locate(':', {t}) END"
    )


def equal_body(t: str) -> str:
    """The text an ``=`` pair is split in: quoted pairs are split inside the quotes."""
    return f"CASE WHEN {starts_quoted(t)} THEN {unquote(t)} ELSE {t} END"


def before(t: str, mark: str) -> str:
    return f"left({t}, locate('{mark}', {t}) - 1)"


def after(t: str, mark: str) -> str:
    return f"substring({t}, locate('{mark}', {t}) + 1)"


def pair_key(t: str, colon: str) -> str:
    """The key candidate of a token: before ``=``, before the splitting colon, or all of it."""
    return (
        f"CASE WHEN contains({t}, '=') THEN {before(equal_body(t), '=')}"
        f" WHEN {colon} > 0 THEN {unquote(f'left({t}, {colon} - 1)')} ELSE {unquote(t)} END"
    )


def pair_value(t: str, colon: str) -> str:
    """What follows the key, NULL for a token that is no pair."""
    return (
        f"CASE WHEN contains({t}, '=') THEN {after(equal_body(t), '=')}"
        f" WHEN {colon} > 0 THEN substring({t}, {colon} + 1) END"
    )


def pair_form(t: str, colon: str) -> str:
    """'equal', 'colon', 'image' (colon inside an image name, kept whole) or 'single'."""
    return (
        f"CASE WHEN contains({t}, '=') THEN 'equal' WHEN {colon} = 0 THEN 'single'"
        f" WHEN {is_registry_image(t)} THEN 'image' ELSE 'colon' END"
    )
