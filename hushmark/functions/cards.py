"""Card numbers: Luhn-valid digit groups inside a line."""

from __future__ import annotations

from .. import fixed
from .sqltext import let, lit

_LO, _HI = fixed.CARD_MIN_DIGITS, fixed.CARD_MAX_DIGITS
LONG_RUN = rf"[0-9](?:[ -]?[0-9]){{{_LO - 1}}}"
RUN_OR_TEXT = r"[0-9](?:[ -]?[0-9])*+|[^0-9]++"
_STRETCH = 256  # pieces summed in one go
CHUNK = 4096  # characters of a long line that are looked at together
_NONE = "''"
RUNS = "ARRAY<STRUCT<at: INT, run: STRING, start: BOOLEAN, stop: BOOLEAN>>"
RANGES = "ARRAY<STRUCT<start: INT, stop: INT>>"


def may_hold_card(line: str) -> str:
    return f"{line} RLIKE {lit(LONG_RUN)}"


def digits_of(text: str) -> str:
    return f"translate({text}, ' -', '')"


def distinct_digits(digits: str) -> str:
    return f"size(array_distinct(split({digits}, '')))"


def is_card(digits: str) -> str:
    """Length, variety and checksum of a digit string."""
    return (
        f"octet_length({digits}) BETWEEN {_LO} AND {_HI}"
        f" AND {distinct_digits(digits)} >= {fixed.CARD_MIN_DISTINCT} AND luhn_check({digits})"
    )


def open_boundary(near: str, far: str) -> str:
    """May a number start or end next to character ``near`` (``far`` is one further)?"""
    return (
        rf"""NOT ({near} RLIKE '[\\p{{L}}\\p{{Nd}}]' OR {near} IN ('-', '.') AND {far} RLIKE '\\p{{L}}')"""
    )


def runs(line: str) -> str:
    """ARRAY of (at, run, start, stop): connected digits (single blanks and dashes between)
    long enough for a card, their 1-based place, and whether a card may start and stop at their ends."""

    def long_ones(ps: str) -> str:
        # only a letter two characters away matters, and letters stand in the neighbouring piece
        before, after = f"right({ps}[i - 1], 2)", f"left({ps}[i + 1], 2)"
        start = f"(i = 0 OR {open_boundary(f'right({before}, 1)', f'CASE WHEN char_length({ps}[i - 1]) > 1 THEN left({before}, 1) ELSE {_NONE} END')})"
        stop = f"(i + 1 = size({ps}) OR {open_boundary(f'left({after}, 1)', f'substring({after}, 2, 1)')})"
        long = f"char_length({ps}[i]) >= {_LO} AND {ps}[i] RLIKE '\\\\A[0-9]' AND octet_length({digits_of(f'{ps}[i]')}) >= {_LO}"
        # places are summed only where a run is long enough
        return let(
            f"filter(sequence(0, size({ps}) - 1), i -> {long})",
            lambda ix: f"CASE WHEN size({ix}) = 0 THEN CAST(array() AS {RUNS}) ELSE "
            + let(
                _places(ps, 0),
                lambda at: f"transform({ix}, i -> named_struct('at', {at}[i] + 1, 'run', {ps}[i], 'start', {start}, 'stop', {stop}))",
            )
            + " END",
        )

    return let(f"regexp_extract_all({line}, {lit(RUN_OR_TEXT)}, 0)", long_ones)


def _places(groups: str, gap: int) -> str:
    """ARRAY of where each piece starts, from 0, with ``gap`` characters between two: running sums, in stretches."""
    step = f"named_struct('n', acc.n + char_length(g) + {gap}, 'b', concat(acc.b, array(acc.n)))"
    part = f"aggregate(slice({groups}, j * {_STRETCH} + 1, {_STRETCH}), named_struct('n', o.s.n, 'b', CAST(array() AS ARRAY<INT>)), (acc, g) -> {step})"
    return (
        f"aggregate(sequence(0, (size({groups}) - 1) DIV {_STRETCH}),"
        " named_struct('s', named_struct('n', 0, 'b', CAST(array() AS ARRAY<INT>)), 'd', CAST(array() AS ARRAY<ARRAY<INT>>)),"
        f" (o, j) -> named_struct('s', {part}, 'd', concat(o.d, array(o.s.b))), o -> flatten(concat(o.d, array(o.s.b))))"
    )


def candidates(run: str) -> str:
    """ARRAY of (start, stop, digits): every 13–19 digit window of one of ``runs`` whose
    ends are free; ``stop`` is exclusive.

    A window starts with a group of digits and ends with one, and each group has a digit, so
    from every group on at most 19 need to be looked at, however long the run is.
    """
    ends = "ARRAY<STRUCT<last: INT, digits: STRING>>"

    def windows(r: str) -> str:
        near = f"slice({r}.g, i, {_HI})"
        fits = f"octet_length(d) BETWEEN {_LO} AND {_HI} AND (i + acc.n < size({r}.g) OR {run}.stop)"
        grown = (
            f"transform(array(concat(acc.d, x)), d -> named_struct('d', d, 'n', acc.n + 1,"
            f" 'o', CASE WHEN {fits} THEN concat(acc.o, array(named_struct('last', i + acc.n, 'digits', d))) ELSE acc.o END))[0]"
        )
        found = (
            f"aggregate({near}, named_struct('d', '', 'n', 0, 'o', CAST(array() AS {ends})),"
            f" (acc, x) -> CASE WHEN octet_length(acc.d) + octet_length(x) > {_HI} THEN named_struct('d', repeat('0', {_HI}), 'n', acc.n, 'o', acc.o) ELSE {grown} END, acc -> acc.o)"
        )
        starts = f"filter(sequence(1, size({r}.g)), i -> (i > 1 OR {run}.start) AND octet_length({r}.g[i - 1]) <= {_HI})"
        window = (
            f"named_struct('start', {run}.at + {r}.p[i - 1], 'stop', {run}.at + {r}.p[w.last - 1] + char_length({r}.g[w.last - 1]), 'digits', w.digits)"
        )
        return f"flatten(transform({starts}, i -> transform({found}, w -> {window})))"

    groups = f"regexp_extract_all({run}.run, '[0-9]++', 0)"
    return let(let(groups, lambda g: f"named_struct('g', {g}, 'p', {_places(g, 1)})"), windows)


def chunks(line: str) -> str:
    """ARRAY of the characters of a line, ``CHUNK`` at a time, for ``cut``."""
    return f"CASE WHEN char_length({line}) <= {CHUNK} THEN array({line}) ELSE transform(sequence(0, (char_length({line}) - 1) DIV {CHUNK}), j -> substring({line}, j * {CHUNK} + 1, {CHUNK})) END"


def cut(chunked: str, start: str, stop: str) -> str:
    """Characters ``start`` (from 1) to ``stop`` (exclusive): a long line is not read from its beginning each time."""
    first, last = f"(({start} - 1) DIV {CHUNK})", f"(({stop} - 2) DIV {CHUNK})"
    near = f"CASE WHEN {first} = {last} THEN get({chunked}, {first}) ELSE array_join(slice({chunked}, {first} + 1, {last} - {first} + 1), '') END"
    return f"CASE WHEN {stop} <= {start} THEN '' ELSE substring({near}, {start} - {first} * {CHUNK}, {stop} - {start}) END"


def merge(ranges: str) -> str:
    """Union of touching ranges, given in start order."""
    last = "acc[size(acc) - 1]"
    joined = (
        f"concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', {last}.start,"
        f" 'stop', greatest({last}.stop, r.stop))))"
    )
    return (
        f"aggregate({ranges}, CAST(array() AS {RANGES}), (acc, r) -> CASE"
        f" WHEN size(acc) = 0 OR r.start > {last}.stop THEN concat(acc, array(r)) ELSE {joined} END)"
    )


def card_ranges(line: str) -> str:
    """Merged card ranges of a line, in order; empty without a long digit run."""
    per_run = candidates("g")
    hits = (
        f"transform(filter(flatten(transform({runs(line)}, g -> {per_run})), w -> {is_card('w.digits')}),"
        " w -> named_struct('start', w.start, 'stop', w.stop))"
    )
    ordered = f"array_sort({hits})"
    return f"CASE WHEN {may_hold_card(line)} THEN {merge(ordered)} ELSE CAST(array() AS {RANGES}) END"
