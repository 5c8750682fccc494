"""One line → its leaves → its redacted text, as a single Spark SQL expression.

A leaf is a stretch of the line that is decided on its own. The line is opened
step by step: card numbers are cut out, segments become tokens, tokens become
pairs, quoted values and URLs are opened again, until only leaves are left.
Nothing here needs a join, a window or a shuffle, so the same expression runs
in batch, inside nested columns and in a stream.

Leaf fields: ``m`` mode, ``p`` literal text before, ``c`` content that is
judged, ``o`` original text that is written when the content stays, ``a``
whether a bare number or literal gets quotes when replaced, ``s`` text after.
"""

from __future__ import annotations

from .. import fixed
from ..functions import cards, keys, pairs, pseudonym, rules, scores, shapes, tokens
from ..functions.sqltext import let, lit
from ..options import Options

# Leaf modes. From SEGMENT on the leaf is still to be opened: a segment, a URL
# with a query, a nested token, a nested token whose key counts as sensitive.
LITERAL, PLAIN, CONTEXT, FORCED, URL_VALUE, URL_KEYED, CARD, SEGMENT, QUERY, TOKEN, TOKEN_RAISED = range(11)

LEAF = "STRUCT<m: INT, p: STRING, c: STRING, o: STRING, a: BOOLEAN, s: STRING>"
_STRETCH = 512  # tokens folded in one go
_FIRST_FLAG = 65


def leaf(mode, p: str = "''", c: str = "''", o: str | None = None, a: str = "false", s: str = "''") -> str:
    return (
        f"named_struct('m', {mode}, 'p', {p}, 'c', {c}, 'o', {c if o is None else o}, 'a', {a}, 's', {s})"
    )


# --- token facts and the state that links tokens -----------------------------


def _facts(ln: str, options: Options) -> str:
    """ARRAY of what each token of ``ln`` is, independent of the others.

    sep separators before it, t the token, b and eq the body an ``=`` splits and
    its place, col the splitting colon, es ends in ``:`` or ``=``, bl blank, cl
    cleaned text, k its key is sensitive, ctx it is a context word. cl, k and
    ctx are worked out only where the line can need them.
    """
    split = f"CASE WHEN {ln}.mode >= {TOKEN} THEN array({ln}.x) ELSE {tokens.pieces(f'{ln}.x')} END"
    token = f"CASE WHEN {ln}.mode >= {TOKEN} THEN p ELSE {tokens.piece_token('p')} END"
    first = f"transform({split}, p -> named_struct('x', p, 't', {token}))"
    second = (
        f"transform({first}, f -> named_struct('x', f.x, 't', f.t, 'col', {pairs.colon_at('f.t')},"
        f" 'b', CASE WHEN contains(f.t, '=') THEN {pairs.equal_body('f.t')} END, 'w', {tokens.trim_space('f.t')}))"
    )
    key = (
        f"CASE WHEN NOT {ln}.key OR {pairs.is_url_like('f.t')} THEN NULL WHEN f.b IS NOT NULL THEN {pairs.before('f.b', '=')}"
        f" WHEN f.col = 0 THEN {tokens.unquote('f.t')} WHEN {shapes.is_registry_image('f.t')} THEN NULL"
        f" ELSE {tokens.unquote('left(f.t, f.col - 1)')} END"
    )
    third = (
        f"transform({second}, f -> named_struct('sep', left(f.x, char_length(f.x) - char_length(f.t)), 't', f.t,"
        f" 'b', f.b, 'eq', locate('=', f.b), 'col', f.col, 'es', {tokens.ends_with_mark('f.w')}, 'bl', f.w = '',"
        f" 'st', CASE WHEN {ln}.key OR {ln}.ctx THEN {tokens.stem('f.w')} END, 'kc', {key}))"
    )
    cleaned = tokens.unquote("f.st")
    return (
        f"transform({third}, f -> named_struct('sep', f.sep, 't', f.t, 'b', f.b, 'eq', f.eq, 'col', f.col, 'es', f.es, 'bl', f.bl,"
        f" 'cl', {cleaned},"
        f" 'k', CASE WHEN f.kc IS NULL THEN false ELSE {keys.is_sensitive_key('f.kc', options)} END,"
        f" 'ctx', CASE WHEN {ln}.ctx THEN {keys.is_context_word(f'lower({cleaned})')} ELSE false END))"
    )


def _is_key() -> str:
    """Does token ``f`` announce a secret value, given the state ``acc``?"""
    equal = f"f.eq = char_length(f.b) AND (f.k OR acc.n AND NOT {tokens.starts_quoted('f.t')})"
    return (
        f"CASE WHEN NOT (f.k OR acc.n) OR {pairs.is_url_like('f.t')} THEN false"
        f" WHEN f.b IS NOT NULL THEN {equal}"
        f" WHEN f.col > 0 THEN NOT {shapes.is_registry_image('f.t')}"
        " ELSE NOT acc.v END"
    )


def _fold_step(options: Options) -> str:
    """Next state, and the flags the token is judged under.

    State: k a value is expected to be secret, c after a context word, v in
    value position, g after a generic key name, n the next key is sensitive;
    b collects one flag character per token.
    """
    code = (
        f"char({_FIRST_FLAG} + CASE WHEN acc.k THEN 1 ELSE 0 END + CASE WHEN acc.c THEN 2 ELSE 0 END"
        " + CASE WHEN acc.v THEN 4 ELSE 0 END + CASE WHEN acc.n THEN 8 ELSE 0 END)"
    )
    names_key = f"acc.v AND acc.g AND f.cl IS NOT NULL AND {keys.is_sensitive_key('f.cl', options)}"
    return (
        f"transform(array({_is_key()}), key -> named_struct("
        "'k', key OR (NOT acc.v AND acc.k),"
        " 'c', f.ctx,"
        " 'v', CASE WHEN f.bl THEN acc.v ELSE f.es END,"
        f" 'g', CASE WHEN key THEN {keys.is_generic_name('lower(f.cl)')} ELSE NOT acc.v AND acc.g END,"
        f" 'n', CASE WHEN key THEN false ELSE acc.n OR {names_key} END,"
        f" 'b', array_join(array(acc.b, {code}), '')))[0]"
    )


def _flags(facts: str, options: Options) -> str:
    """One flag character per token.

    The fold runs in stretches of a fixed number of tokens: a stretch grows its
    own short flag string and hands its last state on, so that very long lines
    cost no more per token than short ones.
    """
    blank = "named_struct('k', false, 'c', false, 'v', false, 'g', false, 'n', false, 'b', '')"
    resume = "named_struct('k', o.s.k, 'c', o.s.c, 'v', o.s.v, 'g', o.s.g, 'n', o.s.n, 'b', '')"
    stretch = (
        f"aggregate(slice({facts}, i * {_STRETCH} + 1, {_STRETCH}), {resume}, (acc, f) -> {_fold_step(options)})"
    )
    return (
        f"split(aggregate(sequence(0, greatest(size({facts}) - 1, 0) DIV {_STRETCH}),"
        f" named_struct('s', {blank}, 'd', CAST(array() AS ARRAY<STRING>)),"
        f" (o, i) -> named_struct('s', {stretch}, 'd', concat(o.d, array(o.s.b))),"
        " o -> concat(array_join(o.d, ''), o.s.b)), '')"
    )


# --- opening -----------------------------------------------------------------


def _token_leaf(f: str, bits: str) -> str:
    """Leaf of one token, given its facts and flags."""
    t, sep = f"{f}.t", f"{f}.sep"
    forced, context = f"({bits} & 1) = 1", f"({bits} & 2) = 2"
    in_value, override = f"({bits} & 4) = 4", f"({bits} & 8) = 8"
    judged = f"CASE WHEN {forced} THEN {FORCED} WHEN {context} THEN {CONTEXT} ELSE {PLAIN} END"
    announces = f"NOT ({in_value}) AND ({f}.k OR {override})"

    url = f"CASE WHEN contains({t}, '?') THEN {leaf(QUERY, sep, t)} ELSE {leaf(LITERAL, sep, t)} END"

    quote = f"CASE WHEN {tokens.is_quoted(t)} THEN left({t}, 1) ELSE '' END"
    value = f"substring({f}.b, {f}.eq + 1)"
    equal_mode = (
        f"CASE WHEN {f}.k OR ({override} AND NOT {tokens.starts_quoted(t)}) THEN {FORCED}"
        f" WHEN locate('=', {f}.b, {f}.eq + 1) > 0 OR locate(':', {f}.b, {f}.eq + 1) > 0"
        f" THEN CASE WHEN {override} THEN {TOKEN_RAISED} ELSE {TOKEN} END"
        f" WHEN {tokens.starts_quoted(t)} THEN {SEGMENT} ELSE {PLAIN} END"
    )
    equal = leaf(equal_mode, f"concat({sep}, {quote}, left({f}.b, {f}.eq))", value, s=quote)

    colon = (
        f"CASE WHEN {f}.col = char_length({t}) OR {shapes.is_registry_image(t)} THEN {leaf(LITERAL, sep, t)} ELSE "
        + leaf(
            f"CASE WHEN {f}.k OR {override} THEN {FORCED} ELSE {PLAIN} END",
            f"concat({sep}, left({t}, {f}.col))",
            f"substring({t}, {f}.col + 1)",
        )
        + " END"
    )
    word = leaf(f"CASE WHEN {announces} THEN {LITERAL} ELSE {judged} END", sep, t, a="true")
    inner = tokens.unquote(t)
    # A quoted value that is one bare word needs no opening: it is a fresh single token.
    one_word = f"NOT {inner} RLIKE {lit('[' + tokens.SEP_CLASS + '=:?' + chr(34) + chr(39) + ']')}"
    quote_before = f"concat({sep}, left({t}, 1))"
    quoted = (
        f"CASE WHEN {announces} THEN {leaf(LITERAL, sep, t)}"
        f" WHEN {in_value} AND NOT ({forced}) AND {tokens.is_quoted(t)} THEN "
        + leaf(
            f"CASE WHEN NOT {one_word} THEN {SEGMENT} WHEN {f}.k THEN {LITERAL} ELSE {PLAIN} END",
            quote_before,
            inner,
            a="true",
            s=f"right({t}, 1)",
        )
        + f" ELSE {leaf(judged, sep, inner, o=t, a='true')} END"
    )
    return (
        f"CASE WHEN {f}.b IS NULL AND {f}.col = 0 AND NOT {tokens.starts_quoted(t)} THEN {word}"
        f" WHEN {pairs.is_url_like(t)} THEN {url}"
        f" WHEN {f}.b IS NOT NULL THEN {equal}"
        f" WHEN {f}.col > 0 THEN {colon} ELSE {quoted} END"
    )


def _open_segment(x: str, options: Options) -> str:
    """Leaves of a segment or of one nested token; the token state starts fresh.

    Without a key fragment, a context word and a quote no token can influence
    another, and the fold over the state is skipped.
    """
    line = line_facts(f"{x}.c", f"{x}.m", options)

    def opened(ln: str) -> str:
        return let(
            _facts(ln, options),
            lambda fs: f"zip_with({fs}, CASE WHEN {ln}.mode = {TOKEN_RAISED} THEN array('{chr(_FIRST_FLAG + 8)}')"
            f" WHEN {ln}.mode <> {TOKEN} AND ({ln}.key OR {ln}.ctx OR {ln}.quote) THEN {_flags(fs, options)}"
            f" ELSE array_repeat('{chr(_FIRST_FLAG)}', size({fs})) END,"
            f" (ft, fl) -> {_token_leaf('ft', f'(ascii(fl) - {_FIRST_FLAG})')})",
        )

    return let(line, opened)


def line_facts(text: str, mode: str, options: Options) -> str:
    """STRUCT(x, mode, key, ctx, quote): the text and what its tokens can be."""
    return let(
        f"lower({text})",
        lambda low: f"named_struct('x', {text}, 'mode', {mode}, 'key', {keys.may_hold_key(low, options)},"
        f" 'ctx', {keys.may_hold_context(low)}, 'quote', {_has_quote(text)})",
    )


def _has_quote(text: str) -> str:
    return f"""(contains({text}, '"') OR contains({text}, '\\''))"""


def _open_query(url: str, options: Options) -> str:
    """Leaves of a URL: the base, then one leaf per parameter."""
    base = f"left({url}, locate('?', {url}))"
    query = f"split(substring({url}, locate('?', {url}) + 1), '&')"
    amp = "CASE WHEN i > 0 THEN '&' ELSE '' END"
    keyed = f"transform(array({pairs.before('kv', '=')}), k -> {keys.is_sensitive_key('k', options)})[0]"
    param = (
        f"CASE WHEN contains(kv, '=') THEN "
        + leaf(
            f"CASE WHEN {keyed} THEN {URL_KEYED} ELSE {URL_VALUE} END",
            f"concat({amp}, left(kv, locate('=', kv)))",
            pairs.after("kv", "="),
        )
        + f" ELSE {leaf(LITERAL, amp, 'kv')} END"
    )
    return f"concat(array({leaf(LITERAL, c=base)}), transform({query}, (kv, i) -> {param}))"


def _cut_cards(line: str) -> str:
    """Segments and cards of a line, in order."""

    def cut(r: str) -> str:
        def parts(ch: str) -> str:
            text = cards.cut(ch, f"coalesce(get({r}, i - 1).stop, 1)", f"{r}[i].start")
            card = cards.cut(ch, f"{r}[i].start", f"{r}[i].stop")
            each = f"array({leaf(SEGMENT, c=text)}, {leaf(CARD, c=card)})"
            tail = leaf(SEGMENT, c=f"substring({line}, {r}[size({r}) - 1].stop)")
            return f"concat(flatten(transform(sequence(0, size({r}) - 1), i -> {each})), array({tail}))"

        return f"CASE WHEN size({r}) = 0 THEN array({leaf(SEGMENT, c=line)}) ELSE {let(cards.chunks(line), parts)} END"

    return let(cards.card_ranges(line), cut)


def leaves(line: str, options: Options) -> str:
    """ARRAY of leaves of a valid UTF-8 line; their texts joined give the line back.

    Opening repeats until nothing is left to open. Whatever is opened loses a
    pair of quotes, an ``=`` or a query mark, so the token with most of these
    bounds the rounds.
    """
    opened = (
        f"CASE WHEN x.m = {QUERY} THEN {_open_query('x.c', options)} ELSE {_open_segment('x', options)} END"
    )
    none = f"CAST(array() AS ARRAY<{LEAF}>)"
    around = (
        f"CASE WHEN x.m < {SEGMENT} THEN array(x) ELSE concat("
        f"CASE WHEN x.p = '' THEN {none} ELSE array({leaf(LITERAL, 'x.p')}) END, {opened},"
        f" CASE WHEN x.s = '' THEN {none} ELSE array({leaf(LITERAL, 'x.s')}) END) END"
    )
    return (
        f"aggregate(sequence(1, {_rounds(line)}), CAST({_cut_cards(line)} AS ARRAY<{LEAF}>),"
        f" (items, r) -> CASE WHEN exists(items, y -> y.m >= {SEGMENT})"
        f" THEN flatten(transform(items, x -> {around})) ELSE items END)"
    )


def _rounds(line: str) -> str:
    """How often leaves of a line may have to be opened, the line itself included."""

    def measure(t: str) -> str:
        quotes = f"(octet_length({t}) - octet_length(translate({t}, '\"\\'', '')))"
        equals = f"(octet_length({t}) - octet_length(replace({t}, '=', '')))"
        return f"{equals} + {quotes} DIV 2 + CASE WHEN contains({t}, '?') THEN 1 ELSE 0 END"

    # Cutting out a card changes where quotes pair up: then the whole line counts.
    per_token = f"array_max(transform({tokens.pieces(line)}, p -> {measure('p')}))"
    return (
        f"CASE WHEN NOT ({_has_quote(line)} OR contains({line}, '=') OR contains({line}, '?')) THEN 1"
        f" WHEN {cards.may_hold_card(line)} THEN 2 + {measure(line)} ELSE 1 + coalesce({per_token}, 0) END"
    )


# --- deciding ----------------------------------------------------------------


def threshold_of(x: str, options: Options, plain: str | None = None) -> str:
    """Score limit of a leaf; ``plain`` replaces the base for unmarked leaves."""
    base = f"{options.entropy_threshold}D"
    context = f"{round(options.entropy_threshold - fixed.CONTEXT_DISCOUNT, 9)}D"
    return (
        f"CASE {x}.m WHEN {FORCED} THEN {fixed.FORCED_THRESHOLD}D WHEN {CONTEXT} THEN {context}"
        f" WHEN {URL_VALUE} THEN {base} ELSE {plain or base} END"
    )


def _long_enough(x: str, options: Options) -> str:
    return (
        f"({x}.m IN ({FORCED}, {URL_VALUE}) OR octet_length({x}.c) >= {options.min_secret_length}"
        f" AND NOT contains({x}.c, ' '))"
    )


def _scored_hidden(x: str, options: Options, plain: str | None) -> str:
    """Hidden because of the score; short and plain-looking leaves never get that far."""
    over = scores.exceeds(f"{x}.c", f"({threshold_of(x, options, plain)})", options)
    return (
        f"CASE WHEN {x}.m = {LITERAL} THEN false WHEN {x}.m IN ({URL_KEYED}, {CARD}) THEN true"
        f" WHEN NOT {_long_enough(x, options)} THEN false"
        f" WHEN NOT ({over}) THEN false"
        f" ELSE {x}.m = {URL_VALUE} OR NOT {shapes.is_safe(f'{x}.c', options)} END"
    )


def rule_name(x: str, options: Options) -> str:
    """Name of the user rule that replaces the leaf, NULL when none does."""
    if not options.custom_rules:
        return "CAST(NULL AS STRING)"
    return (
        f"CASE WHEN {x}.m IN ({PLAIN}, {CONTEXT}, {FORCED}) THEN "
        + let(
            rules.rule_hit(f"{x}.c", options),
            lambda h: f"CASE WHEN {h} IS NOT NULL AND NOT {shapes.is_safe(f'{x}.c', options)} THEN {h}.name END",
        )
        + " END"
    )


def _quoted(x: str, mark: str) -> str:
    """The placeholder, in double quotes where the original value had quotes or
    was a bare number or literal that must stay a value."""
    bare = rf"({x}.a AND ({x}.c RLIKE '\\A\\p{{Nd}}*\\z' OR lower({x}.c) IN ('true', 'false', 'null')))"
    quotes = f"({x}.m IN ({PLAIN}, {CONTEXT}, {FORCED}) AND ({tokens.starts_quoted(f'{x}.o')} OR {bare}))"
    return let(mark, lambda m: f"CASE WHEN {quotes} THEN concat('\"', {m}, '\"') ELSE {m} END")


def _rule_mark(name: str) -> str:
    return f"CASE WHEN {name} = '' THEN '[HIDDEN]' ELSE concat('[HIDDEN:', {name}, ']') END"


def _out(x: str, options: Options, plain: str | None) -> str:
    hashed = _quoted(x, pseudonym.placeholder(f"{x}.c"))
    scored = f"CASE WHEN {_scored_hidden(x, options, plain)} THEN {hashed} ELSE {x}.o END"
    if not options.custom_rules:
        return scored
    return let(
        rule_name(x, options),
        lambda n: f"CASE WHEN {n} IS NOT NULL THEN {_quoted(x, _rule_mark(n))} ELSE {scored} END",
    )


def _plain_limit(adaptive: tuple[str, str] | None, options: Options) -> str | None:
    """Base limit of leaf number i when a source baseline is attached."""
    if adaptive is None:
        return None
    limit, first = adaptive
    return f"CASE WHEN i >= {first} THEN {limit} ELSE {options.entropy_threshold}D END"


def _bare(line: str, options: Options) -> str:
    """The line holds bare words only: no key, pair, quote, card or context word,
    so every token is judged on its own against the base threshold."""
    if options.custom_rules or options.key_patterns or options.adaptive:
        return "false"
    words_only = let(
        f"lower({line})",
        lambda low: f"NOT ({keys.may_hold_key(low, options)} OR {keys.may_hold_context(low)})",
    )
    marks = f"{_has_quote(line)} OR contains({line}, '=') OR contains({line}, ':') OR {cards.may_hold_card(line)}"
    return f"CASE WHEN {marks} THEN false ELSE {words_only} END"


def _bare_hits(line: str, options: Options) -> str:
    """ARRAY of the tokens of a bare line that are hidden.

    Words that are too short for their kind to reach the threshold are not even
    extracted; in prose that is nearly all of them.
    """
    limit = options.entropy_threshold
    sep = tokens.SEP_CLASS
    rare = scores.rare_pairs(options)
    gain = rare is None
    guard = rf"(?!(?i:{'|'.join(rare)}))" if rare else ""
    low, up = rf"(?:{guard}\p{{Ll}})", rf"{guard}\p{{Lu}}"
    one, two, three = (scores.longest_quiet(n, limit, gain) for n in (1, 2, 3))
    short = []
    if one >= 1:
        short.append(rf"{low}{{1,{one}}}+")
    if two >= 2:
        short += [rf"{up}{low}{{1,{two - 1}}}+", rf"{low}{{1,{two - 1}}}+\p{{P}}"]
    if three >= 3:
        short.append(rf"{up}{low}{{1,{three - 2}}}+\p{{P}}")
    skip = f"(?!(?:{'|'.join(short)})(?:[{sep}]|\\z))" if short else ""
    least = scores.longest_quiet(4, limit, options.bigram_check) + 1
    word = rf"(?<![^{sep}]){skip}[^{sep}]{{{least},}}+"
    scored = (
        f"octet_length(t) >= {options.min_secret_length} AND {scores.exceeds('t', f'{limit}D', options)}"
        f" AND NOT {shapes.is_safe('t', options)}"
    )
    return f"filter(regexp_extract_all({line}, {lit(word)}, 0), t -> {scored})"


def _bare_redacted(line: str, options: Options) -> str:
    """A bare line with its hits replaced; without a hit it is returned as it is."""
    token = tokens.piece_token("p")
    x = f"named_struct('m', {PLAIN}, 'c', {token}, 'o', {token}, 'a', true)"
    put = let(
        x,
        lambda v: f"CASE WHEN array_contains(hits, {v}.c) THEN concat(left(p, char_length(p) - char_length({v}.c)),"
        f" {_quoted(v, pseudonym.placeholder(f'{v}.c'))}) ELSE p END",
    )
    return (
        f"transform(array({_bare_hits(line, options)}), hits -> CASE WHEN size(hits) = 0 THEN {line}"
        f" ELSE array_join(transform({tokens.pieces(line)}, p -> {put}), '') END)[0]"
    )


def redact(text: str, options: Options, adaptive: tuple[str, str] | None = None) -> str:
    """The redacted line. Needs the key columns of ``pseudonym.with_key``.

    ``adaptive``: SQL of a source's own limit and of the first leaf number it
    applies to (NULL: never).
    """
    plain = _plain_limit(adaptive, options)

    def body(line: str) -> str:
        done = f"flatten(transform({leaves(line, options)}, (x, i) -> array(x.p, {_out('x', options, plain)}, x.s)))"
        return (
            f"CASE WHEN {line} = '' THEN {line} WHEN {_bare(line, options)} THEN {_bare_redacted(line, options)}"
            f" ELSE array_join({done}, '') END"
        )

    return let(tokens.repair(text), body)


FINDING = "STRUCT<pos: INT, kind: STRING, rule: STRING, mark: STRING, secret: STRING>"
KINDS = {PLAIN: "entropy", CONTEXT: "context", FORCED: "key", URL_VALUE: "url", URL_KEYED: "url", CARD: "card"}


def findings(text: str, options: Options, adaptive: tuple[str, str] | None = None) -> str:
    """ARRAY of what is hidden in a line, in order: number, kind, rule name, placeholder, secret."""
    plain = _plain_limit(adaptive, options)
    kind = "CASE x.m " + " ".join(f"WHEN {m} THEN '{k}'" for m, k in KINDS.items()) + " END"
    null = "CAST(NULL AS STRING)"

    def struct(k: str, rule: str, mark: str) -> str:
        return f"named_struct('kind', {k}, 'rule', {rule}, 'mark', {mark}, 'secret', x.c)"

    scored = (
        f"CASE WHEN {_scored_hidden('x', options, plain)} THEN "
        + struct(kind, null, pseudonym.placeholder("x.c"))
        + " END"
    )
    if options.custom_rules:
        found = let(
            rule_name("x", options),
            lambda n: f"CASE WHEN {n} IS NOT NULL THEN {struct(lit('rule'), n, _rule_mark(n))} ELSE {scored} END",
        )
    else:
        found = scored

    def body(line: str) -> str:
        hits = f"filter(transform({leaves(line, options)}, (x, i) -> {found}), y -> y IS NOT NULL)"
        fields = "'kind', y.kind, 'rule', y.rule, 'mark', y.mark, 'secret', y.secret"
        all_found = f"transform({hits}, (y, i) -> named_struct('pos', i, {fields}))"
        alone = (
            f"transform({_bare_hits(line, options)}, (t, i) -> named_struct('pos', i, 'kind', '{KINDS[PLAIN]}',"
            f" 'rule', {null}, 'mark', {pseudonym.placeholder('t')}, 'secret', t))"
        )
        return f"CASE WHEN {_bare(line, options)} THEN {alone} ELSE {all_found} END"

    return let(tokens.repair(text), body)


def kept_tokens(text: str, options: Options) -> str:
    """ARRAY of (pos, token) of leaves that are scored and kept: baseline samples,
    still without their score. In a bare line every piece is a leaf."""
    scored = (
        f"{_long_enough('z.x', options)} AND NOT {shapes.is_safe('z.x.c', options)} AND {rules.rule_hit('z.x.c', options)} IS NULL"
        f" AND NOT ({scores.exceeds('z.x.c', '(' + threshold_of('z.x', options) + ')', options)})"
    )

    def body(line: str) -> str:
        token = tokens.piece_token("p")
        bare = f"transform({tokens.pieces(line)}, (p, i) -> named_struct('i', i, 'x', named_struct('m', {PLAIN}, 'c', {token})))"
        full = f"transform({leaves(line, options)}, (x, i) -> named_struct('i', i, 'x', named_struct('m', x.m, 'c', x.c)))"
        return (
            f"transform(filter(CASE WHEN {_bare(line, options)} THEN {bare} ELSE {full} END,"
            f" z -> z.x.m IN ({PLAIN}, {CONTEXT}) AND {scored}), z -> named_struct('pos', z.i, 'token', z.x.c))"
        )

    return let(tokens.repair(text), body)
