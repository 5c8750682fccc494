"""DuckDB SQL building blocks, written as relations over lines, tokens and leaves."""

from __future__ import annotations

from hushmark import fixed
from hushmark.options import Options
from hushmark.sources import derived

GUARD = "1e-9"


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SEP = r" \t,;\[\]{}()<>"
TOKEN = (
    rf"""(?s)[{SEP}]|(?:[^{SEP}"']|"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\z)|'[^'\\]*(?:\\.[^'\\]*)*(?:'|\\?\z))+"""
)
BG = "MAP {" + ", ".join(f"'{k}': {round(v * 10)}" for k, v in fixed.BIGRAMS.items()) + "}"
WS = "".join(dict.fromkeys(fixed.WHITE_SPACE))

SAFE = (
    ("scheme", "contains({t}, '://')"),
    ("uuid", r"regexp_matches({t}, '\A[0-9A-Fa-f]{{8}}(?:-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}\z')"),
    ("ipv6", r"(regexp_matches({t}, '\A[0-9A-Fa-f:]+\z') AND length({t}) - length(replace({t}, ':', '')) >= 2)"),
    ("unix_time", r"(length({t}) = 10 AND regexp_matches({t}, '\A[0-9]+\z') AND left({t}, 2) IN ('17', '18', '19', '20'))"),
    ("iso_date", r"(strlen({t}) >= 10 AND regexp_matches({t}, '\A[0-9]{{4}}-[0-9]{{2}}-'))"),
    ("registry", "(contains({t}, 'docker.io') OR contains({t}, 'gcr.io') OR contains({t}, 'quay.io'))"),
    ("path", r"(starts_with({t}, '/') OR starts_with({t}, './') OR starts_with({t}, '../') OR regexp_matches({t}, '\A[A-Za-z]:\\') OR length({t}) - length(replace({t}, '\', '')) >= 2)"),
    ("git_hash", r"regexp_matches({t}, '\A[0-9A-Fa-f]{{40}}\z')"),
    ("object_id", r"regexp_matches({t}, '\A[0-9A-Fa-f]{{24}}\z')"),
    ("ssh", r"(starts_with({t}, 'ssh-') OR (starts_with({t}, 'AAAA') AND length({t}) > 20 AND regexp_matches({t}, '\A[0-9A-Za-z+/=]+\z')))"),
    ("user_name", r"regexp_matches({t}, '\Auser_[0-9A-Fa-f_]{{1,11}}\z')"),
)


def shape(name: str, t: str) -> str:
    return dict(SAFE)[name].format(t=t)


def is_safe(t: str) -> str:
    return "(" + " OR ".join(test.format(t=t) for _, test in SAFE) + ")"


def first_shape(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(t=t)} THEN '{n}'" for n, test in SAFE) + " END"


def entropy(t: str) -> str:
    return f"coalesce(list_aggregate(regexp_extract_all({t}, '(?s).'), 'entropy'), 0)"


def bonus(t: str) -> str:
    flags = " + ".join(
        f"regexp_matches({t}, '{p}')::INT" for p in (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r"[\p{P}\p{S}]")
    )
    return f"greatest({flags} - 1, 0) * 0.5"


def bigram(t: str) -> str:
    low = f"lower({t})"
    total = (
        f"(coalesce(list_sum(list_transform(range(1, length({low})), lambda i: coalesce({BG}[substr({low}, i, 2)], -70))), 0)"
        f" - 70 * (strlen({low}) - length({low})))"
    )
    n = f"(strlen({low}) - 1)"
    return (
        f"CASE WHEN strlen({t}) <= 3 THEN 0 WHEN {total} > -58 * {n} THEN -1.5 WHEN {total} < -70 * {n} THEN 0.5 ELSE 0 END"
    )


def score(t: str) -> str:
    return f"CASE WHEN {t} = '' THEN 0 ELSE {entropy(t)} + {bonus(t)} + ({bigram(t)}) END"


def fragment(t: str) -> str:
    return "(" + " OR ".join(f"contains(lower({t}), '{k}')" for k in fixed.SENSITIVE_KEYS) + ")"


def sensitive(key: str, limit: float = 3.6) -> str:
    return f"({fragment(key)} AND NOT (strlen({key}) > 15 AND {score(key)} > {limit} + {GUARD}))"


def starts_quoted(t: str) -> str:
    return f"(starts_with({t}, '\"') OR starts_with({t}, ''''))"


def is_quoted(t: str) -> str:
    return (
        f"(strlen({t}) >= 2 AND left({t}, 1) = right({t}, 1) AND {starts_quoted(t)})"
    )


def unquote(t: str) -> str:
    return f"CASE WHEN {is_quoted(t)} THEN substr({t}, 2, length({t}) - 2) ELSE {t} END"


def trim_ws(t: str) -> str:
    return f"trim({t}, {s(WS)})"


def clean(t: str) -> str:
    return unquote(f"regexp_replace({trim_ws(t)}, '[:=]\\z', '')")


def url_like(t: str) -> str:
    return f"(contains({t}, '://') OR (contains({t}, '?') AND contains({t}, '=')))"


def colon_at(t: str) -> str:
    rest = f"substr({t}, 2)"
    close = f"instr({rest}, left({t}, 1))"
    after = f"substr({t}, {close} + 2)"
    return (
        f"CASE WHEN {starts_quoted(t)} AND {close} > 0 THEN CASE WHEN contains({after}, ':')"
        f" THEN {close} + 1 + instr({after}, ':') ELSE 0 END ELSE instr({t}, ':') END"
    )


def word_list(words) -> str:
    return "(" + ", ".join(s(w) for w in words) + ")"


def blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


def hmac_hex(m: str, o: Options) -> str:
    inner, outer = o.hmac_pads()
    return f"sha256({blob(outer)} || unhex(sha256({blob(inner)} || encode({m}))))"


def mark(m: str, o: Options) -> str:
    return f"('[HIDDEN:' || left({hmac_hex(m, o)}, 6) || ']')"


# --- line sources -------------------------------------------------------------

DOC_LINES = (
    "SELECT doc_id, lang, source, (t.i - 1)::INT AS line_no, doc_id * 4294967296 + t.i - 1 AS line_id, t.line AS line"
    " FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY t(line, i)"
)
ORDER_LOGS = (
    f"SELECT source, k AS line_id, {derived.LINE_SQL} AS line, {derived.LABEL_SQL} AS label FROM ("
    f"SELECT *, {derived.SECRET_SQL} AS b FROM (SELECT o_orderpriority AS source, o_orderkey AS k,"
    " sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders))"
)


# --- cards ----------------------------------------------------------------------


def card_ctes(lines: str) -> str:
    """CTEs runs, win, cards, ranges over ``lines(line_id, line)``."""
    digits = "regexp_replace(substr(run, i, d + 1), '[ -]', '', 'g')"
    return f"""
runs AS MATERIALIZED (
  SELECT line_id, line, run, off FROM (
    SELECT line_id, line, t.run, 1 + coalesce(sum(length(t.run)) OVER (PARTITION BY line_id ORDER BY t.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS off
    FROM {lines} src, unnest(regexp_extract_all(line, '[0-9](?:[ -]?[0-9])*|[^0-9]+')) WITH ORDINALITY t(run, n)
    WHERE regexp_matches(line, '[0-9]'))
  WHERE length(regexp_replace(run, '[^0-9]', '', 'g')) >= 13 AND regexp_matches(run, '\\A[0-9]')),
win AS MATERIALIZED (
  SELECT line_id, off + i - 1 AS start, off + i + d AS stop, digits FROM (
    SELECT line_id, line, run, off, i, d, {digits} AS digits
    FROM runs, unnest(range(1, length(run) + 1)) a(i), unnest(range(12, 37)) b(d)
    WHERE i + d <= length(run)
      AND regexp_matches(substr(run, i, 1), '[0-9]') AND regexp_matches(substr(run, i + d, 1), '[0-9]')
      AND (i = 1 OR NOT regexp_matches(substr(run, i - 1, 1), '[0-9]'))
      AND (i + d = length(run) OR NOT regexp_matches(substr(run, i + d + 1, 1), '[0-9]')))
  WHERE length(digits) BETWEEN 13 AND 19
    AND NOT (off + i > 2 AND (regexp_matches(substr(line, off + i - 2, 1), '[\\p{{L}}\\p{{Nd}}]')
         OR (substr(line, off + i - 2, 1) IN ('-', '.') AND off + i > 3 AND regexp_matches(substr(line, off + i - 3, 1), '\\p{{L}}'))))
    AND NOT (regexp_matches(substr(line, off + i + d, 1), '[\\p{{L}}\\p{{Nd}}]')
         OR (substr(line, off + i + d, 1) IN ('-', '.') AND regexp_matches(substr(line, off + i + d + 1, 1), '\\p{{L}}')))),
varied AS MATERIALIZED (SELECT *, length(list_aggregate(list_distinct(string_split(digits, '')), 'string_agg', '')) AS n_distinct FROM win
  WHERE len(list_distinct(string_split(digits, ''))) >= 4),
cards AS MATERIALIZED (SELECT * FROM varied WHERE list_sum(list_transform(range(1, length(digits) + 1), lambda i:
    CASE WHEN (length(digits) - i) % 2 = 0 THEN substr(digits, i, 1)::INT
         WHEN substr(digits, i, 1)::INT * 2 > 9 THEN substr(digits, i, 1)::INT * 2 - 9
         ELSE substr(digits, i, 1)::INT * 2 END)) % 10 = 0),
ranges AS MATERIALIZED (
  SELECT line_id, min(start) AS start, max(stop) AS stop FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY line_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY line_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM cards))
  GROUP BY line_id, island)"""


def rule_ctes(src: str, col: str, rules) -> str:
    """hits and best(rn = 1): the deciding user rule of each row of ``src``.

    The place of a match is known by the length of what stands before it.
    """
    each = []
    for i, r in enumerate(rules):
        before = f"regexp_extract({col}, {s('(?s)^(.*?)(?:' + r.pattern + ')')}, 1)"
        place = "1" if r.pattern.startswith("^") else f"length({before}) + 1"
        each.append(
            f"SELECT *, {place} AS rule_pos, {i} AS rule_ord, {s(r.name)} AS rule FROM {src}"
            f" WHERE strlen({col}) >= 5 AND regexp_matches({col}, {s(r.pattern)})"
        )
    return (
        f"hits AS ({' UNION ALL '.join(each)}), best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {col} ORDER BY rule_pos, rule_ord) AS rn FROM hits)"
    )


# --- tokens, state, leaves --------------------------------------------------------

LITERAL, PLAIN, CONTEXT, FORCED, URL_VALUE, URL_KEYED, CARD, SEGMENT, QUERY, NESTED, RAISED = range(11)


def token_ctes(k: int, items: str) -> str:
    """tok{k}: tokens of the open items with facts and flags (state before the token)."""
    t = "tok"
    body = f"(CASE WHEN {starts_quoted(t)} THEN {unquote(t)} ELSE {t} END)"
    f = "f"
    bit = lambda n: f"(({f} >> {n}) & 1) = 1"
    st = lambda n: f"((acc.b >> {n}) & 1) = 1"
    is_key = (
        f"(CASE WHEN {bit(6)} THEN false"
        f" WHEN {bit(1)} AND {bit(2)} THEN {bit(0)} AND {bit(3)}"
        f" WHEN {bit(1)} THEN ({bit(0)} OR {st(4)}) AND {bit(3)}"
        f" WHEN {bit(4)} THEN NOT {bit(5)} AND ({bit(0)} OR {st(4)})"
        f" ELSE NOT {st(2)} AND ({bit(0)} OR {st(4)}) END)"
    )
    step = (
        f"(CASE WHEN {is_key} OR (NOT {st(2)} AND {st(0)}) THEN 1 ELSE 0 END"
        f" + CASE WHEN {bit(9)} THEN 2 ELSE 0 END"
        f" + CASE WHEN CASE WHEN {bit(8)} THEN {st(2)} ELSE {bit(7)} END THEN 4 ELSE 0 END"
        f" + CASE WHEN CASE WHEN {is_key} THEN {bit(10)} ELSE NOT {st(2)} AND {st(3)} END THEN 8 ELSE 0 END"
        f" + CASE WHEN NOT {is_key} AND ({st(4)} OR ({st(2)} AND {st(3)} AND {bit(11)})) THEN 16 ELSE 0 END)"
    )
    step = step.replace("(f >>", "(f.b >>")
    bits = " + ".join(
        f"CASE WHEN {c} THEN {1 << i} ELSE 0 END"
        for i, c in enumerate(
            ["sk", "eq", "q", "ve", "col > 0", "img", "url", "es", "bl", "ctx", "gen", "sc"]
        )
    )
    return f"""
raw{k} AS MATERIALIZED (
  SELECT line_id, ord, m, t.i::INT AS i, t.tok FROM {items} it,
    unnest(CASE WHEN m >= {NESTED} THEN [c] ELSE regexp_extract_all(c, {s(TOKEN)}) END) WITH ORDINALITY t(tok, i)
  WHERE m IN ({SEGMENT}, {NESTED}, {RAISED})),
voc{k} AS MATERIALIZED (
  SELECT *, {bits} AS feat FROM (
    SELECT *, {sensitive('kc')} AS sk, {sensitive('cl')} AS sc FROM (
      SELECT *, CASE WHEN eq THEN left(body, instr(body, '=') - 1) WHEN col > 0 THEN {unquote('kr')} ELSE {unquote(t)} END AS kc,
        eq AND instr(body, '=') = length(body) AS ve FROM (
        SELECT tok, {url_like(t)} AS url, contains(tok, '=') AS eq, {starts_quoted(t)} AS q, {is_quoted(t)} AS isq, {body} AS body,
          {colon_at(t)} AS col, left(tok, ({colon_at(t)}) - 1) AS kr, {shape('registry', t)} AS img,
          regexp_matches({trim_ws(t)}, '[:=]\\z') AS es, {trim_ws(t)} = '' AS bl, {clean(t)} AS cl,
          lower({clean(t)}) IN {word_list(fixed.CONTEXT_WORDS)} AS ctx, lower({clean(t)}) IN ('key', 'name', 'setting') AS gen
        FROM (SELECT DISTINCT tok FROM raw{k} WHERE NOT (m = {SEGMENT} AND regexp_matches(tok, {s(chr(92) + 'A[' + SEP + ']' + chr(92) + 'z')}))))))),
flag{k} AS MATERIALIZED (
  SELECT line_id, ord, list(i ORDER BY i) AS idx,
    list_reduce(list({{'b': feat::BIGINT, 'out': ''}} ORDER BY i),
      lambda acc, f: {{'b': ({step})::BIGINT, 'out': acc.out || chr((65 + (acc.b & 7) + CASE WHEN {st(4)} THEN 8 ELSE 0 END)::INT)}},
      {{'b': (CASE WHEN any_value(m) = {RAISED} THEN 16 ELSE 0 END)::BIGINT, 'out': ''}}).out AS flags
  FROM raw{k} JOIN voc{k} USING (tok) GROUP BY line_id, ord),
tok{k} AS MATERIALIZED (
  SELECT r.line_id, r.ord, r.m, r.i, r.tok, v.* EXCLUDE (tok), v.tok IS NULL AS is_sep, u.fl FROM raw{k} r
  LEFT JOIN voc{k} v ON r.tok = v.tok AND NOT (r.m = {SEGMENT} AND regexp_matches(r.tok, {s(chr(92) + 'A[' + SEP + ']' + chr(92) + 'z')}))
  LEFT JOIN (SELECT line_id, ord, unnest(idx) AS i, ascii(unnest(string_split(flags, ''))) - 65 AS fl FROM flag{k}) u
    ON r.line_id = u.line_id AND r.ord = u.ord AND r.i = u.i)"""


def open_ctes(k: int, items: str) -> str:
    """item{k+1}: what the open items of ``items`` turn into."""
    tok = "tok"
    fl = lambda n: f"((fl >> {n}) & 1) = 1"  # noqa: E731  0 forced 1 context 2 value 3 raised
    val = "substr(body, instr(body, '=') + 1)"
    judged = f"CASE WHEN {fl(0)} THEN {FORCED} WHEN {fl(1)} THEN {CONTEXT} ELSE {PLAIN} END"
    announces = f"(NOT {fl(2)} AND (sk OR {fl(3)}))"
    quoted_open = f"({fl(2)} AND NOT {fl(0)} AND isq)"
    stay = f"(col = length({tok}) OR img)"
    mode = (
        f"CASE WHEN is_sep THEN {LITERAL} WHEN url THEN CASE WHEN contains(tok, '?') THEN {QUERY} ELSE {LITERAL} END"
        f" WHEN eq THEN CASE WHEN sk OR ({fl(3)} AND NOT q) THEN {FORCED}"
        f" WHEN regexp_matches({val}, '[=:]') THEN CASE WHEN {fl(3)} THEN {RAISED} ELSE {NESTED} END WHEN q THEN {SEGMENT} ELSE {PLAIN} END"
        f" WHEN col > 0 THEN CASE WHEN {stay} THEN {LITERAL} WHEN sk OR {fl(3)} THEN {FORCED} ELSE {PLAIN} END"
        f" WHEN {announces} THEN {LITERAL} WHEN {quoted_open} THEN {SEGMENT} ELSE {judged} END"
    )
    plain_tok = f"(is_sep OR url OR (NOT eq AND col > 0 AND {stay}) OR (NOT eq AND col = 0 AND {announces}))"
    p = (
        f"CASE WHEN {plain_tok} THEN '' WHEN eq THEN CASE WHEN isq THEN left(tok, 1) ELSE '' END || left(body, instr(body, '=') - 1) || '='"
        f" WHEN col > 0 THEN left(tok, col) WHEN {quoted_open} THEN left(tok, 1) ELSE '' END"
    )
    c = (
        f"CASE WHEN {plain_tok} THEN tok WHEN eq THEN {val} WHEN col > 0 THEN substr(tok, col + 1) ELSE {unquote('tok')} END"
    )
    single = f"(NOT is_sep AND NOT url AND NOT eq AND col = 0)"
    o = f"CASE WHEN {single} THEN tok ELSE c END"
    suf = (
        f"CASE WHEN {plain_tok} THEN '' WHEN eq AND isq THEN left(tok, 1) WHEN NOT eq AND col = 0 AND {quoted_open} THEN right(tok, 1) ELSE '' END"
    )
    big = 1 << 30
    kv = "t.kv"
    return token_ctes(k, items) + f""",
item{k + 1} AS MATERIALIZED (
  SELECT line_id, list_append(ord, i) AS ord, m, p, c, {o} AS o, {single} AND m NOT IN ({SEGMENT}) AS a, s FROM (
    SELECT * EXCLUDE (m), {mode} AS m, {p} AS p, {c} AS c, {suf} AS s FROM tok{k})
  UNION ALL
  SELECT line_id, list_append(ord, 0), {LITERAL}, '', p, p, false, '' FROM {items} WHERE m >= {SEGMENT} AND p <> ''
  UNION ALL
  SELECT line_id, list_append(ord, {big}), {LITERAL}, '', s, s, false, '' FROM {items} WHERE m >= {SEGMENT} AND s <> ''
  UNION ALL
  SELECT line_id, list_append(ord, 1), {LITERAL}, '', left(c, instr(c, '?')), left(c, instr(c, '?')), false, '' FROM {items} WHERE m = {QUERY}
  UNION ALL
  SELECT line_id, list_append(ord, 1 + j), CASE WHEN NOT contains(kv, '=') THEN {LITERAL} WHEN {sensitive("left(kv, instr(kv, '=') - 1)")} THEN {URL_KEYED} ELSE {URL_VALUE} END,
    CASE WHEN j > 1 THEN '&' ELSE '' END || CASE WHEN contains(kv, '=') THEN left(kv, instr(kv, '=')) ELSE '' END,
    CASE WHEN contains(kv, '=') THEN substr(kv, instr(kv, '=') + 1) ELSE kv END,
    CASE WHEN contains(kv, '=') THEN substr(kv, instr(kv, '=') + 1) ELSE kv END, false, ''
  FROM (SELECT it.line_id, it.ord, {kv} AS kv, t.j::INT AS j FROM {items} it, unnest(string_split(substr(c, instr(c, '?') + 1), '&')) WITH ORDINALITY t(kv, j) WHERE m = {QUERY}))"""


def leaf_ctes(lines_sql: str, o: Options, levels: int = 6) -> str:
    """CTEs up to ``decided``: every leaf of every line with what becomes of it.

    ``lines_sql`` selects ``line_id`` (unique), ``line`` and anything else.
    """
    parts = [
        f"src AS MATERIALIZED ({lines_sql})",
        card_ctes("src"),
        f"""item0 AS MATERIALIZED (
  SELECT line_id, [start::INT] AS ord, {CARD} AS m, '' AS p, substr(line, start, stop - start) AS c, substr(line, start, stop - start) AS o, false AS a, '' AS s
  FROM ranges JOIN src USING (line_id)
  UNION ALL
  SELECT line_id, [lo::INT], {SEGMENT}, '', substr(line, lo, hi - lo), substr(line, lo, hi - lo), false, '' FROM (
    SELECT src.line_id, src.line, coalesce(lag(stop) OVER (PARTITION BY src.line_id ORDER BY start), 1) AS lo, start AS hi FROM ranges JOIN src USING (line_id)
    UNION ALL
    SELECT line_id, line, coalesce(stop, 1), length(line) + 1 FROM src LEFT JOIN (SELECT line_id, max(stop) AS stop FROM ranges GROUP BY 1) USING (line_id))
  WHERE hi > lo)""",
    ]
    for k in range(levels):
        parts.append(open_ctes(k, f"item{k}"))
    every = " UNION ALL ".join(
        f"SELECT * FROM item{k}" + (f" WHERE m < {SEGMENT}" if k < levels else "") for k in range(levels + 1)
    )
    digits = "regexp_matches(c, '\\A\\p{Nd}*\\z')"
    parts.append(f"leaf AS MATERIALIZED ({every})")
    allowed = " OR ".join(f"regexp_matches(c, {s(r.pattern)})" for r in o.safe_rules) or "false"
    parts.append(f"contents AS MATERIALIZED (SELECT DISTINCT c FROM leaf WHERE m <> {LITERAL})")
    if o.custom_rules:
        parts.append(rule_ctes("contents", "c", o.custom_rules))
        ruled = "SELECT contents.c, best.rule FROM contents LEFT JOIN best ON contents.c = best.c AND rn = 1"
    else:
        ruled = "SELECT c, NULL::VARCHAR AS rule FROM contents"
    parts.append(
        f"rated AS MATERIALIZED (SELECT c, rule, {score('c')} AS score, {is_safe('c')} OR (strlen(c) >= 3 AND ({allowed})) AS safe, {mark('c', o)} AS mark FROM ({ruled}))"
    )
    limit = f"CASE m WHEN {FORCED} THEN 1.0 WHEN {CONTEXT} THEN {round(o.entropy_threshold - 1.3, 9)} ELSE {o.entropy_threshold} END"
    parts.append(
        f"""decided AS MATERIALIZED (
  SELECT *, hidden AND m IN ({PLAIN}, {CONTEXT}, {FORCED}) AND ({starts_quoted('o')} OR (a AND ({digits} OR lower(c) IN ('true', 'false', 'null')))) AS quoted,
    row_number() OVER (PARTITION BY line_id ORDER BY ord) - 1 AS pos FROM (
    SELECT leaf.*, CASE WHEN m IN ({PLAIN}, {CONTEXT}, {FORCED}) AND rule IS NOT NULL THEN CASE WHEN rule = '' THEN '[HIDDEN]' ELSE '[HIDDEN:' || rule || ']' END ELSE mark END AS mark,
      score, safe, CASE WHEN m IN ({URL_KEYED}, {CARD}) THEN true WHEN m = {LITERAL} THEN false
      WHEN m = {URL_VALUE} THEN score > {o.entropy_threshold} + {GUARD}
      WHEN safe THEN false
      WHEN rule IS NOT NULL THEN true
      WHEN m <> {FORCED} AND (strlen(leaf.c) < {o.min_secret_length} OR contains(leaf.c, ' ')) THEN false
      ELSE score > {limit} + {GUARD} END AS hidden
    FROM leaf LEFT JOIN rated ON leaf.c = rated.c AND leaf.m <> {LITERAL}))"""
    )
    parts.append(
        """done AS MATERIALIZED (
  SELECT src.*, coalesce(r.redacted, '') AS redacted FROM src LEFT JOIN (
    SELECT line_id, string_agg(p || CASE WHEN quoted THEN '"' || mark || '"' WHEN hidden THEN mark ELSE o END || s, '' ORDER BY ord) AS redacted
    FROM decided GROUP BY line_id) r USING (line_id))"""
    )
    kind = f"CASE m WHEN {PLAIN} THEN 'entropy' WHEN {CONTEXT} THEN 'context' WHEN {FORCED} THEN 'key' WHEN {CARD} THEN 'card' ELSE 'url' END"
    parts.append(
        f"found AS MATERIALIZED (SELECT src.* EXCLUDE (line), d.pos, {kind} AS kind, d.mark, d.c AS secret FROM decided d JOIN src USING (line_id) WHERE hidden)"
    )
    return "WITH " + ",\n".join(parts)
