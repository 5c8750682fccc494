"""Expected results of the registered queries, as DuckDB SQL on the same tables."""

from __future__ import annotations

from hushmark import fixed
from hushmark.registry import CUSTOM_RULES, HIGH_LIMIT, LOW_LIMIT, OPTIONS, RULES, SHAPE_NAMES
from hushmark.sources import derived

from . import duck
from .duck import s

ORACLE: dict[str, str] = {}

LINES = f"lines AS MATERIALIZED ({duck.DOC_LINES})"
LOGS = f"logs AS MATERIALIZED ({duck.ORDER_LOGS})"
IS_SEP = "regexp_matches(token, " + s("\\A[" + duck.SEP + "]\\z") + ")"


def vocab(name: str, src: str, by: str = "") -> str:
    cols = f"{by}, " if by else ""
    return (
        f"{name} AS MATERIALIZED (SELECT {cols}token, count(*) AS n FROM (SELECT {cols}unnest(regexp_extract_all(line, {s(duck.TOKEN)})) AS token FROM {src})"
        f" WHERE NOT {IS_SEP} GROUP BY ALL)"
    )


WORDS = f"WITH {LINES}, {vocab('words', 'lines')} "
LOG_WORDS = f"WITH {LOGS}, {vocab('words', 'logs')} "

DOC_SRC = f"SELECT source, line_id, line FROM ({duck.DOC_LINES})"
LOG_SRC = f"SELECT source, line_id, line FROM ({duck.ORDER_LOGS})"
DOC_LEAF = duck.leaf_ctes(DOC_SRC, OPTIONS)
LOG_LEAF = duck.leaf_ctes(LOG_SRC, OPTIONS)
LABEL_LEAF = duck.leaf_ctes(duck.ORDER_LOGS, OPTIONS)

CONV = "SELECT role AS source, conv_id * 1000 + turn AS line_id, text AS line FROM conversations"

# --- sources, sinks
ORACLE["src1_conversations"] = CONV
ORACLE["src2_stream"] = f"SELECT source, count(*) AS n, sum(strlen(line))::BIGINT AS bytes FROM ({CONV}) GROUP BY 1"
_FILES = "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) - 1 AS line_id, regexp_replace(line, '\\r$', '') AS line, doc_id, line_no FROM (" + duck.DOC_LINES + ")"
ORACLE["src1_text"] = f"SELECT lang, line_id, line FROM ({_FILES})"
ORACLE["src2_text"] = f"SELECT f.lang, f.line_id, done.redacted FROM ({_FILES}) f JOIN (" + DOC_LEAF + " SELECT line_id, redacted FROM done) done ON done.line_id = f.doc_id * 4294967296 + f.line_no"
ORACLE["src3_documents"] = (
    "SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: x = '')) AS n_blank,"
    " md5(text) AS text_md5 FROM documents"
)
ORACLE["src4_part"] = (
    "SELECT p_type, 'custom' AS kind, (row_number() OVER (PARTITION BY p_type ORDER BY p_brand) - 1)::INT AS ord,"
    " '^' || p_brand || '$' AS pattern, p_brand AS name FROM (SELECT DISTINCT p_type, p_brand FROM part)"
)
ORACLE["snk1_documents"] = DOC_LEAF + " SELECT source, line_id, redacted FROM done"
ORACLE["snk2_stream"] = LOG_LEAF + " SELECT source, line_id, redacted FROM done"

# --- tokens
ORACLE["tok1_documents"] = (
    f"SELECT line_id, len(toks) AS n_tokens, len(list_filter(toks, lambda token: {IS_SEP})) AS n_separators,"
    " md5(array_to_string(toks, chr(10))) AS tokens_md5, true AS lossless"
    f" FROM (SELECT *, regexp_extract_all(line, {s(duck.TOKEN)}) AS toks FROM ({duck.DOC_LINES}))"
)
ORACLE["tok1_rebuild"] = f"SELECT line_id, line FROM ({duck.ORDER_LOGS})"
ORACLE["tok2_customer"] = "SELECT c_custkey, c_name || chr(65533) || '_End' AS repaired FROM customer"
ORACLE["tok3_logs"] = LOG_WORDS + f"SELECT token, n, {duck.unquote('token')} AS unquoted FROM words"
ORACLE["tok4_logs"] = LOG_WORDS + f"SELECT token, lower({duck.clean('token')}) AS clean_lower FROM words"


def _nested() -> str:
    """As deep as the lines are."""
    return (
        f"WITH RECURSIVE {LOGS}, lv(level, token) AS (SELECT 0, unnest(regexp_extract_all(line, {s(duck.TOKEN)})) FROM logs"
        f" UNION ALL SELECT level + 1, unnest(regexp_extract_all({duck.unquote('token')}, {s(duck.TOKEN)})) FROM lv WHERE {duck.is_quoted('token')})"
        f" SELECT level, token, count(*) AS n FROM lv WHERE NOT {IS_SEP} GROUP BY ALL"
    )


ORACLE["tok5_logs"] = _nested()

# --- scores
ORACLE["sco1_documents"] = WORDS + f"SELECT token, n, round({duck.entropy('token')}, 6) AS entropy FROM words"
ORACLE["sco2_documents"] = WORDS + f"SELECT token, ({duck.bonus('token')})::DOUBLE AS bonus FROM words"
ORACLE["sco3_documents"] = WORDS + f"SELECT token, ({duck.bigram('token')})::DOUBLE AS bigram FROM words"
_PAIRS = (
    "pairs AS (SELECT substr(lower(token), i, 2) AS bg, sum(n)::BIGINT AS n FROM words, unnest(range(1, length(lower(token)))) t(i) GROUP BY 1),"
    " listed AS (SELECT unnest(map_keys(m)) AS bg, unnest(map_values(m)) / 10.0 AS known FROM (SELECT " + duck.BG + " AS m))"
)
ORACLE["sco4_documents"] = (
    WORDS.rstrip() + f", {_PAIRS} SELECT bg, n, coalesce(known, -7.0)::DOUBLE AS logp, known IS NOT NULL AS listed FROM pairs LEFT JOIN listed USING (bg)"
)
ORACLE["sco5_documents"] = (
    WORDS.rstrip() + f", {_PAIRS} SELECT known::DOUBLE AS logp, count(*) AS n_pairs, sum(n)::BIGINT AS n FROM pairs JOIN listed USING (bg) GROUP BY 1"
)
ORACLE["sco6_documents"] = WORDS + f"SELECT token, n, round({duck.score('token')}, 6) AS score FROM words"
ORACLE["sco7_documents"] = (
    f"WITH {LINES}, {vocab('words', 'lines', 'source')}, rated AS (SELECT token, round({duck.score('token')}, 9) AS score FROM (SELECT DISTINCT token FROM words))"
    " SELECT source, CASE WHEN score < 3.0 THEN 0 WHEN score < 3.6 THEN 1 WHEN score < 4.5 THEN 2 WHEN score < 5.0 THEN 3 ELSE 4 END AS band,"
    " count(*) AS n_distinct, sum(n)::BIGINT AS n FROM words JOIN rated USING (token) GROUP BY ALL"
)

# --- safe shapes
_VALUE = (
    f"CASE WHEN contains(token, '=') THEN substr(body, instr(body, '=') + 1) WHEN col > 0 THEN substr(token, col + 1) END"
)
_BODY = f"(CASE WHEN {duck.starts_quoted('token')} THEN {duck.unquote('token')} ELSE token END)"
_SHAPED = (
    LOG_WORDS.rstrip()
    + f", parts AS (SELECT token, n, {_VALUE} AS value FROM (SELECT *, {_BODY} AS body, {duck.colon_at('token')} AS col FROM words)),"
    " both_ AS (SELECT token, n FROM parts UNION ALL SELECT value, n FROM parts WHERE value IS NOT NULL AND value <> token UNION ALL SELECT url, 1 FROM pages),"
    " pool AS MATERIALIZED (SELECT token, sum(n)::BIGINT AS n FROM both_ GROUP BY 1) "
)
ORACLE["safe_all"] = _SHAPED + f"SELECT {duck.first_shape('token')} AS shape, count(*) AS n_distinct, sum(n)::BIGINT AS n FROM pool GROUP BY 1"
for _i, _shape in enumerate(SHAPE_NAMES, 1):
    ORACLE[f"safe{_i}_{_shape}"] = _SHAPED + f"SELECT token, n FROM pool WHERE {duck.shape(_shape, 'token')}"
ORACLE["safe_candidates"] = (
    LOG_WORDS + f"SELECT token, n FROM words WHERE NOT {duck.is_safe('token')} AND {duck.score('token')} > 3.6 + 1e-9"
)
_BRANDS = (
    "WITH words AS (SELECT token, count(*) AS n FROM (SELECT p_brand AS token FROM part UNION ALL SELECT p_type FROM part"
    " UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT c_name FROM customer) GROUP BY 1) "
)
ORACLE["safe12_part"] = _BRANDS + "SELECT token, n FROM words WHERE strlen(token) >= 3 AND (regexp_matches(token, '^Brand#1[0-9]$') OR regexp_matches(token, '^[A-Z]{6,}$'))"


_RULED = duck.rule_ctes("words", "token", CUSTOM_RULES)
ORACLE["rul1_part"] = _BRANDS.rstrip() + f", {_RULED} SELECT token, n, rule FROM best WHERE rn = 1"
ORACLE["rul2_logs"] = LOG_WORDS.rstrip() + f", {_RULED} SELECT token, n, rule_pos::INT AS rule_pos, rule_ord::INT AS rule_ord, rule FROM best WHERE rn = 1"

_LISTED = f"listed AS ({ORACLE['src4_part']})"
ORACLE["rul3_part"] = f"WITH {_LISTED}, w AS (SELECT p_type, p_brand AS token, count(*) AS n FROM part GROUP BY ALL) SELECT p_type, token, n, 1 AS rule_pos, ord AS rule_ord, name AS rule FROM w JOIN listed USING (p_type) WHERE ord % 2 = 0 AND regexp_matches(token, pattern)"
ORACLE["rul3_safe"] = _BRANDS.rstrip() + f", {_LISTED} SELECT token, n FROM words WHERE token IN (SELECT substr(pattern, 2, length(pattern) - 2) FROM listed WHERE contains(name, '1'))"
ORACLE["rul3_customers"] = (
    "SELECT c_custkey, 'row ' || c_custkey || ' of ' || CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE '[HIDDEN:N' || n_nationkey || ']' END AS redacted FROM customer JOIN nation ON c_nationkey = n_nationkey"
)

# --- keys and pairs
_PARTS = (
    LOG_WORDS.rstrip()
    + f", cut AS (SELECT *, {_BODY} AS body, {duck.colon_at('token')} AS col FROM words WHERE NOT {duck.url_like('token')}),"
    f" keyed AS MATERIALIZED (SELECT token, n, CASE WHEN contains(token, '=') THEN 'equal' WHEN col = 0 THEN 'single' WHEN {duck.shape('registry', 'token')} THEN 'image' ELSE 'colon' END AS form,"
    f" CASE WHEN contains(token, '=') THEN left(body, instr(body, '=') - 1) WHEN col > 0 THEN {duck.unquote('left(token, col - 1)')} ELSE {duck.unquote('token')} END AS key,"
    f" {_VALUE} AS value FROM cut) "
)
ORACLE["key1_logs"] = _PARTS + f"SELECT key, sum(n)::BIGINT AS n FROM keyed WHERE {duck.sensitive('key')} GROUP BY 1"
ORACLE["key2_logs"] = _PARTS + f"SELECT key, {duck.sensitive('key')} AS sensitive, sum(n)::BIGINT AS n FROM keyed WHERE strlen(key) > 15 AND {duck.fragment('key')} GROUP BY ALL"
_TRACED = _PARTS.replace(vocab("words", "logs"), vocab("words", f"(SELECT {derived.TRACED_SQL} AS line FROM logs)"))
ORACLE["key3_logs"] = _TRACED + f"SELECT key, sum(n)::BIGINT AS n FROM keyed WHERE NOT {duck.fragment('key')} AND regexp_matches(key, '(?i)(^user|context_?id)') GROUP BY 1"
ORACLE["key4_logs"] = (
    f"WITH {LOGS}, {vocab('words', 'logs', 'source')} SELECT source, lower({duck.clean('token')}) AS word, sum(n)::BIGINT AS n FROM words"
    f" WHERE lower({duck.clean('token')}) IN {duck.word_list(fixed.CONTEXT_WORDS)} GROUP BY ALL"
)
ORACLE["par1_logs"] = _PARTS + "SELECT token, n, key, value FROM keyed WHERE form = 'equal'"
ORACLE["par2_logs"] = _PARTS + "SELECT token, form, key, value FROM keyed WHERE form IN ('colon', 'image')"

# --- state: the stretches between cards are segments of their own
def _segments(src: str) -> str:
    """CTEs up to state and seg over ``src``, a query of line_id and line."""
    return (
        f"src AS MATERIALIZED ({src}), {duck.card_ctes('src')}, "
        "seg AS MATERIALIZED (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY lo) - 1 AS seg, substr(line, lo, hi - lo) AS line FROM ("
        "SELECT src.line_id, src.line, coalesce(lag(stop) OVER (PARTITION BY src.line_id ORDER BY start), 1) AS lo, start AS hi FROM ranges JOIN src USING (line_id)"
        " UNION ALL SELECT line_id, line, coalesce(stop, 1), length(line) + 1 FROM src LEFT JOIN (SELECT line_id, max(stop) AS stop FROM ranges GROUP BY 1) USING (line_id)) WHERE hi > lo), "
        f"open AS (SELECT line_id, [seg] AS ord, {duck.SEGMENT} AS m, '' AS p, line AS c, '' AS s FROM seg), "
        + duck.token_ctes(0, "open")
        + ", state AS MATERIALIZED (SELECT line_id, ord[1] AS seg, i, tok AS token, sk AND NOT img AND NOT url AS sensitive, (fl & 1) = 1 AS forced, (fl & 2) = 2 AS context,"
        " (fl & 4) = 4 AS in_value, (fl & 8) = 8 AS raised FROM tok0 WHERE NOT is_sep) "
    )


_STATE = f"WITH {LOGS}, {_segments('SELECT line_id, line FROM logs')}"
ORACLE["par3_logs"] = _STATE + "SELECT line_id, seg::INT AS seg, token FROM state WHERE forced AND in_value"
ORACLE["par4_logs"] = _STATE + "SELECT line_id, seg::INT AS seg, token FROM state WHERE raised"
for _name, _flag in (("st3_forced", "forced"), ("st5_raised", "raised")):
    ORACLE[_name] = _STATE + f"SELECT line_id, seg::INT AS seg, string_agg(CASE WHEN {_flag} THEN '1' ELSE '0' END, '' ORDER BY i) AS {_flag} FROM state GROUP BY ALL"
# Value position and context are plain windows: an independent formulation.
_WINDOWS = _STATE.rstrip() + (
    f", toks AS (SELECT line_id, seg, t.i, t.token FROM seg, unnest(regexp_extract_all(line, {s(duck.TOKEN)})) WITH ORDINALITY t(token, i) WHERE NOT {IS_SEP}) "
)
ORACLE["st1_in_value"] = _WINDOWS + (
    "SELECT line_id, seg::INT AS seg, string_agg(CASE WHEN v THEN '1' ELSE '0' END, '' ORDER BY i) AS in_value FROM (SELECT line_id, seg, i,"
    f" coalesce(last_value(CASE WHEN {duck.trim_ws('token')} <> '' THEN regexp_matches({duck.trim_ws('token')}, '[:=]\\z') END IGNORE NULLS) OVER (PARTITION BY line_id, seg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS v FROM toks) GROUP BY ALL"
)
ORACLE["st2_context"] = _WINDOWS + (
    "SELECT line_id, seg::INT AS seg, string_agg(CASE WHEN v THEN '1' ELSE '0' END, '' ORDER BY i) AS context FROM (SELECT line_id, seg, i,"
    f" coalesce(lag(lower({duck.clean('token')}) IN {duck.word_list(fixed.CONTEXT_WORDS)}) OVER (PARTITION BY line_id, seg ORDER BY i), false) AS v FROM toks) GROUP BY ALL"
)
ORACLE["st4_generic"] = _STATE + f"SELECT line_id, seg::INT AS seg, lower({duck.clean('token')}) AS clean FROM state WHERE sensitive AND lower({duck.clean('token')}) IN ('key', 'name', 'setting')"
_SAID = (
    "SELECT row_number() OVER () AS line_id, conv_id, turn, t.line FROM (SELECT *, text || chr(10) || role || ' password: ' || left(md5(text), 9) || ' card 4012888888881881 key=' || turn AS said"
    " FROM conversations WHERE text IS NOT NULL), unnest(string_split(said, chr(10))) t(line)"
)
ORACLE["st_conversations"] = (
    f"WITH said AS MATERIALIZED ({_SAID}), {_segments('SELECT line_id, line FROM said')}, sums AS (SELECT line_id, "
    + ", ".join(f"count_if({f}) AS {f}" for f in ("in_value", "context", "forced", "raised"))
    + " FROM state GROUP BY 1), many AS (SELECT line_id, count(*) AS n FROM seg GROUP BY 1) SELECT conv_id, turn, sum(n)::BIGINT AS n_segments, "
    + ", ".join(f"coalesce(sum({f}), 0)::BIGINT AS {f}" for f in ("in_value", "context", "forced", "raised"))
    + " FROM said JOIN many USING (line_id) LEFT JOIN sums USING (line_id) GROUP BY ALL"
)

# --- URLs
_TRACKED = (
    "WITH tracked AS (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'sid=' || left(sha256(url), 32) || '&auth=' || page_id AS url FROM pages),"
    " params AS MATERIALIZED (SELECT page_id, url, t.i::INT - 1 AS idx, t.kv FROM tracked, unnest(string_split(substr(url, instr(url, '?') + 1), '&')) WITH ORDINALITY t(kv, i)),"
    f" named AS MATERIALIZED (SELECT *, {duck.sensitive('name')} AS sensitive, {duck.score('value')} > 3.6 + 1e-9 AS random FROM (SELECT *, left(kv, instr(kv, '=') - 1) AS name, substr(kv, instr(kv, '=') + 1) AS value FROM params WHERE contains(kv, '='))) "
)
ORACLE["url1_pages"] = _TRACKED + "SELECT page_id, idx, name, value, sensitive, random FROM named"
ORACLE["url1_masked"] = _TRACKED + (
    "SELECT page_id, any_value(left(url, instr(url, '?'))) || string_agg(CASE WHEN sensitive OR random THEN name || '=' || "
    + duck.mark("value", OPTIONS)
    + " ELSE kv END, '&' ORDER BY idx) AS masked FROM (SELECT params.*, name, value, sensitive, random FROM params LEFT JOIN named USING (page_id, idx)) GROUP BY page_id"
)
ORACLE["url2_logs"] = LOG_WORDS + f"SELECT token, n FROM words WHERE {duck.url_like('token')}"

# --- cards
_CARDS = (
    f"WITH src AS MATERIALIZED (SELECT line_id, line FROM ({duck.DOC_LINES}) UNION ALL SELECT -1 - line_id, line FROM ({duck.ORDER_LOGS})), "
    + duck.card_ctes("src")
)
ORACLE["luh1_lines"] = _CARDS + " SELECT line_id, start::INT AS start, stop::INT AS stop FROM win"
ORACLE["luh2_lines"] = _CARDS + " SELECT length(digits) AS n_digits, count(*) AS n FROM win GROUP BY 1"
ORACLE["luh3_lines"] = _CARDS + " SELECT line_id, start::INT AS start, stop::INT AS stop, n_distinct FROM varied"
ORACLE["luh4_lines"] = _CARDS + " SELECT line_id, start::INT AS start, stop::INT AS stop, digits FROM cards"
ORACLE["luh5_lines"] = _CARDS + " SELECT line_id, start::INT AS start, stop::INT AS stop, substr(line, start, stop - start) AS card FROM ranges JOIN src USING (line_id)"

# --- redaction
ORACLE["red1_documents"] = DOC_LEAF + " SELECT source, line_id, (row_number() OVER (PARTITION BY line_id ORDER BY pos) - 1)::INT AS pos, kind, mark FROM found"
ORACLE["red1_logs"] = LOG_LEAF + " SELECT source, line_id, kind, mark FROM found"
ORACLE["red2_customer"] = f"SELECT c_custkey, c_mktsegment, {duck.mark('c_name', OPTIONS)} AS name_mark FROM customer"
ORACLE["red3_logs"] = LOG_LEAF + " SELECT line_id, redacted FROM done WHERE contains(redacted, '\"[HIDDEN')"
ORACLE["red4_documents"] = DOC_LEAF + " SELECT line_id, redacted FROM done"
ORACLE["red4_logs"] = LOG_LEAF + " SELECT line_id, redacted FROM done"
ORACLE["red4_texts"] = DOC_LEAF + " SELECT line_id // 4294967296 AS doc_id, md5(string_agg(redacted, chr(10) ORDER BY line_id)) AS redacted_md5 FROM done GROUP BY 1"
ORACLE["red4_rules"] = duck.leaf_ctes(LOG_SRC, RULES) + " SELECT line_id, redacted FROM done"
ORACLE["red5_stream"] = ORACLE["red4_documents"]
ORACLE["red6_logs"] = LOG_LEAF + (
    " SELECT mark, count(*) AS n, count(DISTINCT source) AS n_sources, min(line_id) AS first_line, max(line_id) AS last_line FROM found GROUP BY 1"
)
ORACLE["red7_orders"] = (
    f"SELECT mark, count(*) AS n_secrets FROM (SELECT DISTINCT secret, {duck.mark('secret', OPTIONS)} AS mark FROM (SELECT l_orderkey || '-' || l_linenumber AS secret FROM lineitem)) GROUP BY 1 HAVING count(*) > 1"
)

# --- functions of SQL: every text as one line
_TALK = (
    "SELECT conv_id * 1000 + turn AS line_id, conv_id, turn, role, text || ' password: ' || left(md5(text), 9) || ' card 4012888888881881 ' || left(upper(md5(text)), 4) || substr(md5(text), 9, 12) AS line"
    " FROM conversations WHERE text IS NOT NULL"
)
_TALK_LEAF = duck.leaf_ctes(_TALK, OPTIONS)
ORACLE["fn1_conversations"] = _TALK_LEAF + (
    f" SELECT conv_id, turn, redacted, coalesce(c.n, 0)::INT AS n_cards, {duck.mark('role', OPTIONS)} AS role_mark, round({duck.score('line')}, 6) AS complexity, ({duck.bigram('line')})::DOUBLE AS bigram"
    " FROM done LEFT JOIN (SELECT line_id, count(*) AS n FROM ranges GROUP BY 1) c USING (line_id)"
)
ORACLE["fn2_conversations"] = _TALK_LEAF + " SELECT role, kind, count(*) AS n, count(DISTINCT mark) AS n_marks FROM found GROUP BY ALL"

# --- JSON
def _json(src: str, key: str, col: str) -> str:
    return (
        f"tree AS MATERIALIZED (SELECT d.{key}, t.id, t.fullkey AS path, CASE WHEN NOT ends_with(t.fullkey, ']') THEN t.key END AS name, t.path AS parent,"
        " CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type, t.atom ->> '$' AS value"
        f" FROM {src} d, json_tree(d.{col}) t WHERE t.type NOT IN ('OBJECT', 'ARRAY'))"
    )


ORACLE["jsn1_events"] = f"WITH {_json('events', 'event_id', 'props')} SELECT event_id, path, type, value FROM tree"
_JLOG = f"WITH {LOGS}, jl AS MATERIALIZED (SELECT line_id, line FROM logs WHERE starts_with(line, '{{')), {_json('jl', 'line_id', 'line')}"
ORACLE["jsn1_logs"] = _JLOG + " SELECT line_id, path, type, value FROM tree"
_JPAIR = _JLOG + f""", duo AS (SELECT line_id, parent, max(CASE WHEN name = 'key' AND type = 'string' THEN value END) AS key,
  max(CASE WHEN name = 'value' THEN path END) AS value_path FROM tree WHERE name IN ('key', 'value') GROUP BY ALL)"""
ORACLE["jsn4_logs"] = _JPAIR + f" SELECT line_id, parent, key, value_path FROM duo WHERE key IS NOT NULL AND value_path IS NOT NULL AND {duck.sensitive('key')}"


# Leaves masked: their strings are scanned as lines of their own, and so are the texts of ``plain``.
def _json_masked(pre: str = _JPAIR, key: str = "line_id", plain: str = "") -> str:
    pre = pre.removeprefix("WITH ") + f""", pairs AS (SELECT {key}, parent FROM duo WHERE key IS NOT NULL AND value_path IS NOT NULL AND {duck.sensitive('key')}),
jleaf AS MATERIALIZED (SELECT row_number() OVER () AS rid, tree.*, (name IS NOT NULL AND {duck.sensitive('name')}) OR (name = 'value' AND pairs.parent IS NOT NULL) AS secret
  FROM tree LEFT JOIN pairs ON tree.{key} = pairs.{key} AND tree.parent = pairs.parent)"""
    scan = duck.leaf_ctes(f"SELECT rid AS line_id, value AS line FROM jleaf WHERE type = 'string'{plain}", OPTIONS).removeprefix("WITH ")
    number = f"strlen(value) >= 6 AND NOT {duck.is_safe('value')} AND {duck.score('value')} > 3.6 + 1e-9"
    return (
        f"WITH {pre}, {scan}, jmask AS (SELECT jleaf.*, CASE WHEN type = 'string' AND secret THEN {duck.mark('value', OPTIONS)} WHEN type = 'string' THEN done.redacted"
        f" WHEN type = 'number' AND (secret OR ({number})) THEN '0' ELSE value END AS masked FROM jleaf LEFT JOIN done ON jleaf.rid = done.line_id)"
    )


# A text taken apart at its own tokens: the n-th token that is a value belongs to the n-th leaf of the tree.
_JTOKEN = r"""(?s)[ \t\n\r]+|"(?:[^"\\]|\\.)*"|[0-9A-Za-z.+-]+|."""


def _json_encoded(src: str, key: str, col: str) -> str:
    return f""",
toks AS MATERIALIZED (SELECT d.{key}, t.i, t.tok FROM {src} d, unnest(regexp_extract_all(d.{col}, {s(_JTOKEN)})) WITH ORDINALITY t(tok, i)),
valued AS (SELECT {key}, i, row_number() OVER (PARTITION BY {key} ORDER BY i) AS nth FROM (
  SELECT *, lead(tok) OVER (PARTITION BY {key} ORDER BY i) AS following FROM toks WHERE trim(tok, chr(10) || chr(13) || chr(9) || ' ') <> '')
  WHERE regexp_matches(tok, '\\A[0-9A-Za-z-]') OR (starts_with(tok, '"') AND coalesce(following, '') <> ':')),
leafed AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY id) AS nth FROM jmask),
encoded AS (SELECT toks.{key}, string_agg(CASE WHEN masked IS NULL OR masked = value THEN tok WHEN type = 'string' THEN to_json(masked)::VARCHAR ELSE masked END, '' ORDER BY toks.i) AS encoded
  FROM toks LEFT JOIN valued ON toks.{key} = valued.{key} AND toks.i = valued.i LEFT JOIN leafed ON leafed.{key} = valued.{key} AND leafed.nth = valued.nth GROUP BY 1)"""


ORACLE["jsn1_steps"] = _JLOG + r""" SELECT '["' || array_to_string(list_filter(string_split(regexp_replace(substr(path, 2), '\[([0-9]+)\]', '.\1', 'g'), '.'), lambda x: x <> ''), '","') || '"]' AS steps,
  type, count(*) AS n FROM tree GROUP BY ALL"""
ORACLE["jsn1_encoded"] = (
    _json_masked(plain=" UNION ALL SELECT -1 - line_id, line FROM logs WHERE NOT starts_with(line, '{')") + _json_encoded("jl", "line_id", "line")
    + " SELECT line_id, encoded, starts_with(encoded, '{') AND json_valid(encoded) AS parses FROM (SELECT * FROM encoded UNION ALL SELECT -1 - line_id, redacted FROM done WHERE line_id < 0)"
)
_TAGGED = (
    "tagged AS MATERIALIZED (SELECT event_id, '{\"event\":\"' || event_type || '\", \"user\": {\"id\": ' || user_id || ', \"session_token\": \"' || sha256(event_id::VARCHAR) || '\"}, \"props\" : ' || props || '}' AS props FROM events)"
)
_TAGGED_PAIR = f"""WITH {_TAGGED}, {_json('tagged', 'event_id', 'props')}, duo AS (SELECT event_id, parent, max(CASE WHEN name = 'key' AND type = 'string' THEN value END) AS key,
  max(CASE WHEN name = 'value' THEN path END) AS value_path FROM tree WHERE name IN ('key', 'value') GROUP BY ALL)"""
ORACLE["jsn1_events_encoded"] = _json_masked(_TAGGED_PAIR, "event_id") + _json_encoded("tagged", "event_id", "props") + " SELECT event_id, encoded FROM encoded"
ORACLE["jsn2_logs"] = _json_masked() + " SELECT line_id, path, type, masked FROM jmask WHERE name IS NOT NULL"
ORACLE["jsn3_logs"] = _json_masked() + " SELECT line_id, path, type, masked FROM jmask WHERE name IS NULL"
_HIDE = lambda m: duck.mark(m, OPTIONS)
_SCAN = lambda m: f"CASE WHEN strlen({m}) >= 6 AND NOT {duck.is_safe(m)} AND {duck.score(m)} > 3.6 + 1e-9 THEN {_HIDE(m)} ELSE {m} END"
ORACLE["jsn5_customer"] = (
    f"SELECT c_custkey, {_SCAN('c_name')} AS \"user\", {_HIDE('sha256(c_name)')} AS api_key, 0::BIGINT AS cvv, {_HIDE(s('password'))} AS pair_key, {_HIDE('c_mktsegment')} AS pair_value,"
    f" {_SCAN('c_mktsegment')} || '|' || {_SCAN('left(sha256(c_name), 30)')} AS tags, c_acctbal AS balance FROM customer"
)

# --- baseline
def _base(part: str) -> str:
    """samp and base; lines count in the order of ``part`` (the batch they come in) first."""
    return DOC_LEAF + f""", samp AS MATERIALIZED (SELECT * FROM (
  SELECT src.source, d.line_id, d.pos, d.score, {part} AS part, row_number() OVER (PARTITION BY src.source ORDER BY {part}, d.line_id, d.pos) AS rank
  FROM decided d JOIN src USING (line_id) WHERE d.m IN ({duck.PLAIN}, {duck.CONTEXT}) AND NOT d.safe AND NOT d.hidden AND strlen(d.c) >= 6 AND NOT contains(d.c, ' ')) WHERE rank <= 100),
base AS MATERIALIZED (SELECT source, count(*) AS n, avg(score) + 2 * stddev_pop(score) AS threshold, max((part, line_id, pos)) AS last FROM samp GROUP BY 1)"""


_BASE = _base("0")
ORACLE["bas1_documents"] = _BASE + " SELECT source, rank::INT AS rank, line_id, round(score, 6) AS score FROM samp"
ORACLE["bas2_documents"] = _BASE + " SELECT source, round(threshold, 6) AS threshold FROM base WHERE n = 100"
ORACLE["bas4_documents"] = _BASE + " SELECT source, n, n >= 100 AS ready FROM base"
def _adaptive(part: str) -> str:
    return _base(part) + f""", again AS (SELECT d.line_id, d.ord, d.p, d.c, d.o, d.s, d.m, coalesce(d.mark, '') AS mark, d.a,
  CASE WHEN d.m <> {duck.PLAIN} OR b.n IS NULL OR b.n < 100 OR ({part}, d.line_id, d.pos) <= b.last THEN d.hidden
       WHEN d.safe OR strlen(d.c) < 6 OR contains(d.c, ' ') THEN false ELSE d.score > b.threshold + 1e-9 END AS hidden
  FROM decided d JOIN src USING (line_id) LEFT JOIN base b USING (source))
SELECT src.line_id, coalesce(r.redacted, '') AS redacted FROM src LEFT JOIN (
  SELECT line_id, string_agg(p || CASE WHEN hidden AND m IN ({duck.PLAIN}, {duck.CONTEXT}, {duck.FORCED}) AND ({duck.starts_quoted('o')} OR (a AND regexp_matches(c, '\\A\\p{{Nd}}*\\z'))) THEN '"' || mark || '"'
     WHEN hidden THEN mark ELSE o END || s, '' ORDER BY ord) AS redacted FROM again GROUP BY 1) r USING (line_id)"""


ORACLE["bas3_documents"] = _adaptive("0")
ORACLE["bas5_stream"] = "SELECT *, (line_id // 4294967296 % 3)::INT AS batch FROM (" + _adaptive("d.line_id // 4294967296 % 3") + ")"

# --- evaluation
_CONF = (
    " SELECT source, count_if(label = 'SECRET' AND line <> redacted) AS tp,"
    " count_if(label <> 'SECRET' AND NOT (label = 'SAFE' AND line <> redacted AND contains(redacted, '[HIDDEN'))) AS tn,"
    " count_if(label = 'SAFE' AND line <> redacted AND contains(redacted, '[HIDDEN')) AS fp,"
    " count_if(label = 'SECRET' AND line = redacted) AS fn FROM done GROUP BY 1"
)
ORACLE["evl1_logs"] = "SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM (" + LABEL_LEAF + _CONF + ")"
ORACLE["evl2_logs"] = duck.leaf_ctes(duck.ORDER_LOGS, OPTIONS.with_(entropy_threshold=HIGH_LIMIT)) + (
    " SELECT line_id, CASE WHEN label = 'SECRET' THEN 'leak' ELSE 'false_positive' END AS mistake FROM done"
    " WHERE (label = 'SECRET' AND line = redacted) OR (label = 'SAFE' AND line <> redacted AND contains(redacted, '[HIDDEN'))"
)
ORACLE["evl3_documents"] = (
    f"SELECT line_id, a.redacted AS got, b.redacted AS want FROM ({duck.leaf_ctes(DOC_SRC, OPTIONS.with_(entropy_threshold=LOW_LIMIT))} SELECT line_id, redacted FROM done) a"
    f" JOIN ({DOC_LEAF} SELECT line_id, redacted FROM done) b USING (line_id) WHERE a.redacted <> b.redacted"
)
ORACLE["evl4_logs"] = LABEL_LEAF + (
    " SELECT source, count(*) AS n_json, count_if(NOT json_valid(redacted)) AS n_broken FROM done WHERE starts_with(redacted, '{') GROUP BY 1"
)
ORACLE["evl5_documents"] = DOC_LEAF + (
    " SELECT source, count(*) AS n, 0 AS n_invalid, count_if(strlen(redacted) > 3 * strlen(line) + 100) AS n_exploded FROM done GROUP BY 1"
)
ORACLE["evl6_documents"] = DOC_LEAF + (
    " SELECT source, count(*) AS n_rows, sum(strlen(line))::BIGINT AS n_bytes, sum(strlen(redacted))::BIGINT AS n_bytes_out FROM done GROUP BY 1"
)
ORACLE["rpt1_documents"] = DOC_LEAF + (
    " SELECT coalesce(source, '(all)') AS source, coalesce(kind, '(all)') AS kind, count(*) AS n FROM found GROUP BY ROLLUP (source, kind)"
)
ORACLE["flagship_documents"] = DOC_LEAF + " SELECT source, kind, count(*) AS n, count(DISTINCT mark) AS n_marks FROM found GROUP BY ALL"
