"""What becomes of single lines: the golden pairs, and lines of our own for every rule."""

import json
import random
import re

import pytest

from hushmark import Options, Rule
from hushmark.options import rules_from_json

from . import golden

OWN = Options(salt="the tests' own salt, long enough")
MARK = re.compile(r"\[HIDDEN:[0-9a-f]{6}\]")
HEX40 = "0f1e2d3c4b" * 4


def shape(line):
    """A redacted line with the placeholders blotted out."""
    return MARK.sub("#", line)


def check(redact, options, cases):
    got = redact([line for line, _ in cases], options)
    assert [(line, shape(out)) for (line, _), out in zip(cases, got)] == cases


def test_golden_pairs(redact):
    lines, want = zip(*golden.PAIRS)
    assert redact(list(lines), Options(salt=golden.SALT)) == list(want)


def test_an_empty_line_stays(redact):
    assert redact(["", " ", "\t"], OWN) == ["", " ", "\t"]


SAFE_SHAPES = [
    "order ref 1b9d6bcd-bbfd-4b2d-9b5d-ab8dfbbd4bed closed",
    "seen at 1893456000 and 2031-05-17T04:21:09Z",
    "peer fd12:3456:789a:0001:0000:0000:0000:0042 went away",
    f"built from {HEX40} today",
    "row 65f0c2a1b3d4e5f6a7b8c9d0 touched",
    "see https://depot.example.net/manual/7 and /srv/depot/cfg.d or ../up/one",
    r"loaded D:\depot\till\Register7Plugin now",
    "pulled quay.io/depot/Till9x:Zq7Kd today",
    "login ssh-ed25519 known, by user_0a1b2c done",
]


def test_safe_shapes_are_left_alone(redact):
    assert redact(SAFE_SHAPES, OWN) == SAFE_SHAPES


def test_safe_shapes_beat_sensitive_keys(redact):
    check(redact, OWN, [(f"token={HEX40}", f"token={HEX40}"), ("secret=/run/depot/x", "secret=/run/depot/x"), ("passwd=qZ7kd", "passwd=#"), ("passwd=7777", "passwd=7777")])


KEYS = [
    ("secret=w0lf", "secret=#"),
    ("auth: w0lfpack", "auth: #"),
    ("till_token = w0lf next", "till_token = # next"),
    ("opt.Password:w0lf", "opt.Password:#"),
    ("m=n=o=token=w0lf", "m=n=o=token=#"),
    ("jdbc:depot://h:99?passphrase=W0lfWinter", "jdbc:depot://h:99?passphrase=#"),
    ("plain=words colour=red", "plain=words colour=red"),
    ("card=4012888888881881", "card=#"),
    ("Failed: 10.20.30.40 wQzZanojgGcO9a refused", "Failed: # # refused"),  # the word after a context word has a lower limit
    ('{"key": "api_token", "value": "Winter42Wolf"}', '{"key": "#", "value": "#"}'),
]


def test_keys_and_context(redact):
    check(redact, OWN, KEYS)


OBJECTS = [
    '{"clerk": "bo", "secret": "winterwolf9"}', '{"till": {"token": "t", "n": 12}}', '[{"n": 4}, {"m": 5, "auth": "w0lfgang"}]', r'{"said": "she \"left\" early"}', '{"none": ""}', '{"passwd": 887766, "gone": null}',
]


def test_objects_still_parse(redact):
    out = redact(OBJECTS, OWN)
    for before, after in zip(OBJECTS, out):
        a, b = json.loads(before), json.loads(after)
        assert type(a) is type(b) and (not isinstance(a, dict) or list(a) == list(b))
    assert "winterwolf9" not in out[0] and "w0lfgang" not in out[2] and json.loads(out[5])["passwd"].startswith("[HIDDEN:")
    assert out[3] == OBJECTS[3] and out[4] == OBJECTS[4]


ODD = [
    ("http://h/p?a=1?b=2", "http://h/p?a=1?b=2"),  # nothing after a second ? is lost
    ('"k=v":', '"k=v":'),  # keeps its own quotes only
    ("secret then abcdef and more", "secret then # # more"),  # a bare key word holds until a value position; small words stay
    ("she won't say token=w0lf2x", "she won't say token=#"),  # the apostrophe opens a quote: the key is "won't say token"
    ("paid 4012888888881881—then", "paid #—then"),
    ("x4012888888881881 4012-8888-8888-1881a 4012888888881881", "x4012888888881881 4012-8888-8888-1881a #"),
    ('auth: "445566778899" n: 5', 'auth: "#" n: 5'),
    ("secret=w0lf(pack", "secret=#(pack"),
]


def test_odd_lines(redact):
    check(redact, OWN, ODD)


STATE = [
    ("token bq7", "token #"),
    # what a card cuts off knows nothing of the key word before it, of a context word, or of a quote that was open
    ("token 4012888888881881 bq7", "token # bq7"),
    ("password: 4012 8888 8888 1881 bq7", "password: # bq7"),
    ("password: bq7 4012888888881881 secret: y9x8", "password: # # secret: #"),
    ("Failed: 4012888888881881 bq7kd4", "Failed: # bq7kd4"),
    ("note: 'open 4012888888881881 token=bq7 more", "note: 'open # token=# more"),
]


def test_state_ends_at_a_card(redact):
    check(redact, OWN, STATE)


def test_state_table_restarts_at_a_card(spark):
    from hushmark.operators import state

    lines = spark.createDataFrame([(1, "token 4012888888881881 b password: 4012-8888-8888-1881"), (2, "4012888888881881"), (3, "password: a b")], "line_id INT, line STRING")
    got = {(r.line_id, r.seg): (r.forced, r.in_value) for r in state.flag_strings(state.segment_state(lines, OWN), "forced", "in_value").collect()}
    # by hand: "token" | "b", "password:" | nothing after the last card; without the restart b would be forced
    assert got == {(1, 0): ("0", "0"), (1, 1): ("00", "00"), (3, 0): ("010", "010")}


def test_a_higher_limit_keeps_more(redact):
    lines = ["tree wQzZ7nojgGcO9a", "minified u=function(t,n){return t.size>n.size?t:n}"]
    low, high = redact(lines, OWN.with_(entropy_threshold=3.0)), redact(lines, OWN.with_(entropy_threshold=9.0))
    assert high == lines and low[0] != lines[0]


SPEECH = [
    ("La caja del almacén abrió tarde y nadie avisó", "es"),
    ("Der Lieferwagen blieb gestern im Schnee stecken", "de"),
    ("Утром склад открыли без задержки", "ru"),
    ("Le dépôt reçoit les colis après midi", "fr"),
]


def test_other_languages_survive_without_letter_pairs(redact):
    lines = [x for x, _ in SPEECH]
    for line, out in zip(lines, redact(lines, OWN.with_(bigram_check=False))):
        kept = [w for w in line.split() if len(w) < 8]
        assert all(w in out.split() for w in kept), out


def test_the_salt_changes_every_placeholder(redact):
    lines = ["secret=w0lfpack", "secret=w0lfpack"]
    first, second = redact(lines, OWN), redact(lines, OWN.with_(salt="another salt of sixteen and more"))
    assert first[0] == first[1] and second[0] == second[1] and first[0] != second[0]


NONE, HIGH = "", 100.0
PARCEL = '{"pattern": "^PRCL/[0-9]{6}$", "name": "Parcel"}'
RULES = [
    (f"[{PARCEL}]", NONE, HIGH, "Sent PRCL/204816 today", "Sent [HIDDEN:Parcel] today"),
    ('[{"pattern": "^PRCL/[0-9]{6}$", "name": ""}]', NONE, HIGH, "Sent PRCL/204816", "Sent [HIDDEN]"),
    ('[{"pattern": "(?i)^prcl/[0-9]{6}$", "name": "Parcel"}]', NONE, HIGH, "at: PRCL/204816", "at: [HIDDEN:Parcel]"),
    ('[{"pattern": "^[0-9]{4}$", "name": "Door"}]', NONE, HIGH, "door: 9876", "door: 9876"),  # under five bytes
    (f'[{PARCEL}, {{"pattern": "^VAN-[A-Z]{{3}}$", "name": "Van"}}]', NONE, HIGH, "PRCL/204816 in VAN-KLM", "[HIDDEN:Parcel] in [HIDDEN:Van]"),
    ('[{"pattern": "^(VAN)-([A-Z]{3})$", "name": "Van"}, {"pattern": "K", "name": "Letter"}]', NONE, HIGH, "took VAN-KLM", "took [HIDDEN:Van]"),
    ('[{"pattern": "LM$", "name": "End"}, {"pattern": "V", "name": "Start"}]', NONE, HIGH, "took VAN-KLM", "took [HIDDEN:Start]"),  # leftmost first
    (NONE, NONE, HIGH, "Sent PRCL/204816", "Sent PRCL/204816"),
    (NONE, '[{"pattern": "^BAY-[0-9]+$", "name": "Bay"}]', 2.0, "BAY-75310", "BAY-75310"),
    ('[{"pattern": "^BAY-[0-9]{4}$", "name": "Hide"}]', '[{"pattern": "^BAY-[0-9]{4}$", "name": "Let"}]', 3.6, "to: BAY-7531", "to: BAY-7531"),
    (NONE, '[{"pattern": "^[a-z]+[0-9]{3,}$", "name": "Shelf"}]', 1.5, "shelfletters90817263", "shelfletters90817263"),
]


@pytest.mark.parametrize("custom,safe,limit,line,want", RULES)
def test_rules(redact, custom, safe, limit, line, want):
    options = OWN.with_(custom_rules=rules_from_json(custom), safe_rules=rules_from_json(safe), entropy_threshold=limit)
    assert redact([line], options) == [want]


def test_key_patterns(redact):
    options = OWN.with_(key_patterns=("^bay(_?door)?$", " iban "))
    check(redact, options, [("bay_door=q1w2 side=q1w2 IBAN=q1w2", "bay_door=# side=q1w2 IBAN=#"), ("BAY:zq17 bays=zq17", "BAY:# bays=zq17")])


def test_bad_rules_fail(spark):
    from hushmark.functions.rules import validate_rules

    with pytest.raises(ValueError):
        rules_from_json("[{]")
    with pytest.raises(ValueError):
        rules_from_json('{"pattern": "x"}')
    with pytest.raises(ValueError):
        validate_rules(spark, OWN.with_(safe_rules=(Rule("(open", "Open"),)))
    with pytest.raises(ValueError):
        validate_rules(spark, OWN.with_(key_patterns=("*x",)))
    validate_rules(spark, OWN.with_(custom_rules=(Rule("^x+$", "X"), Rule("y{2}", "Y"))))


def test_settings():
    o = Options.from_mapping(
        {"salt": OWN.salt, "entropy_threshold": "2.75", "sensitive_keys": " Bay ,door", "disable_bigram_check": "true", "adaptive": "1", "adaptive_samples": "31", "bigram_default": "low"}
    )
    assert (o.entropy_threshold, o.sensitive_keys, o.bigram_check, o.adaptive_samples, o.bigram_default) == (2.75, ("bay", "door"), False, 31, -7.0)
    assert OWN.salt not in repr(o)
    with pytest.raises(ValueError):
        Options.from_mapping({"entropy_threshold": "2"})


def test_any_bytes_give_valid_text(spark):
    """Marks, quotes and broken bytes thrown together: valid UTF-8 comes out and does not explode."""
    from hushmark.operators.evaluate import output_properties
    from hushmark.operators.redaction import redact_lines

    rng = random.Random(2031)
    parts = [b'"', b"'", b"=", b":", b"\\", b"?", b"&", b"{", b"]", b",", b" ", b"\t", b"token", b"w0lf", b"4012888888881881", "é—".encode(), b"\xc3", b"\xf0\x9f", b"\xff\xfe", b"://", b"::"]
    seeds = [b"".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(300)]
    df = spark.createDataFrame([(bytearray(b),) for b in seeds], "raw BINARY").selectExpr("CAST(raw AS STRING) AS line")
    row = output_properties(redact_lines(df, OWN)).first()
    assert (row.n, row.n_invalid, row.n_exploded) == (len(seeds), 0, 0)


def test_long_lines_and_deep_nesting(redact):
    """Whole texts, not prefixes: secrets at the far end of a long line and deep inside a value."""
    far = "crate: y " * 28_000 + "secret=farAway7"
    chain = "z=" * 200 + "auth=deepDown5"
    nest = "p: \"q: 'r: authkey: yyBot31yy'\""
    out = redact([far, chain, nest], OWN)
    assert "farAway7" not in out[0] and len(out[0]) > 250_000
    assert "deepDown5" not in out[1] and out[1].startswith("z=z=z=")
    assert "yyBot31yy" not in out[2]
