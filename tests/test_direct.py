"""Texts settled in plain Python: the same as the expressions give, and all log lines are settled there."""

import random

import pytest
from pyspark.sql import functions as F

from hushmark import Options
from hushmark.functions import jsontext, pseudonym
from hushmark.llm.common import ship
from hushmark.operators import jsonleaf
from hushmark.options import Rule
from hushmark.plans import direct
from hushmark.sources import derived

OPTIONS = Options(salt="direct test salt of good length")
WORDS = [
    "password", "token", "Key", "name", "error", "denied", "aB3xQ9zLk27Wm", "4012 8888 8888 1881", "4012-8888-8888-1881", "5555555555554444", "1893456000", "docker.io/a:b1", "true",
    "https://a.b/c?x=1&token=q1w2e3&d", "C:\\dir\\aB3xQ9z", "2001:0db8::1", "cvvvpwtkwd", "interesting", "9f8e7d6c5b4a39281706", "�x�Yz09�qr", "0123456789abcdef01234567", "user_ab1", "a", "",
]
MARKS = ["=", ":", " ", "  ", "\"", "'", "?", "&", "\\", ",", "[", "}", "\t", "-", ".", "==", "=\"", ": \"", "\\\"", "\n", "\x0b", "\x01", "\x7f"]


def lines(rng, n):
    return ["".join(rng.choice(WORDS) + rng.choice(MARKS) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def objects(rng, n):
    quoted = lambda x: direct._encoded(x)

    def value(depth):
        k = rng.randrange(7 if depth < 3 else 4)
        if k < 2:
            return quoted(rng.choice(lines(rng, 1) + WORDS))
        if k < 4:
            return rng.choice(["1", "-2.5E+7", "98765432109.87", "null", "false", '"\\u0000\\/p\\u0061ss=aB3xQ9zLk27Wm"', '"\\u00e9"'])
        if k == 4:
            return "[" + ", ".join(value(depth + 1) for _ in range(rng.randrange(3))) + "]"
        return made(depth + 1)

    def made(depth=0):
        names = ["key", "value", "password", "a", "Token", "tokenThatIs9Very8LongXq", "na me"]
        return "{" + ",".join(f'{quoted(rng.choice(names))} :{value(depth)}\n' for _ in range(rng.randrange(5))) + "}"

    return [made() for _ in range(n)]


def by_expressions(monkeypatch, df, options):
    with monkeypatch.context() as m:
        m.setattr(direct, "settles", lambda options: False)
        done = jsonleaf.redact_json(df, "j", options).withColumn("parses", F.expr(f"{jsontext.items('redacted')} IS NOT NULL"))
        assert "Python" not in done._jdf.queryExecution().toString()
        return {r.id: (r.redacted, r.parses) for r in done.collect()}


@pytest.mark.parametrize("changes", [{}, {"bigram_check": False, "entropy_threshold": 2.7, "min_secret_length": 3}, {"bigram_default": -7.123, "sensitive_keys": ("na", "Q")}])
def test_same_as_the_expressions(spark, monkeypatch, changes):
    rng = random.Random(3)
    texts = lines(rng, 400) + objects(rng, 300)
    texts += ["".join(rng.sample(x, len(x))) for x in objects(rng, 60)] + [x[: rng.randrange(len(x))] for x in objects(rng, 60)]
    texts += ["", " ", None, "é token=aB3xQ9zLk27Wm", '{"password":"é"}', "password=éaB3xQ9zLk27", '{"a":' * 60 + "1" + "}" * 60, "token=" + "a=" * 30 + "aB3xQ9zLk27Wm", "xY9" * 700, "\"'" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, j STRING")
    bad = df.limit(1).selectExpr("-1 AS id", "CAST(X'746F6B656E3D61423378513980FFFE7A4C6B3237' AS STRING) AS j")  # broken UTF-8 is repaired
    df = df.unionByName(bad).repartition(8).cache()
    options = OPTIONS.with_(**changes)
    got = {r.id: (r.redacted, r.parses) for r in jsonleaf.with_parses(jsonleaf.redact_json(df, "j", options), "redacted").collect()}
    want = by_expressions(monkeypatch, df, options)
    assert sum("[HIDDEN:" in (v[0] or "") for v in want.values()) > 200 and sum(v[1] for v in want.values()) > 250
    assert {texts[i]: (v, got[i]) for i, v in want.items() if v != got[i]} == {}


def test_log_lines_are_settled(spark):
    """Every shape of log line is done in one pass of Python: the expressions cost several times as much and ran out of time."""
    ship(spark)
    logs = derived.order_logs(spark.range(400).selectExpr("'s' AS o_orderpriority", "id AS o_orderkey")).select("line_id", "line")
    keyed = pseudonym.with_key(logs, OPTIONS)
    done = keyed.select("line_id", direct.redacted_json(OPTIONS, F.col("line"), F.col(pseudonym.IPAD), F.col(pseudonym.OPAD)).alias("r"))
    done = {r.line_id: r.r for r in done.collect()}
    assert len(done) == 400 and None not in done.values()
    assert done == {r.line_id: r.redacted for r in jsonleaf.redact_json(logs, "line", OPTIONS).collect()}
    assert OPTIONS.salt not in jsonleaf.redact_json(logs, "line", OPTIONS)._jdf.queryExecution().toString()


def test_patterns_of_users_stay_with_the_expressions(spark):
    df = spark.createDataFrame([(1, "AB12345 x"), (2, '{"a":"AB12345"}')], "id INT, j STRING")
    done = jsonleaf.redact_json(df, "j", OPTIONS.with_(custom_rules=(Rule("^[A-Z]{2}[0-9]{5}$", "Account"),)))
    assert "ArrowEvalPython" not in done._jdf.queryExecution().toString()
    assert [r.redacted for r in done.orderBy("id").collect()] == ["[HIDDEN:Account] x", '{"a":"[HIDDEN:Account]"}']


def test_deep_objects():
    deep = lambda n: '{"a":' * n + "1" + "}" * n
    assert direct.is_object(deep(300)) is True and direct.is_object(deep(300)[:-1]) is False
    assert direct.is_object(deep(100_000)) is None  # left to the expressions


def test_clashing_columns_and_order(spark):
    df = spark.createDataFrame([("a", '{"password":"abc"}', 1)], "j STRING, redacted STRING, z INT")
    done = jsonleaf.redact_json(df, "redacted", OPTIONS)
    assert done.columns == ["j", "redacted", "z"] and done.first().redacted.startswith('{"password":"[HIDDEN:')
    told = jsonleaf.with_parses(df, "redacted", "j")
    assert told.columns == ["j", "redacted", "z"] and told.first().j is True
    assert [r.parses for r in jsonleaf.with_parses(spark.createDataFrame([(None,), ("[1]",), ('{"a":NaN}',), ("{}",)], "t STRING"), "t").collect()] == [False, False, False, True]
