"""JSON texts: grammar, paths, and redaction in place."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from hushmark import Options
from hushmark.functions import jsontext
from hushmark.operators import jsonleaf

OPTIONS = Options(salt="json test salt of good length")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id INT, j STRING")


def redacted(spark, texts, options=OPTIONS):
    done = jsonleaf.redact_json(frame(spark, texts), "j", options)
    assert done.columns == ["id", "j", "redacted"]
    return [r.redacted for r in done.orderBy("id").collect()]


def test_only_hidden_tokens_change(spark):
    text = '{ "b" : 1.50e1,\t"a":[1, {"api_key" : "p4ssw0rd",\n"count": 123 , "pin_secret": 12}], "z":null,"t":true, "a" : "plain words", "e": "" }'
    got, = redacted(spark, [text])
    mark = json.loads(got)["a"]  # the last of the two wins here
    assert mark == "plain words"
    hidden = got[got.index("[HIDDEN:") : got.index("[HIDDEN:") + 15]
    assert got == text.replace("p4ssw0rd", hidden).replace('"pin_secret": 12', '"pin_secret": 0')


def test_repeated_keys_stay(spark):
    text = '{"a":1,"a":2,"password":"one","password":"two"}'
    got, = redacted(spark, [text])
    assert got.startswith('{"a":1,"a":2,"password":"[HIDDEN:') and got.count("[HIDDEN:") == 2
    rows = jsonleaf.leaves(frame(spark, [text]), "j").collect()
    assert [(r.path, r.steps, r.value) for r in rows] == [("$.a", ["a"], "1"), ("$.a", ["a"], "2"), ("$.password", ["password"], "one"), ("$.password", ["password"], "two")]


def test_a_key_beside_names_the_secret_in_any_order(spark):
    texts = [
        '{"value": "abc", "key": "password"}', '{"key": "password", "value": 17}', '{"key": "colour", "value": "red"}', '{"k\\u0065y": "passw\\u006frd", "value": "abc"}',
        '{"o": {"key": "password"}, "value": "abc"}', '{"l": [{"key": "token", "value": "x"}, {"value": "x"}], "a.l": {"value": "y", "key": "nothing"}}',
    ]
    found = {r.id: (r.parent, r.key, r.value_path) for r in jsonleaf.generic_pairs(frame(spark, texts), "j", OPTIONS).collect()}
    assert found == {0: ("$", "password", "$.value"), 1: ("$", "password", "$.value"), 3: ("$", "password", "$.value"), 5: ("$.l[0]", "token", "$.l[0].value")}
    got = [json.loads(x) for x in redacted(spark, texts)]
    assert got[0]["value"].startswith("[HIDDEN:") and got[1]["value"] == 0 and got[2]["value"] == "red" and got[3]["value"].startswith("[HIDDEN:")
    assert got[4]["value"] == "abc" and got[5]["l"][0]["value"].startswith("[HIDDEN:") and got[5]["l"][1]["value"] == "x" and got[5]["a.l"]["value"] == "y"


def test_keys_with_dots_and_quotes(spark):
    rows = jsonleaf.leaves(frame(spark, ['{"a.b":{"c":[1]},"a":{"b.c":[2]},"q\\"":{"":3}}']), "j").collect()
    assert [(r.path, r.steps, r.parent) for r in rows] == [
        ('$."a.b".c[0]', ["a.b", "c", "0"], '$."a.b".c'), ('$.a."b.c"[0]', ["a", "b.c", "0"], '$.a."b.c"'), ('$."q\\"".""', ['q"', ""], '$."q\\""')
    ]


def test_other_texts_are_lines(spark):
    texts = ["password=hunter2hunter2", '{"a" 1} token=abcdefgh1', "[1]", "", None, '{"a":1} x', '{"a":[1,2}', '{"password":"abc"']
    got = redacted(spark, texts)
    assert got[0].startswith("password=[HIDDEN:") and "token=[HIDDEN:" in got[1] and got[2:6] == ["[1]", "", None, '{"a":1} x']
    assert got[6] == texts[6] and "abc" not in got[7]
    leafy = jsonleaf.redact_leaves(frame(spark, texts[:4]), "j", OPTIONS).collect()
    assert {(r.type, r.path) for r in leafy} == {("line", None)} and len(leafy) == 4
    assert [r.masked for r in sorted(leafy, key=lambda r: r.id)] == got[:4]


def test_strings_are_decoded_before_they_are_scanned(spark):
    text = '{"m": "say \\"password=\\u0068unter2hunter2\\" now", "card": 4556737586899855, "c": "pay 4556 7375 8689 9855\\n"}'
    got = json.loads(redacted(spark, [text])[0])
    assert "unter2" not in got["m"] and got["m"].startswith('say "password=') and "[HIDDEN:" in got["m"]
    assert got["c"].startswith("pay [HIDDEN:") and got["c"].endswith("]\n")


def _valid(text):
    try:
        ok = isinstance(json.loads(text, parse_constant=lambda c: 1 / 0), dict)
        return ok
    except (ValueError, ZeroDivisionError):
        return False


def test_grammar_against_a_parser(spark):
    rng = random.Random(5)
    bits = ["{", "}", "[", "]", ":", ",", '"a"', '"b\\n"', '"\\x"', "1", "-0.5e3", "01", "true", "nul", "null", " ", "\n", '"']
    texts = ['{"a":' + "".join(rng.choices(bits, k=rng.randrange(1, 7))) + "}" for _ in range(1500)]

    def made(depth):
        kind = rng.randrange(5 if depth < 4 else 3)
        if kind < 3:
            return rng.choice(["1", "-2.5E+7", '"x y"', '"\\u00e9\\\\"', "null", "false", '""'])
        if kind == 3:
            return "[" + " ,".join(made(depth + 1) for _ in range(rng.randrange(4))) + "]"
        return "{" + ", ".join(f'"k{rng.randrange(3)}" :{made(depth + 1)}' for _ in range(rng.randrange(4))) + "} "

    texts += ['{"r":' + made(0) + "}" for _ in range(300)]
    found = frame(spark, texts).select("id", F.expr(jsontext.items("j")).alias("x")).select(
        "id", F.expr("array_join(transform(x, y -> y.t), '')").alias("back"), F.expr("size(filter(x, y -> y.st IS NOT NULL))").alias("n")
    )
    def count(v):
        return sum(map(count, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else 1

    for r in found.collect():
        assert (r.back is not None) == _valid(texts[r.id]), texts[r.id]
        if r.back is not None:
            assert r.back == texts[r.id]
            if len(set(texts[r.id].split('"'))) and "k" not in texts[r.id]:
                assert r.n == count(json.loads(texts[r.id]))


@pytest.mark.parametrize("make", [lambda n: '{"a":' + "[" * n + "1" + "]" * n + "}", lambda n: '{"a":[' + ",".join(['{"b":1}'] * n) + "]}"])
def test_deep_and_long_texts(spark, make):
    texts = [make(300), make(3000)]
    started = time.time()
    assert redacted(spark, texts) == texts
    assert time.time() - started < 60


def test_stream_and_clashing_columns(spark, tmp_path):
    df = frame(spark, ['{"password":"abc"}', "x"]).withColumn("m", F.lit("kept")).withColumn("l", F.lit(1)).withColumn("type", F.lit("t"))
    assert redacted(spark, ['{"password":"abc"}'])[0] in [r.redacted for r in jsonleaf.redact_json(df, "j", OPTIONS).collect()]
    df.write.parquet(str(tmp_path / "in"))
    rows = jsonleaf.redact_json(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "j", OPTIONS)
    rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("redacted LIKE '{\"password\":\"[HIDDEN:%' AND m = 'kept' AND l = 1").count() == 1
