"""Table jobs: tokens, baselines, JSON, evaluation, streams, skew."""

import random

from pyspark.sql import functions as F

from hushmark import Options
from hushmark.operators import baseline, evaluate, jsonleaf, numbers, redaction, vocabulary
from hushmark.plans import scan
from hushmark.sources import lines as line_source
from hushmark.streaming import stream

from . import golden

BASE = Options(salt=golden.SALT)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_cards(line):
    """Every window of connected digits, as the definition says."""
    at = [i for i, c in enumerate(line) if c in "0123456789"]
    found = []
    for a in range(len(at)):
        for n in range(13, 20):
            idx = at[a : a + n]
            if len(idx) < n or any(y - x > 2 or (y - x == 2 and line[x + 1] not in " -") for x, y in zip(idx, idx[1:])):
                continue
            s, e = idx[0], idx[-1] + 1
            if s > 0 and (line[s - 1].isalnum() or (line[s - 1] in "-." and s > 1 and line[s - 2].isalpha())):
                continue
            if e < len(line) and (line[e].isalnum() or (line[e] in "-." and e + 1 < len(line) and line[e + 1].isalpha())):
                continue
            digits = "".join(line[i] for i in idx)
            if len(set(digits)) >= 4 and luhn(digits):
                found.append((s, e))
    merged = []
    for s, e in sorted(found):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def test_cards_against_brute_force(spark):
    rng = random.Random(7)
    lines = []
    for i in range(400):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append("".join(rng.choice("0123456789") for _ in range(rng.choice([1, 3, 4, 4, 4, 13, 16]))))
        lines.append(rng.choice(["", "x", "id-", "a."]) + rng.choice([" ", "-", "", ". "]).join(parts) + rng.choice(["", "z", "-q", " end"]))
    df = spark.createDataFrame(list(enumerate(lines)), "i INT, line STRING")
    got = {}
    for r in numbers.merged(df).collect():
        got.setdefault(r.i, []).append((r.start - 1, r.stop - 1))
    assert sum(map(len, got.values())) > 20
    for i, line in enumerate(lines):
        assert sorted(got.get(i, [])) == brute_cards(line), line


def test_tokens_are_lossless(spark):
    texts = ["a b\t'c d\" e' \"x\\\" y\" [z]", "it's open", "", "   ", "\\\\\"", "é=ü, {x: 'y'}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, line STRING")
    table = vocabulary.token_rows(df)
    back = {r.i: r.line for r in vocabulary.rebuild(table, "i").collect()}
    assert all(back.get(i, "") == t for i, t in enumerate(texts))
    assert [r.token for r in table.where("i = 1").orderBy("pos").collect()] == ["it's open"]


def test_baseline(spark):
    same = spark.createDataFrame([("a", i, 0, 3.5, i + 1) for i in range(100)] + [("b", 1, 0, 5.0, 1)], "source STRING, line_id BIGINT, pos INT, score DOUBLE, rank INT")
    rows = {r.source: r for r in baseline.thresholds(same, BASE).collect()}
    assert rows["a"].ready and abs(rows["a"].threshold - 3.5) < 1e-9
    assert not rows["b"].ready and rows["b"].threshold == BASE.entropy_threshold


def test_hot_source_baseline_is_exact(spark):
    """One source holds nearly all lines: the first N by order, no more, no fewer."""
    df = spark.range(5000).selectExpr("IF(id % 50 = 0, 'cold', 'hot') AS source", "id AS line_id", "concat('wordy', id, ' plain', id) AS line")
    got = baseline.samples(df, BASE.with_(adaptive_samples=20)).collect()
    for source in ("hot", "cold"):
        mine = sorted((r.line_id, r.pos) for r in got if r.source == source)
        ids = [i for i in range(5000) if (i % 50 == 0) == (source == "cold")]
        every = df.where(F.col("source") == source).select("line_id", F.explode(F.expr(scan.kept_tokens("line", BASE))).alias("s"))
        want = sorted((r.line_id, r.s.pos) for r in every.where(F.col("line_id") <= ids[40]).collect())[:20]
        assert mine == want


def test_adaptive_changes_later_lines_only(spark):
    rows = [("s", i, f"letters{i % 10} there") for i in range(60)] + [("s", 100, "zq7Kd mixwordzz9"), ("t", 100, "zq7Kd mixwordzz9")]
    df = spark.createDataFrame(rows, "source STRING, line_id BIGINT, line STRING")
    o = BASE.with_(adaptive_samples=10, adaptive=True)
    limits = baseline.thresholds(baseline.samples(df, o), o)
    out = {(r.source, r.line_id): r.redacted for r in baseline.redact_adaptive(df, limits, o).collect()}
    assert out[("t", 100)] == redaction.redact_lines(df.where("source = 't'"), BASE).first().redacted


def test_json_leaves_and_struct(spark):
    text = '{"key": "password", "value": "SuperSecret123", "cvv": 123, "deep": [[{"a": {"token": "x1y2z3", "ok": true, "n": null}}], "plain"], "card": "4556737586899855"}'
    df = spark.createDataFrame([(1, text), (2, "[1]"), (3, "no json")], "id INT, j STRING")
    got = {r.path: (r.type, r.masked) for r in jsonleaf.redact_leaves(df, "j", BASE).collect()}
    assert got["$.value"][1].startswith("[HIDDEN:") and got["$.key"][1].startswith("[HIDDEN:")
    assert got["$.cvv"] == ("number", "0")
    assert got["$.deep[0][0].a.token"][1].startswith("[HIDDEN:")
    assert got["$.deep[0][0].a.ok"] == ("boolean", "true") and got["$.deep[0][0].a.n"] == ("null", None)
    assert got["$.deep[1]"] == ("string", "plain") and got["$.card"][1] == "[HIDDEN:525c70]"
    typed = df.where("id = 1").select(F.from_json("j", "key STRING, value STRING, cvv INT, card STRING, m MAP<STRING, STRING>").alias("d"))
    done = jsonleaf.redact_struct(typed, "d", BASE)
    assert done.schema["d"].dataType.simpleString() == typed.schema["d"].dataType.simpleString()
    d = done.first().d
    assert d.cvv == 0 and d.value.startswith("[HIDDEN:") and d.card == "[HIDDEN:525c70]" and d.m is None


def test_evaluation(spark):
    rows = [("a", "a", "SECRET"), ("b", "[HIDDEN:1]", "SECRET"), ("c", "[HIDDEN:2]", "SAFE"), ("d", "d", "SAFE"), ("e", "[HIDDEN:3]", "NOISE")]
    df = spark.createDataFrame(rows, "line STRING, redacted STRING, label STRING")
    r = evaluate.confusion(df).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.accuracy) == (1, 2, 1, 1, 0.6)
    assert {(x.line, x.mistake) for x in evaluate.mistakes(df).collect()} == {("a", "leak"), ("c", "false_positive")}


def test_golden_join_finds_differences(spark):
    actual = spark.createDataFrame([(1, "x"), (2, "y")], "id INT, redacted STRING")
    expected = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "id INT, expected STRING")
    assert {r.id for r in evaluate.golden_mismatches(actual, expected, "id").collect()} == {2, 3}


def test_text_source_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_bytes(b"password=abc123\r\n\nplain words\n" + b"x " * 70_000 + b"token=q1w2e3\n")
    batch = redaction.redact_lines(line_source.from_text(spark, str(folder)), BASE)
    want = sorted(r.redacted for r in batch.collect())
    assert len(want) == 4 and not any("abc123" in w or "q1w2e3" in w or w.endswith("\r") for w in want)
    out = stream.redact_stream(line_source.from_text_stream(spark, str(folder)), BASE)
    stream.write_stream(out.select("redacted"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


SCHEMA = "source STRING, line_id BIGINT, line STRING"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def test_adaptive_stream_over_batches(spark, tmp_path):
    """Samples add up over batches, a limit stays once it is there, a batch run again changes nothing, a reset learns anew."""
    src, work = tmp_path / "in", str(tmp_path / "work")
    o = BASE.with_(adaptive_samples=15, adaptive=True)
    odd = "zq7Kd mixwordzz9"
    put(spark, src, [("s", i, f"letters{i}") for i in range(10)] + [("t", 1, "letters1"), (None, 5, odd)])
    put(spark, src, [("s", i, f"letters{i}") for i in range(10, 30)] + [("t", 2, "letters2")])
    put(spark, src, [("s", 30, odd), ("t", 3, odd)])

    def run():
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
        stream.adaptive_stream(rows, o, work).awaitTermination()

    run()
    states = [{r.source: (r.n, r.ready, r.threshold) for r in stream.baseline_state(spark, work, k).collect()} for k in range(3)]
    assert states[0] == {"s": (10, False, None), "t": (1, False, None)}
    assert states[1]["s"][:2] == (15, True) and states[1]["t"] == (2, False, None) and states[2]["s"] == states[1]["s"]
    whole = spark.createDataFrame([("s", i, f"letters{i}") for i in range(15)], SCHEMA)
    want = baseline.thresholds(baseline.samples(whole, o), o).first().threshold
    assert abs(states[1]["s"][2] - want) < 1e-9
    got = {(r.source, r.line_id): r.redacted for r in spark.read.parquet(f"{work}/redacted").collect()}
    assert len(got) == 35
    static = redaction.redact_lines(spark.createDataFrame([("t", 3, odd)], SCHEMA), BASE).first().redacted
    assert got["t", 3] == got[None, 5] == static
    limit = BASE.with_(entropy_threshold=states[1]["s"][2])
    assert got["s", 30] == redaction.redact_lines(spark.createDataFrame([("s", 30, odd)], SCHEMA), limit).first().redacted
    # the last batch again, as after a crash: its commit is lost
    (tmp_path / "work" / "checkpoint" / "commits" / "2").unlink()
    (tmp_path / "work" / "checkpoint" / "commits" / ".2.crc").unlink(missing_ok=True)
    run()
    assert {(r.source, r.line_id): r.redacted for r in spark.read.parquet(f"{work}/redacted").collect()} == got
    assert {r.source: (r.n, r.ready, r.threshold) for r in stream.baseline_state(spark, work, 2).collect()} == states[2]
    stream.reset_sources(spark, work, 2, "s")
    put(spark, src, [("s", 31, odd), ("t", 4, "letters4")])
    run()
    after = {r.source: (r.n, r.ready) for r in stream.baseline_state(spark, work, 3).collect()}
    assert not after.get("s", (0, False))[1] and after["t"] == (states[2]["t"][0] + 1, False)
    assert spark.read.parquet(f"{work}/redacted").where("source = 's' AND line_id = 31").first().redacted == static


def test_first_lines_and_rounds(spark, monkeypatch):
    """Bounds against sorting; sources whose first lines give too few samples go on until they have them or end."""
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.randrange(400), "x") for _ in range(900)] + [(None, 1, "x"), ("c", None, "x"), ("d", 5, "x")]
    got = {r.source: (r.bound, r.n_lines, r.more) for r in baseline.first_lines(spark.createDataFrame(rows, SCHEMA).repartition(7), 40).collect()}
    for s in "abd":
        ids = sorted(i for x, i, _ in rows if x == s)
        assert got[s] == (ids[:40][-1], min(40, len(ids)), len(ids) > 40)
    assert set(got) == set("abd")
    monkeypatch.setattr(baseline, "GROWTH", 3)
    lines = [("late", i, "a b c" if i < 100 else f"letters{i} wordy{i}") for i in range(130)] + [("never", i, "a b") for i in range(50)] + [("soon", i, f"wordy{i}") for i in range(30)]
    found = baseline.samples(spark.createDataFrame(lines, SCHEMA).repartition(5), BASE.with_(adaptive_samples=20)).collect()
    assert sorted((r.source, r.line_id, r.pos, r.rank) for r in found) == sorted(
        [("late", 100 + k // 2, k % 2, k + 1) for k in range(20)] + [("soon", k, 0, k + 1) for k in range(20)]
    )


def test_baseline_does_not_exchange_the_text(spark):
    """Even without broadcasts by size: only ids, samples and limits move."""
    df = spark.range(400).selectExpr("concat('s', id % 3) AS source", "id AS line_id", "concat('letters', id, ' the long text') AS line")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o = BASE.with_(adaptive_samples=10, adaptive=True)
        done = baseline.redact_adaptive(df, baseline.thresholds(baseline.samples(df, o), o), o)
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Sort " not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_plans_stay_narrow(spark):
    """Redaction and findings need no exchange; the salt is not in the plan."""
    df = spark.range(10).selectExpr("concat('password=', id) AS line", "id AS line_id")
    for plan in (redaction.redact_lines(df, BASE), redaction.find(df, BASE)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in text and "Python" not in text
        assert golden.SALT not in plan._jdf.queryExecution().toString()


def test_redaction_is_worked_out_once(spark):
    """Filters and other uses of the redacted column do not copy its expression."""
    df = spark.range(10).selectExpr("concat('password=w0lf', id) AS line", "id AS line_id")
    done = redaction.redact_lines(df, BASE)
    copies = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("'[HIDDEN:'") + d._jdf.queryExecution().optimizedPlan().toString().count("[HIDDEN:, ")
    used = done.where("redacted LIKE '%]' AND NOT redacted <=> line").selectExpr("redacted", "length(redacted) AS n", "upper(redacted) AS u")
    assert copies(done) > 0 and copies(used) == copies(done)
    assert used.count() == 10


def test_nesting_as_deep_as_the_text(spark):
    """Each level against plain taking off of quotes; long lines of many quoted words stay linear."""
    deep = "x"
    for k in range(9):
        deep = f"\"a{k} '{deep}' b\"" if k % 2 else f"'{deep}'"
    rows = [(1, deep), (2, "\"p\" 'q \"r\"' s"), (3, "'w' " * 20_000)]
    got = vocabulary.nested_tokens(spark.createDataFrame(rows, "i INT, line STRING"))
    two = sorted((r.level, r.token) for r in got.where("i = 2").collect())
    assert two == [(0, "\"p\""), (0, "'q \"r\"'"), (0, "s"), (1, "\"r\""), (1, "p"), (1, "q"), (2, "r")]
    assert got.where("i = 1").agg(F.max("level")).first()[0] >= 1
    assert got.where("i = 3").count() == 40_000


def test_functions_of_sql(spark):
    from hushmark.functions import sqlfunctions

    names = sqlfunctions.register(spark, BASE)
    spark.createDataFrame([(1, "token=w0lfpack 4012888888881881"), (2, None)], "id INT, line STRING").createOrReplaceTempView("fn_lines")
    df = spark.sql(f"SELECT id, {', '.join(f'{n}(line) AS {n}' for n in names)} FROM fn_lines")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and golden.SALT not in plan
    one, none = df.orderBy("id").collect()
    want = redaction.redact_lines(spark.table("fn_lines"), BASE).where("id = 1").first().redacted
    assert one.hush_redact == want and [f.kind for f in one.hush_findings] == ["key", "card"] and one.hush_cards[0].start == 16
    assert all(none[n] is None for n in names)


def test_correlation_of_a_hot_secret(spark):
    df = spark.range(3000).selectExpr("concat('src', id % 3) AS source", "id AS line_id", "IF(id % 3 = 0, 'token=hotSecret1', concat('token=cold', id)) AS line")
    top = redaction.correlate(redaction.find(df, BASE)).orderBy(F.desc("n")).first()
    assert top.n == 1000 and top.n_sources == 1


def test_bare_lines_agree_with_the_full_plan(spark):
    """The short path must never change a result: a rule that matches nothing switches it off."""
    from hushmark import Rule
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = line_source.split_documents(docs, "doc_id", "text").select("doc_id", "line_no", "line").cache()
    for change in ({}, {"entropy_threshold": 100.0}, {"entropy_threshold": 2.0}, {"bigram_check": False}, {"bigram_default": -8.0}, {"min_secret_length": 3, "entropy_threshold": 3.0}):
        o = BASE.with_(**change)
        never = o.with_(custom_rules=(Rule(r"\Anever-matches-[0-9]{40}\z", "Never"),))
        short = redaction.redact_lines(texts, o)
        full = redaction.redact_lines(texts, never, out="expected").drop("line")
        n = short.join(full, ["doc_id", "line_no"]).where("NOT redacted <=> expected").count()
        assert n == 0, change
