"""Rule tables and text files: ids that stay, rules that are checked first and matched in blocks."""

import pytest
from pyspark.sql import functions as F

from hushmark import Options, Rule
from hushmark.operators import redaction, ruletable, vocabulary
from hushmark.sources import lines
from hushmark.streaming import stream

OWN = Options(salt="the tests' own salt, long enough")


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def ids(df):
    return {(r.source.rsplit("/", 1)[1], r.line_id): r.line for r in df.collect()}


def test_line_ids_count_each_file(spark, tmp_path, small_blocks):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {"a.log": [f"first {i} " + "x" * (i % 70) for i in range(120)], "b.log": ["one", "", "three\r", "é" * 900, "five"], "c.log": [""]}
    for name, rows in texts.items():
        (folder / name).write_bytes("\n".join(rows).encode() + b"\n")
    want = {(name, i): row.removesuffix("\r") for name, rows in texts.items() for i, row in enumerate(rows)}
    got = lines.from_text(spark, str(folder))
    assert got.columns == ["source", "line_id", "line"] and ids(got) == want
    assert lines._raw(spark.read.format("text"), str(folder)).select("file", "block").distinct().count() > 8
    (folder / "aa.log").write_text("new\nfile\n" * 90)
    again = ids(lines.from_text(spark, str(folder)))
    assert {k: v for k, v in again.items() if k[0] != "aa.log"} == want and len(again) == len(want) + 180


def test_a_stream_gives_the_same_ids(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.log").write_text("\n".join(f"secret=w{n}lf{i}" for i in range(20)) + "\n")
    raw = lines.from_text_stream(spark, str(folder), maxFilesPerTrigger="2")
    stream.numbered_stream(raw, OWN, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.source, r.line_id): r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = redaction.redact_lines(lines.from_text(spark, str(folder)), OWN)
    assert got == {(r.source, r.line_id): r.redacted for r in batch.collect()} and len(got) == 60


RULES = [("custom", 0, "[0-9]+$", "End"), ("custom", 1, "^van-", "Van"), ("custom", 2, "lm", "Inner"), ("custom", 3, "^van-k", "Second"), ("custom", 4, None, "None"), ("custom", 5, "^.{30,}$", None)]
WORDS = ["van-klm", "van-77", "xxlm9", "short", "lm", "nothing", "a" * 31, "tail99999"]


@pytest.mark.parametrize("block", [1024, 2])
def test_rules_meet_distinct_words(spark, monkeypatch, block):
    monkeypatch.setattr(ruletable, "BLOCK", block)
    table = spark.createDataFrame(RULES, "kind STRING, ord INT, pattern STRING, name STRING")
    vocab = spark.createDataFrame([(w, i + 1) for i, w in enumerate(WORDS)], "token STRING, n INT")
    got = {r.token: (r.n, r.rule_pos, r.rule_ord, r.rule) for r in ruletable.match_rules(vocab, table).collect()}
    # leftmost first, then list order; words under five bytes are not looked at
    assert got == {"van-klm": (1, 1, 1, "Van"), "van-77": (2, 1, 1, "Van"), "xxlm9": (3, 3, 2, "Inner"), "a" * 31: (7, 1, 5, ""), "tail99999": (8, 5, 0, "End")}
    options = OWN.with_(custom_rules=tuple(Rule(p, n or "") for _, _, p, n in RULES if p))
    row_by_row = {r.token: r.rule for r in vocabulary.with_rule(vocab, options).collect()}
    assert row_by_row == {t: v[3] for t, v in got.items()}
    assert {r.token for r in ruletable.allowed_by(vocab, table).collect()} == {w for w in WORDS if w not in ("short", "lm", "nothing")}
    assert ruletable.match_rules(vocab, table.where("false")).count() == 0 and ruletable.allowed_by(vocab, table.where("false")).count() == 0


def test_lists_of_groups(spark):
    table = spark.createDataFrame([("a", 0, "^word", "A"), ("b", 0, "word$", "B")], "list STRING, ord INT, pattern STRING, name STRING")
    vocab = spark.createDataFrame([("a", "wordy"), ("b", "wordy"), ("b", "sword"), ("c", "words")], "list STRING, token STRING")
    assert {(r["list"], r.token, r.rule) for r in ruletable.match_rules(vocab, table, "list").collect()} == {("a", "wordy", "A"), ("b", "sword", "B")}


def test_a_table_drives_the_redaction(spark):
    listed = spark.createDataFrame([("safe", '[{"pattern": "^bay-[0-9]+$", "name": "Bay"}]'), ("custom", '[{"pattern": "^van-", "name": "Van"}, {"pattern": "^bay-", "name": "No"}]')], "kind STRING, j STRING")
    options = ruletable.options_with_rules(vocabulary.rule_table(listed, "j", None), OWN)
    assert options.custom_rules == (Rule("^van-", "Van"), Rule("^bay-", "No")) and options.safe_rules == (Rule("^bay-[0-9]+$", "Bay"),)
    df = spark.createDataFrame([("van-12345 bay-12345 bay-x9",)], "line STRING")
    assert redaction.redact_lines(df, options).first().redacted == "[HIDDEN:Van] bay-12345 [HIDDEN:No]"
    many = spark.range(ruletable.INLINE + 1).select(F.lit("custom").alias("kind"), F.col("id").cast("int").alias("ord"), F.lit("x").alias("pattern"), F.lit("n").alias("name"))
    with pytest.raises(ValueError, match="match them as a table"):
        ruletable.options_with_rules(many, OWN)


def test_bad_patterns_fail_before_the_job(spark):
    df = spark.createDataFrame([("x",)], "line STRING")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    before = jobs()
    for bad in (OWN.with_(custom_rules=(Rule("ok", "a"), Rule("(x", "b"))), OWN.with_(safe_rules=(Rule("[z-", "b"),)), OWN.with_(key_patterns=("+",))):
        for build in (redaction.redact_lines, redaction.find):
            with pytest.raises(ValueError, match="invalid rule pattern"):
                build(df, bad)
    assert jobs() == before
    table = spark.createDataFrame([("custom", 0, "fine", "a"), ("custom", 1, "(x", "b")], "kind STRING, ord INT, pattern STRING, name STRING")
    with pytest.raises(ValueError, match="invalid rule pattern"):
        ruletable.match_rules(spark.createDataFrame([("words",)], "token STRING"), table)
