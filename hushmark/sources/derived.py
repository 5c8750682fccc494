"""Log lines derived from the orders table.

The tables hold prose and columns, hardly any log lines. This view writes one
log line per order, every order once, in the shapes a log scanner meets: known
and unknown keys, safe look-alikes, JSON, generic pairs, URLs, card numbers,
nested values, quotes and unstructured secrets. The shape follows from the
order key, and what a line truly holds is its label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Standard SQL, shared by every engine that reads the table. ``h`` is the hex
# SHA-256 of the order key, ``k`` the key itself, ``b`` a mixed-case secret.
SHAPES = (
    ("SECRET", "concat('2031-05-17T04:21:09Z <notice> checkout worker gave up token=', b, ' attempt=3')"),
    ("SAFE", "concat('{\"at\": \"1893456000\", \"sev\": 4, \"text\": \"queue drained\", \"who\": \"by=user_', substr(h, 1, 4), '\", \"n\": 77}')"),
    ("SAFE", "concat('1893456000 <trace> build ready rev=', substr(h, 1, 40), ' shard=77')"),
    ("SAFE", "concat('{\"at\": \"1893456000\", \"text\": \"ping ok\", \"ref\": \"span=', substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12), '\", \"n\": ', CAST(k AS VARCHAR(20)), '}')"),
    ("SAFE", "concat('1893456000 <notice> bytes seen: [', substr(h, 1, 2), ' ', substr(h, 3, 2), ' ', substr(h, 5, 2), ' 7f 03] shard=77')"),
    ("SECRET", "concat('{\"at\": \"1893456000\", \"sev\": 2, \"text\": \"cart saved\", \"ref\": \"opt_', substr(h, 1, 4), '=', b, '\", \"n\": 77}')"),
    ("NOISE", "concat('1893456000 <warn> ping late blob=cut', chr(65533), 'short shard=', CAST(k AS VARCHAR(20)))"),
    ("SECRET", "concat('{\"at\": \"1893456000\", \"sev\": 1, \"ref\": \"Failed: 10.20.30.40 ', b, ' was refused\", \"n\": 77}')"),
    ("SECRET", "concat('{\"key\": \"api_token\", \"value\": \"', b, '\"}')"),
    ("SECRET", "concat('{\"clerk\": \"bo\", \"passphrase\": \"', b, '\", \"till\": {\"token\": \"', substr(h, 40, 12), '\", \"n\": ', CAST(k AS VARCHAR(20)), '}, \"tags\": [1, \"two\", {\"auth\": ', CAST(k AS VARCHAR(20)), '}], \"memo\": null}')"),
    ("SECRET", "concat('PUT https://depot.example.net/box?token=', b, '&part=2&sid=', substr(h, 1, 32), '&last and /plain?x=1')"),
    ("SECRET", "concat('paid by 4012 8888 8888 1881 for order ', CAST(k AS VARCHAR(20)), ' or 4', substr(translate(h, 'abcdef', '123456'), 1, 15), ' and 4012-8888-8888-1881.')"),
    ("SECRET", "concat('wrap=\"part=\"', substr(h, 1, 3), '\"\" map=a=b:', b, ' \"memo=x: y\" \"set=', substr(h, 1, 6), ' ', b, ' password q', substr(h, 1, 7), '\" login=pass=', b)"),
    ("SECRET", "concat('won', chr(39), 't keep password ', b, ' around; she', chr(39), 's token ', substr(h, 1, 9), ' again')"),
    ("SECRET", "concat('note: \"Failed: token: ', chr(39), b, chr(39), ' denied: x\" level=LOW, auth: \"', b, '\" more words')"),
    ("SAFE", "concat('image=docker.io/depot/till:', substr(h, 1, 3), ' path: /srv/depot/', substr(h, 1, 12), ' win: D:', chr(92), 'depot', chr(92), substr(h, 1, 12), ' addr: 2001:0db8:0000:0000:0042:8a2e:0370:7334 at 2031-05-17T04:21:09Z')"),
    ("SECRET", "concat('password = \"', b, '\" then secret : ', substr(h, 1, 10), ' name=', substr(h, 1, 5), ' key= ', CAST(k AS VARCHAR(20)), ' value=true')"),
    ("SECRET", "concat('token 4012 8888 8888 1881 left', substr(h, 1, 9), ' password: 4012-8888-8888-1881 tail', substr(h, 10, 8), ' key= 4012888888881881 end')"),
    ("SECRET", "concat('outer: \"middle: ', chr(39), 'inner: x=', substr(h, 1, 4), ' secret=', b, chr(39), ' end\" rest')"),
)

LABEL_SQL = f"CASE k % {len(SHAPES)} " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (kind, _) in enumerate(SHAPES)) + " END"
LINE_SQL = f"CASE k % {len(SHAPES)} " + " ".join(f"WHEN {i} THEN {line}" for i, (_, line) in enumerate(SHAPES)) + " END"
SECRET_SQL = "concat(substr(h, 1, 7), upper(substr(h, 8, 7)), 'Zq', substr(h, 15, 3))"

# A log line with the user and the context of its request before it.
TRACED_SQL = (
    "'username=user_' || substr(md5(CAST(line_id AS VARCHAR(20))), 1, 4) || ' context_id=' || CAST(line_id AS VARCHAR(20))"
    " || ' user=' || CAST(line_id % 10 AS VARCHAR(20)) || ' ' || line"
)


def order_logs(orders: DataFrame) -> DataFrame:
    """``source, line_id, line, label``: one log line per order."""
    base = orders.selectExpr(
        "o_orderpriority AS source",
        "o_orderkey AS k",
        "sha2(CAST(o_orderkey AS STRING), 256) AS h",
    ).selectExpr("source", "k", "h", f"{SECRET_SQL} AS b")
    line = LINE_SQL.replace("chr(65533)", "'\\uFFFD'")
    return base.selectExpr("source", "k AS line_id", f"{line} AS line", f"{LABEL_SQL} AS label")
