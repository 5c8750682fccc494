"""URL query parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, pairs, pseudonym, scores
from ..options import Options
from ..plans import scan


def parameters(df: DataFrame, url: str, options: Options) -> DataFrame:
    """``idx, name, value, sensitive, random`` of every parameter of a URL column."""
    others = [c for c in df.columns if c != url]
    query = F.expr(f"split(substring({url}, locate('?', {url}) + 1), '&')")
    rows = df.where(F.col(url).contains("?")).select(*others, F.posexplode(query).alias("idx", "param"))
    named = rows.where(F.col("param").contains("=")).select(
        *others, "idx", F.expr(pairs.before("param", "=")).alias("name"), F.expr(pairs.after("param", "=")).alias("value")
    )
    return named.withColumns(
        {
            "sensitive": F.expr(keys.is_sensitive_key("name", options)),
            "random": F.expr(scores.exceeds("value", f"{options.entropy_threshold}D", options)),
        }
    )


def masked(df: DataFrame, url: str, options: Options, out: str = "masked") -> DataFrame:
    """URL column with the values of sensitive or random parameters replaced."""
    leaf = f"named_struct('m', {scan.QUERY}, 'c', {url})"
    parts = scan._open_query("q.c", options)
    done = f"transform({parts}, (x, i) -> concat(x.p, {scan._out('x', options, None)}, x.s))"
    body = f"transform(array({leaf}), q -> CASE WHEN contains(q.c, '?') THEN array_join({done}, '') ELSE q.c END)[0]"
    keyed = pseudonym.with_key(df, options)
    return pseudonym.without_key(keyed.withColumn(out, F.expr(body)))
