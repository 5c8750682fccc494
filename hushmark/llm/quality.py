"""Quality classifier: document evidence combined with host and path rates by hierarchical empirical Bayes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, only, row_key, written

LABELS = 20_000  # labelled rows the classifier is fitted on, at most
FEATURES = (
    "length", "word_size", "distinct", "top_word", "capitals", "symbols", "bars", "shouts", "digits", "stops", "commas", "lines", "short_lines",
)
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{}~"
_DIGITS = b"0123456789"


def features(text: str | None) -> list[float]:
    """Shares and logarithms that do not depend on the language; all 0 for a blank text."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    n, size = len(words), len(raw)
    share = lambda some: (size - len(raw.translate(None, some))) / size
    counts = Counter(words)
    lines = text.split("\n")
    return [
        math.log1p(n),
        math.log1p(size / n),
        math.log1p(len(counts)) / math.log1p(n),
        max(counts.values()) / n,
        share(_CAPITALS),
        min(1.0, 10 * share(_SYMBOLS)),
        min(1.0, 10 * share(b"|")),
        min(1.0, 10 * share(b"!?")),
        share(_DIGITS),
        text.count(".") / n,
        text.count(",") / n,
        len(lines) / n,
        sum(len(x) < 20 for x in lines) / len(lines),
    ]


def _wide(x: np.ndarray) -> np.ndarray:
    """Features and their squares, after a constant."""
    return np.column_stack([np.ones(len(x)), x, x * x])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> dict:
    """Logistic regression by Newton steps on standardised features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = _wide(np.clip((x - mean) / scale, -6, 6))
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "w": w}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    a = _wide(np.clip((x - model["mean"]) / model["scale"], -6, 6))
    return 1 / (1 + np.exp(-np.clip(a @ model["w"], -12, 12)))


def featured(docs: DataFrame, doc_id: str, text: str, host: str, path: str) -> DataFrame:
    """``doc_id, k1, k2, site, host, x``: small rows with the features of each text."""
    k1, k2 = row_key(doc_id, text)
    part = lambda c: F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(c).cast("string")))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.concat(part(host), F.lit("\x1f"), part(path)).alias("site"), part(host).alias("host"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "k1", "k2", "site", "host", "x"])

    return rows.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, site string, host string, x array<double>")


def train(rows: DataFrame, labels: DataFrame, bound: int = LABELS) -> dict | None:
    """The classifier, from at most ``bound`` labelled rows in the order of a hash; None without both classes."""
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    sample = rows.join(known, "doc_id").select("x", "y").orderBy(F.xxhash64("k1", "doc_id")).limit(bound).collect()
    y = np.array([r.y for r in sample])
    if len(y) == 0 or y.min() == y.max():
        return None
    model = fit(np.array([r.x for r in sample]), y)
    return model | {"prior": float(y.mean())}


def _strength(n: float, n2: float, groups: int, spread: float, within: float, mean: float) -> float:
    """Weight of a prior in documents: how little groups differ beyond what their sizes explain."""
    freedom = n - n2 / n if n else 0.0
    between = max(0.0, (spread - max(groups - 1, 0) * within) / freedom) if freedom > 0 else 0.0
    return float(np.clip(mean * (1 - mean) / between - 1 if between > 0 else 1e6, 1.0, 1e6))


def site_rates(scored: DataFrame) -> tuple[DataFrame, float]:
    """``site, n, total, host_n, host_total, host_rate, weight`` and the weight of the global rate.

    Counts and sums of the classifier's probabilities per path and per host, by grouped
    aggregation with map-side sums. Two weights say how many documents the rate of the
    level above is worth; both follow from all paths and hosts by the method of moments.
    """
    paths = written(scored.groupBy("site", "host").agg(F.count("*").alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("square")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"), F.sum("square").alias("host_square"))
    whole = hosts.agg(F.sum("host_n"), F.sum("host_total"), F.sum(F.col("host_n") * F.col("host_n")), F.count("*"), F.sum(F.col("host_square") - F.col("host_total") * F.col("host_total") / F.col("host_n"))).first()
    n, total, n2, groups, inner = (float(v or 0) for v in whole)
    mean = float(np.clip(total / n if n else 0.5, 1e-6, 1 - 1e-6))
    off = lambda t, m, base: F.sum(F.col(m) * (F.col(t) / F.col(m) - base) * (F.col(t) / F.col(m) - base))
    spread = float(hosts.agg(off("host_total", "host_n", F.lit(mean))).first()[0] or 0)
    top = _strength(n, n2, int(groups), spread, inner / n if n else 0.0, mean)
    hosts = hosts.withColumn("host_rate", (F.col("host_total") + F.lit(top * mean)) / (F.col("host_n") + F.lit(top)))
    joined = written(paths.join(hosts.drop("host_square"), "host"), "sites")
    below = joined.agg(
        off("total", "n", F.col("host_total") / F.col("host_n")), F.sum(F.col("n") * F.col("n") / F.col("host_n")), F.count("*"), F.sum(F.col("square") - F.col("total") * F.col("total") / F.col("n"))
    ).first()
    spread, share, groups, inner = (float(v or 0) for v in below)
    freedom = max(n - share, 0.0)
    low = _strength(freedom or 1.0, 0.0, int(groups - whole[3]) + 1, spread, inner / n if n else 0.0, mean) if freedom else 1e6
    return joined.withColumn("weight", F.lit(low)), mean


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", least: float = 0.5, bound: int = LABELS) -> DataFrame:
    """``doc_id, k1, k2, p, host_rate, path_rate, posterior, kept``, one row per document.

    ``p`` is the classifier's probability of good quality, fitted on at most ``bound``
    labelled rows. A host's rate is shrunk to the global rate, a path's rate to its
    host's; both leave the document itself out. The posterior odds are the document's
    evidence (its odds over the prior odds of the labels) times the odds of its path.
    Rows with a posterior below ``least`` are not ``kept``. Null text is blank, a null host
    or path is a site of its own, labels that are null or of unknown ids do not count, and
    labels that repeat are averaged. Without labels of both classes everything is kept.
    """
    rows = written(featured(docs, doc_id, text, host, path), "features")
    model = train(rows, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            p = probability(model, values) if model else np.full(len(values), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(p)], ["doc_id", "k1", "k2", "site", "host", "p"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, site string, host string, p double")
    sites, mean = site_rates(scored)
    found = join_hot(scored.drop("host"), sites.drop("host", "square"), "site", "n", max(rows.count(), 1))
    p, w = F.col("p"), F.col("weight")
    # the document's own share is taken out of its path and its host
    path_rate = (F.col("total") - p + w * F.col("host_rate")) / (F.col("n") - 1 + w)
    rate = F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda x: F.log(x / (1 - x))
    prior = model["prior"] if model else 0.5
    logit = odds(p) - F.lit(math.log(prior / (1 - prior))) + odds(rate)
    posterior = 1 / (1 + F.exp(-logit))
    kept = posterior >= least if model else F.lit(True)
    return found.select("doc_id", "k1", "k2", "p", "host_rate", rate.alias("path_rate"), posterior.alias("posterior"), kept.alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """``docs`` without the rows whose id and text the classifier rejects."""
    found = quality(docs, labels, **columns)
    return only(docs, found.where("kept").select("k1", "k2").distinct(), columns.get("doc_id", "doc_id"), columns.get("text", "text"), one=False)
