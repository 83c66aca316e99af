"""Quality classification by hierarchical empirical Bayes.

A logistic regression over a text's form gives each document's own evidence, as a log-likelihood
ratio of good against bad. What is known of its site comes from all documents of the site: labels where
there are any and the regression's probability elsewhere, summed by path and host. Rates are shrunk down
the hierarchy, paths toward their host and hosts toward all, by beta priors whose strengths are
estimated from how much rates vary beyond chance (method of moments): a site of few documents
stays near its parent. A document is left out of its own site's sums. The posterior combines the
path's log odds with the document's ratio.

The regression is fitted on about ``LABELLED`` labelled rows at most, drawn by a hash of their id; all
sums are over all documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import WORD, hash_fraction, materialise

LABELLED = 20_000
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 10_000.0


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without port and user; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def path_of(url: Column, depth: int = 1) -> Column:
    """Host and the first ``depth`` folders of a URL's path."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.concat_ws("/", host_of(url), F.array_join(F.slice(F.split(F.ltrim(path, F.lit("/")), "/"), 1, depth), "/"))


def features(text: Column) -> Column:
    """An array of a text's measures: all of the whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.array(
        F.log1p(F.size(words).cast("double")),
        F.size(F.array_distinct(words)) / n,
        F.least(chars / n, F.lit(40.0)),
        F.least(count("[#*$%&|<>]") / n, F.lit(4.0)),
        F.least(count("!") / n, F.lit(4.0)),
        count("[A-Z]") / chars,
        count("[0-9]") / chars,
        F.least(count("\n") / n, F.lit(1.0)),
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the last for the constant, of a ridge logistic regression by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty @ w
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def _strength(rates: DataFrame, level: str, parent: Column) -> float:
    """Beta prior strength of ``rates`` (k, n) around ``parent``: what variance chance leaves over."""
    r = rates.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - parent, 2)).alias("spread"), F.sum(parent * (1 - parent)).alias("chance"), F.sum("n").alias("n"), F.sum(F.col("n") * parent * (1 - parent)).alias("v")
    ).first()
    if not r["n"] or not r["v"]:
        return STRONGEST
    between = (r["spread"] - r["chance"]) / r["n"]
    return STRONGEST if between <= 0 else float(min(STRONGEST, max(WEAKEST, r["v"] / r["n"] / between - 1)))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """(id, doc_score, host_rate, path_rate, score, kept) of every row of ``docs``.

    ``host`` and ``path`` are columns of ``docs``; null is a site like any other. Several labels of one id count
    by their mean, null labels not at all; without labels of both kinds the regression is even and only
    sites speak. Null or empty texts are measured as empty; repeated rows and null ids keep their rows.
    """
    known = labels.where(F.col(label).isNotNull() & labels[id].isNotNull()).groupBy(labels[id].cast("long").alias("l")).agg((F.avg(labels[label].cast("double")) >= 0.5).cast("double").alias("y"))
    base = docs.select(docs[id].cast("long").alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), features(docs[text].cast("string")).alias("x"))
    base = materialise(base.join(known, F.col("id") == F.col("l"), "left").drop("l"), "features")
    n = base.where("y is not null").count()
    rows = base.where("y is not null").where(hash_fraction(F.lit("fit"), F.col("id")) < min(1.0, LABELLED / max(n, 1))).select("x", "y").collect()
    x, y = np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) == 2:
        w, rate = fit_logistic(x, y), float(y.mean())
    else:
        w, rate = np.zeros(9), 0.5
    even = float(np.log(rate / (1 - rate)))
    z = F.lit(float(w[-1]))
    for i, v in enumerate(w[:-1]):
        z = z + F.lit(float(v)) * F.col("x")[i]
    scored = base.select("id", "host", "path", z.alias("z"), "y").withColumn("p", 1 / (1 + F.exp(-F.col("z")))).withColumn("s", F.coalesce("y", "p")).drop("y")
    paths = materialise(scored.groupBy("host", "path").agg(F.sum("s").alias("k"), F.count("*").cast("double").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("k").alias("hk"), F.sum("n").alias("hn"))
    total = hosts.agg(F.sum("hk").alias("k"), F.sum("hn").alias("n")).first()
    mean = min(1 - 1e-6, max(1e-6, (total["k"] or 0.5) / (total["n"] or 1.0)))
    host_strength = _strength(hosts.select(F.col("hk").alias("k"), F.col("hn").alias("n")), "host", F.lit(mean))
    host_rate = lambda k, n: (k + host_strength * mean) / (n + host_strength)
    sites = paths.join(hosts, "host")
    path_strength = _strength(sites.withColumn("r", host_rate(F.col("hk"), F.col("hn"))), "path", F.col("r"))
    at = scored.join(sites, ["host", "path"])
    # a document does not speak for its own site
    at = at.withColumn("host_rate", host_rate(F.col("hk") - F.col("s"), F.col("hn") - 1))
    at = at.withColumn("path_rate", (F.col("k") - F.col("s") + path_strength * F.col("host_rate")) / (F.col("n") - 1 + path_strength))
    at = at.withColumn("score", 1 / (1 + F.exp(-(_logit(F.col("path_rate")) + F.col("z") - even))))
    return at.select("id", F.col("p").alias("doc_score"), "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept"))
