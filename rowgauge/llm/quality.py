"""Document quality: a classifier's evidence on top of what is known of host and path."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, free_names, send_package, shared_folder

#: The classifier is fitted on at most so many labelled documents, drawn by a hash of doc_id.
MAX_LABELS = 20_000
#: Documents whose posterior is lower are rejected.
THRESHOLD = 0.5

#: Sites of so many bytes or fewer are broadcast to the texts.
BROADCAST_BYTES = 64 << 20

FEATURES = 12
_SYMBOLS = b"#$%&*@^~|<>{}=+_\\/[]"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOG_ODDS_LIMIT = 30.0


def text_features(text: str | None) -> np.ndarray:
    """Twelve measures of a whole text, each roughly within 0..1; all zero but the last if it has no word."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    found = np.zeros(FEATURES)
    if not words:
        found[11] = 1.0
        return found
    n, size = len(words), len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]

    def share(of: bytes) -> float:
        return (size - len(raw.translate(None, of))) / size

    found[0] = min(1.0, np.log1p(n) / 10)
    found[1] = len(set(words)) / n
    found[2] = min(1.0, sum(map(len, words)) / n / 20)
    found[3] = share(_SYMBOLS)
    found[4] = share(_UPPER)
    found[5] = share(b"0123456789")
    found[6] = raw.count(b"|") / n
    found[7] = sum(a == b for a, b in zip(words, words[1:])) / n
    found[8] = min(1.0, raw.count(b"!") / n)
    found[9] = 1 - len(set(lines)) / len(lines)
    found[10] = min(1.0, (raw.count(b".") + raw.count(b"?")) / n)
    return found


def _features(column: Column) -> Column:
    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(text_features)

    return measured(column)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression with a small ridge, by Newton's method."""
    spread = x.std(axis=0)
    scale = np.where(spread > 1e-9, spread, 1.0)
    middle = x.mean(axis=0)
    z = np.hstack([(x - middle) / scale, np.ones((len(x), 1))])
    penalty = np.full(z.shape[1], ridge * len(x) / 100)
    penalty[-1] = 0.0
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return np.append(weights, w[-1] - weights @ middle)


@dataclass
class QualityModel:
    """Fitted by fit_quality. `sites` has one row per host and path; the rest are a few numbers."""

    weights: list[float]
    base_log_odds: float
    sites: DataFrame | None
    host: str
    path: str

    def evidence(self, features: Column) -> Column:
        """Log likelihood ratio of good against bad, from the classifier alone."""
        total = F.lit(self.weights[-1] - self.base_log_odds)
        for k, w in enumerate(self.weights[:-1]):
            total = total + F.lit(w) * features[k]
        return F.greatest(F.lit(-_LOG_ODDS_LIMIT), F.least(F.lit(_LOG_ODDS_LIMIT), total))

    def judge(self, docs: DataFrame, features: Column) -> tuple[DataFrame, list[str]]:
        """`docs` with evidence, site prior and posterior, and the names of these three columns."""
        names = free_names(docs, "evidence", "site_quality", "posterior", "site_host", "site_path", "site_sum", "site_n", "site_host_quality", "site_strength", "site_features")
        evidence, prior, posterior, host, path, total, n, mean, strength, held = names
        if self.sites is None:
            one = F.lit(1.0)
            return docs.withColumn(evidence, F.lit(0.0)).withColumn(prior, one).withColumn(posterior, one), names[:3]
        sites = self.sites.toDF(host, path, total, n, mean, strength)
        own = _probability(F.col(evidence) + F.lit(self.base_log_odds))
        # A document's own score is taken out of its site's sum.
        joined = (
            docs.withColumn(held, features)
            .withColumn(evidence, self.evidence(F.col(held)))
            .join(
                sites,
                docs[self.host].eqNullSafe(sites[host]) & docs[self.path].eqNullSafe(sites[path]),
                "left",
            )
            .withColumn(
                prior,
                (F.col(strength) * F.col(mean) + F.greatest(F.lit(0.0), F.col(total) - own))
                / (F.col(strength) + F.greatest(F.lit(0), F.col(n) - 1)),
            )
            .withColumn(posterior, _probability(F.col(evidence) + _log_odds(F.col(prior))))
        )
        return joined.select(*docs.columns, evidence, prior, posterior), names[:3]


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _probability(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _log_odds(p: Column) -> Column:
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(held / (1 - held))


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior weight, in documents, that makes the spread of group means what it is (by moments).

    Between-group variance is what is left of the variance of means after that expected from
    within; the smaller it is, the more a group is drawn to its parent.
    """
    p = F.col(mean)
    row = groups.where("n > 1").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - p, 2)).alias("spread"),
        F.sum((F.col("squares") - F.pow("total", 2) / F.col("n")) / (F.col("n") - 1)).alias("within"),
        F.sum(F.col("n") * p * (1 - p)).alias("whole"),
    ).first()
    if not row.n:
        return 10.0
    between = max(0.0, (row.spread - row.within) / row.n)
    whole = max(row.whole / row.n, 1e-9)
    return float(min(1e6, max(1.0, whole / max(between, 1e-9) - 1)))


def fit_quality(features: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
                max_labels: int = MAX_LABELS) -> QualityModel:
    """Fit on a table of (doc_id, host, path, features) and labels (doc_id, quality 0 or 1).

    The classifier sees at most `max_labels` labelled rows. Everything else covers all documents:
    their scores are summed per host and path, and the strength with which a path is drawn to its
    host, and a host to the whole, is estimated from the spread of these sums. Per-site sums are
    combined before they are shuffled and stay distributed. Labels that are null, neither 0 nor 1,
    or of unknown documents are left out; with fewer than two classes there is no model and every
    document's posterior is 1.
    """
    shared_folder(features.sparkSession)
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("y")).where("y IN (0, 1)")
    # Drawn where the rows lie: sorting for the first ones would send each task's share to the driver.
    share = min(1.0, 0.95 * max_labels / max(1, known.count()))
    sample = (
        features.join(known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(share * (1 << 30))),
                      features["doc_id"] == known["label_id"])
        .select("y", "features").limit(max_labels).collect()
    )
    y = np.array([r.y for r in sample], dtype=float)
    if len(set(y)) < 2:
        return QualityModel([0.0] * (FEATURES + 1), 0.0, None, host, path)
    weights = fit_logistic(np.array([r.features for r in sample]), y)
    model = QualityModel([float(w) for w in weights], float(np.log(y.mean() / (1 - y.mean()))), None, host, path)
    p = _probability(model.evidence(F.col("features")) + F.lit(model.base_log_odds))
    paths = (
        features.select(F.col(host).alias("host"), F.col(path).alias("path"), p.alias("p"))
        .groupBy("host", "path")
        .agg(F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares"), F.count("*").alias("n"))
        .checkpoint()
    )
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("total", "squares", "n")))
    whole = paths.agg(F.sum("total") / F.sum("n")).first()[0]
    pull = _strength(hosts.withColumn("mean", F.lit(whole)), "mean")
    hosts = hosts.select(
        F.col("host").alias("of"), ((F.col("total") + pull * whole) / (F.col("n") + pull)).alias("host_quality")
    )
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["of"]))
    pull = _strength(joined, "host_quality")
    model.sites = joined.select("host", "path", "total", "n", "host_quality", F.lit(pull).alias("strength"))
    return model


def document_features(docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, host, path, text_hash, features) in one pass, written to the shared folder."""
    scratch = Scratch(docs.sparkSession)
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), host, path, _text_hash(F.col("text")).alias("text_hash"),
        _features(F.col("text").cast("string")).alias("features"),
    )
    return scratch.keep(narrow, "features")


def judged(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
           threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, host, path, evidence, site_quality, posterior, kept) of every document.

    `evidence` is the classifier's log likelihood ratio from twelve measures of the whole text;
    `site_quality` the shrunken share of good documents among the others of the same host and path;
    `posterior` the two combined by Bayes' rule; `kept` if it is `threshold` or more.

    Null and empty texts have no words, which is a measure of its own. Null hosts and paths are a
    site like any other. Repeated rows are judged alike, each a row. Other columns are not read. An
    empty table gives no rows; without labels of both classes all is kept with a posterior of 1.
    """
    features = document_features(docs, host, path)
    model = fit_quality(features, labels, host, path)
    found, (evidence, prior, posterior) = model.judge(features, F.col("features"))
    return found.select(
        "doc_id", host, path, evidence, prior, posterior, (F.col(posterior) >= threshold).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with their columns, that `judged` keeps.

    Where the sites have BROADCAST_BYTES or fewer, as measured, they come to the texts: rows are
    filtered where they are read, no text is shuffled, and the measures are taken once more from the
    text. More sites are joined with the narrow table of measures, and the rejected rows with the
    texts by doc_id, site and a hash of the text, so that a large site is dealt evenly.
    """
    send_package(docs.sparkSession)
    features = document_features(docs, host, path)
    model = fit_quality(features, labels, host, path)
    if model.sites is None:
        return docs
    widths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ("host", "path")]
    size = model.sites.agg(F.coalesce(F.sum(widths[0] + widths[1] + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        model.sites = F.broadcast(model.sites)
        found, (_, _, posterior) = model.judge(docs, _features(F.col("text").cast("string")))
        return found.where(F.col(posterior) >= threshold).select(*docs.columns)
    found, (_, _, posterior) = model.judge(features, F.col("features"))
    names = free_names(docs, "gone_doc_id", "gone_host", "gone_path", "gone_text_hash")
    gone = found.where(F.col(posterior) < threshold).select("doc_id", host, path, "text_hash").distinct().toDF(*names)
    own = [docs["doc_id"].cast("long"), docs[host], docs[path], _text_hash(docs["text"])]
    same = reduce(Column.__and__, [a.eqNullSafe(gone[b]) for a, b in zip(own, names)])
    return docs.join(gone, same, "left_anti")
