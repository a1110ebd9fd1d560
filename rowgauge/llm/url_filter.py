"""URL filters: rules for hosts and paths, and a logistic regression for all other URLs."""

from __future__ import annotations

import zlib

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of character n-grams, and their lengths.
BUCKETS = 1 << 16
SHORTEST, LONGEST = 3, 5
#: The regression is fitted on at most so many labelled URLs, the first by a hash of the URL.
MAX_LABELS = 10_000
#: Rules are part of the expression; a longer list raises ValueError.
MAX_RULES = 1_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Labels of hosts, by what the host is about, for a small labelled table.
BLOCKED_NAMES = """
casino-win play-casino best-casino online-casino casino-royal free-bets sure-bets bets-today betting-tips free-spins
jackpot-slots cheap-pills pills-online discount-pills pharma-pills cheap-meds spam-farm link-farm seo-spam spam-links
content-farm adult-x adult-video xxx-adult free-xxx ads-track track-ads ads-server click-track pop-ads win-prize
free-prize cheap-loans fast-loans
""".split()
ALLOWED_NAMES = """
library museum weather garden school university history cooking science music open-data code-docs travel mountain-hikes
film-review poems local-news maps language physics health sports-club farming theron thering inention stoner erand
hereth ststion ouble edther reand areth onthe nthin tisour entha inging ander therest oner hation tiones thoner ererin
thstre ndation blethe lyther whering ofand ththan edtion heston atther ithere isthe fordon
""".split()
_PREFIXES, _ENDINGS = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org", "test")
_PATHS = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/{}", "", "/about")


def labelled_urls(spark) -> DataFrame:
    """(url, blocked): a small labelled table, the names above as hosts with usual paths."""
    rows = []
    for blocked, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)):
        for name in names:
            for j in range(5 if blocked else 3):
                # Prefix, ending and path by a checksum, so that none of them tells the label.
                n = zlib.crc32(f"{name} {j}".encode())
                path = _PATHS[n // 64 % len(_PATHS)].format(n // 4096 % 997)
                rows.append((f"https://{_PREFIXES[n // 4 % 4]}{name}.{_ENDINGS[n // 16 % 4]}{path}", blocked))
    return spark.createDataFrame(rows, "url string, blocked int")


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls.

    A rule is a verdict and a host followed by a path, such as ("block", "example.org/en/"). It fits
    its host and all subdomains of it, where the path starts with its own. Of rules of equal length
    the first in the list wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        at = text.find("/")
        own_host, own_path = (text, "") if at < 0 else (text[:at], text[at:])
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, mark: str) -> Column:
    """All n-grams of a text with its ends marked, each with the part it comes from."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    found = []
    for n in range(SHORTEST, LONGEST + 1):
        starts = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - n + 1)).otherwise(
            F.array().cast("array<int>")
        )
        found.append(F.transform(starts, lambda i, n=n: F.concat(F.lit(mark), F.substring(marked, i, F.lit(n)))))
    return F.flatten(F.array(*found))


def _vectors(df: DataFrame, host: str, path: str, name: str) -> DataFrame:
    grams = F.concat(_grams(F.col(host), "h"), _grams(F.col(path), "p"))
    hashing = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="url_grams", outputCol=name)
    return hashing.transform(df.withColumn("url_grams", grams)).drop("url_grams")


def fit_url_model(labels: DataFrame, max_labels: int = MAX_LABELS, ridge: float = 0.001) -> LogisticRegressionModel:
    """Logistic regression on hashed character n-grams of host and path, from (url, blocked 0 or 1)."""
    known = (
        labels.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                      F.col("blocked").cast("double").alias("label"), F.xxhash64("url").alias("order"))
        .where("label IN (0, 1) AND host != ''")
        .orderBy("order", "label").limit(max_labels).coalesce(1)
    )
    table = _vectors(known, "host", "path", "url_vector").select("url_vector", "label").persist()
    try:
        return LogisticRegression(
            featuresCol="url_vector", regParam=ridge, standardization=False, maxIter=60, tol=1e-6
        ).fit(table)
    finally:
        table.unpersist()


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    model: LogisticRegressionModel,
    threshold: float = 0.5,
    key: str = "page_id",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row's `url`.

    `score` is the model's probability that the URL is to be blocked. `verdict` is `allow` or
    `block`: that of the longest rule that fits, else `block` where the score is `threshold` or
    more. A null URL or one without `://` has empty host and path, no rule fits it, its score is 0
    and it is allowed. Long and repeated URLs are judged like any other, each row by itself; nothing
    is shuffled. Other columns are not read. An empty table gives no rows.
    """
    parts = pages.select(F.col(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = model.transform(_vectors(parts, "host", "path", "url_vector"))
    chance = F.when((F.col("host") == "") & (F.col("path") == ""), F.lit(0.0)).otherwise(
        vector_to_array(F.col("probability"))[1]
    )
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    return scored.select(key, "host", "path", rule.alias("rule"), verdict.alias("ruled"), chance.alias("score")).select(
        key, "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
