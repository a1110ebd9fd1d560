from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowgauge.llm.queries import QUERIES, URL_RULES
from rowgauge.llm.url_filter import fit_url_model, judge_urls, labelled_urls

from .helpers import SF


def brute_force(url, rules):
    """(host, path, rule, verdict of the rule)."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = []
    for decision, rule in rules:
        at = rule.find("/")
        own_host, own_path = (rule, "") if at < 0 else (rule[:at], rule[at:])
        if (host == own_host or host.endswith("." + own_host)) and path.startswith(own_path):
            fits.append((len(rule), rule, decision))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


@pytest.fixture(scope="module")
def model(spark):
    return fit_url_model(labelled_urls(spark))


def test_registered_query_equals_brute_force(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op1_url_filter"](spark, SF).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute_force(urls[r.page_id], URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_odd_urls(spark, model):
    urls = [
        None, "", "no scheme", "://", "http://", "http:///p", "HTTP://A.Org", "http://A.ORG/", "http://ORG/x",
        "http://xorg/", "ftp://É.Com/fr/", "http://a.com/fr", "http://example.org/en/12", "http://example.org/en/2",
        "http://w.example.org/es/?q=/x", "http://a.com?u=http://b.org/", "http://a.com#f/g", "a\nb://h.org/p\nq?x",
        "http://" + "a." * 3000 + "com/de/" + "x" * 20_000, "http://a.com/fr/", "http://a.com/fr/", "x://y://z.org/",
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = judge_urls(df.selectExpr("*", "1 AS features", "2 AS probability", "3 AS url_vector"), URL_RULES, model)
    rows = {r.page_id: r for r in got.collect()}
    assert len(rows) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule, verdict = brute_force(url, URL_RULES)
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert all(rows[i].verdict == "allow" and rows[i].score == 0 for i in range(5))


def test_empty_table_and_no_rules(spark, model):
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(none, URL_RULES, model).collect() == []
    one = spark.createDataFrame([(1, "http://free-casino.test/win")], "page_id long, url string")
    assert judge_urls(one, [], model).first().rule is None
    with pytest.raises(ValueError):
        judge_urls(one, [("allow", f"h{k}/") for k in range(2000)], model)


def test_held_out_accuracy(spark):
    labels = labelled_urls(spark)
    kept = F.pmod(F.xxhash64("url"), F.lit(5)) != 0
    held_out = labels.where(~kept).withColumn("page_id", F.xxhash64("url"))
    judged = judge_urls(held_out, [], fit_url_model(labels.where(kept))).join(held_out, "page_id")
    right, n = judged.agg(F.avg(((F.col("verdict") == "block") == (F.col("blocked") == 1)).cast("int")), F.count("*")).first()
    assert n > 25 and right >= 0.85
