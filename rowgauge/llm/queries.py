"""Registered queries of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import benchmark_overlaps
from .licenses import license_labels
from .mixing import mixed
from .near_dup import near_duplicates
from .neighbours import nearest
from .oracles import LICENSES, NEAR_DUP, PHRASES, SET_JOIN
from .phrases import collocations
from .quality import judged
from .runs import periodic_runs, with_planted_runs
from .scratch import Scratch
from .secrets import dictionary, fit_secret_model, labelled_findings, scan_secrets
from .sentence_spans import remove_repeats
from .set_join import linked_sets
from .tokens import read_digests, write_tokens
from .url_filter import fit_url_model, judge_urls, labelled_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op5_minhash_near_dedup": NEAR_DUP,
    "op9_license_scan": LICENSES,
    "op12_ngram_join": SET_JOIN,
    "op13_phrases": PHRASES,
}

#: Target shares of tokens; values not named share what `*` has.
MIXTURE = {
    "source": {"src0": 0.15, "*": 0.85},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": {"prose": 0.85, "table": 0.05, "legal": 0.05, "contact": 0.05},
}
END_ID = 1
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer that the token files are made with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    model = fit_url_model(labelled_urls(spark))
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, model)


@query
def op2_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated weights and the draw of half of all tokens, or as many as meet MIXTURE, for every document."""
    return mixed(table(spark, sf_dir, "documents"), MIXTURE, fraction=0.5)


@query
def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token blocks and read them back."""
    path = Scratch(spark).path("tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return read_digests(spark, path)


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates for secrets in all documents, judged by the forest."""
    words = dictionary(spark, tokenizer_path())
    model = fit_secret_model(labelled_findings(spark, tokenizer_path()), words)
    return scan_secrets(table(spark, sf_dir, "documents"), model, words, F.col("source"))


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), similarity=85)


@query
def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose sentences repeated from elsewhere, with what is left of their text."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "first_doc_ids", "n_sentences", "n_removed", "text")


@query
def op8_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in all documents."""
    return benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return license_labels(table(spark, sf_dir, "documents"))


@query
def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality posterior of every document."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which have a periodic tail put in."""
    found = periodic_runs(table(spark, sf_dir, "documents"), with_planted_runs)
    return found.drop("collapsed")


@query
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by four-word shingles at similarity 0.85."""
    return linked_sets(table(spark, sf_dir, "documents"), similarity=85, size=4)


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of each language."""
    return collocations(table(spark, sf_dir, "documents"))
