"""From raw documents to token files: STAGES in order, each the next one's input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `docs`. Extra columns are carried along, nulls in any column are allowed, and an empty table goes
through all stages. What each operator does with nulls, ties and repeated rows is in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgauge.llm import mixing
from rowgauge.llm.decontaminate import without_overlaps
from rowgauge.llm.near_dup import near_duplicates
from rowgauge.llm.quality import keep_good
from rowgauge.llm.queries import END_ID, MIXTURE, tokenizer_path
from rowgauge.llm.scratch import Scratch, free_names
from rowgauge.llm.tokens import read_digests, write_tokens

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that classifier and site together take for bad go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays.

    Only the documents that go, copies of others, are joined with the rest.
    """
    (doc_id,) = free_names(docs, "copy_doc_id")
    copies = near_duplicates(docs, similarity=80).where("NOT kept").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(copies, docs["doc_id"] == copies[doc_id], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, each row by its own text."""
    return without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of documents whose tokens meet the target shares of source, language and topic."""
    return mixing.sample_mixture(docs, MIXTURE, fraction=0.5)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; returns (doc_id, start, n_tokens, ids_crc32) as read from them."""
    path = Scratch(spark).path("tokens")
    write_tokens(docs, path, tokenizer_path(), END_ID)
    return read_digests(spark, path)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near-dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: The stages train a model, rake and draw in rounds, which SQL cannot say; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to `documents`; each stage's rows are written and read back as the next one's."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for number, (name, stage) in enumerate(STAGES):
        table = f"{number}-{name}"
        docs = scratch.keep(stage(spark, docs, sf_dir), table)
        if before:
            scratch.drop(before)
        before = table
    return docs
