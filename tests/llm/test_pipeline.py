from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from rowgauge.llm.queries import MIXTURE
from rowgauge.llm.scratch import Scratch, free_names

from .helpers import SCHEMA, SF, prose
from .test_decontaminate import brute_force as leaks
from .test_near_dup import brute_force as groups
from .test_tokens import expected


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives, each written and read again."""
    scratch, docs, out = Scratch(spark), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.keep(stage(spark, docs, SF), name)
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "near-dedup", "decontaminate", "mix", "tokens"]
    for name, (before, after) in stages.items():
        if name != "tokens":
            assert after.columns == before.columns
            assert after.exceptAll(before).isEmpty()


def test_quality_keeps_labelled_good_documents(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(good - ids(after)) <= 0.02 * len(good) and len(bad & ids(after)) <= 0.1 * len(bad)


def test_near_dedup_equals_brute_force(stages):
    before, after = stages["near-dedup"]
    want = groups([(r.doc_id, r.text) for r in before.collect()], 80)
    assert ids(after) == {i for i, (_, c) in want.items() if i == c}


def test_decontaminate_equals_brute_force_on_short_documents(spark, stages):
    before, after = stages["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    short = [(r.doc_id, r.text) for r in before.collect() if len(r.text) < 2000]
    assert {i for i, _ in short} - ids(after) == {i for i, _ in leaks(short, items)}


def test_mix_draws_by_probability(spark, stages):
    before, after = stages["mix"]
    from rowgauge.llm.mixing import mixed

    assert ids(after) == ids(mixed(before, MIXTURE, fraction=0.5).where("kept"))


def test_tokens_are_those_of_the_texts(stages):
    before, after = stages["tokens"]
    rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
    assert [tuple(r) for r in after.orderBy("start").collect()] == expected(rows)


def test_registered_and_equal_to_its_stages(spark, stages):
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in contract.oracle_sql()
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(map(tuple, stages["tokens"][1].collect()))


def test_odd_rows_go_through_all_stages(spark):
    rows = [
        (None, prose(1), None, None, None), (1, None, "en", "src0", 0), (2, "", None, "src1", None), (3, "word", "xx", None, 4),
        (4, prose(2, 20_000), "en", "src0", 1), (5, prose(3), "de", "src2", 1), (5, prose(3), "de", "src2", 1), (6, prose(3), "de", "src2", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS kept", "2 AS copy_doc_id", "3 AS topic", "4 AS start")
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark).keep(stage(spark, docs, SF), name)
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [r.start for r in docs.orderBy("start").collect()][:1] in ([], [0])


def test_near_dedup_of_odd_rows(spark):
    rows = [(None, prose(1)), (None, prose(1)), (2, prose(1)), (3, prose(1)), (5, prose(3)), (5, prose(3)), (6, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "5", "6", "7", "None", "None"]


def test_decontaminate_and_mix_of_odd_rows(spark):
    (leak,) = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").select("text").first()
    rows = [(None, leak)] + [(None, prose(k)) for k in range(50)] + [(7, leak), (7, prose(60)), (8, prose(61)), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).withColumn("leak_doc_id", F.lit(1))
    kept = corpus_pipeline.decontaminate(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str(r) for r in rows if r[1] != leak)
    drawn = corpus_pipeline.mix(spark, kept.where("doc_id IS NULL"), SF)
    assert 10 < drawn.count() < 40


def test_empty_table_goes_through_all_stages(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark).keep(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_every_dealt_operator_is_registered():
    found = {n.split("_")[0] for n in contract.queries() if n.startswith("op")}
    assert found == {f"op{k}" for k in range(1, 14)}


def test_free_names(spark):
    df = spark.range(1).select(F.lit(1).alias("A"), F.lit(2).alias("a_"))
    assert free_names(df, "a", "b", "b") == ["a__", "b", "b_"]
