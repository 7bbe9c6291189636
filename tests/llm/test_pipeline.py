"""The pipeline stage by stage, each against what its operator says of the same table."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from burdenflow.llm import mixing, near_copies, quality, toxicity
from burdenflow.llm.store import keep
from burdenflow.llm.tokens import default_vocabulary, encoder

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not found")


@pytest.fixture(scope="module")
def tables(spark):
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(keep(stage(spark, docs[-1], FOLDER), f"test-{name.replace(' ', '-')}"))
    return docs


def rows(df):
    return Counter(df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_stages_return_the_columns_of_documents(tables):
    assert all(t.dtypes == tables[0].dtypes for t in tables[1:-1])
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_decisions_of_the_filters_take_effect(spark, tables):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = quality.rank_quality(tables[0], labels).filter("predicted = 1").select("doc_id")
    assert rows(tables[1]) == rows(tables[0].join(good, "doc_id"))
    clean = toxicity.score_toxicity(tables[1], labels).filter("predicted = 0").select("doc_id")
    assert rows(tables[2]) == rows(tables[1].join(clean, "doc_id"))


def test_one_of_each_class_stays(tables):
    members = near_copies.class_members(tables[2])
    assert sorted(r.doc_id for r in tables[3].collect()) == sorted(r.class_id for r in members.select("class_id").distinct().collect())


def test_the_mix_takes_what_it_says(tables):
    copies = {r.doc_id: r.copies for r in mixing.mix(tables[3]).collect() if r.copies}
    assert {r.doc_id: r.n for r in tables[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == copies


def test_all_of_the_mix_is_packed(tables):
    encode = encoder(default_vocabulary()).encode
    want = sum(len(encode(r.text, 1)) // 4 for r in tables[4].collect())
    assert tables[5].agg(F.sum("length")).first()[0] == want
    sizes = tables[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert sizes.filter("n != end or n > 2048").isEmpty()


def test_run_gives_the_last_table(spark, tables):
    names = [c for c in tables[5].columns if c != "sequence_id"]
    assert Counter(corpus_pipeline.run(spark, FOLDER).select(names).agg(F.sum("length"), F.count("*")).collect()) == Counter(
        tables[5].select(names).agg(F.sum("length"), F.count("*")).collect()
    )
