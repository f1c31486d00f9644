"""The pipeline stage by stage: rows, columns, and effects."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridcast.llm import exact_dedup, mixing, sentencepiece, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
        out[-1].count()
    return out


def counted(df):
    return {r.doc_id: r["count"] for r in df.groupBy("doc_id").count().collect()}


def test_stages_by_their_operators(spark, stages):
    docs, clean, once, apart, mix, coded = stages
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = toxicity.judged(docs, toxicity.fit(docs, labels)).where("predicted = 0")
    assert counted(clean) == {r.doc_id: 1 for r in good.collect()}
    assert counted(once) == {r.doc_id: 1 for r in exact_dedup.exact_groups(clean).where("kept").collect()}
    kept = simhash.simhash_components(once).where("doc_id = component_id")
    assert counted(apart) == {r.doc_id: 1 for r in kept.collect()}
    plan = mixing.plan(apart, labels).where("times > 0")
    assert counted(mix) == {r.doc_id: r.times for r in plan.collect()}
    assert counted(coded) == counted(mix)
    assert all(x.columns == docs.columns for x in stages[:5]) and coded.columns == [*docs.columns, "ids", "round_trip"]
    texts = sentencepiece.decoded(coded, sentencepiece.model_bytes())
    assert texts.where("decoded <> text OR NOT round_trip").count() == 0


def test_run_gives_the_last_stage(spark, stages):
    assert counted(corpus_pipeline.run(spark, SF)) == counted(stages[-1])


def test_stages_keep_odd_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lost_id", F.lit("a")).withColumn("_id", F.lit(1)).withColumn("_one", F.lit(2)).withColumn("Shard", F.lit(3)).withColumn("size", F.lit(None).cast("int"))
    for some in (docs.limit(40), docs.where(F.lit(False))):
        for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, some, SF)
            assert made.columns == (docs.columns if place < 4 else [*docs.columns, "ids", "round_trip"])
            made.count()


def test_encoding_stage_decodes_every_text(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Two words"), (2, None), (3, ""), (4, "a\u2581b \n\u00e9\U0001f600")], "doc_id long, text string")
    made = corpus_pipeline.encoding_stage(spark, docs, SF).collect()
    assert [(r.doc_id, r.text) for r in made] == [tuple(r) for r in docs.collect()] and [len(r.ids) > 0 for r in made] == [True, False, False, True]
    readable = sentencepiece.readable
    monkeypatch.setattr(sentencepiece, "readable", lambda c: F.replace(readable(c), F.lit("words"), F.lit("word")))
    marked = {r.doc_id: r.round_trip for r in corpus_pipeline.encoding_stage(spark, docs, SF).collect()}
    assert marked == {1: False, 2: True, 3: True, 4: True}  # the row stays, marked
