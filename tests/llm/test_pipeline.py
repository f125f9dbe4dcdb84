"""The stages of the corpus pipeline on a small corpus with planted cases."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from molframe.llm import simhash
from tests.conftest import DATA


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_stages_keep_columns_and_rows(spark, docs):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "toxicity", "simhash_near_dedup", "mixing", "sentencepiece"]
    symbols = docs.limit(1).withColumn("text", F.lit("1234 !!")).withColumn("doc_id", F.lit(-1).cast("long"))
    one = pipeline.language_stage(spark, docs.unionByName(symbols), DATA)
    assert one.columns == docs.columns and one.where("doc_id = -1").count() == 0 and one.count() > 0.97 * docs.count()
    two = pipeline.toxicity_stage(spark, one, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    clean = one.join(labels.where("toxic = 0"), "doc_id", "left_semi")
    assert two.columns == docs.columns and two.join(clean, "doc_id", "left_semi").count() >= 0.98 * clean.count()
    three = pipeline.dedup_stage(spark, docs, DATA)
    ids = {r.doc_id for r in three.select("doc_id").collect()}
    assert three.columns == docs.columns and ids == {r.component_id for r in simhash.similar(docs).collect()}
    four = pipeline.mixing_stage(spark, docs, DATA)
    assert four.columns == docs.columns and 0.7 * docs.count() < four.count() < 1.3 * docs.count()
    five = pipeline.token_stage(spark, docs, DATA)
    assert five.count() == docs.count() and five.join(docs, "doc_id").where("decoded <> text").count() == 0


def test_repeated_and_null_rows_leave_one(spark, docs):
    few = docs.orderBy("doc_id").limit(3)
    null = few.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("quite another text of its own"))
    out = pipeline.dedup_stage(spark, few.unionByName(few).unionByName(null), DATA)
    assert out.count() == pipeline.dedup_stage(spark, few, DATA).count() + 1
    assert pipeline.dedup_stage(spark, docs.limit(0), DATA).count() == 0


def test_run(spark, docs, tmp_path):
    out = pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "decoded"] and 0 < out.count() < 1.3 * docs.count()


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES])
def test_clashing_columns_and_odd_rows(spark, docs, stage):
    """Further columns of any name and type, nulls, blanks, a very long text and repeated rows, in every stage."""
    few = docs.limit(40)
    long = few.limit(1).withColumn("doc_id", F.lit(900_001).cast("long")).withColumn("text", F.repeat(F.lit("long words go on and on "), 45_000))
    odd = few.limit(4).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 900_010)).withColumn("text", F.when(F.col("doc_id").isNull(), F.lit(" "))).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    rows = few.unionByName(long).unionByName(odd).unionByName(few.limit(5))
    more = {"score": F.lit(7), "rejected": F.lit("no"), "lang_pred": F.lit(1.5), "copy": F.lit(77), "shard": F.lit("s"), "shuffle_key": F.lit(1), "component_id": F.lit(2), "__k": F.lit(3), "k0": F.lit(4), "fp": F.lit("f"), "bag": F.create_map(F.lit("a"), F.col("doc_id"))}
    wide = rows.withColumns(more)
    out = stage(spark, wide, DATA)
    if stage is pipeline.token_stage:
        assert out.count() == rows.count()
        return
    assert out.columns == wide.columns and 0 < out.count()
    assert out.where("score <> 7 OR rejected <> 'no' OR lang_pred <> 1.5 OR copy <> 77 OR shard <> 's' OR component_id <> 2 OR fp <> 'f' OR bag['a'] IS DISTINCT FROM doc_id").count() == 0
    plain = stage(spark, rows, DATA)
    key = lambda df: sorted((str(r.doc_id), (r.text or "")[:80]) for r in df.select("doc_id", "text").collect())
    assert key(out) == key(plain)
    assert stage(spark, wide.limit(0), DATA).count() == 0
