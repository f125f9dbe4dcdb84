"""A corpus pipeline of five stages, each one operator of molframe.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` chains them in memory, the check
writes and rereads each result. All stages but the last return the columns of `docs`. Null texts have no
language and go in the first stage; an empty table stays empty; further columns are carried along, whatever
their names and types.

Part of subpackage llm: deleted together with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm import langid, mixing, sentencepiece, simhash, toxicity
from molframe.llm.common import cut, table

#: Source weights of the mixing stage: the source named gets twice the share of each other one.
WEIGHTS = {"src0": 2.0}


OWN = ("doc_id", "text", "lang", "source")


def apart(docs: DataFrame) -> DataFrame:
    """`docs` with other columns than OWN under private names, by their places: none clashes with what an operator adds."""
    return docs.toDF(*[c if c in OWN and docs.columns.index(c) == i else f"__{i}" for i, c in enumerate(docs.columns)])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language ID rejects: without a letter, or too far from every centroid."""
    d = apart(docs)
    model = langid.fit(langid.training_rows(d))
    return langid.predict(d, model, keep=tuple(d.columns)).where("NOT rejected").select(*d.columns).toDF(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity is 0.5 or more; the model learns from the labelled ones outside the held-out fold."""
    d = apart(docs)
    model = toxicity.fit(d, toxicity.seen(table(spark, sf_dir, "labels")))
    return toxicity.score(d, model, keep=tuple(d.columns)).where("score < 0.5").select(*d.columns).toDF(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of near-duplicates (five-word shingles, 0.8 or more).

    Repeated rows of that id leave one row (the first by the JSON of all columns, so columns of any type will do)."""
    d = apart(docs)
    keep = simhash.similar(d).where("doc_id = component_id OR doc_id IS NULL AND component_id IS NULL").select(F.col("doc_id").alias("__k"))
    once = cut(keep.groupBy("__k").agg(F.count("*").alias("__n")))
    kept = d.join(once, F.col("doc_id").eqNullSafe(F.col("__k")))
    single = kept.where("__n = 1").select(*d.columns)
    if not once.where("__n > 1").isEmpty():
        row = F.struct(*d.columns)
        first = kept.where("__n > 1").groupBy("__k").agg(F.min_by(row, F.to_json(row)).alias("r"))
        single = single.unionByName(first.select("r.*"))
    return single.toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents so that the sources have their target weights; copies are rows of their own."""
    d = apart(docs)
    return mixing.mix(d, WEIGHTS).select(*d.columns).toDF(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text that they decode to; a null text has none and decodes to the empty one."""
    out = sentencepiece.encode(apart(docs).select("doc_id", "text"), decoded=True)
    return out.select("doc_id", F.size("token_ids").alias("n_tokens"), "token_ids", "decoded")


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: SQL has neither the classifiers nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
