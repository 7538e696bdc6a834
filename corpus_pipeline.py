"""Corpus preparation in five stages over ``documents``, each written as Parquet and read again.

Toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark
passages go, the sources are mixed to their target weights, and the mix is written as token shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, mixing, simhash, sstable, toxicity
from tilewright.llm.common import digest, free_name, materialise, small_or_not, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the stage's own input.

    Null and empty texts have no toxic word and stay unless all documents are called toxic; rows are judged one
    by one, so null and repeated ids and repeated rows each keep their own verdict; an empty table stays empty.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, predicted = (free_name(c, docs.columns) for c in ("score", "predicted"))
    return toxicity.score(docs, model, names=(score, predicted)).where(F.col(predicted) == 0).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of linked fingerprints; ids may be null or repeat."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows.

    The verdict hangs on the text alone and is carried by its digest, so null and repeated ids play no part.
    """
    keyed = docs.select(digest(docs["text"]).alias("_key"), "text")
    bad = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"), "_key").where("contaminated").select(F.col("_key").alias("_bad")).distinct()
    bad = small_or_not(materialise(bad, "contaminated"))
    return docs.join(bad, digest(docs["text"]) == bad["_bad"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus in shard order; a document that the mix takes again is a row again.

    A null source is a source; documents without words, null texts among them, are taken with their block;
    equal rows are taken one by one; an empty table stays empty.
    """
    return mixing.mix(docs, shard_col=free_name("shard", docs.columns)).select(docs.columns)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token shards hold, read back: doc_id, start, n_tokens, ids_crc32, shard.

    Null ids come first and repeated ids by text, each row of its own; a null or empty text is the end
    id alone; further columns are not written; an empty table gives no rows.
    """
    return sstable.encode_corpus(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", write_shards),
]

#: No SQL: a trained classifier decides the first stage and a seeded draw the fourth.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; null ids, texts and sources, repeated rows, further columns and empty tables are as the stages say."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
