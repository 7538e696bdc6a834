"""Columns of documents keep their values through the pipeline's stages, empty tables pass, and shards follow the data."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tilewright.llm import mixing, simhash, sstable

SMALL = "/root/testdata/sf0.001"
#: Names that operators use for columns of their own.
NAMES = ("score", "predicted", "shard", "_digest", "_id", "_key", "copy", "key", "block", "size", "u", "id", "taken", "number", "n_words", "Score", "k", "t", "salt", "h")


def with_names(docs):
    own = docs
    for i, name in enumerate(n for n in NAMES if n not in ("Score",)):
        own = own.withColumn(name, F.concat(F.lit(f"{i}:"), F.xxhash64("doc_id", "text").cast("string")))
    return own


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_values_of_columns_with_names_of_their_own(spark, k):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(120)
    docs = docs.unionByName(docs.limit(10))  # rows that repeat
    wide = corpus_pipeline.materialise(with_names(docs), "wide")
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, wide, SMALL)
    assert got.columns == wide.columns and [f.dataType for f in got.schema] == [f.dataType for f in wide.schema]
    plain = stage(spark, docs, SMALL)
    key = lambda df: sorted(map(tuple, df.select(docs.columns).collect()), key=str)
    assert key(got) == key(plain)
    for i, c in enumerate(n for n in NAMES if n != "Score"):
        assert got.where(F.col(c) != F.concat(F.lit(f"{i}:"), F.xxhash64("doc_id", "text").cast("string"))).count() == 0, (name, c)
    assert got.count() > 0


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables_nulls_and_long_texts(spark, k):
    _, stage = corpus_pipeline.STAGES[k]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert stage(spark, spark.createDataFrame([], schema), SMALL).count() == 0
    rows = [(1, None, None, None, None), (None, "some words here", "en", "s", 15), (None, "some words here", "en", "s", 15), (2, "", "en", None, 0), (3, "lorem ipsum " * 40_000, "en", "s", 480_000), (3, "é 漢字", None, "t", 4)]
    got = stage(spark, corpus_pipeline.materialise(spark.createDataFrame(rows, schema), "odd"), SMALL)
    assert got.count() >= 3
    if k < 4:
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {tuple(r) for r in got.collect()} <= set(rows)
    else:
        assert got.count() == len(rows)


def test_shards_follow_bytes_and_split_a_repeated_row(spark, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", (4_000, 8_000))
    words = spark.range(600).select("id", F.concat_ws(" ", F.sequence(F.col("id"), F.col("id") + 40)).alias("text"))
    docs = words.select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text again " * 10)).otherwise(F.col("text")).alias("text"))
    docs = corpus_pipeline.materialise(docs.repartition(5), "hot")
    n = sstable.shard_count(docs)
    assert n >= 3 and sstable.shard_count(docs.groupBy("doc_id").agg(F.max("text").alias("text"))) >= 3
    monkeypatch.setattr(sstable, "LEAST_BYTES", 1 << 40)
    manifest = sstable.write_shards(docs, sstable.default_tokenizer(), sstable.new_path(spark, "t"))
    per = [r.n_docs for r in manifest.collect()]
    assert sum(per) == 600 and len(per) >= 2 and max(per) <= 2 * sum(per) / len(per)
    rows = sstable.read_shards(manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and len(sstable.lookup(manifest, [7])[7]) == docs.where("doc_id = 7").count()


def test_mixing_of_very_many_sources(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.format_string("s%06d", "id").alias("source"))
    got = mixing.plan(docs).agg(F.count("*"), F.countDistinct("source"), F.sum("taken"), F.sum("size"), F.max(F.col("taken") - 3 * F.col("size")), F.max(F.col("target") - 3 * F.col("source_size"))).head()
    assert got[0] == got[1] == 100_000 and got[4] <= 0 and got[5] <= 1e-6
    assert abs(got[2] - got[3]) <= 0.2 * got[3]


def test_near_duplicates_keep_one_with_a_digest_column(spark):
    rows = [(1, "a b c d e f", "mine"), (1, "a b c d e f", "mine"), (2, "a b c d e f", "other"), (3, "quite another text of words", "x")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _digest string")).collect()
    assert sorted(map(tuple, got)) == [rows[0], rows[3]]
