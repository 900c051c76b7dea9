"""A corpus pipeline over `documents`: each stage is written as Parquet and read again as the next one's input.

language: documents without a determined language go. near duplicates: the smallest doc_id of each group
stays. decontaminate: documents that hold benchmark passages go. mix: a sample by raked weights stays, in which
documents that count more than once are repeated. tokens: one row for each document and copy that is left,
read back from its token shards.

Defined results: stages decide on rows, by doc_id and text, so rows that share a doc_id (or have none) are judged each by
its own text. A null or empty text has no language, so its row goes. Of rows with one doc_id and one text, one stays; a row
without a doc_id stays behind those of its group that have one, and ties go to the text with the smaller hash. An empty
table gives no rows; columns that documents don't have are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import common, decontaminate, jaccard, language, mixing, tokens

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids of up to this many rows (8 bytes each) are broadcast; more are joined by shuffles.
BROADCAST_IDS = 1 << 20


def _key() -> Column:
    """What a row is known by within a stage: rows of one doc_id and text are alike."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs for an operator that reads doc_id and text: with that key as the doc_id."""
    return docs.select(_key().alias("doc_id"), "text")


def _among(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs whose key is (left_semi) or isn't (left_anti) among `keys` (doc_id)."""
    keys = common.materialize(keys.select(F.col("doc_id").alias("__key")).distinct())
    few = keys.count() <= BROADCAST_IDS
    return docs.select(*COLUMNS, _key().alias("__key")).join(F.broadcast(keys) if few else keys, "__key", how).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.identify(_keyed(docs), *language.train(language.train_split(docs)))
    return _among(docs, found.where(F.col("lang_pred") == language.UNDETERMINED), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = common.materialize(jaccard.link_documents(_keyed(docs)).select("doc_id", "component_id"))
    joined = common.materialize(groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"))
    shared = common.materialize(groups.join(joined, "component_id").distinct())
    # Of each group with several rows: the smallest doc_id, null last, then the smallest key.
    ids = _among(docs, shared, "left_semi").select(_key().alias("doc_id"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), _key().alias("key")).alias("place"))
    first = ids.distinct().join(shared, "doc_id").groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.key").alias("doc_id"))
    first = common.materialize(first)
    gone = shared.select("doc_id").join(first, "doc_id", "left_anti")
    left = common.materialize(_among(docs, gone, "left_anti"))
    # Rows with one doc_id and one text are still as many as they were.
    again = common.materialize(groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return left
    return _among(left, again, "left_anti").unionByName(_among(left, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _among(docs, decontaminate.contaminated(_keyed(docs), common.table(spark, sf_dir, "benchmark")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slim = common.materialize(mixing.described(docs).select("source", "lang", "topic", "n_tokens"))
    drawn = mixing.sample(mixing.described(docs), mixing.cell_weights(slim)).where("keep")
    return drawn.withColumn("copy", F.explode(F.array_repeat(F.lit(0), mixing.copies()))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.document_ids(tokens.encode_shards(docs, tokens.default_path()))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", encode),
]

#: Language ID, raking and tokenization aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs)
    return docs
