"""A training-corpus pipeline over ``documents``: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``.

Defined cases, in every stage: null and empty texts are documents without words
(the classifier's score decides whether they stay; they are copies of nothing,
hold nothing of the benchmark and have no tokens, and a null text stays null);
null ids stay unless the quality or contamination of the text drops the row; an
empty table gives an empty one; columns beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornlog.llm import bpe, decontam, neardup, quality_clf, substring
from hornlog.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in COLUMNS])


def _without(docs: DataFrame, dropped: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys, null ones included, are not in ``dropped``."""
    dropped = materialize(dropped.select(*[F.col(k).alias(f"gone_{k}") for k in keys]).distinct(), "dropped")
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"gone_{k}")) for k in keys])
    return docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, same, "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; equal rows are judged alike."""
    docs = _columns(docs)
    return quality_clf.accepted(docs, *quality_clf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies: five words, similarity 0.8.

    Rows that share an id with others are told apart by a negative key of id and text; equal rows of them stay once.
    A null id is never dropped."""
    docs = _columns(docs)
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("several"))
    several = materialize(several, "several")
    bound = F.broadcast if several.count() <= BROADCAST_ROWS else (lambda df: df)
    own = F.when(F.col("several"), -1 - F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)).otherwise(F.col("doc_id"))
    keyed = docs.join(bound(several), "doc_id", "left").withColumn("row_key", own)
    found = materialize(neardup.near_duplicates(keyed.select(F.col("row_key").alias("doc_id"), "text"), 5, 80), "near")
    kept = _without(keyed, found.where("not kept").select(F.col("doc_id").alias("row_key")), "row_key")
    equal = kept.where("several").groupBy("row_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.where("several is null").select(*COLUMNS).union(equal.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that stand, in windows of 50, in a document of smaller id; empty ones go."""
    found = substring.remove_repeats(_columns(docs), carry=("lang", "source", "n_chars"), as_is=True)
    changed = F.col("n_removed") > 0
    return found.where(~changed | (F.col("kept") != "")).select(
        "doc_id", F.col("kept").alias("text"), F.col("carried.lang").alias("lang"), F.col("carried.source").alias("source"),
        F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col("carried.n_chars")).alias("n_chars"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark text; rows of one id, or of none, are told apart by a hash of the text."""
    keyed = _columns(docs).withColumn("text_key", F.xxhash64("text"))
    judged = decontam.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), tag="text_key")
    return _without(keyed, judged.where("contaminated").select("doc_id", F.col("tag").alias("text_key")), "doc_id", "text_key").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with n_tokens and token_ids; equal rows each have theirs."""
    return bpe.with_tokens(_columns(docs))


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", tokenize),
]

#: A trained network decides in the first stage, which SQL cannot express; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
