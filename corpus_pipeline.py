"""The corpus pipeline: quality, exact copies, near copies, mixing, encoding; each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curalith.llm import bpe, exact_dedup, mixing, ngram_join, quality
from curalith.storage import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share 0.8 of their five-word shingles.
NEAR = {"k": 5, "threshold": (80, 100)}


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labelled ones among them, does not reject.

    Null and empty texts score the share of good labels; rows that repeat score alike; without labels all score 0.5
    and stay; columns besides those of documents are left out; an empty table gives an empty one."""
    model = quality.fit_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_scores(docs.select(*COLUMNS), model, to="_score").where(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the case of A-Z: that with the largest id.

    Null and empty texts are one group; a null id is smaller than any; of rows equal in id and text one stays;
    an empty table gives an empty one."""
    return exact_dedup.kept_rows(docs.select(*COLUMNS))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near copies: with the least id, then digest; rows without an id come last.

    Documents without words have no near copies and stay; rows equal in id and text, which exact dedup has made one,
    stay or go together; an empty table gives an empty one."""
    # an id may have several texts; after the exact dedup the digest tells them apart
    docs = docs.select(*COLUMNS).withColumn("_row", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = ngram_join.jaccard_groups(docs, **NEAR, row=F.col("_row"))
    gone = found.where(F.col("first").isNotNull() & ~ngram_join.row_order("doc_id", "row").eqNullSafe(F.col("first")))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("row").alias("_gone")).hint("merge")
    return docs.join(gone, (F.col("_row") == F.col("_gone")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Rows are known by all of their columns, so rows without an id, or with one id, are taken as often as each is;
    rows equal in all of them share what they are taken. Documents without words are never taken; null is a source of
    its own; an empty table gives an empty one."""
    docs = docs.select(*COLUMNS)
    nulls = F.concat_ws("", *[F.col(c).isNull().cast("string") for c in COLUMNS])
    docs = docs.withColumn("_row", F.concat_ws(":", F.xxhash64(nulls, *COLUMNS), F.xxhash64(F.lit(1), nulls, *COLUMNS)))
    took = mixing.mix(docs, row="_row").groupBy(F.col("row").alias("_taken")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    out = docs.join(took.hint("merge"), F.col("_row") == F.col("_taken"))
    if not took.where("n > 1").isEmpty():  # rows that repeat: one of them stands for all
        out = out.where("n = 1").unionByName(out.where("n > 1").dropDuplicates(["_row"]))
    return out.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row: the number of ids of its text, and hashes of the
    ids and of the decoded bytes. A null text is empty and has no ids; an empty table gives an empty one."""
    import public_tokenizers as P

    return bpe.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("quality", good_documents),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: The classifier, the similarity join and the encoder are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
