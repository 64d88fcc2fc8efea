"""Exact deduplication over a stream, with disk-backed keyed state that never expires.

A structured stream aggregates rows by the digest of the normalised text (A-Z in lower case) in a RocksDB state
store: for each digest the identifier that stays (the largest), the locator of its content, and a count. A row
whose digest was met before is a hit; hits are checked against the full bytes of the row that stays. Rows whose
bytes differ in spite of equal digests form groups by the text itself. Only DataFrame and SQL operations run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curalith.storage import fresh_path, materialise

from ._names import unused

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # caches and write buffers of all stores of an executor together
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
#: A group with at least this share of all rows is hot; there are at most 1 / HOT of them.
HOT = 1 / 1000


def normalised(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(spark: SparkSession, path: str, state: str, files_per_batch: int = 1000) -> DataFrame:
    """Folds the table of digests at ``path`` (digest, doc_id, locator), as it stands, into the state at ``state``
    and returns the state: ``(digest, keep_id, locator, group_size)``.

    Called again with the same folders after files were added, it reads only these and returns the whole state.
    Every batch commits its changed groups as a table of its own, which a repeated batch overwrites; the latest
    row of a group is its state. An empty table gives an empty state; rows that repeat count each; a null id is smaller
    than any.
    """
    schema = spark.read.parquet(path).schema
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        groups = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
            .groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("group_size"))
        )

        def commit(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{state}/groups/batch={number}")

        query = groups.writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = "digest binary, keep struct<doc_id: bigint, locator: bigint>, group_size bigint, batch int"
    return spark.read.schema(rows).parquet(f"{state}/groups").groupBy("digest").agg(F.max(F.struct("batch", "keep", "group_size")).alias("g")).select("digest", F.col("g.keep.doc_id").alias("keep_id"), F.col("g.keep.locator").alias("locator"), F.col("g.group_size").alias("group_size"))


def by_group(rows: DataFrame, groups: DataFrame, total: int, key: str = "digest") -> DataFrame:
    """Rows with their group's columns. Hot groups, of which there are at most 1 / HOT, are broadcast; the rest is shuffled."""
    bound = max(2, math.ceil(total * HOT))
    hot = F.broadcast(groups.where(F.col("group_size") >= bound))
    cold = groups.where(F.col("group_size") < bound)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key))


#: Words of 64 bits of the filter that spares texts the way to the byte check; so many rows are broadcast at most.
FILTER_WORDS = 1 << 17


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those that are not wanted, and with all that are: known by ``k`` and ``locator``, through
    a table of bits whose size is fixed."""
    place = F.xxhash64("k", "locator")
    word = F.pmod(place, F.lit(FILTER_WORDS)).cast("int")
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(k, locator), 20), 64) as int))")
    bits = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    kept = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word")
    return kept.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*rows.columns)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=lambda t: F.unhex(F.sha2(t, 256))) -> DataFrame:
    """``(doc_id, locator, keep_id, group_size, kept, text_sha256)`` for every row; one row of each group is kept.

    Equal texts are identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id stays
    (null is smaller than any; among rows of one doc_id that with the largest locator, a hash of the row's text
    and id; of rows equal in all that, ``kept`` marks each, and :func:`kept_rows` leaves one).
    ``digest`` may be any function of the text: rows with equal digests and other bytes are told apart.
    Other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = fresh_path(spark, "digests")
    rows = base.withColumn("norm", normalised(F.col("text"))).select("doc_id", digest(F.col("norm")).alias("digest"), F.sha2("norm", 256).alias("text_sha256"), F.xxhash64("text", "doc_id").alias("locator"))
    rows.write.parquet(table)
    rows = spark.read.schema(rows.schema).parquet(table)
    groups = materialise(fold(spark, table, fresh_path(spark, "dedup-state")), "groups")
    total = rows.count()
    found = by_group(rows, groups.withColumnRenamed("locator", "keep_locator"), total)

    # hits against the full bytes: their rows are found by id and locator, so that only texts of repeated digests are
    # normalised again, and least and greatest bytes of a digest, formed before the shuffle, are those of one text
    least = F.lit(-(2**63))
    marked = by_group(rows.select("digest", "doc_id", "locator"), groups.where("group_size > 1").select("digest", "group_size"), total)
    marked = marked.select("digest", F.coalesce("doc_id", least).alias("k"), "locator").distinct()
    content = base.select(F.coalesce("doc_id", least).alias("k"), F.xxhash64("text", "doc_id").alias("locator"), "doc_id", "text")
    content = _likely(content, marked)
    hits = content.join(marked.hint("shuffle_hash"), ["k", "locator"]).select("digest", "doc_id", "locator", normalised(F.col("text")).alias("norm"))
    bytes_ = hits.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    odd = materialise(bytes_.where("a <> b").select("digest"), "collisions")
    if odd.isEmpty():
        out = found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_locator")))
        return out.select("doc_id", "locator", "keep_id", "group_size", "kept", "text_sha256")
    # digests that stand for several texts: their rows are grouped by text
    mixed = hits.join(odd, "digest")
    exact = mixed.groupBy("norm").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("group_size"))
    told = mixed.join(exact, "norm").select("doc_id", "locator", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("locator") == F.col("keep.locator"))).alias("kept"), F.sha2("norm", 256).alias("text_sha256"))
    out = found.join(odd, "digest", "left_anti").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_locator")))
    return out.select("doc_id", "locator", "keep_id", "group_size", "kept", "text_sha256").unionByName(told)


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that others stand for; all columns stay, whatever their names. Of rows equal in id and
    text one stays. An empty table gives an empty one."""
    at, locator, own = unused(docs.columns, "_at", "_locator", "_id")
    keep = deduplicate(docs, doc_id, text).where("kept").select(F.col("locator").alias(locator), F.col("doc_id").alias(own)).distinct()
    marked = docs.withColumn(at, F.xxhash64(F.col(text), F.col(doc_id).cast("long")))
    out = marked.join(keep, (F.col(at) == F.col(locator)) & F.col(doc_id).cast("long").eqNullSafe(F.col(own)), "left_semi")
    again = out.groupBy(at, doc_id).agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return out.drop(at)
    return out.dropDuplicates([at, doc_id]).select(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the one that stays for it; odd inputs as stated in :func:`deduplicate`."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLE = {
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)"""
}
