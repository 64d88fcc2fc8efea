"""Attempts as they arrive: the first success of each key, kept up to date over a stream of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType

from curalith.storage import fresh_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def follow(spark: SparkSession, path: str, schema: str, key: list[str], attempt: str, ok: str, state: str, most: int = 3, files_per_batch: int = 1000) -> DataFrame:
    """``(key..., tried, success)`` for all attempts in the tables at ``path``, of which only the first ``most`` of a key
    count: how many there were, and the least number of one that succeeded, null so far.

    Called again with the same ``state`` folder after files were added, it reads only these. State is kept on disk, a
    few numbers for each key, and does not expire; a batch commits as a table of its own, which a repeat overwrites.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).where(F.col(attempt) < most)
        groups = rows.groupBy(*key).agg(F.count("*").alias("tried"), F.min(F.when(F.col(ok), F.col(attempt))).alias("success"))
        shape = groups.schema

        def commit(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{state}/keys/batch={number}")

        query = groups.writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    found = spark.read.schema(shape.add("batch", IntegerType())).parquet(f"{state}/keys")
    latest = found.groupBy(*key).agg(F.max(F.struct("batch", "tried", "success")).alias("s"))
    return latest.select(*key, "s.tried", "s.success")


def first_success(spark: SparkSession, attempts: DataFrame, key: list[str], attempt: str, ok: str, most: int = 3) -> DataFrame:
    """``follow`` over one table, written to the shared folder first."""
    path = fresh_path(spark, "attempts")
    attempts.select(*key, attempt, ok).write.parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in attempts.select(*key, attempt, ok).schema.fields)
    return follow(spark, path, schema, key, attempt, ok, fresh_path(spark, "attempts-state"), most)
