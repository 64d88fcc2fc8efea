"""Positions in an order within groups, of which one may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curalith.functions.scalar import keyed_hash


def positions(rows: DataFrame, by: list[str], order: list[Column], bucket: Column, pos: str = "_pos", size: str = "_n") -> DataFrame:
    """``rows`` with each row's position (from 1) in the order of its group, and the group's size.

    ``bucket`` never falls along the order, so that a position is what earlier buckets hold and the rank within the
    bucket: no task sorts a whole group. Null keys form groups like others.
    """
    r = rows.withColumn("_bucket", bucket)
    counts = r.groupBy(*by, "_bucket").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_b"), (F.sum("_c").over(w.orderBy("_bucket")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias(size))
    r = r.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return r.join(counts, same).withColumn(pos, F.col("_before") + F.col("_r")).select(*rows.columns, pos, size)


def shuffled_positions(rows: DataFrame, by: list[str], key: str, seed: str, digits: int = 3) -> DataFrame:
    """``positions`` in the keyed order of a seeded shuffle; buckets are the hash's first ``digits`` hex digits."""
    h = rows.withColumn("_h", keyed_hash(seed, F.col(key)))
    return positions(h, by, [F.col("_h"), F.col(key)], F.substring("_h", 1, digits)).drop("_h")


def dense_ids(rows: DataFrame, key: str, to: str = "id") -> DataFrame:
    """``rows`` with a dense number from 0 for each distinct key in its order; null keys have none. Ranges of keys are
    counted first, so that no task sorts all of them."""
    distinct = rows.select(F.col(key).alias("_key")).where(F.col(key).isNotNull()).distinct()
    # ranges follow the order; partitions of a range shuffle are its buckets
    ranged = distinct.repartitionByRange(F.col("_key")).withColumn("_part", F.spark_partition_id())
    numbered = positions(ranged.withColumn("_all", F.lit(1)), ["_all"], [F.col("_key")], F.col("_part"))
    return rows.join(numbered.select("_key", (F.col("_pos") - 1).alias(to)), F.col(key) == F.col("_key"), "left").drop("_key")


def first_rows(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group: the feature of a report, not a cap. Groups are cut in two steps, a part of each
    group in each task first."""
    part = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(64)))
    part = part.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("_r") <= n)
    return part.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_part")
