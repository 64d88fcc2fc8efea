"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a seeded order, as often as the mix may repeat them. A copy's virtual finish
time is its source's words up to and with it, divided by the source's target. The mix takes copies by finish
time until the next would go beyond the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from curalith.storage import materialise

SHARE = 1.5
REPEATS = 2
WEIGHTS = (3, 1, 2)
SEED = "mix"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, weight, target)`` for each source from rows ``(source, size)``.

    Sources by code point, null last, weigh ``weights`` in turn; they share ``share`` of all words, none above
    ``repeats`` times its own. The level at which the shares add up is found in one pass over sources by
    capacity for each unit of weight; the windows hold one row for each source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.array(*[F.lit(w) for w in weights])
    by = by.withColumn("weight", F.element_at(turn, (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    by = by.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    queue = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    done = F.coalesce(F.sum("cap").over(queue.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(queue.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - done) / left)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    by = by.withColumn("level", level)
    return by.select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")), F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED, row: str | None = None) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)`` for each row of ``docs``.

    Rows with a null id, and rows that repeat, count like others; a null text has no words and is never taken; null
    is a source of its own; an empty table gives an empty one. The seeded order is by id and text, so rows without an
    id spread like others; rows equal in both are interchangeable. With ``row``, a column that tells rows apart, it is
    returned too. Running totals are formed in two levels: first over (source, bucket of the seeded order), then within
    a bucket, so a source may hold most of the rows; the cut is found in a histogram of finish times and only its
    bucket is sorted.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    sizes = materialise(docs.select(F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("size"), F.col(source).alias("source"), key.alias("key"), *([] if row is None else [F.col(row).alias("row")])), "sizes")
    return mix_sizes(sizes, share, repeats, weights)


def mix_sizes(sizes: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``mix`` for rows ``(doc_id, size, source, key)``, and ``row`` if there is one, read from a table."""
    targets = source_targets(sizes, share, repeats, weights).select(F.col("source").alias("s"), "source_size", "target")
    n = sizes.count()
    digits = 2 if n < 2_000_000 else 3 if n < 30_000_000 else 5  # 256, 4,096 or a million buckets of a source
    rows = sizes.withColumn("bucket", F.substring("key", 1, digits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("offset"))
    rows = rows.withColumn("within", F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = materialise(rows.withColumn("cum", F.col("offset") + F.col("within")).drop("offset", "within", "bucket"), "queue")

    copies = [((F.col("cum") + F.col("source_size") * i) / F.col("target")) for i in range(repeats)]
    timed = rows.where("size > 0 and target > 0").select("size", "source", "key", "doc_id", F.explode(F.array(*copies)).alias("vt"))
    order = [F.col("vt"), F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size")]
    limit = _cut(timed, min(share, repeats) * (sizes.agg(F.sum("size")).first()[0] or 0), order, float(repeats))
    took = sum((F.coalesce((F.col("size") > 0) & (c < limit), F.lit(False)).cast("long") if limit is not None else (F.col("size") > 0).cast("long") for c in copies), F.lit(0).cast("long"))
    return rows.withColumn("copies", took).withColumn("taken", F.col("copies") * F.col("size")).drop("cum")


def _cut(timed: DataFrame, budget: float, order: list[Column], high: float, steps: int = 4096, sortable: int = 100_000) -> float | None:
    """Finish time of the first copy that goes beyond the budget, None if none does.

    Histograms of ``steps`` rows narrow the range until few enough copies, or copies of one time only, are left to sort."""
    low, spent, left = 0.0, 0, timed
    for _ in range(6):
        width = (high - low) / steps
        step = F.least(F.greatest(F.floor((F.col("vt") - low) / width), F.lit(0)), F.lit(steps)).cast("int")
        counts = left.groupBy(step.alias("step")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("vt").alias("a"), F.max("vt").alias("b")).orderBy("step").collect()
        hit = None
        for r in counts:  # as many rows as steps
            if spent + r["n"] > budget:
                hit = r
                break
            spent += r["n"]
        if hit is None:
            return None
        left = left.where(step == hit["step"])
        if hit["rows"] <= sortable or hit["a"] == hit["b"]:
            break
        low, high = hit["a"], hit["b"]
    if hit["a"] == hit["b"]:
        return hit["a"]
    run = left.withColumn("run", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("run") + spent > budget).agg(F.min("vt")).first()[0]


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed by source; odd inputs as stated in :func:`mix`."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM {docs}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight FROM s0),
s2 AS (SELECT *, source_size * 2 AS cap, source_size * 2 / weight AS ratio FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
       / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM s2),
s4 AS (SELECT *, (SELECT lv FROM s3 WHERE lv <= ratio ORDER BY ratio, lv LIMIT 1) AS level FROM s3),
s AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, weight * level), cap::DOUBLE) AS target FROM s4),
q AS (SELECT d.*, s.source_size, s.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT *, (cum + source_size * e)::DOUBLE / target AS vt FROM q, (VALUES (0), (1)) t(e) WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY vt, source NULLS LAST, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c),
x AS (SELECT min(vt) AS lim FROM r WHERE run > (SELECT sum(size) * 1.5 FROM d))
"""
ORACLE = {
    "op5_mixing": SQL.replace("{docs}", "documents")
    + """SELECT doc_id, size, source_size, target,
       (size * ((CASE WHEN size > 0 AND (lim IS NULL OR cum::DOUBLE / target < lim) THEN 1 ELSE 0 END)
              + (CASE WHEN size > 0 AND (lim IS NULL OR (cum + source_size)::DOUBLE / target < lim) THEN 1 ELSE 0 END)))::BIGINT AS taken
FROM q, x"""
}
QUERIES = {"op5_mixing": op5_mixing}
