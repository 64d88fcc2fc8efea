"""Joins on keys of which one holds most rows: results, and that no task reads a hot group."""

from pyspark.sql import functions as F

from curalith.operators.skew import join_groups


def test_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 10 == 9 else "hot" if i % 10 else f"k{i}") for i in range(3000)], "id long, key string")
    groups = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("group_size"), F.min("id").alias("first")).where("key <> 'k20'")
    want = rows.join(groups, "key", "left")
    for how in ("inner", "left"):
        got = join_groups(rows, groups, 3000, "key", how=how)
        expect = want if how == "left" else want.where("first is not null")
        assert sorted(map(str, got.select("id", "key", "group_size", "first").collect())) == sorted(map(str, expect.select("id", "key", "group_size", "first").collect()))


def test_no_task_reads_a_hot_group(spark):
    rows = spark.range(20000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("group_size"))
    met = join_groups(rows, groups, 20000, "key").withColumn("task", F.spark_partition_id())
    assert met.count() == 20000
    # the nine in ten rows of one key stay in the tasks that read them
    assert met.where("key = 'hot'").groupBy("task").count().agg(F.max("count")).first()[0] <= 20000 / 4


def test_curation_of_a_digest_that_nine_in_ten_rows_have(spark):
    """Results by plain code, and the tasks of the join: the hot digest's rows stay where they were read."""
    from curalith.operators import curation as C

    rows = [(i, "hot" if i % 10 else None if i % 100 == 50 else f"d{i // 20}", "ab"[i % 7 == 3] if i % 10 == 0 else "a", ("train", "val", "test", "other")[i % 4]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, md5 string, cls string, split string")
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    rank = {"test": 1, "val": 2, "train": 3, "other": 4}
    want = {}
    for k, g in by.items():
        keep = min(g, key=lambda r: (rank[r[3]], r[0]))
        for r in g:
            want[r[0]] = None if k is None or len(g) == 1 else "conflicting_label" if len({x[2] for x in g}) > 1 else None if r is keep else "exact_duplicate"
    got = C.resolve_exact(df, "md5", "cls", "split", "id")
    assert {r["id"]: r["reason"] for r in got.collect()} == want
    assert got.where("md5 = 'hot'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 3600 / 4
    first = {k: min(r[0] for r in g) for k, g in by.items() if k is not None}
    assert {(r["id"], r["duplicate"]) for r in C.keep_first(df, "md5", "id").collect()} == {(r[0], r[0] != first[r[1]]) for r in rows if r[1] is not None}
    assert {(r["src"], r["dst"]) for r in C.star_edges(df, "md5", "id").collect()} == {(first[r[1]], r[0]) for r in rows if r[1] is not None and first[r[1]] != r[0]}
    mixed = {k for k, g in by.items() if len({x[2] for x in g}) > 1}
    assert {(r["id"], r["status"]) for r in C.quarantine_cross_class(df, "md5", "cls").collect()} == {(r[0], "quarantined_cross_class" if r[1] in mixed else "eligible") for r in rows if r[1] is not None}
