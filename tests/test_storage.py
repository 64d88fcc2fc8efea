"""Intermediate tables: what a session wrote can be removed once a job's results are saved."""

import os

from curalith import storage


def test_only_what_was_written_since_a_mark_goes(spark):
    first = storage.materialise(spark.range(5), "first")
    at = storage.mark()
    storage.materialise(spark.range(3), "second")
    storage.fresh_path(spark, "never-written")
    paths = storage._written[at:]
    assert os.path.isdir(paths[0]) and storage.remove_written(spark, at) == 1
    assert not os.path.isdir(paths[0]) and storage.mark() == at and first.count() == 5


def test_bucketed_tables_are_joined_unshuffled_and_go_with_their_files(spark):
    at = storage.mark()
    table = storage.bucketed(spark.range(100).selectExpr("id AS d", "id % 7 AS t"), "dealt", 4, "d", "t")
    n = len(spark.catalog.listTables())
    plan = table.hint("merge").join(table.groupBy("d", "t").count(), ["d", "t"])._jdf.queryExecution().executedPlan().toString()
    assert table.count() == 100 and "Exchange" not in plan
    assert storage.remove_written(spark, at) == 1 and len(spark.catalog.listTables()) == n - 1
