"""Exact percentiles against numpy, by groups, on values that are hard to divide, and what is shuffled."""

import numpy as np
from pyspark.sql import functions as F

from curalith.operators.selection import exact_percentiles

POINTS = {"low": 0.0, "median": 0.5, "p95": 0.95, "top": 1.0}


def check(got, groups, names):
    by = {r[0]: r for r in got.collect()}
    assert by.keys() == groups.keys()
    for k, values in groups.items():
        for name, p in names.items():
            assert np.isclose(by[k][name], np.quantile(values, p), rtol=1e-12, atol=0), (k, name)


def test_groups_of_all_kinds(spark):
    rng = np.random.default_rng(1)
    groups = {
        "uniform": rng.random(4001), "ties": rng.integers(0, 3, 3000).astype(float), "one": np.array([7.5]), "two": np.array([-1.0, 4.0]), "equal": np.full(2500, 3.25),
        "tails": np.concatenate([rng.normal(size=2000), [1e300, -1e300]]), "tiny": rng.integers(1, 4, 2000) * 5e-324, "powers": 10.0 ** rng.uniform(-200, 200, 3000), None: rng.normal(size=2100),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("uniform", None), ("uniform", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    log = []
    check(exact_percentiles(df, ["k"], "v", POINTS, log, sortable=50), groups, POINTS)
    assert len(log) > 1
    check(exact_percentiles(df, ["k"], "v", POINTS), groups, POINTS)  # few rows: put in order at once
    assert exact_percentiles(df.limit(0), ["k"], "v", POINTS).count() == 0


def test_counts_do_not_grow_with_the_rows(spark):
    for n in (20_000, 80_000):
        df, log = spark.range(n).select(F.lit("hot").alias("k"), F.sin("id").alias("v")), []
        got = exact_percentiles(df, ["k"], "v", {"median": 0.5}, log, sortable=100).first()
        assert np.isclose(got["median"], np.median(np.sin(np.arange(n))))
        assert sum(x["steps"] for x in log) <= 3 * 1024
