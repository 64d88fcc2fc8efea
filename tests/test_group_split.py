"""The best of many shuffles by plain code, and what its selection counts and puts in order."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from curalith.operators import curation as C


def order(groups, seed, i):
    return sorted(groups, key=lambda g: (hashlib.md5(f"{seed}:{i}:{g}".encode()).hexdigest(), g))


def plain(rows, share, tries, seed):
    groups, classes, total = sorted({g for g, _ in rows}), {c for _, c in rows}, len(rows)
    p = {c: sum(x == c for _, x in rows) / total for c in classes}
    scores = []
    for i in range(tries):
        held = set(order(groups, seed, i)[: math.ceil(share * len(groups))])
        side = [c for g, c in rows if g in held]
        worst = max(abs(side.count(c) / len(side) / p[c] - 1) for c in classes)
        scores.append((round(worst + 2 * abs(len(side) / total - share), 9), i, held))
    return min(scores)[2]


def test_same_split_as_sorting_every_shuffle(spark):
    rng = random.Random(2)
    for n, share in ((40, 0.3), (300, 0.15), (3, 0.5), (1, 0.3)):
        rows = [(f"g{rng.randrange(n)}", rng.choice("aab") if rng.random() < 0.9 else "c") for _ in range(4 * n)] + [("g0", "a")] * n
        got = C.best_group_split(spark.createDataFrame(rows, "g string, c string"), "g", "c", share, 20, "s").collect()
        assert {r["g"] for r in got if r["held_out"]} == plain(rows, share, 20, "s") and len(got) == len({g for g, _ in rows})
    assert C.best_group_split(spark.createDataFrame([], "g string, c string"), "g", "c", 0.3, 5, "s").count() == 0


def test_only_counts_and_the_boundary_are_shuffled(spark):
    for n in (2000, 8000):
        groups = spark.range(n).select(F.col("id").cast("string").alias("g"), F.array(F.struct((F.col("id") % 3).alias("c"), F.lit(1).cast("long").alias("n"))).alias("cs"))
        log = {}
        got = C.held_classes(groups, "g", 8, "s", n // 3, 2, log).groupBy("try").agg(F.sum("n").alias("n")).collect()
        assert {r["n"] for r in got} == {n // 3} and len(got) == 8
        assert log["counted"] <= 8 * 256 * 3 and log["ordered"] <= 8 * n / 256 * 3  # instead of 8 n rows in order
