"""Groups from batches against groups from one run, what batches write, and repeats."""

import random

from pyspark.sql import functions as F

from curalith.operators import growing as G

SCHEMA = "id long, a string, b string"


def plain(rows):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    seen = {}
    for i, *keys in rows:
        for k, key in enumerate(keys):
            if i is not None and key is not None:
                a, b = root(seen.setdefault((k, key), i)), root(i)
                up[max(a, b)] = min(a, b)
    size = {}
    for x in up:
        size[root(x)] = size.get(root(x), 0) + 1
    return {x: root(x) for x in up if size[root(x)] > 1}


def test_batches_equal_one_run_and_write_what_they_bring(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, f"a{rng.randrange(150)}" if rng.random() < 0.5 else None, f"b{rng.randrange(200)}" if rng.random() < 0.4 else "hot" if rng.random() < 0.3 else None) for i in rng.sample(range(5000), 400)]
    rows += [(None, "a1", "b1"), rows[3], rows[3]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, " + SCHEMA)
    state, cuts = str(tmp_path / "state"), (0, 250, 380, 395, len(rows))
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = df.where(F.col("n").between(lo, hi - 1)).select("id", "a", "b")
        wrote = G.add_batch(part, "id", ["a", "b"], state, i)
        assert wrote["keys"] <= 2 * (hi - lo) and wrote["nodes"] <= 3 * (hi - lo) and wrote["names"] <= 2 * (hi - lo)
        if i in (1, 3):  # a batch that is repeated changes nothing
            assert G.add_batch(part, "id", ["a", "b"], state, i) == wrote
            assert {r["node"]: r["component"] for r in G.groups(spark, state, i + 1).collect()} == plain(rows[:hi])
    assert wrote["nodes"] + wrote["keys"] < 40  # the last few rows touch the hot group, whose nodes are not written again


def test_empty_batches(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    for i in range(2):
        assert G.add_batch(none, "id", ["a", "b"], str(tmp_path), i) == {"keys": 0, "nodes": 0, "names": 0}
    assert G.groups(spark, str(tmp_path), 2).count() == 0
