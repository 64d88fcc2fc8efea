"""Acceptance in order, whose search for conflicts takes as many tasks as its rows need."""

import random

from curalith.operators import links as L


def test_conflicts_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(L, "KEYED", 500)
    rng, rows, seen = random.Random(2), [], []
    for i in range(240):
        code = rng.getrandbits(63) if i < 80 else rng.choice(rows)[2] ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(6)))
        rows.append((i, rng.choice(["a", "b", None]), code))
    frames = []
    kept = L.materialise
    monkeypatch.setattr(L, "materialise", lambda df, name: frames.append((name, df)) or kept(df, name))
    got = {r["id"]: r["accepted"] for r in L.accept_in_order(spark.createDataFrame(rows, "id long, k string, c long"), "k", "id", "c", 64, 4).collect()}
    for i, k, c in rows:
        near = any(x == k and (c ^ y).bit_count() <= 4 for x, y in seen)
        assert got[i] is not near
        if not near:
            seen.append((k, c))
    pairs = next(df for name, df in frames if name == "conflicts")
    assert pairs.rdd.getNumPartitions() >= 6  # 4 shuffle partitions are set: about 200 codes have 3,000 keyed rows
