"""Multi-index search against brute force, at any radius, and how many pairs it compares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalith.operators import hamming as H


def planted(rng, n, words=1, flips=8):
    """Random codes, and beside each query a reference code a few bits away."""
    base = rng.integers(0, 2**64, (n, words), dtype=np.uint64)
    other = base.copy()
    for row in other:
        for b in rng.choice(64 * words, rng.integers(0, flips + 1), replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return base, other


@pytest.mark.parametrize(("bits", "radius", "n"), [(64, 0, 300), (64, 5, 2000), (64, 13, 5000), (128, 27, 3000), (128, 20, 20000), (40, 40, 200)])
def test_tables_miss_nothing(bits, radius, n):
    rng = np.random.default_rng(bits + radius)
    words = -(-bits // 64)
    codes, queries = planted(rng, n, words, radius)
    if bits < 64:
        codes, queries = codes & np.uint64((1 << bits) - 1), queries & np.uint64((1 << bits) - 1)
    codes = np.concatenate([codes, codes[:40]])  # copies are met one by one
    queries = queries[:60]
    t = H.Tables(codes, bits)
    got = {q: dict(zip(rows.tolist(), d.tolist())) for q, rows, d in t.near(queries, radius)}
    for q in range(len(queries)):
        d = np.bitwise_count(codes ^ queries[q]).sum(1)
        assert got.get(q, {}) == {int(i): int(d[i]) for i in np.flatnonzero(d <= radius)}


def test_both_sides_of_the_cost_switch_agree(monkeypatch):
    rng = np.random.default_rng(4)
    codes, queries = planted(rng, 4000, 2, 27)
    found = []
    for cost in (0, 10**9):
        monkeypatch.setattr(H, "PROBE", cost)
        t = H.Tables(codes, 128)
        found.append([(q, rows.tolist(), d.tolist()) for q, rows, d in t.near(queries[:50], 27)])
    assert found[0] == found[1] and found[0]


def test_the_share_of_compared_pairs_falls_with_the_codes(monkeypatch):
    monkeypatch.setattr(H, "PROBE", 0)
    rng, share = np.random.default_rng(5), []
    for n in (1 << 17, 1 << 19):
        codes, queries = planted(rng, n, 2, 27)
        t = H.Tables(codes, 128)
        assert len(list(t.near(queries[:20], 27))) == 20
        share.append(t.compared / (20 * n))
    assert share[0] < 0.06 and share[1] < 0.03


def frame(spark, codes, **more):
    return spark.createDataFrame([(int(c),) for c in codes], "code long")


def brute(queries, reference):
    return {int(q): int(np.bitwise_count(reference.view(np.uint64) ^ np.uint64(int(q) & (2**64 - 1))).min()) for q in queries}


def test_nearest_at_any_distance_and_the_pairs_it_meets(spark):
    rng = np.random.default_rng(6)
    shares = []
    for n in (1500, 12000):
        ref, near = (x[:, 0].view(np.int64) for x in planted(rng, n))
        far = rng.integers(-(2**63), 2**63 - 1, 10)
        log = []
        got = {r["code"]: r["nearest"] for r in H.nearest_distance(frame(spark, [*near[:400], *near[:5], *far]), frame(spark, [*ref, *ref[:100]]), log=log).collect()}
        assert got == brute([*near[:400], *far], ref)
        shares.append(sum(r["met"] for r in log if r["round"] != "all") / (410 * n))
        assert next((r["asking"] for r in log if r["round"] == "all"), 0) <= 10  # only far ones are held against all
    assert max(shares) < 0.05


def test_nearest_of_odd_inputs(spark):
    some = frame(spark, [1, 1, 3])
    null = spark.createDataFrame([(None,), (7,)], "code long")
    assert H.nearest_distance(null, some).collect() == [(7, 1)]
    assert H.nearest_distance(some, null.where("code is null")).orderBy("code").collect() == [(1, None), (3, None)]
    assert H.nearest_distance(some.limit(0), some).count() == 0
    bounded = some.withColumn("bound", F.lit(1))
    assert H.nearest_distance(bounded, frame(spark, [-1])).orderBy("code").collect() == [(1, 1), (3, 1)]
    assert H.nearest_distance(some, frame(spark, [-1])).orderBy("code").collect() == [(1, 63), (3, 62)]


def test_one_block_value_of_all_codes(spark):
    """All codes share their low half: one key of several tables holds them all."""
    rng = np.random.default_rng(9)
    ref = rng.integers(0, 2**31, 800) << 32 | 12345
    ask = ref[:50] ^ 1 << 33
    got = {r["code"]: r["nearest"] for r in H.nearest_distance(frame(spark, ask), frame(spark, ref)).collect()}
    assert got == brute(ask, ref)
