"""Acceptance over a stream against a plain loop, in one run and in several that go on from the state."""

import random

from pyspark.sql import functions as F

from curalith.streaming import acceptance as A


def plain(rows, target, cap, batch, most):
    out = {}
    for c in {r[0] for r in rows}:
        held, tried, left = [], 0, 0
        for _, n, code, bad in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]):
            if not left and len(held) < target and tried < cap:
                left = min(batch, target - len(held))
            if not left:
                out[c, n] = "not_tried"
                continue
            tried, left = tried + 1, left - 1
            if bad or code is None:
                out[c, n] = "degenerate"
            elif any(((code ^ x) & (2**64 - 1)).bit_count() <= most for x in held):
                out[c, n] = "near"
            else:
                held.append(code)
                out[c, n] = "accepted"
    return out


def attempts():
    rng = random.Random(4)
    rows = []
    for c, n in (("a", 60), ("b", 60), (None, 20), ("short", 3)):
        centres = [rng.randrange(-(2**63), 2**63) for _ in range(25)]
        for i in range(n):
            code = rng.choice(centres)
            for _ in range(rng.randrange(6)):
                code ^= 1 << rng.randrange(63)
            rows.append((c, i, None if rng.random() < 0.05 else code, rng.random() < (0.7 if c == "b" else 0.1)))
    return rows


def test_one_run_and_runs_over_added_files(spark, tmp_path):
    rows = attempts()
    want = plain(rows, 12, 30, 5, 4)
    assert {"accepted", "near", "degenerate", "not_tried"} == set(want.values())
    df = spark.createDataFrame(rows, A.SCHEMA)
    got = A.accepted(df, 12, 30, 5).collect()
    assert len(got) == len(rows) and {(r["class"], r["attempt"]): r["status"] for r in got} == want
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    for part in (F.col("attempt") < 10, F.col("attempt").between(10, 24), F.col("attempt") > 24):
        df.where(part).coalesce(1).write.mode("append").parquet(path)
        again = A.follow(spark, path, state, 12, 30, 5).collect()
    assert len(again) == len(rows) and {(r["class"], r["attempt"]): r["status"] for r in again} == want
