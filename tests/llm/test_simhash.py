"""Fingerprints, edited texts and likenesses against plain code over whole tables."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalith.llm import _bytes as B, simhash

SCHEMA = "doc_id long, text string"


def by_hand(t):
    """Votes of each shingle on each bit, in plain numbers."""
    words = [w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    total = [0] * 128
    for gram, n in collections.Counter(grams).items():
        h = B.shingles(np.array([B.span_hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0] for w in gram]), 5)
        bits = "".join(f"{x:08b}" for salt in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165) for x in B.mix(h ^ np.uint64(salt)).tobytes())
        weight = round(64 * (1 + math.log(n)))
        for i, b in enumerate(bits):
            total[i] += weight if b == "1" else -weight
    return f"{int(''.join('1' if x > 0 else '0' for x in total), 2):032x}"


def expected(docs):
    order = sorted(docs, key=lambda r: (-(2**63) if r[0] is None else r[0], r[2]), reverse=True)
    out = []
    for (d, t, _), (_, n, _) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        f, g, x = by_hand(t), by_hand(e), by_hand(n)
        like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, like(f, g), like(f, x)))
    return out


def rows(spark, docs):
    frame = spark.createDataFrame(docs, SCHEMA)
    hashes = {r.text: r.h for r in frame.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    return frame, [(d, t or "", hashes[t or ""]) for d, t in docs]


def got(frame):
    made = simhash.with_edits(frame)
    f = F.col("fingerprint")
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", simhash.likeness(f, F.col("edited_fingerprint")), simhash.likeness(f, F.col("next_fingerprint")))


@pytest.mark.parametrize("parts", [2, 7, 40])
def test_equals_plain_code(spark, parts):
    rng = random.Random(parts)
    word = lambda: rng.choice(["a", "bb", "é", "🙂x", "the", "of", "one"])
    docs = [(i % 70 if i % 9 else None, None if i % 31 == 0 else " ".join(word() for _ in range(rng.randrange(25)))) for i in range(150)]
    docs += [(33, "six words that stand here twice"), (33, "six words that stand here twice"), (None, "x y")] + [(None, "x y")] * 40
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame, docs = rows(spark, docs)
        assert sorted(map(tuple, got(frame).collect()), key=repr) == sorted(expected(docs), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repeated_rows(spark):
    docs = [(i, f"text {i} of a dozen") for i in range(12) for _ in range(2)]
    frame, docs = rows(spark, docs)
    assert sorted(map(tuple, got(frame).collect()), key=repr) == sorted(expected(docs), key=repr)
    one, alike = rows(spark, [(5, "the only row, six words long")] * 3)
    assert sorted(map(tuple, got(one).collect()), key=repr) == sorted(expected(alike), key=repr)
    assert got(frame.limit(0)).count() == 0


def test_plans_with_many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 10_000)
    try:
        made = simhash.with_edits(spark.range(40_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
        assert len(made._jdf.queryExecution().executedPlan().toString()) < 50_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_query(spark, tmp_path):
    """op1 over a table, with the number of others within the radius."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(12))) for _ in range(30)]
    docs = [(i, rng.choice(texts)) for i in range(0, 90)]
    frame, docs = rows(spark, docs)
    frame.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    prints = {d: by_hand(t) for d, t, _ in docs}
    near = {d: sum((int(p, 16) ^ int(x, 16)).bit_count() <= simhash.RADIUS for x in prints.values()) - 1 if d % 20 == 0 else None for d, p in prints.items()}
    assert {r.doc_id: r.n_within_radius for r in simhash.op1_simhash(spark, str(tmp_path)).collect()} == near


@pytest.mark.parametrize("radius", [3, 7, 8, 27])
def test_search_on_both_sides_of_the_table_switch(spark, radius):
    """Joined and probed tables against all pairs, with copies, for pairs and for counts."""
    rng = np.random.default_rng(radius)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(60)]
    near = [b ^ sum(1 << int(i) for i in rng.choice(128, rng.integers(0, radius + 4), replace=False)) for b in base for _ in range(3)]
    text = lambda x: f"{x:032x}"
    prints = spark.createDataFrame([(text(x),) for x in base + near + base[:9]] + [(None,)], "fingerprint string")
    asks = spark.createDataFrame([(text(x),) for x in base[:20] + base[:5]] + [(None,)], "fingerprint string")
    every = set(base + near)
    want = {(text(q), text(x), (q ^ x).bit_count()) for q in base[:20] for x in every if 0 < (q ^ x).bit_count() <= radius}
    got = simhash.within_radius(prints, asks, radius).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == want
    counts = prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n"))
    n = {r["fingerprint"]: r["n"] for r in counts.collect()}
    near_by = {}
    for q, x, _ in want:
        near_by[q] = near_by.get(q, 0) + n[x]
    assert {r["fingerprint"]: r["near"] for r in simhash.within_radius_counts(counts, asks, radius).collect()} == near_by
