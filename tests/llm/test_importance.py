"""Importance resampling against plain code, its hashes, and its odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from curalith.llm import importance as I

SCHEMA = "doc_id long, text string, weight string, score double, key int"


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def buckets(t):
    w = words(t)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(docs, target, percent=5):
    s, t = np.zeros(10000, object), np.zeros(10000, object)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in buckets(x):
                counts[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (big_s + 10000) / ((a + 1) * (big_t + 10000)))) for a, b in zip(s, t)]
    out = []
    for i, x in docs:
        f = buckets(x)
        w = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= 20])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def as_rows(rows):
    return sorted(map(tuple, rows), key=str)


def test_features_equal_plain_hashes():
    texts = ["", "one", "One TWO", "a b c d", "ünï çode ÄB 12", "x" * 63 + " " + "y" * 64 + " " + "z" * 65, "q" * 5000 + "-" + "r" * 100000, "...", "a\x00b\tc", "日本 語 a"]
    for ngram in (1, 2, 3):
        codes, off, n = I.features(pa.array(texts), ngram=ngram)
        for k, t in enumerate(texts):
            w = words(t)
            want = sorted(zlib.crc32(" ".join(w[i : i + j]).encode()) % 10000 for j in range(1, ngram + 1) for i in range(len(w) - j + 1))
            assert codes[off[k] : off[k + 1]].tolist() == want and n[k] == len(w)


@pytest.mark.parametrize("seed", (1, 2))
def test_against_plain_code_with_copies_ties_and_nulls(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(60)] + ["Éa", "über", "x9"]
    texts = [None, "", "!!", "too short", "long " * 3000] + [" ".join(rng.choices(vocabulary, k=rng.choice((19, 20, 21, 60)))) for _ in range(70)]
    docs = [(i, rng.choice(texts)) for i in range(400)] + [(1000 + i, texts[9]) for i in range(300)] + [(5, texts[8])] * 2 + [(None, texts[10])] * 3
    target = [" ".join(rng.choices(vocabulary[:20], k=50)) for _ in range(10)] + [None]
    df = spark.createDataFrame([(*d, "w", 0.5, 1) for d in docs], SCHEMA)
    got = I.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=20)
    want = plain(docs, target, 20)
    assert as_rows(got.select("doc_id", "n_features", "weight", "score").collect()) == as_rows(r[:4] for r in want)
    assert sorted(r[4] for r in want if r[4]) == list(range(1, 1 + sum(r[4] is not None for r in want)))
    ranked = lambda rows: sorted((r[4], r[3], r[0]) for r in rows if r[4] and r[0] is not None)  # noqa: E731  rows without an id tie
    assert ranked(got.collect()) == ranked(want)


def test_tables_without_rows(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a " * 30, None, None, None)] * 40, SCHEMA)
    assert I.resample(none, some).collect() == []
    assert as_rows(I.resample(some, none).collect()) == as_rows(plain([(1, "a " * 30)] * 40, []))


def test_the_query_over_its_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = I.op11_importance(spark, d)
    assert as_rows(got.collect()) == as_rows(plain(docs, [r[0] for r in spark.read.parquet(f"{d}/benchmark.parquet").select("text").collect()]))
    assert {t for _, t in got.dtypes} == {"bigint"} and got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
