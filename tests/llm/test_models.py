"""Token counts over a table, marginals of the line field, long matches of the encoder, and base spans, by plain code."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalith.llm import bpe, pii, quality, tokens

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("seed", range(4))
def test_marginals_by_enumeration(seed):
    """Every labelling of short chains, weighed by its score, against forward and backward sums."""
    rng = np.random.default_rng(seed)
    sizes = [0, 1, 2, 5, 0, 7, 3]
    first = np.cumsum([0, *sizes])
    unary, t = rng.normal(size=first[-1]) * 3, rng.normal(size=(2, 2)) * 2
    good, pair, log_z = quality.marginals(unary, first, t)
    for d, (a, b) in enumerate(zip(first[:-1], first[1:])):
        if a == b:
            assert not pair[d].any() and log_z[d] == 0
            continue
        weights, on, moves = [], np.zeros(b - a), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            score = sum(unary[a + i] for i, y in enumerate(labels) if y) + sum(t[x, y] for x, y in itertools.pairwise(labels))
            weights.append(np.exp(score))
            on += weights[-1] * np.array(labels)
            for x, y in itertools.pairwise(labels):
                moves[x, y] += weights[-1]
        z = sum(weights)
        assert np.allclose(good[a:b], on / z) and np.allclose(pair[d], moves / z) and np.isclose(log_z[d], np.log(z))


def test_document_score_weighs_lines_by_length(spark):
    field = quality.LineField(np.zeros(20, np.float32), np.ones(20, np.float32), np.r_[np.zeros(60), 1.5], np.zeros((2, 2)), 0.25)
    import pyarrow as pa

    got = field.scores(pa.array(["a line\nand another", "", "\n\n"]))
    assert np.allclose(got, [1 / (1 + np.exp(-1.5)), 0.25, 0.25])


def test_token_counts_over_a_table(spark):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    first, later = map(set, tokens.byte_vocabulary(path))

    def count(w):
        """Longest pieces one after the other; 1 for a word that they cannot cover."""
        n = i = 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in (later if i else first)), None)
            if j is None:
                return 1
            n, i = n + 1, j
        return n

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(None, None), (1, ""), (1, "one one"), (1, "one one"), (2, " \t\n"), (3, "x" * 20000), (4, "é🙂\x0bword")]
    want = [(d, len((t or "").encode().split()), sum(map(count, (t or "").encode().split()))) for d, t in docs]
    frame = spark.createDataFrame(docs, SCHEMA).withColumn("n_words", F.lit("replaced"))
    got = tokens.token_counts(frame, path).select("doc_id", "n_words", "n_tokens").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tokens.token_counts(frame.limit(0), path).count() == 0


def test_long_matches(monkeypatch):
    """One match of many thousand bytes is joined by windows at every level, and equals the library's ids."""
    import public_tokenizers as P

    b = bpe.Bpe(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN, piece=64)
    rng = random.Random(3)
    for t in ("a" * 9000, "ab" * 4000, "x" * 5001 + "y" * 3000, "".join(rng.choice("etaoin") for _ in range(9000)), " " * 7000, "=" * 5000 + "é" * 2000):
        ids = b.encode(t)
        assert ids.tolist() == b.base.encode_ordinary(t) and b.decode(ids).decode() == t


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = []
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    for k, (name, pattern, ok) in enumerate(kinds):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t) if ok(m.group())]
    return ",".join(x for *_, x in sorted(out))


def test_base_spans_equal_plain_patterns(spark):
    """Random texts, and whole documents, against the patterns as they are stated."""
    rng = random.Random(5)
    parts = ["a.b", "@", "x-y", ".", "1", "22", "255", "256", "007", " ", "-", "+", "(", ")", "é", "🙂", "4111 1111 1111 1111", "4111-1111", "10.0.0.1", "+1 555 555 1234", "me@it.example.org", "\n", "_%", "378282246310005"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(1500)] + [(None, None), (3, ""), (3, ""), (9, "1.2.3.4, " * 500)]
    docs += [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    frame = spark.createDataFrame(docs, SCHEMA).withColumn("_t", F.lit(1)).withColumn("_wide", F.lit(2)).withColumn("_base", F.lit(3))
    got = pii.find(frame, pii.Trees([])).select("doc_id", "text", pii.written(F.col("base")).alias("base"), pii.written(F.col("spans")).alias("spans"), "_t", "_wide", "_base").collect()
    assert sorted(((r.doc_id, r.text, r.base) for r in got), key=repr) == sorted(((d, t, base_spans(t or "")) for d, t in docs), key=repr)
    assert all((r._t, r._wide, r._base) == (1, 2, 3) and r.spans == r.base for r in got)


def test_counts_of_spans(spark):
    rows = pii.op7_pii(spark, "/root/testdata/sf0.001").collect()
    assert all(r.n_spans == len(list(filter(None, r.spans.split(",")))) >= r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)
    assert sum(r.n_spans for r in rows) > 0
