"""Counts of the quality rules by plain code, trees by plain walks, constraints, and held-out labels."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from curalith.llm import boosting, quality_rules as Q

D = "/root/testdata"


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    hit = {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(5)}
    counts = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(hit))
    return (*counts, len(w) < 10 or 100 * len(hit) > 20 * len(w))


def texts(seed):
    rng = random.Random(seed)
    words = ["a", "bb", "Über", "#x", "日本", "c!", "*&", "d.", "e", "f<g>"]
    out = ["", " \n\n", "\x0b\x0c", "one", "a\n\na\n a\na", "x\r\nx\r\n", "w " * 5, "w " * 6, "p q r s t p q r s t", "é" * 70000, "\x00 \x1f a", "a b c d e\n" * 40000]
    for _ in range(150):
        out.append(rng.choice(("", "\n")).join(rng.choice(words) + rng.choice((" ", "\n", "  ", "\t", "\x0b")) for _ in range(rng.choice((3, 9, 10, 30, 200)))))
    return out


@pytest.mark.parametrize("seed", (1, 2))
def test_counts_by_plain_code(seed):
    t = texts(seed)
    counts, x = Q.statistics(pa.array(t))
    failed = Q.base_failed(counts)
    assert [(*c.tolist(), bool(f)) for c, f in zip(counts, failed)] == [plain(s) for s in t]
    assert x.shape == (len(t), len(Q.STATISTICS)) and np.isfinite(x).all()
    alone = np.concatenate([Q.statistics(pa.array([s]))[1] for s in t[:60]])
    assert np.allclose(alone, x[:60])  # what else is in a batch does not matter


def walked(m, row):
    total = m.start
    for node in m.roots:
        while m.left[node] != node:
            node = m.left[node] if row[m.feature[node]] <= m.limit[node] else m.right[node]
        total += m.value[node]
    return total


def test_node_arrays_score_as_walks_do_and_obey_constraints():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    # the raw relation falls and rises with both constrained features
    y = ((np.sin(2 * x[:, 0]) + np.cos(3 * x[:, 1]) + x[:, 2] + rng.normal(size=3000) * 0.5) > 0).astype(float)
    m = boosting.fit(x, y, np.array([1, -1, 0, 0]))
    assert len(m.roots) == 80 and np.allclose(m.margins(x[:200]), [walked(m, r) for r in x[:200]])
    grid = np.linspace(-4, 4, 200)
    for row in x[:50]:
        for f, way in ((0, 1), (1, -1)):
            line = np.repeat(row[None], len(grid), 0)
            line[:, f] = grid
            assert (way * np.diff(m.margins(line)) >= -1e-12).all()
    free = boosting.fit(x, y, np.zeros(4, int))
    line = np.repeat(x[:1], len(grid), 0)
    line[:, 0] = grid
    assert (np.diff(free.margins(line)) < -1e-9).any() and ((free.scores(x) > 0.5) == y).mean() > 0.85


def test_constant_models():
    for y in (np.zeros(0), np.zeros(20), np.ones(20)):
        m = boosting.fit(np.ones((len(y), 3)), y, np.zeros(3, int))
        assert not len(m.roots) and np.ptp(m.scores(np.random.rand(5, 3))) == 0


def test_held_out_labels_and_counts_of_the_query(spark):
    got = {r["doc_id"]: r for r in Q.op13_quality_rules(spark, f"{D}/sf0.01").collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert tuple(r[c] for c in (*Q.COUNTS, "base_failed")) == plain(docs[i])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["score"] <= 1
    held = [r for r in spark.read.parquet(f"{D}/sf0.01/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good = [got[r["doc_id"]] for r in held if r["quality"] == 1 and not got[r["doc_id"]]["base_failed"]]
    bad = [got[r["doc_id"]] for r in held if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)


def test_odd_inputs(spark):
    rows = [(None, None, "x", 1.0), (1, "", None, None), (1, "", None, None), (2, "word " * 300000, "s", 0.5), (3, "some plain words that stand in a row and then end.", "k", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEPT string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    rules = Q.fit_sample(docs, labels)
    got = Q.with_verdicts(docs, rules).collect()
    assert len(got) == 5 and got[0].asDict().keys() == {"doc_id", "text", *Q.COUNTS, "base_failed", "score", "kept"}
    by = sorted(((r["doc_id"] or 0, r["n_words"], r["base_failed"], r["kept"]) for r in got))
    assert by == [(0, 0, True, False), (1, 0, True, False), (1, 0, True, False), (2, 300000, True, False), (3, 11, False, True)]
    assert Q.with_verdicts(docs.limit(0), rules).count() == 0 and Q.fit_sample(docs.limit(0), labels.limit(0)).limit == 0


@pytest.mark.parametrize("block", (250, 10**6))
def test_trees_of_a_table_are_those_of_arrays(spark, block):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(-3, 9, 2000) / 4, rng.integers(0, 12, 2000), rng.integers(0, 3, 2000)]).astype(float)
    y = ((np.sin(x[:, 0]) + np.cos(x[:, 1]) - x[:, 2] / 3 + rng.normal(size=2000) * 0.4) > 0).astype(float)
    way = np.array([1, 0, -1])
    table = spark.createDataFrame([(i, int(b), bytearray(a.tobytes())) for i, (a, b) in enumerate(zip(x, y))], "id long, y int, x binary")
    want, got = (boosting.fit(x, y, way, rounds=12), boosting.fit_table(table, way, rounds=12, block=block))
    assert len(got.roots) == 12 and np.allclose(got.margins(x), want.margins(x), atol=1e-4) and np.ptp(want.margins(x)) > 1
    assert not len(boosting.fit_table(table.where("y = 1"), way).roots) and not len(boosting.fit_table(table.limit(0), way).roots)


def test_rules_come_from_all_labelled_rows(spark):
    """Bad rows are labelled only behind the first 8,000 in the order of hashed ids, by which a sample was drawn once."""
    import hashlib

    ids = sorted((i for i in range(12000) if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert len(ids) > 9000
    good, bad = "some plain words that stand in a row and then end here.", "some ^^ words ^^ that ^^ stand in a row ^^ and end here"
    docs = spark.createDataFrame([(i, good if k < 8000 else bad) for k, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k < 8000)) for k, i in enumerate(ids)], "doc_id long, quality int")
    kept = Q.with_verdicts(docs, Q.fit_sample(docs, labels)).groupBy("text", "kept").count().collect()
    assert {(r["text"], r["kept"]) for r in kept} == {(good, True), (bad, False)}
