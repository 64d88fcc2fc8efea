"""The pipeline's rows against brute force over what the classifier keeps."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from curalith.llm import bpe, mixing

SF = "/root/testdata/sf0.001"


def lowered(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_pipeline(spark):
    import public_tokenizers as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r.asDict() for r in corpus_pipeline.good_documents(spark, docs, SF).collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stay = {r["doc_id"] for r in good}
    assert sum((d in stay) == (q == 1) for d, q in labels.items()) >= 0.95 * len(labels)

    last = {}
    for r in good:
        k = lowered(r["text"])
        if k not in last or r["doc_id"] > last[k]["doc_id"]:
            last[k] = r
    rows = sorted(last.values(), key=lambda r: r["doc_id"])
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(r["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = collections.defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                near[i].add(j)
                near[j].add(i)
    seen, first = set(), []
    for i in range(len(rows)):  # by id, so the first of each group is its least
        if i not in seen:
            first.append(rows[i])
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo.extend(near[x])

    import pandas as pd

    con = duckdb.connect()
    con.register("left_over", pd.DataFrame(first)[["doc_id", "text", "source"]])
    took = con.sql(mixing.ORACLE["op5_mixing"].replace("documents", "left_over")).fetchall()
    copies = {d: taken // size if size else 0 for d, size, _, _, taken in took}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = collections.Counter()
    for r in first:
        ids = enc.encode_ordinary(r["text"] or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[(r["doc_id"], len(ids), digest, hashlib.sha256((r["text"] or "").encode()).hexdigest())] = copies[r["doc_id"]]
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert collections.Counter(map(tuple, got)) == +want and got


def test_near_dedup_drops_rows_not_ids(spark):
    w = [f"w{i}" for i in range(200)]
    near = lambda n, at: " ".join(f"{n}{x}" if i != at else "new" for i, x in enumerate(w))
    rows = [(1, near("a", None)), (2, near("a", 50)), (2, near("b", None)), (3, near("b", 20)), (None, near("c", None)), (None, near("c", 90)), (None, near("a", 70)), (None, "alone"), (4, ""), (5, near("d", None))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.without_near_copies(spark, docs, SF).collect()]
    c = min((rows[4], rows[5]), key=lambda r: hashlib.sha256(r[1].encode()).hexdigest())
    assert sorted(got, key=repr) == sorted([rows[0], rows[2], c, rows[7], rows[8], rows[9]], key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "a long text of many words " * 8000


def edges(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns with names of the stages' own."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three four five six", "en", "s", 5), (3, "one two three four five six", "en", "s", 5), (3, "another text of this id entirely", "en", None, 5)]
    rows += [(None, f"no id here at all, number {i} of several", None, "t", None) for i in (1, 2, 3)] + [(None, "no id here at all, number 1 of several", None, "t", None), (7, LONG, "en", "s", len(LONG))]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("_row", "_id", "_at", "_n", "_score", "_taken", "copies", "row", "n", "key", "size", "s", "bucket"):
        docs = docs.withColumn(name, F.lit("mine"))
    return rows, docs


def counted(frame):
    assert frame.columns == list(corpus_pipeline.COLUMNS)
    return collections.Counter(map(tuple, frame.collect()))


def test_stages_on_edges(spark):
    rows, docs = edges(spark)
    every = collections.Counter(rows)
    assert counted(corpus_pipeline.good_documents(spark, docs, SF)) <= every
    # of equal texts the row with the largest id stays
    assert counted(corpus_pipeline.without_copies(spark, docs, SF)) == collections.Counter({r: 1 for r in every if r != rows[0]})
    near = counted(corpus_pipeline.without_near_copies(spark, docs, SF))
    assert near == every
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    got = [tuple(r) for r in corpus_pipeline.encoded(spark, docs, SF).select("doc_id", "n_tokens", "decoded_sha256").collect()]
    assert sorted((d, x) for d, _, x in got if d) == sorted((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows if r[0])
    assert all((n == 0) == (x == hashlib.sha256(b"").hexdigest()) for _, n, x in got)


def test_mixing_takes_what_the_plan_says(spark):
    """Rows without an id, of one id, and rows that repeat are taken as often as planned, in all and each."""
    rows, docs = edges(spark)
    plan = mixing.mix(docs.select(*corpus_pipeline.COLUMNS).withColumn("r", F.to_json(F.struct("doc_id", "text", "source"))), row="r").collect()
    want = collections.Counter()
    for r in plan:
        want[r.row] += r.copies
    got = collections.Counter()
    for d, t, _, s, _ in counted(corpus_pipeline.mixed(spark, docs, SF)).elements():
        got[(d, t, s)] += 1
    keys = {r.r: (r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source", F.to_json(F.struct("doc_id", "text", "source")).alias("r")).collect()}
    assert got == +collections.Counter({keys[k]: n for k, n in want.items()}) and got
    assert sum(r.size for r in plan) * 1.5 >= sum(r.taken for r in plan) > sum(r.size for r in plan)
