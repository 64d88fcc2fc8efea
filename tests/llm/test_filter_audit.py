"""The filter audit against walking every order over the rows, and its odd inputs."""

import random
import re
from itertools import permutations

from curalith.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, extra string, good string, n int"
LABELS = "doc_id long, quality int, toxic int"


def flags(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, text, lang, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield i, lang or "", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t])


def walked(rows, labels):
    told = {}
    for i, q, x in labels:
        a, b = told.get(i, (False, False))
        told[i] = (a or q == 1, b or x == 1)
    all_ = [(*f, *(told.get(f[0], (False, False)) if f[0] is not None else (False, False))) for f in flags(rows)]
    out, value = {}, {}
    for part in {f[1] for f in all_}:
        mine = [f for f in all_ if f[1] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                k = "ABCDE".index(c)
                gone = [f for f in left if f[2][k]]
                left = [f for f in left if not f[2][k]]
                fails = [f for f in mine if f[2][k]]
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(sum(f[2]) == 1 for f in fails), sum(f[3] for f in gone), sum(f[4] for f in gone)]
                value[part, c] = value.get((part, c), 0) + len(gone)
    return {k: (*v, value[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, DOCS)
    got = A.audit(A.joint_failures(A.flagged(docs, spark.createDataFrame(labels, LABELS)))).collect()
    assert len(got) == len({r[:3] for r in got})
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got}


def test_against_walking_every_order(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n\t", "# x", "a" * 70000 + " b"]
    for _ in range(60):
        t = [rng.choice(words[: rng.choice((20, 400))]) for _ in range(rng.choice((5, 199, 200, 201, 260)))]
        if rng.random() < 0.3:
            t = [x.upper() for x in t[: len(t) // 2]] + t[len(t) // 2 :]
        texts.append(rng.choice((" ", "  ", "\n", "\x0b")).join(t) + rng.choice(("", "|", " ünï")))
    rows = [(i, rng.choice(texts), rng.choice(("en", "de", None, "")), "e", "g", 1) for i in range(300)]
    rows += [(None, texts[7], "en", None, None, None)] * 40 + [rows[3]] * 5 + [(1000 + i, texts[9], "xx", "e", "g", 1) for i in range(200)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    assert audited(spark, rows, labels) == walked(rows, labels)


def test_ties_of_equal_rows_and_tables_without_rows(spark):
    row = (7, "same text", "en", None, None, None)
    got = audited(spark, [row] * 3, [])
    assert len(got) == 600 and got["en", "EABCD", 1][:4] == (3, 0, 0, 0)  # none has a smaller id
    assert audited(spark, [], [(1, 1, 1)]) == {}


def test_shapley_adds_up_and_the_weights_are_inclusion_exclusion(spark):
    rows = [(i, "A # " * (i % 4) + "x", "en", None, None, None) for i in range(50)]
    got = audited(spark, rows, [])
    removed_by_all = 50 - got["en", "ABCDE", 5][0]
    assert sum(got["en", "ABCDE", s][6] for s in range(1, 6)) == 120 * removed_by_all


def test_the_query_over_its_tables(spark):
    got = A.op12_filter_audit(spark, "/root/testdata/sf0.001")
    docs = [(*r, None, None, None) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == walked(docs, labels)
    assert {t for c, t in got.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"} and dict(got.dtypes)["step"] == "int"
