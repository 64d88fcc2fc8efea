"""Line dedup against brute force over all pairs of lines."""

import random

import pytest

from curalith.llm import line_dedup

SCHEMA = "doc_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def kept(docs, edits):
    """Texts without lines that lie within the bound of an earlier one; ids and texts of ``docs`` differ."""
    lines = [(i, n, x) for i, t in sorted(docs) for n, x in enumerate(t.split("\n"))]
    gone = {(i, n) for at, (i, n, x) in enumerate(lines) if x and any(y and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits for _, _, y in lines[:at])}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in docs}


def edited(rng, x, edits):
    for _ in range(edits):
        at = rng.randrange(len(x) + 1)
        x = rng.choice([x[:at] + x[at + 1 :], x[:at] + "q" + x[at:], x[:at] + "é" + x[at + 1 :]])
    return x


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_equals_brute_force(spark, edits):
    rng = random.Random(edits)
    word = lambda n: "".join(rng.choice("abc d🙂") for _ in range(n))
    base = [word(n) for n in (1, 1, 2, 3, 5, 8, 9, 10, 12, 20, 31, 33, 40, 64, 65, 90, 140, 300, 700 if edits < 2 else 70)]
    docs = []
    for i in range(30 if edits < 2 else 20):
        docs.append((i, "\n".join(rng.choice(["", word(7), edited(rng, rng.choice(base), rng.randrange(edits + 2))]) for _ in range(5))))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, SCHEMA), edits=edits).collect()}
    assert got == kept(docs, edits)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "same line\n\n\nother", "y"), (3, "same line\n\n\nother", "z"), (None, "same line\nnew here", None), (4, "Other\n" + "w" * 30000), (5, "w" * 29999 + "\nfresh")]
    docs = spark.createDataFrame([(*r, None)[:3] for r in rows], "doc_id long, text string, _d string").withColumnRenamed("_d", "_D")
    got = sorted(line_dedup.dedup_lines(docs).select("doc_id", "text", "_D").collect(), key=repr)
    assert got == sorted([(1, None, "x"), (2, "", "x"), (3, "same line\n\n\nother", "y"), (3, "same line\n\n\nother", "z"), (None, "new here", None), (4, "w" * 30000, None), (5, "fresh", None)], key=repr)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
