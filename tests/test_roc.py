"""ROC curves and macro AUC by plain code, over few and many distinct scores."""

import random

import pytest

from curalith.operators import metrics as X

SCHEMA = "m string, y int, probs array<double>"


def curve(rows, c):
    """From the highest score down; a point between equal steps goes."""
    scores = sorted({p[c] for _, p in rows}, reverse=True)
    steps = [(sum(p[c] == s and y == c for y, p in rows), sum(p[c] == s and y != c for y, p in rows)) for s in scores]
    pos, neg = map(sum, zip(*steps))
    out, tp, fp = {(None, 0.0 if pos else None, 0.0 if neg else None)}, 0, 0
    for i, (s, (a, b)) in enumerate(zip(scores, steps)):
        tp, fp = tp + a, fp + b
        if i in (0, len(scores) - 1) or steps[i + 1] != (a, b):
            out.add((s, tp / pos if pos else None, fp / neg if neg else None))
    return out


def auc(rows, c):
    a, b = [p[c] for y, p in rows if y == c], [p[c] for y, p in rows if y != c]
    return sum((x > z) + (x == z) / 2 for x in a for z in b) / len(a) / len(b) if a and b else None


@pytest.mark.parametrize("digits", [1, 3, 12])
def test_curves_and_macro_auc(spark, digits):
    rng = random.Random(digits)
    rows = []
    for _ in range(400):
        p = round(rng.random() ** 2, digits)
        rows.append((rng.randrange(3), [p, round(rng.random(), digits), 1 - p]))
    rows += [(0, [1.0, 0.0, 0.0]), (1, [1.0 - 1e-13, 0.0, 1e-300])]
    df = spark.createDataFrame([("a", y, p) for y, p in rows] + [("b", 0, [0.5, 0.25, 0.25])] * 3, SCHEMA)
    got = X.roc_points(df, 3, ["m"]).collect()
    for c in range(3):
        mine = [(r["score"], r["tpr"], r["fpr"]) for r in got if r["m"] == "a" and r["class"] == c]
        assert len(mine) == len(set(mine)) and set(mine) == curve(rows, c)
    assert {(r["score"], r["tpr"], r["fpr"]) for r in got if r["m"] == "b" and r["class"] == 0} == {(None, 0.0, None), (0.5, 1.0, None)}
    whole = X.roc_points(df, 3, ["m"], drop=False).where("m = 'a' and class = 1").count()
    assert whole == len({p[1] for _, p in rows}) + 1
    by = {r["m"]: r["auc"] for r in X.macro_auc(df, 3, ["m"]).collect()}
    assert abs(by["a"] - sum(auc(rows, c) for c in range(3)) / 3) < 1e-12 and by["b"] is None
