from pyspark.sql import functions as F
from curalith.operators.curation import balance, resolve_exact, sample_fraction
from curalith.operators.graph import connected_components
from curalith.operators.metrics import confusion, per_class, summary


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)] + [(200, x) for x in range(201, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{x: 200 for x in range(200, 260)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_metrics_by_hand(spark):
    """Twelve labels of three classes, and the formulas over their confusion matrix in plain numbers."""
    y = [2, 2, 2, 2, 2, 1, 1, 1, 1, 0, 0, 0]
    p = [2, 2, 1, 2, 0, 1, 1, 2, 1, 0, 2, 0]
    m = [[sum(a == i and b == j for a, b in zip(y, p)) for j in range(3)] for i in range(3)]
    t, q, n = [sum(r) for r in m], [sum(c) for c in zip(*m)], len(y)
    f1 = [2 * m[i][i] / (t[i] + q[i]) for i in range(3)]
    acc, pe = sum(m[i][i] for i in range(3)) / n, sum(a * b for a, b in zip(t, q)) / n**2
    want = {
        "accuracy": acc, "f1_macro": sum(f1) / 3, "f1_weighted": sum(f * a for f, a in zip(f1, t)) / n, "balanced_accuracy": sum(m[i][i] / t[i] for i in range(3)) / 3, "kappa": (acc - pe) / (1 - pe),
        "mcc": (acc * n * n - pe * n * n) / ((n * n - sum(x * x for x in q)) * (n * n - sum(x * x for x in t))) ** 0.5,
    }
    rows = spark.createDataFrame([("a", a, b) for a, b in zip(y, p)], "m string, y int, pred int")
    s = summary(per_class(confusion(rows, 3, ["m"]), ["m"]), ["m"]).first()
    for k, v in want.items():
        assert abs(s[k] - v) < 1e-9, k


def test_macro_f1_over_present_labels(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("a", 1, 1)], "m string, y int, pred int")
    classes = per_class(confusion(rows, 3, ["m"]), ["m"])
    assert summary(classes, ["m"]).first().f1_macro < 0.7 and summary(classes, ["m"], present_only=True).first().f1_macro == 1


def test_exact_resolution(spark):
    pool = [("h4", "a", "holdout", "p6"), ("h4", "a", "test", "p7"), ("h1", "a", "train", "p1"), ("h1", "a", "test", "p2"), ("h2", "a", "train", "p3"), ("h2", "b", "val", "p4"), ("h3", "a", "val", "p5")]
    got = {r.path: r.reason for r in resolve_exact(spark.createDataFrame(pool, "h string, c string, split string, path string"), "h", "c", "split", "path").collect()}
    assert got == {"p6": "exact_duplicate", "p7": None, "p1": "exact_duplicate", "p2": None, "p3": "conflicting_label", "p4": "conflicting_label", "p5": None}


def test_sampling_is_half_even_and_never_empty(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "c string, i int")
    got = {r.c: r["count"] for r in sample_fraction(rows, "c", "i", 0.5, "s").groupBy("c").count().collect()}
    assert got == {"a": 2, "b": 1}
    assert balance(rows, "c", "i", 3, 4, "s").groupBy("c").sum("copies").orderBy("c").collect() == [("a", 4), ("b", 3)]


def test_one_level_fingerprint_of_a_manifest(spark):
    import hashlib

    from curalith.operators import curation as C

    rows = spark.createDataFrame([(3, "c"), (1, "é"), (2, "b"), (2, "b")], "id long, x string")
    assert C.plain_fingerprint(rows, F.concat_ws("|", "id", "x")) == hashlib.sha256("1|é\n2|b\n2|b\n3|c".encode()).hexdigest()
