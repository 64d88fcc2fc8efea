"""The Frechet distance of each class against eigenvalues of the covariances' product."""

import numpy as np

from curalith.operators import audit as A


def test_distance_over_the_embeddings(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = e.collect()
    want = {}
    for c in {r["label"] for r in rows}:
        a, b = (np.array([r["embedding"] for r in rows if r["label"] == c and r["vec_id"] % 2 == k], float) for k in (0, 1))
        if min(len(a), len(b)) > 1:
            s, t = np.cov(a.T), np.cov(b.T)
            root = np.sqrt(np.linalg.eigvals(s @ t).astype(complex)).real.sum()
            want[str(c)] = len(a), len(b), ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(s) + np.trace(t) - 2 * root
    got = {r["class"]: tuple(r)[1:] for r in A.frechet(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "label", "embedding").collect()}
    assert got.keys() == want.keys() and all(got[c][:2] == want[c][:2] and abs(got[c][2] - want[c][2]) < 1e-4 * want[c][2] for c in want)
