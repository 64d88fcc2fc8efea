"""The metric partition against all pairs: near copies among clusters, copies, mirrors, zero and null vectors."""

import math

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from curalith.operators import audit as A, links as L, metric as M
from curalith.plans import registry


def clustered(rng, n, dims=16, clusters=40, spread=0.35):
    """Vectors around cluster centres, and to one in ten a near copy at cosines of about 0.90 to 0.99."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = unit(rng.normal(size=(clusters, dims)))
    x = unit(centre[rng.integers(0, clusters, n)] + spread * unit(rng.normal(size=(n, dims))) * rng.random((n, 1)))
    some = x[: n // 10]
    near = unit(some + unit(rng.normal(size=some.shape)) * rng.uniform(0.1, 0.45, (len(some), 1)))
    return np.concatenate([x, near])


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in enumerate(vectors, start)], "id long, v array<double>")


def units(x, centre=0.0):
    x = x - centre
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def links(got):
    return {(r["src"], r["dst"]): round(r["score"], 9) for r in got.collect()}


@pytest.mark.parametrize("least", [0.9, 0.95, 0.98])
def test_links_of_clustered_vectors(spark, least):
    x = clustered(np.random.default_rng(1), 1500)
    s = units(x, x.mean(0)) @ units(x, x.mean(0)).T
    i, j = np.nonzero(np.triu(s >= least, 1))
    want = {(int(a), int(b)): round(float(s[a, b]), 9) for a, b in zip(i, j)}
    assert links(L.cosine_links(frame(spark, x), "id", "v", least, cell=50)) == want and want


def test_share_of_pairs_compared_at_two_sizes(spark):
    share = []
    for n in (2000, 8000):
        x, log = clustered(np.random.default_rng(n), n, clusters=n // 25, spread=0.2), []
        got = links(L.cosine_links(frame(spark, x), "id", "v", 0.95, cell=25, log=log))
        share.append(log[0]["met"] / (len(x) * (len(x) - 1) / 2))
        u = units(x, x.mean(0))
        s = u @ u.T
        assert got.keys() == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(s >= 0.95, 1)))}
    assert share[1] < share[0] < 0.2, share


def test_blocks_of_a_crowded_cell_meet_once(spark):
    x = clustered(np.random.default_rng(3), 300, clusters=2)
    items = M.packed(frame(spark, x), "id", ["v"])
    u = units(x)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)))}
    got = M.pairs_within(items, 16, 0.9, cell=100, block=17).select("src", "dst").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == want


def test_copies_hang_on_stars_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=8), rng.normal(size=8)
    rows = [a, b, a, a * 1.001, None, b, np.zeros(8), np.zeros(8), a]
    df = frame(spark, rows)
    m = np.mean([r for r in rows if r is not None], 0)
    got = links(L.cosine_links(df, "id", "v", 0.9, cell=2))
    # classes {0, 2, 8}, {1, 5}, {6, 7}, and 3 near 0
    assert {(0, 2), (0, 8), (0, 3), (1, 5), (6, 7)} <= got.keys() and (2, 3) not in got and not any(4 in k for k in got)
    centred = units(np.array([a, b, a * 1.001, np.zeros(8)]), m)
    assert abs(got[0, 3] - centred[0] @ centred[2]) < 1e-9
    assert links(L.cosine_links(df.where("v is null"), "id", "v", 0.9)) == {} == links(L.cosine_links(df.limit(0), "id", "v", 0.9))


def test_mirrors_count_for_the_later_row(spark):
    x = clustered(np.random.default_rng(5), 400)
    df = spark.createDataFrame([(i, v.tolist(), v[::-1].tolist()) for i, v in enumerate(x)], "id long, v array<double>, w array<double>")
    u, w = units(x, x.mean(0)), units(x[:, ::-1], x.mean(0))
    s = np.maximum(u @ u.T, u @ w.T)
    want = {(int(a), int(b)): round(float(s[a, b]), 9) for a, b in zip(*np.nonzero(np.triu(s >= 0.8, 1)))}
    assert links(L.cosine_links(df, "id", "v", 0.8, "w", cell=60)) == want


@pytest.mark.parametrize("mirror", [None, "w"])
def test_nearest_reference_and_the_pairs_it_compares(spark, mirror):
    rng = np.random.default_rng(6)
    shares = []
    for n in (1000, 5000):
        x = clustered(rng, n, clusters=n // 25, spread=0.2)
        ask, ref = x[-n // 10 :], np.concatenate([x[: -n // 10], x[:5]])
        df = spark.createDataFrame([(i, v.tolist(), v[::-1].tolist()) for i, v in enumerate(ref)], "id long, v array<double>, w array<double>")
        log = []
        got = {r["query"]: (r["reference"], r["score"]) for r in A.nearest(frame(spark, ask, 10**6), df, "id", "v", mirror, cell=25, log=log).collect()}
        s = units(ask) @ units(ref).T
        s = s if mirror is None else np.maximum(s, units(ask) @ units(ref[:, ::-1]).T)
        assert len(got) == len(ask)
        for i in range(len(ask)):
            r, score = got[10**6 + i]
            assert abs(score - s[i].max()) < 1e-9 and s[i, r] > s[i].max() - 1e-9 and r == np.flatnonzero(s[i] > s[i].max() - 1e-12)[0]
        shares.append(sum(x["met"] for x in log) / (len(ask) * len(ref)))
    assert mirror or shares[1] < shares[0] < 0.5, shares


def test_nearest_of_odd_inputs(spark):
    ref = frame(spark, [np.ones(4), None, np.zeros(4), np.array([1.0, 0, 0, 0])])
    ask = frame(spark, [None, np.zeros(4), np.ones(4), -np.ones(4)], 10)
    got = {r["query"]: (r["reference"], round(r["score"], 9)) for r in A.nearest(ask, ref, "id", "v", cell=1).collect()}
    assert got == {11: (0, 0.0), 12: (0, 1.0), 13: (2, 0.0)}
    assert A.nearest(ask, ref.limit(0), "id", "v").count() == 0 == A.nearest(ask.limit(0), ref, "id", "v").count()


def test_random_vectors_are_sent_once_a_tile_and_no_link_is_shuffled(spark):
    """Visits would send each of 3,000 vectors to about 30 cells; tiles send it to six."""
    x, log = np.random.default_rng(8).normal(size=(3000, 32)), []
    items = M.packed(frame(spark, x), "id", ["v"])
    u = units(x)
    got = M.pairs_within(items, 32, 0.5, cell=50, block=100, log=log)
    assert {(r["src"], r["dst"]) for r in got.collect()} == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.5, 1)))}
    assert log[0]["visits"] <= 5 * len(x) and "hashpartitioning(src" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("least, cell", [(0.3, 50), (0.9, 10)])
def test_thinned_links_connect_what_all_connect(spark, monkeypatch, least, cell):
    monkeypatch.setattr(M, "LINKS", 200)
    x = np.random.default_rng(9).normal(size=(600, 16)) if least < 0.5 else clustered(np.random.default_rng(9), 600)
    df, taus = frame(spark, x), [least, least + 0.05, least + 0.08]
    every, thin = L.cosine_links(df, "id", "v", least, cell=cell), L.cosine_links(df, "id", "v", least, cell=cell, forest=True)
    assert thin.count() < every.count()
    assert [tuple(r) for r in A.escalate(thin, 600, taus, most=0).collect()] == [tuple(r) for r in A.escalate(every, 600, taus, most=0).collect()]


def with_copies(rng, n=300):
    """Vectors of which some are held by several rows, whose ids lie between those of others; one by many."""
    x = clustered(rng, n)
    return x[np.concatenate([rng.permutation(len(x)), rng.integers(0, len(x), n // 3), [7] * 40])]


@pytest.mark.parametrize("saves", [0.0, 1.0])
@pytest.mark.parametrize("mirror", [None, "w"])
def test_copies_are_in_all_their_pairs_by_tiles_and_by_visits(spark, monkeypatch, saves, mirror):
    monkeypatch.setattr(M, "SAVES", saves)
    x = with_copies(np.random.default_rng(10))
    df = spark.createDataFrame([(i, v.tolist(), v[::-1].tolist()) for i, v in enumerate(x)], "id long, v array<double>, w array<double>")
    u, w = units(x, x.mean(0)), units(x[:, ::-1], x.mean(0))
    s = np.maximum(u @ u.T, u @ w.T) if mirror else u @ u.T
    want = {(int(a), int(b)): round(float(s[a, b]), 9) for a, b in zip(*np.nonzero(np.triu(s >= 0.8, 1)))}
    got = L.cosine_links(df, "id", "v", 0.8, mirror, cell=60, whole=True)
    assert links(got) == want and got.count() == len(want)
    items = M.packed(df, "id", ["v", mirror] if mirror else ["v"], x.mean(0))
    parts = M.gathered(items, 3)  # classes in several parts
    assert parts.where("size(ids) > 3").isEmpty() and parts.where("kind = 0").selectExpr("sum(size(ids))").first()[0] == len(x)
    got = M.pairs_within(parts, 16, 0.8, cell=60, block=40)
    assert links(got) == want and got.count() == len(want)


def test_pairs_of_many_copies_come_in_parts(monkeypatch):
    monkeypatch.setattr(M, "LINKS", 10)
    members = M._members(pa.chunked_array([pa.array([[1, 4, 9, 20], [2, 3, 30]]), pa.array([[5]])]))
    x, y = (a.ravel() for a in np.meshgrid(range(3), range(3), indexing="ij"))
    got = [list(zip(*map(np.ndarray.tolist, part))) for part in M._links(x, y, np.ones(9), np.zeros(3, int), members, False)]
    ids = sorted([1, 4, 9, 20, 2, 3, 30, 5])
    assert sorted(sum(got, [])) == [(a, b, 1.0) for a in ids for b in ids if a < b] and len(got) > 1


@pytest.mark.parametrize("name", ["mirrored_cosine_links", "cosine_links"])
def test_queries_equal_their_sql_where_rows_repeat(spark, tmp_path, name):
    x = with_copies(np.random.default_rng(11), 120).astype(np.float32)
    pd.DataFrame({"vec_id": np.random.default_rng(1).permutation(len(x)), "embedding": list(x), "label": 0}).to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    want = {(a, b): s for a, b, s in con.sql(registry.oracle_sql()[name]).fetchall()}
    rows = registry.queries()[name](spark, str(tmp_path)).collect()
    got = {(r.src, r.dst): r.score for r in rows}
    assert got.keys() == want.keys() and len(rows) == len(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_visits_between_pivots_that_nearly_agree():
    """The gaps between pivots that are 1e-8 to 6e-8 apart are rounded in their products."""
    rng, alpha = np.random.default_rng(12), math.acos(0.4)
    for apart in np.linspace(1e-8, 6e-8, 60):
        c, e = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        p = np.array([c, c + apart * e])
        p /= np.linalg.norm(p, axis=1, keepdims=True)
        t = rng.uniform(-1.4, 1.4, 200)
        x = units(np.cos(t)[:, None] * c + np.sin(t)[:, None] * e + 0.02 * rng.normal(size=(200, 64)))
        angles = M._angles(x, p)
        own = angles.argmin(1)
        batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(own, pa.int32())], ["v", "cell"])
        widest = {i: angles[own == i, i].max() for i in range(2) if (own == i).any()}
        i, j, _ = M._reacher(p, widest, True, alpha)(batch)
        a, b = np.nonzero((x @ x.T >= 0.4) & (own[:, None] < own))
        assert set(zip(a.tolist(), own[b].tolist())) <= set(zip(i.tolist(), j.tolist()))
