"""Spanning forests and components by threshold against union-find over sorted links."""

import random

import pytest

from curalith.operators import audit as A, forest as T
from curalith.storage import materialise


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def kruskal(links):
    best = {}
    for a, b, s in links:
        if None not in (a, b, s) and a != b:
            k = min(a, b), max(a, b)
            best[k] = max(best.get(k, s), s)
    sets = Sets()
    return {(a, b, s) for (a, b), s in sorted(best.items(), key=lambda e: (-e[1], e[0])) if sets.join(a, b)}


def largest(links, tau):
    sets = Sets()
    for a, b, s in kruskal(links):
        if s >= tau:
            sets.join(a, b)
    size = {}
    for x in list(sets.up):
        size[sets.root(x)] = size.get(sets.root(x), 0) + 1
    return max(size.values(), default=1)


def graph():
    rng = random.Random(3)
    out = [(rng.randrange(120), rng.randrange(120), round(rng.random(), 2)) for _ in range(260)]  # ties of scores, repeats, self-links
    out += [(1000, i, 0.5 + i % 3 / 10) for i in range(1001, 1200)] + [(1001, 1002, 0.9), (None, 1, 0.9), (5, None, 0.9), (7, 8, None)]  # a hub and nulls
    return out + [(2000 + i, 2001 + i, i / 30) for i in range(29)] + [(2029, 2000, 1.0)]  # a ring of rising scores


@pytest.mark.parametrize("small", [0, 40, 50_000])
def test_forest_and_thresholds(spark, monkeypatch, small):
    """By rounds alone, by rounds and then one task, and by one task alone."""
    monkeypatch.setattr(T, "SMALL", small)
    links = graph()
    df = spark.createDataFrame(links, "src long, dst long, score double")
    got = materialise(T.spanning_forest(df), "forest")
    assert sorted(map(tuple, got.collect())) == sorted(kruskal(links))
    taus = [0.1, 0.61, 1.5] if small else [0.61]
    assert T.largest_components(got, taus) == {t: largest(links, t) for t in taus}


def test_escalation_stops_at_the_first_small_component(spark):
    links = [(0, 1, 0.9), (1, 2, 0.8), (2, 3, 0.7), (3, 4, 0.6)]
    df = spark.createDataFrame(links, "src long, dst long, score double")
    got = A.escalate(df, 100, [0.5, 0.75, 0.85], most=0.03).collect()
    assert [tuple(r) for r in got] == [(0.5, 5, 0.05, False), (0.75, 3, 0.03, True)]
    none = df.limit(0)
    assert T.spanning_forest(none).count() == 0 and A.escalate(none, 0, [0.5, 0.6]).collect()[0]["largest"] == 1
