"""A maximum spanning forest of scored links, and components at any number of thresholds from it.

Two nodes are connected by links of at least some score exactly if the forest's links of at least that score connect
them. So thresholds need no other look at the links, of which there may be far more than nodes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from curalith.operators.graph import connected_components
from curalith.operators.skew import join_groups
from curalith.storage import materialise


#: Contracted links that one task finishes: a bounded number, whatever the input.
SMALL = 50_000


def _united(pairs: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """For each pair, in order, the size of the set that it unites, and its own number; pairs within one set give none."""
    up: dict[int, int] = {}
    size: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for i, (a, b) in enumerate(pairs):
        a, b = root(a), root(b)
        if a != b:
            if size.get(a, 1) < size.get(b, 1):
                a, b = b, a
            up[b] = a
            size[a] = size.get(a, 1) + size.get(b, 1)
            yield i, size[a]


def _finished(cur: DataFrame) -> DataFrame:
    """The best links of a small graph ``(a, b, w)``, in one task: from the best down, those that unite two sets."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "x", "y"], ascending=False, kind="stable").reset_index(drop=True)
        keep = [i for i, _ in _united(zip(pdf["a"].tolist(), pdf["b"].tolist()))]
        return pdf.loc[keep, ["score", "x", "y"]]

    return cur.select(F.lit(1).alias("one"), "a", "b", "w.score", "w.x", "w.y").groupBy("one").applyInPandas(run, "score double, x long, y long").select(F.struct("score", "x", "y").alias("w"))


def spanning_forest(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(src, dst, score)``: the links of a maximum spanning forest of ``links`` (src, dst, score).

    Boruvka rounds over the link table until few links are left, which one task finishes: every component takes its best link to another one (greatest score, then least
    ends, so that there are no cycles), what is taken is contracted, and of parallel links the best stays. Each round at
    least halves the components that still have links. A component's best is formed before the shuffle and its name is
    joined skew-safe, so a hub is no hot task. Self-links and links with a null are left out; repeated links count once, with
    their greatest score; an empty table gives an empty one.
    """
    a, b = F.col("src"), F.col("dst")
    whole = links.where(a.isNotNull() & b.isNotNull() & F.col("score").isNotNull() & (a != b))
    # greatest of w is the best link: a total order of links
    w = F.struct(F.col("score"), (-F.least(a, b)).alias("x"), (-F.greatest(a, b)).alias("y")).alias("w")
    cur = materialise(whole.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), w).groupBy("a", "b").agg(F.max("w").alias("w")), "links")
    taken = None
    for _ in range(max_rounds):
        links_left = cur.count()
        if links_left <= SMALL:
            if links_left:
                now = materialise(_finished(cur), "last-links")
                taken = now if taken is None else taken.unionByName(now)
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        best = materialise(both.groupBy("a").agg(F.max(F.struct("w", "b")).alias("m"), F.count("*").alias("n")), "best-links")
        now = best.select("m.w").distinct()
        taken = now if taken is None else taken.unionByName(now)
        names = best.select(F.col("a").alias("node"), "n").join(_roots(best.select(F.col("a").alias("node"), F.col("m.b").alias("up"))), "node")
        names, total = materialise(names, "names"), 2 * links_left
        for end in ("a", "b"):
            cur = join_groups(cur, names.select(F.col("node").alias(end), F.col("up").alias(f"{end}_"), "n"), total, end, size="n").drop("n")
        u, v = F.col("a_"), F.col("b_")
        cur = materialise(cur.where(u != v).select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"), "w").groupBy("a", "b").agg(F.max("w").alias("w")), "links")
    else:
        raise RuntimeError("the spanning forest did not settle")
    if taken is None:
        return links.select("src", "dst", "score").limit(0)
    return taken.select((-F.col("w.x")).alias("src"), (-F.col("w.y")).alias("dst"), F.col("w.score").alias("score"))


def _roots(rows: DataFrame) -> DataFrame:
    """``(node, up)``: the root of each node's tree, where ``up`` leads from every node to another and of each tree just two
    lead to each other; the lesser of these is the root. Ways double with every round."""
    mutual = rows.select(F.col("node").alias("x"), F.col("up").alias("y")).where("x < y")
    root = rows.join(mutual, (F.col("node") == F.col("y")) & (F.col("up") == F.col("x"))).select(F.col("x").alias("node"), F.lit(True).alias("root"))
    cur = materialise(rows.join(root, "node", "left").select("node", F.when(F.col("root"), F.col("node")).otherwise(F.col("up")).alias("up")), "ways")
    total = cur.count()
    for _ in range(64):
        led = cur.groupBy("up").agg(F.count("*").alias("n"))  # many may lead to one
        beyond = materialise(cur.select(F.col("node").alias("up"), F.col("up").alias("far")).join(led, "up"), "beyond")
        if beyond.where("up <> far").isEmpty():
            return cur
        cur = materialise(join_groups(cur, beyond, total, "up", size="n").select("node", F.col("far").alias("up")), "ways")
    raise RuntimeError("ways did not settle")


def largest_components(forest: DataFrame, thresholds: list[float]) -> dict[float, int]:
    """The number of nodes of the largest component at each threshold, 1 where nothing is linked.

    One pass from the highest threshold down: each link of the forest is contracted at the first threshold that it
    reaches, and what is left only names components. A threshold so costs as much as the links that it adds."""
    left = materialise(forest.select(F.col("src").alias("a"), F.col("dst").alias("b"), "score"), "forest")
    sizes, out = None, {}
    if left.count() <= SMALL:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("score", ascending=False, kind="stable")
            most, at, rows = 1, 0, []
            score, grown = pdf["score"].to_numpy(), dict(_united(zip(pdf["a"].tolist(), pdf["b"].tolist())))
            for tau in sorted(thresholds, reverse=True):
                while at < len(score) and score[at] >= tau:
                    most, at = max(most, grown.get(at, 1)), at + 1
                rows.append((tau, most))
            return pd.DataFrame(rows, columns=["tau", "n"])

        found = {r["tau"]: r["n"] for r in left.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "tau double, n long").collect()}
        return {t: found.get(t, 1) for t in thresholds}
    for tau in sorted(thresholds, reverse=True):
        band = left.where(F.col("score") >= tau)
        if not band.isEmpty():
            moved = materialise(connected_components(band.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "contracted")
            known = moved if sizes is None else moved.join(sizes, F.col("node") == F.col("id"), "left")
            grown = known.groupBy(F.col("component").alias("id")).agg(F.sum(F.lit(1) if sizes is None else F.coalesce("size", F.lit(1))).alias("size"))
            sizes = materialise(grown if sizes is None else grown.unionByName(sizes.join(moved.select(F.col("node").alias("id")), "id", "left_anti")), "sizes")
            rest = left.where(F.col("score") < tau)
            for end in ("a", "b"):  # a component may have many links: they are joined by groups of counted size
                by = rest.groupBy(end).agg(F.count("*").alias("n")).join(moved.select(F.col("node").alias(end), F.col("component").alias("to")), end)
                rest = join_groups(rest, materialise(by, "names"), max(1, rest.count()), end, size="n", how="left").withColumn(end, F.coalesce("to", end)).drop("to", "n")
            left = materialise(rest, "forest")
        out[tau] = 1 if sizes is None else sizes.agg(F.max("size")).first()[0]
    return out
