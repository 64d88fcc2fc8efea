"""Exact cosine search among unit vectors by a metric partition.

Angles between unit vectors obey the triangle inequality. Vectors belong to the nearest of some sampled pivots; a cell
knows its greatest angle to its pivot. A vector can have a partner within an angle in another cell only if that
cell's ball is near enough, and if the vector itself is near enough to the boundary between both pivots. Only such
vectors visit a cell, and within a cell only those meet whose angles to the pivot differ by no more. All bounds are
exact, so nothing is missed; how much they save depends on the data: much where near copies stand out from
the rest, nothing among random vectors of many dimensions. Where visits would spare less than three quarters of all pairs,
which is counted before any is written, vectors lie in large tiles instead: every two tiles meet in one task, so a
vector is sent as often as there are tiles, not as often as there are cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from curalith.storage import materialise

#: Mean number of vectors of a cell; so many of a cell meet in one task at most, on either side.
CELL = 4096
#: Pivots are broadcast, so their number is bounded.
PIVOTS = 2048
#: Mean number of vectors of a tile, at most; all pairs are cut into tiles where visits spare less than 1 - SAVES of them.
TILE = 1 << 15
SAVES = 0.25
#: So many products of a task are in memory at once, and so many links that a task thins to a forest.
AT_ONCE = 1 << 22
LINKS = 1 << 20
#: So many ids of equal vectors are sent with one of these, at most.
COPIES = 512
#: Slack of angles against rounding.
SLACK = 1e-6


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def packed(rows: DataFrame, key: str, vectors: list[str], centre: np.ndarray | None = None) -> DataFrame:
    """``(id, kind, v)``: unit vectors, less ``centre``, as bytes; ``kind`` counts the columns. Rows with a null, or a null
    in a vector, are left out; a vector of length zero stays so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = x.reshape(len(column), -1) if len(column) else x.reshape(0, 0)
            x = x - centre if centre is not None else x
            x = x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("kind"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "kind", "v"])

    whole = [F.col(c).cast("array<double>") for c in vectors]
    items = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.posexplode(F.array(*whole)).alias("kind", "v"))
    return items.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).mapInArrow(run, "id long, kind int, v binary")


def classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors under their least id, and ``(rep, id)`` of the ids that they stand for beside it. Ids of several
    vectors (kinds) are equal if all are."""
    whole = items.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "v"))), lambda x: x["v"]).alias("vs"))  # two at most
    reps = materialise(whole.groupBy("vs").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    star = whole.join(reps.where("n > 1"), "vs").where("id <> rep").select("rep", "id", "vs")
    return reps.select(F.col("rep").alias("id"), F.posexplode("vs").alias("kind", "v")), star


def gathered(items: DataFrame, most: int = COPIES) -> DataFrame:
    """Distinct vectors with ``ids``, in order, of the rows that hold them, ``most`` at most: others of that class follow with the
    same vectors. ``id`` is the least of these. The ids of a class are one row at first, of a size of the square root of its links."""
    whole = items.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("kind", "v"))).alias("vs"))  # two at most
    sets = materialise(whole.groupBy("vs").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vector-sets")
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(most))
    parts = sets.select("vs", F.explode(F.transform(starts, lambda i: F.slice("ids", i, most))).alias("ids"))
    return parts.select(F.get("ids", F.lit(0)).alias("id"), F.inline("vs"), "ids").select("id", "kind", "v", "ids")


def pivots(items: DataFrame, dims: int, cell: int = CELL) -> np.ndarray:
    """Vectors in the order of a hash of their ids, one for each ``cell`` of them, PIVOTS at most."""
    n = items.count()
    count = min(PIVOTS, max(1, n // cell))
    got = items.where("kind = 0").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(count).select("v").collect()
    return np.frombuffer(b"".join(bytes(r["v"]) for r in got)).reshape(-1, dims)


def _angles(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ p.T, -1, 1))


def assigned(items: DataFrame, p: np.ndarray) -> DataFrame:
    """``items`` with ``cell``, the nearest pivot, and ``angle``, that to it."""
    dims = p.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a = _angles(matrix(batch.column("v"), dims), p)
                cell = a.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(a[np.arange(len(a)), cell])], [*batch.schema.names, "cell", "angle"])

    fields = ", ".join(f"{c} {t}" for c, t in items.dtypes)
    return items.mapInArrow(run, f"{fields}, cell int, angle double")


def visits(items: DataFrame, p: np.ndarray, widest: dict[int, float], higher: bool, alpha: float | None = None) -> DataFrame:
    """``items`` once for each other cell that can hold a vector within ``alpha``, or within each item's own ``reach``, in
    ``cell``, with the ``angle`` to its pivot. With ``higher`` only cells of a higher number than an item's own."""
    reached = _reacher(p, widest, higher, alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j, angle = reached(batch)
            at = batch.schema.names.index("cell"), batch.schema.names.index("angle")
            out = batch.take(pa.array(i))
            columns = list(out.columns)
            columns[at[0]], columns[at[1]] = pa.array(j, pa.int32()), pa.array(angle)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return items.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in items.dtypes))


def _reacher(p: np.ndarray, widest: dict[int, float], higher: bool, alpha: float | None):
    """What ``visits`` decides of a batch: rows, cells and angles."""
    dims, count = p.shape[1], len(p)
    top = np.array([widest.get(i, -np.inf) for i in range(count)])  # empty cells are never visited
    gaps = np.array([np.sqrt(((p - q) ** 2).sum(1)) for q in p])  # by differences: products do not tell near pivots apart

    def reached(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, own = matrix(batch.column("v"), dims), batch.column("cell").to_numpy()
        dots = x @ p.T
        angle = np.arccos(np.clip(dots, -1, 1))
        reach = (np.full(len(x), alpha) if alpha is not None else batch.column("reach").to_numpy())[:, None] + SLACK
        gap = gaps[own]
        side = np.where(gap > 1e-9, (dots[np.arange(len(x)), own][:, None] - dots) / np.maximum(gap, 1e-9), 0)  # sine of the angle to the boundary
        ok = (angle - top <= reach) & (np.arcsin(np.clip(side, -1, 1)) <= reach)
        ok[np.arange(len(x)), own] = False
        if higher:
            ok &= np.arange(count) > own[:, None]
        i, j = np.nonzero(ok)
        return i, j, angle[i, j]

    return reached


def _pairs_of_visits(homes: DataFrame, p: np.ndarray, widest: dict[int, float], alpha: float) -> tuple[int, int]:
    """How many pairs would meet by visits, and how many there are; no visit is written."""
    reached = _reacher(p, widest, True, alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = np.bincount(reached(batch)[1], minlength=len(p))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n, pa.int64())], ["cell", "g"])

    guests = {r["cell"]: r["n"] for r in homes.mapInArrow(run, "cell int, g long").groupBy("cell").agg(F.sum("g").alias("n")).collect()}
    own = {r["cell"]: r["count"] for r in homes.groupBy("cell").count().collect()}  # a row for each pivot, both
    n = sum(own.values())
    return sum(r * guests.get(c, 0) + r * (r - 1) // 2 for c, r in own.items()), n * (n - 1) // 2


def spanning(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the links of a maximum spanning forest: every component takes its best link until none is left."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = np.argsort(-score, kind="stable")
    u, v, count = ends[: len(a)][at], ends[len(a) :][at], len(names)
    taken = [np.zeros(0, np.int64)]
    while True:
        apart = u != v
        u, v, at = u[apart], v[apart], at[apart]
        if not len(u):
            return np.concatenate(taken)
        best, every = np.full(count, len(u)), np.arange(count)
        np.minimum.at(best, u, np.arange(len(u)))
        np.minimum.at(best, v, np.arange(len(u)))
        has = np.flatnonzero(best < len(u))
        taken.append(at[np.unique(best[has])])
        up = every.copy()
        up[has] = u[best[has]] + v[best[has]] - has
        root = (up[up] == every) & (every <= up)  # two lead to each other: the lesser is the root
        up[root] = every[root]
        while (up[up] != up).any():
            up = up[up]
        names, up = np.unique(up, return_inverse=True)
        u, v, count = up[u], up[v], len(names)


def _members(ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of lists on end, where each list starts, and how many it holds; none is empty."""
    column = ids.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    count = column.value_lengths().to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), np.cumsum(count) - count, count


def _links(x: np.ndarray, y: np.ndarray, s: np.ndarray, kind: np.ndarray, members: tuple, both: bool) -> Iterator[list[np.ndarray]]:
    """``src``, ``dst`` and score of all ids that the vectors at ``x`` and ``y`` stand for, src < dst, once a pair: the earlier id's
    vector is of kind 0. Ids of two vectors may lie between each other, so that each vector is the earlier one's in some
    pairs, by other scores if there are mirrors. With ``both`` those at ``y`` may be earlier, too."""
    flat, at, count = members
    first, last = flat[at], flat[at + count - 1]
    go = (kind[x] == 0) & (first[x] < last[y])
    back = (kind[y] == 0) & (first[y] < last[x]) & both
    src, dst, s = np.concatenate([x[go], y[back]]), np.concatenate([y[go], x[back]]), np.concatenate([s[go], s[back]])
    order = np.lexsort((-s, first[dst], first[src]))
    src, dst, s = src[order], dst[order], s[order]
    a, b = first[src], first[dst]
    best = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(src) else np.zeros(0, bool)
    src, dst, s = src[best], dst[best], s[best]
    n = count[src] * count[dst]
    if (n == 1).all():
        yield [first[src], first[dst], s]
        return
    ends = np.cumsum(n)
    for part in np.split(np.arange(len(n)), np.unique(np.searchsorted(ends, np.arange(LINKS, ends[-1], LINKS)))):
        r = np.repeat(part, n[part])
        k = np.arange(len(r)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        a, b = flat[at[src[r]] + k // count[dst[r]]], flat[at[dst[r]] + k % count[dst[r]]]
        ok = a < b
        yield [a[ok], b[ok], s[r][ok]]


def _batches(links: Iterator[list[np.ndarray]], forest: bool) -> Iterator[pa.RecordBatch]:
    """Links in batches of about LINKS; with ``forest`` all of a task, thinned whenever there are more."""
    held: list[list[np.ndarray]] = []
    for some in links:
        held.append(some)
        if sum(len(c[0]) for c in held) > LINKS:
            got = [np.concatenate(c) for c in zip(*held)]
            if forest:
                held = [[c[keep] for c in got] for keep in [spanning(*got)]]
            else:
                held = []
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["src", "dst", "score"])
    if held:
        got = [np.concatenate(c) for c in zip(*held)]
        if forest:
            keep = spanning(*got)
            got = [c[keep] for c in got]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["src", "dst", "score"])


def _widest(items: DataFrame) -> dict[int, float]:
    return {r["cell"]: r["a"] for r in items.groupBy("cell").agg(F.max("angle").alias("a")).collect()}  # a row for each pivot


def _tasks(residents: DataFrame, visitors: DataFrame, own_pairs: bool, block: int, log: list[dict] | None) -> DataFrame:
    """Both sides with ``guest`` and the task (cell, lo, hi) in which blocks of a cell meet: residents among each other, if
    they do, and guests with residents."""
    sized = residents.groupBy("cell").agg(F.count("*").alias("r")).join(visitors.groupBy("cell").agg(F.count("*").alias("g")), "cell", "left").select("cell", "r", F.coalesce("g", F.lit(0)).alias("g"))
    sized = materialise(sized, "cell-sizes")
    if log is not None:
        pairs = F.col("r") * F.col("g") + (F.col("r") * (F.col("r") - 1) / 2 if own_pairs else 0)
        log.append({"met": int(sized.agg(F.coalesce(F.sum(pairs), F.lit(0))).first()[0]), "visits": visitors.count()})
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    sized = F.broadcast(sized.select("cell", parts("r").alias("k"), F.when(F.col("g") > 0, parts("g")).otherwise(0).alias("w")))  # a row for each pivot
    h = F.xxhash64("id", "kind")
    a = residents.join(sized, "cell").withColumn("b", F.pmod(h, F.col("k")).cast("int"))
    first, last = F.when(F.lit(own_pairs), F.lit(0)).otherwise(F.col("k")), F.col("k") + F.col("w") - 1
    a = a.where(first <= last).withColumn("o", F.explode(F.sequence(first, last)))
    b = visitors.join(sized, "cell").withColumn("b", (F.col("k") + F.pmod(h, F.greatest("w", F.lit(1)))).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    out = [x.select("cell", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), F.col("b").alias("own"), F.lit(guest).alias("guest"), "id", "kind", "angle", "v", *(["ids"] if "ids" in x.columns else [])) for x, guest in ((a, False), (b, True))]
    return out[0].unionByName(out[1])


def pairs_within(items: DataFrame, dims: int, least: float, cell: int = CELL, block: int = CELL, log: list[dict] | None = None, forest: bool = False) -> DataFrame:
    """``(src, dst, score)``, src < dst: pairs of ids whose cosine is at least ``least``, by all vectors of distinct
    classes: a later row's vector of kind 1 counts with an earlier row's of kind 0. Where vectors come with ``ids`` (see
    ``gathered``) the pairs are of all these. Each pair meets once: in its own cell, or where the one of the lower cell visits
    the other's. With ``forest`` each task keeps only a maximum spanning forest of its links, which connects at every threshold
    what all of them do."""
    alpha = math.acos(max(-1.0, min(1.0, least)))
    if least > 0:  # others have a cosine of 0 with all
        items = items.where(F.col("v") != F.lit(bytes(8 * dims)))
    items = materialise(items if "ids" in items.columns else items.withColumn("ids", F.array("id")), "vectors")
    p = pivots(items, dims, cell)
    if not len(p):
        return items.sparkSession.createDataFrame([], "src long, dst long, score double")
    homes = materialise(assigned(items, p), "cells")
    widest = _widest(homes)
    met, whole = _pairs_of_visits(homes, p, widest, alpha)
    if met > SAVES * whole:
        return _tiled(items, dims, least, block, log, forest)
    guests = materialise(visits(homes, p, widest, True, alpha), "visits")
    dealt = _tasks(homes, guests, True, block, log)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        v, members = matrix(t.column("v"), dims), _members(t.column("ids"))
        lo, hi, own, angle, kind = (t.column(c).to_numpy() for c in ("lo", "hi", "own", "angle", "kind"))
        same = bool(lo[0] == hi[0])  # both ways are met there
        left = np.flatnonzero(own == lo[0])
        right = left if same else np.flatnonzero(own == hi[0])
        left, right = left[np.argsort(angle[left])], right[np.argsort(angle[right])]

        def found() -> Iterator[list[np.ndarray]]:
            for at in range(0, len(left), 512):
                i = left[at : at + 512]
                a, b = np.searchsorted(angle[right], [angle[i[0]] - alpha - SLACK, angle[i[-1]] + alpha + SLACK])
                j = right[a:b]
                s = v[i] @ v[j].T
                x, y = np.nonzero(s >= least)
                yield from _links(i[x], j[y], s[x, y], kind, members, not same)

        yield from _batches(found(), forest)

    met = dealt.groupBy("cell", "lo", "hi").applyInArrow(judge, "src long, dst long, score double")
    return met.groupBy("src", "dst").agg(F.max("score").alias("score"))


def _tiled(items: DataFrame, dims: int, least: float, block: int, log: list[dict] | None, forest: bool) -> DataFrame:
    """``pairs_within`` by tiles of ids, of which every two meet in one task. All kinds of an id lie in one tile, so a pair's
    greatest score is known in its task and no pair is shuffled."""
    n = items.count()
    k = -(-n // max(block, min(TILE, -(-n // 6))))
    if log is not None:
        log.append({"met": n * (n - 1) // 2, "visits": n * (k - 1)})
    rows = items.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    dealt = rows.select(F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), F.col("b").alias("own"), "id", "kind", "v", "ids")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        v, (lo, hi, own, ids, kind) = matrix(t.column("v"), dims), (t.column(c).to_numpy() for c in ("lo", "hi", "own", "id", "kind"))
        members = _members(t.column("ids"))
        same = bool(lo[0] == hi[0])
        left = np.flatnonzero(own == lo[0])
        right = left if same else np.flatnonzero(own == hi[0])
        left = left[np.argsort(ids[left], kind="stable")]
        if not len(left) or not len(right):
            return
        mine, theirs = ids[left], v[right].T
        cuts = np.arange(0, len(left), max(1, AT_ONCE // len(right)))[1:]
        cuts = cuts + (mine[cuts] == mine[cuts - 1])  # kinds of an id, two at most, stay together

        def found() -> Iterator[list[np.ndarray]]:
            for i in np.split(left, np.unique(cuts)):
                s = v[i] @ theirs
                x, y = np.nonzero(s >= least)
                yield from _links(i[x], right[y], s[x, y], kind, members, not same)

        yield from _batches(found(), forest)

    return dealt.groupBy("lo", "hi").applyInArrow(judge, "src long, dst long, score double")


def nearest_of(queries: DataFrame, reference: DataFrame, dims: int, cell: int = CELL, block: int = CELL, log: list[dict] | None = None) -> DataFrame:
    """``(query, reference, score)``: the reference id of greatest cosine, over all kinds, for each query id; the least id
    of equals. A query first meets the cell of its nearest pivot; what it finds there is how far it has to reach, and
    only cells within that reach are visited."""
    spark = queries.sparkSession
    schema = "query long, reference long, score double"
    # equal vectors under their least id: which of them is nearest is no matter of rounding
    reference = materialise(reference.groupBy("v").agg(F.min(F.struct("id", "kind")).alias("m")).select("m.id", "m.kind", "v"), "references")
    p = pivots(reference.withColumn("kind", F.lit(0)), dims, cell)
    if not len(p):
        return spark.createDataFrame([], schema)
    homes = materialise(assigned(reference, p), "cells")
    widest = _widest(homes)
    some = np.array(sorted(widest))  # a pivot that others stand before may have no cell
    asking = assigned(queries, p[some])
    asking = materialise(asking.withColumn("cell", F.get(F.array(*[F.lit(int(x)) for x in some]), F.col("cell")) if len(some) < len(p) else F.col("cell")), "queries")

    def met(guests: DataFrame) -> DataFrame:
        def judge(key: tuple, t: pa.Table) -> pa.Table:
            guest = t.column("guest").to_numpy(zero_copy_only=False).astype(bool)
            v, ids = matrix(t.column("v"), dims), t.column("id").to_numpy()
            q, r = np.flatnonzero(guest), np.flatnonzero(~guest)
            who, score = np.zeros(len(q), np.int64), np.zeros(len(q))
            for at in range(0, len(q) if len(r) else 0, 512):
                s = v[q[at : at + 512]] @ v[r].T
                best = s.max(1)
                tied = np.where(s == best[:, None], ids[r][None, :], np.iinfo(np.int64).max)
                who[at : at + 512], score[at : at + 512] = tied.min(1), best
            n = len(q) if len(r) else 0
            return pa.table({"query": ids[q[:n]], "reference": who[:n], "score": score[:n]})

        return _tasks(homes, guests, False, block, log).groupBy("cell", "lo", "hi").applyInArrow(judge, schema)

    top = lambda df: df.groupBy("query").agg(F.max(F.struct("score", (-F.col("reference")).alias("r"))).alias("m"))
    first = materialise(top(met(asking)), "first-cell")
    known = asking.join(first.select(F.col("query").alias("id"), F.acos(F.least(F.greatest(F.col("m.score"), F.lit(-1.0)), F.lit(1.0))).alias("reach")), "id").select("id", "kind", "v", "cell", "angle", "reach")
    more = materialise(visits(known, p, widest, False).drop("reach"), "visits")
    second = top(met(more))
    return top(first.select("query", (-F.col("m.r")).alias("reference"), F.col("m.score").alias("score")).unionByName(second.select("query", (-F.col("m.r")).alias("reference"), F.col("m.score").alias("score")))).select("query", (-F.col("m.r")).alias("reference"), F.col("m.score").alias("score"))
