"""Boosted regression trees for a binary label, with monotonic constraints, flattened into arrays of nodes.

Splits are sought in histograms of quantile bins. A constrained feature may only move a score one way: a split
against it is refused, and the values of what grows below either side are held apart by the middle between both, so
that the whole tree, and with it the sum of trees, is monotonic. A fitted model is five arrays over all nodes of all
trees; scoring moves every row down every tree one level at a time.

``fit`` takes arrays. ``fit_table`` fits the same trees to all rows of a table, of any number: rows lie as blocks of bins,
each level of a tree is one pass in which every block gives its histograms, and only these reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from curalith.storage import materialise

BINS = 64
#: Mean number of rows of a block, which is one task's work in a pass.
BLOCK = 1 << 15
#: Trees that a pass applies anew to each row before margins are written.
FRESH = 8
#: Gradients are summed as whole numbers of this unit: such sums are exact, so the order of blocks is no matter.
UNIT = 2.0**-24
#: Bits of a double that quantiles do not see: values are told apart by sign, exponent and ten more bits.
COARSE = 42


@dataclass
class NodeArrays:
    """``feature``, ``limit``, ``left``, ``right`` and ``value`` by node; a leaf leads to itself. ``roots`` by tree."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margins(self, x: np.ndarray, rows: int = 8192) -> np.ndarray:
        """Log odds of each row of features."""
        out = np.empty(len(x))
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            which = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[which, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            out[at : at + rows] = self.start + self.value[node].sum(1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -500, 500)))


def _held(g, h, low: float, high: float, penalty: float):
    return np.clip(g / (h + penalty), low, high)


def _best_split(hists: Iterable[tuple], all_g: float, all_h: float, rows: int, direction: np.ndarray, low: float, high: float, penalty: float, least: int) -> tuple | None:
    """Feature, bin and the values below either side of the best split, from ``(feature, gradients, curvatures, rows)`` by
    bin; None if no split is allowed or gains anything."""
    held = lambda a, b: _held(a, b, low, high, penalty)
    gain_of = lambda a, b: (lambda v: v * a - 0.5 * v * v * (b + penalty))(held(a, b))
    best = (1e-6, None)
    for f, *by_bin in hists:
        ag, ah, c = (np.cumsum(w)[:-1] for w in by_bin)
        bg, bh = all_g - ag, all_h - ah
        gain = gain_of(ag, ah) + gain_of(bg, bh) - gain_of(all_g, all_h)
        ok = (c >= least) & (rows - c >= least)
        if direction[f]:
            ok &= direction[f] * (held(bg, bh) - held(ag, ah)) >= 0
        gain = np.where(ok, gain, -np.inf)
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-12:
            best = (gain[k], (f, k, float(held(ag[k], ah[k])), float(held(bg[k], bh[k]))))
    return best[1]


def _spans(way: int, low: float, high: float, v: float, w: float) -> tuple:
    """What values may be left and right of a split whose sides have the values v and w."""
    mid = (v + w) / 2
    return {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[way]


def fit(x: np.ndarray, y: np.ndarray, direction: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, penalty: float = 1.0, least: int = 10) -> NodeArrays:
    """A model of log odds of ``y`` (0 or 1). ``direction`` by feature: 1 never falls, -1 never rises, 0 free.

    Without rows, or with one class only, the model is a constant."""
    nodes: list[list[float]] = []
    roots: list[int] = []
    good = float(y.sum())
    start = float(np.log((good + 0.5) / (len(y) - good + 0.5)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1) if x.shape[1] else np.zeros((len(x), 0), int)
    margin = np.full(len(y), start)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), rate * value])
        return len(nodes) - 1

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, left: int, add: np.ndarray) -> int:
        all_g, all_h = g[at].sum(), h[at].sum()

        def hists() -> Iterator[tuple]:
            for f in range(x.shape[1]) if left and len(at) >= 2 * least else ():
                if len(edges[f]):
                    yield f, *(np.bincount(binned[at, f], w, len(edges[f]) + 1) for w in (g[at], h[at], None))

        split = _best_split(hists(), all_g, all_h, len(at), direction, low, high, penalty, least)
        if split is None:
            value = float(_held(all_g, all_h, low, high, penalty))
            add[at] = rate * value
            return leaf(value)
        f, k, v, w = split
        me = leaf(0.0)
        spans = _spans(int(direction[f]), low, high, v, w)
        goes = binned[at, f] <= k
        a = grow(at[goes], g, h, *spans[0], left - 1, add)
        b = grow(at[~goes], g, h, *spans[1], left - 1, add)
        nodes[me] = [f, edges[f][k], a, b, 0.0]
        return me

    for _ in range(rounds if 0 < good < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        add = np.zeros(len(y))
        roots.append(grow(np.arange(len(y)), y - p, p * (1 - p), -np.inf, np.inf, depth, add))
        margin += add
    table = np.array(nodes).reshape(-1, 5)
    return NodeArrays(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4], np.array(roots, np.int64), depth, start)


def _coarse(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of values, equal for values that quantiles do not tell apart."""
    i = (np.ascontiguousarray(x) + 0.0).view(np.int64)
    return np.where(i < 0, -(i & np.int64(2**63 - 1)), i) >> COARSE


def _upper(key: np.ndarray) -> np.ndarray:
    """The greatest value with a key."""
    i = ((key + 1) << COARSE) - 1
    return np.where(i < 0, -i | np.int64(-(2**63)), i).view(np.float64)


def table_edges(table: DataFrame, width: int) -> list[np.ndarray]:
    """Limits between bins: BINS - 1 quantiles of each feature, over all rows of ``table`` (x: ``width`` doubles as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _coarse(np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(-1, width))
            for f in range(width):
                k, n = np.unique(keys[:, f], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), f, np.int32)), pa.array(k), pa.array(n)], ["f", "k", "n"])

    # as many rows as there are keys: some thousands for a feature, whatever the table
    got = np.array([tuple(r) for r in table.select("x").mapInArrow(run, "f int, k long, n long").groupBy("f", "k").agg(F.sum("n")).collect()], np.int64).reshape(-1, 3)
    out = []
    for f in range(width):
        mine = got[got[:, 0] == f]
        mine = mine[np.argsort(mine[:, 1])]
        upto = np.cumsum(mine[:, 2])
        at = np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS) if len(mine) else np.zeros(0, int)
        out.append(_upper(mine[np.unique(at), 1]))
    return out


@dataclass
class _Tree:
    """A tree over bins, grown by levels: rows of ``nodes`` are feature, last bin to the left, left, right."""

    nodes: np.ndarray
    value: np.ndarray

    def place(self, bins: np.ndarray, depth: int) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        which = np.arange(len(bins))
        for _ in range(depth):
            f, k, a, b = self.nodes[at].T
            at = np.where(bins[which, f] <= k, a, b)
        return at


def fit_table(table: DataFrame, direction: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, penalty: float = 1.0, least: int = 10, block: int = BLOCK) -> NodeArrays:
    """The model of ``fit`` of all rows of ``table`` (id, y: 0 or 1, x: doubles as bytes, one for each direction).

    Bins come from quantiles of values cut to a tenth of a percent. Each level of a tree is a pass over blocks of bins; a
    block gives the sums of each node, feature and bin. So the driver gets rows / ``block`` such histograms at once, and
    no task more than a block. Without rows, or with one class only, the model is a constant."""
    width = len(direction)
    n, good = table.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    start = float(np.log((good + 0.5) / (n - good + 0.5)))
    edges = table_edges(table, width) if 0 < good < n else []

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, y = [], []
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(-1, width)
            bins.append(np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1).astype(np.uint8))
            y.append(batch.column("y").to_numpy().astype(np.uint8))
        if y:
            rows = np.concatenate(y)
            yield pa.RecordBatch.from_arrays([pa.array([z], pa.binary()) for z in (np.concatenate(bins).tobytes(), rows.tobytes(), np.full(len(rows), start).tobytes())], ["bins", "y", "margin"])

    def opened(rows: Iterable[tuple], trees: list[_Tree]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for bins, y, margin in rows:
            bins, y, margin = np.frombuffer(bins, np.uint8).reshape(-1, width), np.frombuffer(y, np.uint8), np.frombuffer(margin).copy()
            for t in trees:
                margin += t.value[t.place(bins, depth)]
            yield bins, y, margin

    def histograms(cached: RDD, trees: list[_Tree], tree: _Tree, active: list[int]) -> np.ndarray:
        """Gradients, curvatures and rows by active node, feature and bin."""
        slot = np.full(len(tree.nodes), -1)
        slot[active] = np.arange(len(active))
        size = len(active) * width * BINS

        def run(rows: Iterator[tuple]) -> Iterator[bytes]:
            for bins, y, margin in opened(rows, trees):
                where = slot[tree.place(bins, depth)]
                some = where >= 0
                p = 1 / (1 + np.exp(-margin[some]))
                cell = (where[some, None] * width + np.arange(width)) * BINS + bins[some]
                sums = [np.bincount(cell.ravel(), w if w is None else np.repeat(np.rint(w / UNIT), width), size) for w in (y[some] - p, p * (1 - p), None)]
                yield np.stack(sums).astype(np.float64).tobytes()

        out = np.zeros(3 * size)
        for h in cached.mapPartitions(run).collect():
            out += np.frombuffer(h)
        out = out.reshape(3, len(active), width, BINS)
        out[:2] *= UNIT
        return out

    def applied(blocks: DataFrame, trees: list[_Tree]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in opened(zip(*(batch.column(c).to_pylist() for c in ("bins", "y", "margin"))), trees):
                    yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()) for z in block], ["bins", "y", "margin"])

        return materialise(blocks.mapInArrow(run, blocks.schema), "tree-margins")

    def grown(cached: RDD, trees: list[_Tree]) -> _Tree:
        nodes, value, active = [[0, BINS, 0, 0]], [0.0], {0: (-np.inf, np.inf)}
        for level in range(depth):
            if not active:
                break
            sums, below = histograms(cached, trees, _Tree(np.array(nodes), np.array(value)), list(active)), {}
            for (me, (low, high)), (g, h, c) in zip(active.items(), sums.swapaxes(0, 1)):
                all_g, all_h, rows = g[0].sum(), h[0].sum(), int(c[0].sum())
                some = [(f, *(z[f, : len(edges[f]) + 1] for z in (g, h, c))) for f in range(width) if len(edges[f])] if rows >= 2 * least else []
                split = _best_split(some, all_g, all_h, rows, direction, low, high, penalty, least)
                if split is None:
                    value[me] = rate * float(_held(all_g, all_h, low, high, penalty))
                    continue
                f, k, v, w = split
                to = len(nodes)
                nodes[me] = [f, k, to, to + 1]
                spans = _spans(int(direction[f]), low, high, v, w)
                ag, ah = g[f, : k + 1].sum(), h[f, : k + 1].sum()
                for i, (side, a, b) in enumerate(zip(spans, (ag, all_g - ag), (ah, all_h - ah))):
                    nodes.append([0, BINS, to + i, to + i])
                    value.append(rate * float(_held(a, b, *side, penalty)) if level + 1 == depth else 0.0)
                    below[to + i] = side
            active = below
        return _Tree(np.array(nodes), np.array(value))

    made: list[_Tree] = []
    if edges:
        blocks = materialise(table.repartition(-(-n // block)).select("y", "x").mapInArrow(packed, "bins binary, y binary, margin binary"), "tree-blocks")
        for _ in range(0, rounds, FRESH):
            # hundreds of short passes: blocks stay in the executors' memory between them
            cached, fresh = blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK), []
            for _ in range(min(FRESH, rounds - len(made))):
                fresh.append(grown(cached, fresh))
            made += fresh
            if len(made) < rounds:
                blocks = applied(blocks, fresh)
            cached.unpersist()
    roots = np.cumsum([0, *(len(t.nodes) for t in made)])[: len(made)].astype(np.int64)
    nodes = np.concatenate([t.nodes + [0, 0, r, r] for t, r in zip(made, roots)]) if made else np.zeros((0, 4), np.int64)
    limit = np.array([edges[f][k] if k < BINS else np.inf for f, k in nodes[:, :2]])
    return NodeArrays(nodes[:, 0], limit, nodes[:, 2], nodes[:, 3], np.concatenate([t.value for t in made]) if made else np.zeros(0), roots, depth, start)
