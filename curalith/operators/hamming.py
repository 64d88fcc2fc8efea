"""Exact search among codes of equal length, at any radius, by multi-index tables.

Codes fall into blocks of bits. If two codes differ in fewer than ``m * (t + 1)`` bits, some of their ``m`` blocks differ
in at most ``t``: so a table for each block, probed with all keys up to ``t`` bits from the query's, misses none of them.
Blocks are about as wide as the number of codes has binary digits, so that a key has about one code.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from curalith.storage import materialise

#: Codes and queries that meet in one task where queries are held against all codes.
CODE_BLOCK, QUERY_BLOCK = 1 << 19, 1 << 14
#: A probed key costs a task about as much as so many codes that are scanned.
PROBE = 40
#: In joined rounds a query asks no more keys than one in so many codes; beyond, it is held against all.
ROUND = 6


def spans(bits: int, count: int) -> list[tuple[int, int]]:
    """Bit ranges (from, to) of the blocks, as even as can be."""
    edges = [round(i * bits / count) for i in range(count + 1)]
    return list(zip(edges, edges[1:]))


def block_count(bits: int, codes: int, widest: int = 22) -> int:
    """Blocks for so many codes: a block's keys are about as many as the codes."""
    width = min(max(int(math.log2(max(codes, 2))), 8), widest, bits)
    return max(1, math.ceil(bits / width))


@lru_cache(64)
def masks(width: int, ones: int) -> np.ndarray:
    """All numbers of ``width`` bits of which ``ones`` are set."""
    return np.array([sum(1 << b for b in some) for some in combinations(range(width), ones)], np.int64)


class Tables:
    """Codes in the memory of one task: ``codes`` has a row of 64-bit words for each, the lowest bits first."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        self.words = [np.ascontiguousarray(codes[:, i]) for i in range(codes.shape[1])]
        self.spans = spans(bits, block_count(bits, len(codes)))
        self.compared = 0  # pairs whose distance was computed
        self.order, self.start = [], []

    def _build(self) -> None:
        for a, b in self.spans:
            key = self.keys(self.codes, a, b)
            self.order.append(np.argsort(key, kind="stable").astype(np.int32))
            self.start.append(np.append(0, np.cumsum(np.bincount(key, minlength=1 << b - a))).astype(np.int32))

    @staticmethod
    def keys(codes: np.ndarray, a: int, b: int) -> np.ndarray:
        """Bits a to b of each code."""
        out, at = np.zeros(len(codes), np.uint64), a
        while at < b:
            word, low = divmod(at, 64)
            n = min(b - at, 64 - low)
            out |= (codes[:, word] >> np.uint64(low) & np.uint64((1 << n) - 1)) << np.uint64(at - a)
            at += n
        return out.astype(np.int64)

    def weights(self, radius: int) -> list[int]:
        """For each block the most differing bits that must be probed, -1 for none: with ``m`` blocks and a radius of
        ``m * t + r``, the first r + 1 blocks up to t and the others up to t - 1 miss nothing."""
        t, r = divmod(radius, len(self.spans))
        return [t if i <= r else t - 1 for i in range(len(self.spans))]

    def probes(self, radius: int) -> int:
        return sum(math.comb(b - a, w) for (a, b), most in zip(self.spans, self.weights(radius)) for w in range(most + 1))

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(query, rows, distances)`` of all codes within the radius, for each query that has any. Few codes are scanned."""
        scan = self.probes(radius) * PROBE > len(self.codes)
        if not scan and not self.start:
            self._build()
        most = self.weights(radius)
        todo = [] if scan else [(i, np.concatenate([masks(b - a, w) for w in range(most[i] + 1)])) for i, (a, b) in enumerate(self.spans) if most[i] >= 0]
        keys = [] if scan else [self.keys(queries, a, b) for a, b in self.spans]
        for q in range(len(queries)):
            if scan:
                rows, d = None, self._distance(queries[q])
            else:
                met = []
                for i, mask in todo:
                    k = mask ^ keys[i][q]
                    low = self.start[i][k]
                    n = self.start[i][k + 1] - low
                    some = np.flatnonzero(n)
                    if len(some):
                        low, n = low[some], n[some]
                        met.append(self.order[i][np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())])
                if not met:
                    continue
                rows = np.concatenate(met)
                d = self._distance(queries[q], rows)
            hit = np.flatnonzero(d <= radius)
            if len(hit):
                found, first = np.unique(hit if rows is None else rows[hit], return_index=True)
                yield q, found, d[hit][first]

    def _distance(self, query: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        out = 0
        for own, q in zip(self.words, query):
            out = out + np.bitwise_count((own if rows is None else own[rows]) ^ q).astype(np.int16, copy=False)
        self.compared += len(out)
        return out.astype(np.int32)


def dealt(queries: DataFrame, codes: DataFrame, n_queries: int, n_codes: int, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``qb`` and ``pb``, so that every block of queries meets every block of codes once."""
    down = max(1, -(-n_codes // CODE_BLOCK))
    across = max(1, -(-n_queries // QUERY_BLOCK), -(-16 // down))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    return queries.withColumn("qb", own(across)).withColumn("pb", every(down)), codes.withColumn("pb", own(down)).withColumn("qb", every(across))


def _held_against_all(queries: DataFrame, reference: DataFrame, n_queries: int, n_codes: int) -> DataFrame:
    """``(code, d)``: the least distance of each query to any code of a block, for all blocks."""
    left, right = dealt(queries.select("code"), reference.select("code"), n_queries, n_codes, ["code"])

    def judge(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (s["code"].to_numpy().view(np.uint64) for s in (a, b))
        if not len(x) or not len(y):
            return pd.DataFrame({"code": np.zeros(0, np.int64), "d": np.zeros(0, np.int32)})
        best = np.full(len(x), 64, np.int32)
        for j in range(0, len(y), 4096):
            for i in range(0, len(x), 64):
                best[i : i + 64] = np.minimum(best[i : i + 64], np.bitwise_count(x[i : i + 64, None] ^ y[None, j : j + 4096]).min(1))
        return pd.DataFrame({"code": x.view(np.int64), "d": best})

    return left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInPandas(judge, "code long, d int")


def _block_keys(code: Column, bits: int, count: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << b - a) - 1)).alias("key")) for i, (a, b) in enumerate(spans(bits, count))])


def nearest_distance(queries: DataFrame, reference: DataFrame, bits: int = 64, log: list[dict] | None = None) -> DataFrame:
    """``(code, nearest)`` for each distinct ``code`` of ``queries``: the least distance to any ``code`` of ``reference``,
    however large; null where there is no reference. Codes have at most 64 bits, in a long.

    ``queries`` may have a column ``bound``, a distance known already: the answer is then the lesser of both. Round t
    probes each block's table with all keys that differ in t bits; a query whose best is at most what the next
    round could find at best is settled and asks no more. Where a round would cost more than it saves, the queries left
    are held against all codes by blocks. Null codes ask and answer nothing. ``log`` receives each round's figures.
    """
    bound = F.col("bound").cast("int") if "bound" in queries.columns else F.lit(None).cast("int")
    open_ = materialise(queries.where("code is not null").groupBy("code").agg(F.max(bound).alias("best")), "open")
    ref = materialise(reference.select("code").where("code is not null").distinct(), "codes")
    n = ref.count()
    if not n:
        return open_.select("code", F.col("best").alias("nearest"))
    count = block_count(bits, n)
    keyed = materialise(ref.select("code", F.explode(_block_keys(F.col("code"), bits, count)).alias("x")).select(F.col("x.block").alias("block"), F.col("x.key").alias("key"), F.col("code").alias("other")), "code-tables")
    spark, settled, t = queries.sparkSession, None, 0
    while True:
        asking = open_.count()
        widths = [b - a for a, b in spans(bits, count)]
        probes = sum(math.comb(w, t) for w in widths)
        if not asking or t > max(widths):
            break
        if probes * ROUND > n and t:
            found = _held_against_all(open_, ref, asking, n).groupBy("code").agg(F.min("d").alias("d"))
            open_ = materialise(open_.join(found, "code", "left").select("code", F.least("best", "d").alias("best")), "settled")
            if log is not None:
                log.append({"round": "all", "asking": asking, "met": asking * n})
            break
        mask = F.broadcast(spark.createDataFrame([(i, m) for i, w in enumerate(widths) for m in masks(w, t).tolist()], "block int, mask long"))  # no more than n / ROUND rows, or one a block
        asked = open_.select("code", F.explode(_block_keys(F.col("code"), bits, count)).alias("x")).select("code", F.col("x.block").alias("block"), F.col("x.key").alias("own"))
        asked = asked.join(mask, "block").select("code", "block", F.col("own").bitwiseXOR(F.col("mask")).alias("key"))
        met = asked.join(keyed.hint("merge"), ["block", "key"]).groupBy("code").agg(F.min(F.bit_count(F.col("code").bitwiseXOR(F.col("other")))).cast("int").alias("d"), F.count("*").alias("met"))
        now = materialise(open_.join(met, "code", "left").select("code", F.least("best", "d").alias("best"), F.coalesce("met", F.lit(0)).alias("met")), "round")
        if log is not None:
            log.append({"round": t, "asking": asking, "met": now.agg(F.sum("met")).first()[0]})
        t += 1
        sure = F.coalesce(F.col("best") <= count * t, F.lit(False))  # later rounds find distances of count * t at least
        done = now.where(sure).select("code", "best")
        settled = done if settled is None else settled.unionByName(done)
        open_ = now.where(~sure).select("code", "best")
    out = open_ if settled is None else settled.unionByName(open_)
    return out.select("code", F.col("best").alias("nearest"))
