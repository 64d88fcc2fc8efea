"""Document fingerprints: SimHash over weighted word shingles, and exact search within a Hamming radius.

A document's terms are its distinct runs of five words; a term weighs 1 + ln(count). Each term's 128-bit hash
votes, with its weight, for or against each bit; a text without words has the fingerprint 0. Fingerprints are
strings of 32 hex digits. A null text counts as empty.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from curalith.operators import hamming
from curalith.storage import materialise

from . import _bytes as B

SHINGLE = 5
BITS = 128
#: Jaccard similarity of shingles from which texts are near copies.
SIMILARITY = 0.8


def radius_for(similarity: float, deviations: float = 2.0) -> int:
    """Bits by which fingerprints of two equally large sets of that Jaccard similarity differ, and some deviations
    more: sets of Jaccard j have the cosine 2j / (1 + j), and each bit differs with probability angle / pi."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(BITS * p + deviations * math.sqrt(BITS * p * (1 - p)))


RADIUS = radius_for(SIMILARITY)
#: Below this radius tables of whole blocks are joined; beyond, where blocks differ too, tables are probed with near keys.
TABLES = 8


def _votes(h: np.ndarray, w: np.ndarray) -> str:
    if not len(h):
        return "0" * 32
    out = b""
    for salt in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165):
        bits = np.unpackbits(B.mix(h ^ np.uint64(salt)).view(np.uint8).reshape(-1, 8), axis=1)
        out += np.packbits(2 * (w @ bits) > w.sum()).tobytes()
    return out.hex()


def fingerprint_of(words: np.ndarray, k: int = SHINGLE) -> str:
    """Fingerprint of a text given the hashes of its words."""
    h, n = np.unique(B.shingles(words, k), return_counts=True)
    # whole numbers, so that sums are exact in any order and equal texts vote alike
    return _votes(h, np.round(64 * (1 + np.log(n))).astype(np.float32 if len(h) <= 4096 else np.float64))


def fingerprints(texts: list[str], k: int = SHINGLE) -> list[str]:
    return [fingerprint_of(w, k) for w in B.hashed_words(pa.array(texts, pa.string()))]


def likeness(a: Column, b: Column) -> Column:
    """1 - Hamming distance / 128 of two fingerprints."""
    part = lambda c, i: F.conv(F.substring(c, i, 16), 16, -10).cast("long")
    return 1 - (F.bit_count(part(a, 1).bitwiseXOR(part(b, 1))) + F.bit_count(part(a, 17).bitwiseXOR(part(b, 17)))) / F.lit(128.0)


def add_fingerprints(docs: DataFrame, text: str = "text", to: str = "fingerprint", k: int = SHINGLE) -> DataFrame:
    """``docs`` with a column of fingerprints; other columns stay, one of that name is replaced. A null or empty text has the
    fingerprint 0; rows that repeat have equal ones; an empty table gives an empty one."""
    docs = docs.drop(to) if to != text else docs
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            filled = batch.set_column(at, text, batch.column(at).fill_null(""))
            done = 0
            for part in B.slices(filled, text):
                prints = [fingerprint_of(w, k) for w in B.hashed_words(part.column(text))]
                yield pa.RecordBatch.from_arrays([*batch.slice(done, part.num_rows).columns, pa.array(prints, pa.string())], [*batch.schema.names, to])
                done += part.num_rows

    return docs.mapInArrow(B.tidy(run), schema)


def _ranges(rows: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """Bounds of at most ``parts`` ranges of ``(k, h, r)``, from a sample of places; a few for each range, whatever the
    input. They only deal rows, so a bad sample costs balance and nothing else."""
    total = rows.count()
    some = rows.select("k", "h", "r") if total <= 50 * parts else rows.sample(False, min(1.0, 50 * parts / total), 7).select("k", "h", "r")
    keys = sorted(tuple(x) for x in some.collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is the beginning of the next document:
    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint, h)``, one row for each row.

    The next document is the one with the next smaller id (after the last, the first; a null id counts as the smallest;
    ties by a hash of the text, which is ``h``; of rows equal in both each is followed by its like and the last by another). A null text is empty; an empty table gives an empty one; other
    columns are not read. Rows are dealt once, by ranges of this order, of which one id or one text may fill several;
    the first row of each range also goes to the range before, so that no range waits for another and none is gathered
    whole.
    """
    spark = docs.sparkSession
    # the place only spreads rows that are equal in all else over ranges
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("r")).withColumn("h", F.xxhash64("t"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _ranges(rows, parts)
    top = np.array([x[0] for x in bounds], np.int64)

    def ranges_of(ks: pd.Series, hs: pd.Series, rs: pd.Series) -> np.ndarray:
        """Range 0 holds the last in the order of numbers, which come first."""
        ks = ks.to_numpy()
        low, high = np.searchsorted(top, ks, "left"), np.searchsorted(top, ks, "right")
        out = len(bounds) - low
        for i in np.flatnonzero(low < high).tolist():
            out[i] = len(bounds) - bisect.bisect_right(bounds, (int(ks[i]), int(hs.iat[i]), int(rs.iat[i])), int(low[i]), int(high[i]))
        return out.astype(np.int32)

    place = F.pandas_udf(lambda ks, hs, rs: pd.Series(ranges_of(ks, hs, rs)), "int", F.PandasUDFType.SCALAR)
    # two rows for each range: its first and its last one
    ends = rows.select(place("k", "h", "r").alias("p"), F.struct("k", "h").alias("x")).groupBy("p").agg(F.max("x").alias("first"), F.min("x").alias("last")).orderBy("p").collect() if bounds else []
    follows = {x["p"]: ends[(i + 1) % len(ends)] for i, x in enumerate(ends)} if len(ends) > 1 else {}
    # a range that ends within a run of equal rows needs no row of the next one: its last row's next is its like
    like = {x["p"] for x in ends if x["p"] in follows and x["last"] == follows[x["p"]]["first"]}
    lent = {tuple(x["first"]): p for p, x in follows.items() if p not in like}
    heads = np.array(sorted({x[0] for x in lent}), np.int64)

    def also_of(ks: pd.Series, hs: pd.Series) -> pd.Series:
        out = np.full(len(ks), -1, np.int32)
        for i in np.flatnonzero(np.isin(ks.to_numpy(), heads)).tolist():
            out[i] = lent.get((int(ks.iat[i]), int(hs.iat[i])), -1)
        return pd.Series(out)

    also = F.pandas_udf(lambda ks, hs: also_of(ks, hs), "int", F.PandasUDFType.SCALAR)
    dealt = rows.withColumn("p", place("k", "h", "r") if bounds else F.lit(0)).withColumn("also", also("k", "h") if lent else F.lit(-1))
    dealt = dealt.select("k", "t", "h", F.explode(F.array(F.struct(F.col("p"), F.lit(False).alias("borrowed")), F.struct(F.col("also").alias("p"), F.lit(True).alias("borrowed")))).alias("x")).where("x.p >= 0")
    dealt = dealt.select("k", "t", "h", "x.p", "x.borrowed").repartition(parts, "p").sortWithinPartitions("p", "borrowed", F.desc("k"), F.desc("h"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, h long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def edited(t: str, nxt: str) -> str:
            cut = min(len(t) // 3, len(nxt))
            return t[: len(t) - len(t) // 3] + nxt[:cut]

        def made(todo: list[tuple[int, int, str, str]]) -> pa.RecordBatch:
            texts = [edited(t, nxt) for _, _, t, nxt in todo]
            plain = fingerprints([t for _, _, t, _ in todo] + [todo[-1][3]], k)
            columns = [[i if i > -(2**63) else None for i, *_ in todo], [len(t) for _, _, t, _ in todo], [hashlib.sha256(t.encode()).hexdigest() for t in texts], plain[:-1], fingerprints(texts, k), plain[1:], [h for _, h, *_ in todo]]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "h"])

        def ended(last: tuple, first: str) -> tuple[int, int, str, str]:
            # without a borrowed row the range ends within equal rows, or is the only one: its last row is followed by its first
            return *last[:3], last[2] if last[3] in like else first

        todo: list[tuple[int, int, str, str]] = []
        last, first, size = None, None, 0
        for batch in batches:
            for i, t, h, p, borrowed in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "h", "p", "borrowed"))):
                if last is not None and last[3] != p:
                    todo.append(ended(last, first))
                    yield made(todo)
                    todo, last, size = [], None, 0
                if last is not None:
                    todo.append((*last[:3], t))
                    size += len(t)
                elif borrowed:  # copies of a borrowed row; one has been used
                    continue
                first = t if last is None else first
                last = None if borrowed else (i, h, t, p)
                if todo and (size > 1 << 20 or last is None):
                    yield made(todo)
                    todo, size = [], 0
        if last is not None:
            todo.append(ended(last, first))
        if todo:
            yield made(todo)

    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string()), ("h", pa.int64())])
    return dealt.mapInArrow(B.tidy(run), schema)


def _blocks(fingerprint: Column, n: int) -> list[Column]:
    width = 32 // n
    return [F.substring(fingerprint, 1 + i * width, width) for i in range(n)]


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``(query, fingerprint, distance)`` of different fingerprints at most ``radius`` bits apart; none is missed.

    From TABLES on the tables are probed within tasks, see ``_by_blocks``. Below they are joined: 128 bits fall into ``n`` blocks; two prints within the radius agree in ``n - radius``
    of them at least, so each choice of that many blocks is a table keyed by these blocks' bits, and the prints
    that share a key are compared. Both inputs have a column ``fingerprint`` and are made distinct first, so
    that copies cost nothing. Nulls are left out.
    """
    if radius >= TABLES:
        distinct = prints.select("fingerprint").where("fingerprint is not null").distinct()
        return _by_blocks(distinct, queries, radius, "query string, fingerprint string, distance int")
    n = next(x for x in (4, 8) if x > radius)
    keep = n - radius
    keys = F.array(*[F.concat(F.lit(f"{i}:"), *[b for j, b in enumerate(_blocks(F.col("fingerprint"), n)) if j in c]) for i, c in enumerate(combinations(range(n), keep))])
    table = lambda df: df.select("fingerprint").where("fingerprint is not null").distinct().select("fingerprint", F.explode(keys).alias("key"))
    pairs = table(queries).withColumnRenamed("fingerprint", "query").join(table(prints), "key").where("query <> fingerprint")
    distance = F.round((1 - likeness(F.col("query"), F.col("fingerprint"))) * 128).cast("int")
    return pairs.withColumn("distance", distance).where(F.col("distance") <= radius).select("query", "fingerprint", "distance").distinct()


def _by_blocks(prints: DataFrame, queries: DataFrame, radius: int, schema: str) -> DataFrame:
    """Every query against the distinct ``prints``, at any radius: each task has block tables of a part of the prints and
    probes them with all keys near enough to a query's (see ``operators.hamming``), so that of most pairs no distance is
    computed and none within the radius is missed.

    With a column ``n`` in ``prints`` each pair of parts gives sums of it, ``(query, near)``; else pairs."""
    counted = "n" in prints.columns
    queries = queries.select("fingerprint").where("fingerprint is not null").distinct()
    part = lambda i: F.conv(F.substring("fingerprint", i, 16), 16, -10).cast("long")
    words = [part(17).alias("lo"), part(1).alias("hi")]
    left, right = hamming.dealt(queries.select("fingerprint", *words), prints.select("fingerprint", *words, *(["n"] if counted else [])), queries.count(), prints.count(), ["fingerprint"])

    def judge(a: pa.Table, b: pa.Table) -> pa.Table:
        ask, codes = (np.column_stack([t.column(c).to_numpy().view(np.uint64) for c in ("lo", "hi")]) for t in (a, b))
        weight = b.column("n").to_numpy() if counted else None
        who, other, value = [], [], []
        for q, rows, d in hamming.Tables(codes, BITS).near(ask, radius):
            far = d > 0
            if counted and far.any():
                who.append(q)
                value.append(int(weight[rows[far]].sum()))
            elif not counted:
                who += [q] * int(far.sum())
                other += [f"{int(h):016x}{int(x):016x}" for x, h in codes[rows[far]]]
                value += d[far].tolist()
        asked = a.column("fingerprint").take(pa.array(who, pa.int64()))
        if counted:
            return pa.table({"query": asked, "near": pa.array(value, pa.int64())})
        return pa.table({"query": asked, "fingerprint": pa.array(other, pa.string()), "distance": pa.array(value, pa.int32())})

    return left.groupBy("qb", "pb").cogroup(right.drop("fingerprint").groupBy("qb", "pb")).applyInArrow(judge, schema)


def within_radius_counts(counts: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fingerprint, near)`` for each query with others within the radius: the sum of the column ``n`` of these.
    ``counts`` has one row for each fingerprint."""
    if radius >= TABLES:
        pairs = _by_blocks(counts.where("fingerprint is not null"), queries, radius, "query string, near long")
    else:
        pairs = within_radius(counts, queries, radius).join(counts, "fingerprint").withColumnRenamed("n", "near")
    return pairs.groupBy(F.col("query").alias("fingerprint")).agg(F.sum("near").alias("near"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, likenesses to the edited text and the next document; for ids divisible by 20 also the number
    of other documents within the radius (null for others)."""
    made = materialise(with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")), "fingerprints")
    counts = made.groupBy("fingerprint").agg(F.count("*").alias("n"))
    queries = made.where("doc_id % 20 = 0").select("fingerprint").distinct()
    near = within_radius_counts(counts, queries)
    found = queries.join(near, "fingerprint", "left").join(counts, "fingerprint")
    found = found.select("fingerprint", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_within_radius"))
    # rows that ask are a twentieth; only they are joined
    asks = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    rows = made.where(asks).join(found, "fingerprint", "left").unionByName(made.where(~asks).withColumn("n_within_radius", F.lit(None).cast("long")))
    f = F.col("fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(f, F.col("edited_fingerprint")).alias("near_edited"), likeness(f, F.col("next_fingerprint")).alias("near_next"), "n_within_radius")


QUERIES = {"op1_simhash": op1_simhash}
ORACLE: dict[str, str] = {}
