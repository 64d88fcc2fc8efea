"""Importance resampling towards a target distribution, by hashed n-grams.

Identical texts are collapsed first: rows are grouped by their full text, the features of a text are computed once,
and its counts are multiplied by how often it occurs. Features are runs of one to three words, hashed into buckets;
a bucket's gain is the smoothed log ratio of its share in the target and in the corpus. A text's weight, the sum of
gains over its features, is computed once too, joined back to its rows, and only then gets a row's own noise, so that
the highest scores are a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from curalith.operators.skew import join_groups
from curalith.storage import materialise

from . import _bytes as B

BUCKETS = 10_000
NGRAM = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = "42"

#: Bytes of words once A-Z are lower: digits, a-z, and all beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Words longer than this are hashed one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()


def _shifts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables by which a CRC is carried over so many bytes that follow, one for each distinct length, and each length's
    table. Carrying is linear over bits, so a power of one byte's step is made by squaring and then spread over the four
    bytes of a CRC."""
    cache = B.worker_cache().setdefault("crc_shifts", {})
    which, at = np.unique(lengths, return_inverse=True)
    if len(cache) > 4096:
        cache.clear()

    def apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for bit in range(32):
            out ^= np.where(x >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
        return out

    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for n in which.tolist():
        if n not in cache:
            step, columns, left = _TABLE[unit & np.uint32(255)] ^ unit >> np.uint32(8), unit, n
            while left:
                if left & 1:
                    columns = apply(step, columns)
                step, left = apply(step, step), left >> 1
            cache[n] = np.stack([apply(columns, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])
    return np.stack([cache[n] for n in which.tolist()]) if len(which) else np.zeros((0, 4, 256), np.uint32), at


def _carried(crc: np.ndarray, tables: np.ndarray, which: np.ndarray) -> np.ndarray:
    flat, base = tables.ravel(), which.astype(np.int64) * 1024
    out = flat[base + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= flat[base + 256 * k + (crc >> np.uint32(8 * k) & np.uint32(255))]
    return out


def _word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word's bytes: all words one byte further at a time, long ones singly."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    s, n = starts[order], size[order]
    state = np.full(len(s), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-n, -_LONG, "left"))
    alive = np.searchsorted(-n[long:], -np.arange(_LONG), "left") + long
    for i in range(_LONG):
        if alive[i] == long:
            break
        part = slice(long, alive[i])
        state[part] = _TABLE[(state[part] ^ data[s[part] + i]) & np.uint32(255)] ^ state[part] >> np.uint32(8)
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        state[i] = zlib.crc32(data[s[i] : s[i] + n[i]])
    out = np.empty_like(state)
    out[order] = state
    return out


def features(col: pa.Array, buckets: int = BUCKETS, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``ngram`` words, each row's sorted, with the offsets of rows in them, and each row's
    number of words. Nulls must have been filled."""
    data, off = B.text_bytes(col)
    data = B.LOWER[data]
    n = len(data)
    inner = np.zeros(n + 1, bool)
    inner[off] = True
    word = _WORD[data]
    begin, end = word.copy(), word.copy()
    if n:
        begin[1:] &= ~word[:-1] | inner[1:n]
        end[:-1] &= ~word[1:] | inner[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, off)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(col)), words)
    crc = _word_crcs(data, starts, ends)
    tables, which = _shifts(ends - starts)
    spaced = _carried(np.full(len(crc), zlib.crc32(b" "), np.uint32), tables, which) ^ crc
    tables, which = _shifts(ends - starts + 1)
    docs, codes, run = [doc], [crc % np.uint32(buckets)], crc
    for k in range(1, ngram):  # a run of k + 1 words is one of k words, a blank and the next word
        run = _carried(run[:-1], tables, which[k:]) ^ spaced[k:]
        same = doc[k:] == doc[: len(doc) - k]
        docs.append(doc[k:][same])
        codes.append((run % np.uint32(buckets))[same])
    key = np.sort(np.concatenate(docs).astype(np.int64) * buckets + np.concatenate(codes))
    return key % buckets, np.searchsorted(key, np.arange(len(col) + 1, dtype=np.int64) * buckets), words


def feature_table(texts: DataFrame, key: str, text: str, count: str, buckets: int = BUCKETS, ngram: int = NGRAM) -> DataFrame:
    """``(key, n, n_words, n_features, steps)`` of texts: the sorted buckets of all features as their differences, 16 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "text"):
                codes, off, words = features(part.column("text"), buckets, ngram)
                steps = np.diff(codes, prepend=0)
                heads = off[:-1][np.diff(off) > 0]
                steps[heads] = codes[heads]
                raw = steps.astype("<u2").tobytes()
                packed = pa.array([raw[2 * a : 2 * b] for a, b in zip(off[:-1], off[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n"), pa.array(words, pa.int64()), pa.array(np.diff(off), pa.int64()), packed], ["key", "n", "n_words", "n_features", "steps"])

    rows = texts.select(F.col(key).alias("key"), F.col(count).cast("long").alias("n"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(B.tidy(run), "key binary, n long, n_words long, n_features long, steps binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column of packed differences, and the rows' offsets in them."""
    data, off = B.text_bytes(column)
    off = off // 2
    total = np.cumsum(np.frombuffer(data.tobytes(), "<u2").astype(np.int64))
    before = np.append(0, total)[off[:-1]]
    return total - np.repeat(before, np.diff(off)), off


def bucket_counts(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows, copies included, lie in each bucket. A task sends one count for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in B.slices(batch, "steps"):
                codes, off = _unpacked(part.column("steps"))
                times = np.repeat(part.column("n").to_numpy(), np.diff(off))
                once = times == 1
                sums += np.bincount(codes[once], minlength=buckets)
                np.add.at(sums, codes[~once], times[~once])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["bucket", "count"])

    out = np.zeros(buckets, np.int64)
    for r in table.select("n", "steps").mapInArrow(B.tidy(run), "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count")).collect():  # as many rows as buckets
        out[r["bucket"]] = r["count"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target and in the corpus, rounded down."""
    n, all_s, all_t = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (all_s + n)) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(key, n, n_words, n_features, weight)``: the sum of gains over each row's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "steps"):
                codes, off = _unpacked(part.column("steps"))
                upto = np.append(0, np.cumsum(gain[codes]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "n", "n_words", "n_features")), pa.array(upto[off[1:]] - upto[off[:-1]], pa.int64())], ["key", "n", "n_words", "n_features", "weight"])

    return table.select("key", "n", "n_words", "n_features", "steps").mapInArrow(B.tidy(run), "key binary, n long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of Gumbel noise of an id, rounded down; a null id has the noise of the empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def text_weights(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, ngram: int = NGRAM) -> DataFrame:
    """``(key, n, n_words, n_features, weight)`` of each distinct text of ``docs``; ``key`` is its SHA-256."""
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(whole.alias("text")).groupBy("text").agg(F.count("*").alias("n")).withColumn("key", F.unhex(F.sha2("text", 256)))
    table = materialise(feature_table(texts, "key", "text", "n", buckets, ngram), "features")
    wanted = feature_table(target.select(F.coalesce(F.col(target_text), F.lit("")).alias("text"), F.lit(b"").alias("key"), F.lit(1).alias("n")), "key", "text", "n", buckets, ngram)
    return weights(table, gains(bucket_counts(table, buckets), bucket_counts(wanted, buckets)))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS, ngram: int = NGRAM) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for every row of ``docs``.

    Rows with at least ``least_words`` words are drawn, ``percent`` of a hundred of them rounded down, by falling score,
    ties by rising id (null last) and then in any order; ``rank`` is null for others. A null or empty text has no
    features and weight 0; rows equal in text share its weight; rows equal in id and text have equal scores and ranks
    that follow one another. Without a target all gains come from the corpus alone. Other columns are not read, so
    names cannot clash; an empty table gives an empty one.

    The order is a range sort of small rows: ranges are written with their number, counted, and a rank is what earlier
    ranges hold and the place within its own.
    """
    by_text = materialise(text_weights(docs, target, text, target_text, buckets, ngram), "text-weights")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("key"))
    total = by_text.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scored = join_groups(rows, by_text, total, "key", size="n").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("fit"), F.monotonically_increasing_id().alias("row"))
    scored = materialise(scored, "scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranged = materialise(scored.where("fit").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    held = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}  # as many rows as partitions
    upto, last, before = percent * sum(held.values()) // 100, max(held, default=0), [0]
    for i in range(last):
        before.append(before[-1] + held.get(i, 0))
    at = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("range"))
    reached = max((i for i, b in enumerate(before) if b < upto), default=-1)  # later ranges hold none that are drawn
    drawn = ranged.where(F.col("range") <= reached).withColumn("rank", at).where(F.col("rank") <= upto).select("row", "rank")
    return scored.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against the texts of ``benchmark``; odd inputs as stated in :func:`resample`."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op11_importance": op11_importance}
#: The CRC of features is beyond DuckDB's functions; tests hold the query against plain code.
ORACLE: dict[str, str] = {}
