"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score for being good is linear in its own features and in those of the lines
before and after it; neighbouring labels have transition weights. The model is fitted to lines that carry their
document's label. Forward-backward gives each line's probability of being good, and a document's score is their
mean, weighted by length in bytes. Texts without lines score the share of good documents in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import _bytes as B

#: Most labelled rows that the model is fitted to; those whose hashed ids come first.
SAMPLE = 6000
#: Most lines of these rows together, which bounds what the driver holds (80 bytes a line).
SAMPLE_LINES = 400_000
FOLDS = 5
THRESHOLD = 0.3

_KINDS = np.zeros((256, 8), np.float32)
_CLASS = np.full(256, 8, np.uint8)
for _i, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), [33], b"#$%&*@^~<>{}[]\\=_+", b"|", b".,;:?'\"()-", range(128, 256))):
    _KINDS[list(_set), _i] = 1
    _CLASS[list(_set)] = _i


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that are not empty, their lengths, and the first line's number of each row."""
    data, off = B.text_bytes(col)
    n = len(data)
    nl = data == 10
    inner = np.zeros(n + 1, bool)
    inner[off] = True
    begin, end = ~nl, ~nl
    if n:
        begin[1:] &= nl[:-1] | inner[1:n]
        end[:-1] &= nl[1:] | inner[1:n]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(a, off)
    size = (b - a).astype(np.float32)
    if not len(a):
        return np.zeros((0, 20), np.float32), size, first
    # line breaks count for the line before them, in a class that is not a feature
    place = np.maximum(np.cumsum(begin, dtype=np.int64) - 1, 0) * 9
    place += _CLASS[data]
    shares = np.bincount(place, minlength=9 * len(a)).reshape(-1, 9)[:, :8] / size[:, None]
    ws, we, _ = B.word_bounds(data, np.unique(np.concatenate([off, a, b])))
    h = B.span_hash(data, ws, we)
    line = place[ws] // 9
    words = np.bincount(line, minlength=len(a)).astype(np.float32)
    some = np.maximum(words, 1)
    key = np.sort(line.astype(np.uint64) << np.uint64(38) | h >> np.uint64(26))
    repeated = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(38)).astype(np.int64), minlength=len(a)) / some
    tail = data[we - 1] if len(we) else np.zeros(0, np.uint8)
    odd = np.bincount(line, _KINDS[tail, 4] + _KINDS[tail, 3], len(a)) / some
    width = np.bincount(line, we - ws, len(a)) / some
    longest = np.zeros(len(a), np.int64)
    lead = np.flatnonzero(np.diff(line, prepend=-1))
    if len(lead):
        longest[line[lead]] = np.maximum.reduceat(we - ws, lead)
    whole = B.span_hash(data, a, b)
    row = np.searchsorted(first, np.arange(len(a)), "right") - 1
    order = np.lexsort((whole, row))
    twin = np.zeros(len(a), bool)
    if len(a) > 1:
        eq = (whole[order][1:] == whole[order][:-1]) & (row[order][1:] == row[order][:-1])
        twin[order[1:]] |= eq
        twin[order[:-1]] |= eq
    count = np.diff(first)[row]
    x = np.column_stack([shares, np.log1p(size), np.log1p(words), repeated, odd, width, np.log1p(longest), twin, _KINDS[data[b - 1], 6], (words <= 2), np.log1p(count), np.sqrt(shares[:, 4]), np.sqrt(shares[:, 5])])
    return x.astype(np.float32), size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its document (zeros at the ends), and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    starts = first[:-1][np.diff(first) > 0]
    before[starts] = 0
    after[first[1:][np.diff(first) > 0] - 1] = 0
    return np.column_stack([x, before, after, np.ones(len(x), np.float32)])


def marginals(unary: np.ndarray, first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once: P(good) of each line, expected transitions of each document
    (2 x 2), and log partition functions. ``unary`` is the score of good (bad scores 0), ``t[i, j]`` that of i
    followed by j (0 bad, 1 good)."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, start = n[order], first[:-1][order]
    steps = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(steps), "left")  # documents with more than t lines
    e = np.zeros((len(unary), 2))
    e[:, 1] = unary
    top = e.max(1)
    e = np.exp(e - top[:, None])
    m = np.exp(t)
    fwd, scale, bwd = np.zeros_like(e), np.ones(len(unary)), np.ones_like(e)
    for s in range(steps):
        i = start[: live[s]] + s
        f = e[i] if s == 0 else (fwd[i - 1] @ m) * e[i]
        scale[i] = z = f.sum(1)
        fwd[i] = f / z[:, None]
    for s in range(steps - 2, -1, -1):
        i = start[: live[s + 1]] + s
        bwd[i] = (e[i + 1] * bwd[i + 1]) @ m.T / scale[i + 1][:, None]
    p = fwd * bwd
    good = p[:, 1] / p.sum(1)
    pair = np.zeros((len(n), 2, 2))
    inside = np.ones(len(unary), bool)
    inside[(start + n - 1)[n > 0]] = False
    at = np.flatnonzero(inside)
    both = fwd[at][:, :, None] * m[None] * (e[at + 1] * bwd[at + 1])[:, None, :] / scale[at + 1][:, None, None]
    doc = np.searchsorted(first, at, "right") - 1
    pair = np.stack([np.bincount(doc, both[:, a, b], len(first) - 1) for a in (0, 1) for b in (0, 1)], 1).reshape(-1, 2, 2)
    log_z = np.add.reduceat(np.append(np.log(scale) + top, 0), np.minimum(first[:-1], len(unary))) * (np.diff(first) > 0)
    return good, pair, log_z


@dataclass
class LineField:
    """A fitted model: standardisation, weights of features, transitions, and the share of good documents."""

    mean: np.ndarray
    std: np.ndarray
    w: np.ndarray
    t: np.ndarray
    base: float

    def lines(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return marginals(with_neighbours((x - self.mean) / self.std, first) @ self.w, first, self.t)[0]

    def scores(self, col: pa.Array) -> np.ndarray:
        x, size, first = line_features(col)
        p = self.lines(x, first)
        doc = np.repeat(np.arange(len(col)), np.diff(first))
        total = np.bincount(doc, size, len(col))
        return np.where(total > 0, np.clip(np.bincount(doc, size * p, len(col)) / np.maximum(total, 1), 0, 1), self.base)


def fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 250, penalty: float = 2e-3, seed_rate: float = 0.1) -> LineField:
    """Maximum penalised likelihood by Adam steps over the whole sample. A document weighs as the root of its lines,
    divided by them."""
    base = float(labels.mean()) if len(labels) else 0.5
    if not len(x):
        return LineField(np.zeros(20, np.float32), np.ones(20, np.float32), np.zeros(61), np.zeros((2, 2)), base)
    mean, std = x.mean(0), x.std(0) + 1e-3
    z = with_neighbours((x - mean) / std, first).astype(np.float64)
    n = np.diff(first)
    y = np.repeat(labels, n).astype(np.float64)
    weight = np.where(n > 0, 1 / np.sqrt(np.maximum(n, 1)), 0)
    weight /= weight.sum()
    by_line = np.repeat(weight, n)
    seen = np.zeros((len(n), 2, 2))
    seen[labels == 1, 1, 1] = np.maximum(n - 1, 0)[labels == 1]
    seen[labels == 0, 0, 0] = np.maximum(n - 1, 0)[labels == 0]
    theta, m, v = np.zeros(z.shape[1] + 4), 0.0, 0.0
    for step in range(1, rounds + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        good, pair, _ = marginals(z @ w, first, t)
        g = np.append(z.T @ (by_line * (good - y)), np.einsum("d,dij->ij", weight, pair - seen).ravel()) + penalty * theta
        g[len(w) - 1] -= penalty * theta[len(w) - 1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - seed_rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineField(mean, std, theta[:-4], theta[-4:].reshape(2, 2), base)


def fit_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> LineField:
    """A model fitted to ``sample`` labelled rows at most, outside the held-out fold, those whose hashed ids come first,
    as far as they have no more than ``lines`` lines together. The sample's ids are broadcast and its features go to the
    driver one row at a time; both bounds hold there. Rows without an id or a label are no part; of an id's labels the
    greatest counts; without any rows a model scores all alike."""
    import hashlib
    import heapq

    ids = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).where("_id is not null and _y is not null and " + f"crc32(cast(cast(_id as string) as binary)) % {FOLDS} <> 0")
    ids = ids.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.md5(F.col("_id").cast("string"))).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, first = line_features(batch.column("_t"))
            keep = np.diff(first) <= lines  # no such row fits in
            parts = [x[a:b].tobytes() if ok else None for a, b, ok in zip(first[:-1], first[1:], keep)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.array(parts, pa.binary())], ["id", "y", "x"])

    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(ids), "_id").select(F.col("_id").cast("long").alias("_id"), F.col("_y").cast("int").alias("_y"), "_t")
    held, total = [], 0  # the last in the order of hashes goes first when there are too many lines
    for r in rows.mapInArrow(B.tidy(run), "id long, y int, x binary").where("x is not null").toLocalIterator():
        order = int(hashlib.md5(str(r["id"]).encode()).hexdigest(), 16)
        heapq.heappush(held, (-order, r["id"], bytes(r["x"]), r["y"]))
        total += len(r["x"]) // 80
        while total > lines:
            total -= len(heapq.heappop(held)[2]) // 80
    got = sorted((i, x, y) for _, i, x, y in held)
    xs = [np.frombuffer(x, np.float32).reshape(-1, 20) for _, x, _ in got]
    first = np.cumsum([0, *map(len, xs)])
    return fit(np.concatenate(xs) if xs else np.zeros((0, 20), np.float32), first, np.array([y for *_, y in got]))


def with_scores(docs: DataFrame, model: LineField, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 for each whole text; null counts as empty and scores the share of good
    labels. A column named ``to`` is replaced, others stay; rows that repeat score alike; an empty table gives an empty one."""
    docs = docs.drop(to) if to != text else docs
    schema, names = T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            filled, done = batch.set_column(at, text, batch.column(at).fill_null("")), 0
            for part in B.slices(filled, text):
                yield pa.RecordBatch.from_arrays([*batch.slice(done, part.num_rows).columns, pa.array(model.scores(part.column(text)), pa.float64())], [*names, to])
                done += part.num_rows

    return docs.mapInArrow(B.tidy(run), schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored; a null id is not held out; other odd inputs as stated in :func:`with_scores` and :func:`fit_sample`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    return with_scores(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLE: dict[str, str] = {}
