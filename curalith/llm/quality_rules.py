"""Quality rules: document statistics, two hard rules, and boosted trees over the statistics.

Every statistic is counted over the whole text. The trees are fitted to all labelled rows outside the held-out fold, by
passes over blocks of their statistics; more marks, repeated lines, repeated words, exclamation marks or capitals can never
raise a score. The least score of a kept document is set on the third of these rows that the trees do not see, so that
nearly all good documents stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import _bytes as B, boosting
from ._names import unused
from curalith.storage import materialise

#: Rows outside this fold of ids are for fitting, those inside for measuring.
FOLDS = 5
#: Share of good documents, of the third of the labelled rows that is set apart, that must stay; the limit is at most HIGHEST.
KEEP = 0.999
HIGHEST = 0.5
LEAST_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see, and the only way in which each may move a score (0: either).
STATISTICS = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "capitals": -1, "exclamations": -1, "digits": 0, "stops": 0, "other_marks": -1,
    "non_ascii": 0, "distinct": 0, "plain_ends": 0, "letterless": -1, "line_words": 0, "ended_lines": 0, "longest_word": 0, "short_words": 0, "commonest": 0,
}

_IS = {k: np.isin(np.arange(256), list(v)) for k, v in {"symbol": b"#*$%&|<>", "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:?'\"()-", "other": b"@^~{}[]\\=_+`/", "high": range(128, 256), "tail": range(128, 192)}.items()}
_WORDLY = _IS["upper"] | _IS["lower"] | _IS["digit"] | _IS["high"]
_LETTER = _IS["upper"] | _IS["lower"] | _IS["high"]


def statistics(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The five counts (rows x 5, whole numbers) and the trees' statistics (rows x 19) of each text.

    Words in windows are told apart by 64-bit hashes. Nulls must have been filled."""
    data, off = B.text_bytes(col)
    rows = len(col)
    starts, ends, first = B.word_bounds(data, off)
    words = np.diff(first)
    doc = np.repeat(np.arange(rows), words)

    def by_row(mark: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(mark, dtype=np.int64))
        return upto[off[1:]] - upto[off[:-1]]

    def by_word(mark: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(mark, dtype=np.int64))
        return upto[first[1:]] - upto[first[:-1]]

    char = ~_IS["tail"][data]
    word_chars = by_row(char & ~B.SPACE[data])
    symbols = by_row(_IS["symbol"][data])
    raw, dup, lines, ended = data.tobytes(), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        some = [x for x in raw[a:b].split(b"\n") if x.strip()]  # strip takes the same blanks as words have
        dup[i], lines[i] = len(some) - len(set(some)), len(some)
        ended[i] = sum(x.rstrip()[-1] in b".!?\"" for x in some)
    h = B.span_hash(data, starts, ends)
    own = B.mix(doc.astype(np.uint64) + np.uint64(1))
    repeated = np.zeros(rows, np.int64)
    if len(h) >= WINDOW:
        inside = doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1]
        at = np.flatnonzero(inside)
        runs = (B.shingles(h, WINDOW) ^ own[: len(inside)])[at]
        order = np.argsort(runs, kind="stable")
        same = runs[order][1:] == runs[order][:-1]
        twice = np.zeros(len(runs), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
        repeated = by_word(np.cumsum(cover[:-1]) > 0)
    key = np.sort(h ^ own)
    # a row's words by how often they occur: runs of equal keys
    lead = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(lead, len(key)))
    whose = np.zeros(len(lead), np.int64)
    if len(lead):
        order = np.argsort(h ^ own, kind="stable")
        whose = doc[order][lead]
    distinct = np.bincount(whose, minlength=rows)
    commonest = np.zeros(rows, np.int64)
    np.maximum.at(commonest, whose, times)
    size = ends - starts
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, doc, size)
    letters = np.append(0, np.cumsum(_LETTER[data], dtype=np.int64))
    letterless = by_word(letters[ends] == letters[starts]) if len(h) else words * 0
    plain_ends = by_word(_WORDLY[data[ends - 1]]) if len(h) else words * 0
    short = by_word(size <= 3)
    capitals, small = by_row(_IS["upper"][data]), by_row(_IS["lower"][data])
    n, c, per_line = np.maximum(words, 1), np.maximum(word_chars, 1), np.maximum(lines, 1)
    x = np.column_stack([
        np.log1p(words), word_chars / n, symbols / n, dup / per_line, repeated / n, capitals / np.maximum(capitals + small, 1), by_row(data == 33) / n, by_row(_IS["digit"][data]) / c,
        by_row(_IS["stop"][data]) / n, by_row(_IS["other"][data]) / n, by_row(_IS["high"][data] & char) / c, distinct / n, plain_ends / n, letterless / n, words / per_line, ended / per_line,
        np.log1p(longest), short / n, commonest / n,
    ])
    return np.column_stack([words, word_chars, symbols, dup, repeated]), x


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Few words, or many in repeated windows."""
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


@dataclass
class Rules:
    """Fitted trees and the least score of a kept document."""

    trees: boosting.NodeArrays
    limit: float


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, the five counts, x)`` of each row, ``x`` being the trees' statistics as bytes. Null texts are empty."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "_t"):
                counts, x = statistics(part.column("_t"))
                arrays = [pa.array(counts[:, i], pa.int64()) for i in range(len(COUNTS))]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *arrays, pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", *COUNTS, "x"])

    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return rows.mapInArrow(B.tidy(run), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", x binary")


def fit_labelled(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Rules:
    """Rules fitted to all labelled ``rows`` of ``with_statistics`` outside the held-out fold, one row an id (of several texts
    of an id that with the least statistics, of several labels the greatest). Trees are fitted to two thirds of the ids,
    the limit is set on the good ones of the others: the score that all but a share of 1 - KEEP of them reach. Without any of
    these it is 0 and all documents stay that the hard rules keep. Rows without an id or a label are no part."""
    ids = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    ids = ids.where(f"crc32(cast(cast(id as string) as binary)) % {FOLDS} <> 0").groupBy("id").agg(F.max("y").alias("y"))
    known = rows.select(F.col("doc_id").cast("long").alias("id"), "x").join(ids, "id").groupBy("id").agg(F.min("x").alias("x"), F.max("y").alias("y"))
    known = materialise(known.withColumn("apart", F.crc32(F.concat(F.lit("apart:"), F.col("id").cast("string")).cast("binary")) % 3 == 0), "labelled-statistics")
    trees = boosting.fit_table(known.where("not apart"), np.array(list(STATISTICS.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([pa.array(trees.scores(x))], ["score"])

    good = materialise(known.where("apart and y = 1").select("x").mapInArrow(run, "score double"), "good-scores")
    least = good.orderBy("score").offset(int((1 - KEEP) * good.count())).limit(1).collect()
    return Rules(trees, min(HIGHEST, least[0]["score"]) if least else 0.0)


def fit_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Rules:
    """``fit_labelled`` of all labelled documents; no sample is taken, in spite of the name, which callers know."""
    return fit_labelled(materialise(with_statistics(docs, doc_id, text), "statistics"), labels, doc_id, label)


def with_verdicts(docs: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """``docs`` with the five counts, ``base_failed``, ``score`` (0 to 1) and ``kept``, for each whole text.

    Null and empty texts have no words and fail the hard rules; rows that repeat have equal results; an empty table
    gives an empty one. Other columns stay, but those named like the new ones are replaced."""
    new = [*COUNTS, "base_failed", "score", "kept"]
    taken = {x.lower() for x in new}
    (held,) = unused(docs.columns, "_t")
    docs = docs.withColumn(held, F.coalesce(F.col(text), F.lit("")))
    stay = [c for c in docs.columns if c.lower() not in taken and c != held]
    docs = docs.select(*stay, held)
    kinds = [T.LongType()] * len(COUNTS) + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*(docs.schema[c] for c in stay), *(T.StructField(n, k) for n, k in zip(new, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in B.slices(batch, held):
                counts, x = statistics(part.column(held))
                failed, score = base_failed(counts), rules.trees.scores(x)
                arrays = [*(pa.array(counts[:, i], pa.int64()) for i in range(len(COUNTS))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= rules.limit))]
                same = batch.slice(done, part.num_rows)
                yield pa.RecordBatch.from_arrays([*(same.column(c) for c in stay), *arrays], [*stay, *new])
                done += part.num_rows

    return docs.mapInArrow(B.tidy(run), schema)


def judged(rows: DataFrame, rules: Rules) -> DataFrame:
    """Rows of ``with_statistics`` with ``base_failed``, ``score`` and ``kept`` as in :func:`with_verdicts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.column_stack([batch.column(c).to_numpy() for c in COUNTS])
            failed = base_failed(counts)
            score = rules.trees.scores(np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *COUNTS)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= rules.limit))], ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "x")
    return rows.mapInArrow(B.tidy(run), f"{fields}, base_failed boolean, score double, kept boolean")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, with rules fitted to ``labels.quality``; odd inputs as stated in :func:`with_verdicts`. Statistics
    are counted once, for fitting and judging."""
    rows = materialise(with_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "statistics")
    return judged(rows, fit_labelled(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op13_quality_rules": op13_quality_rules}
#: Trees are beyond SQL; tests hold counts against plain code and verdicts against held-out labels.
ORACLE: dict[str, str] = {}
