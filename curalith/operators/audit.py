"""Audits of splits and sources: nearest neighbours, distances between feature sets, frozen manifests, dispositions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from curalith.operators import metric, metrics as X
from curalith.operators.curation import stratified_split
from curalith.operators.forest import largest_components, spanning_forest
from curalith.operators.links import _mean, dimensions
from curalith.operators.order import dense_ids
from curalith.operators.selection import exact_percentiles
from curalith.storage import materialise


def pseudonym(key: bytes, *parts: Column, digits: int = 32) -> Column:
    """The first digits of the HMAC-SHA256 of the parts joined by ``|``, as nested digests; empty for blank parts."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda b: F.unhex(F.lit(bytes(x ^ b for x in key).hex()))
    message = F.concat_ws("|", *parts)
    inner = F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256)
    out = F.substring(F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256), 1, digits)
    return F.when(F.trim(F.coalesce(parts[-1], F.lit(""))) == "", "").otherwise(out)


def median_bits(coefficients: Column) -> Column:
    """A string of 0 and 1: which coefficients lie above their median."""
    s = F.array_sort(F.transform(coefficients, lambda x: x.cast("double")))
    n = F.size(coefficients)
    at = lambda i: F.element_at(s, i.cast("int"))
    median = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    return F.array_join(F.transform(coefficients, lambda x: F.when(x.cast("double") > median, "1").otherwise("0")), "")


def nearest(query: DataFrame, reference: DataFrame, node: str, vector: str, mirror: str | None = None, centre: list[float] | None = None, cell: int = metric.CELL, log: list[dict] | None = None) -> DataFrame:
    """``(query, reference, score)``: the reference vector of greatest cosine for each query vector, the least id of
    equals, exactly, by a metric partition (see ``metric``). With ``mirror`` a reference counts as it is or mirrored,
    whichever is nearer; ``centre`` is taken off all vectors first. Rows without a vector neither ask nor answer; without
    references there are no rows."""
    dims, middle = dimensions(query, vector), None if centre is None else np.array(centre)
    if not dims:
        return query.sparkSession.createDataFrame([], "query long, reference long, score double")
    asks = metric.packed(query, node, [vector], middle)
    return metric.nearest_of(asks, metric.packed(reference, node, [vector, *([mirror] if mirror else [])], middle), dims, cell, metric.CELL, log)


def neighbour_report(found: DataFrame, by: list[str], marks: tuple[float, ...] = (0.9, 0.95), warn: float | None = None) -> DataFrame:
    """Queries, median (exact, see ``selection``) and greatest score, and how many, and which share, reach each mark; with
    ``warn`` whether the share at the last mark is above it."""
    at = [(m, F.col("score") >= m) for m in marks]
    found = materialise(found.select(*by, "score"), "scores")
    out = found.groupBy(*by).agg(
        F.count("*").alias("n"), F.max("score").alias("most"),
        *[F.avg(hit.cast("int")).alias(f"share_{round(m * 100)}") for m, hit in at], *[F.count_if(hit).alias(f"n_{round(m * 100)}") for m, hit in at],
    )
    middle = exact_percentiles(found, by, "score", {"median": 0.5}).select(*[F.col(c).alias(f"_{c}") for c in by], "median")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = out.join(middle, same, "left").select(*by, "n", "median", *[c for c in out.columns if c not in (*by, "n")])
    return out if warn is None else out.withColumn("warning", F.col(f"share_{round(marks[-1] * 100)}") > warn)


def leakage_report(rows: DataFrame, node: str, vector: str, split: str, source: str, marks: tuple[float, ...] = (0.9, 0.95), warn: float = 0.02, mirror: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(report, flagged)``: for every evaluation split, source of its rows, and source of training rows, how near the
    nearest training row is; and the pairs that reach the lowest mark. Vectors are centred by the mean of all."""
    centre = _mean(rows, vector).tolist()
    sources = [r[0] for r in rows.select(source).distinct().orderBy(source).collect()]  # names of sources
    every = None
    for ref in sources:
        train = rows.where((F.col(split) == "train") & (F.col(source) == ref))
        found = nearest(rows.where(F.col(split) != "train"), train, node, vector, mirror, centre).withColumn("train_source", F.lit(ref))
        every = found if every is None else every.unionByName(found)
    every = every.join(rows.select(F.col(node).alias("query"), F.col(split).alias("evaluation_split"), F.col(source).alias("query_source")), "query")
    every = materialise(every, "neighbours")
    by = ["evaluation_split", "query_source", "train_source"]
    return neighbour_report(every, by, marks, warn), every.where(F.col("score") >= min(marks)).select(*by, "query", "reference", "score")


def random_pair_scores(rows: DataFrame, node: str, vector: str, seed: str, n: int = 20_000, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles of the cosine of ``n`` seeded random pairs of mean-centred vectors: what chance alone gives. The
    number of pairs is the feature, as a scale to hold scores against."""
    centre = F.array(*[F.lit(float(x)) for x in _mean(rows, vector)])
    total = rows.count()
    at = lambda name: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), F.col("i").cast("string"))), 1, 12), 16, 10).cast("long") % F.lit(max(total, 1))
    pairs = rows.sparkSession.range(n if total else 0).select(F.col("id").alias("i")).select("i", at("a").alias("a"), at("b").alias("b"))
    numbered = dense_ids(rows.select(F.col(node).alias("k"), F.zip_with(F.col(vector).cast("array<double>"), centre, lambda x, m: x - m).alias("v")), "k", "at").where("at is not null")
    side = lambda name: numbered.select(F.col("at").alias(name), F.col("v").alias(f"v{name}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    score = dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb")))
    scores = materialise(both.select(F.lit(1).alias("all"), score.alias("s")), "pair-scores")
    at = exact_percentiles(scores, ["all"], "s", {f"p{round(100 * p)}": p for p in points}).drop("all")
    return scores.agg(F.count("*").alias("n")).join(at, F.lit(True), "left")  # a row each


def escalate(links: DataFrame, n: int, taus: list[float], most: float = 0.02) -> DataFrame:
    """``(tau, largest, share, chosen)``: the first threshold at which the largest component holds at most that share
    of n nodes is chosen, else the last; later ones are left out. All thresholds come from one spanning forest."""
    largest, rows = largest_components(spanning_forest(materialise(links, "scored-links")), taus), []
    for tau in taus:
        rows.append((tau, largest[tau], largest[tau] / n if n else 0.0))
        if rows[-1][2] <= most:
            break
    return links.sparkSession.createDataFrame([(*r, i == len(rows) - 1) for i, r in enumerate(rows)], "tau double, largest long, share double, chosen boolean")


def complete_group_split(groups: DataFrame, key: str, seed: str) -> DataFrame:
    """Groups as wholes to train, val and test; those not ``complete`` are excluded."""
    parts = stratified_split(groups.where("complete").withColumn("_all", F.lit(1)), "_all", key, seed).select(key, "split")
    return groups.join(parts, key, "left").withColumn("split", F.coalesce("split", F.lit("excluded")))


def frozen_checks(actual: DataFrame, saved: DataFrame, key: str, cls: str, digest: str, group: str, splits=("train", "val", "test")) -> dict[str, DataFrame]:
    """Checks that a saved split still fits the files: each a table of offending rows. Any row refuses the reuse."""
    a, s = actual.alias("a"), saved.alias("s")
    both = a.join(s, F.col(f"a.{key}") == F.col(f"s.{key}"))
    return {
        "missing": actual.join(saved, key, "left_anti"),
        "unknown": saved.join(actual, key, "left_anti"),
        "repeated": saved.groupBy(key).count().where("count > 1"),
        "changed": both.where(~F.col(f"a.{digest}").eqNullSafe(F.col(f"s.{digest}"))),
        "relabelled": both.where(~F.col(f"a.{cls}").eqNullSafe(F.col(f"s.{cls}"))),
        "bad_split": saved.where(~F.coalesce(F.col("split").isin(*splits), F.lit(False))),
        "no_group": saved.where(F.col(group).isNull()),
        "crossing": saved.groupBy(group).agg((F.min("split") != F.max("split")).alias("x")).where("x"),
    }


def disposition(rules: list[tuple[str, Column]], default: str = "retained") -> Column:
    """One final status: of the rules that hold, the last one counts."""
    out = F.lit(default)
    for status, holds in rules:
        out = F.when(F.coalesce(holds, F.lit(False)), status).otherwise(out)
    return out


def moments(rows: DataFrame, cls: str, vector: str) -> DataFrame:
    """``(class, n, sum, outer)`` of each partition: a few numbers a class, whatever the rows."""

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for c, part in pdf.groupby("c", dropna=False):
                x = np.vstack(part["v"].to_numpy()).astype(np.float64)
                n, s, o = held.get(c, (0, 0.0, 0.0))
                held[c] = n + len(x), s + x.sum(0), o + x.T @ x
        if held:
            yield pd.DataFrame([(c, n, s.tolist(), o.ravel().tolist()) for c, (n, s, o) in held.items()], columns=["class", "n", "sum", "outer"]).astype({"class": object})

    return rows.select(F.col(cls).cast("string").alias("c"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, "class string, n long, sum array<double>, outer array<double>")


def frechet(a: DataFrame, b: DataFrame, cls: str, vector: str) -> DataFrame:
    """``(class, n_a, n_b, distance)``: Frechet distance of the two sets of vectors of each class that has two rows on
    each side."""
    distance = F.col("mean_part") + F.col("trace_a") + F.col("trace_b") - 2 * F.col("cross")
    return frechet_terms(a, b, cls, vector).select("class", "n_a", "n_b", distance.alias("distance"))


def frechet_terms(a: DataFrame, b: DataFrame, cls: str, vector: str) -> DataFrame:
    """``(class, n_a, n_b, mean_part, trace_a, trace_b, cross)``: squared distance of the means, traces of both covariances,
    and the trace of their product's root. Sums meet by class; the eigenvalues of one small matrix a class are taken in a
    task."""
    fields = ["class", "n_a", "n_b", "mean_part", "trace_a", "trace_b", "cross"]
    sides = moments(a, cls, vector).withColumn("side", F.lit(0)).unionByName(moments(b, cls, vector).withColumn("side", F.lit(1)))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        got = []
        for side in (0, 1):
            p = pdf[pdf["side"] == side]
            n = int(p["n"].sum())
            if n < 2:
                return pd.DataFrame({"class": np.zeros(0, object), "n_a": np.zeros(0, np.int64), "n_b": np.zeros(0, np.int64), **{f: np.zeros(0) for f in fields[3:]}})
            mean = np.vstack(p["sum"].to_numpy()).sum(0) / n
            d = len(mean)
            got.append((n, mean, (np.vstack(p["outer"].to_numpy()).sum(0).reshape(d, d) - n * np.outer(mean, mean)) / (n - 1)))
        (n, m, s), (k, q, t) = got
        w, u = np.linalg.eigh(s)
        root = (u * np.sqrt(np.clip(w, 0, None))) @ u.T
        cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ t @ root), 0, None)).sum()
        return pd.DataFrame([(pdf["class"].iloc[0], n, k, float((m - q) @ (m - q)), float(np.trace(s)), float(np.trace(t)), float(cross))], columns=fields).astype({"class": object})

    return sides.groupBy("class").applyInPandas(judge, "class string, n_a long, n_b long, mean_part double, trace_a double, trace_b double, cross double")


def shortcut_control(rows: DataFrame, features: list[str], label: str, held_out: Column, max_iter: int = 50) -> DataFrame:
    """``(n, accuracy, balanced_accuracy, f1_macro, chance)`` on held-out rows of a class-weighted logistic regression,
    of two classes or more (labels from 0), over standardised features that should carry no signal."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    x = rows.na.drop(subset=[*features, label]).withColumn("_held", held_out)
    train = x.where("not _held")
    by = train.groupBy(label).agg(F.count("*").alias("_n"))
    total, k = by.agg(F.sum("_n"), F.count("*")).first()
    train = train.join(F.broadcast(by), label).withColumn("_w", F.lit(float(total)) / (k * F.col("_n")))  # a row a class
    stages = [VectorAssembler(inputCols=features, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol=label, weightCol="_w", maxIter=max_iter)]
    out = Pipeline(stages=stages).fit(train).transform(x.where("_held").withColumn("_w", F.lit(1.0)))
    pred = out.select(F.lit("all").alias("m"), F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"))
    most = rows.agg(F.max(label)).first()[0]
    s = X.summary(X.per_class(X.confusion(pred, int(most or 0) + 1, ["m"]), ["m"]), ["m"], present_only=True)
    return s.select("n", "accuracy", "balanced_accuracy", "f1_macro", F.lit(1.0 / k if k else None).alias("chance"))


def shortcut_controls(rows: DataFrame, sets: dict[str, list[str]], labels: dict[str, str], held_out: Column) -> DataFrame:
    """``shortcut_control`` for each set of features and each label, such as class or source, as one table."""
    out = None
    for target, label in labels.items():
        for name, features in sets.items():
            one = shortcut_control(rows, features, label, held_out).select(F.lit(target).alias("target"), F.lit(name).alias("features"), "*")
            out = one if out is None else out.unionByName(one)
    return out
