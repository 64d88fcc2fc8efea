"""Model-evaluation queries: predictions derived from line items, and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curalith.functions import scalar as S
from curalith.operators import metrics as X
from curalith.storage import materialise

from .curation import table

K = 4
MODELS = ("m0", "m1", "m2")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three models' probabilities for each line item, whose class is its line number modulo 4."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    y = (F.col("l_linenumber") % K).cast("int")
    m = F.col("m")
    raw = [F.col("l_quantity") + 1, F.col("l_discount") * 300 + 1, F.col("l_tax") * (400 + 50 * m) + 1, F.lit(25.0) + m]
    # four decimals by plain arithmetic: rounding a double goes through big decimals
    raw = [F.rint((r + F.when(y == i, (6.0 + 4 * m) * ((F.col("l_orderkey") + m) % 3)).otherwise(0.0)) * 10000) / 10000 for i, r in enumerate(raw)]
    x = li.select(F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("m"), "*").select(F.concat(F.lit("m"), "m").alias("model"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), F.col("l_returnflag").alias("source"), y.alias("y"), *[r.alias(f"r{i}") for i, r in enumerate(raw)])
    total = sum((F.col(f"r{i}") for i in range(1, K)), F.col("r0"))
    x = x.withColumn("total", total)
    split = F.when(F.col("record_id") % 20 < 10, "val").otherwise("test")
    probs = [F.col(f"r{i}") / F.col("total") for i in range(K)]
    best, pred = F.greatest(*probs), F.lit(K - 1)
    for i in reversed(range(K - 1)):  # the first maximum
        pred = F.when(probs[i] == best, i).otherwise(pred)
    return x.select("model", "record_id", "source", split.alias("split"), "y", F.array(*probs).alias("probs"), pred.alias("pred"))


P = """p0 AS (SELECT m, 'm' || m AS model, l_orderkey * 10 + l_linenumber AS record_id, l_returnflag AS source, (l_linenumber % 4)::INT AS y,
  [l_quantity + 1, l_discount * 300 + 1, l_tax * (400 + 50 * m) + 1, 25.0::DOUBLE + m] AS raw, l_orderkey FROM lineitem, range(3) t(m)),
p1 AS (SELECT *, list_transform(range(4), lambda i: round(raw[i + 1] + CASE WHEN y = i THEN (6 + 4 * m) * ((l_orderkey + m) % 3) ELSE 0 END, 4)) AS r FROM p0),
p2 AS (SELECT *, list_transform(r, lambda v: v / (r[1] + r[2] + r[3] + r[4])) AS probs FROM p1),
p AS (SELECT model, record_id, source, CASE WHEN record_id % 20 < 10 THEN 'val' ELSE 'test' END AS split, y, probs, (list_position(probs, list_max(probs)) - 1)::INT AS pred FROM p2)"""

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def classes_sql(rows: str, by: str) -> str:
    return f"""k AS (SELECT DISTINCT {by} FROM {rows}), l AS (SELECT k.*, c FROM k, range(4) t(c)),
pc AS (SELECT {by}, c AS class, (SELECT count(*) FROM {rows} x WHERE ({on(by, 'x', 'l')}) AND x.y = c AND x.pred = c) AS tp,
 (SELECT count(*) FROM {rows} x WHERE ({on(by, 'x', 'l')}) AND x.y = c) AS support, (SELECT count(*) FROM {rows} x WHERE ({on(by, 'x', 'l')}) AND x.pred = c) AS predicted FROM l),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
 CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM pc),
sm0 AS (SELECT {by}, sum(support)::DOUBLE AS n, sum(tp)::DOUBLE AS c, sum(support * predicted)::DOUBLE AS tpx, sum(support * support)::DOUBLE AS tt, sum(predicted * predicted)::DOUBLE AS pp,
 avg(recall) FILTER (support > 0) AS balanced_accuracy, avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted FROM pr GROUP BY ALL),
sm AS (SELECT {by}, n::BIGINT AS n, c / n AS accuracy, balanced_accuracy, precision_macro, recall_macro, f1_macro, f1_weighted,
 CASE WHEN tpx / (n * n) < 1 THEN (c / n - tpx / (n * n)) / (1 - tpx / (n * n)) ELSE 0 END AS kappa,
 CASE WHEN sqrt((n * n - pp) * (n * n - tt)) > 0 THEN (c * n - tpx) / sqrt((n * n - pp) * (n * n - tt)) ELSE 0 END AS mcc FROM sm0)"""


def on(by: str, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in by.split(","))


NUMBERS = ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted", "kappa", "mcc")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def rounded_sql(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query(f"""WITH {P}, d AS (SELECT model, split, a.y::INT AS y, b.pred::INT AS pred FROM (SELECT DISTINCT model, split FROM p), range(4) a(y), range(4) b(pred)),
c AS (SELECT model, split, y, pred, count(*) AS n FROM p GROUP BY ALL) SELECT model, split, y, pred, coalesce(n, 0)::BIGINT AS n FROM d LEFT JOIN c USING (model, split, y, pred)""")
def confusion_matrix(spark, sf):
    return X.confusion(predictions(spark, sf), K, ["model", "split"])


def _classes(spark, sf, by):
    return X.per_class(X.confusion(predictions(spark, sf), K, by), by)


@query(f"WITH {P}, {classes_sql('p', 'model, split')} SELECT model, split, class::INT AS class, support, {rounded_sql('precision', 'recall', 'f1')} FROM pr")
def per_class_report(spark, sf):
    return rounded(_classes(spark, sf, ["model", "split"]), "precision", "recall", "f1").select("model", "split", "class", "support", "precision", "recall", "f1")


@query(f"WITH {P}, {classes_sql('p', 'model, split')} SELECT model, split, n, {rounded_sql(*NUMBERS)} FROM sm")
def metric_summary(spark, sf):
    return rounded(X.summary(_classes(spark, sf, ["model", "split"]), ["model", "split"]), *NUMBERS)


@query(f"WITH {P}, {classes_sql('p', 'model, source')} SELECT model, source, n, {rounded_sql('accuracy', 'f1_macro', 'recall_macro')} FROM sm")
def per_source_metrics(spark, sf):
    return rounded(X.summary(_classes(spark, sf, ["model", "source"]), ["model", "source"]), *NUMBERS).select("model", "source", "n", "accuracy", "f1_macro", "recall_macro")


@query(f"""WITH {P}, s AS (SELECT model, y, unnest(range(4)) AS class, unnest(probs) AS score FROM p),
r AS (SELECT *, rank() OVER (PARTITION BY model, class ORDER BY score) + (count(*) OVER (PARTITION BY model, class, score) - 1) / 2 AS rk FROM s)
SELECT model, class::INT AS class, round((sum(rk) FILTER (y = class) - count(*) FILTER (y = class) * (count(*) FILTER (y = class) + 1) / 2) / (count(*) FILTER (y = class) * count(*) FILTER (y <> class)), 6) AS auc FROM r GROUP BY ALL""")
def roc_auc(spark, sf):
    return rounded(X.auc_ovr(predictions(spark, sf), K, ["model"]), "auc")


@query(f"""WITH {P}, s AS (SELECT model, y, unnest(range(4)) AS class, unnest(probs) AS score FROM p),
r AS (SELECT *, rank() OVER (PARTITION BY model, class ORDER BY score) + (count(*) OVER (PARTITION BY model, class, score) - 1) / 2 AS rk FROM s),
a AS (SELECT model, class, (sum(rk) FILTER (y = class) - count(*) FILTER (y = class) * (count(*) FILTER (y = class) + 1) / 2) / (count(*) FILTER (y = class) * count(*) FILTER (y <> class)) AS auc FROM r GROUP BY ALL)
SELECT model, round(avg(auc), 6) AS auc FROM a GROUP BY 1""")
def macro_roc_auc(spark, sf):
    return rounded(X.macro_auc(predictions(spark, sf), K, ["model"]), "auc")


@query(f"""WITH {P}, s AS (SELECT model, y, unnest(range(4)) AS class, unnest(probs) AS score FROM p WHERE split = 'test'),
c AS (SELECT model, class, score, count(*) AS m, count(*) FILTER (y = class) AS pos FROM s GROUP BY ALL),
n AS (SELECT *, lead(m) OVER w AS m2, lead(pos) OVER w AS pos2, row_number() OVER w AS i, sum(pos) OVER w AS tp, sum(m - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY model, class) AS np, sum(m - pos) OVER (PARTITION BY model, class) AS nn
 FROM c WINDOW w AS (PARTITION BY model, class ORDER BY score DESC))
SELECT model, class::INT AS class, round(score, 9) AS score, round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr FROM n WHERE i = 1 OR m2 IS NULL OR m <> m2 OR pos <> pos2
UNION ALL SELECT DISTINCT model, class::INT, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM n""")
def roc_curve(spark, sf):
    return X.roc_points(predictions(spark, sf).where("split = 'test'"), K, ["model"]).withColumns({c: F.round(c, d) for c, d in (("score", 9), ("tpr", 6), ("fpr", 6))})


@query(f"WITH {P} SELECT model, avg((len(list_filter(probs, lambda v: v > probs[y + 1])) < 2)::INT) AS top2, round(avg(-0.25 * (1 - probs[y + 1]) ** 2 * ln(probs[y + 1])), 6) AS focal FROM p GROUP BY 1")
def topk_and_focal(spark, sf):
    p = predictions(spark, sf)
    own = F.element_at("probs", F.col("y") + 1)
    return p.groupBy("model").agg(F.avg((F.size(F.filter("probs", lambda v: v > own)) < 2).cast("int")).alias("top2"), F.round(F.avg(S.focal_loss(F.col("probs"), F.col("y"))), 6).alias("focal"))


VOTE = f"""{classes_sql('p', 'model, split')}, w AS (SELECT model, f1_macro / sum(f1_macro) OVER () AS weight FROM sm WHERE split = 'val'),
e1 AS (SELECT record_id, y, [round(sum(weight * probs[1]), 12), round(sum(weight * probs[2]), 12), round(sum(weight * probs[3]), 12), round(sum(weight * probs[4]), 12)] AS q FROM p JOIN w USING (model) WHERE split = 'test' GROUP BY ALL),
e AS (SELECT 'ensemble' AS model, record_id, y, (list_position(q, list_max(q)) - 1)::INT AS pred FROM e1)"""


BOARD = ("accuracy", "f1_macro", "f1_weighted", "auc", "kappa", "mcc")


@query(f"""WITH {P}, {VOTE.replace("AS pred FROM e1", "AS pred, q FROM e1")}, a AS (SELECT model, y, pred, probs FROM p WHERE split = 'test' UNION ALL SELECT model, y, pred, q FROM e),
u AS (SELECT model, y, unnest(range(4)) AS class, unnest(probs) AS score FROM a), rk AS (SELECT *, rank() OVER (PARTITION BY model, class ORDER BY score) + (count(*) OVER (PARTITION BY model, class, score) - 1) / 2 AS rk FROM u),
ac AS (SELECT model, class, (sum(rk) FILTER (y = class) - count(*) FILTER (y = class) * (count(*) FILTER (y = class) + 1) / 2) / (count(*) FILTER (y = class) * count(*) FILTER (y <> class)) AS auc FROM rk GROUP BY ALL),
am AS (SELECT model, avg(auc) AS auc FROM ac GROUP BY 1), z AS (WITH {classes_sql('a', 'model')} SELECT * FROM sm)
SELECT model, n, {rounded_sql(*BOARD)} FROM z JOIN am USING (model)""")
def leaderboard(spark, sf):
    """Every model and the weighted vote on the test split, with all numbers of the comparison."""
    p = predictions(spark, sf)
    # both splits' counts in one pass: weights from val, the models' numbers from test
    scores = materialise(X.summary(X.per_class(X.confusion(p, K, ["model", "split"]), ["model", "split"]), ["model", "split"]), "scores")
    weights = X.ensemble_weights(scores.where("split = 'val'").select("model", "f1_macro")).select("model", "weight")
    test = p.where("split = 'test'")
    vote = X.soft_vote(test, weights, "model", "record_id", K).select(F.lit("ensemble").alias("model"), "y", F.transform("probs", lambda v: F.rint(v * 1e12) / 1e12).alias("probs"), "pred")
    vote = materialise(vote, "vote")
    own = X.summary(X.per_class(X.confusion(vote, K, ["model"]), ["model"]), ["model"])
    every = scores.where("split = 'test'").drop("split").unionByName(own)
    auc = X.macro_auc(test.select("model", "y", "probs").unionByName(vote.drop("pred")), K, ["model"])
    return rounded(every.join(auc, "model").select("model", "n", *BOARD), *BOARD)


@query(f"""WITH {P}, {classes_sql('p', 'model, split')}, b AS (SELECT * FROM sm WHERE split = 'test'),
r AS (SELECT *, row_number() OVER (ORDER BY round(accuracy, 6) DESC, model) AS position FROM b)
SELECT model, position::INT AS position, position = 1 AS best, 'this' AS run, {rounded_sql('accuracy', 'f1_macro', 'f1_weighted', 'kappa', 'mcc')} FROM r""")
def model_comparison(spark, sf):
    """Models by accuracy on the test split, with the runs that were measured on the same holdout."""
    board = rounded(X.summary(_classes(spark, sf, ["model", "split"]), ["model", "split"]).where("split = 'test'"), *NUMBERS).select("model", "accuracy", "f1_macro", "f1_weighted", "kappa", "mcc")
    other = board.withColumn("accuracy", F.lit(2.0))
    return X.ranked_models(X.same_holdout({"this": (board, "a"), "other": (other, "b")}, "a"), "accuracy")


@query(f"""WITH {P}, c AS (SELECT model, y, pred, count(*) AS n FROM p GROUP BY ALL), d AS (SELECT model, a.y::INT AS y, b.pred::INT AS pred FROM (SELECT DISTINCT model FROM p), range(4) a(y), range(4) b(pred)),
e AS (SELECT model, y, pred, coalesce(n, 0)::BIGINT AS n FROM d LEFT JOIN c USING (model, y, pred))
SELECT model, y, pred, n, round(CASE WHEN sum(n) OVER (PARTITION BY model, y) > 0 THEN n / sum(n) OVER (PARTITION BY model, y) ELSE 0 END, 6) AS share FROM e""")
def confusion_shares(spark, sf):
    return rounded(X.row_shares(X.confusion(predictions(spark, sf), K, ["model"]), ["model"]), "share")


B = """b AS (SELECT l_linestatus AS g, (l_returnflag = 'R')::INT AS y, round((l_quantity + CASE WHEN l_returnflag = 'R' THEN 10 ELSE 0 END) / 61, 6) AS s FROM lineitem),
pc AS (SELECT g, c, count(*) FILTER (y = c AND (s >= 0.5)::INT = c) AS tp, count(*) FILTER (y = c) AS support, count(*) FILTER ((s >= 0.5)::INT = c) AS predicted FROM b, range(2) t(c) GROUP BY ALL),
m AS (SELECT g, sum(support)::BIGINT AS n, sum(tp) / sum(support) AS accuracy, avg(tp / support) FILTER (support > 0) AS balanced_accuracy, avg(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END) AS f1_macro FROM pc GROUP BY 1),
r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2 AS rk FROM b),
a AS (SELECT g, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY 1)"""


@query(f"WITH {B} SELECT g AS l_linestatus, n, {rounded_sql('accuracy', 'balanced_accuracy', 'f1_macro', 'auc')} FROM m JOIN a USING (g)")
def binary_source_scores(spark, sf):
    is_r = F.col("l_returnflag") == "R"
    li = table(spark, sf, "lineitem").select("l_linestatus", is_r.cast("int").alias("y"), F.round((F.col("l_quantity") + F.when(is_r, 10).otherwise(0)) / 61, 6).alias("s"))
    return rounded(X.binary_scores(li, "y", "s", ["l_linestatus"]), "accuracy", "balanced_accuracy", "f1_macro", "auc")


@query("""WITH e AS (SELECT l_returnflag AS model, (l_linenumber % 3 + 1)::INT AS phase, (l_orderkey % 25)::INT AS epoch, round(avg(l_quantity), 6) AS val FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY val DESC, phase, epoch) AS k FROM e) SELECT model, phase AS chosen_phase, epoch, val AS best FROM r WHERE k = 1""")
def checkpoint_selection(spark, sf):
    log = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("phase"), (F.col("l_orderkey") % 25).cast("int").alias("epoch")).agg(F.round(F.avg("l_quantity"), 6).alias("val"))
    return X.chosen_phase(log, "model", "phase", "epoch", "val")


@query(f"WITH {P} SELECT model, record_id, [(y = 0)::INT, (y = 1)::INT, (y = 2)::INT, (y = 3)::INT] AS one_hot FROM p")
def label_binarize(spark, sf):
    return predictions(spark, sf).select("model", "record_id", S.one_hot(F.col("y"), K).alias("one_hot"))


@query(f"""WITH {P.replace("FROM p2)", "FROM p2 WHERE y <> 3)")}, {classes_sql('p', 'model')}, o AS (SELECT model, avg(f1) FILTER (support + predicted > 0) AS f1_macro FROM pr GROUP BY 1) SELECT model, round(f1_macro, 6) AS f1_macro FROM o""")
def present_classes_f1(spark, sf):
    """Macro-F1 over the classes that have rows or predictions, of records without the last class."""
    return rounded(X.summary(X.per_class(X.confusion(predictions(spark, sf).where("y <> 3"), K, ["model"]), ["model"]), ["model"], present_only=True), "f1_macro").select("model", "f1_macro")
