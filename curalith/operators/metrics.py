"""Classification metrics as aggregates over predictions ``(by..., y, pred, probs)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from curalith.storage import materialise


def confusion(pred: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Dense counts ``(by..., y, pred, n)`` over labels 0 to k - 1. Predictions are read once: what each key counts is
    at most k * k numbers, among which its dense grid is looked up."""
    counts = pred.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))
    grid = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * k + F.col("pred")).alias("key"), F.col("n").alias("value")))).alias("_cells"))
    cells = grid.select(*by, "_cells", F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("_i"))
    return cells.select(*by, F.floor(F.col("_i") / k).cast("int").alias("y"), (F.col("_i") % k).cast("int").alias("pred"), F.coalesce(F.element_at("_cells", F.col("_i")), F.lit(0)).cast("long").alias("n"))


def row_shares(conf: DataFrame, by: list[str]) -> DataFrame:
    """A confusion matrix with each row's shares; 0 in a row without counts."""
    total = F.sum("n").over(Window.partitionBy(*by, "y"))  # k cells
    return conf.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def per_class(conf: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined."""
    c = conf.select(*by, F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(0).alias("side"), "n", (F.col("y") == F.col("pred")).alias("hit")), F.struct(F.col("pred").alias("c"), F.lit(1).alias("side"), "n", F.lit(False).alias("hit")))).alias("x")).select(*by, "x.*")
    m = c.groupBy(*by, "c").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("predicted"))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f = F.when(F.col("support") + F.col("predicted") > 0, 2 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return m.select(*by, F.col("c").alias("class"), "tp", "support", "predicted", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def summary(classes: DataFrame, by: list[str], present_only: bool = False) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted averages, Cohen's kappa and the multiclass MCC. With
    ``present_only`` macro-F1 leaves out classes without rows and predictions."""
    n, seen = F.sum("support"), F.col("support") + F.col("predicted") > 0
    s, t, p = F.col("n"), F.col("support"), F.col("predicted")
    agg = classes.groupBy(*by).agg(
        n.alias("n"), F.sum("tp").alias("c"), F.sum(t * p).cast("double").alias("tp_"), F.sum(t * t).cast("double").alias("tt"), F.sum(p * p).cast("double").alias("pp"),
        F.avg(F.when(t > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg(F.when(seen, F.col("f1")) if present_only else F.col("f1")).alias("f1_macro"), (F.sum(F.col("f1") * t) / n).alias("f1_weighted"),
    )
    pe = F.col("tp_") / (s * s)
    acc = F.col("c") / s
    den = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    mcc = F.when(den > 0, (F.col("c") * s - F.col("tp_")) / den).otherwise(0.0)
    return agg.select(*by, "n", acc.alias("accuracy"), "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted", F.when(pe < 1, (acc - pe) / (1 - pe)).otherwise(0.0).alias("kappa"), mcc.alias("mcc"))


#: Parts of the range of scores in which cumulated counts are formed.
BUCKETS = 4096


def _cumulated(rows: DataFrame, by: list[str], down: bool = False) -> DataFrame:
    """Counts ``(by..., score, _m, _pos)`` of distinct scores with ``_cum`` and ``_cum_pos``, what lies at or below (above)
    each, and the totals ``_n`` and ``_np``. Sums are formed over buckets of scores first, then within each, so that
    no task sorts all scores of a key. ``rows`` has ``score`` and ``hit``."""
    c = materialise(rows.groupBy(*by, "score").agg(F.count("*").alias("_m"), F.count_if("hit").alias("_pos")), "score-counts")
    c = c.withColumn("_b", F.least(F.greatest(F.floor(F.col("score") * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int"))
    per = c.groupBy(*by, "_b").agg(F.sum("_m").alias("_bm"), F.sum("_pos").alias("_bp"))
    key = Window.partitionBy(*by)
    order = key.orderBy(F.desc("_b") if down else F.col("_b"))
    per = per.select(*[F.col(x).alias(f"_{i}") for i, x in enumerate(by)], F.col("_b").alias("_ob"), (F.sum("_bm").over(order) - F.col("_bm")).alias("_om"), (F.sum("_bp").over(order) - F.col("_bp")).alias("_op"), F.sum("_bm").over(key).alias("_n"), F.sum("_bp").over(key).alias("_np"))
    w = Window.partitionBy(*by, "_b").orderBy(F.desc("score") if down else F.col("score"))
    c = c.withColumn("_cum", F.sum("_m").over(w)).withColumn("_cum_pos", F.sum("_pos").over(w))
    same = F.col("_b") == F.col("_ob")
    for i, x in enumerate(by):
        same = same & F.col(x).eqNullSafe(F.col(f"_{i}"))
    return c.join(per, same).withColumns({"_cum": F.col("_cum") + F.col("_om"), "_cum_pos": F.col("_cum_pos") + F.col("_op")}).select(*by, "score", "_m", "_pos", "_cum", "_cum_pos", "_n", "_np")


def _auc(rows: DataFrame, by: list[str]) -> DataFrame:
    c = _cumulated(rows, by)
    rank = F.col("_cum") - F.col("_m") + (F.col("_m") + 1) / 2
    a = c.groupBy(*by).agg(F.sum(rank * F.col("_pos")).alias("rs"), F.first("_np").alias("_np"), F.first("_n").alias("_n"))
    q = F.col("_n") - F.col("_np")
    return a.select(*by, F.when((F.col("_np") > 0) & (q > 0), (F.col("rs") - F.col("_np") * (F.col("_np") + 1) / 2) / (F.col("_np") * q)).alias("auc"))


def _one_vs_rest(pred: DataFrame, k: int, by: list[str]) -> DataFrame:
    # the outer form: else the optimizer repeats what makes the array in a filter on its size
    rows = pred.select(*by, "y", F.posexplode_outer("probs").alias("class", "score")).where(F.col("class") < k)
    return rows.select(*by, "class", "score", (F.col("y") == F.col("class")).alias("hit"))


def auc_ovr(pred: DataFrame, k: int, by: list[str]) -> DataFrame:
    """One-vs-rest ROC AUC of each class by tied ranks; null where one side is empty."""
    return _auc(_one_vs_rest(pred, k, by), [*by, "class"])


def binary_scores(rows: DataFrame, label: str, score: str, by: list[str], cut: float = 0.5) -> DataFrame:
    """For a binary label and the score of 1: rows, accuracy, balanced accuracy, macro-F1 at the cut, and ROC AUC
    (null where one side is empty)."""
    one = rows.select(*by, F.col(label).cast("int").alias("y"), F.col(score).alias("score")).withColumn("pred", (F.col("score") >= cut).cast("int"))
    at_cut = summary(per_class(confusion(one, 2, by), by), by).select(*by, "n", "accuracy", "balanced_accuracy", "f1_macro")
    return at_cut.join(_auc(one.select(*by, "score", (F.col("y") == 1).alias("hit")), by), by)


def macro_auc(pred: DataFrame, k: int, by: list[str]) -> DataFrame:
    """``(by..., auc)``: the mean over all k classes of the one-vs-rest ROC AUC; null if any class has none."""
    return auc_ovr(pred, k, by).groupBy(*by).agg(F.when(F.count("auc") == k, F.avg("auc")).alias("auc"))


def roc_points(pred: DataFrame, k: int, by: list[str], drop: bool = True) -> DataFrame:
    """``(by..., class, score, tpr, fpr)``: the curve from the origin, whose score is null, over distinct scores from the
    highest down. With ``drop`` points go whose step (in hits and in others) is the same as the next one's, since the line
    runs straight through them; the first and the last score stay. Scores are told apart as they are. The next score of a
    bucket's last one is the first of the next bucket that has any, so no task gets a curve. Shares of an empty side are null."""
    keys = [*by, "class"]
    c = _cumulated(_one_vs_rest(pred, k, by), keys, down=True)
    if drop:
        bucket = F.least(F.greatest(F.floor(F.col("score") * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")
        c = c.withColumn("_b", bucket)
        step = F.struct("_m", "_pos")
        heads = c.groupBy(*keys, "_b").agg(F.max_by(step, "score").alias("_head"))  # keys x buckets at most
        heads = heads.withColumn("_after", F.lead("_head").over(Window.partitionBy(*keys).orderBy(F.desc("_b")))).withColumn("_top", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_b"))) == 1)
        heads = heads.select(*[F.col(x).alias(f"_k{i}") for i, x in enumerate(keys)], F.col("_b").alias("_hb"), "_after", "_top")
        same = F.col("_b") == F.col("_hb")
        for i, x in enumerate(keys):
            same = same & F.col(x).eqNullSafe(F.col(f"_k{i}"))
        w = Window.partitionBy(*keys, "_b").orderBy(F.desc("score"))
        c = c.withColumns({"_next": F.lead(step).over(w), "_i": F.row_number().over(w)}).join(heads, same)
        straight = F.coalesce(F.coalesce("_next", "_after") == step, F.lit(False)) & ~(F.col("_top") & (F.col("_i") == 1))
        c = c.where(~straight)
    tpr, fpr = F.col("_cum_pos") / F.col("_np"), (F.col("_cum") - F.col("_cum_pos")) / (F.col("_n") - F.col("_np"))
    sides = c.groupBy(*keys).agg(F.first("_n").alias("_n"), F.first("_np").alias("_np"))
    zero = sides.select(*keys, F.lit(None).cast("double").alias("score"), F.when(F.col("_np") > 0, 0.0).alias("tpr"), F.when(F.col("_n") > F.col("_np"), 0.0).alias("fpr"))
    return c.select(*keys, "score", F.when(F.col("_np") > 0, tpr).alias("tpr"), F.when(F.col("_n") > F.col("_np"), fpr).alias("fpr")).unionByName(zero)


def ranked_models(board: DataFrame, metric: str, model: str = "model") -> DataFrame:
    """A comparison with each model's ``position`` by the metric, the name deciding ties, and whether it is ``best``."""
    w = Window.orderBy(F.col(metric).desc_nulls_last(), F.col(model))  # a row a model
    return board.withColumn("position", F.row_number().over(w)).withColumn("best", F.col("position") == 1)


def same_holdout(boards: dict[str, tuple[DataFrame, str]], fingerprint: str) -> DataFrame:
    """Comparisons of several runs as one, with ``run``: only of those whose holdout has the given fingerprint."""
    out = None
    for run, (board, own) in boards.items():
        if own == fingerprint:
            part = board.withColumn("run", F.lit(run))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no run was measured on this holdout")
    return out


def chosen_phase(log: DataFrame, model: str, phase: str, epoch: str, metric: str) -> DataFrame:
    """For each model the phase with the best epoch by the metric, the first of equals, and that epoch, the first of
    equals. A model with a phase that has no metric at all is refused."""
    best = log.groupBy(model, phase).agg(F.max(metric).alias("score"), F.min(F.struct((-F.col(metric)).alias("s"), F.col(epoch).alias("e"))).alias("at"))
    missing = best.where(F.col("score").isNull()).limit(1).collect()
    if missing:
        raise ValueError(f"no {metric} in phase {missing[0][phase]} of {missing[0][model]}")
    top = F.min(F.struct((-F.col("score")).alias("s"), F.col(phase).alias("p"), F.col("at.e").alias("e")))
    return best.groupBy(model).agg(top.alias("t")).select(model, F.col("t.p").alias("chosen_phase"), F.col("t.e").alias("epoch"), (-F.col("t.s")).alias("best"))


def soft_vote(preds: DataFrame, weights: DataFrame, model: str, record: str, k: int) -> DataFrame:
    """Weighted mean of the models' probabilities for each record, and its first maximum."""
    from curalith.functions.scalar import argmax

    x = preds.join(F.broadcast(weights), model)  # a row for each model
    sums = [F.sum(F.col("weight") * F.element_at("probs", i + 1)).alias(f"p{i}") for i in range(k)]
    out = x.groupBy(record, "y").agg(*sums).withColumn("probs", F.array(*[F.col(f"p{i}") for i in range(k)]))
    return out.select(record, "y", "probs", argmax(F.transform("probs", lambda v: F.rint(v * 1e12))).alias("pred"))


def ensemble_weights(scores: DataFrame, score: str = "f1_macro") -> DataFrame:
    """Weights in proportion to a validation score; equal if the sum is not positive."""
    w = Window.partitionBy()
    total = F.sum(score).over(w)
    return scores.withColumn("weight", F.when(total > 0, F.col(score) / total).otherwise(1.0 / F.count("*").over(w)))
