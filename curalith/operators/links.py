"""Links between codes and vectors: near-duplicate pairs, nearest of another source, greedy acceptance, quarantine.

Equal codes are one class: pairs are found between classes, named by their least id, and members hang on that id as a
star. A group of copies so costs as many rows as it has members.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from curalith.operators import metric
from curalith.operators.hamming import nearest_distance
from curalith.storage import materialise


#: Mean number of keyed rows of a task in the search for conflicts.
KEYED = 500_000


def _bands(code: Column, bits: int, n: int) -> list[Column]:
    edges = [round(i * bits / n) for i in range(n + 1)]
    return [F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(edges, edges[1:])]


def _first_key(a: Column, b: Column, bits: int, most: int, extra: int) -> Column:
    """The place in ``_keys`` of the first key that two codes share."""
    same = [x == 0 for x in _bands(a.bitwiseXOR(b), bits, most + extra)]
    return F.coalesce(*[F.when(reduce(and_, [same[j] for j in some]), F.lit(i)) for i, some in enumerate(combinations(range(most + extra), extra))])


def _keys(code: Column, bits: int, most: int, extra: int) -> Column:
    """Keys of which two codes at most ``most`` bits apart share one: of ``most + extra`` bands, any ``extra`` that
    are equal. More bands make keys longer and more, so that unrelated codes meet less."""
    n = most + extra
    bands = _bands(code, bits, n)
    return F.array(*[F.xxhash64(F.lit(i), *[bands[j] for j in some]) for i, some in enumerate(combinations(range(n), extra))])


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))).cast("int")


def code_pairs(left: DataFrame, right: DataFrame, bits: int, most: int, extra: int = 2) -> DataFrame:
    """``(left, right, distance)`` of distinct codes ``(code)`` of either side at most ``most`` bits apart, exactly."""
    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("code").alias(name)).where("code is not null").distinct().select(name, F.explode(_keys(F.col(name), bits, most, extra)).alias("key"))

    pairs = keyed(left, "left").join(keyed(right, "right"), "key").withColumn("distance", _distance("left", "right"))
    return pairs.where(F.col("distance") <= most).select("left", "right", "distance").distinct()


def hamming_links(rows: DataFrame, node: str, codes: list[str], bits: int, most: int, extra: int = 2) -> DataFrame:
    """``(src, dst, distance, plain)``: links of rows whose codes lie at most ``most`` bits apart.

    ``codes`` are a picture as it is and, if given, in further orientations: the distance is the least between the
    first code of one and any of the other's; ``plain`` is that of the first codes. Rows equal in all codes are linked
    as a star with their least id, others by these ids. Rows with a null code have no links.
    """
    known = rows.select(F.col(node).alias("id"), F.array(*codes).alias("cs")).where(F.forall("cs", lambda c: c.isNotNull()))
    classes = materialise(known.groupBy("cs").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "code-classes")
    first = classes.select("rep", F.get("cs", F.lit(0)).alias("code"))
    every = classes.select("rep", F.explode("cs").alias("code"))
    pairs = code_pairs(first, every, bits, most, extra)
    met = pairs.join(first.select(F.col("rep").alias("a"), F.col("code").alias("left")), "left").join(every.select(F.col("rep").alias("b"), F.col("code").alias("right")).distinct(), "right").where("a <> b")
    met = met.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("distance").alias("distance"))
    met = met.join(first.select(F.col("rep").alias("src"), F.col("code").alias("x")), "src").join(first.select(F.col("rep").alias("dst"), F.col("code").alias("y")), "dst")
    between = met.select("src", "dst", "distance", _distance("x", "y").alias("plain"))
    star = known.join(classes.where("n > 1"), "cs").where("id <> rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("distance"), F.lit(0).alias("plain"))
    return between.unionByName(star)


def nearest_code(query: DataFrame, reference: DataFrame, node: str, codes: list[str], bits: int = 64) -> DataFrame:
    """``(node, nearest)``: the least distance of each query row to any reference row, however large, over all
    orientations as in ``hamming_links``; null for a row without a code, or where there is no reference row.

    The first code asks all orientations of the reference; what that finds bounds the search of the others."""
    side = lambda df, cs: df.select(F.explode(F.array(*cs)).alias("code"))
    q = materialise(query.select(F.col(node).alias("id"), F.array(*codes).alias("cs")), "queries")
    r = materialise(reference.select(*codes), "references")
    own = q.select("id", F.get("cs", F.lit(0)).alias("code"))
    best = own.join(nearest_distance(own, side(r, codes), bits), "code").select("id", "nearest")
    if len(codes) > 1:
        best = materialise(best, "nearest")
        more = q.join(best, "id").select("id", F.explode(F.slice("cs", 2, len(codes) - 1)).alias("code"), F.col("nearest").alias("bound"))
        turned = nearest_distance(more, side(r, codes[:1]), bits)
        best = best.unionByName(more.join(turned, "code").select("id", "nearest"))
    best = best.groupBy("id").agg(F.min("nearest").alias("nearest"))
    return q.select("id").join(best, "id", "left").select(F.col("id").alias(node), "nearest")


def accept_in_order(rows: DataFrame, by: str, order: str, code: str, bits: int, most: int, max_rounds: int = 1000) -> DataFrame:
    """``rows`` with ``accepted``: in each class and in order, a row is accepted if no accepted earlier one lies within
    ``most`` bits. Rows without a code are not accepted.

    Only conflicts are walked: in each round a row whose earlier neighbours have all been rejected is accepted, and
    its later neighbours are rejected. Of equal codes only the first can ever be accepted, so copies are no neighbours.
    Rounds are as many as the longest chain of rows that decide each other.
    """
    known = rows.select(F.col(by).alias("k"), F.col(order).alias("o"), F.col(code).alias("c")).where("c is not null")
    first = materialise(known.groupBy("k", "c").agg(F.min("o").alias("o")), "first-codes")
    # a class as text without nulls; tasks are as many as their rows need, and a pair is taken at its first common key
    keyed = first.select(F.coalesce(F.concat(F.lit("="), F.col("k").cast("string")), F.lit("")).alias("g"), "k", "o", "c", F.posexplode(_keys(F.col("c"), bits, most, 2)).alias("i", "key"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-first.count() * comb(most + 2, 2) // KEYED))
    keyed = keyed.repartition(parts, "i", "g", "key")  # all keys of the join, or it deals them anew
    pairs = keyed.alias("a").join(keyed.alias("b").hint("merge"), (F.col("a.i") == F.col("b.i")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.o") < F.col("b.o")))
    pairs = pairs.where((F.bit_count(F.col("a.c").bitwiseXOR(F.col("b.c"))) <= most) & (F.col("a.i") == _first_key(F.col("a.c"), F.col("b.c"), bits, most, 2)))
    pairs = pairs.select(F.col("a.k").alias("k"), F.col("a.o").alias("u"), F.col("b.o").alias("v"))
    left = materialise(pairs, "conflicts")
    rejected = left.select("k", F.col("v").alias("o")).limit(0)
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        # earlier ends that are no later end of a conflict left are accepted; what conflicts with them goes
        later = left.select(F.col("k").alias("k2"), F.col("v").alias("v2")).distinct()
        sure = left.join(later, F.col("k").eqNullSafe(F.col("k2")) & (F.col("u") == F.col("v2")), "left_anti")
        gone = materialise(sure.select("k", F.col("v").alias("o")).distinct(), "rejected")
        rejected = rejected.unionByName(gone)
        cut = gone.select(F.col("k").alias("k2"), F.col("o").alias("o2"))
        same = F.col("k").eqNullSafe(F.col("k2"))
        left = left.join(cut, same & (F.col("v") == F.col("o2")), "left_anti").join(cut, same & (F.col("u") == F.col("o2")), "left_anti")
        left = materialise(left, "conflicts")
    else:
        raise RuntimeError("acceptance did not settle")
    cut = rejected.select(F.col("k").alias("k2"), F.col("o").alias("o2"))
    accepted = first.join(cut, F.col("k").eqNullSafe(F.col("k2")) & (F.col("o") == F.col("o2")), "left_anti").select(F.col("k").alias("_k"), F.col("o").alias("_o"), F.lit(True).alias("_yes"))
    out = rows.join(accepted, F.col(by).eqNullSafe(F.col("_k")) & (F.col(order) == F.col("_o")), "left")
    return out.withColumn("accepted", F.coalesce("_yes", F.lit(False))).drop("_k", "_o", "_yes")


def quarantine(rows: DataFrame, group: str, cls: str, near: Column) -> DataFrame:
    """``status`` of each row by its whole group: of several classes, near the other source, both, or eligible."""
    by = rows.groupBy(F.col(group).alias("_g")).agg((F.min(cls) != F.max(cls)).alias("_mixed"), F.bool_or(F.coalesce(near, F.lit(False))).alias("_near"))
    out = rows.join(by, F.col(group).eqNullSafe(F.col("_g")))
    status = F.when(F.col("_mixed") & F.col("_near"), "quarantined_cross_class_and_real_group").when(F.col("_near"), "quarantined_near_real_group").when(F.col("_mixed"), "quarantined_cross_class_group").otherwise("eligible")
    return out.withColumn("status", status).drop("_g", "_mixed", "_near")


def _mean(rows: DataFrame, vector: str) -> np.ndarray:
    dims = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i")
    return np.array([r["m"] for r in dims.collect()])  # one number for each dimension


def dimensions(rows: DataFrame, vector: str) -> int:
    some = rows.select(F.size(vector).alias("d")).where("d >= 0").first()  # null has the size -1
    return some["d"] if some else 0


def cosine_links(rows: DataFrame, node: str, vector: str, least: float, mirror: str | None = None, cell: int = metric.CELL, log: list[dict] | None = None, forest: bool = False, whole: bool = False) -> DataFrame:
    """``(src, dst, score)``, src < dst: pairs of mean-centred vectors whose cosine is at least ``least``, exactly, by a
    metric partition (see ``metric``).

    With ``mirror``, the vector of the mirrored picture, the score is the greater of the earlier row's vector with the later
    row's and with its mirror; both are centred by the mean of the plain vectors. With a mirror or ``whole`` all pairs of rows are returned,
    copies too: a score with a mirror depends on which row is the earlier, so no row can stand for its copies. Otherwise
    rows equal in their vectors are linked as a star with their least id, others by these ids, so copies cost as many rows as
    they are. Rows without a vector have no links, nor have vectors equal to the mean unless ``least`` is 0 or below. ``node`` is
    a key. ``log`` receives how many pairs were compared. With ``forest`` links come thinned, to such as connect at every
    threshold what all connect.
    """
    dims = dimensions(rows, vector)
    if not dims:
        return rows.sparkSession.createDataFrame([], "src long, dst long, score double")
    items = materialise(metric.packed(rows, node, [vector, *([mirror] if mirror else [])], _mean(rows, vector)), "units")
    if mirror or whole:
        return metric.pairs_within(metric.gathered(items), dims, least, cell, metric.CELL, log, forest)
    reps, star = metric.classes(items)
    zero = F.get("vs", F.lit(0)) == F.lit(bytes(8 * dims))
    copies = star.select(F.col("rep").alias("src"), F.col("id").alias("dst"), F.when(zero, 0.0).otherwise(1.0).alias("score")).where(F.col("score") >= least)
    return metric.pairs_within(reps, dims, least, cell, metric.CELL, log, forest).unionByName(copies)
