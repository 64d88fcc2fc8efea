"""What filters remove together: joint failures of all intersections, and from them every order at once.

For each part one pass counts, for each of the 32 sets of filters, the rows that fail all of its members, as sums of
products of flags (J). Everything else is arithmetic on these counts by inclusion and exclusion, without another
look at the rows:

- survivors of a set: the signed sum of J over its subsets;
- rows that fail a filter and no other: the signed sum of J over the sets that hold it;
- removed at a step: survivors before it less survivors after it; redundant: J of the filter less these;
- Shapley: J of a set, signed, is its Harsanyi dividend in the game "rows removed by these filters", and each
  member of the set has an equal share of it; times the number of orders all shares are whole.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curalith.operators.skew import join_groups
from curalith.storage import materialise

from ._names import unused

FILTERS = "ABCDE"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> dict[str, Column]:
    """Failures of A to D of a text (null is empty): few words, repeated words, capitals, marks."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, WORD_BREAK, -1), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long") > 3 * F.length(t).cast("long"),
        "D": t.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(part, A, B, C, D, E, good, toxic)`` of 0 and 1 for every row of ``docs``.

    E is failed by a row whose text some smaller id has too, in any part. Null and empty texts are one text; a null id
    is smaller than none and has no label; rows equal in id and text do not fail E by each other. A null part is the
    empty string. Of several labels of an id the greatest counts. Other columns are not read; an empty table gives an
    empty one.
    """
    id_, digest = unused([], "id", "digest")
    rows = docs.select(F.col(doc_id).alias(id_), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias(digest), *[f.cast("byte").alias(k) for k, f in text_flags(F.col(text)).items()])
    rows = materialise(rows, "flags")
    total = rows.count()
    groups = rows.groupBy(digest).agg(F.min(id_).alias("least"), F.count("*").alias("group_size")).where("group_size > 1")
    rows = join_groups(rows, materialise(groups, "copies"), total, digest, how="left")
    rows = rows.withColumn("E", F.coalesce(F.col(id_) > F.col("least"), F.lit(False)).cast("byte")).drop(digest, "least", "group_size")
    told = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(id_)).agg(*[F.max((F.col(c) == 1).cast("byte")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))], F.lit(1).alias("group_size"))
    # an id has few rows, but rows without one may be many: they stay out of the shuffle
    rows = join_groups(rows, told, total, id_, how="left").drop(id_, "group_size")
    return rows.withColumns({c: F.coalesce(c, F.lit(0).cast("byte")) for c in ("good", "toxic")})


def joint_failures(rows: DataFrame, filters: str = FILTERS, weights: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """``(part, n, n_<weight> ...)``: arrays over all sets of filters, as bit masks, of how many rows fail every member."""
    def products(weight: Column) -> list[Column]:
        out = []
        for mask in range(1 << len(filters)):
            p = weight
            for i, f in enumerate(filters):
                if mask >> i & 1:
                    p = p * F.col(f)
            out.append(F.sum(p.cast("long")))
        return out

    kinds = {"n": F.lit(1), **{f"n_{w}": F.col(w) for w in weights}}
    return rows.groupBy("part").agg(*[F.array(*products(w)).alias(k) for k, w in kinds.items()])


def _sign(mask: Column) -> Column:
    return F.when(F.bit_count(mask) % 2 == 0, 1).otherwise(-1)


def survivors(joint: Column, filters: str = FILTERS) -> Column:
    """An array over all sets of filters: rows that fail none of the members."""
    every = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))
    return F.transform(every, lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda acc, s: acc + F.when(s.bitwiseAND(m) == s, _sign(s) * F.get(joint, s)).otherwise(0)))


def only(joint: Column, filters: str = FILTERS) -> Column:
    """An array over filters: rows that fail this one and no other."""
    every = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))
    bits = F.array(*[F.lit(1 << i) for i in range(len(filters))])
    return F.transform(bits, lambda b: F.aggregate(every, F.lit(0).cast("long"), lambda acc, s: acc + F.when(s.bitwiseAND(b) == b, -_sign(s) * F.get(joint, s)).otherwise(0)))


def shapley(joint: Column, filters: str = FILTERS) -> Column:
    """An array over filters: the sum over all orders of what each removes, from equal shares in dividends."""
    every = F.sequence(F.lit(1), F.lit((1 << len(filters)) - 1))
    bits, orders = F.array(*[F.lit(1 << i) for i in range(len(filters))]), factorial(len(filters))
    share = lambda s: -_sign(s) * F.get(joint, s) * (orders / F.bit_count(s)).cast("long")
    return F.transform(bits, lambda b: F.aggregate(every, F.lit(0).cast("long"), lambda acc, s: acc + F.when(s.bitwiseAND(b) == b, share(s)).otherwise(0)))


def audit(joint: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from ``joint_failures``.

    ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley`` are all long;
    what does not occur is 0. Without parts there are no rows.
    """
    by = joint.select("part", "n", F.array(*[F.get("n", F.lit(1 << i)) for i in range(len(filters))]).alias("fails"), *[survivors(F.col(c), filters).alias(to) for c, to in (("n", "left"), ("n_good", "left_good"), ("n_toxic", "left_toxic"))], only(F.col("n"), filters).alias("alone"), shapley(F.col("n"), filters).alias("value"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = by.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    place = lambda i: F.position(F.col("filter_order").substr(i, F.lit(1)), F.lit(filters)) - 1
    bits = F.array(*[F.lit(1 << i) for i in range(len(filters))])
    taken = lambda upto: F.aggregate(F.sequence(F.lit(0), upto), F.lit(0), lambda m, i: F.when(i == 0, m).otherwise(m + F.element_at(bits, place(i) + 1)))
    steps = steps.withColumns({"f": place(F.col("step")), "before": taken(F.col("step") - 1), "after": taken(F.col("step"))})
    gone = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    return steps.select(
        "part", "filter_order", "step", F.get("left", F.col("after")).alias("kept"), gone("left").alias("removed"),
        (F.get("fails", F.col("f")) - gone("left")).alias("redundant"), F.get("alone", F.col("f")).alias("unique_fails"),
        gone("left_good").alias("good_lost"), gone("left_toxic").alias("toxic_lost"), F.get("value", F.col("f")).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of ``documents`` by ``lang`` with ``labels``; odd inputs as stated in :func:`flagged`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audit(materialise(joint_failures(flagged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))), "joint-failures"))


QUERIES = {"op12_filter_audit": op12_filter_audit}
#: Counts by pattern of failures, walked order by order and step by step.
ORACLE = {
    "op12_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT t.part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
             regexp_matches(text, '[#$%&*|]'), coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS fails,
             coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
p AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, fails),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || h.c AS filter_order FROM c a, c b, c d, c e, c h WHERE len(list_distinct([a.c, b.c, d.c, e.c, h.c])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
w AS (SELECT *, substr(filter_order, step, 1) AS letter, ascii(substr(filter_order, step, 1)) - 64 AS i,
             list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda q: ascii(q) - 64) AS earlier FROM s),
r AS (SELECT p.*, w.*, fails[i] AS own, len(list_filter(earlier, lambda q: q > 0 AND fails[q])) > 0 AS gone, len(list_filter(fails, lambda q: q)) AS k FROM p, w),
a AS (SELECT part, filter_order, step, letter,
             coalesce(sum(n) FILTER (NOT gone AND NOT own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND own), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (gone AND own), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND k = 1), 0)::BIGINT AS unique_fails,
             coalesce(sum(g) FILTER (NOT gone AND own), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (NOT gone AND own), 0)::BIGINT AS toxic_lost
      FROM r GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM a"""
}
