"""Exact order statistics by groups, of which one may hold most of the rows: selection by narrowing histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curalith.storage import materialise

STEPS = 1024
#: An interval with so many rows at most is put in order; others are narrowed.
SORTABLE = 20_000
#: Up to so many intervals are broadcast; more meet their rows by a shuffle.
FEW = 10_000
#: Intervals over more powers of two than this are divided by these, others evenly.
WIDE = 4


def _octave(x: Column) -> Column:
    """A scale on which every power of two is one step from the next, for any sign; it never falls as x rises."""
    return F.signum(x) * (F.greatest(F.log2(F.abs(x)), F.lit(-1074.0)) + 1075)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_{k}"])
    return out


def _aside(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in df.columns])


def exact_percentiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float], log: list[dict] | None = None, sortable: int = SORTABLE) -> DataFrame:
    """``by`` and a column for each of ``points`` (name to share): percentiles with linear interpolation, as doubles.

    Each wanted place of each group is found in a histogram of its interval, which starts as the group's range; the step
    that holds it is the next interval, until that has one value or few rows, which are put in order. Counts are formed
    before the shuffle, so no task gets a group's values. Null and NaN values do not count; a group without others has no row; null
    keys form a group. ``log`` receives how many rows were counted and put in order.
    """
    keys = [f"k{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    r = materialise(rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")), "values")
    sizes = materialise(r.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    wanted = sizes.select("*", F.explode(F.array(*[F.lit(float(p)) for p in points.values()])).alias("p")).withColumn("x", (F.col("n") - 1) * F.col("p"))
    places = wanted.select(*keys, "n", "lo", "hi", F.explode(F.array(F.floor("x"), F.ceil("x"))).alias("rank")).distinct()
    open_ = materialise(places.withColumn("at", F.col("rank")).withColumnRenamed("n", "c"), "places")
    found = None

    def add(more: DataFrame) -> None:
        nonlocal found
        found = more if found is None else found.unionByName(more)

    def within(part: DataFrame) -> DataFrame:
        spans = _aside(part.select(*keys, "lo", "hi").distinct(), keys)
        small = spans.limit(FEW + 1).count() <= FEW
        return r.join(F.broadcast(spans) if small else spans, _same(r, spans, keys)).where("v between lo and hi").select(*keys, "lo", "hi", "v")

    last = None
    while True:
        add(open_.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value")))
        left = open_.where("lo < hi")
        state = left.agg(F.count("*"), F.sum("c")).first()
        small = left if state == last else left.where(F.col("c") <= sortable)  # a span that floats cannot divide further is put in order too
        if state[0]:
            ordered = within(small).withColumn("i", F.row_number().over(Window.partitionBy(*keys, "lo", "hi").orderBy("v")) - 1)
            ordered = _aside(ordered, [*keys, "lo", "hi"])
            ask = small.select(*keys, "lo", "hi", "at", "rank")
            add(materialise(ask.join(ordered, _same(ask, ordered, [*keys, "lo", "hi"]) & (F.col("at") == F.col("i"))).select(*keys, "rank", F.col("v").alias("value")), "ordered"))
        big = left.where(F.col("c") > sortable)
        if state == last or big.isEmpty():
            break
        last = state
        low, high = _octave(F.col("lo")), _octave(F.col("hi"))
        even = (F.col("v") - F.col("lo")) / F.greatest(F.col("hi") / STEPS - F.col("lo") / STEPS, F.lit(5e-324))
        step = F.least(F.floor(F.when(high - low > WIDE, (_octave(F.col("v")) - low) / ((high - low) / STEPS)).otherwise(even)), F.lit(STEPS - 1))
        counts = within(big).groupBy(*keys, "lo", "hi", step.alias("step")).agg(F.count("*").alias("m"), F.min("v").alias("a"), F.max("v").alias("b"))
        counts = counts.withColumn("before", F.sum("m").over(Window.partitionBy(*keys, "lo", "hi").orderBy("step")) - F.col("m"))
        counts = _aside(materialise(counts, "steps"), [*keys, "lo", "hi"])
        if log is not None:
            log.append({"places": big.count(), "steps": counts.count()})
        hit = big.join(counts, _same(big, counts, [*keys, "lo", "hi"]) & (F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("m")))
        open_ = materialise(hit.select(*keys, F.col("m").alias("c"), F.col("a").alias("lo"), F.col("b").alias("hi"), "rank", (F.col("at") - F.col("before")).alias("at")), "places")
    found = _aside(materialise(found, "found"), keys)
    ends = wanted.join(found, _same(wanted, found, keys) & ((F.col("rank") == F.floor("x")) | (F.col("rank") == F.ceil("x"))))
    value_ = F.min("value") + (F.max("value") - F.min("value")) * (F.first("x") - F.floor(F.first("x")))
    each = ends.groupBy(*keys, "p").agg(value_.alias("value"))
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for name, p in points.items()]).select(*[F.col(k).alias(c) for k, c in zip(keys, by)], *points)
