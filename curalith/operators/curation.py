"""Duplicates, quarantine, splits, sampling and constraints over manifests."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from curalith.operators.order import positions, shuffled_positions
from curalith.operators.skew import join_groups
from curalith.storage import materialise


def _with_groups(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``join_groups`` for groups with their size in ``_n``, which is dropped."""
    groups = materialise(groups.where(F.col(key).isNotNull()), "groups")
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return join_groups(rows, groups, total, key, "_n", how).drop("_n")


def resolve_exact(pool: DataFrame, digest: str, cls: str, split: str, key: str, priority=("test", "val", "train")) -> DataFrame:
    """``pool`` with ``reason``: null for rows that stay; rows of a digest under several classes all go
    (conflicting_label), else the row of the first split, then least key, stays (others: exact_duplicate). Splits that
    ``priority`` does not name come after those it does; rows without a digest stay. Digests of very many rows, such as that of
    empty files, are broadcast and shuffle no rows."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(split))
    rank = F.when(place > 0, place).otherwise(len(priority) + 1)
    by = pool.groupBy(digest).agg(F.count("*").alias("_n"), (F.min(cls) != F.max(cls)).alias("_mixed"), F.min(F.struct(rank.alias("r"), F.col(key).alias("k"))).alias("_keep"))
    rows = _with_groups(pool, by.where("_n > 1"), digest, "left")
    reason = F.when(F.col("_mixed"), "conflicting_label").when(F.struct(rank.alias("r"), F.col(key).alias("k")) != F.col("_keep"), "exact_duplicate")
    return rows.withColumn("reason", reason).drop("_mixed", "_keep")


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Flags rows after the first of each key; keys may hold most rows."""
    least = rows.groupBy(key).agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    return _with_groups(rows, least, key).withColumn("duplicate", F.col(order) != F.col("_first")).drop("_first")


def star_edges(rows: DataFrame, key: str, node: str) -> DataFrame:
    """Links of each row with the least of its key: as many as rows, not pairs; keys may hold most rows."""
    least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(node).alias("src"), F.count("*").alias("_n"))
    return _with_groups(rows.select(key, node), least.where("_n > 1"), key).select("src", F.col(node).alias("dst")).where("src <> dst")


def quarantine_cross_class(rows: DataFrame, group: str, cls: str) -> DataFrame:
    """``status``: quarantined_cross_class for all rows of a group that has several classes, else eligible; groups may hold
    most rows."""
    by = rows.groupBy(group).agg((F.min(cls) != F.max(cls)).alias("_mixed"), F.count("*").alias("_n"))
    return _with_groups(rows, by, group).withColumn("status", F.when(F.col("_mixed"), "quarantined_cross_class").otherwise("eligible")).drop("_mixed")


def stratified_split(rows: DataFrame, cls: str, key: str, seed: str, shares: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """``split`` by position in a keyed order of each class: exact shares, also of a class that holds most rows."""
    h = shuffled_positions(rows, [cls], key, seed)
    pos, n = F.col("_pos"), F.col("_n")
    a, b = F.bround(n * shares[0]), F.bround(n * (shares[0] + shares[1]))
    return h.withColumn("split", F.when(pos <= a, "train").when(pos <= b, "val").otherwise("test")).drop("_pos", "_n")


def _shuffled(groups: DataFrame, group: str, seed: str, number: Column) -> DataFrame:
    """``groups`` with ``try`` and ``h``, the place in that shuffle's order."""
    out = groups.withColumn("try", number)
    return out.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("try").cast("string"), F.col(group).cast("string"))))


def held_classes(groups: DataFrame, group: str, tries: int, seed: str, first: int, digits: int = 3, log: dict | None = None) -> DataFrame:
    """``(try, c, n)``: rows by class of the first ``first`` groups of each keyed shuffle, from groups with their class counts
    ``cs`` (array of structs c, n). No shuffle is sorted: groups are counted by (try, bucket of the hash, class) before they
    leave a task, and only the groups of the bucket in which a try's boundary falls are put in order."""
    every = F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))
    tried = _shuffled(groups, group, seed, every).withColumn("bucket", F.substring("h", 1, digits))
    counts = tried.select("try", "bucket", F.posexplode("cs").alias("i", "x")).groupBy("try", "bucket", F.col("x.c").alias("c")).agg(F.sum("x.n").alias("n"), F.count_if(F.col("i") == 0).alias("g"))
    counts = materialise(counts, "try-histograms")  # tries x buckets x classes at most
    by = counts.groupBy("try", "bucket").agg(F.sum("g").alias("g")).withColumn("upto", F.sum("g").over(Window.partitionBy("try").orderBy("bucket")))
    by = materialise(by, "try-buckets")
    edge = by.where((F.col("upto") > first) & (F.col("upto") - F.col("g") < first)).select("try", "bucket", (first - F.col("upto") + F.col("g")).alias("r"))
    whole = counts.join(by.where(F.col("upto") <= first).select("try", "bucket"), ["try", "bucket"]).select("try", "c", "n")
    cut = tried.join(F.broadcast(edge), ["try", "bucket"])  # a row for each try
    if log is not None:
        log |= {"counted": counts.count(), "ordered": cut.count()}
    cut = cut.withColumn("k", F.row_number().over(Window.partitionBy("try").orderBy("h", group))).where("k <= r")
    return whole.unionByName(cut.select("try", F.explode("cs").alias("x")).select("try", "x.c", "x.n")).groupBy("try", "c").agg(F.sum("n").alias("n"))


def best_group_split(rows: DataFrame, group: str, cls: str, share: float, tries: int, seed: str) -> DataFrame:
    """``(group, held_out)``: of ``tries`` keyed shuffles of whole groups the one whose held-out side, the first share
    of the groups (rounded up), has the class shares and size nearest the target; the earliest of equals. Groups are
    counted by class first, and each shuffle's side is selected by histogram (see ``held_classes``)."""
    sizes = rows.groupBy(group, F.col(cls).alias("c")).agg(F.count("*").alias("n"))
    groups = materialise(sizes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("cs")), "groups")  # a group has as many entries as classes
    k = groups.count()
    shares = groups.select(F.explode("cs").alias("x")).groupBy("x.c").agg(F.sum("x.n").alias("n"))
    total = shares.agg(F.sum("n")).first()[0] or 0
    shares = shares.select("c", (F.col("n") / total).alias("p"))
    first, digits = math.ceil(share * k), 2 if k < 1_000_000 else 3
    side = materialise(held_classes(groups, group, tries, seed, first, digits), "sides")
    side = side.join(side.groupBy("try").agg(F.sum("n").alias("nb")), "try")
    every = side.select("try").distinct().crossJoin(F.broadcast(shares))  # tries x classes
    every = every.join(side, (every["try"] == side["try"]) & every["c"].eqNullSafe(side["c"]), "left").select(every["try"], "p", "n", "nb")
    score = every.groupBy("try").agg((F.max(F.abs(F.coalesce(F.col("n") / F.col("nb"), F.lit(0.0)) / F.col("p") - 1)) + 2 * F.abs(F.max("nb") / total - share)).alias("score"))
    best = score.agg(F.min(F.struct(F.round("score", 9).alias("s"), "try"))["try"].alias("try")).first()
    number = -1 if best is None or best[0] is None else best[0]
    # the chosen shuffle alone
    chosen = positions(_shuffled(groups.select(group), group, seed, F.lit(number)), ["try"], [F.col("h"), F.col(group)], F.substring("h", 1, digits))
    return chosen.select(group, (F.col("_pos") <= first).alias("held_out"))


def complete_groups(rows: DataFrame, group: list[str], variant: str, n: int) -> DataFrame:
    """Groups with their counts and whether they have exactly n rows and n variants."""
    by = rows.groupBy(*group).agg(F.count("*").alias("rows"), F.count_distinct(variant).alias("variants"))
    return by.withColumn("complete", (F.col("rows") == n) & (F.col("variants") == n))


def sample_fraction(rows: DataFrame, cls: str, key: str, fraction: float, seed: str) -> DataFrame:
    """min(n, max(1, round half even of n * fraction)) rows of each class, by keyed order."""
    if not 0 < fraction <= 1:
        raise ValueError("a fraction lies above 0 and is 1 at most")
    h = shuffled_positions(rows, [cls], key, seed)
    return h.where(F.col("_pos") <= F.least(F.col("_n"), F.greatest(F.lit(1), F.bround(F.col("_n") * fraction)))).drop("_pos", "_n")


def balance(rows: DataFrame, cls: str, key: str, target: int, cap: int, seed: str) -> DataFrame:
    """``copies`` of each row: classes below target gain keyed draws with replacement, classes above cap lose rows."""
    h = shuffled_positions(rows, [cls], key, seed)
    sizes = rows.groupBy(F.col(cls).alias("_k")).agg(F.count("*").alias("_n2"))
    draws = sizes.where(F.col("_n2") < target).select("_k", "_n2", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(target) - F.col("_n2"))).alias("_i"))
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("_k").cast("string"), F.col("_i").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("_n2") + 1
    draws = draws.select("_k", at.alias("_at")).groupBy("_k", "_at").agg(F.count("*").alias("_more"))
    out = h.where((F.col("_n") <= cap) | (F.col("_pos") <= cap)).join(draws, F.col(cls).eqNullSafe(F.col("_k")) & (F.col("_pos") == F.col("_at")), "left")
    return out.withColumn("copies", (1 + F.coalesce("_more", F.lit(0))).cast("long")).select(*rows.columns, "copies")


def mean_class_size(rows: DataFrame, cls: str) -> int:
    """The mean number of rows of a class, rounded half to even as the reference does; null is no class."""
    r = rows.where(F.col(cls).isNotNull()).agg(F.count("*").alias("n"), F.count_distinct(cls).alias("k")).first()
    return round(r["n"] / r["k"]) if r["k"] else 0


def class_weights(rows: DataFrame, cls: str, classes: list[str] | None = None) -> DataFrame:
    """``(class, n, weight)``: n rows / (classes * rows of the class). With ``classes`` these count, whether or not they
    have rows; a class without rows weighs 1."""
    by = rows.groupBy(cls).agg(F.count("*").alias("n"))
    if classes is not None:
        named = rows.sparkSession.createDataFrame([(c,) for c in classes], f"{cls} string")
        by = named.join(by, cls, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    everything = Window.partitionBy()  # a row for each class
    weight = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return by.withColumn("weight", F.when(F.col("n") > 0, weight).otherwise(1.0))


def plain_fingerprint(rows: DataFrame, line: Column) -> str:
    """SHA-256 of all lines, sorted by code point and joined by line feeds, as manifests record it. The digest takes
    lines one after the other, so they stream through the driver a partition at a time; none is kept."""
    digest, first = hashlib.sha256(), True
    for r in rows.select(line.alias("l")).orderBy("l").toLocalIterator(prefetchPartitions=False):
        digest.update(("" if first else "\n").encode() + r["l"].encode())
        first = False
    return digest.hexdigest()


def fingerprint(rows: DataFrame, line: Column) -> DataFrame:
    """SHA-256 over a table's lines in two levels, so no task gets all lines: sorted lines of each of 4,096 buckets of
    their hash, then the buckets' digests in order."""
    by = rows.select(line.alias("l")).withColumn("b", F.substring(F.md5("l"), 1, 3)).groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("d"), F.count("*").alias("n"))
    return by.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("fingerprint"), F.sum("n").alias("n"))


def constraints(checks: dict[str, DataFrame]) -> DataFrame:
    """``(name, violations)``: the number of rows of each check."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def enforce(checks: dict[str, DataFrame], what: str) -> None:
    """Refuses with the names of all checks that have violations."""
    broken = {r["name"]: r["violations"] for r in constraints(checks).where("violations > 0").collect()} if checks else {}  # a row for each check
    if broken:
        raise ValueError(f"{what}: " + ", ".join(f"{k} ({v})" for k, v in sorted(broken.items())))
