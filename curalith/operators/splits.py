"""Splits of whole groups and of subtypes, the mixing of training pools, and the job that makes a run's pools."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from curalith.operators import curation as C, manifest as M
from curalith.operators.order import shuffled_positions

TRIES = 200


def two_stage_group_split(rows: DataFrame, group: str, cls: str, share: float = 0.30, tries: int = TRIES, seed: str = "split") -> DataFrame:
    """``rows`` with ``split``: a share of the groups is held out, and half of these are test, the others val; each
    time by the best of ``tries`` shuffles."""
    held = C.best_group_split(rows, group, cls, share, tries, seed).where("held_out").select(F.col(group).alias("_g"))
    out = rows.join(held, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("_held", F.col("_g").isNotNull()).drop("_g")
    test = C.best_group_split(out.where("_held").drop("_held"), group, cls, 0.5, tries, seed + "/held").where("held_out").select(F.col(group).alias("_g"))
    out = out.join(test, F.col(group).eqNullSafe(F.col("_g")), "left")
    return out.withColumn("split", F.when(~F.col("_held"), "train").when(F.col("_g").isNull(), "val").otherwise("test")).drop("_held", "_g")


def counted_split(rows: DataFrame, by: list[str], key: str, seed: str, share: float = 0.30, least: int = 3) -> DataFrame:
    """``rows`` with ``split``: of each group's n rows, in keyed order, ceil(n * share) are held out and half of these,
    rounded up, are test; a group of fewer than ``least`` rows is all train."""
    h = shuffled_positions(rows, by, key, seed)
    held = F.ceil(F.col("_n") * F.lit(share) - 1e-9)
    test = F.ceil(held / 2)
    split = F.when((F.col("_n") < least) | (F.col("_pos") <= F.col("_n") - held), "train").when(F.col("_pos") <= F.col("_n") - test, "val").otherwise("test")
    return h.withColumn("split", split).drop("_pos", "_n")


def synthetic_split(rows: DataFrame, cls: str, prompt: str, variant: str, subtype: str, key: str, n: int = 5, share: float = 0.30, seed: str = "split") -> DataFrame:
    """``rows`` with ``split``: prompts with exactly ``n`` different variants as wholes, rows of a subtype one by one
    within it, all others excluded. A prompt outweighs a subtype."""
    of_prompt = rows.where(F.col(prompt).isNotNull())
    groups = C.complete_groups(of_prompt, [cls, prompt], variant, n).where("complete").select(F.col(cls).alias("_c"), F.col(prompt).alias("_p"))
    groups = groups.withColumn("_g", F.concat_ws("_", "_c", "_p")).withColumn("_all", F.lit(1))
    parts = counted_split(groups, ["_all"], "_g", seed, share, 1).select("_c", "_p", F.col("split").alias("_split"))
    whole = of_prompt.join(parts, (F.col(cls) == F.col("_c")) & (F.col(prompt) == F.col("_p")), "left").drop("_c", "_p")
    whole = whole.withColumn("split", F.coalesce("_split", F.lit("excluded"))).drop("_split")
    single = rows.where(F.col(prompt).isNull())
    typed = counted_split(single.where(F.col(subtype).isNotNull()), [subtype], key, seed, share)
    rest = single.where(F.col(subtype).isNull()).withColumn("split", F.lit("excluded"))
    return whole.unionByName(typed).unionByName(rest)


def mix_pools(pools: dict[str, DataFrame], fractions: dict[str, float], cls: str, key: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, report)``: of each source's pool its fraction of every class, see ``curation.sample_fraction``, with
    ``source``; and for each class what was there, what is used, and the share of real rows in it."""
    taken, had, used = None, None, None
    for source, pool in pools.items():
        some = C.sample_fraction(pool, cls, key, fractions.get(source, 1.0), f"{seed}/{source}").withColumn("source", F.lit(source))
        taken = some if taken is None else taken.unionByName(some)
        a = pool.select(F.col(cls).alias("class"), F.lit(source).alias("source"))
        had = a if had is None else had.unionByName(a)
    used = taken.select(F.col(cls).alias("class"), "source")
    names = list(pools)
    count = lambda df, what: df.groupBy("class").agg(*[F.count_if(F.col("source") == s).alias(f"{s}_{what}") for s in names])
    report = count(had, "available").join(count(used, "used"), "class", "left").na.fill(0)
    total = sum((F.col(f"{s}_used") for s in names[1:]), F.col(f"{names[0]}_used"))
    if "real" in names:
        report = report.withColumn("achieved_real_%", F.round(100 * F.col("real_used") / F.greatest(total, F.lit(1)), 1))
    return taken, report


def check_subset(part: DataFrame, whole: DataFrame, key: str) -> None:
    """Refuses a training subset that repeats rows or has rows the whole has not."""
    C.enforce({"repeated": part.groupBy(key).count().where("count > 1"), "unknown": part.join(whole, key, "left_anti")}, "not a subset")


def split_constraints(rows: DataFrame, key: str, group: str, cls: str, digest: str, split: str = "split", least: int = 1) -> dict[str, DataFrame]:
    """Tables of violations of a finished split: each must be empty."""
    one = lambda c: rows.where(F.col(c).isNotNull()).groupBy(c).agg((F.min(split) != F.max(split)).alias("x")).where("x")
    classes = rows.select(cls).distinct()
    every = classes.crossJoin(rows.sparkSession.createDataFrame([(s,) for s in M.SPLITS], f"{split} string"))  # three rows a class
    return {
        "split_known": rows.where(~F.coalesce(F.col(split).isin(*M.SPLITS), F.lit(False))),
        "unique_ids": rows.groupBy(key).count().where("count > 1"),
        "group_in_one_split": one(group),
        "digest_in_one_split": one(digest),
        "no_group": rows.where(F.col(group).isNull()),
        "class_in_every_split": every.join(rows.select(cls, split).distinct(), [cls, split], "left_anti"),
        "least_class_size": rows.groupBy(cls).count().where(F.col("count") < least),
    }


@dataclass
class Pools:
    """A run's pools: training rows as mixed, whole validation and test pools, and what was decided on the way."""

    train: DataFrame
    val: DataFrame
    test: DataFrame
    manifest: DataFrame
    resolved: M.Resolved
    mix: DataFrame


def build_pools(sources: dict[str, DataFrame], cls: str, key: str, digest: str, fractions: dict[str, float], seed: str, strict: bool = True, auto_resolve: bool = True) -> Pools:
    """From split sources to a run's pools, in this order: classes must be the same in every source; equal files are
    resolved once over the full pools; only then is the training split mixed, val and test stay whole; the manifest
    has every resolved row. Each source has ``split``; excluded rows are left out."""
    classes = {name: {r[0] for r in rows.select(cls).distinct().collect()} for name, rows in sources.items()}  # class names
    if len({frozenset(x) for x in classes.values()}) > 1:
        raise ValueError(f"classes differ between sources: {classes}")
    full = None
    for name, rows in sources.items():
        part = rows.where(F.col("split").isin(*M.SPLITS)).withColumn("source", F.lit(name))
        full = part if full is None else full.unionByName(part)
    resolved = M.resolve_pools(full, digest, cls, "split", key, "source", strict, auto_resolve)
    kept = resolved.kept
    train = kept.where("split = 'train'")
    mixed, report = mix_pools({name: train.where(F.col("source") == name).drop("source") for name in sources}, fractions, cls, key, seed)
    check_subset(mixed, train, key)
    return Pools(mixed, kept.where("split = 'val'"), kept.where("split = 'test'"), kept.select(key, cls, "source", "split"), resolved, report)
