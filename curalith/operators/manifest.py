"""Manifests: attaching saved splits, strict joins, exact resolution with its reports, provenance, dispositions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from curalith.functions import scalar as S
from curalith.operators import curation as C

#: What marks a row as not to be used, and a field as not known.
FORBIDDEN = ("false", "no", "0", "not_allowed")
REJECTED = ("reject", "rejected", "incorrect_label")
UNKNOWN = "unknown"
SPLITS = ("train", "val", "test")


def portable_key(path: Column, aliases: dict[str, str]) -> Column:
    """Class and file name: what of a path stays when the folder above moves."""
    parts = F.split(path, "/")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    return F.concat(S.canonical_class(parent, aliases), F.lit("/"), F.element_at(parts, -1))


def attach(actual: DataFrame, saved: DataFrame, aliases: dict[str, str], path: str = "path", fields: tuple[str, ...] = ("split", "group")) -> DataFrame:
    """``actual`` with the saved fields: by path if the saved manifest has all paths, else by class and file name, which
    must then be unique on either side. Rows without a saved one have nulls; checks tell them."""
    if "path" not in saved.columns and "relative_path" in saved.columns:
        saved = saved.withColumn("path", F.col("relative_path"))
    gone = [x for x in ("path", *fields) if x not in saved.columns]
    if gone:
        raise ValueError(f"a saved manifest has path or relative_path, and {', '.join(fields)}; it lacks {', '.join(gone)}")
    by_path = actual.join(saved.select(F.col("path").alias(path)), path, "left_anti").isEmpty()
    key = (lambda c: F.col(c)) if by_path else (lambda c: portable_key(F.col(c), aliases))
    a, s = actual.withColumn("_key", key(path)), saved.select(key("path").alias("_key"), *fields)
    C.enforce({"repeated in the files": a.groupBy("_key").count().where("count > 1"), "repeated in the manifest": s.groupBy("_key").count().where("count > 1")}, "keys are not unique")
    return a.join(s, "_key", "left").drop("_key")


def one_to_one(actual: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables whose keys are unique; other columns of both sides get the suffixes _actual, _saved."""
    C.enforce({"left": actual.groupBy(key).count().where("count > 1"), "right": saved.groupBy(key).count().where("count > 1")}, f"{key} is not one to one")
    both = {c for c in actual.columns if c in saved.columns and c != key}
    a = actual.select(key, *[F.col(c).alias(f"{c}_actual" if c in both else c) for c in actual.columns if c != key])
    return a.join(saved.select(key, *[F.col(c).alias(f"{c}_saved" if c in both else c) for c in saved.columns if c != key]), key)


def reuse_frozen(actual: DataFrame, saved: DataFrame, aliases: dict[str, str], path: str = "path", cls: str = "class", digest: str = "sha256", group: str | None = "group", same_count: bool = False, fingerprint: str | None = None) -> DataFrame:
    """``actual`` with ``split`` (and ``group``) of a frozen split, or a refusal that names all that does not fit.

    Every file has to be in the manifest with equal bytes, splits and groups must be known, and no group may cross
    splits. If the manifest has classes they must agree. ``same_count`` also refuses files the manifest has beyond
    these; ``fingerprint`` is what every row's ``dataset_fingerprint`` must be.
    """
    if digest not in saved.columns:
        raise ValueError(f"a reusable split has {digest}; paths alone do not tell files apart")
    fields = ["split", *([group] if group else []), digest, *([cls] if cls in saved.columns else [])]
    renamed = saved.select(*[c for c in ("path", "relative_path", "dataset_fingerprint") if c in saved.columns], *[F.col(c).alias(f"_{c}") for c in fields])
    m = attach(actual.drop("split", *([group] if group else [])), renamed, aliases, path, tuple(f"_{c}" for c in fields))
    checks = {
        "missing": m.where(F.col("_split").isNull()),
        "invalid split": m.where(~F.col("_split").isin(*SPLITS)),
        "changed": m.where(~F.col(digest).eqNullSafe(F.col(f"_{digest}")) & F.col("_split").isNotNull()),
    }
    if cls in saved.columns:
        checks["other class"] = m.where(~S.canonical_class(F.col(cls), aliases).eqNullSafe(S.canonical_class(F.col(f"_{cls}"), aliases)) & F.col("_split").isNotNull())
    if group:
        checks["no group"] = m.where(F.col(f"_{group}").isNull())
        checks["group crosses splits"] = m.groupBy(f"_{group}").agg((F.min("_split") != F.max("_split")).alias("x")).where("x")
    if same_count:
        sides = saved.agg(F.count("*").alias("a")).crossJoin(actual.agg(F.count("*").alias("b")))  # one row each
        checks["other number of files"] = sides.where("a <> b")
    if fingerprint is not None:
        checks["other fingerprint"] = saved.where(~F.col("dataset_fingerprint").eqNullSafe(F.lit(fingerprint)))
    C.enforce(checks, "refusing to reuse the split")
    out = m.withColumn("split", F.col("_split"))
    if group:
        out = out.withColumn(group, F.col(f"_{group}"))
    return out.drop(*[f"_{c}" for c in fields])


@dataclass
class Resolved:
    """Exact resolution: what stays, and the reports of what does not."""

    kept: DataFrame
    removed: DataFrame
    by_source: DataFrame
    totals: DataFrame


def resolve_pools(pool: DataFrame, digest: str = "md5", cls: str = "class", split: str = "split", path: str = "path", source: str = "source", strict: bool = True, auto_resolve: bool = True) -> Resolved:
    """Resolves equal files over all splits, see ``curation.resolve_exact``.

    A path that occurs twice is refused. Without ``auto_resolve`` copies are refused if ``strict`` and else stay.
    Reports: rows removed with their reason, their number by source and reason, and what each source had and kept.
    """
    if source not in pool.columns:
        pool = pool.withColumn(source, F.lit("unspecified"))
    C.enforce({"path": pool.groupBy(path).count().where("count > 1")}, "a path occurs more than once")
    told = C.resolve_exact(pool, digest, cls, split, path)
    gone = told.where("reason is not null")
    if not auto_resolve:
        if strict:
            C.enforce({"copies": gone}, "equal files, and auto_resolve is off")
        told, gone = told.withColumn("reason", F.lit(None).cast("string")), gone.limit(0)
    removed = gone.select(F.col(digest).alias("md5"), F.col(path).alias("path"), F.col(source).alias("source"), F.col(cls).alias("class"), F.col(split).alias("split"), "reason")
    kept = told.where("reason is null").drop("reason")
    if strict:
        C.enforce({digest: kept.where(F.col(digest).isNotNull()).groupBy(digest).count().where("count > 1")}, "equal files are left")
    is_gone = F.col("reason").isNotNull()
    totals = told.groupBy(source).agg(F.count("*").alias("original"), F.count_if(~is_gone).alias("retained"), F.count_if(is_gone).alias("removed"))
    return Resolved(kept, removed, removed.groupBy("source", "reason").agg(F.count("*").alias("removed")), totals)


def digest_conflicts(rows: DataFrame, short: str = "md5", long: str = "sha256") -> DataFrame:
    """Short digests that stand for several long ones: a check that must have no rows."""
    by = rows.where(F.col(short).isNotNull()).groupBy(short).agg(F.min(long).alias("a"), F.max(long).alias("b"))
    return by.where("a <> b").select(short)


def synthetic_audit(synthetic: DataFrame, real: DataFrame, digest: str = "sha256", cls: str = "class", path: str = "relative_path", prompt: str = "prompt_id", variant: str = "variant", n: int = 5) -> DataFrame:
    """``synthetic`` with ``status``: a file equal to any real one, of a digest under several classes, a further copy,
    of a prompt whose eligible variants are not ``n`` different ones, or eligible. What comes later decides only
    what is still eligible, except that a label conflict outweighs a real copy."""
    real_digests = real.select(F.col(digest).alias("_d")).distinct()
    rows = synthetic.join(real_digests, F.col(digest) == F.col("_d"), "left").withColumn("_real", F.col("_d").isNotNull()).drop("_d")
    by = rows.groupBy(F.col(digest).alias("_d")).agg((F.min(cls) != F.max(cls)).alias("_mixed"), F.min(F.when(~F.col("_real"), F.col(path))).alias("_first"))
    rows = rows.join(by, F.col(digest).eqNullSafe(F.col("_d"))).drop("_d")
    status = F.when(F.coalesce("_mixed", F.lit(False)), "quarantined_synthetic_label_conflict").when(F.col("_real"), "removed_shared_exact_real").when(F.col(path) != F.col("_first"), "removed_synthetic_exact_copy").otherwise("eligible")
    rows = rows.withColumn("status", status).drop("_real", "_mixed", "_first")
    of_prompt = rows.where((F.col(prompt) != "") & F.col(prompt).isNotNull()).groupBy(F.col(cls).alias("_c"), F.col(prompt).alias("_p"))
    ok = F.when(F.col("status") == "eligible", F.col(variant))
    complete = of_prompt.agg((F.count_if(F.col("status") == "eligible") == n).alias("_n"), (F.count_distinct(ok) == n).alias("_v"))
    rows = rows.join(complete, (F.col(cls) == F.col("_c")) & (F.col(prompt) == F.col("_p")), "left")
    partial = (F.col("status") == "eligible") & ~F.coalesce(F.col("_n") & F.col("_v"), F.lit(True))
    return rows.withColumn("status", F.when(partial, "quarantined_incomplete_prompt_group").otherwise(F.col("status"))).drop("_c", "_p", "_n", "_v")


def known(value: Column) -> Column:
    """Whether a field says anything."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return (v != "") & (v != UNKNOWN)


def provenance_rejected(allowed: Column, review: Column) -> Column:
    """Whether the source's record forbids a row, or a review rejected it."""
    return F.lower(F.coalesce(allowed, F.lit(""))).isin(*FORBIDDEN) | F.lower(F.coalesce(review, F.lit(""))).isin(*REJECTED)


def with_provenance(rows: DataFrame, origin: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """``rows`` with the fields of a unique provenance table: blank where a row has none, and the given default for
    fields that the table lacks."""
    C.enforce({key: origin.groupBy(key).count().where("count > 1")}, "provenance is not unique")
    have = [f for f in fields if f in origin.columns]
    out = rows.join(origin.select(key, *have), key, "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f), F.lit("")).alias(f) if f in have else F.lit(default).alias(f) for f, default in fields.items()])


def suspicious(name: Column, cls: Column, tokens: dict[str, list[str]]) -> Column:
    """Those of a class's telltale words that a file name has, in their order."""
    none = F.array().cast("array<string>")
    words = F.create_map(*[x for c, ws in tokens.items() for x in (F.lit(c), F.array(*map(F.lit, ws)))])
    return F.filter(F.coalesce(F.element_at(words, cls), none), lambda w: F.contains(F.lower(name), w))


def disposition_totals(rows: DataFrame, source: str, key: str, status: str, groups: dict[str, list[str]], retained: str = "eligible") -> DataFrame:
    """A row for each source: candidates, those of each named group of statuses, all others, and those retained. Rows
    that repeat, or sums that do not add up, are refused."""
    C.enforce({"repeated": rows.groupBy(source, key).count().where("count > 1"), "no status": rows.where(F.col(status).isNull())}, "dispositions")
    named = [s for ss in groups.values() for s in ss]
    out = rows.groupBy(source).agg(
        F.count("*").alias("candidates"),
        *[F.count_if(F.col(status).isin(*ss)).alias(name) for name, ss in groups.items()],
        F.count_if(~F.col(status).isin(*named, retained)).alias("other"),
        F.count_if(F.col(status) == retained).alias("retained"),
    )
    parts = sum((F.col(name) for name in groups), F.col("other") + F.col("retained"))
    C.enforce({"sum": out.where(F.col("candidates") != parts)}, "dispositions do not add up")
    return out


def pending(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks whose output does not exist yet."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")
