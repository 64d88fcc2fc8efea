"""Scalar expressions: names, seeds, distances, per-row losses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def canonical_class(name: Column, aliases: dict[str, str]) -> Column:
    """Without white space at the ends, lower-cased, runs of hyphens and white space as one underscore, looked up;
    unknown names stay as they are."""
    key = F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), r"[-\s]+", "_")
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else F.create_map().cast("map<string,string>")
    return F.coalesce(F.element_at(table, key), name)


def file_kind(name: Column, subtypes: tuple[str, ...]) -> Column:
    """``(kind, prompt_id, variant, subtype, number)`` of a file name by how its stem ends, whatever the case: a prompt
    and variant, which wins, or a subtype and number; else unknown."""
    s = stem(name)
    prompt, typed = r"(?i)_p_(\d+)_v_(\d+)$", rf"(?i)_({'|'.join(subtypes)})_(\d+)$"
    is_prompt, is_typed = s.rlike(prompt), s.rlike(typed)
    return F.struct(
        F.when(is_prompt, "synthetic").when(is_typed, "subtype").otherwise("unknown").alias("kind"),
        F.when(is_prompt, F.regexp_extract(s, prompt, 1)).alias("prompt_id"),
        F.when(is_prompt, F.regexp_extract(s, prompt, 2).cast("int")).alias("variant"),
        F.when(~is_prompt & is_typed, F.upper(F.regexp_extract(s, typed, 1))).alias("subtype"),
        F.when(~is_prompt & is_typed, F.regexp_extract(s, typed, 2).cast("int")).alias("number"),
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def stable_seed(*parts: Column) -> Column:
    """The low 32 bits of the MD5 of the parts joined by bars."""
    return F.conv(F.right(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), F.lit(8)), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body has it; the optimizer cannot write it out."""
    return F.element_at(F.transform(F.array(value), body), 1)


def argmax(values: Column) -> Column:
    """Index of the first maximum, from 0."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def one_hot(label: Column, k: int) -> Column:
    """An array of k numbers, 1 at the label and 0 elsewhere; all 0 for a null or unknown label."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce((i == label).cast("int"), F.lit(0)))


def focal_loss(probs: Column, label: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    p = F.greatest(F.least(F.element_at(probs, label.cast("int") + 1), F.lit(1 - 1e-7)), F.lit(1e-7))
    return -F.lit(alpha) * F.pow(1 - p, F.lit(gamma)) * F.log(p)


def keyed_hash(seed: str, key: Column) -> Column:
    """The order of seeded shuffles: does not depend on partitioning."""
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))
