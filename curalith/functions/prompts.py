"""Prompts: the grid of their settings, seeded draws, their text, and the tasks they expand to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curalith.functions import scalar as S

#: The settings that vary, one at a time; the last one varies all.
AXES = ("age", "severity", "skin_tone", "anatomical_distribution", "combined")


@dataclass(frozen=True)
class Grid:
    """What a class's prompts are made of. The first distribution, and the named defaults, hold where an axis does not vary."""

    phenotypes: tuple[str, ...]
    distributions: tuple[str, ...]
    genders: tuple[str, ...] = ("female", "male")
    ages: tuple[tuple[int, int], ...] = ((16, 24), (26, 38), (41, 58))
    default_age: int = 1
    severities: tuple[str, ...] = ("mild", "moderate", "severe")
    default_severity: str = "moderate"
    tones: tuple[str, ...] = ("I", "II", "III", "IV", "V", "VI")
    default_tone: str = "III"
    per_axis: int = 10

    @property
    def size(self) -> int:
        return len(self.phenotypes) * len(self.genders) * len(AXES) * self.per_axis


def draw(seed: Column, name: str, n: Column | int) -> Column:
    """A whole number from 0 to n - 1 that depends on the seed and the draw's name alone. Draws are hashes, so they
    do not equal those of any generator that keeps a state."""
    n = F.lit(n) if isinstance(n, int) else n
    return S.stable_seed(seed, F.lit(name)) % n


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


def prompt_records(spark: SparkSession, cls: str, grid: Grid) -> DataFrame:
    """The whole grid of a class, ids from 0 (see ``records_of``)."""
    return records_of(spark.range(grid.size).withColumn("class", F.lit(cls)), grid)


def records_of(rows: DataFrame, grid: Grid) -> DataFrame:
    """``(id, class, phenotype, gender, variation_group, idx, age, severity, tone, distribution, seed_base)`` for rows ``(id,
    class)``. An id has its place in the grid, which repeats, in the order of phenotypes, genders, axes, and numbers: an axis
    varies its own setting, the last one draws all."""
    a, g = len(AXES), len(grid.genders)
    n, k = F.pmod(F.col("id"), F.lit(grid.size)), grid.per_axis
    rows = rows.select(
        "id", "class", _pick(grid.phenotypes, F.floor(n / (k * a * g))).alias("phenotype"), _pick(grid.genders, F.floor(n / (k * a)) % g).alias("gender"),
        _pick(AXES, F.floor(n / k) % a).alias("variation_group"), (n % k).cast("int").alias("idx"),
    )
    seed = S.stable_seed(F.col("class"), F.col("phenotype"), F.col("gender"), F.col("variation_group"), F.col("idx"))
    axis = lambda name: F.col("variation_group") == name

    def setting(own: str, values: tuple[str, ...], default: str) -> Column:
        return F.when(axis(own), _pick(values, F.col("idx") % len(values))).when(axis("combined"), _pick(values, draw(seed, own, len(values)))).otherwise(F.lit(default))

    spans = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in grid.ages])
    at = F.when(axis("combined"), draw(seed, "range", len(grid.ages))).otherwise(F.col("idx") % len(grid.ages))
    span = F.element_at(spans, at.cast("int") + 1)
    drawn = span["lo"] + draw(seed, "age", span["hi"] - span["lo"] + 1)
    lo, hi = grid.ages[grid.default_age]
    return rows.select(
        "*", F.when(axis("age") | axis("combined"), drawn).otherwise((lo + hi) // 2).cast("int").alias("age"),
        setting("severity", grid.severities, grid.default_severity).alias("severity"), setting("skin_tone", grid.tones, grid.default_tone).alias("tone"),
        setting("anatomical_distribution", grid.distributions, grid.distributions[0]).alias("distribution"),
        S.stable_seed(F.col("class"), F.col("phenotype"), F.col("gender"), F.col("variation_group"), F.col("idx"), F.lit("img")).alias("seed_base"),
    )


def article(word: Column) -> Column:
    return F.when(F.lower(F.left(word, F.lit(1))).isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def filled(template: str, **values: Column) -> Column:
    """A template's text with ``{name}`` replaced by columns."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def final_prompt(text: Column, prefix: str, anchor: str) -> Column:
    """The prefix before the text, without its closing clause: what begins at the anchor goes if it ends with a full
    stop; white space before it goes too. Without the anchor, or the full stop, nothing is cut."""
    at = F.instr(text, anchor)
    closed = F.regexp_replace(text, r"\s+$", "").endswith(".")
    return F.concat(F.lit(prefix), F.when((at > 0) & closed, F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"\s+$", "")).otherwise(text))


def task_expansion(prompts: DataFrame, variants: int, cls_number: int, base: int = 1000, prompt_step: int = 7919, variant_step: int = 104729, retries: int = 3, retry_step: int = 15485863, suffix: str = "png") -> DataFrame:
    """One row for each prompt, variant and attempt: file name, and the seed by position. ``prompts`` has ``id`` from 0."""
    rows = prompts.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants)))).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(retries - 1))))
    number = F.col("id") + 1
    seed = (F.lit(base).cast("long") + (number - 1) * prompt_step + (F.col("variant") - 1) * variant_step + F.col("attempt") * retry_step) % (1 << 32)
    return rows.withColumn("filename", F.format_string(f"cls%02d_p_%03d_v_%d.{suffix}", F.lit(cls_number), number, F.col("variant"))).withColumn("seed", seed)


def hex64(code: Column) -> Column:
    """A 64-bit code as 16 hex digits."""
    return F.lpad(F.lower(F.hex(code)), 16, "0")


def first_success(attempts: DataFrame, key: list[str], attempt: str, ok: str, most: int = 3) -> DataFrame:
    """For each key the first attempt, of the first ``most``, that succeeded (null if none), and how many were used."""
    tried = attempts.where(F.col(attempt) < most)
    hit = F.min(F.when(F.col(ok), F.col(attempt)))
    return tried.groupBy(*key).agg(hit.alias("success"), F.count("*").alias("tried")).withColumn("used", F.when(F.col("success").isNull(), F.col("tried")).otherwise(F.col("success") + 1).cast("long")).drop("tried")


def load_or_build(built: DataFrame, lines: DataFrame | None, meta: DataFrame | None, cls: str) -> DataFrame:
    """The prompts of a class: records ``meta`` if there are as many as saved ``lines`` (id from 1, text); else the lines
    themselves as custom prompts; without lines, what was built."""
    if lines is None:
        return built
    if meta is not None and meta.count() == lines.count():
        return meta
    number = F.col("id") - 1
    return lines.select(number.alias("id"), F.lit(cls).alias("class"), F.lit("custom").alias("phenotype"), F.lit("unspecified").alias("gender"), F.lit("custom").alias("variation_group"), F.col("text").alias("prompt"), S.stable_seed(F.lit(cls), F.lit("custom"), number).alias("seed_base"))
