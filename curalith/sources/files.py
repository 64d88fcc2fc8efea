"""Readers and writers of the files a curation run meets: labelled folders of images, manifests, prompts, reports.

Every reader declares its schema, so no pass over the data is spent on guessing one. Paths go to Spark's readers alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from curalith.functions import scalar as S

#: Suffixes of images.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tiff", "webp")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _qualified(spark: SparkSession, path: str):
    """The file system and the full path of a path, as listings give it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _qualified(spark, path)
    return fs.exists(at)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted: one for each class, whatever the files."""
    fs, at = _qualified(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory())


def find_root(spark: SparkSession, hint: str, expected: set[str], names: tuple[str, ...] = (), depth: int = 3) -> str:
    """The first folder whose subfolders are exactly the expected ones: among the hint's own folders of these names,
    the hint itself, and then all below it, ``depth`` levels down, in the order of their paths."""
    hint, level = hint.rstrip("/"), []
    tried = [*[f"{hint}/{n}" for n in names], hint]
    below = [hint]
    for _ in range(depth):
        below = [f"{base}/{x}" for base in below if exists(spark, base) for x in subfolders(spark, base)]
        level += below
    for folder in [*tried, *sorted(level)]:
        if exists(spark, folder) and set(subfolders(spark, folder)) == expected:
            return folder
    raise FileNotFoundError(f"no folder below {hint} has exactly the folders {sorted(expected)}")


def labelled_files(spark: SparkSession, root: str, aliases: dict[str, str] | None = None, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, content: bool = False) -> DataFrame:
    """``(path, relative_path, name, folder, class, label, size, modified, kept[, content])`` of every file below
    ``root``. The first folder names the class; labels count the sorted classes of all folders from 0, with or without
    files. Files of other suffixes have ``kept`` false and no label. Without ``content`` the bytes are never read.
    Two folders of one class are refused."""
    _, at = _qualified(spark, root)
    folders = subfolders(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # the listing gives full paths; what follows the root is relative
    relative = F.substring(F.col("path"), F.lit(len(at.toString().rstrip("/")) + 2), F.length("path"))
    folder = F.when(F.instr(relative, "/") > 0, F.substring_index(relative, "/", 1))
    rows = files.select("path", relative.alias("relative_path"), S.file_name(F.col("path")).alias("name"), folder.alias("folder"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    rows = rows.withColumn("class", S.canonical_class(F.col("folder"), aliases or {})).withColumn("kept", F.col("folder").isNotNull() & suffix(F.col("name")).isin(*suffixes))
    named = spark.createDataFrame([(x,) for x in folders], "folder string").select("folder", S.canonical_class(F.col("folder"), aliases or {}).alias("class"))
    names = [r["class"] for r in named.orderBy("class").collect()]  # one for each folder
    if len(set(names)) < len(names):
        raise ValueError(f"several folders name one class: {sorted(x for x in set(names) if names.count(x) > 1)}")
    return rows.withColumn("label", F.when(F.col("kept"), F.array_position(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), F.col("class")) - 1).cast("int"))


def class_conflicts(files: DataFrame) -> DataFrame:
    """Classes that several folders name."""
    by = files.where("kept").groupBy("class").agg(F.array_sort(F.collect_set("folder")).alias("folders"))
    return by.where(F.size("folders") > 1)


def read_csv_in_zip(spark: SparkSession, path: str, member: str, schema: str | StructType) -> DataFrame:
    """A table with a header that is a member of an archive. The archive is one file and read in one task; a header that
    lacks a column of the schema, and an archive without the member, are errors."""
    shape = spark.createDataFrame([], schema).schema
    names = shape.names

    def run(batches):
        import csv
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(member) as f:
                    lines = csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline=""))
                    if missing := set(names) - set(lines.fieldnames or ()):
                        raise ValueError(f"{member} lacks {sorted(missing)}")
                    held = []
                    for x in lines:
                        held.append([x[n] if x[n] != "" else None for n in names])
                        if len(held) == 10_000:
                            yield pd.DataFrame(held, columns=names, dtype=object)
                            held = []
                    yield pd.DataFrame(held, columns=names, dtype=object)

    text = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, text)
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in shape.fields])


def write_cache(df: DataFrame, path: str, key: str) -> None:
    """Adds rows, such as embeddings by digest and model, to a cache; those it has by key stay as they are."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.schema(df.schema).parquet(path).select(key), key, "left_anti")
    df.dropDuplicates([key]).write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str, wanted: DataFrame, key: str, schema: str | StructType) -> DataFrame | None:
    """The wanted keys' rows of a cache, or None if it lacks any of them."""
    if not exists(spark, path):
        return None
    cached = spark.read.schema(schema).parquet(path)
    if not wanted.select(key).join(cached.select(key), key, "left_anti").isEmpty():
        return None
    return wanted.select(key).distinct().join(cached, key)


def with_digests(files: DataFrame) -> DataFrame:
    """Digests of each file's bytes beside its row."""
    return files.withColumn("md5", F.md5("content")).withColumn("sha256", F.sha2("content", 256))


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A table with a header; a header that differs from the schema is an error, not a table of nulls."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", multiLine=True, escape='"')


def read_json(spark: SparkSession, path: str, schema: str | StructType, lines: bool = True) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=not lines, mode="FAILFAST")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(id, text)`` of the lines that are not blank, trimmed; ids count them from 1 in the order of the file.
    A prompt file is one file and read as one row, so its order is that of its lines."""
    whole = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("l"))
    kept = F.filter(F.transform("l", lambda x: F.trim(x)), lambda x: x != "")
    return whole.select(F.posexplode(kept).alias("i", "text")).select((F.col("i") + 1).cast("long").alias("id"), "text")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.csv(path, mode=mode, header=True, escape='"')


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="append")


def report_json(df: DataFrame) -> str:
    """A table of one row, such as a run's totals, as JSON; NaN and infinities are errors."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report is one row")
    return json.dumps(rows[0].asDict(recursive=True), allow_nan=False, indent=2, default=str)


def write_crosstab(table: DataFrame, path: str, index: str) -> None:
    """A crosstab with its index as the first column, in the index's order, as one CSV file: a row for each class."""
    rest = [c for c in table.columns if c != index]
    write_csv(table.select(index, *rest).orderBy(index).coalesce(1), path)


def artifacts(spark: SparkSession, root: str, expected: list[str], private: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """``(relative_path, size, expected, present, public)`` of each file below ``root`` and each one that should be
    there; files below a private folder are not public. With ``strict`` a missing one is an error that names all."""
    _, at = _qualified(spark, root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = found.select(F.substring(F.col("path"), F.lit(len(at.toString().rstrip("/")) + 2), F.length("path")).alias("relative_path"), F.col("length").alias("size"), F.lit(True).alias("present"))
    asked = spark.createDataFrame([(x, True) for x in expected], "relative_path string, expected boolean")
    out = found.join(asked, "relative_path", "full").select("relative_path", "size", F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("present", F.lit(False)).alias("present"))
    hidden = F.lit(False)
    for p in private:
        hidden = hidden | F.startswith(F.col("relative_path"), F.lit(p.rstrip("/") + "/"))
    if strict and (gone := [r[0] for r in out.where("not present").select("relative_path").orderBy("relative_path").collect()]):  # as many as expected at most
        raise FileNotFoundError(f"missing: {', '.join(gone)}")
    return out.withColumn("public", ~hidden)
