"""Queries through files: tables written to the shared folder and read again, labelled folders, pictures; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curalith.operators import images as IM
from curalith.sources import files as FS
from curalith.storage import fresh_path

from .curation import M, manifest, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents")
def csv_trip(spark, sf):
    """Whole texts, with their line breaks and quotes, as CSV with a header and back by a declared schema."""
    d, path = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source"), fresh_path(spark, "csv")
    FS.write_csv(d, path)
    return FS.read_csv(spark, path, d.schema).withColumn("text", F.coalesce("text", F.lit("")))


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines_trip(spark, sf):
    """Two runs append their records to one log of JSON lines."""
    d, path = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), fresh_path(spark, "jsonl")
    for part in (0, 1):
        FS.append_jsonl(d.where(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == part), path)
    return FS.read_json(spark, path, d.schema)


@query("SELECT count(*) AS n, count(DISTINCT lang) AS classes, sum(length(text))::BIGINT AS chars FROM documents")
def report_trip(spark, sf):
    """A run's totals as one JSON document, written and read whole."""
    path = fresh_path(spark, "report")
    report = FS.report_json(table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("classes"), F.sum(F.length("text")).alias("chars")))
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.text(path, lineSep="\n")
    return FS.read_json(spark, path, "n long, classes long, chars long", lines=False)


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS id, trim(n_name) AS text FROM nation")
def prompt_lines_trip(spark, sf):
    """A prompt file: one line a prompt, blank ones between, numbered in the order of the file."""
    path = fresh_path(spark, "prompts")
    lines = table(spark, sf, "nation").orderBy("n_nationkey").coalesce(1).select(F.concat(F.lit("  "), "n_name", F.lit(" \n")).alias("value"))
    lines.write.text(path)
    return FS.read_lines(spark, path)


@query("SELECT sha256(array_to_string(embedding, ',')) AS digest, count(*) AS n FROM (SELECT DISTINCT label AS k, [label, label + 1] AS embedding FROM embeddings) GROUP BY 1")
def cache_keys_trip(spark, sf):
    """Vectors by digest in a cache that two runs fill, the second with what the first had left out."""
    e = table(spark, sf, "embeddings").select(F.array(F.col("label"), F.col("label") + 1).alias("v"))
    e = e.select(F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256).alias("digest"), "v")
    path, schema = fresh_path(spark, "cache"), "digest string, v array<int>"
    FS.write_cache(e.where(F.col("v")[0] % 2 == 0), path, "digest")
    if FS.read_cache(spark, path, e, "digest", schema) is not None and not e.where(F.col("v")[0] % 2 == 1).isEmpty():
        raise AssertionError("a cache that lacks keys must not answer")
    FS.write_cache(e, path, "digest")
    return FS.read_cache(spark, path, e, "digest", schema).groupBy("digest").agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT class, count(*) FILTER (split='train') AS train, count(*) FILTER (split='val') AS val, count(*) FILTER (split='test') AS test FROM m GROUP BY 1")
def crosstab_trip(spark, sf):
    """A crosstab as one CSV file, its index first and in order."""
    path = fresh_path(spark, "crosstab")
    t = manifest(spark, sf).groupBy("class").pivot("split", ["train", "val", "test"]).count().na.fill(0)
    FS.write_crosstab(t, path, "class")
    return FS.read_csv(spark, path, t.schema)


NAMES = {"folder=en": "English", "folder=de": "German"}


def _folders(spark, sf) -> str:
    """A root some levels down whose folders name the classes of documents, a line for each document in its class."""
    top = fresh_path(spark, "folders")
    table(spark, sf, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("value"), F.col("lang").alias("folder")).write.partitionBy("folder").text(f"{top}/deep/set")
    return top


@query("""WITH c AS (SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'folder=' || lang END AS class, 33 * count(*) AS size FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT class, (row_number() OVER (ORDER BY class) - 1)::INT AS label, size::BIGINT AS size FROM c""")
def labelled_folders(spark, sf):
    """The folder that has exactly the expected class folders is found, its files are labelled, other files left out."""
    top = _folders(spark, sf)
    expected = {f"folder={r[0]}" for r in table(spark, sf, "documents").select("lang").where("lang is not null").distinct().collect()}  # a name for each class
    root = FS.find_root(spark, top, expected | {x for x in FS.subfolders(spark, f"{top}/deep/set") if "HIVE_DEFAULT" in x})
    files = FS.labelled_files(spark, root, NAMES, ("txt",)).where("kept and folder not like '%HIVE_DEFAULT%'")
    return files.groupBy("class", "label").agg(F.sum("size").alias("size"))


@query("SELECT DISTINCT 'folder=' || lang AS folder, lang <> 'de' AS public, true AS present FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'report.csv', true, false")
def artifact_list(spark, sf):
    """What a run has left below its root, which of it is private, and what should be there but is not."""
    got = FS.artifacts(spark, f"{_folders(spark, sf)}/deep/set", ["report.csv"], ("folder=de",))
    return got.select(F.substring_index("relative_path", "/", 1).alias("folder"), "public", "present").where("folder not like '%HIVE_DEFAULT%'").distinct()


def pictures(spark, sf) -> DataFrame:
    """Grey pictures of 64 x 64 from vectors: each pixel is made of two coordinates; every seventh picture is black."""
    a = lambda i: F.floor(F.abs(F.element_at("embedding", (i + 1).cast("int"))) * 64)
    value = lambda i: F.when(F.col("vec_id") % 7 == 0, 0).otherwise((a(F.floor(i / 64)) + a(i % 64)) % 256).cast("long")
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.lpad(F.hex(value(i)), 2, "0")), ""))
    size = F.lit(64)
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), size.alias("width"), size.alias("height"), F.lit(1).alias("channels"), data.alias("data"), F.lit(True).alias("valid"))


PIXELS = """f AS (SELECT vec_id, [floor(abs(x) * 64)::INT FOR x IN embedding] AS a FROM embeddings),
x AS (SELECT vec_id, y, x, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE (a[y + 1] + a[x + 1]) % 256 END AS p FROM f, range(64) s(y), range(64) t(x))"""
BANDS = "(y < 8)::INT + (y >= 56)::INT + (x < 8)::INT + (x >= 56)::INT"


@query(f"""WITH {PIXELS} SELECT vec_id::VARCHAR AS path, round(stddev_pop(p), 2) AS pixel_std, avg((p < 4)::INT) AS dark_share, round(sum(p * ({BANDS})) / sum({BANDS}), 2) AS border_mean,
round(stddev_pop(p), 2) < 3 OR avg((p < 4)::INT) > 0.97 AS degenerate FROM x GROUP BY vec_id""")
def picture_statistics(spark, sf):
    """Deviation, dark share and border of pictures, and which are blank or black."""
    s = IM.with_statistics(pictures(spark, sf))
    return s.select("path", F.round("pixel_std", 2).alias("pixel_std"), "dark_share", F.round(F.get("border_mean", F.lit(0)), 2).alias("border_mean"), IM.degenerate().alias("degenerate"))
