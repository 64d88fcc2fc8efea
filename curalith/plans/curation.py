"""Curation queries over documents, conversations and embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curalith.functions import scalar as S
from curalith.operators import audit as A, curation as C, growing as GR, links as L, manifest as MA, splits as SP
from curalith.operators.graph import connected_components
from curalith.operators.selection import exact_percentiles
from curalith.storage import fresh_path, materialise

TOKENS = ("src1", "src7")
ALIASES = {"en": "English", "de": "German", "fr": "French"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a manifest: digest, class, and a split by keyed hash."""
    d = table(spark, sf, "documents")
    u = F.conv(F.substring(S.keyed_hash("split", F.col("doc_id")), 1, 8), 16, 10).cast("long") % 100
    return d.select("doc_id", F.md5("text").alias("md5"), F.col("lang").alias("class"), "source", F.length("text").alias("size"), F.when(u < 70, "train").when(u < 85, "val").otherwise("test").alias("split"))


M = """m AS (SELECT doc_id, md5(text) AS md5, lang AS class, source, length(text) AS size,
  CASE WHEN u < 70 THEN 'train' WHEN u < 85 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || substr(md5('split:' || doc_id), 1, 8))::BIGINT % 100 AS u FROM documents))"""

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT doc_id, length(text) >= 32 AS valid, list_filter(['src1','src7'], lambda t: contains(lower(source), t)) AS tokens FROM documents""")
def inventory(spark, sf):
    found = F.filter(F.array(*map(F.lit, TOKENS)), lambda t: F.instr(F.lower("source"), t) > 0)
    return table(spark, sf, "documents").select("doc_id", (F.length("text") >= 32).alias("valid"), found.alias("tokens"))


@query("""SELECT r AS name, CASE lower(regexp_replace(trim(r), '[-\\s]+', '_', 'g')) WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE r END AS class, count(*) AS n
FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN ' ' || upper(lang) ELSE lang END AS r FROM documents) GROUP BY 1, 2""")
def canonical_classes(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.upper("lang"))).otherwise(F.col("lang")).alias("name"))
    return d.select("name", S.canonical_class(F.col("name"), ALIASES).alias("class")).groupBy("name", "class").agg(F.count("*").alias("n"))


@query("""SELECT path, regexp_extract(path, '_p_(\\d+)_v_(\\d+)\\.jpg$', 1) AS prompt_id, regexp_extract(path, '_p_(\\d+)_v_(\\d+)\\.jpg$', 2)::INT AS variant,
('0x' || right(md5(l_orderkey || '|' || l_linenumber), 8))::BIGINT AS seed, (1000 + (l_orderkey - 1) * 7919 + (l_linenumber - 1) * 104729) % 4294967296 AS positional_seed
FROM (SELECT *, 'x/cls01_p_' || lpad(l_orderkey::VARCHAR, 9, '0') || '_v_' || l_linenumber || '.jpg' AS path FROM lineitem)""")
def parse_names_and_seeds(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("path", F.format_string("x/cls01_p_%09d_v_%d.jpg", "l_orderkey", "l_linenumber"))
    stem = S.stem(F.col("path"))
    seed = (1000 + (F.col("l_orderkey") - 1) * 7919 + (F.col("l_linenumber") - 1) * 104729) % 4294967296
    return d.select("path", F.regexp_extract(stem, r"_p_(\d+)_v_(\d+)$", 1).alias("prompt_id"), F.regexp_extract(stem, r"_p_(\d+)_v_(\d+)$", 2).cast("int").alias("variant"), S.stable_seed(F.col("l_orderkey"), F.col("l_linenumber")).alias("seed"), seed.alias("positional_seed"))


D1 = f"""WITH {M}, r AS (SELECT *, list_position(['test','val','train'], split) AS rk, count(*) OVER (PARTITION BY md5) AS n,
  min(class) OVER (PARTITION BY md5) <> max(class) OVER (PARTITION BY md5) AS mixed FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY rk, doc_id) AS pos FROM r),
d AS (SELECT doc_id, md5, class, source, split, CASE WHEN n > 1 AND mixed THEN 'conflicting_label' WHEN pos > 1 THEN 'exact_duplicate' END AS reason FROM k) """


@query(D1 + "SELECT doc_id, split, reason FROM d")
def exact_dup_resolution(spark, sf):
    return C.resolve_exact(manifest(spark, sf), "md5", "class", "split", "doc_id").select("doc_id", "split", "reason")


@query(D1 + "SELECT source, count(*) AS original, count(*) FILTER (reason IS NULL) AS retained, count(*) FILTER (reason IS NOT NULL) AS removed, count(*) FILTER (reason = 'exact_duplicate') AS copies FROM d GROUP BY 1")
def removal_totals(spark, sf):
    d = C.resolve_exact(manifest(spark, sf), "md5", "class", "split", "doc_id")
    gone = F.col("reason").isNotNull()
    return d.groupBy("source").agg(F.count("*").alias("original"), F.count_if(~gone).alias("retained"), F.count_if(gone).alias("removed"), F.count_if(F.col("reason") == "exact_duplicate").alias("copies"))


@query(f"WITH {M} SELECT doc_id, row_number() OVER (PARTITION BY md5 ORDER BY doc_id) > 1 AS duplicate FROM m")
def duplicated_keep_first(spark, sf):
    return C.keep_first(manifest(spark, sf), "md5", "doc_id").select("doc_id", "duplicate")


#: Everything in ASCII but letters and digits.
MARKS = r"[\x01-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, md5(text) AS a, md5(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{MARKS}', ' ', 'g')) AS b FROM documents),
e AS (SELECT x.doc_id AS u, y.doc_id AS v FROM d x JOIN d y ON x.a = y.a OR x.b = y.b),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT u AS doc_id, min(v) AS group_id FROM r GROUP BY 1""")
def duplicate_groups(spark, sf):
    """Groups of links by several keys of whole texts: equal texts, and texts equal but for case and marks."""
    plain = F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), MARKS, " ")
    d = materialise(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("a"), F.md5(plain).alias("b")), "keys")
    comp = connected_components(C.star_edges(d, "a", "doc_id").unionByName(C.star_edges(d, "b", "doc_id")))
    return d.join(comp, d["doc_id"] == comp["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("group_id"))


DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, md5(text) AS a, md5(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{MARKS}', ' ', 'g')) AS b FROM documents),
"""


@query(DUPLICATES + """e AS (SELECT x.doc_id AS u, y.doc_id AS v FROM d x JOIN d y ON x.a = y.a OR x.b = y.b),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT u AS doc_id, min(v) AS group_id FROM r GROUP BY 1""")
def growing_groups(spark, sf):
    """The same groups from documents that arrive in three batches, each of which reads only its own and the saved state."""
    plain = F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), MARKS, " ")
    d = materialise(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("a"), F.md5(plain).alias("b")), "keys")
    state = fresh_path(spark, "growing")
    for i in range(3):
        GR.add_batch(d.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == i), "doc_id", ["a", "b"], state, i)
    found = GR.groups(spark, state, 3)
    return d.join(found, d["doc_id"] == found["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("group_id"))


PATIENT = "CASE WHEN doc_id % 3 = 0 THEN '  ' WHEN doc_id % 11 = 1 THEN NULL ELSE (doc_id // 7)::VARCHAR END"


@query(DUPLICATES.replace(" FROM documents),", f", CASE WHEN doc_id % 13 = 0 THEN 'unknown' ELSE source END AS s, trim(coalesce({PATIENT}, '')) AS p FROM documents),") + """k AS (SELECT *, p <> '' AND s IS NOT NULL AND trim(s) NOT IN ('', 'unknown') AS known FROM d),
e AS (SELECT x.doc_id AS u, y.doc_id AS v FROM k x JOIN k y ON x.a = y.a UNION SELECT x.doc_id, y.doc_id FROM k x JOIN k y ON x.known AND y.known AND x.p = y.p AND x.s = y.s),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT u AS doc_id, min(v) AS group_id FROM r GROUP BY 1""")
def patient_groups(spark, sf):
    """Groups by equal content and by pseudonym, where both patient and source are known."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("a"), F.when(i % 13 == 0, "unknown").otherwise(F.col("source")).alias("s"), F.when(i % 3 == 0, "  ").when(i % 11 == 1, None).otherwise(F.floor(i / 7).cast("string")).alias("patient"))
    name = F.when(MA.known(F.col("patient")) & MA.known(F.col("s")), A.pseudonym(b"curalith", F.col("s"), F.trim("patient")))
    d = materialise(d.select("doc_id", "a", name.alias("p")), "keys")
    comp = connected_components(C.star_edges(d, "a", "doc_id").unionByName(C.star_edges(d, "p", "doc_id")))
    return d.join(comp, d["doc_id"] == comp["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("group_id"))


@query(f"WITH {M} SELECT class, source, count(*) FILTER (split='train') AS train, count(*) FILTER (split='val') AS val, count(*) FILTER (split='test') AS test, count(*) AS total FROM m GROUP BY 1, 2")
def source_crosstab(spark, sf):
    """Counts by two keys, with what does not occur as 0 and the total."""
    by = manifest(spark, sf).groupBy("class", "source").pivot("split", ["train", "val", "test"]).count().na.fill(0, ["train", "val", "test"])
    return by.withColumn("total", F.col("train") + F.col("val") + F.col("test"))


@query(f"WITH {M} SELECT doc_id, CASE WHEN min(source) OVER (PARTITION BY md5) <> max(source) OVER (PARTITION BY md5) THEN 'quarantined_cross_class' ELSE 'eligible' END AS status FROM m")
def cross_class_quarantine(spark, sf):
    return C.quarantine_cross_class(manifest(spark, sf), "md5", "source").select("doc_id", "status")


@query("""WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('r1:' || doc_id), doc_id) AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, CASE WHEN pos <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN pos <= round_even(n * 0.85::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM h""")
def stratified_split(spark, sf):
    return C.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", "r1").select("doc_id", "split")


def best_split_sql(rows: str, share: str, seed: str, name: str, tries: int = 200) -> str:
    """The best of many shuffles of the groups ``(g, c)`` of a table, as common table expressions that end in ``name`` (g, held_out)."""
    n = name
    return f"""{n}_s AS (SELECT g, c, count(*) AS n FROM {rows} GROUP BY 1, 2), {n}_t AS (SELECT sum(n)::DOUBLE AS total, count(DISTINCT g) AS k FROM {n}_s),
{n}_p AS (SELECT c, sum(n) / (SELECT total FROM {n}_t) AS p FROM {n}_s GROUP BY 1), {n}_gs AS (SELECT DISTINCT g FROM {n}_s),
{n}_tr AS (SELECT g, i, row_number() OVER (PARTITION BY i ORDER BY md5('{seed}:' || i || ':' || g), g) AS pos FROM {n}_gs, range({tries}) x(i)),
{n}_h AS (SELECT i, g FROM {n}_tr, {n}_t WHERE pos <= ceil({share}::DOUBLE * k)),
{n}_sd AS (SELECT i, c, sum(n) AS n FROM {n}_h JOIN {n}_s USING (g) GROUP BY 1, 2), {n}_nb AS (SELECT i, sum(n) AS nb FROM {n}_sd GROUP BY 1),
{n}_sc AS (SELECT nb.i, max(abs(coalesce(sd.n / nb.nb, 0) / p.p - 1)) + 2 * abs(max(nb.nb) / max(total) - {share}::DOUBLE) AS score FROM {n}_nb nb CROSS JOIN {n}_p p CROSS JOIN {n}_t LEFT JOIN {n}_sd sd ON sd.i = nb.i AND sd.c = p.c GROUP BY 1),
{n}_b AS (SELECT i FROM {n}_sc ORDER BY round(score, 9), i LIMIT 1),
{n} AS (SELECT g, g IN (SELECT g FROM {n}_h JOIN {n}_b USING (i)) AS held_out FROM {n}_gs)"""


@query(f"""WITH d AS (SELECT md5(text) AS g, lang AS c FROM documents), {best_split_sql('d', '0.3', 'r2', 'x')} SELECT g AS "group", held_out FROM x""")
def best_group_split(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("group"), F.col("lang").alias("class"))
    return C.best_group_split(d, "group", "class", 0.3, 200, "r2")


@query(f"""WITH d AS (SELECT doc_id, md5(text) AS g, lang AS c FROM documents), {best_split_sql('d', '0.3', 'r3', 'x')},
e AS (SELECT d.* FROM d JOIN x USING (g) WHERE held_out), {best_split_sql('e', '0.5', 'r3/held', 'y')}
SELECT doc_id, CASE WHEN NOT x.held_out THEN 'train' WHEN y.held_out THEN 'test' ELSE 'val' END AS split FROM d JOIN x USING (g) LEFT JOIN y USING (g)""")
def three_way_group_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("group"), F.col("lang").alias("class"))
    return SP.two_stage_group_split(d, "group", "class", 0.3, 200, "r3").select("doc_id", "split")


@query("SELECT conv_id, count(*) AS rows, count(DISTINCT turn) AS variants, count(*) = 5 AND count(DISTINCT turn) = 5 AS complete FROM conversations GROUP BY 1")
def complete_groups(spark, sf):
    return C.complete_groups(table(spark, sf, "conversations"), ["conv_id"], "turn", 5)


@query("""WITH h AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('mix:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source FROM h WHERE r <= least(n, greatest(1, round_even(n * 0.3::DOUBLE, 0)))""")
def sample_fraction(spark, sf):
    return C.sample_fraction(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 0.3, "mix")


@query("""WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('bal:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
t AS (SELECT round_even(count(*) / count(DISTINCT lang)::DOUBLE, 0)::BIGINT AS t FROM documents WHERE lang IS NOT NULL),
dr AS (SELECT lang, ('0x' || substr(md5('bal:' || lang || ':' || i), 1, 8))::BIGINT % n + 1 AS at_, count(*) AS more FROM (SELECT lang, n, unnest(range(1, t - n + 1)) AS i FROM (SELECT DISTINCT lang, n FROM h), t WHERE n < t) GROUP BY 1, 2)
SELECT doc_id, h.lang, (1 + coalesce(more, 0))::BIGINT AS copies FROM h CROSS JOIN t LEFT JOIN dr ON h.lang = dr.lang AND r = at_ WHERE h.lang IS NOT NULL AND r <= t""")
def balance(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").where("lang IS NOT NULL")
    mean = C.mean_class_size(d, "lang")
    return C.balance(d, "lang", "doc_id", mean, mean, "bal")


@query("SELECT lang, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE AS weight FROM documents GROUP BY 1")
def class_weights(spark, sf):
    return C.class_weights(table(spark, sf, "documents"), "lang")


@query(f"""WITH {M}, b AS (SELECT substr(md5(l), 1, 3) AS b, sha256(string_agg(l, chr(10) ORDER BY l)) AS d, count(*) AS n FROM (SELECT doc_id || '|' || md5 || '|' || class AS l FROM m) GROUP BY 1)
SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS fingerprint, sum(n)::BIGINT AS n FROM b""")
def manifest_fingerprint(spark, sf):
    return C.fingerprint(manifest(spark, sf), F.concat_ws("|", "doc_id", "md5", "class"))


@query(f"""WITH {M} SELECT 'split_known' AS name, count(*) FILTER (split NOT IN ('train','val','test')) AS violations FROM m
UNION ALL SELECT 'unique_ids', count(*) FROM (SELECT doc_id FROM m GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'digest_in_one_split', count(*) FROM (SELECT md5 FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'least_class_size', count(*) FROM (SELECT class FROM m GROUP BY 1 HAVING count(*) < 30)""")
def integrity_constraints(spark, sf):
    m = manifest(spark, sf)
    return C.constraints({
        "split_known": m.where(~F.col("split").isin("train", "val", "test")),
        "unique_ids": m.groupBy("doc_id").count().where("count > 1"),
        "digest_in_one_split": m.groupBy("md5").agg(F.count_distinct("split").alias("k")).where("k > 1"),
        "least_class_size": m.groupBy("class").count().where("count < 30"),
    })


@query(f"WITH {M}, t AS (SELECT DISTINCT md5 FROM m WHERE split = 'train') SELECT split, avg((m.md5 IN (SELECT md5 FROM t))::INT) AS leaked, count(*) AS n FROM m WHERE split <> 'train' GROUP BY 1")
def split_leakage(spark, sf):
    m = manifest(spark, sf)
    train = m.where("split = 'train'").select("md5").distinct().withColumn("hit", F.lit(1))
    return m.where("split <> 'train'").join(train, "md5", "left").groupBy("split").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("leaked"), F.count("*").alias("n"))


@query(f"WITH {M} SELECT class, count(*) FILTER (split='train') AS train, count(*) FILTER (split='val') AS val, count(*) FILTER (split='test') AS test FROM m GROUP BY 1")
def split_crosstab(spark, sf):
    return manifest(spark, sf).groupBy("class").pivot("split", ["train", "val", "test"]).count().na.fill(0)


@query(f"WITH {M} SELECT class, count(*) AS n, count(DISTINCT md5) AS groups, count(DISTINCT md5) / count(*) AS groups_per_row, avg(size) AS mean, median(size) AS median, quantile_cont(size, 0.95) AS p95, quantile_cont(size, 0.99) AS p99, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM m GROUP BY 1")
def class_statistics(spark, sf):
    m = materialise(manifest(spark, sf), "manifest")
    out = m.groupBy("class").agg(F.count("*").alias("n"), F.count_distinct("md5").alias("groups"), (F.count_distinct("md5") / F.count("*")).alias("groups_per_row"), F.avg("size").alias("mean"), F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"))
    at = exact_percentiles(m, ["class"], "size", {"median": 0.5, "p95": 0.95, "p99": 0.99}).withColumnRenamed("class", "_class")
    return out.join(at, F.col("class").eqNullSafe(F.col("_class")), "left").drop("_class")


@query("""SELECT 'both' AS side, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'any', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""")
def key_sets(spark, sf):
    a, b = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    out = [("both", a.intersect(b)), ("unlabelled", a.join(b, "doc_id", "left_anti").distinct()), ("any", a.union(b).distinct())]
    rows = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("side"), "n") for k, x in out]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


NORMED = """c AS (SELECT i, avg(x::DOUBLE) AS m FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1),
mean AS (SELECT list(m ORDER BY i) AS m FROM c), v AS (SELECT vec_id, label, list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE - m[i]) AS v FROM embeddings, mean),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v)"""


@query(f"WITH {NORMED} SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.4")
def cosine_links(spark, sf):
    return L.cosine_links(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4, whole=True).select("src", "dst", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT p_partkey + 1 AS id, lower(replace(p_brand, '#', ' ')) AS class, p_partkey % 300 AS slot FROM part)
SELECT class, slot // 100 AS phenotype, slot // 50 % 2 AS gender, slot // 10 % 5 AS variation, slot % 10 AS idx, id, ('0x' || right(md5(class || '|' || id), 8))::BIGINT AS seed, CASE WHEN slot // 10 % 5 = 1 THEN slot % 10 % 4 ELSE 0 END AS severity FROM p""")
def prompt_grid(spark, sf):
    """A place in the grid of settings for each part, whose brand is its class."""
    p = table(spark, sf, "part").select(F.lower(F.regexp_replace("p_brand", "#", " ")).alias("class"), (F.col("p_partkey") + 1).alias("id"), (F.col("p_partkey") % 300).alias("n"))
    at = lambda width, k: F.floor(F.col("n") / width) % k
    g = p.select("class", at(100, 3).alias("phenotype"), at(50, 2).alias("gender"), at(10, 5).alias("variation"), at(1, 10).alias("idx"), "id")
    return g.select("*", S.stable_seed(F.col("class"), F.col("id")).alias("seed"), F.when(F.col("variation") == 1, F.col("idx") % 4).otherwise(0).alias("severity"))
