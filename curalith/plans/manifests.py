"""Queries on manifests: exact resolution and its reports, saved splits, provenance, pools, prompts and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curalith.functions import prompts as P, scalar as S
from curalith.operators import curation as C, manifest as M, order as O, splits as SP
from curalith.streaming import attempts as ST

from .curation import ALIASES, M as MANIFEST, manifest, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# exact resolution

R = f"""{MANIFEST}, r AS (SELECT *, list_position(['test','val','train'], split) AS rk, count(*) OVER (PARTITION BY md5) AS n, min(class) OVER (PARTITION BY md5) <> max(class) OVER (PARTITION BY md5) AS mixed FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY rk, doc_id) AS pos FROM r),
d AS (SELECT doc_id, md5, class, source, split, CASE WHEN n > 1 AND mixed THEN 'conflicting_label' WHEN pos > 1 THEN 'exact_duplicate' END AS reason FROM k)"""


def _resolved(spark, sf) -> M.Resolved:
    return M.resolve_pools(manifest(spark, sf), path="doc_id")


@query(f"WITH {R} SELECT md5, doc_id AS path, source, class, split, reason FROM d WHERE reason IS NOT NULL")
def removed_files(spark, sf):
    return _resolved(spark, sf).removed


@query(f"WITH {R} SELECT source, reason, count(*) AS removed FROM d WHERE reason IS NOT NULL GROUP BY ALL")
def removals_by_reason(spark, sf):
    return _resolved(spark, sf).by_source


@query(f"WITH {R} SELECT source, count(*) AS original, count(*) FILTER (reason IS NULL) AS retained, count(*) FILTER (reason IS NOT NULL) AS removed FROM d GROUP BY 1")
def source_totals(spark, sf):
    return _resolved(spark, sf).totals


@query("SELECT n_chars FROM documents GROUP BY 1 HAVING count(DISTINCT md5(text)) > 1")
def digest_conflicts(spark, sf):
    """Short digests (here: the number of characters) that stand for several long ones."""
    return M.digest_conflicts(table(spark, sf, "documents").withColumn("md5", F.md5("text")), "n_chars", "md5")


Y = """s0 AS (SELECT doc_id, md5(text) AS d, lang AS c, (doc_id // 20)::VARCHAR AS p, doc_id % 20 // 4 AS v FROM documents WHERE doc_id % 4 = 1), re AS (SELECT DISTINCT md5(text) AS d FROM documents WHERE doc_id % 4 <> 1),
s1 AS (SELECT *, d IN (SELECT d FROM re) AS re, min(c) OVER (PARTITION BY d) <> max(c) OVER (PARTITION BY d) AS mixed, row_number() OVER (PARTITION BY d ORDER BY doc_id) AS k FROM s0),
s2 AS (SELECT *, CASE WHEN mixed THEN 'quarantined_synthetic_label_conflict' WHEN re THEN 'removed_shared_exact_real' WHEN k > 1 THEN 'removed_synthetic_exact_copy' ELSE 'eligible' END AS st FROM s1),
s3 AS (SELECT *, count(*) FILTER (st = 'eligible') OVER (PARTITION BY p) AS n, count(DISTINCT v) FILTER (st = 'eligible') OVER (PARTITION BY p) AS nv FROM s2),
y AS (SELECT doc_id, d, c, p, v, CASE WHEN st = 'eligible' AND NOT (n = 5 AND nv = 5) THEN 'quarantined_incomplete_prompt_group' ELSE st END AS status FROM s3)"""


def _synthetic(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("sha256"), "lang", F.lit("all").alias("class"), F.floor(F.col("doc_id") / 20).cast("string").alias("prompt_id"), F.floor(F.col("doc_id") % 20 / 4).alias("variant"))
    return M.synthetic_audit(d.where("doc_id % 4 = 1").withColumn("class", F.lit("all")), d.where("doc_id % 4 <> 1"), path="doc_id")


@query(f"WITH {Y.replace('lang AS c', chr(39) + 'all' + chr(39) + ' AS c')} SELECT doc_id, status FROM y")
def synthetic_audit(spark, sf):
    return _synthetic(spark, sf).select("doc_id", "status")




@query(f"WITH {Y.replace('lang AS c', chr(39) + 'all' + chr(39) + ' AS c')} SELECT 'synthetic' AS source, count(*) AS candidates, count(*) FILTER (status LIKE 'removed%') AS copies, count(*) FILTER (status LIKE '%conflict') AS conflicts, count(*) FILTER (status LIKE '%incomplete%') AS other, count(*) FILTER (status = 'eligible') AS retained FROM y")
def disposition_totals(spark, sf):
    groups = {"copies": ["removed_shared_exact_real", "removed_synthetic_exact_copy"], "conflicts": ["quarantined_synthetic_label_conflict"]}
    return M.disposition_totals(_synthetic(spark, sf).withColumn("source", F.lit("synthetic")), "source", "doc_id", "status", groups)


# saved splits

S1 = f"{MANIFEST}, s AS (SELECT 'elsewhere/' || class || '/' || doc_id || '.txt' AS path, md5 AS sha256, split, doc_id AS \"group\" FROM m)"


def _files(spark, sf) -> DataFrame:
    m = manifest(spark, sf)
    return m.select("doc_id", F.concat(F.lit("here/"), F.col("class"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "class", F.col("md5").alias("sha256"))


def _saved(spark, sf) -> DataFrame:
    m = manifest(spark, sf)
    return m.select(F.concat(F.lit("elsewhere/"), F.col("class"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"), F.col("md5").alias("sha256"), "split", F.col("doc_id").alias("group"), "class")


@query(f"WITH {S1} SELECT doc_id, m.split, doc_id AS \"group\" FROM m")
def manifest_attach(spark, sf):
    """A saved split found by class and file name, as the folder above has moved."""
    return M.attach(_files(spark, sf), _saved(spark, sf).drop("class"), ALIASES).select("doc_id", "split", "group")


@query(f"WITH {MANIFEST} SELECT doc_id, split, doc_id AS \"group\", class FROM m")
def frozen_reuse(spark, sf):
    return M.reuse_frozen(_files(spark, sf), _saved(spark, sf), ALIASES, same_count=True).select("doc_id", "split", "group", "class")


@query(f"WITH {MANIFEST} SELECT doc_id, md5 AS md5_actual, md5 AS md5_saved, class, size FROM m")
def one_to_one_join(spark, sf):
    m = manifest(spark, sf)
    return M.one_to_one(m.select("doc_id", "md5", "class"), m.select("doc_id", "md5", F.col("size").cast("long").alias("size")), "doc_id")


# provenance

O_ = """o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE source END AS source_dataset, CASE doc_id % 11 WHEN 0 THEN 'No' WHEN 1 THEN 'not_allowed' ELSE 'yes' END AS allowed, CASE doc_id % 13 WHEN 3 THEN 'Rejected' ELSE 'ok' END AS review FROM documents WHERE doc_id % 7 <> 0),
j AS (SELECT d.doc_id, d.source, coalesce(source_dataset, '') AS source_dataset, coalesce(allowed, '') AS allowed, coalesce(review, '') AS review, 'unknown' AS license FROM documents d LEFT JOIN o USING (doc_id))"""


@query(f"""WITH {O_} SELECT doc_id, lower(allowed) IN ('false','no','0','not_allowed') OR lower(review) IN ('reject','rejected','incorrect_label') AS rejected,
trim(source_dataset) <> '' AND source_dataset <> 'unknown' AS traceable, license <> 'unknown' AS licensed, 'real:' || doc_id AS record_id, CASE WHEN doc_id % 2 = 0 THEN source || '_' || doc_id // 10 END AS group_key FROM j""")
def provenance(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    i = F.col("doc_id")
    origin = d.where("doc_id % 7 <> 0").select("doc_id", F.when(i % 5 == 0, "unknown").otherwise(F.col("source")).alias("source_dataset"), F.when(i % 11 == 0, "No").when(i % 11 == 1, "not_allowed").otherwise("yes").alias("allowed"), F.when(i % 13 == 3, "Rejected").otherwise("ok").alias("review"))
    rows = M.with_provenance(d, origin, "doc_id", {"source_dataset": "unknown", "allowed": "unknown", "review": "unverified", "license": "unknown"})
    key = F.when(i % 2 == 0, F.concat_ws("_", "source", F.floor(i / 10).cast("string")))
    return rows.select("doc_id", M.provenance_rejected(F.col("allowed"), F.col("review")).alias("rejected"), M.known(F.col("source_dataset")).alias("traceable"), M.known(F.col("license")).alias("licensed"), F.concat(F.lit("real:"), i.cast("string")).alias("record_id"), key.alias("group_key"))


@query("SELECT doc_id, list_filter(CASE lang WHEN 'en' THEN ['src1', 'src7'] WHEN 'de' THEN ['src2'] ELSE [] END, lambda t: contains(lower(source), t)) AS matched FROM documents")
def suspicious_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.suspicious(F.col("source"), F.col("lang"), {"en": ["src1", "src7"], "de": ["src2"]}).alias("matched"))


@query("""SELECT l_orderkey, l_linenumber, name, CASE WHEN regexp_matches(name, '(?i)_p_\\d+_v_\\d+\\.jpg$') THEN 'synthetic' WHEN regexp_matches(name, '(?i)_(bcc|scc|mel)_\\d+\\.jpg$') THEN 'subtype' ELSE 'unknown' END AS kind,
nullif(regexp_extract(name, '(?i)_p_(\\d+)_v_(\\d+)\\.jpg$', 1), '') AS prompt_id, nullif(upper(regexp_extract(name, '(?i)_(bcc|scc|mel)_(\\d+)\\.jpg$', 1)), '') AS subtype
FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'a_P_' || l_orderkey || '_v_2.jpg' WHEN 1 THEN 'x_Mel_' || l_orderkey || '.jpg' WHEN 2 THEN 'x_bcc_1_p_7_V_' || l_orderkey || '.jpg' ELSE 'plain.jpg' END AS name FROM lineitem)""")
def file_kinds(spark, sf):
    n, k = F.col("l_linenumber") % 4, F.col("l_orderkey").cast("string")
    name = F.when(n == 0, F.concat(F.lit("a_P_"), k, F.lit("_v_2.jpg"))).when(n == 1, F.concat(F.lit("x_Mel_"), k, F.lit(".jpg"))).when(n == 2, F.concat(F.lit("x_bcc_1_p_7_V_"), k, F.lit(".jpg"))).otherwise("plain.jpg")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"))
    kind = S.file_kind(F.col("name"), ("BCC", "SCC", "MEL"))
    return rows.withColumn("x", kind).select("l_orderkey", "l_linenumber", "name", "x.kind", "x.prompt_id", "x.subtype")


# splits and pools

CUT = """held AS (SELECT *, ceil(n * 0.3::DOUBLE - 1e-9) AS h FROM pos), cut AS (SELECT *, CASE WHEN n < {least} OR p <= n - h THEN 'train' WHEN p <= n - ceil(h / 2) THEN 'val' ELSE 'test' END AS split FROM held)"""


@query(f"WITH pos AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('sub:' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY source) AS n FROM documents), {CUT.format(least=3)} SELECT doc_id, source, split FROM cut")
def subtype_split(spark, sf):
    return SP.counted_split(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", "sub")


@query(f"""WITH g AS (SELECT conv_id, count(*) = 5 AND count(DISTINCT turn) = 5 AS ok FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1),
pos AS (SELECT conv_id, row_number() OVER (ORDER BY md5('syn:' || 'c_' || conv_id), 'c_' || conv_id) AS p, count(*) OVER () AS n FROM g WHERE ok), {CUT.format(least=1)},
w AS (SELECT conv_id, turn, coalesce(split, 'excluded') AS split FROM conversations LEFT JOIN cut USING (conv_id) WHERE conv_id % 3 <> 0),
pos2 AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY md5('syn:' || (conv_id || ':' || turn)), conv_id || ':' || turn) AS p, count(*) OVER (PARTITION BY role) AS n FROM conversations WHERE conv_id % 3 = 0 AND turn > 0),
t AS (SELECT conv_id, turn, CASE WHEN n < 3 OR p <= n - ceil(n * 0.3::DOUBLE - 1e-9) THEN 'train' WHEN p <= n - ceil(ceil(n * 0.3::DOUBLE - 1e-9) / 2) THEN 'val' ELSE 'test' END AS split FROM pos2)
SELECT * FROM w UNION ALL SELECT * FROM t UNION ALL SELECT conv_id, turn, 'excluded' FROM conversations WHERE conv_id % 3 = 0 AND turn <= 0""")
def synthetic_split(spark, sf):
    """Whole prompts, single rows of subtypes, and rows that are neither."""
    c = table(spark, sf, "conversations")
    rows = c.select("conv_id", "turn", F.lit("c").alias("class"), F.when(F.col("conv_id") % 3 != 0, F.col("conv_id").cast("string")).alias("prompt"), F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") > 0), F.col("role")).alias("subtype"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"))
    return SP.synthetic_split(rows, "class", "prompt", "turn", "subtype", "key", seed="syn").select("conv_id", "turn", "split")


def taken_sql(rows: str, fraction: str, seed: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('{seed}:' || doc_id), doc_id) AS tp, count(*) OVER (PARTITION BY class) AS tn FROM {rows}) WHERE tp <= least(tn, greatest(1, round_even(tn * {fraction}::DOUBLE, 0)))"


POOLS = f"""{MANIFEST}, u AS (SELECT doc_id, md5, class, CASE WHEN doc_id % 3 = 0 THEN 'synthetic' ELSE 'real' END AS source, split FROM m),
r AS (SELECT *, list_position(['test','val','train'], split) AS rk, count(*) OVER (PARTITION BY md5) AS n, min(class) OVER (PARTITION BY md5) <> max(class) OVER (PARTITION BY md5) AS mixed FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY rk, doc_id) AS pos FROM r), kept AS (SELECT doc_id, class, source, split FROM k WHERE NOT (n > 1 AND mixed) AND pos = 1),
tr AS (SELECT * FROM kept WHERE split = 'train'), syn AS (SELECT * FROM tr WHERE source = 'synthetic'), rea AS (SELECT * FROM tr WHERE source = 'real'),
mix AS ({taken_sql('syn', '0.5', 'run/synthetic')} UNION ALL {taken_sql('rea', '0.3', 'run/real')})"""


def _pools(spark, sf) -> SP.Pools:
    m = manifest(spark, sf).select("doc_id", "md5", "class", "split")
    sources = {"synthetic": m.where("doc_id % 3 = 0"), "real": m.where("doc_id % 3 <> 0")}
    return SP.build_pools(sources, "class", "doc_id", "md5", {"synthetic": 0.5, "real": 0.3}, "run")


@query(f"WITH {POOLS} SELECT doc_id, class, source, 'train' AS pool FROM mix UNION ALL SELECT doc_id, class, source, split FROM kept WHERE split <> 'train'")
def run_pools(spark, sf):
    p = _pools(spark, sf)
    part = lambda df, name: df.select("doc_id", "class", "source", F.lit(name).alias("pool"))
    return part(p.train, "train").unionByName(part(p.val, "val")).unionByName(part(p.test, "test"))


@query(f"WITH {POOLS} SELECT doc_id, class, source, split FROM kept")
def pool_manifest(spark, sf):
    return _pools(spark, sf).manifest


@query(f"""WITH {POOLS}, a AS (SELECT class, count(*) FILTER (source = 'synthetic') AS synthetic_available, count(*) FILTER (source = 'real') AS real_available FROM tr GROUP BY 1),
b AS (SELECT class, count(*) FILTER (source = 'synthetic') AS synthetic_used, count(*) FILTER (source = 'real') AS real_used FROM mix GROUP BY 1)
SELECT class, synthetic_available, real_available, coalesce(synthetic_used, 0) AS synthetic_used, coalesce(real_used, 0) AS real_used, round(100 * coalesce(real_used, 0) / greatest(coalesce(synthetic_used, 0) + coalesce(real_used, 0), 1), 1) AS "achieved_real_%" FROM a LEFT JOIN b USING (class)""")
def mix_report(spark, sf):
    return _pools(spark, sf).mix


@query(f"""WITH {MANIFEST}, s AS (SELECT *, doc_id // 2 AS g FROM m)
SELECT 'split_known' AS name, 0::BIGINT AS violations UNION ALL SELECT 'unique_ids', 0 UNION ALL SELECT 'group_in_one_split', count(*) FROM (SELECT g FROM s GROUP BY 1 HAVING min(split) <> max(split))
UNION ALL SELECT 'digest_in_one_split', count(*) FROM (SELECT md5 FROM s GROUP BY 1 HAVING min(split) <> max(split)) UNION ALL SELECT 'no_group', 0
UNION ALL SELECT 'class_in_every_split', count(*) FROM (SELECT c.class, x.split FROM (SELECT DISTINCT class FROM s) c, (VALUES ('train'), ('val'), ('test')) x(split) EXCEPT SELECT class, split FROM s)
UNION ALL SELECT 'least_class_size', count(*) FROM (SELECT class FROM s GROUP BY 1 HAVING count(*) < 40)""")
def split_constraints(spark, sf):
    m = manifest(spark, sf).withColumn("g", F.floor(F.col("doc_id") / 2))
    return C.constraints(SP.split_constraints(m, "doc_id", "g", "class", "md5", least=40))


# positions, pivots, fingerprints

@query("SELECT * EXCLUDE (k) FROM (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 8")
def longest_rows(spark, sf):
    """The first eight rows of each class of a report."""
    return O.first_rows(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 8)


@query("SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS id FROM documents")
def dense_codes(spark, sf):
    return O.dense_ids(table(spark, sf, "documents").select("doc_id", "source"), "source").select("doc_id", "id")


@query(f"WITH {MANIFEST} SELECT class, avg(size) FILTER (split = 'train') AS train, avg(size) FILTER (split = 'val') AS val, avg(size) FILTER (split = 'test') AS test FROM m GROUP BY 1")
def mean_size_by_split(spark, sf):
    return manifest(spark, sf).groupBy("class").pivot("split", ["train", "val", "test"]).agg(F.avg("size"))


@query("WITH n AS (SELECT l AS lang, count(d.lang) AS n FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('xx')) c(l) LEFT JOIN documents d ON d.lang = l GROUP BY 1) SELECT lang, n, CASE WHEN n > 0 THEN sum(n) OVER () / (5 * n)::DOUBLE ELSE 1 END AS weight FROM n")
def named_class_weights(spark, sf):
    return C.class_weights(table(spark, sf, "documents"), "lang", ["en", "de", "fr", "es", "xx"])


@query("SELECT event_id, (props->>'k')::BIGINT AS k, '{\"event_type\":\"' || event_type || '\",\"k\":' || (props->>'k') || '}' AS record FROM events")
def json_records(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct("event_type", F.col("p.k").alias("k"))).alias("record"))


# prompts, tasks and attempts

GRID = P.Grid(("papular", "nodular", "open"), ("on the cheeks", "on the chin", "on the forehead", "on the nose"))
PREFIX, ANCHOR = "Sharp picture. ", "Natural anatomy"
TEMPLATE = "Portrait of a {age}-year-old {gender} of type {tone}, with {article} {phenotype} finding, {severity}, {distribution}. Natural anatomy, soft light."


def seed_sql(*parts: str) -> str:
    return "('0x' || right(md5(" + " || '|' || ".join(parts) + "), 8))::BIGINT"


OWN = seed_sql("class", "phenotype", "gender", "variation_group", "idx")
DRAW = lambda name, n: f"{seed_sql(OWN, chr(39) + name + chr(39))} % {n}"


def setting_sql(own: str, values: str, n: int, default: str) -> str:
    return f"CASE variation_group WHEN '{own}' THEN {values}[idx % {n} + 1] WHEN 'combined' THEN {values}[{DRAW(own, n)} + 1] ELSE '{default}' END"


G = f"""pt AS (SELECT p_partkey AS id, p_partkey % 300 AS slot, lower(replace(p_brand, '#', ' ')) AS class FROM part),
g0 AS (SELECT id, class, {list(GRID.phenotypes)}[slot // 100 + 1] AS phenotype, ['female', 'male'][slot // 50 % 2 + 1] AS gender, {list(P.AXES)}[slot // 10 % 5 + 1] AS variation_group, (slot % 10)::INT AS idx FROM pt),
g1 AS (SELECT *, CASE WHEN variation_group = 'combined' THEN {DRAW('range', 3)} ELSE idx % 3 END AS span FROM g0), g2 AS (SELECT *, [16, 26, 41][span + 1] AS lo, [24, 38, 58][span + 1] AS hi FROM g1),
g AS (SELECT id, class, phenotype, gender, variation_group, idx, (CASE WHEN variation_group IN ('age', 'combined') THEN lo + {DRAW('age', '(hi - lo + 1)')} ELSE 32 END)::INT AS age,
{setting_sql('severity', "['mild', 'moderate', 'severe']", 3, 'moderate')} AS severity, {setting_sql('skin_tone', "['I', 'II', 'III', 'IV', 'V', 'VI']", 6, 'III')} AS tone,
{setting_sql('anatomical_distribution', str(list(GRID.distributions)), 4, 'on the cheeks')} AS distribution, {seed_sql('class', 'phenotype', 'gender', 'variation_group', 'idx', "'img'")} AS seed_base FROM g2)"""


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt for each part, whose brand is its class."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower(F.regexp_replace("p_brand", "#", " ")).alias("class"))
    return P.records_of(rows, GRID)


@query(f"WITH {G} SELECT * FROM g")
def prompt_records(spark, sf):
    return _prompts(spark, sf)


@query(f"""WITH {G}, t AS (SELECT id, 'Portrait of a ' || age || '-year-old ' || gender || ' of type ' || tone || ', with ' || CASE WHEN left(phenotype, 1) IN ('a','e','i','o','u') THEN 'an' ELSE 'a' END || ' ' || phenotype || ' finding, ' || severity || ', ' || distribution || '. Natural anatomy, soft light.' || CASE WHEN id % 3 = 0 THEN ' More' ELSE '' END AS text FROM g)
SELECT id, text, 'Sharp picture. ' || CASE WHEN text LIKE '%.' THEN rtrim(left(text, instr(text, 'Natural anatomy') - 1)) ELSE text END AS final FROM t""")
def prompt_texts(spark, sf):
    p = _prompts(spark, sf)
    values = {c: F.col(c) for c in ("age", "gender", "tone", "phenotype", "severity", "distribution")}
    text = F.concat(P.filled(TEMPLATE, article=P.article(F.col("phenotype")), **values), F.when(F.col("id") % 3 == 0, " More").otherwise(""))
    return p.select("id", text.alias("text")).withColumn("final", P.final_prompt(F.col("text"), PREFIX, ANCHOR))


@query("""SELECT id, variant, attempt, printf('cls%02d_p_%03d_v_%d.png', 7, id + 1, variant) AS filename, (1000 + id * 7919 + (variant - 1) * 104729 + attempt * 15485863) % 4294967296 AS seed
FROM (SELECT p_partkey AS id FROM part), (SELECT unnest(range(1, 6))::INT AS variant), (SELECT unnest(range(3))::INT AS attempt)""")
def task_expansion(spark, sf):
    return P.task_expansion(_prompts(spark, sf).select("id"), 5, 7)


@query("""SELECT id, variant FROM (SELECT p_partkey AS id FROM part ORDER BY 1 LIMIT 40), (SELECT unnest(range(1, 6))::INT AS variant) WHERE (id * 5 + variant) % 7 <> 0""")
def pending_tasks(spark, sf):
    """Tasks of the first forty prompts, a set limit, whose files do not exist yet."""
    tasks = P.task_expansion(_prompts(spark, sf).orderBy("id").limit(40).select("id"), 5, 7, retries=1)
    done = tasks.where((F.col("id") * 5 + F.col("variant")) % 7 == 0).select("filename")
    return M.pending(tasks, done, "filename").select("id", "variant")


TRIED = "SELECT l_orderkey, count(*) AS tried, min(l_linenumber - 1) FILTER (l_returnflag = 'R') AS success FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1"


def _attempts(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("attempt"), (F.col("l_returnflag") == "R").alias("ok"))


@query(f"SELECT l_orderkey, success, CASE WHEN success IS NULL THEN tried ELSE success + 1 END::BIGINT AS used FROM ({TRIED})")
def first_attempts(spark, sf):
    return P.first_success(_attempts(spark, sf), ["l_orderkey"], "attempt", "ok")


@query(TRIED)
def streamed_attempts(spark, sf):
    """The same over a stream, with state on disk."""
    return ST.first_success(spark, _attempts(spark, sf), ["l_orderkey"], "attempt", "ok")


@query("""SELECT c_custkey - 1 AS id, 'acne' AS class, 'custom' AS phenotype, 'unspecified' AS gender, 'custom' AS variation_group, c_name AS prompt, ('0x' || right(md5('acne|custom|' || (c_custkey - 1)), 8))::BIGINT AS seed_base FROM customer""")
def custom_prompts(spark, sf):
    """Saved lines without records of their own."""
    lines = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    return P.load_or_build(_prompts(spark, sf), lines, _prompts(spark, sf).limit(1), "acne")
