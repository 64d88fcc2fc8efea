"""Audit queries over documents, conversations, embeddings and line items, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalith.operators import audit as A, curation as C, links as L

from .curation import M, NORMED, manifest, table

Q: dict = {}
SQL: dict[str, str] = {}
KEY = b"curalith"


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pad(b: int) -> str:
    return bytes(x ^ b for x in KEY.ljust(64, b"\0")).hex()


@query(f"""SELECT user_id, event_type, left(sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(event_type || '|' || user_id)))), 32) AS pseudonym
FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def pseudonyms(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type").distinct()
    return e.withColumn("pseudonym", A.pseudonym(KEY, F.col("event_type"), F.col("user_id").cast("string")))


@query("""SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > list_median(list_transform(embedding, lambda y: y::DOUBLE)) THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM embeddings""")
def hash_bits(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", A.median_bits(F.col("embedding")).alias("bits"))


UNIT = "u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM u)"
NEAR = f"""WITH {UNIT}, p AS (SELECT a.vec_id AS query, a.label, b.vec_id AS reference, list_dot_product(a.v, b.v) / (a.n * b.n) AS score FROM n a JOIN n b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, reference) AS r FROM p), f AS (SELECT * FROM k WHERE r = 1) """


def _near(spark, sf):
    e = table(spark, sf, "embeddings")
    return A.nearest(e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0"), "vec_id", "embedding")


@query(NEAR + "SELECT query, reference, round(score, 6) AS score FROM f")
def nearest_in_train(spark, sf):
    return _near(spark, sf).withColumn("score", F.round("score", 6))


@query(NEAR + "SELECT label, count(*) AS n, round(median(score), 6) AS median, round(max(score), 6) AS most, avg((score >= 0.4)::INT) AS share_40, avg((score >= 0.45)::INT) AS share_45, count(*) FILTER (score >= 0.4) AS n_40, count(*) FILTER (score >= 0.45) AS n_45 FROM f GROUP BY 1")
def neighbour_audit(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query"), "label")
    out = A.neighbour_report(_near(spark, sf).join(e, "query"), ["label"], (0.4, 0.45))
    return out.withColumns({c: F.round(c, 6) for c in ("median", "most")})


@query(f"""WITH RECURSIVE {NORMED}, l AS (SELECT a.vec_id AS u, b.vec_id AS v, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.3),
t AS (SELECT x.t AS i, 0.3 + 0.04 * x.t AS tau FROM range(5) x(t)), e AS (SELECT i, u, v FROM l, t WHERE round(s, 9) >= tau),
r AS (SELECT i, u, v FROM e UNION SELECT r.i, r.u, e.v FROM r JOIN e ON r.v = e.u AND r.i = e.i),
z AS (SELECT i, u, count(DISTINCT v) AS n FROM r GROUP BY 1, 2), w AS (SELECT t.i, tau, coalesce(max(n), 1) AS largest, coalesce(max(n), 1) / (SELECT count(*) FROM embeddings) AS share FROM t LEFT JOIN z USING (i) GROUP BY 1, 2),
f AS (SELECT coalesce(min(i) FILTER (share <= 0.02), 4) AS i FROM w)
SELECT round(tau, 2)::DOUBLE AS tau, largest, round(share, 6) AS share, w.i = f.i AS chosen FROM w, f WHERE w.i <= f.i""")
def tau_escalation(spark, sf):
    e = table(spark, sf, "embeddings")
    links = L.cosine_links(e, "vec_id", "embedding", 0.3, forest=True)
    return A.escalate(links, e.count(), [round(0.3 + 0.04 * i, 2) for i in range(5)]).withColumn("share", F.round("share", 6))


@query("""WITH g AS (SELECT conv_id, count(*) = 5 AND count(DISTINCT turn) = 5 AS complete FROM conversations GROUP BY 1),
h AS (SELECT conv_id, row_number() OVER (ORDER BY md5('r4:' || conv_id), conv_id) AS pos, count(*) OVER () AS n FROM g WHERE complete)
SELECT g.conv_id, complete, CASE WHEN pos <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN pos <= round_even(n * 0.85::DOUBLE, 0) THEN 'val' WHEN pos IS NOT NULL THEN 'test' ELSE 'excluded' END AS split FROM g LEFT JOIN h USING (conv_id)""")
def complete_group_split(spark, sf):
    groups = C.complete_groups(table(spark, sf, "conversations"), ["conv_id"], "turn", 5).select("conv_id", "complete")
    return A.complete_group_split(groups, "conv_id", "r4")


S = f"""{M}, a AS (SELECT doc_id, md5, class, source, split FROM m WHERE doc_id % 53 <> 5),
s AS (SELECT doc_id, CASE WHEN doc_id % 41 = 3 THEN upper(md5) ELSE md5 END AS md5, CASE WHEN doc_id % 37 = 2 THEN 'other' ELSE class END AS class, md5 AS g, CASE WHEN doc_id % 67 = 1 THEN 'x' ELSE split END AS split FROM m WHERE doc_id % 50 <> 7)"""


@query(f"""WITH {S} SELECT 'missing' AS name, count(*) AS violations FROM a WHERE doc_id NOT IN (SELECT doc_id FROM s)
UNION ALL SELECT 'unknown', count(*) FROM s WHERE doc_id NOT IN (SELECT doc_id FROM a)
UNION ALL SELECT 'repeated', count(*) FROM (SELECT doc_id FROM s GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'changed', count(*) FROM a JOIN s USING (doc_id) WHERE a.md5 IS DISTINCT FROM s.md5
UNION ALL SELECT 'relabelled', count(*) FROM a JOIN s USING (doc_id) WHERE a.class IS DISTINCT FROM s.class
UNION ALL SELECT 'bad_split', count(*) FROM s WHERE split NOT IN ('train','val','test')
UNION ALL SELECT 'no_group', count(*) FROM s WHERE g IS NULL
UNION ALL SELECT 'crossing', count(*) FROM (SELECT g FROM s GROUP BY 1 HAVING min(split) <> max(split))""")
def frozen_split_checks(spark, sf):
    m = manifest(spark, sf)
    saved = m.where("doc_id % 50 <> 7").select("doc_id", F.when(F.col("doc_id") % 41 == 3, F.upper("md5")).otherwise(F.col("md5")).alias("md5"), F.when(F.col("doc_id") % 37 == 2, "other").otherwise(F.col("class")).alias("class"), F.col("md5").alias("g"), F.when(F.col("doc_id") % 67 == 1, "x").otherwise(F.col("split")).alias("split"))
    return C.constraints(A.frozen_checks(m.where("doc_id % 53 <> 5"), saved, "doc_id", "class", "md5", "g"))


@query(f"""WITH {M}, d AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY doc_id) > 1 AS dup FROM m)
SELECT source, CASE WHEN dup THEN 'exact_duplicate' WHEN lower(source) LIKE '%7%' THEN 'provenance' WHEN size < 32 THEN 'too_small' ELSE 'retained' END AS status, count(*) AS n FROM d GROUP BY 1, 2""")
def disposition_accounting(spark, sf):
    d = C.keep_first(manifest(spark, sf), "md5", "doc_id")
    status = A.disposition([("too_small", F.col("size") < 32), ("provenance", F.lower("source").contains("7")), ("exact_duplicate", F.col("duplicate"))])
    return d.withColumn("status", status).groupBy("source", "status").agg(F.count("*").alias("n"))


@query(None)
def frechet_distance(spark, sf):
    e = table(spark, sf, "embeddings")
    return A.frechet(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "label", "embedding")


@query(None)
def shortcut_control(spark, sf):
    """How well class and source can be told from features that should not tell them."""
    li = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_linenumber") % 3).cast("int").alias("source"), *[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")], "l_orderkey")
    return A.shortcut_controls(li, {"size": ["l_quantity"], "size and border": ["l_quantity", "l_discount", "l_tax"]}, {"class": "y", "source": "source"}, F.col("l_orderkey") % 5 == 0)


PARTS = """e AS (SELECT label, (vec_id % 2)::INT AS side, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, side, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
m AS (SELECT label, side, i, avg(x) AS m, var_samp(x) AS s, count(*) AS n FROM x GROUP BY ALL)"""


@query(f"WITH {PARTS} SELECT a.label::VARCHAR AS class, any_value(a.n) AS n_a, any_value(b.n) AS n_b, round(sum((a.m - b.m) ** 2), 6) AS mean_part, round(sum(a.s), 6) AS trace_a, round(sum(b.s), 6) AS trace_b FROM m a JOIN m b ON a.label = b.label AND a.i = b.i AND a.side = 0 AND b.side = 1 GROUP BY 1")
def frechet_parts(spark, sf):
    """What a Frechet distance is made of, but for its matrix root: counts, distance of means, traces of covariances."""
    e = table(spark, sf, "embeddings")
    return A.frechet_terms(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "label", "embedding").drop("cross").withColumns({c: F.round(c, 6) for c in ("mean_part", "trace_a", "trace_b")})


@query("""WITH l AS (SELECT l_orderkey % 5 = 0 AS held, (l_returnflag = 'R')::INT AS y FROM lineitem) SELECT count(*) FILTER (held) AS n, round(1 / count(DISTINCT y) FILTER (NOT held), 6) AS chance FROM l""")
def shortcut_counts(spark, sf):
    """Held-out rows and the chance level of a shortcut control."""
    li = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").cast("double").alias("q"), "l_orderkey")
    return A.shortcut_control(li, ["q"], "y", F.col("l_orderkey") % 5 == 0).select("n", F.round("chance", 6).alias("chance"))
