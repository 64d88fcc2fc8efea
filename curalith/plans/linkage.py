"""Queries on codes and vectors: links in four orientations, nearest of another source, acceptance, quarantine, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curalith.functions import prompts as P
from curalith.operators import audit as A, links as L
from curalith.operators.graph import connected_components
from curalith.storage import materialise
from curalith.streaming import acceptance as ACC

from .curation import NORMED, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: What turns a code into that of the mirrored, the upside-down and the turned picture, and the radius of near codes.
TURNS = (0, 0x00FF00FF00FF00FF, 0x0F0F0F0F0F0F0F0F, 0x0FF00FF00FF00FF0)
RADIUS = 5
#: Within which an attempt is too near to one that was accepted.
ACCEPT = 4


def codes(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, label, real, c0..c3)``: the signs of 64 coordinates of each vector, and beside each two synthetic codes: one
    of its turns with up to eight bits changed, and that with up to six others changed, at times of another class."""
    bits = [F.when(F.element_at("embedding", i + 1) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    e = table(spark, sf, "embeddings").select("vec_id", "label", code.alias("c"))
    turn = F.element_at(F.array(*[F.lit(t).cast("long") for t in TURNS]), (F.col("vec_id") % 4 + 1).cast("int"))
    changed = e.select((F.col("vec_id") + 1_000_000).alias("id"), "label", F.lit(False).alias("real"), F.col("c").bitwiseXOR(turn).bitwiseXOR(F.expr("shiftleft(1L, cast(vec_id % 9 as int)) - 1")).alias("c"))
    vec = F.col("id") - 1_000_000
    again = changed.select((vec + 2_000_000).alias("id"), (F.col("label") + F.when(vec % 5 == 0, 1).otherwise(0)).alias("label"), "real", F.col("c").bitwiseXOR(F.expr("shiftleft(shiftleft(1L, cast((id - 1000000) % 7 as int)) - 1, 40)")).alias("c"))
    every = e.select(F.col("vec_id").alias("id"), "label", F.lit(True).alias("real"), "c").unionByName(changed).unionByName(again)
    return every.select("id", "label", "real", *[F.col("c").bitwiseXOR(F.lit(t).cast("long")).alias(f"c{i}") for i, t in enumerate(TURNS)])


SIGNS = " + ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i if i < 63 else '(-9223372036854775807 - 1)'} ELSE 0 END" for i in range(64))
H = f"""e AS (SELECT vec_id, label, ({SIGNS})::BIGINT AS c FROM embeddings),
h1 AS (SELECT vec_id, label, xor(xor(c, [{', '.join(map(str, TURNS))}][vec_id % 4 + 1]::BIGINT), (1 << (vec_id % 9)::INT) - 1) AS c FROM e),
h AS (SELECT vec_id AS id, label, true AS real, c FROM e UNION ALL SELECT vec_id + 1000000, label, false, c FROM h1
 UNION ALL SELECT vec_id + 2000000, label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END, false, xor(c, ((1::BIGINT << (vec_id % 7)::INT) - 1) << 40) FROM h1)"""
DISTANCE = "least(" + ", ".join(f"bit_count(xor(xor(a.c, b.c), {t}::BIGINT))" for t in TURNS) + ")::INT"
LINKS = f"""r AS (SELECT min(id) AS id, c FROM h GROUP BY c), l AS (SELECT a.id AS src, b.id AS dst, {DISTANCE} AS distance, bit_count(xor(a.c, b.c))::INT AS plain FROM r a JOIN r b ON a.id < b.id WHERE {DISTANCE} <= {RADIUS}
UNION ALL SELECT r.id, h.id, 0, 0 FROM h JOIN r USING (c) WHERE h.id <> r.id)"""
TURNED = ["c0", "c1", "c2", "c3"]


@query(f"WITH {H}, {LINKS} SELECT src, dst, distance, plain FROM l")
def hamming_links(spark, sf):
    return L.hamming_links(codes(spark, sf), "id", TURNED, 64, RADIUS)


@query(f"WITH {H}, {LINKS} SELECT count(*) FILTER (plain <= {RADIUS}) AS plain_pairs, count(*) AS pairs FROM l")
def hamming_pair_counts(spark, sf):
    return L.hamming_links(codes(spark, sf), "id", TURNED, 64, RADIUS).agg(F.count_if(F.col("plain") <= RADIUS).alias("plain_pairs"), F.count("*").alias("pairs"))


NEAREST = f"n AS (SELECT a.id, min({DISTANCE}) AS d FROM h a JOIN h b ON NOT a.real AND b.real GROUP BY 1), near AS (SELECT id, d AS nearest FROM n)"


@query(f"WITH {H}, {NEAREST} SELECT id, nearest FROM near")
def cross_source_nearest(spark, sf):
    c = codes(spark, sf)
    return L.nearest_code(c.where(~F.col("real")), c.where("real"), "id", TURNED)


@query(f"""WITH RECURSIVE {H}, s AS (SELECT * FROM h WHERE NOT real), rr AS (SELECT min(id) AS id, c FROM s GROUP BY c),
l AS (SELECT a.id AS u, b.id AS v FROM s a JOIN s b ON a.c = b.c UNION ALL SELECT a.id, b.id FROM rr a JOIN rr b ON {DISTANCE} <= {RADIUS}),
w AS (SELECT u, v FROM l UNION SELECT w.u, l.v FROM w JOIN l ON w.v = l.u), g AS (SELECT u AS id, min(v) AS g FROM w GROUP BY 1), {NEAREST},
x AS (SELECT id, g, label, nearest FROM s JOIN g USING (id) JOIN near USING (id)), y AS (SELECT g, min(label) <> max(label) AS mixed, coalesce(bool_or(nearest <= {RADIUS}), false) AS close FROM x GROUP BY 1)
SELECT id, g AS "group", CASE WHEN mixed AND close THEN 'quarantined_cross_class_and_real_group' WHEN close THEN 'quarantined_near_real_group' WHEN mixed THEN 'quarantined_cross_class_group' ELSE 'eligible' END AS status FROM x JOIN y USING (g)""")
def near_real_quarantine(spark, sf):
    """Groups of synthetic codes, and which of them go: those near a real one, and those of several classes."""
    c = materialise(codes(spark, sf), "codes")
    own = c.where(~F.col("real"))
    comp = connected_components(L.hamming_links(own, "id", TURNED, 64, RADIUS).select("src", "dst"))
    near = L.nearest_code(own, c.where("real"), "id", TURNED)
    rows = own.select("id", "label").join(comp, F.col("id") == F.col("node"), "left").select("id", "label", F.coalesce("component", "id").alias("group")).join(near, "id")
    return L.quarantine(rows, "group", "label", F.col("nearest") <= RADIUS).select("id", "group", "status")


@query(f"""WITH RECURSIVE {H}, o AS (SELECT id, label, c, row_number() OVER (PARTITION BY label ORDER BY id) AS n FROM h),
w AS (SELECT DISTINCT label, 0::BIGINT AS n, []::BIGINT[] AS held, NULL::BIGINT AS id, false AS accepted FROM o
UNION ALL SELECT o.label, o.n, CASE WHEN len(list_filter(held, lambda x: bit_count(xor(x, o.c)) <= 4)) = 0 THEN list_append(held, o.c) ELSE held END, o.id, len(list_filter(held, lambda x: bit_count(xor(x, o.c)) <= 4)) = 0
 FROM w JOIN o ON o.label = w.label AND o.n = w.n + 1)
SELECT id, accepted FROM w WHERE id IS NOT NULL""")
def accepted_codes(spark, sf):
    """Attempts in order: one is accepted if no accepted one before it in its class is near."""
    return L.accept_in_order(codes(spark, sf), "label", "id", "c0", 64, ACCEPT).select("id", "accepted")


#: Accepted codes wanted of a class, the most attempts for them, and attempts made at once.
TARGET, CAP, BATCH = 40, 240, 16


@query(f"""WITH RECURSIVE {H}, o AS (SELECT id, label, c, bit_count(c) < 28 AS bad, row_number() OVER (PARTITION BY label ORDER BY id) AS n FROM h),
w AS (SELECT DISTINCT label, 0::BIGINT AS n, []::BIGINT[] AS held, 0::BIGINT AS tried, 0::BIGINT AS remain, NULL::BIGINT AS id, '' AS status FROM o
UNION ALL SELECT label, n, CASE WHEN status = 'accepted' THEN list_append(held, c) ELSE held END, tried + (now > 0)::BIGINT, greatest(now - 1, 0), id, status FROM
 (SELECT *, CASE WHEN now = 0 THEN 'not_tried' WHEN bad THEN 'degenerate' WHEN len(list_filter(held, lambda x: bit_count(xor(x, c)) <= {ACCEPT})) > 0 THEN 'near' ELSE 'accepted' END AS status FROM
  (SELECT o.label, o.n, o.id, o.c, o.bad, held, tried, CASE WHEN remain > 0 THEN remain WHEN len(held) < {TARGET} AND tried < {CAP} THEN least({BATCH}, {TARGET} - len(held)) ELSE 0 END AS now FROM w JOIN o ON o.label = w.label AND o.n = w.n + 1)))
SELECT label::VARCHAR AS class, id AS attempt, status FROM w WHERE id IS NOT NULL""")
def acceptance_stream(spark, sf):
    """Attempts accepted or rejected over a stream, with a target and a cap for each class."""
    tries = codes(spark, sf).select(F.col("label").cast("string").alias("class"), F.col("id").alias("attempt"), F.col("c0").alias("code"), (F.bit_count("c0") < 28).alias("bad"))
    return ACC.accepted(tries, TARGET, CAP, BATCH, ACCEPT)


@query(f"""WITH {NORMED}, b AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: list_reverse(embedding)[i]::DOUBLE - m[i]) AS w FROM embeddings, mean),
z AS (SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS w FROM b), p AS (SELECT x.vec_id AS src, y.vec_id AS dst, greatest(list_dot_product(x.v, y.v), list_dot_product(x.v, z.w)) AS score FROM u x JOIN u y ON x.vec_id < y.vec_id JOIN z ON z.vec_id = y.vec_id)
SELECT src, dst, round(score, 6) AS score FROM p WHERE score >= 0.4""")
def mirrored_cosine_links(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("mirror", F.reverse("embedding"))
    return L.cosine_links(e, "vec_id", "embedding", 0.4, "mirror").select("src", "dst", F.round("score", 6).alias("score"))


LEAK = f"""{NORMED}, d AS (SELECT vec_id, v, CASE vec_id % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, CASE WHEN vec_id % 3 = 0 THEN 'synthetic' ELSE 'real' END AS source FROM u),
p AS (SELECT a.split AS evaluation_split, a.source AS query_source, b.source AS train_source, a.vec_id AS query, b.vec_id AS reference, list_dot_product(a.v, b.v) AS score,
 row_number() OVER (PARTITION BY a.vec_id, b.source ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS k FROM d a JOIN d b ON a.split <> 'train' AND b.split = 'train'), f AS (SELECT * FROM p WHERE k = 1)"""


def _leak(spark, sf):
    i = F.col("vec_id")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.when(i % 10 == 0, "val").when(i % 10 == 1, "test").otherwise("train").alias("split"), F.when(i % 3 == 0, "synthetic").otherwise("real").alias("source"))
    return A.leakage_report(e, "vec_id", "embedding", "split", "source", (0.25, 0.35), 0.1)


@query(f"WITH {LEAK} SELECT evaluation_split, query_source, train_source, count(*) AS n, round(median(score), 6) AS median, round(max(score), 6) AS most, avg((score >= 0.25)::INT) AS share_25, avg((score >= 0.35)::INT) AS share_35, count(*) FILTER (score >= 0.25) AS n_25, count(*) FILTER (score >= 0.35) AS n_35, avg((score >= 0.35)::INT) > 0.1 AS warning FROM f GROUP BY ALL")
def leakage_by_source(spark, sf):
    return _leak(spark, sf)[0].withColumns({c: F.round(c, 6) for c in ("median", "most")})


@query(f"WITH {LEAK} SELECT evaluation_split, query_source, train_source, query, reference, round(score, 6) AS score FROM f WHERE score >= 0.25")
def flagged_pairs(spark, sf):
    return _leak(spark, sf)[1].withColumn("score", F.round("score", 6))


@query(f"""WITH {NORMED}, o AS (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM u), n AS (SELECT count(*) AS n FROM u),
i AS (SELECT ('0x' || substr(md5('pairs:a:' || i), 1, 12))::BIGINT % n AS a, ('0x' || substr(md5('pairs:b:' || i), 1, 12))::BIGINT % n AS b FROM range(20000) x(i), n), s AS (SELECT list_dot_product(x.v, y.v) AS s FROM i JOIN o x ON x.at = a JOIN o y ON y.at = b)
SELECT count(*) AS n, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.95), 6) AS p95, round(quantile_cont(s, 0.99), 6) AS p99 FROM s""")
def random_pairs(spark, sf):
    out = A.random_pair_scores(table(spark, sf, "embeddings"), "vec_id", "embedding", "pairs")
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")})


@query(f"WITH {H} SELECT id, printf('%016x', c) AS code FROM h")
def code_names(spark, sf):
    return codes(spark, sf).select("id", P.hex64(F.col("c0")).alias("code"))
