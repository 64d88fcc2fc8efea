"""Queries that do the whole job on planted rows, against brute force and their SQL."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from curalith.operators import links, order
from curalith.plans import curation, registry


def test_balance_grows_with_the_input(spark, tmp_path):
    kept = []
    for times in (1, 3):
        langs = ["en"] * 900 * times + ["de"] * 300 * times + ["fr"] * 60 * times + [None] * 5
        (tmp_path / str(times)).mkdir()
        pd.DataFrame({"doc_id": range(len(langs)), "lang": langs}).to_parquet(tmp_path / str(times) / "documents.parquet")
        rows = curation.balance(spark, str(tmp_path / str(times))).collect()
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{times}/documents.parquet')")
        assert sorted(map(tuple, rows)) == sorted(con.sql(registry.oracle_sql()["balance"]).fetchall())
        sizes = pd.DataFrame([r.asDict() for r in rows]).groupby("lang")["copies"].sum()
        assert sizes.to_dict() == dict.fromkeys(("en", "de", "fr"), 420 * times)
        kept.append(len(rows))
    assert kept[1] == 3 * kept[0]


def coded(rng, n, most):
    base = [rng.getrandbits(64) for _ in range(n)]
    return [b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 0, 1, 3, most, most + 1, 9)] + [base[0] ^ 1 << 63]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_of_codes(spark):
    rng = random.Random(9)
    codes = coded(rng, 12, 5)
    rows = [(i, signed(c)) for i, c in enumerate(codes)] + [(500, None)]
    got = links.hamming_links(spark.createDataFrame(rows, "id long, c long"), "id", ["c"], 64, 5).collect()
    least = {c: min(i for i, x in enumerate(codes) if x == c) for c in codes}
    want = {(i, j, (a ^ b).bit_count()) for a, i in least.items() for b, j in least.items() if i < j and (a ^ b).bit_count() <= 5}
    want |= {(least[c], i, 0) for i, c in enumerate(codes) if least[c] != i}
    assert sorted((r.src, r.dst, r.distance) for r in got) == sorted(want) and all(r.plain == r.distance for r in got)
    # copies cost a row each
    many = spark.range(3000).select("id", F.lit(7).cast("long").alias("c"))
    assert links.hamming_links(many, "id", ["c"], 64, 5).count() == 2999


def test_acceptance_in_order(spark):
    rng = random.Random(2)
    rows = [(k, i, signed(c)) for k in ("a", "b", None) for i, c in enumerate(rng.sample(coded(rng, 8, 4) * 2, 100))] + [("a", 900, None)]
    got = {(r.k, r.o): r.accepted for r in links.accept_in_order(spark.createDataFrame(rows, "k string, o long, c long"), "k", "o", "c", 64, 4).collect()}
    want, held = {}, {}
    for k, o, c in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        seen = held.setdefault(k, [])
        want[k, o] = c is not None and all(((c ^ x) & (1 << 64) - 1).bit_count() > 4 for x in seen)
        if want[k, o]:
            seen.append(c)
    assert got == want


def test_positions_of_a_hot_group(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 50 < 40, "hot").alias("k"))
    got = order.shuffled_positions(rows, ["k"], "id", "s").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(r)
    assert {k: sorted(r._pos for r in v) == list(range(1, len(v) + 1)) and {r._n for r in v} == {len(v)} for k, v in by.items()} == {"hot": True, "rare": True, None: True}
