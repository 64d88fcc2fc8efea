"""Saved splits, resolution, pools and acceptance: what is taken over, and what is refused."""

import hashlib

import pytest
from pyspark.sql import functions as F

from curalith.functions import prompts, scalar
from curalith.operators import curation, manifest, metrics, splits
from curalith.streaming import attempts

ALIASES = {"clear_skin": "Clear_Skin", "red_spot": "Red_Spot"}
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def actual(spark):
    return spark.createDataFrame([("/now/clear skin/one.jpg", "Clear_Skin", sha("1")), ("/now/Red_spot/two.jpg", "Red_Spot", sha("2"))], "path string, class string, sha256 string")


def saved(spark, **changes):
    rows = [{"relative_path": "Clear-skin/one.jpg", "sha256": sha("1"), "split": "test", "group": "g0", "class": "Clear_Skin"}, {"relative_path": "red_spot/two.jpg", "sha256": sha("2"), "split": "train", "group": "g1", "class": "Red_Spot"}]
    rows[0] |= changes
    return spark.createDataFrame([tuple(r.values()) for r in rows], "relative_path string, sha256 string, split string, group string, class string")


def test_portable_split_is_taken_over(spark):
    got = manifest.reuse_frozen(actual(spark), saved(spark), ALIASES, same_count=True)
    assert sorted((r.path, r.split, r.group) for r in got.collect()) == [("/now/Red_spot/two.jpg", "train", "g1"), ("/now/clear skin/one.jpg", "test", "g0")]
    assert [scalar.canonical_class(F.lit(x), ALIASES) is not None for x in ("a",)] == [True]
    names = spark.createDataFrame([("\t Clear -skin\n",), ("Unknown thing",)], "n string").select(scalar.canonical_class(F.col("n"), ALIASES)).collect()
    assert [r[0] for r in names] == ["Clear_Skin", "Unknown thing"]


@pytest.mark.parametrize("change,why", [({"sha256": sha("x")}, "changed"), ({"split": "holdout"}, "invalid split"), ({"group": None}, "no group"), ({"group": "g1"}, "crosses"), ({"class": "Red_Spot"}, "other class"), ({"relative_path": "Clear-skin/gone.jpg"}, "missing"), ({"relative_path": "red spot/two.jpg"}, "not unique")])
def test_tampering_is_refused(spark, change, why):
    with pytest.raises(ValueError, match=why):
        manifest.reuse_frozen(actual(spark), saved(spark, **change), ALIASES)


def test_other_refusals(spark):
    with pytest.raises(ValueError, match="sha256"):
        manifest.reuse_frozen(actual(spark), saved(spark).drop("sha256"), ALIASES)
    with pytest.raises(ValueError, match="number of files"):
        manifest.reuse_frozen(actual(spark).limit(1), saved(spark), ALIASES, same_count=True)
    with pytest.raises(ValueError, match="fingerprint"):
        manifest.reuse_frozen(actual(spark), saved(spark).withColumn("dataset_fingerprint", F.lit("a")), ALIASES, fingerprint="b")
    with pytest.raises(ValueError, match="one to one"):
        manifest.one_to_one(actual(spark).union(actual(spark)), actual(spark), "path")


def pool(spark):
    rows = [("real/a", "real", "x", "train", "d1"), ("real/b", "real", "x", "val", "d2"), ("syn/c", "synthetic", "x", "test", "d1"), ("real/e", "real", "x", "train", "d3"), ("real/f", "real", "y", "train", "d3")]
    return spark.createDataFrame(rows, "path string, source string, class string, split string, md5 string")


def test_full_pool_resolution(spark):
    done = manifest.resolve_pools(pool(spark))
    assert {r.path for r in done.kept.collect()} == {"real/b", "syn/c"}
    assert {r.path: r.reason for r in done.removed.collect()} == {"real/a": "exact_duplicate", "real/e": "conflicting_label", "real/f": "conflicting_label"}
    assert {r.source: (r.original, r.retained, r.removed) for r in done.totals.collect()} == {"real": (4, 1, 3), "synthetic": (1, 1, 0)}
    assert {(r.source, r.reason): r.removed for r in done.by_source.collect()} == {("real", "exact_duplicate"): 1, ("real", "conflicting_label"): 2}
    with pytest.raises(ValueError, match="copies"):
        manifest.resolve_pools(pool(spark), auto_resolve=False)
    assert manifest.resolve_pools(pool(spark), strict=False, auto_resolve=False).kept.count() == 5
    with pytest.raises(ValueError, match="more than once"):
        manifest.resolve_pools(pool(spark).union(pool(spark).limit(1)))


def test_pools_need_the_same_classes(spark):
    p = pool(spark).drop("source")
    with pytest.raises(ValueError, match="classes differ"):
        splits.build_pools({"real": p, "synthetic": p.where("class = 'x'")}, "class", "path", "md5", {}, "s")
    with pytest.raises(ValueError, match="subset"):
        splits.check_subset(p, p.limit(2), "path")
    with pytest.raises(ValueError, match="fraction"):
        splits.mix_pools({"real": p}, {"real": 0.0}, "class", "path", "s")


def test_prompt_groups_stay_whole(spark):
    rows = [("Spot", f"{p:03d}", v, None, f"p{p}v{v}") for p in range(20) for v in range(1, 6)] + [("Spot", "900", v, None, f"x{v}") for v in (1, 2, 3, 4, 4)] + [("C", None, None, s, f"{s}{i}") for s, n in (("BCC", 2), ("MEL", 11)) for i in range(n)] + [("C", None, None, None, "odd")]
    got = splits.synthetic_split(spark.createDataFrame(rows, "class string, prompt string, variant int, subtype string, path string"), "class", "prompt", "variant", "subtype", "path", seed="a").collect()
    by = {}
    for r in got:
        by.setdefault(r.prompt or r.subtype, []).append(r.split)
    whole = [v for k, v in by.items() if k not in (None, "BCC", "MEL", "900")]
    assert all(len(set(v)) == 1 and len(v) == 5 for v in whole) and sorted(v[0] for v in whole) == ["test"] * 3 + ["train"] * 14 + ["val"] * 3
    assert set(by["900"]) == {"excluded"} == set(by[None]) and by["BCC"] == ["train"] * 2
    assert sorted(by["MEL"]) == ["test"] * 2 + ["train"] * 7 + ["val"] * 2


def test_weights_and_phases(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)], "c string")
    assert {r.c: r.weight for r in curation.class_weights(rows, "c", ["a", "b", "z"]).collect()} == {"a": 4 / 9, "b": 4 / 3, "z": 1.0}
    log = spark.createDataFrame([("m", 1, 1, 0.5), ("m", 1, 2, 0.7), ("m", 2, 1, 0.7), ("m", 3, 1, None)], "m string, p int, e int, v double")
    assert metrics.chosen_phase(log.where("p < 3"), "m", "p", "e", "v").collect() == [("m", 1, 2, 0.7)]
    with pytest.raises(ValueError, match="no v"):
        metrics.chosen_phase(log, "m", "p", "e", "v")
    with pytest.raises(ValueError):
        metrics.same_holdout({"a": (log, "x")}, "y")


def test_stream_goes_on(spark, tmp_path):
    schema, path, state = "k long, a int, ok boolean", str(tmp_path / "in"), str(tmp_path / "state")
    add = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    read = lambda: sorted(map(tuple, attempts.follow(spark, path, schema, ["k"], "a", "ok", state).collect()))
    add([(1, 0, False), (2, 0, True)])
    assert read() == [(1, 1, None), (2, 1, 0)]
    add([(1, 1, True), (1, 2, True), (3, 3, True), (3, 2, False)])
    assert read() == [(1, 3, 1), (2, 1, 0), (3, 1, None)] == read()


def test_final_prompts(spark):
    texts = ["Red spot. Natural look, soft.  ", "Red spot. Natural look, soft", "Red spot", "Natural look."]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(prompts.final_prompt(F.col("t"), "P. ", "Natural"), prompts.article(F.col("t"))).collect()
    assert [r[0] for r in got] == ["P. Red spot.", "P. Red spot. Natural look, soft", "P. Red spot", "P. "] and {r[1] for r in got} == {"a"}
