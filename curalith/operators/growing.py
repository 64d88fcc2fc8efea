"""Groups of rows that share keys, kept up to date as rows arrive.

A saved state has three tables, each written in parts by batch: the first node of each key, each node's component as it was
named when the node came, and names that later became others. A batch links its rows to the saved first nodes of their
keys, contracts only the components that its links touch, and writes its own keys and nodes and the names that changed:
what it writes grows with the batch, however large the components are. Names stay the least node; they are looked up when
groups are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curalith.operators.graph import connected_components
from curalith.operators.skew import join_groups
from curalith.storage import materialise

TABLES = {"keys": "kind int, key string, node long", "nodes": "node long, component long", "names": "old long, new long"}


def _saved(spark: SparkSession, state: str, name: str, before: int) -> DataFrame:
    """A table of the state as it was before a batch."""
    out = None
    for i in range(before):
        part = spark.read.schema(TABLES[name]).parquet(f"{state}/{name}/batch={i}")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], TABLES[name]) if out is None else out


def _names(spark: SparkSession, state: str, before: int) -> DataFrame:
    """``(old, name)``: the name now of every name that became another."""
    changed = _saved(spark, state, "names", before)
    return connected_components(changed.select(F.col("old").alias("src"), F.col("new").alias("dst"))).select(F.col("node").alias("old"), F.col("component").alias("name"))


def add_batch(rows: DataFrame, node: str, keys: list[str], state: str, number: int) -> dict[str, int]:
    """Takes batch ``number`` (from 0, one after the other) into the state and returns the rows written to each table.

    Rows with an equal key, of the same column, are in one group; null keys link nothing, rows with a null node are left out. Run
    again with the same number a batch replaces what it wrote, so a batch that was lost half-way is simply repeated. Rows that repeat
    are harmless; an empty batch adds nothing. Keys may be shared by most rows: they are joined skew-safe.
    """
    spark = rows.sparkSession
    whole = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).cast("string").alias("key")) for i, k in enumerate(keys)])
    mine = rows.where(F.col(node).isNotNull()).select(F.col(node).cast("long").alias("node"), F.explode(whole).alias("x")).select("x.kind", "x.key", "node").where("key is not null")
    mine = materialise(mine, "batch-keys")
    groups = mine.groupBy("kind", "key").agg(F.min("node").alias("least"), F.count("*").alias("n"))
    first = _saved(spark, state, "keys", number).select("kind", "key", F.col("node").alias("known"))
    groups = materialise(groups.join(first, ["kind", "key"], "left"), "key-groups")
    total = mine.count()
    stars = join_groups(mine, groups.where("n > 1 or known is not null"), total, ["kind", "key"], "n")
    edges = materialise(stars.select(F.coalesce("known", "least").alias("src"), F.col("node").alias("dst")).where("src <> dst").distinct(), "links")

    # ends by the name of the component that they are in; an end that is in none is its own
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    names = materialise(_names(spark, state, number), "names")
    known = ends.join(_saved(spark, state, "nodes", number), "node").join(names, F.col("component") == F.col("old"), "left")
    known = known.select("node", F.coalesce("name", "component").alias("name"))
    ends = materialise(ends.join(known, "node", "left").select("node", F.coalesce("name", "node").alias("name"), F.col("name").isNull().alias("fresh")), "ends")
    degree = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).groupBy("node").agg(F.count("*").alias("n"))
    by = materialise(ends.join(degree, "node").select("node", "name", "n"), "end-names")
    links = edges
    for end in ("src", "dst"):
        links = join_groups(links, by.select(F.col("node").alias(end), F.col("name").alias(f"{end}_"), "n"), max(1, total), end, "n").drop("n")
    contracted = materialise(connected_components(links.select(F.col("src_").alias("src"), F.col("dst_").alias("dst"))), "contracted")
    at = ends.join(contracted.select(F.col("node").alias("was"), "component"), F.col("name") == F.col("was"), "left")
    at = materialise(at.select("node", "name", "fresh", F.coalesce("component", "name").alias("component")), "named")
    written = {
        "keys": groups.where("known is null").select("kind", "key", F.col("least").alias("node")),
        "nodes": at.where("fresh").select("node", "component"),
        "names": at.where("not fresh and name <> component").select(F.col("name").alias("old"), F.col("component").alias("new")).distinct(),
    }
    out = {}
    for name, part in written.items():
        path = f"{state}/{name}/batch={number}"
        part.write.mode("overwrite").parquet(path)
        out[name] = spark.read.schema(TABLES[name]).parquet(path).count()
    return out


def groups(spark: SparkSession, state: str, batches: int) -> DataFrame:
    """``(node, component)`` of every node with a link, after so many batches: the least node of its group."""
    names = materialise(_names(spark, state, batches), "names")
    nodes = _saved(spark, state, "nodes", batches)
    sized = nodes.groupBy("component").agg(F.count("*").alias("n")).join(names, F.col("component") == F.col("old"), "left").select("component", F.coalesce("name", "component").alias("name"), "n")
    sized = materialise(sized, "sized")
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_groups(nodes, sized, max(1, total), "component", "n").select("node", F.col("name").alias("component"))
