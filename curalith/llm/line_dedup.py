"""Line deduplication: lines within a bound of edits of an earlier line are dropped.

A deletion-neighbourhood join. Two lines lie within ``edits`` edits of each other exactly if there are that many
spots at which each of them may lose a character or not, so that the rest is equal. Every variant, keyed by the
rest and the spots, therefore is a set of lines that lie within the bound of each other pairwise, and any two such
lines share a variant: the least place of a variant's lines stands for all its pairs. A variant holds at most as
many lines as there are characters for its spots, however large the table.

Emitting every variant of every line would cost a line its length squared, so spots are first narrowed down, losing
no pair: the rest is cut into blocks, each spot lies in one of them, and the line without these blocks is a coarser
variant of its own. Only blocks whose coarse variant another line shares are cut again, until they are so short
(``WINDOW``) that all variants inside them are emitted, by the hash of what surrounds them and of what is left in
them. Only DataFrame operations run.

Earlier means a smaller doc_id (null last), then a smaller hash of the text, then the earlier line; rows that are
equal in id and text share one place and one fate. Empty lines always stay; all others take part whatever their
length, so that a line of one character is within one edit of every other such line. ``keep earliest`` is direct: a
line goes if any earlier line is near, whether or not that one stays.
"""

from __future__ import annotations

from itertools import combinations_with_replacement, product

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from curalith.storage import materialise

from ._names import unused
from .exact_dedup import by_group

EDITS = 1
#: Blocks of the first cut, which every line undergoes, and of the later ones.
FIRST, LATER = 2, 8
#: Variants are emitted for every spot of blocks of this many characters.
WINDOW = 32


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64(t).alias("t"), F.posexplode(F.split(t, "\n", -1)).alias("n", "line"))
    return rows.where("line <> ''").select("d", "t", "n", "line", _id(F.col("line")).alias("id"))


def _id(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _outside(line: Column, base: Column, lo: list[Column], hi: list[Column], gone: list[Column], seed: int = 0) -> Column:
    """Hash of what lies outside the blocks: characters ``lo`` to ``hi`` of the rest, whose length is ``base``, when
    the line has lost ``gone`` (0 or 1) characters in each block. Blocks are in order and may be the same."""
    pieces, shift = [F.substring(line, F.lit(1), lo[0])], F.lit(0)
    for j in range(len(lo)):
        shift = shift + gone[j]
        end = lo[j + 1] if j + 1 < len(lo) else base
        pieces.append(F.substring(line, hi[j] + shift + 1, F.greatest(end - hi[j], F.lit(0))))
    return F.xxhash64(F.lit(seed), base, *lo, *hi, *pieces)


def _cut(lo: Column, hi: Column, n: int, i: int) -> tuple[Column, Column, Column]:
    """The i-th of n blocks of a block, and whether there is one: no more than there are characters, one at least."""
    size = hi - lo
    m = F.greatest(F.least(F.lit(n), size), F.lit(1))
    return (lo + F.floor(size * i / m)).cast("int"), (lo + F.floor(size * (i + 1) / m)).cast("int"), F.lit(i) < m


def _finer(line: Column, length: Column, lo: list[Column], hi: list[Column], gone: list[Column], n: int) -> list[Column]:
    """Every choice of one of n blocks for each spot: structs of the blocks and their key, null where there is none."""
    base = length - sum(gone[1:], gone[0])
    out = []
    for choice in product(range(n), repeat=len(lo)):
        cuts = [_cut(lo[j], hi[j], n, i) for j, i in enumerate(choice)]
        there = cuts[0][2]
        for j, c in enumerate(cuts):
            # spots are in order; later ones lie in the same block or a later one
            there = there & c[2] & (F.lit(True) if j == 0 else cuts[j - 1][0] <= c[0])
        starts, ends = [c[0] for c in cuts], [c[1] for c in cuts]
        key = _outside(line, base, starts, ends, gone)
        out.append(F.when(there, F.struct(F.array(*starts).alias("lo"), F.array(*ends).alias("hi"), F.array(*gone).alias("gone"), key.alias("key"))))
    return out


def _spots(name: str, edits: int) -> list[Column]:
    return [F.element_at(name, j + 1) for j in range(edits)]


def first_keys(line: Column, edits: int) -> Column:
    """Keys of the first cut; their order tells the choice that each stands for."""
    length, keys = F.length(line), []
    for gone in product((0, 1), repeat=edits):
        lost = [F.lit(g) for g in gone]
        whole = F.greatest(length - sum(gone), F.lit(0))
        for choice in combinations_with_replacement(range(FIRST), edits):
            cuts = [_cut(F.lit(0), whole, FIRST, i) for i in choice]
            key = _outside(line, whole, [c[0] for c in cuts], [c[1] for c in cuts], lost)
            there = length >= sum(gone)
            for c in cuts:
                there = there & c[2]
            keys.append(F.when(there, key))
    return F.array(*keys)


def _first_blocks(length: Column, edits: int) -> Column:
    """The blocks of ``first_keys``, in its order."""
    out = []
    for gone in product((0, 1), repeat=edits):
        whole = F.greatest(length - sum(gone), F.lit(0))
        for choice in combinations_with_replacement(range(FIRST), edits):
            cuts = [_cut(F.lit(0), whole, FIRST, i) for i in choice]
            out.append(F.struct(F.array(*[c[0] for c in cuts]).alias("lo"), F.array(*[c[1] for c in cuts]).alias("hi"), F.array(*[F.lit(g) for g in gone]).alias("gone")))
    return F.array(*out)


def _shared(rows: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key others have too."""
    twice = rows.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").select(key)
    return rows.join(twice.hint("merge"), key, "left_semi")


def earliest_near(rows: DataFrame, edits: int = EDITS) -> DataFrame:
    """``(id, near)`` from ``(id, line, pos, lo, hi, gone)``, distinct lines with blocks that hold the spots: the place
    of the earliest line within the bound, for each line that has an earlier one."""
    line, length = F.col("line"), F.length("line")
    lo, hi, gone = (_spots(c, edits) for c in ("lo", "hi", "gone"))
    base = length - sum(gone[1:], gone[0])
    # all but the blocks goes in as two hashes, so that the number of variants, not their length, counts
    rows = rows.select("id", "line", "pos", "lo", "hi", "gone", base.alias("base"), _outside(line, base, lo, hi, gone, 1).alias("a"), _outside(line, base, lo, hi, gone, 2).alias("b"))
    at = [f"q{j}" for j in range(edits)]
    for j in range(edits):
        rows = rows.withColumn(at[j], F.explode(F.sequence(lo[j], hi[j])))
        if j:
            rows = rows.where(F.col(at[j - 1]) <= F.col(at[j]))
    q = [F.col(c) for c in at]
    pieces, shift = [], F.lit(0)
    for j in range(edits):
        begin = F.greatest(lo[j], q[j - 1]) if j else lo[j]
        pieces.append(F.substring("line", begin + shift + 1, q[j] - begin))
        shift = shift + gone[j]
        end = F.least(hi[j], q[j + 1]) if j + 1 < edits else hi[j]
        pieces.append(F.substring("line", q[j] + shift + 1, end - q[j]))
    variant = F.struct(F.xxhash64("a", *q, *pieces).alias("a"), F.xxhash64("b", *q, *pieces).alias("b"))
    rows = rows.select(F.struct("pos", "id").alias("me"), variant.alias("v"))
    rows = rows.select("me", F.min("me").over(Window.partitionBy("v")).alias("near")).where("near < me")
    best = rows.groupBy("me").agg(F.min("near").alias("near"))
    return best.select(F.col("me.id").alias("id"), F.col("near.pos").alias("near"), F.col("near.id").alias("to"))


def near_lines(distinct: DataFrame, fetch, edits: int = EDITS) -> DataFrame:
    """``(id, near)`` of distinct lines ``(id, pos, keys)``; ``fetch`` brings the texts ``(id, pos, line, which)`` of
    those lines that share keys, ``which`` being the numbers of these keys."""
    rows = distinct.select("id", F.posexplode("keys").alias("i", "key")).where("key is not null")
    ids = materialise(_shared(rows).groupBy("id").agg(F.collect_set("i").alias("which")), "near-lines")
    text = materialise(fetch(distinct.select("id", "pos").join(ids, "id")), "sieved")
    blocks = _first_blocks(F.length("line"), edits)
    todo = text.select("id", "pos", "line", F.explode(F.transform("which", lambda i: F.get(blocks, i))).alias("x")).select("id", "pos", "line", "x.*")
    wide = F.exists(F.arrays_zip("lo", "hi"), lambda x: x["hi"] - x["lo"] > WINDOW)
    ready = None
    while True:
        todo = materialise(todo, "blocks")
        part = todo.where(~wide)
        ready = part if ready is None else ready.unionByName(part)
        todo = todo.where(wide)
        if todo.isEmpty():
            break
        lo, hi, gone = (_spots(c, edits) for c in ("lo", "hi", "gone"))
        cuts = F.array_compact(F.array(*_finer(F.col("line"), F.length("line"), lo, hi, gone, LATER)))
        finer = materialise(todo.select("id", F.explode(cuts).alias("x")).select("id", "x.*"), "finer")
        kept = _shared(finer).drop("key").distinct()
        todo = kept.join(text.select("id", "pos", "line"), "id")
    found = earliest_near(ready, edits)
    lines = text.select("id", "line")
    pairs = found.join(lines, "id").join(lines.select(F.col("id").alias("to"), F.col("line").alias("other")), "to")
    return pairs.where(F.levenshtein("line", "other", edits) >= 0).select("id", "near")


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """``(d, t, dropped)``: numbers (from 0) of the lines to drop, for documents that have any; ``d`` is the id
    (the largest long for null) and ``t`` the xxhash64 of the text. With ``edits`` 0 lines match exactly.
    A null text is one empty line; of rows that repeat the first place in the order of (d, t, n) is the one that stays; other
    columns are not read; an empty table gives an empty one."""
    occ = _lines(docs, doc_id, text)
    pos = F.struct("d", "t", "n")
    keys = [first_keys(F.col("line"), edits).alias("keys")] if edits else []
    distinct = materialise(
        occ.select("id", "d", "t", "n", *keys).groupBy("id").agg(F.min(pos).alias("pos"), F.count("*").alias("group_size"), *([F.first("keys").alias("keys")] if edits else [])),
        "lines",
    )

    def fetch(wanted: DataFrame) -> DataFrame:
        # texts of lines, from the places where they stand first
        first = wanted.select("pos.d", "pos.t", F.struct("pos.n", "id", "pos", "which").alias("x")).groupBy("d", "t").agg(F.collect_list("x").alias("xs"))
        t = F.coalesce(F.col(text), F.lit(""))
        rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64(t).alias("t"), t.alias("text")).join(first.hint("shuffle_hash"), ["d", "t"])
        # texts are split once, below the explosion
        rows = rows.select(F.split("text", "\n", -1).alias("all"), "xs").select("all", F.explode("xs").alias("x"))
        return rows.select("x.id", "x.pos", "x.which", F.get("all", F.col("x.n")).alias("line")).dropDuplicates(["id"])

    if edits:
        near = near_lines(distinct.select("id", "pos", "keys"), fetch, edits)
        groups = distinct.drop("keys").join(near, "id", "left").where("group_size > 1 or near is not null")
        groups = groups.select("id", "group_size", F.least("pos", "near").alias("until"))
    else:
        groups = distinct.where("group_size > 1").select("id", "group_size", F.col("pos").alias("until"))
    groups = materialise(groups, "line-groups")
    total = distinct.agg(F.sum("group_size")).first()[0] or 0
    gone = by_group(occ.select("d", "t", "n", "id"), groups, total, "id").where(F.struct("d", "t", "n") > F.col("until"))
    return gone.groupBy("d", "t").agg(F.array_sort(F.collect_set("n")).alias("dropped"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """``docs`` with the lines dropped from the text; other columns stay, whatever their names. A null text stays
    null and has no lines; repeated rows lose the same lines; an empty table gives an empty one."""
    gone = dropped_lines(docs, doc_id, text, edits)
    names = docs.columns
    d, t, cut = unused(names, "_d", "_t", "_gone")
    rows = docs.withColumns({d: F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)), t: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    rows = rows.join(gone.select(F.col("d").alias(d), F.col("t").alias(t), F.col("dropped").alias(cut)), [d, t], "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains(cut, i)), "\n")
    return rows.withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(kept)).select(*names)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` that near-equal earlier ones make needless; odd inputs as stated in :func:`dropped_lines`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.xxhash64(t).alias("t"), F.size(F.split(t, "\n", -1)).cast("long").alias("n_lines"))
    out = rows.join(dropped_lines(docs), ["d", "t"], "left")
    n = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_lines", F.when(F.col("dropped").isNull(), 0).otherwise(n).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLE: dict[str, str] = {}
