"""Joining documents whose sets of word n-grams have a Jaccard similarity at or above a threshold.

A size-aware heavy-light join over inverted lists. First the lists are built, dealt by n-gram: an n-gram that one
set alone has adds to no intersection, so a set keeps only its shared n-grams, and a set of which too few are
shared links with nothing. What is left is small and whole: intersections of shared n-grams are those of the sets.

Light sets are small enough to list fixed-size subsets: two sets link exactly when they share a subset of the size
that the threshold asks of their sizes. Heavy sets are blocked without losing a pair: sets that link differ in few
elements, so among more parts of the hash space than that (dealt anew for each size class), some are equal as
wholes, and the largest of these are keys. The boundary is the largest size whose subsets cost less than blocking
and scanning. Keys that meet form candidate clusters, apart for each size class; each set is sent once to each of
its clusters, at most three, and scanning the inverted lists there gives exact overlaps. Only links of a spanning
forest leave a scan, and members of a cluster's known group are not scanned, so neither copies nor near copies become
all their pairs; a cluster beyond ``BLOCK`` sets is scanned in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curalith.operators.graph import connected_components
from curalith.storage import materialise

from . import _bytes as B
from .exact_dedup import by_group

GRAM = 4
THRESHOLD = (85, 100)
BLOCK = 2048
#: What scanning one inverted list costs, in keys.
SCAN_COST = 8
U = np.uint64


class Plan:
    """Sizes, overlaps and keys that a threshold of ``num / den`` asks for."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds = [1]  # size classes, each up to den / num times its least size
        self.light = 1
        while self.subsets(self.light + 1) <= SCAN_COST * max(1, self.differ(self.light + 1) + 1):
            self.light += 1

    def overlap(self, a: int, b: int) -> int:
        """Least intersection of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.den + self.num))

    def partners(self, n: int) -> range:
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def subsets(self, n: int) -> int:
        return sum(comb(n, c) for b in self.partners(n) if (c := self.overlap(n, b)) <= n)

    def differ(self, n: int) -> int:
        """Most elements in which linked sets of size n at most differ."""
        return 2 * n - 2 * self.overlap(n, n) + 1

    def size_class(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(self.bounds[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.bounds, n, "right"))

    def class_end(self, c: int) -> int:
        """Largest size of class c."""
        while len(self.bounds) <= c:
            self.bounds.append(self.bounds[-1] * self.den // self.num + 1)
        return self.bounds[c] - 1

    def parts(self, c: int) -> tuple[int, int]:
        """For pairs of classes c - 1 and c: the number of parts, and how many of the smallest parts are no keys.

        Linked sets differ in ``most`` elements at most, so that ``spare + 1`` of ``most + spare + 1`` parts are
        equal. Each set leaves out its ``spare`` smallest parts (of equal sizes the first): at least ``spare`` parts
        of either set come before the last of the equal ones, so both keep it.
        """
        most = (self.den - self.num) * 2 * self.class_end(c) // (self.den + self.num)
        spare = 2 + (most + 1) // 2
        return most + 1 + spare, spare

    def classes(self, n: int) -> list[int]:
        """The size classes of a set's clusters; class 0 holds subsets of light sets."""
        c = self.size_class(n)
        return ([0] if n <= self.light else []) + ([c, c + 1] if self.den * n // self.num > self.light else [])

    def keys(self, s: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
        """For each class, keys of a set of n elements, of which ``s`` holds those that other sets have too: sets
        that link share a key of one class."""
        return [(j, np.unique(self._parts_of(s, j) if j else self._subsets_of(s, n))) for j in self.classes(n)]

    def _subsets_of(self, s: np.ndarray, n: int) -> np.ndarray:
        out = [np.zeros(0, U)]
        for b in self.partners(n):
            c = self.overlap(n, b)
            if c <= len(s):
                tag = U((min(n, b) << 32 | max(n, b)) & 0xFFFFFFFFFFFFFFFF)
                take = np.array(list(combinations(range(len(s)), c)))
                out.append(B.mix(B.mix(s)[take].sum(1, dtype=U) ^ B.mix(np.array([tag], U))))
        return np.concatenate(out)

    def _parts_of(self, s: np.ndarray, j: int) -> np.ndarray:
        m, spare = self.parts(j)
        part = (B.mix(s ^ U(j * 0x9E3779B1)) % U(m)).astype(np.int64)
        o = np.argsort(part, kind="stable")
        part = part[o]
        lead = np.flatnonzero(np.diff(part, prepend=-1))
        sums = np.zeros(m, U)
        sums[part[lead]] = np.add.reduceat(B.mix(s[o] + U(1)), lead)
        use = np.argsort(np.bincount(part, minlength=m), kind="stable")[spare:]
        return B.mix(sums[use] + use.astype(U) * U(B.R) + U(j * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


def nodes_of(sid: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A set's name in the clusters of class j."""
    return B.mix(sid.view(U) ^ B.mix(j.astype(U))).view(np.int64)


def set_of(words: np.ndarray, k: int = GRAM) -> np.ndarray:
    return np.unique(B.shingles(words, k))


def set_id(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, in two signed longs."""
    if not len(s):
        return 0, 0
    x = [B.mix(s ^ U(c)).sum(dtype=U) for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    return tuple(int(B.mix(np.array([v], U)).view(np.int64)[0]) for v in x)


#: Sets that are scanned before the largest group among them is taken as known.
LEADERS = 8


def scan(sets: list[np.ndarray], size: np.ndarray, num: int, den: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of all links among the sets (with ``split``, of those between the first ``split``
    and the others), by scanning inverted lists. ``size``: of the whole sets.

    A link within one group adds nothing, and one to another group is found from its other end: so once some sets have
    been scanned, members of the largest group so far are left out. Of many near copies few are scanned.
    """
    n = len(sets)
    held = np.array([len(s) for s in sets])
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), held)
    if split is None:
        first, others = np.arange(n), owner
    else:
        first = np.arange(split)
        keep = owner >= split
        word_of, others = word[keep], owner[keep]
    o = np.argsort(word if split is None else word_of, kind="stable")
    lists = others[o]
    start = np.searchsorted((word if split is None else word_of)[o], np.arange(word.max() + 2))
    edge = np.append(0, np.cumsum(held))
    out, known = [], None
    for turn, i in enumerate(first.tolist()):
        if split is None and turn == LEADERS:
            groups = [find(x) for x in range(n)]
            known = max(set(groups), key=groups.count)
        if known is not None and find(i) == find(known):
            continue
        w = word[edge[i] : edge[i + 1]]
        a, ln = start[w], start[w + 1] - start[w]
        total = int(ln.sum())
        if not total:
            continue
        at = np.arange(total) + np.repeat(a - (np.cumsum(ln) - ln), ln)
        both = np.bincount(lists[at], minlength=n)
        linked = np.flatnonzero(den * both >= num * (size[i] + size - both))
        for j in linked.tolist():
            if (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def row_order(doc_id: str, row: str) -> Column:
    """Order of rows: by id, those without one last, then by what tells rows apart."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).cast("long").alias("id"), F.col(row).alias("row"))


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = GRAM, threshold: tuple[int, int] = THRESHOLD, lower: bool = True, row: Column | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row: the size of its set and the least doc_id that links reach.

    With fewer than k words the whole sequence is one shingle; without words the set is empty and links with
    nothing, itself excepted. Rows with a null id take part: they reach the least id of their group, or null.
    Repeated rows have equal sets and hence one component. Sets are kept as 64-bit hashes of shingles. Other columns are
    not read; an empty table gives an empty one.
    With ``row``, a string that tells rows of one id apart, there are also the columns ``row`` and ``first``: the
    struct (no id, id, row) of the first row of the component, null for a row alone.
    """
    spark = docs.sparkSession
    num, den = threshold
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([] if row is None else [row.alias("row")]))
    more = rows.columns[2:]

    def sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for part in B.slices(batch, "text"):
            yield part, [set_of(w, k) for w in B.hashed_words(part.column("text"), lower)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in sets(batch):
                ids = [set_id(s) for s in own]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in own], pa.int64()), pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64()), *(part.column(c) for c in more)], ["id", "n", "s", "s2", *more])

    known = materialise(rows.mapInArrow(B.tidy(describe), "id long, n long, s long, s2 long" + "".join(f", {c} string" for c in more)), "sets")
    shared = materialise(_shared_elements(rows.drop(*more), sets, parts, num, den), "shared")
    shards = 4 * parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(num, den)
        for batch in batches:
            sids, sizes = batch.column("s").to_pylist(), batch.column("n").to_pylist()
            keys = [(sid, j, key) for sid, x, n in zip(sids, batch.column("x"), sizes) for j, key in plan.keys(np.frombuffer(x.as_buffer(), U), n)]
            if not keys:
                continue
            nodes = nodes_of(np.array([s for s, _, _ in keys], np.int64), np.array([j for _, j, _ in keys]))
            sid, key = np.repeat(nodes, [len(x) for _, _, x in keys]), np.concatenate([x for _, _, x in keys])
            shard = (key % U(shards)).astype(np.int64)
            o = np.argsort(shard, kind="stable")
            sid, key, shard = sid[o], key[o], shard[o]
            cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]].astype(np.int32)), *(pa.array([v[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for v in (sid, key))], ["shard", "sids", "keys"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for s, sids, keys in zip(batch.column("shard").to_pylist(), batch.column("sids"), batch.column("keys")):
                if s != shard and held:
                    yield stars(held)
                    held = []
                shard = s
                held.append((np.frombuffer(sids.as_buffer(), np.int64), np.frombuffer(keys.as_buffer(), U)))
        if held:
            yield stars(held)

    def stars(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sid, key = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        o = np.lexsort((sid, key))
        sid, key = sid[o], key[o]
        lead = np.flatnonzero(np.diff(key, prepend=key[0] + U(1)) != 0)
        least = np.repeat(sid[lead], np.diff(np.append(lead, len(key))))
        pairs = np.unique(np.stack([least, sid], 1)[least != sid], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(num, den)
        for batch in batches:
            of = [plan.classes(n) for n in batch.column("n").to_pylist()]
            s = np.repeat(np.array(batch.column("s").to_pylist(), np.int64), [len(x) for x in of])
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(nodes_of(s, np.array([j for x in of for j in x], np.int64)))], ["s", "node"])

    met = shared.mapInArrow(B.tidy(deal), "shard int, sids binary, keys binary").repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(B.tidy(meet), "src long, dst long")
    near = connected_components(met.distinct())
    sizes = near.groupBy("component").agg(F.count("*").alias("m"))
    blocks = F.when(F.col("m") <= BLOCK, 1).otherwise(F.ceil(F.col("m") / (BLOCK // 2))).cast("int")
    named = shared.select("s", "n").mapInArrow(name, "s long, node long")
    # clusters that hold many of the names are few and broadcast, so that no task gets all of one's names
    placed = by_group(named.join(near, "node"), sizes.withColumn("group_size", F.col("m")), near.count(), "component").withColumn("nb", blocks).withColumn("b", F.pmod("node", "nb").cast("int"))
    found = shared.join(placed, "s").select("component", "s", "n", "nb", "b", "x")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within each group of rows ``(component, o, b)``: of side 0 with side 1, or all of side 0."""
        here, own = None, [[], []]
        links: list[tuple[int, int]] = []

        def settle() -> None:
            rows = own[0] + own[1]
            if len(rows) > 1 and own[0]:
                links.extend((rows[i][0], rows[j][0]) for i, j in scan([x for *_, x in rows], np.array([n for _, n, _ in rows]), num, den, len(own[0]) if own[1] else None))

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["src", "dst"])

        for batch in batches:
            for c, o, b, side, s, n, x in zip(*(batch.column(c).to_pylist() for c in ("component", "o", "b", "side", "s", "n")), batch.column("x")):
                if (c, o, b) != here:
                    settle()
                    here, own = (c, o, b), [[], []]
                    if len(links) > 10_000:
                        yield written()
                        links.clear()
                own[side].append((s, n, np.frombuffer(x.as_py(), U)))
        settle()
        if links:
            yield written()

    def links_of(rows: DataFrame) -> DataFrame:
        rows = rows.select("component", "o", "b", "side", "s", "n", "x").repartition(parts, "component", "o", "b")
        return rows.sortWithinPartitions("component", "o", "b", "side").mapInArrow(B.tidy(scanned), "src long, dst long")

    zero = F.lit(0)
    # a set may come to a cluster by several names
    one = found.where("nb = 1").dropDuplicates(["component", "s"]).select("component", zero.alias("o"), zero.alias("b"), zero.alias("side"), "s", "n", "x")
    links = links_of(one)
    if not sizes.where(F.col("m") > BLOCK).isEmpty():
        links = links.unionByName(_large_clusters(found.where("nb > 1"), links_of, num, den))
    linked = connected_components(links)
    distinct = known.where("n > 0").groupBy("s", "s2").agg(F.min("id").alias("id"), F.count("*").alias("c"), *([F.min(row_order("id", "row")).alias("first")] if more else []))
    # the least id of each component, then of each set
    sets_ = distinct.join(linked, distinct["s"] == linked["node"], "left").withColumn("component", F.coalesce("component", "s"))
    least = sets_.groupBy("component").agg(F.min("id").alias("component_id"), F.sum("c").alias("group_size"), *([F.min("first").alias("first")] if more else []))
    # only groups of several rows need a join; one row is its own component
    firsts = ["first"] if more else []
    groups = materialise(sets_.drop(*firsts).join(least.where("group_size > 1"), "component").select("s", "s2", "component_id", F.col("c").alias("group_size"), *firsts), "components")
    total = known.count()
    bound = max(2, total // 1000)
    key = [F.col("s"), F.col("s2")]
    hot = F.broadcast(groups.where(F.col("group_size") >= bound).select(*key, F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"), *firsts))  # a thousand rows at most
    cold = groups.where(F.col("group_size") < bound).select(*key, "component_id", *firsts)
    out = known.join(hot, ["s", "s2"], "left")
    out = out.where("hot").withColumn("component_id", F.col("hot_id")).unionByName(out.where("hot is null").drop(*firsts).join(cold.hint("merge"), ["s", "s2"], "left"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"), *more, *firsts)


def _large_clusters(found: DataFrame, links_of, num: int, den: int) -> DataFrame:
    """Links within clusters of several blocks. All sets are held against one of their cluster first; those that link
    with it are known to be one group. Every other set then meets every block. So the cost grows with the sets beside the
    group, not with its square: of the links within the group none is needed."""
    leader = found.groupBy("component").agg(F.min("s").alias("lead"), F.max("nb").alias("nb"))
    own = found.select("component", F.col("s").alias("lead"), F.col("n").alias("ln"), F.col("x").alias("lx")).dropDuplicates(["component", "lead"])
    leader = leader.join(own, ["component", "lead"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, np.ndarray] = {}
            near = []
            for x, lx, n, ln in zip(batch.column("x"), batch.column("lx"), batch.column("n").to_pylist(), batch.column("ln").to_pylist()):
                key = lx.as_py()
                if key not in known:
                    known = {key: np.frombuffer(key, U)}
                both = np.isin(np.frombuffer(x.as_py(), U), known[key], assume_unique=True).sum()
                near.append(bool(den * both >= num * (n + ln - both)))
            names = ["component", "s", "n", "nb", "b", "x", "lead"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(near)], [*names, "near"])

    held = found.dropDuplicates(["component", "b", "s"]).join(leader, ["component", "b"]).select("component", "s", "n", "nb", "b", "x", "lead", "lx", "ln")
    held = materialise(held.mapInArrow(hold, "component long, s long, n long, nb int, b int, x binary, lead long, near boolean"), "large-clusters")
    beside = held.where("not near")
    blocks = beside.groupBy("component").agg(F.ceil(F.count("*") / (BLOCK // 2)).cast("int").alias("no"))
    left = beside.join(blocks, "component").withColumn("o", F.pmod(F.xxhash64("s"), F.col("no")).cast("int")).drop("b")
    left = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("side", F.lit(0))
    right = held.join(blocks, "component").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("no") - 1))).withColumn("side", F.lit(1))
    cols = ["component", "o", "b", "side", "s", "n", "x"]
    return held.where("near and s <> lead").select(F.col("lead").alias("src"), F.col("s").alias("dst")).unionByName(links_of(left.select(*cols).unionByName(right.select(*cols))))


LOW = U((1 << 48) - 1)


def _shared_elements(rows: DataFrame, sets, partitions: int, num: int, den: int, flush_at: int = 1_000_000) -> DataFrame:
    """``(s, n, x)``: for sets that may link, the id, the size, and the elements that other sets have too (packed).

    Inverted lists by element: each map task packs its elements into one block for each shard of the hash (48 bits
    of the rest of the hash, run lengths for sets). An element that several of its sets have is known to be shared:
    it goes to its shard once, as a mark, and these sets' own lists pass by; so a very common element costs each
    task one entry. Shards are 65,536 at most, as an element is named by 48 bits and its shard.
    """
    parts = min(partitions, 1 << 16)

    def packed(kind: int, group: np.ndarray, sid: np.ndarray, n: np.ndarray, key: np.ndarray, of: np.ndarray | None = None) -> pa.RecordBatch:
        """Blocks of (set, elements) for each group (shard); all arrays are by element, sorted by group, then set."""
        lead = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(sid, prepend=sid[0] - 1 if sid[0] > 0 else sid[0] + 1) != 0))
        runs = np.diff(np.append(lead, len(sid))).astype(np.uint32)
        cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
        at = np.searchsorted(lead, cuts)
        low, high = (key & U(0xFFFFFFFF)).astype(np.uint32), (key >> U(32)).astype(np.uint16)
        out = [(kind, int(group[a]), sid[lead[i:j]].tobytes(), n[lead[i:j]].astype(np.uint32).tobytes(), runs[i:j].tobytes(), low[a:b].tobytes(), high[a:b].tobytes(), b"" if of is None else of[a:b].astype(np.uint32).tobytes()) for a, b, i, j in zip(cuts, cuts[1:], at, at[1:])]
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], ["kind", "shard", "sids", "ns", "runs", "low", "high", "of"])

    def flush(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sids = np.array(list(held), np.int64)
        size = np.array([len(x) for x in held.values()])
        every = np.concatenate(list(held.values()))
        o = np.argsort(every)
        every, who = every[o], np.repeat(np.arange(len(sids)), size)[o]
        twin = np.zeros(len(every), bool)
        same = every[1:] == every[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        first = twin.copy()
        first[1:] &= ~same
        shard, rest = (every % U(parts)).astype(np.int64), (every // U(parts)) & LOW
        place = np.where(twin, -1, shard * len(sids) + who)
        o = np.argsort(place)[int(twin.sum()) :]
        if len(o):
            yield packed(0, shard[o], sids[who[o]], size[who[o]], rest[o])
        o = np.flatnonzero(first)
        if len(o):
            o = o[np.argsort(shard[o], kind="stable")]
            yield packed(1, shard[o], np.zeros(len(o), np.int64), np.zeros(len(o), np.int64), rest[o])
        # what is known to be shared passes by, dealt by its set
        o = np.flatnonzero(twin)
        if len(o):
            to = (B.mix(sids.view(U)) % U(parts)).astype(np.int64)[who[o]]
            p = np.argsort(to * len(sids) + who[o], kind="stable")
            o, to = o[p], to[p]
            yield packed(2, to, sids[who[o]], size[who[o]], rest[o], shard[o])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = {}, 0
        for batch in batches:
            for _, own in sets(batch):
                for s in own:
                    if len(s) and (sid := set_id(s)[0]) not in held:
                        held[sid] = s
                        count += len(s)
                if count > flush_at:
                    yield from flush(held)
                    held, count = {}, 0
        if held:
            yield from flush(held)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for kind, sh, *cells in zip(batch.column("kind").to_pylist(), batch.column("shard").to_pylist(), *(batch.column(c) for c in ("sids", "ns", "runs", "low", "high", "of"))):
                if sh != shard and held:
                    yield from listed(shard, held)
                    held = []
                shard = sh
                held.append((kind, *(np.frombuffer(c.as_py(), t) for c, t in zip(cells, (np.int64, np.uint32, np.uint32, np.uint32, np.uint16, np.uint32)))))
        if held:
            yield from listed(shard, held)

    def listed(shard: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sid, n = (np.concatenate([np.repeat(h[i], h[3]) for h in held]) for i in (1, 2))
        key = np.concatenate([h[4].astype(U) | h[5].astype(U) << U(32) for h in held])
        of = np.concatenate([h[6].astype(U) if h[0] == 2 else np.full(len(h[4]), shard, U) for h in held])
        kind = np.concatenate([np.full(len(h[4]), h[0], np.int8) for h in held])
        key |= of << U(48)
        keep = kind == 2
        o = np.flatnonzero(~keep)
        if len(o):
            o = o[np.argsort(key[o])]
            lead = np.flatnonzero(np.diff(key[o], prepend=key[o[0]] + U(1)) != 0)
            many = (np.minimum.reduceat(sid[o], lead) != np.maximum.reduceat(sid[o], lead)) | (np.maximum.reduceat(kind[o], lead) > 0)
            keep[o] = np.repeat(many, np.diff(np.append(lead, len(o)))) & (kind[o] == 0)
        sid, n, key = sid[keep], n[keep], key[keep]
        if not len(sid):
            return
        o = np.argsort(sid, kind="stable")
        sid, n, key = sid[o], n[o], key[o]
        lead = np.flatnonzero(np.diff(sid, prepend=sid[0] - 1 if sid[0] > 0 else sid[0] + 1) != 0)
        size = np.diff(np.append(lead, len(sid)))
        to = (B.mix(sid[lead].view(U) + U(1)) % U(parts)).astype(np.int64)
        o = np.argsort(to, kind="stable")
        every = np.argsort(np.repeat(to, size), kind="stable")
        lead, size, to, key = lead[o], size[o], to[o], key[every]
        cuts = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
        at = np.append(0, np.cumsum(size))[cuts]
        out = [(int(to[a]), sid[lead[a:b]].tobytes(), n[lead[a:b]].astype(np.uint32).tobytes(), size[a:b].astype(np.uint32).tobytes(), key[i:j].tobytes()) for a, b, i, j in zip(cuts, cuts[1:], at, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int32(), *[pa.binary()] * 4))], ["to", "sids", "ns", "runs", "x"])

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[], [], []]
        for batch in batches:
            for sids, ns, runs, x in zip(*(batch.column(c) for c in ("sids", "ns", "runs", "x"))):
                runs = np.frombuffer(runs.as_py(), np.uint32)
                held[0].append(np.repeat(np.frombuffer(sids.as_py(), np.int64), runs))
                held[1].append(np.repeat(np.frombuffer(ns.as_py(), np.uint32), runs))
                held[2].append(np.frombuffer(x.as_py(), U))
        if not held[0]:
            return
        sid, n, key = map(np.concatenate, held)
        del held
        o = np.lexsort((key, sid))
        sid, n, key = sid[o], n[o], key[o]
        once = np.ones(len(sid), bool)
        once[1:] = (sid[1:] != sid[:-1]) | (key[1:] != key[:-1])
        sid, n, key = sid[once], n[once], key[once]
        lead = np.flatnonzero(np.diff(sid, prepend=sid[0] - 1 if sid[0] > 0 else sid[0] + 1) != 0)
        ends = np.append(lead[1:], len(sid))
        use = den * (ends - lead) >= num * n[lead].astype(np.int64)  # any partner asks for so many at least
        for at in range(0, len(lead), 2000):
            some = [(a, b) for a, b, ok in zip(lead[at : at + 2000], ends[at : at + 2000], use[at : at + 2000]) if ok]
            if some:
                first = np.array([a for a, _ in some])
                yield pa.RecordBatch.from_arrays([pa.array(sid[first]), pa.array(n[first].astype(np.int64)), pa.array([key[a:b].tobytes() for a, b in some], pa.binary())], ["s", "n", "x"])

    blocks = rows.mapInArrow(B.tidy(deal), "kind int, shard int, sids binary, ns binary, runs binary, low binary, high binary, of binary")
    lists = blocks.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(B.tidy(judge), "to int, sids binary, ns binary, runs binary, x binary")
    return lists.repartition(parts, "to").mapInArrow(B.tidy(enough), "s long, n long, x binary")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with their components; odd inputs as stated in :func:`jaccard_groups`."""
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLE: dict[str, str] = {}
