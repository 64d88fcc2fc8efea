"""Personal data: base patterns, and further spans that boosted trees select among generated candidates.

Wide generators propose spans of each kind, also such as the base patterns miss (spelled-out addresses, phones
without a plus, numbers with other separators). A candidate that fails its kind's format check is none (``valid``).
The others' features are their format and context; trees are boosted on them, counted by feature values. Positives
are those with evidence of their own, whether or not the base has them: a form that is telling by itself, or a hint
before it. Feature values weigh much alike however often they occur, and a kind's threshold, set on texts held out
from the trees, stops before the first score whose candidates lack evidence: neither limits how many are added.
Everything on rows is a DataFrame expression; no row leaves its task, and only the counts by feature values, whose
number the features bound, reach the driver.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._names import unused

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the base spans. Look-behinds skip starts inside a run that was tried from its first character, and
#: possessive quantifiers only spare backtracking: matches are those of the plain patterns.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Generators of candidates, those of one kind in order; what they propose may overlap.
WIDE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20(?=[A-Za-z0-9-]++\x20dot\x20))[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]{1,3}+(?:\x20?[.,]\x20?[0-9]{1,3}+){3}",
    r"(?<![0-9])(?:[0-9]{4}(?:[-. _/]{0,2}[0-9]{4}){3}[0-9]{0,3}+|[0-9]{4}[-. _/]{0,2}[0-9]{6}[-. _/]{0,2}[0-9]{4,5}+)(?![0-9])",
    r"(?<![0-9])(?:(?:\+|00)[0-9]{0,3}?[\x20.-]?|[0-9]{1,3}?[\x20.-]?)??\(?[0-9]{3}\)?[\x20./-]?[0-9]{3}[\x20./-]?[0-9]{4}(?![0-9])",
)
#: Words before a span that hint at personal data of its kind.
HINTS = (r"mail|contact|write", r"\bip\b|\bip:|addr|host|server", r"card|visa|pay|credit", r"tel|phone|call|fax|mobile|contact|\bsms")
#: Ends of addresses that are written in plain words.
ENDINGS = r"(?i)(com|org|net|edu|gov|info|io|eu|de|fr|es|uk|us|at|ch|it|nl)$"
FEATURES = ("kind", "form", "hint", "digits", "size", "marks", "before", "after", "at")
PRECISION = 0.98
#: Rows for which values of features count at most when trees are fitted.
WEIGHT = 20
ROUNDS = 30
RATE = 0.4


#: Matches whose places are summed in one go; texts with more sum by blocks of so many.
RUN = 64


def _places(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost and not overlapping: structs of start, end (code points) and the match.

    Summing places copies what was summed before, so runs are short: within blocks, and over the blocks' totals."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("m")), lambda x: x["m"].isNotNull())

    def summed(block: Column, start: Column) -> Column:
        empty = F.array().cast("array<struct<a:int,b:int,m:string>>")

        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + F.length(x["gap"])
            b = a + F.length(x["m"])
            return F.struct(b.cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), x["m"].alias("m")))).alias("out"))

        return F.aggregate(block, F.struct(start.cast("int").alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def offsets(blocks: Column) -> Column:
        """What comes before each block, and all."""
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + F.length(x["gap"]) + F.length(x["m"])))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def by_blocks(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(RUN)), lambda i: F.slice(pairs, i, RUN))
        long = _let(blocks, lambda bs: _let(offsets(bs), lambda at: F.flatten(F.transform(bs, lambda block, i: summed(block, F.get(at, i))))))
        return F.when(F.size(pairs) > RUN, long).otherwise(summed(pairs, F.lit(0)))

    return _let(pairs, by_blocks)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: int, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == 1:  # parts at most 255, of any length
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int"), F.lit(999)) <= 255)
    if kind == 2:
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == 3:
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _passes_span(kind: int, s: Column) -> Column:
    return _passes(kind, s["m"])


def _of_kind(kind: int, s: Column) -> Column:
    return F.struct(s["a"].alias("a"), F.lit(kind).alias("k"), s["b"].alias("b"), s["m"].alias("m"))


def _worth(kind: int, text: Column) -> Column:
    """Whether the text has what any match of the kind needs; a cheap scan."""
    if kind:
        return text.rlike("[0-9]")
    marks = [F.contains(text, F.lit(x)) for x in ("@", "[at]", "(at)", " dot ")]
    return marks[0] | marks[1] | marks[2] | marks[3]


def _listed(text: Column, patterns: tuple[str, ...], base: bool) -> Column:
    none = F.array().cast("array<struct<a:int,k:int,b:int,m:string>>")
    parts = []
    for k, p in enumerate(patterns):
        spans = _places(text, p)
        if base:
            spans = F.filter(spans, partial(_passes_span, k))
        spans = F.transform(spans, partial(_of_kind, k))
        need = F.contains(text, F.lit("@")) if base and k == 0 else F.contains(text, F.lit("+")) if base and k == 3 else _worth(k, text)
        parts.append(F.when(need, spans).otherwise(none))
    return F.array_sort(F.concat(*parts))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base spans ``_base`` and candidates ``_wide``, arrays of (a, k, b, m) by start, then kind.
    A null text has null arrays (``find`` fills it first); columns named ``_base`` and ``_wide`` are replaced, others stay; an empty
    table gives an empty one."""
    return docs.withColumn("_base", _listed(F.col(text), BASE, True)).withColumn("_wide", _listed(F.col(text), WIDE, False))


def _kind_of(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z0-9]"), 2).when(c.isin("(", "[", "{", "<", '"', "'"), 3).when(c.isin(".", ",", ";", ":", "!", "?"), 4).otherwise(5)


def _plain(kind: int, m: Column) -> Column:
    """A candidate's match as the base patterns would have it."""
    if kind == 0:
        m = F.regexp_replace(m, r"\x20?[\[(]at[\])]\x20?|\x20at\x20", "@")
        return F.regexp_replace(m, r"\x20?[\[(]dot[\])]\x20?|\x20dot\x20", ".")
    return F.regexp_replace(m, "[., ]+", ".") if kind == 1 else m


def _by_kind(k: Column, values: list[Column]) -> Column:
    out = values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(k == i, v).otherwise(out)
    return out


def valid(s: Column) -> Column:
    """Whether a candidate passes the format check of its kind, whatever separates its parts."""
    checks = [_passes(k, _plain(k, s["m"])) for k in range(len(KINDS))]
    checks[0] = _plain(0, s["m"]).rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@([A-Za-z0-9-]+\.)+[A-Za-z]{2,}$")
    return _by_kind(s["k"], checks)


def _telling(s: Column) -> Column:
    """Whether a valid candidate's form alone is evidence: an address with marks or a common ending, numbers with
    plain dots, a checksum, a phone's prefix or separators."""
    m = s["m"]
    email = m.rlike(r"[@\[(]") | m.rlike(ENDINGS)
    phone = m.rlike(r"^(\+|00)") | (F.length(F.regexp_replace(m, "[0-9]", "")) >= 2)
    return _by_kind(s["k"], [email, ~m.rlike("[, ]"), F.lit(True), phone])


def features(text: Column, s: Column) -> dict[str, Column]:
    """Small whole numbers that describe a candidate's format and context."""
    m = s["m"]
    before = F.when(s["a"] > 0, F.substring(text, F.greatest(s["a"] - 15, F.lit(1)), F.least(s["a"], F.lit(16)))).otherwise("")
    out = {
        "kind": s["k"],
        "form": _telling(s),
        "hint": _by_kind(s["k"], [F.lower(before).rlike(h) for h in HINTS]),
        "digits": F.least(F.length(F.regexp_replace(m, "[^0-9]", "")), F.lit(20)),
        "size": F.least(F.floor(F.length(m) / 3), F.lit(12)),
        "marks": F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(9)),
        "before": _kind_of(F.right(before, F.lit(1))),
        "after": _kind_of(F.substring(text, s["b"] + 1, F.lit(1))),
        "at": F.contains(m, F.lit("@")),
    }
    return {k: v.cast("int") for k, v in out.items()}


class Trees:
    """Boosted regression trees of depth two over whole-number features, fitted to counted rows."""

    def __init__(self, rows: list[tuple[tuple[int, ...], int, int]], held: list[tuple[tuple[int, ...], int, int]] | None = None, rounds: int = ROUNDS, rate: float = RATE):
        """``rows``: feature values, positives, negatives; ``held``: others, on which thresholds are set. A kind
        without any among these takes all."""
        everything = rows + (held or [])
        rows = [(x, p * w, q * w) for x, p, q in rows or everything for w in [min(1.0, WEIGHT / (p + q))]]
        n = sum(p + q for _, p, q in rows)
        pos = sum(p for _, p, _ in rows)
        self.start = math.log((pos + 1) / (n - pos + 1))
        self.trees: list[tuple] = []
        score = [self.start] * len(rows)
        for _ in range(rounds if n else 0):
            prob = [1 / (1 + math.exp(-s)) for s in score]
            g = [p - (p + q) * z for (_, p, q), z in zip(rows, prob)]
            h = [(p + q) * z * (1 - z) for (_, p, q), z in zip(rows, prob)]
            tree = self._grow([r[0] for r in rows], g, h, list(range(len(rows))), 2, rate)
            self.trees.append(tree)
            score = [s + self._value(tree, r[0]) for s, r in zip(score, rows)]
        own = {r[0][0] for r in held or ()}
        self.limits = self._calibrated([r for r in everything if r[0][0] not in own] + (held or []))

    def _grow(self, x, g, h, at, depth, rate):
        total = sum(g[i] for i in at), sum(h[i] for i in at) + 1.0
        best = None
        for f in range(len(FEATURES)) if depth else ():
            left = [0.0, 1.0]
            by: dict[int, list[float]] = {}
            for i in at:
                e = by.setdefault(x[i][f], [0.0, 0.0])
                e[0] += g[i]
                e[1] += h[i]
            for v in sorted(by)[:-1]:
                left = [left[0] + by[v][0], left[1] + by[v][1]]
                right = total[0] - left[0], total[1] - left[1] + 1.0
                gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - total[0] ** 2 / total[1]
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, v
        if best is None:
            return (round(rate * total[0] / total[1], 9),)
        _, f, v = best
        return f, v, *(self._grow(x, g, h, [i for i in at if (x[i][f] <= v) == side], depth - 1, rate) for side in (True, False))

    def _value(self, tree, x) -> float:
        while len(tree) > 1:
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree[0]

    def _calibrated(self, rows) -> list[float]:
        """For each kind, the least score down to which at each score PRECISION of the candidates are positives."""
        out = []
        for k in range(len(KINDS)):
            levels: dict[float, list[int]] = {}
            for x, p, q in rows:
                if x[0] == k:
                    e = levels.setdefault(round(self.start + sum(self._value(t, x) for t in self.trees), 7), [0, 0])
                    e[0] += p
                    e[1] += p + q
            best = math.inf
            for s in sorted(levels, reverse=True):
                if levels[s][0] < PRECISION * levels[s][1]:
                    break
                best = s
            out.append(best)
        return out

    def selects(self, f: dict[str, Column]) -> Column:
        """Whether a candidate with these features passes its kind's threshold."""

        def expr(tree) -> Column:
            return F.lit(tree[0]) if len(tree) == 1 else F.when(f[FEATURES[tree[0]]] <= tree[1], expr(tree[2])).otherwise(expr(tree[3]))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + expr(tree)
        limit = F.lit(math.inf)
        for k, x in enumerate(self.limits):
            limit = F.when(f["kind"] == k, x).otherwise(limit)
        return total >= limit - 1e-6


def fit(docs: DataFrame, text: str = "text") -> Trees:
    """Trees fitted to the valid candidates of about half of the texts, with thresholds set on the others. Null texts are empty;
    equal texts lie on one side and count as often as they stand; other columns are not read. Without candidates, as in an empty table,
    no threshold is ever reached."""
    rows = with_candidates(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))).where("size(_wide) > 0")
    # equal texts are on one side
    one = rows.select("text", (F.xxhash64("text") % 2 == 0).alias("held"), F.explode("_wide").alias("s")).where(valid(F.col("s")))
    one = one.select("held", F.struct(*[v.alias(k) for k, v in features(F.col("text"), F.col("s")).items()]).alias("f"))
    y = (F.col("f.form") == 1) | (F.col("f.hint") == 1)
    counts = one.groupBy("held", "f").agg(F.count_if(y).alias("p"), F.count_if(~y).alias("q")).collect()
    sides = [sorted((tuple(r["f"]), r["p"], r["q"]) for r in counts if r["held"] == side) for side in (False, True)]
    return Trees(*sides)


def find(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of structs (a, k, b, m): start, kind, end, match, by start, then
    kind. Spans are the base ones and selected candidates that touch none of these. Null and empty texts have no
    spans; rows that repeat have equal ones; an empty table gives an empty one. Other columns stay, whatever their
    names, but columns named ``base`` and ``spans`` are replaced."""
    docs = docs.drop("base", "spans")
    t, base, wide = unused([*docs.columns, "spans"], "_t", "base", "_wide")
    rows = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn(base, _listed(F.col(t), BASE, True)).withColumn(wide, _listed(F.col(t), WIDE, False))
    # candidates that are base spans go first, by hash, so that few are left to be held against all of these;
    # the trees are an expression over the fields of one candidate, and each text has few
    new = F.filter(F.array_except(wide, base), lambda s: F.forall(base, lambda x: (x["b"] <= s["a"]) | (x["a"] >= s["b"])) & valid(s) & model.selects(features(F.col(t), s)))
    rows = rows.withColumn("spans", F.when(F.size(wide) > 0, F.array_sort(F.concat(F.col(base), new))).otherwise(F.col(base))).drop(wide, t)
    return rows.withColumnRenamed(base, "base") if base != "base" else rows


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["a"], s["b"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans by kind, their digest, all spans, and ``n_spans``, the number of all, added ones included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = find(docs, fit(docs)).select("doc_id", "base", "spans")
    kinds = F.transform("base", lambda s: s["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op7_pii": op7_pii}
ORACLE: dict[str, str] = {}
