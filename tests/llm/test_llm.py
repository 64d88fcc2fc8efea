"""Operators for training data against brute force, and their edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalith.llm import bpe, exact_dedup, line_dedup, mixing, ngram_join, pii, quality, repeats, simhash, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "A b\nA b"), (None, "no id here at all, none"), (6, "é🙂 " * 50), (7, "x" * 30000), (8, "word " * 9000)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 2 else f"s{(i or 0) % 3}", None) for i, t in rows], SCHEMA)


def both(spark):
    return [table(spark, EDGE).withColumn("score", F.lit(1)).withColumn("size", F.lit("x")).withColumn("base", F.lit(0)), table(spark, [])]


def test_edges_do_not_crash(spark):
    import public_tokenizers as P

    labels = spark.createDataFrame([(4, 1), (5, 0), (7, None), (None, 1)], "doc_id long, quality int")
    for docs, n in zip(both(spark), (len(EDGE), 0)):
        assert simhash.with_edits(docs).count() == n
        assert simhash.add_fingerprints(docs).count() == n
        assert tokens.token_counts(docs, P.path("byte_bpe_50k.tiktoken")).count() == n
        assert ngram_join.jaccard_groups(docs).count() == n
        assert bpe.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == n
        assert mixing.mix(docs).count() == n
        assert quality.with_scores(docs, quality.fit_sample(docs, labels)).where("score between 0 and 1").count() == n
        assert pii.find(docs, pii.fit(docs)).count() == n
        assert line_dedup.dedup_lines(docs).count() == n
        assert repeats.remove_repeats(docs).count() == n


def test_exact_dedup(spark):
    rows = EDGE + [(20, "ONE"), (21, "É"), (22, "é"), (None, "one")]
    for digest in (lambda t: F.unhex(F.sha2(t, 256)), lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 4), 2, "0"))):
        got = exact_dedup.deduplicate(table(spark, rows), digest=digest).collect()
        norm = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        groups = collections.defaultdict(list)
        for i, t in rows:
            groups[norm(t)].append(i)
        want = sorted(((i, max((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=repr)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert exact_dedup.kept_rows(table(spark, rows)).count() == len(groups)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_jaccard_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(7)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 3, 6, 9, 14, 18, 25, 40, 80, 300]))] for _ in range(20)]
    docs = []
    for i in range(150):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, len(b) // 30])):
            if b:
                b[rng.randrange(len(b))] = "new"
        docs.append((i, " ".join(b)))
    docs += [(None, docs[3][1]), (5, docs[9][1]), (400, None)]
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if (w := words(t.lower() if t else t)) else set() for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[find(i)].append(d)
    want = [(d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(docs)]
    got = ngram_join.jaccard_groups(table(spark, docs).select("doc_id", "text")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("threshold", [(80, 100), (85, 100), (1, 2)])
def test_linked_sets_share_a_key(threshold):
    num, den = threshold
    plan, rng, linked = ngram_join.Plan(num, den), np.random.default_rng(1), 0
    for _ in range(1500):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 120), dtype=np.uint64))
        b = np.union1d(a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 2**63, rng.integers(0, len(a) // 4 + 1), dtype=np.uint64))
        both = np.intersect1d(a, b)
        if den * len(both) >= num * (len(a) + len(b) - len(both)) and len(both):
            linked += 1
            of_a, of_b = dict(plan.keys(both, len(a))), dict(plan.keys(b, len(b)))
            assert any(len(np.intersect1d(of_a[j], of_b[j])) for j in of_a.keys() & of_b.keys())
    assert linked > 300


def test_repeats(spark):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    docs = [(i, "".join(rng.choice([rng.choice(passages), "".join(rng.choice("abc") for _ in range(rng.randrange(30)))]) for _ in range(rng.randrange(6)))) for i in range(40)]
    docs += [(50, docs[3][1]), (50, docs[3][1]), (51, None), (None, "a" * 60)]
    counts = collections.Counter(b[i : i + 12] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - 11))
    want = []
    for d, t in docs:
        b = (t or "").encode()
        gone = {j for i in range(len(b) - 11) if counts[b[i : i + 12]] > 1 for j in range(i, i + 12)}
        want.append((d, len(b), bytes(x for j, x in enumerate(b) if j not in gone)))
    got = repeats.remove_repeats(table(spark, docs), length=12, gram=4).collect()
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got), key=repr) == sorted(want, key=repr)


def test_bpe_equals_library():
    import public_tokenizers as P

    b = bpe.Bpe(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN, leaf=8, piece=6)
    rng = random.Random(1)
    parts = ["a", "b", "'", "s", "re", " ", "  ", "\n", "é", "1", "23", "!!", "🙂", "the", "ll", "\t", "x'", "thethe"]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(120)))
        ids = b.encode(t)
        assert ids.tolist() == b.base.encode_ordinary(t) and b.decode(ids).decode() == t


def test_longest_match():
    rng = random.Random(2)
    first = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(15)}
    later = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(20)} - {b""}
    machine = tokens.LongestMatch(first, later)

    def greedy(w):
        n, i = 0, 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in (later if i else first)), None)
            if j is None:
                return 1
            n, i = n + 1, j
        return n

    for _ in range(2000):
        w = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 15)))
        assert machine.count(w) == greedy(w)


def test_within_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(20)]
    prints = sorted({x ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(6))) for x in base for _ in range(8)})
    df = spark.createDataFrame([(f"{x:032x}",) for x in prints], "fingerprint string")
    got = {(r.query, r.fingerprint, r.distance) for r in simhash.within_radius(df, df).collect()}
    assert got == {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in prints for b in prints if 0 < (a ^ b).bit_count() <= simhash.RADIUS}


def test_edited_texts(spark):
    docs = [(i, "".join(random.Random(i).choice("ab é\n") for _ in range(i % 50))) for i in range(120)]
    order = sorted(docs, reverse=True)
    want = {}
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        want[d] = (len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest())
    got = simhash.with_edits(table(spark, docs)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want


def test_quality_holds_out(spark):
    import zlib

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op6_quality(spark, sf).collect()}
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [d for d in y if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out for d in held)
    assert sum(got[d].predicted == y[d] for d in held) / len(held) > 0.95


@pytest.mark.parametrize("text,spans", [("a.b@c.de x 1.2.3.4", "email:0:8,ip:11:18"), ("+1 (555) 555-1234, 999.1.1.1", "phone:0:17"), ("card 4111 1111 1111 1111.", "card:5:24"), ("", "")])
def test_base_spans(spark, text, spans):
    assert pii.with_candidates(table(spark, [(1, text)])).select(pii.written(F.col("_base"))).first()[0] == spans


def test_radius_reaches_near_copies(spark):
    """Near copies of Jaccard 0.8 to 0.9, far beyond 3 bits, are found and counted; unrelated texts are not."""
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        w = [f"w{rng.randrange(5000)}" for _ in range(600)]
        texts.append(" ".join(w))
        for at in rng.sample(range(0, 590, 10), rng.choice([7, 10, 12])):  # an edited word changes five of about 596 shingles
            w[at + 5] = "changed"
        texts.append(" ".join(w))
    prints = simhash.fingerprints(texts)
    apart = [(int(a, 16) ^ int(b, 16)).bit_count() for a, b in zip(prints[::2], prints[1::2])]
    assert min(apart) > 3
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    got = {(r.query, r.fingerprint) for r in simhash.within_radius(df, df).collect()}
    assert got == {(a, b) for a in prints for b in prints if 0 < (int(a, 16) ^ int(b, 16)).bit_count() <= simhash.RADIUS}
    assert sum((a, b) in got for a, b in zip(prints[::2], prints[1::2])) >= 0.95 * 60
    tables = {(r.query, r.fingerprint) for r in simhash.within_radius(df, df, 7).collect()}
    assert tables == {(a, b) for a, b in got if (int(a, 16) ^ int(b, 16)).bit_count() <= 7}
    near = simhash.within_radius_counts(df.groupBy("fingerprint").agg((2 * F.count("*")).alias("n")), df)
    assert {r.fingerprint: r.near for r in near.collect()} == {a: 2 * sum(x == a for x, _ in got) for a, _ in got}


#: Spans that the base patterns miss, and such as are none.
DISGUISED = ["jane.doe{i} [at] mail [dot] example [dot] com", "call 55512{i:05d}", "555.123.{i:04d}", "4111.1111.1111.1111", "addr 10, 20, 30, {j}"]
NONE = ["4111.1111.1111.1112", "order 55512{i:05d}", "1, 2, 3, {j}", "looked at noon dot then"]
PLAIN = ["jane{i}@example.com", "10.20.30.{j}", "4111 1111 1111 1111", "+1 (555) 555-{i:04d}"]


@pytest.mark.parametrize("share", [0.01, 0.1, 0.5, 0.9, 1.0])
def test_disguised_spans_at_any_frequency(spark, share):
    n = 400
    take = max(1, round(n * share))
    kinds = ["email", "phone", "phone", "card", "ip"]
    docs, want = [], {}
    for i in range(take):
        for kind, form in zip(kinds, DISGUISED):
            span = form.format(i=i, j=i % 250)
            cut = span.split(" ", 1)[0] in ("call", "addr") and span.index(" ") + 1 or 0
            want[len(docs)] = f"{kind}:{8 + cut}:{8 + len(span)}"
            docs.append((len(docs), f"eine ab {span} und {i}x"))
    for forms, m in ((PLAIN, n - take), (NONE, 60)):
        docs += [(len(docs) + j * len(forms) + k, f"eine ab {f.format(i=j, j=j % 250)} und y{j}") for j in range(m) for k, f in enumerate(forms)]
    rows = table(spark, docs)
    got = {r.doc_id: (r.base, r.spans) for r in pii.find(rows, pii.fit(rows)).select("doc_id", pii.written(F.col("base")).alias("base"), pii.written(F.col("spans")).alias("spans")).collect()}
    missed = [(docs[d][1], got[d], s) for d, s in want.items() if got[d][1] != s]
    assert not missed, (len(missed), len(want), missed[:5])
    assert all(got[d][0] == "" for d in want)
    wrong = [(docs[d][1], b, s) for d, (b, s) in got.items() if d not in want and b != s]
    assert not wrong, wrong[:5]


def test_many_near_copies_are_scanned_once():
    """Of a thousand near copies few are scanned, and the groups are those of all pairs."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = [np.setdiff1d(base, rng.choice(base, rng.integers(0, 18), replace=False)) for _ in range(300)]
    sets += [np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64)) for _ in range(5)]
    sets += [np.append(sets[-1][:-2], np.array([1, 2], np.uint64))]
    size = np.array([len(x) for x in sets])
    root = list(range(len(sets)))
    for i, j in ngram_join.scan(sets, size, 85, 100):
        a, b = root[i], root[j]
        root = [min(a, b) if r == max(a, b) else r for r in root]
    want = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 85 * (len(a) + len(sets[j]) - both) and want[i] != want[j]:
                x, y = min(want[i], want[j]), max(want[i], want[j])
                want = [x if r == y else r for r in want]
    assert root == want and len(set(want)) < 10
