"""Maximal repeat groups and removal against brute force."""

import collections
import random

import numpy as np
import pytest

from curalith.llm import repeats

SCHEMA = "doc_id long, text string"


def surroundings(texts, length, gram):
    """(doc, anchor, lo, hi) of every text."""
    out = []
    for i, t in enumerate(texts):
        data = np.frombuffer(t, np.uint8)
        r, h, a, lo, hi = repeats.anchors(data, np.array([0, len(data)]), length, gram)
        out += [(i, int(x), int(y), int(z), int(k)) for x, y, z, k in zip(a, lo, hi, h)]
    return out


def groups_by_hand(texts, length, gram):
    """Maximal repeats within anchors' surroundings: every string around an anchor, by all its extents."""
    out = {}
    by_hash = collections.defaultdict(list)
    for i, a, lo, hi, h in surroundings(texts, length, gram):
        by_hash[h].append((i, a, a - lo, hi + length - a))
    for own in by_hash.values():
        sets = collections.defaultdict(set)
        for before in range(length - gram + 1):
            for after in range(max(gram, length - before), length + 1):
                meet = collections.defaultdict(set)
                for i, a, left, right in own:
                    if before <= left and after <= right:
                        meet[texts[i][a - before : a + after]].add((i, a))
                for x in meet.values():
                    if len(x) > 1:
                        sets[frozenset(x)].add((before, after))
        for x, extents in sets.items():
            # extents with one set of occurrences are those within the longest
            before, after = max(extents, key=sum)
            i, a = min(x)
            out.setdefault(texts[i][a - before : a + after], set()).update((i, a - before, a + after) for i, a in x)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_groups(spark, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcde é") for _ in range(rng.randrange(10, 45))) for _ in range(5)]
    docs = [(i, "".join(rng.choice([rng.choice(passages), "".join(rng.choice("ab") for _ in range(rng.randrange(14)))]) for _ in range(rng.randrange(6)))) for i in range(25)]
    docs += [(40, docs[3][1]), (41, docs[3][1] + "zz"), (42, docs[3][1]), (43, "a" * 60), (44, ""), (45, None)]
    texts = [(t or "").encode() for _, t in docs]
    rows = repeats.repeat_groups(spark.createDataFrame(docs, SCHEMA), length=12, gram=4).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["repeat"]].add((r.doc_id, r.start, r.stop))
        assert r.occurrences > 1
    ids = [i for i, _ in docs]
    at = {i: n for n, i in enumerate(ids)}
    got = {}
    for x in by.values():
        strings = {texts[at[i]][a:b] for i, a, b in x}
        assert len(strings) == 1
        got[strings.pop()] = x
    assert got == {k: {(ids[i], a, b) for i, a, b in v} for k, v in groups_by_hand(texts, 12, 4).items()}


def test_anchors_do_not_depend_on_the_slice(monkeypatch):
    """The same bytes have the same anchors whatever stands around them, even if hashes often tie."""
    mix = repeats.B.mix
    monkeypatch.setattr(repeats.B, "mix", lambda x: mix(x) & np.uint64(7))
    rng = np.random.default_rng(1)
    one = rng.integers(97, 100, 400).astype(np.uint8)
    alone = repeats.anchors(one, np.array([0, 400]))
    for before in (0, 1, 77, 100_000):
        data = np.concatenate((rng.integers(97, 100, before).astype(np.uint8), one))
        r, *rest = repeats.anchors(data, np.array([0, before, before + 400]))
        assert all((x[r == 1] == y).all() for x, y in zip(rest, alone[1:]))


def test_copies_collapse(spark, monkeypatch):
    """Many copies and a few others, over several flushes, equal brute force."""
    monkeypatch.setattr(repeats, "BYTES_AT_ONCE", 2000)
    monkeypatch.setattr(repeats, "CLASSES_AT_ONCE", 3)
    monkeypatch.setattr(repeats, "ANCHORS_AT_ONCE", 50)
    rng = random.Random(4)
    base = "".join(rng.choice("abcdef") for _ in range(90))
    docs = [(i, base) for i in range(60)] + [(100 + i, base[: 20 + i] + "#" + base[21 + i :]) for i in range(50)]
    docs += [(None, base), (None, "x" + base), (None, base), (7, base), (8, None), (200, "nothing shared here 0123456789")]
    counts = collections.Counter(b[i : i + 12] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - 11))
    want = []
    for d, t in docs:
        b = (t or "").encode()
        gone = {j for i in range(len(b) - 11) if counts[b[i : i + 12]] > 1 for j in range(i, i + 12)}
        want.append((d, len(b), bytes(x for j, x in enumerate(b) if j not in gone)))
    frame = spark.createDataFrame([(*r, 1, 2, b"x") for r in docs], "doc_id long, text string, d int, t int, x binary")
    got = repeats.remove_repeats(frame, length=12, gram=4).collect()
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got), key=repr) == sorted(want, key=repr)
    assert repeats.remove_repeats(frame.limit(0)).count() == 0 and repeats.repeat_groups(frame.limit(0).select("doc_id", "text")).count() == 0


def whole_by_hand(texts, length):
    """Maximal repeats of any length: strings of which no longer one has as many occurrences."""
    where = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            where[t[a : a + length]].add((i, a))
    level = {k: v for k, v in where.items() if len(v) > 1}
    out = {}
    while level:
        longer = collections.defaultdict(set)
        for k, v in level.items():
            for i, a in v:
                if a + len(k) < len(texts[i]):
                    longer[k + texts[i][a + len(k) : a + len(k) + 1]].add((i, a))
        longer = {k: v for k, v in longer.items() if len(v) > 1}
        for k, v in level.items():
            right = any(len(longer.get(k + bytes([c]), ())) == len(v) for c in {texts[i][a + len(k)] for i, a in v if a + len(k) < len(texts[i])})
            before = {texts[i][a - 1] if a else -1 - i for i, a in v}
            if not right and (len(before) > 1 or min(before) < 0):
                out[k] = v
        level = longer
    return out


@pytest.mark.parametrize(("seed", "length", "gram"), [(0, 12, 4), (1, 12, 4), (2, 30, 8)])
def test_whole_groups_far_beyond_surroundings(spark, seed, length, gram):
    """Passages of up to twenty times the minimum, whole copies, and rows that repeat."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop é") for _ in range(n))
    passages = [noise(n * length) for n in (1, 2, 5, 20, 12)]
    docs = [(i, "".join(rng.choice((rng.choice(passages), noise(rng.randrange(3 * length)))) for _ in range(rng.randrange(1, 5)))) for i in range(16)]
    docs += [(50, docs[3][1]), (51, docs[3][1] + "tail"), (51, docs[3][1] + "tail"), (53, ""), (54, None), (55, "x" + passages[0] + "y" + passages[0]), (56, passages[3] + "q" + passages[4]), (57, "z" + passages[3])]
    own = list(dict.fromkeys(docs))
    texts = [(t or "").encode() for _, t in own]
    rows = repeats.whole_repeat_groups(spark.createDataFrame(docs, SCHEMA), length=length, gram=gram, window=5).collect()
    at = {i: n for n, (i, _) in enumerate(own)}
    by = collections.defaultdict(set)
    for r in rows:
        by[r["repeat"]].add((at[r.doc_id], r.start, r.stop))
    got = {}
    for x in by.values():
        strings = {texts[i][a:b] for i, a, b in x}
        assert len(strings) == 1
        got[strings.pop()] = {(i, a) for i, a, _ in x}
    want = whole_by_hand(texts, length)
    assert max(map(len, want)) > 10 * length and sum(len(x) for x in by.values()) == len(rows)
    assert got == want


def test_whole_groups_shuffle_texts_once(spark):
    """Of texts of which little repeats, far less is shuffled than twice their bytes, in however many rounds contexts grow."""
    rng = random.Random(5)
    noise = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9E00)) for _ in range(n))
    # of the long passage's occurrences some begin later, so groups around its later anchors must grow by contexts
    passage = noise(700)
    docs = [(i, noise(3000) + (passage[100 * (i % 3) :] if i % 4 == 0 else noise(500)) + noise(2000)) for i in range(120)]
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = shuffled()
    # a table that is small only in a test is not broadcast
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = repeats.whole_repeat_groups(spark.createDataFrame(docs, SCHEMA), window=8).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    new = sum(v for k, v in shuffled().items() if k not in before)
    assert len(rows) > 60 and max(r.stop - r.start for r in rows) == 2100
    assert new < 2 * sum(len(t.encode()) for _, t in docs)


def test_copies_at_the_ends_of_texts_are_closed(spark):
    """Equal surroundings end where texts do, or where the next bytes differ; else they grow."""
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    one, two = noise(75), noise(31)
    texts = [one, one, one + "x", "y" + one, two + "1", two + "2", "3" + two, "4" + two, "5" + one[:40] + "6", "7" + one[20:64] + "8"]
    rows = repeats.whole_repeat_groups(spark.createDataFrame(list(enumerate(texts)), SCHEMA), length=12, gram=4, window=3).collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[texts[r.doc_id][r.start : r.stop].encode()].add((r.doc_id, r.start))
    assert got == whole_by_hand([t.encode() for t in texts], 12)
