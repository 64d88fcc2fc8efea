"""Repeated byte strings by an enhanced suffix array over sampled suffixes: their removal, and their maximal groups.

Every string of ``length`` bytes belongs to one anchor: the position, among those in it where a whole k-gram fits,
whose k-gram hash is least (leftmost of equals). Equal strings have equal anchors at equal offsets, so only
suffixes at anchors whose hash occurs again need sorting, and sorting is by hash, then bytes. What an anchor's
strings span are its surroundings; anchors with equal surroundings form a class, which enters the array twice at
most, however many members it has, and what a task knows to be repeated passes by as a mark.

In each part of the array adjacent common prefixes give the tree of intervals by a stack scan. The members of an
interval share what follows the anchor; a second array over reversed prefixes gives, among them, the tree of their
common left extensions. A node of that second tree is left-diverse: its members differ, or end, before it. If they
are not all in one child of the first interval either, they are all the occurrences, around this anchor, of one
maximal repeat. ``remove_repeats`` needs for each member the longest left extension in each interval only, which is
that of the deepest node with it; ``repeat_groups`` returns the groups themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from curalith.operators.skew import join_groups
from curalith.storage import bucketed, materialise

from . import _bytes as B

LENGTH = 200
GRAM = 48
U = np.uint64
#: One row of the anchor tables: hash, document (two keys), anchor, first and last start of the strings it owns.
ANCHOR = np.dtype([("h", "<u8"), ("d", "<i8"), ("t", "<i8"), ("a", "<i4"), ("lo", "<i4"), ("hi", "<i4")])


def _least_in_windows(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of w numbers: minima from either end of blocks as wide."""
    m = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, U)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    rear = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(rear[:m], fore[w - 1 : w - 1 + m])


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For rows of bytes: ``(row, hash, anchor, lo, hi)`` of each anchor; strings that start from lo to hi are its own."""
    w = length - gram + 1  # k-grams in a string
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < length:
        return none
    forth, back = B.powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * forth[:n], out=sums[1:])
    h = B.mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    del sums
    # least hash of each window, the leftmost of equals: the upper bits of the hash and the place, in one number
    bits = U(int(n).bit_length())
    m = len(h) - w + 1
    at = (_least_in_windows((h >> bits << bits) | np.arange(len(h), dtype=U), w) & ((U(1) << bits) - U(1))).astype(np.int64)
    # where the upper bits are equal and the others are not, the place decides nothing
    wrong = np.flatnonzero(h[at] != _least_in_windows(h, w))
    for some in np.array_split(wrong, -(-len(wrong) // 10_000)) if len(wrong) else ():
        at[some] = some + np.argmin(np.lib.stride_tricks.sliding_window_view(h, w)[some], axis=1)
    # strings that cross rows are no strings
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:m]
    ok = np.arange(m) + length <= off[1:][row]
    start = np.flatnonzero(ok)
    if not len(start):
        return none
    owner, r = at[start], row[start]
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (r[1:] != r[:-1])
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(start)) - 1
    r = r[lead]
    base = off[r]
    return r, h[owner[lead]], owner[lead] - base, start[lead] - base, start[last] - base


def _order(rows: np.ndarray, *first: np.ndarray) -> np.ndarray:
    """Order of byte rows (width a multiple of 8) by ``first`` keys, then lexicographically."""
    words = np.ascontiguousarray(rows).view(">u8").astype(U)
    return np.lexsort([*words.T[::-1], *first[::-1]]) if len(rows) else np.zeros(0, np.int64)


def _common(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the next."""
    if len(rows) < 2:
        return np.zeros(0, np.int64)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(first, np.minimum(size[1:], size[:-1]))


def _table(x: np.ndarray) -> list[np.ndarray]:
    """Minima of x over runs of 1, 2, 4, ... elements."""
    out = [x]
    while 2 * (step := 1 << len(out) - 1) <= len(x):
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
    return out


def _least(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima from a to b (exclusive, b > a)."""
    k = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), table[0].dtype)
    for i in np.unique(k):
        s = k == i
        out[s] = np.minimum(table[i][a[s]], table[i][b[s] - (1 << i)])
    return out


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan of adjacent common prefixes: ``(length, first, last)`` of every interval of the tree whose members
    share ``least`` bytes or more; deeper ones come first."""
    stack: list[tuple[int, int]] = []
    for i, x in enumerate([*lcp, -1]):
        left = i
        while stack and stack[-1][0] > x:
            size, left = stack.pop()
            yield size, left, i
        if x >= least and (not stack or stack[-1][0] < x):
            stack.append((x, left))


class Tree:
    """Intervals over anchors' surroundings: ``right`` holds bytes + 1 from the anchor on and ``left`` those before it,
    reversed; both are padded with zeros."""

    def __init__(self, h: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, length: int, gram: int):
        self.length, self.gram = length, gram
        self.order = _order(right, h)
        hs = h[self.order]
        self.common = _common(right[self.order], n_right[self.order])
        self.common[hs[1:] != hs[:-1]] = 0
        by_left = _order(left)
        self.rank = np.empty(len(h), np.int64)
        self.rank[by_left] = np.arange(len(h))
        self.extend = _table(_common(left[by_left], n_left[by_left]))

    def nodes(self, batch: int = 200_000) -> Iterator[tuple[np.ndarray, ...]]:
        """``(node, shared, place, member, extension)``: the members of each interval in the order of what stands
        before the anchor, with their place in the suffix array, what the interval shares, and the left extension
        common to a member and the next one (-1 for the last one of an interval)."""
        todo: list[tuple[int, int, int]] = []
        size = 0
        for x in intervals(self.common.tolist(), self.gram):
            todo.append(x)
            size += x[2] - x[1] + 1
            if size >= batch:
                yield self._listed(todo)
                todo, size = [], 0
        if todo:
            yield self._listed(todo)

    def _listed(self, todo: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        shared, a, b = (np.array(x) for x in zip(*todo))
        width = b - a + 1
        node = np.repeat(np.arange(len(a)), width)
        place = np.arange(len(node)) - np.repeat(np.cumsum(width) - width - a, width)
        o = np.lexsort((self.rank[self.order[place]], node))
        node, place = node[o], place[o]
        member = self.order[place]
        extension = np.full(len(node), -1)
        same = np.flatnonzero(node[1:] == node[:-1])
        extension[same] = _least(self.extend, self.rank[member[same]], self.rank[member[same + 1]])
        return node, shared[node], place, member, extension

    def spans(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(member, bytes before the anchor, bytes from it on)``: each member's deepest left-diverse node in each
        interval whose members repeat far enough."""
        for node, shared, _, member, extension in self.nodes():
            best = extension.copy()
            best[1:] = np.maximum(best[1:], extension[:-1])
            good = best >= self.length - shared
            yield member[good], best[good], shared[good]

    def groups(self) -> Iterator[tuple[np.ndarray, int, int]]:
        """``(members, bytes before the anchor, bytes from it on)`` of every maximal repeat of ``length`` bytes or more."""
        reach = _table(self.common)
        for node, shared, place, member, extension in self.nodes():
            good = extension >= self.length - shared
            # runs of members that may be of one group
            edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
            found = [(a + i, a + j + 1, before) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) for before, i, j in intervals(extension[a:b].tolist(), int(self.length - shared[a]))]
            if not found:
                continue
            begin, end, before = np.array(found).T
            ends, within = np.stack([begin, end], 1).ravel(), np.append(place, 0)
            first, last = np.minimum.reduceat(within, ends)[::2], np.maximum.reduceat(within, ends)[::2]
            # all in one child of the interval: these share more to the right and are a group there
            own = first < last
            own[own] = _least(reach, first[own], last[own]) == shared[begin[own]]
            for a, b, x in zip(begin[own].tolist(), end[own].tolist(), before[own].tolist()):
                yield member[a:b], x, int(shared[a])


def _repeated(rows: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Rows whose hash occurs again, among them or the marks."""
    rows = rows[np.argsort(rows["h"], kind="stable")]
    same = rows["h"][1:] == rows["h"][:-1]
    keep = np.isin(rows["h"], marks)
    keep[1:] |= same
    keep[:-1] |= same
    return rows[keep]


def _packed(rows: np.ndarray, to: np.ndarray, kind: int) -> tuple[list, ...]:
    """Records as one block for each destination: kinds, destinations, blocks."""
    o = np.argsort(to, kind="stable")
    rows, to = rows[o], to[o]
    cuts = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
    return [kind] * (len(cuts) - 1), to[cuts[:-1]].tolist(), [rows[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def _doc_part(rows: np.ndarray, parts: int) -> np.ndarray:
    return (B.mix(rows["t"].astype(U) ^ B.mix(rows["d"].astype(U))) % U(parts)).astype(np.int64)


def _dealt(rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """Packed records for each part of the documents."""
    _, to, x = _packed(rows, _doc_part(rows, parts), 0)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(x, pa.binary())], ["to", "x"])


def _by_doc(kind: np.dtype):
    """One row for each document of a part: its keys and its packed records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_py(), kind) for batch in batches for x in batch.column("x")]
        if not held:
            return
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["t"], rows["d"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["d"][1:] != rows["d"][:-1]) | (rows["t"][1:] != rows["t"][:-1])
        cuts = np.append(np.flatnonzero(new), len(rows))
        for at in range(0, len(cuts) - 1, 2000):
            some = cuts[at : at + 2001]
            yield pa.RecordBatch.from_arrays([pa.array(rows["d"][some[:-1]]), pa.array(rows["t"][some[:-1]]), pa.array([rows[a:b].tobytes() for a, b in zip(some, some[1:])], pa.binary())], ["d", "t", "x"])

    return run


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans that cover the same bytes; touching ones become one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    lead = np.flatnonzero(new)
    return np.stack([spans[lead, 0], reach[np.append(lead[1:], len(spans)) - 1]], 1)


SPAN = np.dtype([("d", "<i8"), ("t", "<i8"), ("a", "<i4"), ("b", "<i4")])


#: Anchors, and bytes of surroundings, that a map task gathers before it deals them.
ANCHORS_AT_ONCE, BYTES_AT_ONCE = 400_000, 8 << 20
#: Classes whose bytes are laid out as a matrix at once; an anchor with more has all of its own.
CLASSES_AT_ONCE = 20_000
#: Kinds of rows on the way to the shards: records, marks of what is known to be repeated, records that pass by.
OWN, MARK, BY = 0, 1, 2
#: Primes and bases by which sets of occurrences are told apart whatever their shift: as sums of a document's number times a power
#: of the base by the place. Sums of parts can be added, and a shift is a factor.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], U)
BASES = np.array([1103515245, 1299709711, 1566083941, 1812433253], U)
INVERSES = np.array([pow(int(b), -1, int(p)) for b, p in zip(BASES, PRIMES)], U)
#: An anchor, or the least of a class, with what all members have together: their number, their sum, and the bytes next to their surroundings
#: (NONE where these differ or the text ends).
NONE = 256
SEEN = np.dtype([*ANCHOR.descr, ("n", "<i8"), ("s", "<u4", (4,)), ("left", "<i2"), ("right", "<i2")])
#: A group: its string, the bytes before the anchor, its first occurrence, the number and the sum of all (shifted by the first), of how many
#: classes they are, and whether they have more in common on the left and on the right, beyond their surroundings.
GROUP = np.dtype([("g", "<u8"), ("g2", "<u8"), ("before", "<i4"), ("d", "<i8"), ("t", "<i8"), ("p", "<i4"), ("e", "<i4"), ("n", "<i8"), ("s0", "<u8"), ("s1", "<u8"), ("k", "<i4"), ("l", "i1"), ("r", "i1")])
#: A class of a group.
PART = np.dtype([("g", "<u8"), ("g2", "<u8"), ("before", "<i4"), ("c", "<u8"), ("c2", "<u8")])
MEMBER = np.dtype([("c", "<u8"), ("c2", "<u8"), ("d", "<i8"), ("t", "<i8"), ("a", "<i4")])


def _hashes(data: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each of adjacent spans of bytes, by parts of about ``most`` bytes."""
    other = B.mix(np.arange(256, dtype=U) + U(0x2545F4914F6CDD1D))
    out = np.zeros((2, len(ends)), U)
    i = a = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, a + most, "right")))
        stop = int(ends[j - 1])
        part, e = data[a:stop], ends[i:j] - a
        begin = np.append(0, e[:-1])
        forth, back = B.powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(other[part] * forth[: len(part)], out=sums[1:])
        out[1, i:j] = B.mix((sums[e] - sums[begin]) * back[begin])
        del sums
        out[0, i:j] = B.span_hash(part, begin, e)
        i, a = j, stop
    return out[0], out[1]


class _Surroundings:
    """Anchors with the bytes around them, gathered by a map task, and their classes."""

    def __init__(self, own: list[np.ndarray], bodies: list[np.ndarray], length: int):
        self.own, self.body = np.concatenate(own), np.concatenate(bodies)
        self.size = (self.own["hi"] + length - self.own["lo"]).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.n_left = (self.own["a"] - self.own["lo"]).astype(np.int64)
        c, c2 = _hashes(self.body, self.begin + self.size)
        # a class has one anchor hash and one place of the anchor
        c = B.mix(c ^ B.mix(self.n_left.astype(U)) ^ self.own["h"])
        self.order = np.lexsort((c2, c, self.own["h"]))
        h, self.c, self.c2 = self.own["h"][self.order], c[self.order], c2[self.order]
        new = np.ones(len(self.order), bool)
        new[1:] = (h[1:] != h[:-1]) | (self.c[1:] != self.c[:-1]) | (self.c2[1:] != self.c2[:-1])
        self.lead = np.flatnonzero(new)
        self.count = np.diff(np.append(self.lead, len(new)))
        self.of = np.empty(len(new), np.int64)  # each anchor's class
        self.of[self.order] = np.cumsum(new) - 1
        self.first = self.order[self.lead]  # each class's first anchor

    def take(self, which: np.ndarray) -> np.ndarray:
        """Bytes around the given anchors, joined."""
        return np.concatenate([self.body[a : a + n] for a, n in zip(self.begin[which].tolist(), self.size[which].tolist())]) if len(which) else np.zeros(0, np.uint8)


def _powers(bases: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """Powers of the bases modulo the primes, a row for each exponent."""
    out, e = np.ones((len(exponents), len(PRIMES)), U), exponents.astype(U)
    while e.any():
        odd = (e & U(1)).astype(bool)
        out[odd] = out[odd] * bases % PRIMES
        bases, e = bases * bases % PRIMES, e >> U(1)
    return out


def _summed(s: _Surroundings, several: bool) -> np.ndarray:
    """For each class its least member, by document and place, with what all members have together. ``several``: the
    sums are needed of classes with several anchors only."""
    own = s.own
    sums = own["s"].astype(U)
    one = np.flatnonzero((own["n"] == 1) & ((s.count[s.of] > 1) | (not several)))
    document = B.mix(own["d"][one].astype(U) ^ B.mix(own["t"][one].astype(U)))
    numbers = np.stack([B.mix(document ^ U(i + 1)) % p for i, p in enumerate(PRIMES)], 1)
    sums[one] = numbers * _powers(BASES, own["a"][one]) % PRIMES
    order = np.lexsort((own["a"], own["t"], own["d"], s.of))
    lead = np.searchsorted(s.of[order], np.arange(len(s.lead)))
    out = own[order[lead]]
    out["n"] = np.add.reduceat(own["n"][order], lead)
    out["s"] = np.add.reduceat(sums[order], lead) % PRIMES
    for side in ("left", "right"):
        out[side] = _same(own[side][order], lead)
    return out


def _same(x: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The value that each run has throughout, or NONE."""
    least = np.minimum.reduceat(x, lead)
    return np.where(least == np.maximum.reduceat(x, lead), least, NONE)


def _described(s: _Surroundings, seen: np.ndarray, held: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Groups, given by their classes and the bytes before the anchor and from it on, as records, and their parts.

    Where the surroundings of two members are of different size, and one's hold no more than what all have in common, the
    next byte differs or is missing: with it, both had the same gram and so the same surroundings. So only if they are of one
    size, and one byte is next to all, more is in common.
    """
    before, after = (np.array([x[i] for x in held]) for i in (1, 2))
    pair = np.unique(np.repeat(np.arange(len(held)), [len(x[0]) for x in held]) << 40 | np.concatenate([x[0] for x in held]))
    group, c = pair >> 40, pair & ((1 << 40) - 1)
    lead = np.searchsorted(group, np.arange(len(held)))
    at = s.first[c[lead]]
    middle = s.begin[at] + s.n_left[at]
    g, g2 = _hashes(np.concatenate([s.body[a:b] for a, b in zip((middle - before).tolist(), (middle + after).tolist())]), np.cumsum(before + after))
    order = np.lexsort((seen["a"], seen["t"], seen["d"]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    least = seen[order[np.minimum.reduceat(rank[c], lead)]]
    out, parts = np.zeros(len(held), GROUP), np.zeros(len(c), PART)
    out["g"], out["g2"], out["before"], out["d"], out["t"] = g, g2, before, least["d"], least["t"]
    out["p"], out["e"] = least["a"] - before, least["a"] + after
    out["n"], out["k"] = np.add.reduceat(seen["n"][c], lead), np.diff(np.append(lead, len(c)))
    sums = np.add.reduceat(seen["s"][c].astype(U), lead) % PRIMES * _powers(INVERSES, least["a"]) % PRIMES
    out["s0"], out["s1"] = (sums[:, i] << U(32) | sums[:, i + 1] for i in (0, 2))
    n_left = (seen["a"] - seen["lo"]).astype(np.int64)
    for side, size, byte, common in (("l", n_left, "left", before), ("r", s.size[s.first] - n_left, "right", after)):
        out[side] = (np.maximum.reduceat(size[c], lead) == common) & (_same(seen[byte][c], lead) != NONE)
    parts["g"], parts["g2"], parts["before"] = g[group], g2[group], before[group]
    parts["c"], parts["c2"] = s.c[s.lead[c]], s.c2[s.lead[c]]
    return out, parts


def _dealt_surroundings(s: _Surroundings, length: int, shards: int, parts: int, members: bool) -> Iterator[pa.RecordBatch]:
    """Rows ``(kind, shard, x, body)``: anchors alone in their class; one mark of each class with several, which are
    repeated over all of their surroundings; and, passing by, the spans of these (with ``members``, all members)."""
    alone = s.count == 1
    records = s.own
    if members:
        records = s.own.copy()
        records[s.first[~alone]] = _summed(s, True)[~alone]
    for kind, classes in ((OWN, alone), (MARK, ~alone)):
        which = s.first[classes]
        if not len(which):
            continue
        shard = (s.own["h"][which] % U(shards)).astype(np.int64)
        o = np.argsort(shard, kind="stable")
        which, shard = which[o], shard[o]
        cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)).tolist()
        n = len(cuts) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * n, pa.int32()), pa.array(shard[cuts[:-1]].astype(np.int32)), pa.array([records[which[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([s.take(which[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
            ["kind", "shard", "x", "body"],
        )
    if members:
        rows = np.zeros(len(s.own), MEMBER)
        rows["c"][s.order], rows["c2"][s.order] = s.c, s.c2
        rows["d"], rows["t"], rows["a"] = s.own["d"], s.own["t"], s.own["a"]
    else:
        several = np.flatnonzero(~alone[s.of])
        rows = np.zeros(len(several), SPAN)
        own = s.own[several]
        rows["d"], rows["t"], rows["a"], rows["b"] = own["d"], own["t"], own["lo"], own["hi"] + length
        rows = _joined(rows)
    if len(rows):
        kinds, to, x = _packed(rows, _doc_part(rows, parts), BY)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(to, pa.int32()), pa.array(x, pa.binary()), pa.array([b""] * len(x), pa.binary())], ["kind", "shard", "x", "body"])


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans of each document, overlapping ones as one."""
    spans = spans[np.lexsort((spans["b"], spans["a"], spans["t"], spans["d"]))]
    doc = np.zeros(len(spans), np.int64)
    doc[1:] = np.cumsum((spans["d"][1:] != spans["d"][:-1]) | (spans["t"][1:] != spans["t"][:-1]))
    reach = np.maximum.accumulate(spans["b"] + (doc << 32))
    new = np.ones(len(spans), bool)
    new[1:] = spans["a"][1:] + (doc[1:] << 32) > reach[:-1]
    lead = np.flatnonzero(new)
    out = spans[lead]
    out["b"] = (reach[np.append(lead[1:], len(spans)) - 1] & 0xFFFFFFFF).astype(np.int32) if len(spans) else out["b"]
    return out


def _trees(s: _Surroundings, marks: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, Tree]]:
    """``(classes, tree)`` of a shard's classes, whole anchors at a time; a class of several members stands twice.
    ``marks``: which of the anchors stand for several."""
    several = np.bincount(s.of, weights=1 + marks, minlength=len(s.lead)) > 1
    h = s.own["h"][s.first]
    starts = np.flatnonzero(np.diff(h, prepend=h[0] + U(1)) != 0)  # classes are in order of their anchors' hashes
    cuts = [0]
    for x in starts[1:].tolist():
        if x - cuts[-1] >= CLASSES_AT_ONCE:
            cuts.append(x)
    wide, tall = -(-max(length, 8) // 8) * 8, -(-max(length - gram, 8) // 8) * 8
    padded = np.concatenate((np.zeros(tall, np.uint8), s.body, np.zeros(wide, np.uint8)))
    ahead, behind = np.lib.stride_tricks.sliding_window_view(padded, wide), np.lib.stride_tricks.sliding_window_view(padded, tall)
    for x, y in zip(cuts, [*cuts[1:], len(h)]):
        classes = np.arange(x, y)
        # an anchor with one member in all repeats nothing
        runs = np.flatnonzero(np.diff(h[x:y], prepend=h[x] + U(1)) != 0)
        total = np.add.reduceat(1 + several[x:y], runs)
        classes = classes[np.repeat(total > 1, np.diff(np.append(runs, y - x)))]
        if not len(classes):
            continue
        classes = np.repeat(classes, 1 + several[classes])
        at = s.first[classes]
        n_left, n_right = s.n_left[at], (s.size - s.n_left)[at]
        middle = s.begin[at] + n_left + tall
        right = ahead[middle] + np.uint8(1)
        right[np.arange(wide) >= n_right[:, None]] = 0
        left = behind[middle - tall][:, ::-1] + np.uint8(1)
        left[np.arange(tall) >= n_left[:, None]] = 0
        yield classes, Tree(h[classes], left, n_left, right, n_right, length, gram)


class _Job:
    """The steps that removal and groups have in common: texts dealt once, and their repeated anchors' surroundings."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, length: int, gram: int, kept: bool = False):
        """``kept``: rows that repeat are one, and the texts are written in the buckets they are dealt to."""
        if not 0 < gram <= length:
            raise ValueError("a gram has one byte at least, and a string holds one gram at least")
        spark = docs.sparkSession
        self.length, self.gram = length, gram
        self.parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.shards = 4 * self.parts
        text_of = F.coalesce(F.col(text), F.lit(""))
        self.rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text_of).alias("t"), text_of.alias("text"))
        if kept:
            self.rows = self.dealt = bucketed(_distinct_rows(self.rows, "d", "text"), "dealt-texts", self.parts, "d", "t")
        else:
            # the same exchange serves every join with the texts
            self.dealt = self.rows.repartition(self.parts, "d", "t")

    def lists(self) -> DataFrame:
        """For each document its anchors whose hash occurs again."""
        length, gram, parts, shards = self.length, self.gram, self.parts, self.shards

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, count = [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                every = np.concatenate(held)
                every = every[np.argsort(every["h"], kind="stable")]
                twin = np.zeros(len(every), bool)
                same = every["h"][1:] == every["h"][:-1]
                twin[1:] |= same
                twin[:-1] |= same
                first = twin.copy()
                first[1:] &= ~same
                kinds, to, x = [], [], []
                for kind, rows in ((OWN, every[~twin]), (MARK, every[first]["h"])):
                    h = rows["h"] if kind == OWN else rows
                    for out, more in zip((kinds, to, x), _packed(rows, (h % U(shards)).astype(np.int64), kind)):
                        out += more
                for out, more in zip((kinds, to, x), _packed(every[twin], _doc_part(every[twin], parts), BY)):
                    out += more
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(to, pa.int32()), pa.array(x, pa.binary())], ["kind", "shard", "x"])

            for batch in batches:
                for part in B.slices(batch, "text", 1 << 20):
                    data, off = B.text_bytes(part.column("text"))
                    r, h, a, lo, hi = anchors(data, off, length, gram)
                    out = np.zeros(len(r), ANCHOR)
                    out["h"], out["a"], out["lo"], out["hi"] = h, a, lo, hi
                    out["d"], out["t"] = (part.column(c).to_numpy(zero_copy_only=False)[r] for c in ("d", "t"))
                    held.append(out)
                    count += len(out)
                    if count > ANCHORS_AT_ONCE:
                        yield from flush()
                        held, count = [], 0
            if count:
                yield from flush()

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, own, marks = None, [], []

            def again() -> Iterator[pa.RecordBatch]:
                if own and len(rows := _repeated(np.concatenate(own), np.concatenate(marks) if marks else np.zeros(0, U))):
                    yield _dealt(rows, parts)

            for batch in batches:
                for kind, s, x in zip(batch.column("kind").to_pylist(), batch.column("shard").to_pylist(), batch.column("x")):
                    if kind == BY:
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([x.as_py()], pa.binary())], ["to", "x"])
                        continue
                    if s != shard:
                        yield from again()
                        shard, own, marks = s, [], []
                    (own if kind == OWN else marks).append(np.frombuffer(x.as_py(), ANCHOR if kind == OWN else U))
            yield from again()

        found = self.rows.mapInArrow(B.tidy(find), "kind int, shard int, x binary").repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(B.tidy(meet), "to int, x binary")
        return found.repartition(parts, "to").mapInArrow(_by_doc(ANCHOR), "d long, t long, x binary")

    def near(self, members: bool) -> DataFrame:
        """Rows for the shards, see ``_dealt_surroundings``."""
        length, shards, parts = self.length, self.shards, self.parts

        def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, bodies, size = [], [], 0
            for batch in batches:
                for text, x in zip(batch.column("text"), batch.column("x")):
                    own = np.frombuffer(x.as_py(), ANCHOR)
                    # the list of a row that repeats holds each anchor as often
                    own = own[np.unique(own["a"].astype(np.int64) << 32 | own["lo"], return_index=True)[1]]
                    data = np.frombuffer(text.as_buffer(), np.uint8)
                    if members:
                        seen = np.zeros(len(own), SEEN)
                        for name in ANCHOR.names:
                            seen[name] = own[name]
                        lo, end = own["lo"], own["hi"] + length
                        seen["n"] = 1
                        seen["left"] = np.where(lo > 0, data[lo - 1], NONE)
                        seen["right"] = np.where(end < len(data), data[np.minimum(end, len(data) - 1)], NONE)
                        own = seen
                    held.append(own)
                    bodies.extend(data[a:b] for a, b in zip(own["lo"].tolist(), (own["hi"] + length).tolist()))
                    size += int((own["hi"] + length - own["lo"]).sum())
                    if size > BYTES_AT_ONCE:
                        yield from _dealt_surroundings(_Surroundings(held, bodies, length), length, shards, parts, members)
                        held, bodies, size = [], [], 0
            if size:
                yield from _dealt_surroundings(_Surroundings(held, bodies, length), length, shards, parts, members)

        near = self.dealt.join(self.lists().hint("shuffle_hash"), ["d", "t"]).select("text", "x", "d", "t").mapInArrow(B.tidy(surround), "kind int, shard int, x binary, body binary")
        return near.repartition(parts, "shard").sortWithinPartitions("shard")


def _by_shard(batches: Iterator[pa.RecordBatch], length: int, record: np.dtype = ANCHOR) -> Iterator[tuple]:
    """``(None, rows that pass by)`` and ``(surroundings, marks)`` of each shard, one after the other."""
    shard, own, bodies, marks = None, [], [], []
    for batch in batches:
        for kind, s, x, body in zip(batch.column("kind").to_pylist(), batch.column("shard").to_pylist(), batch.column("x"), batch.column("body")):
            if kind == BY:
                yield None, (s, x.as_py())
                continue
            if s != shard and own:
                yield _Surroundings(own, bodies, length), np.concatenate(marks)
                own, bodies, marks = [], [], []
            shard = s
            own.append(np.frombuffer(x.as_py(), record))
            bodies.append(np.frombuffer(body.as_py(), np.uint8))
            marks.append(np.full(len(own[-1]), kind == MARK))
    if own:
        yield _Surroundings(own, bodies, length), np.concatenate(marks)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, text, n_bytes, spans, kept)`` for each row: bytes covered by a string of ``length`` bytes that also
    starts anywhere else, in this or another row, are removed. ``spans`` is binary, pairs of little-endian 64-bit
    integers, the maximal removed runs; ``kept`` is binary.

    Null texts are empty and shorter ones than ``length`` keep all; repeated rows count as many; rows with a null id
    are told apart by their texts; an empty table gives an empty one; other columns of ``docs`` are not read, whatever
    their names. Anchors and their surroundings travel as packed blocks, one for each shard of the hash. The texts are
    dealt once and meet both the anchors that occur again and, later, the spans. Executors hold a shard at a time,
    whose size falls with the number of shuffle partitions.
    """
    job = _Job(docs, doc_id, text, length, gram)
    parts = job.parts

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, marks in _by_shard(batches, length):
            if s is None:
                yield pa.RecordBatch.from_arrays([pa.array([marks[0]], pa.int32()), pa.array([marks[1]], pa.binary())], ["to", "x"])
                continue
            # members that are no marks, by class
            single = np.flatnonzero(~marks)
            single = single[np.argsort(s.of[single], kind="stable")]
            edge = np.searchsorted(s.of[single], np.arange(len(s.lead) + 1))
            for classes, tree in _trees(s, marks, length, gram):
                for member, before, after in tree.spans():
                    c = classes[member]
                    n = edge[c + 1] - edge[c]
                    if not n.sum():
                        continue
                    own = s.own[single[np.arange(n.sum()) + np.repeat(edge[c] - (np.cumsum(n) - n), n)]]
                    out = np.zeros(len(own), SPAN)
                    out["d"], out["t"], out["a"], out["b"] = own["d"], own["t"], own["a"] - np.repeat(before, n), own["a"] + np.repeat(after, n)
                    yield _dealt(_joined(out), parts)

    spans = job.near(False).mapInArrow(B.tidy(judge), "to int, x binary")
    spans = spans.repartition(parts, "to").mapInArrow(_by_doc(SPAN), "d long, t long, x binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "text", 4 << 20):
                sizes, runs, kept = [], [], []
                for text, x in zip(part.column("text"), part.column("x")):
                    data = text.as_buffer()
                    sizes.append(len(data))
                    if not x.is_valid:
                        runs.append(b"")
                        kept.append(data.to_pybytes())
                        continue
                    s = np.frombuffer(x.as_py(), SPAN)
                    m = _merged(np.stack([s["a"], s["b"]], 1).astype(np.int64))
                    keep = np.ones(len(data), bool)
                    for a, b in m:
                        keep[a:b] = False
                    runs.append(m.astype("<i8").tobytes())
                    kept.append(np.frombuffer(data, np.uint8)[keep].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("d"), part.column("text"), pa.array(sizes, pa.int64()), pa.array(runs, pa.binary()), pa.array(kept, pa.binary())], ["d", "text", "n_bytes", "spans", "kept"])

    out = job.dealt.join(spans.hint("shuffle_hash"), ["d", "t"], "left").select("d", "text", "x").mapInArrow(B.tidy(cut), "d long, text string, n_bytes long, spans binary, kept binary")
    return out.select(F.when(F.col("d") != -(2**63), F.col("d")).alias("doc_id"), "text", "n_bytes", "spans", "kept")


def _distinct_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` without rows that repeat in id and text. Texts are shuffled only if some do."""
    again = docs.groupBy(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t")).agg(F.count("*").alias("n")).where("n > 1")
    return docs if again.isEmpty() else docs.dropDuplicates([doc_id, text])


def _anchored_groups(job: _Job) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Maximal repeats within anchors' surroundings: groups, the classes of each, and the members of each class. All
    classes of a group are in one shard, so what it has together is summed there and no occurrence is written."""
    length, gram = job.length, job.gram

    def block(kind: int, rows: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([rows], pa.binary())], ["kind", "x"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, marks in _by_shard(batches, length, SEEN):
            if s is None:
                yield block(BY, marks[1])
                continue
            seen = None
            for classes, tree in _trees(s, marks, length, gram):
                held, size = [], 0
                for member, before, after in tree.groups():
                    held.append((classes[member], before, after))
                    size += len(member)
                    if len(held) > 5000 or size > 500_000:
                        seen = _summed(s, False) if seen is None else seen
                        yield from (block(kind, rows.tobytes()) for kind, rows in zip((OWN, MARK), _described(s, seen, held)))
                        held, size = [], 0
                if held:
                    seen = _summed(s, False) if seen is None else seen
                    yield from (block(kind, rows.tobytes()) for kind, rows in zip((OWN, MARK), _described(s, seen, held)))

    found = materialise(job.near(True).mapInArrow(B.tidy(judge), "kind int, x binary"), "repeat-groups")

    def table(kind: int, of: np.dtype, but: tuple[str, ...] = ()) -> DataFrame:
        names = [n for n in of.names if n not in but]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column("x"):
                    rows = np.frombuffer(x.as_py(), of)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[n]).view(np.int64) if rows[n].dtype == U else np.ascontiguousarray(rows[n])) for n in names], names)

        sizes = {8: "long", 4: "int", 1: "byte"}
        return found.where(F.col("kind") == kind).mapInArrow(run, ", ".join(f"{n} {sizes[of[n].itemsize]}" for n in names))

    return table(OWN, GROUP), table(MARK, PART), table(BY, MEMBER)


def _occurrences(groups: DataFrame, parts: DataFrame, members: DataFrame) -> DataFrame:
    """``groups`` with each of their occurrences ``(d, t, a)``, given by its anchor."""
    total = groups.agg(F.sum("k")).first()[0] or 1
    return join_groups(parts, groups, total, ["g", "g2", "before"], "k").join(members, ["c", "c2"]).drop("c", "c2", "k")


def repeat_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(repeat, doc_id, text_hash, start, stop, occurrences)``: every maximal repeat of ``length`` bytes or more with
    all its occurrences, one row each; ``repeat`` is a hash of its bytes, ``text_hash`` the xxhash64 of the text
    (which tells rows without an id apart), ``occurrences`` their number.

    A repeat is maximal if no longer string has all of its occurrences; that is judged within the surroundings of an
    anchor, the bytes of all strings that belong to it, at most ``2 * length - gram``. A repeat beyond them comes as
    several, each around an anchor of its own, whose occurrences overlap. Groups and memberships meet by class, so
    copies are listed once each and never in pairs. Repeated rows are one; null texts are empty; rows with a null id
    have a null ``doc_id``; an empty table gives an empty one.
    """
    groups, parts, members = _anchored_groups(_Job(docs, doc_id, text, length, gram, kept=True))
    # a string around several of its anchors has the same occurrences around each
    one = F.min(F.struct("before", "n", "k", F.col("e") - F.col("p"))).alias("m")
    groups = groups.groupBy("g", "g2").agg(one).select("g", "g2", "m.before", "m.n", "m.k", F.col("m.col4").alias("size"))
    every = _occurrences(materialise(groups, "anchored-groups"), parts, members)
    repeat = F.concat(F.lpad(F.hex("g"), 16, "0"), F.lpad(F.hex("g2"), 16, "0"))
    start = F.col("a") - F.col("before")
    return every.select(repeat.alias("repeat"), F.when(F.col("d") != -(2**63), F.col("d")).alias("doc_id"), F.col("t").alias("text_hash"), start.alias("start"), (start + F.col("size")).alias("stop"), F.col("n").alias("occurrences"))


def _islands(chains: DataFrame) -> DataFrame:
    """Of chains ``(chain, p, e, key, l, r)`` those that touch or overlap and have one set of occurrences, but for a shift (``key``),
    as one: the first one's name with the whole extent, open on a side if all that reach as far are."""
    w = Window.partitionBy("key").orderBy("p", "e", "chain")
    upto = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = chains.withColumn("new", F.when(upto.isNull() | (F.col("p") > upto), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    out = rows.groupBy("key", "island").agg(F.min_by("chain", F.struct("p", "e", "chain")).alias("chain"), F.min(F.struct("p", "l")).alias("left"), F.max(F.struct("e", (-F.col("r")).alias("not_r"))).alias("right"))
    return out.select("key", "chain", "left.p", "right.e", "left.l", (-F.col("right.not_r")).alias("r"))


def _common_start(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters that two strings, of one for each byte, have in common at their start."""
    def one(x: str, y: str) -> int:
        n = min(len(x), len(y))
        u, v = (np.frombuffer(z[:n].encode("latin-1"), np.uint8) for z in (x, y))
        odd = np.flatnonzero(u != v)
        return int(odd[0] if len(odd) else n)

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def _growth(rows: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """``(chain, more_l, more_r)``: bytes that all occurrences ``(chain, d, t, a, b, l, r)`` of a chain have in common before
    and after it, on those sides that are open (``l`` and ``r`` not 0)."""
    common = F.pandas_udf(_common_start, "int", F.PandasUDFType.SCALAR)
    open_, found, width = rows, None, window
    while total := open_.count():
        near = open_.join(texts, ["d", "t"]).withColumn("bytes", F.col("text").cast("binary"))
        left = F.when(F.col("l") == 0, "").otherwise(F.reverse(F.decode(F.substring("bytes", (F.greatest(F.col("a") - width, F.lit(0)) + 1).cast("int"), F.least("a", F.lit(width)).cast("int")), "ISO-8859-1")))
        right = F.when(F.col("r") == 0, "").otherwise(F.decode(F.substring("bytes", (F.col("b") + 1).cast("int"), F.lit(width)), "ISO-8859-1"))
        ends = near.select("chain", left.alias("x"), right.alias("y")).groupBy("chain").agg(F.min("x").alias("l0"), F.max("x").alias("l1"), F.min("y").alias("r0"), F.max("y").alias("r1"), F.count("*").alias("n"))
        ends = materialise(ends.select("chain", "n", common("l0", "l1").alias("l"), common("r0", "r1").alias("r")), "common-contexts")
        found = ends.select("chain", "l", "r") if found is None else found.unionByName(ends.select("chain", "l", "r"))
        more = join_groups(open_.drop("l", "r"), ends.where(F.greatest("l", "r") == width), total, "chain", "n")
        sides = [(F.col(x) == width).cast("byte").alias(x) for x in ("l", "r")]
        open_ = materialise(more.select("chain", "d", "t", (F.col("a") - F.col("l")).alias("a"), (F.col("b") + F.col("r")).alias("b"), *sides), "occurrences")
        width = min(4 * width, 1 << 20)
    return found.groupBy("chain").agg(F.sum("l").alias("more_l"), F.sum("r").alias("more_r"))


def whole_repeat_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, window: int = 64) -> DataFrame:
    """``(repeat, doc_id, text_hash, start, stop, occurrences)``: maximal repeats of ``length`` bytes or more however long, with
    all their occurrences, one row each; ``repeat`` is the MD5 of its bytes. Other inputs and columns as in :func:`repeat_groups`.

    Groups of neighbouring anchors that have the same occurrences but for a shift, and touch, are one. Where all
    surroundings, and the bytes next to them, are the same, such a chain grows by the bytes that all occurrences have before and after it: the least and the
    greatest of these contexts, formed before the shuffle, share what all share, so no task gets a group's contexts. Contexts
    widen until they differ. Texts are dealt to buckets once. Until the end, when each is returned, groups
    stand for their occurrences, but for those of chains that may grow. A repeat
    is found if some string of it within an anchor's surroundings has just its occurrences; of those nested in a run
    of one short period, where strings overlap themselves, only some are.
    """
    job = _Job(docs, doc_id, text, length, gram, kept=True)
    groups, parts, members = _anchored_groups(job)
    chain = F.struct("g", "g2", "before", F.col("p").cast("long").alias("p0"), "k")
    chains = groups.select(chain.alias("chain"), F.col("p").cast("long").alias("p"), F.col("e").cast("long").alias("e"), F.struct("s0", "s1", "n", "d", "t").alias("key"), "l", "r")
    chains = materialise(_islands(chains), "chains")
    may_grow = chains.where("l = 1 or r = 1")
    if not may_grow.isEmpty():
        start = F.col("a") - F.col("before") - F.col("p0") + F.col("p")
        rows = _occurrences(may_grow.select("chain.*", "chain", "p", "e", "l", "r"), parts, members)
        rows = materialise(rows.select("chain", "d", "t", start.alias("a"), (start + F.col("e") - F.col("p")).alias("b"), "l", "r"), "occurrences")
        chains = chains.join(_growth(rows, job.dealt, window), "chain", "left")
        chains = chains.select("chain", (F.col("p") - F.coalesce("more_l", F.lit(0))).alias("p"), (F.col("e") + F.coalesce("more_r", F.lit(0))).alias("e"), "key", "l", "r")
        chains = _islands(chains)
    size = F.col("e") - F.col("p")
    content = chains.select("chain.*", "p", "e", "key.n", "key.d", "key.t").join(job.dealt, ["d", "t"])
    content = content.select("g", "g2", "before", "k", (F.col("p") - F.col("p0") - F.col("before")).alias("shift"), size.alias("size"), "n", F.unhex(F.md5(F.substring(F.col("text").cast("binary"), (F.col("p") + 1).cast("int"), size.cast("int")))).alias("md5"))
    every = _occurrences(materialise(content, "contents"), parts, members)
    start = F.col("a") + F.col("shift")
    return every.select(F.lower(F.hex("md5")).alias("repeat"), F.when(F.col("d") != -(2**63), F.col("d")).alias("doc_id"), F.col("t").alias("text_hash"), start.alias("start"), (start + F.col("size")).alias("stop"), F.col("n").alias("occurrences"))


def repeat_groups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal repeat groups of ``documents``; odd inputs as stated in :func:`whole_repeat_groups`."""
    return whole_repeat_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without their repeated bytes; odd inputs as stated in :func:`remove_repeats`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs)
    kept = F.length("kept").cast("long")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.floor(F.length("spans") / 16).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_repeats": op10_repeats, "repeat_groups": repeat_groups_query}
ORACLE: dict[str, str] = {}
