"""Token counts: greedy longest-match word pieces by a linear automaton that builds no pieces.

A trie holds the vocabulary under two roots: pieces that begin a word, and pieces that continue one. Each node
has a failure link and the number of pieces that following the link completes, so a word is counted in one pass
over its bytes. A word that pieces cannot cover counts as one unknown token.
"""

from __future__ import annotations

import base64
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import _bytes as B

CACHED_WORDS = 1 << 18
CACHED_LENGTH = 64


class LongestMatch:
    """``initial`` pieces begin a word, ``later`` ones continue it; all are bytes. An empty initial piece is a
    token of its own before the word (a lone word mark)."""

    def __init__(self, initial: Iterable[bytes], later: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        self.fail: list[int | None] = [None, None]
        self.pops: list[int] = [0, 0]
        ends = set()
        for root, pieces in ((0, initial), (1, later)):
            for piece in pieces:
                v = root
                for c in piece:
                    if (w := self.next[v].get(c)) is None:
                        w = self.next[v][c] = len(self.next)
                        self.next.append({})
                        self.fail.append(None)
                        self.pops.append(0)
                    v = w
                if v != 1:
                    ends.add(v)
        if 0 in ends:
            self.fail[0], self.pops[0] = 1, 1
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                todo.append(v)
                if v in ends:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z is not None and c not in self.next[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z is not None:
                    self.fail[v], self.pops[v] = self.next[z][c], popped

    def count(self, word: bytes) -> int:
        """Pieces of one word; 1 if pieces cannot cover it."""
        nxt, fail, pops = self.next, self.fail, self.pops
        u, n = 0, 0
        for c in word:
            while (v := nxt[u].get(c)) is None:
                if fail[u] is None:
                    return 1
                n += pops[u]
                u = fail[u]
            u = v
        while u != 1:
            if fail[u] is None:
                return 1
            n += pops[u]
            u = fail[u]
        return n


def byte_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a rank file (a base64 token and its rank on each line): tokens with a leading space begin words."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(x.split()[0]) for x in f if x.strip()]
    return [t[1:] for t in tokens if t[:1] == b" "], [t for t in tokens if t[:1] != b" "]


def _automaton(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    cache = B.worker_cache()
    if ("longest", path) not in cache:
        cache["longest", path] = LongestMatch(*byte_vocabulary(path)), {}
    return cache["longest", path]


def count_text(text: bytes, automaton: LongestMatch, known: dict[bytes, int]) -> tuple[int, int]:
    """Words and tokens of a text. ``known`` keeps counts of short words and is emptied when full."""
    total = words = 0
    for word, times in Counter(text.split()).items():
        if (n := known.get(word)) is None:
            n = automaton.count(word)
            if len(word) <= CACHED_LENGTH:
                if len(known) >= CACHED_WORDS:
                    known.clear()
                known[word] = n
        total += n * times
        words += times
    return words, total


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with n_words and n_tokens (long) instead of the text; null counts as empty. Words are runs of
    anything but ASCII white space. The vocabulary is a file that executors can read. Other columns stay, but columns
    named n_words and n_tokens are replaced; rows that repeat count alike; an empty table gives an empty one."""
    keep = [c for c in docs.columns if c not in ("n_words", "n_tokens", text)]
    docs = docs.select(*keep, F.col(text).cast("binary").alias(text))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(vocabulary)
        for batch in batches:
            got = [count_text(t.as_py() or b"", automaton, known) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], [*keep, "n_words", "n_tokens"])

    return docs.mapInArrow(run, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents``; a null text has none; rows that repeat count alike; an empty table gives an empty one."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE: dict[str, str] = {}
