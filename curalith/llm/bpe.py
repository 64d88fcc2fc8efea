"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut into halves down to leaves; a leaf is encoded as a whole. Two neighbours join by encoding a window
over their border again and keeping every token outside it. The window grows to the nearest places, on either
side, where a match of the split pattern must end whatever stands around: between a character that is not white
space and one that is. No match spans such a place, so tokens outside the window cannot change. A run without
such places may be one long match; its tokens join by windows of growing size until the pairs of tokens at both
window edges encode to themselves, which makes the whole sequence the one encoding of its bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import _bytes as B

LEAF = 1024
PIECE = 512
BLANK = regex.compile(r"\S(?=\s)")


class Bpe:
    """Encoder for ranks ``{bytes: id}`` and a split pattern without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, piece: int = PIECE):
        import tiktoken

        self.base = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ranks, self.pattern, self.leaf, self.piece = ranks, regex.compile(pattern), leaf, piece
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    # one match of the pattern

    def _small(self, piece: bytes) -> list[int]:
        return [self.ranks[piece]] if piece in self.ranks else self.base._core_bpe.encode_single_piece(piece)

    def _stable(self, a: int, b: int) -> bool:
        """Whether two tokens side by side encode to themselves."""
        if (ok := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 1 << 18:
                self.pairs.clear()
            ok = self.pairs[a, b] = self._small(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of the bytes of one match; long ones by halves."""
        if len(piece) <= self.piece or piece in self.ranks:
            return self._small(piece)
        half = len(piece) // 2
        return self.join_piece(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def join_piece(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbouring parts of one match."""
        size = 4
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            middle = b"".join(self.bytes_of[t] for t in left[a:] + right[:b])
            tokens = self._small(middle)
            if (a == 0 or self._stable(left[a - 1], tokens[0])) and (b == len(right) or self._stable(tokens[-1], right[b])):
                return left[:a] + tokens + right[b:]
            size *= 2

    # a text

    def _window(self, text: str) -> list[int]:
        """Tokens of a part of the text that is bounded by places where matches must end."""
        if len(text) <= self.leaf:
            return self.base.encode_ordinary(text)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            out += self.encode_piece(m.group().encode())
        return out

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text)) if text else np.zeros(0, np.uint32)

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return np.array(self.base.encode_ordinary(text[lo:hi]), np.uint32)
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        size, start, end = 64, None, None
        while True:  # windows grow until both edges are certain, or reach the ends
            a, b = max(lo, mid - size), min(hi, mid + size)
            if start is None:
                found = [m.end() for m in BLANK.finditer(text, a, min(mid + 1, hi))]
                start = next((p for p in reversed(found) if lo < p <= mid), lo if a == lo else None)
            if end is None:
                m = BLANK.search(text, mid, min(b + 1, hi))
                end = m.end() if m else hi if b == hi else None
            if start is not None and end is not None:
                break
            size *= 2
        drop = self._count(left[::-1], text[start:mid])
        skip = self._count(right, text[mid:end])
        return np.concatenate([left[: len(left) - drop], np.array(self._window(text[start:end]), np.uint32), right[skip:]])

    def _count(self, tokens: np.ndarray, text: str) -> int:
        """How many tokens, from the first on, make up as many bytes as the text has."""
        need, n = len(text.encode()), 0
        for t in tokens.tolist() if need > 4096 else tokens[:need].tolist():
            if need <= 0:
                break
            need -= len(self.bytes_of[t])
            n += 1
        assert need == 0, "a token spans a certain border"
        return n

    def decode(self, tokens: np.ndarray) -> bytes:
        """Bytes of the tokens, joined up the tree."""
        if len(tokens) <= self.leaf:
            return self.base.decode_bytes(tokens.tolist())
        half = len(tokens) // 2
        return self.decode(tokens[:half]) + self.decode(tokens[half:])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def worker_bpe(path: str, pattern: str) -> Bpe:
    cache = B.worker_cache()
    if ("bpe", path, pattern) not in cache:
        cache["bpe", path, pattern] = Bpe(read_ranks(path), pattern)
    return cache["bpe", path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text (array of int); a null text counts as empty. A column named ``to`` is replaced, others
    stay; rows that repeat have equal ids; an empty table gives an empty one."""
    docs = docs.drop(to) if to != text else docs
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, at = worker_bpe(path, pattern), names.index(text)
        for batch in batches:
            filled = batch.set_column(at, text, batch.column(at).fill_null(""))
            done = 0
            for part in B.slices(filled, text):
                ids = [bpe.encode(t) for t in part.column(text).to_pylist()]
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                off = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.slice(done, part.num_rows).columns, pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], [*names, to])
                done += part.num_rows

    return docs.mapInArrow(B.tidy(run), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row: ids are hashed as little-endian unsigned 32-bit
    integers, decoded bytes as they are. A null text is empty and has no ids; rows that repeat give equal rows; an id may
    be null; other columns are not read; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, pattern)
        for batch in batches:
            for part in B.slices(batch, "text"):
                got = []
                for t in part.column("text"):
                    ids = bpe.encode(t.as_py())
                    got.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(B.tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded; odd inputs as stated in :func:`round_trip`."""
    import public_tokenizers as P

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


QUERIES = {"op4_bpe": op4_bpe}
ORACLE: dict[str, str] = {}
