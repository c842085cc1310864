"""Encoding of texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the pattern that cuts a text into the pieces inside which bytes are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker remembers; when it is full it is emptied.
REMEMBERED = 300_000
#: Longest piece (in characters) that is remembered.
REMEMBERED_LENGTH = 64
_NONE = 1 << 62


class BytePairEncoder:
    """Byte pair encoding by a segment tree.

    The leaves of the tree are byte positions. A position where a symbol begins holds the rank of the pair
    it makes with the next symbol, joined with the position, so that the root holds the leftmost pair of
    least rank. A merge changes three leaves: the pair's own, its left neighbour's, and the one that is
    swallowed; each is a walk to the root. A piece of n bytes takes n log n steps, however it merges.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.cut = regex.compile(PATTERN).findall
        self.memory: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                tree[size + i] = r << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least

        while (top := tree[1]) != _NONE:
            i = top & 0xFFFFFFFF
            j = after[i]
            end[i], after[i] = end[j], after[j]
            put(j, _NONE)
            if (k := after[i]) < n:
                before[k] = i
                r = ranks.get(piece[i : end[k]])
                put(i, _NONE if r is None else r << 32 | i)
            else:
                put(i, _NONE)
            if (h := before[i]) >= 0:
                r = ranks.get(piece[h : end[i]])
                put(h, _NONE if r is None else r << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and empty text. Strings of special tokens are ordinary text."""
        ids: list[int] = []
        if not text:
            return ids
        memory = self.memory
        for piece in self.cut(text):
            known = memory.get(piece)
            if known is None:
                known = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= REMEMBERED_LENGTH:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[piece] = known
            ids += known
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_encoders: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The encoder of a vocabulary file, made once in a process."""
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(read_ranks(path))
    return _encoders[path]


def spread(df: DataFrame) -> DataFrame:
    """`df` in enough partitions to keep all cores busy with work that is heavy for its bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(4 * cores)


def encode_texts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str | None = None, counts: bool = False) -> DataFrame:
    """`key` and `ids` (array of int) of every row, or `n_tokens` with `counts`.

    Null and empty texts have an empty list. Whole texts are encoded, whatever their length; no special
    tokens are added or recognised. Rows with equal keys each give a row; other columns are left out.
    Nothing is shuffled but where the input has fewer partitions than cores. Executors read the
    vocabulary themselves from `folder`, or, where they have no such file, get it with the task.
    """
    path = os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # 50 thousand entries, whatever the data
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BytePairEncoder(shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                lists = [own.encode(t) for t in part.column(1).to_pylist()]
                lengths = np.fromiter(map(len, lists), np.int64, len(lists))
                if counts:
                    found = pa.array(lengths)
                else:
                    flat = np.fromiter((i for x in lists for i in x), np.int32, int(lengths.sum()))
                    found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=[key, "n_tokens" if counts else "ids"])

    chosen = spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    return chosen.mapInArrow(run, f"`{key}` {kind}, {'n_tokens bigint' if counts else 'ids array<int>'}")
