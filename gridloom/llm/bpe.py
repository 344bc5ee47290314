"""Token ids of texts by a published byte-level vocabulary, and back.

A text is cut into pieces by the vocabulary's pattern. The bytes of a piece are the first symbols of a
doubly linked list; a priority queue holds the rank of each neighbouring pair that the vocabulary can
merge. The pair of lowest rank (leftmost among equals) is merged, its new neighbours are queued, and
entries whose symbols have changed meanwhile are skipped as stale when they come up. Decoding
concatenates the vocabulary's byte strings.

Defined results: null, empty -> an empty list; blank texts have the ids of their white space; strings that
look like special tokens are ordinary text; lone surrogates cannot occur in UTF-8 columns; very long texts
are encoded whole, a piece of n bytes in O(n log n); repeated texts come out as often as they are given;
extra columns are carried along if named as keys; an empty table gives an empty result.

The vocabulary is a file of fixed size (``path`` is a parameter), read once by the driver and broadcast.
Nothing is shuffled: texts are encoded in Arrow batches where they are read. Each Python worker keeps the
ids of short pieces it has met, up to ``remember`` of them.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: how byte-level vocabularies of this family cut a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: byte string -> id; ids are also the ranks of merges."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    start, end = list(range(n)), list(range(1, n + 1))  # of the symbol that begins at this place
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]  # neighbours
    alive = [True] * n
    queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, upto = heapq.heappop(queue)
        j = right[i]
        if not alive[i] or j < 0 or end[j] != upto:
            continue  # stale
        alive[j], end[i], right[i] = False, end[j], right[j]
        if right[i] >= 0:
            left[right[i]] = i
            if (rank := ranks.get(piece[i : end[right[i]]])) is not None:
                heapq.heappush(queue, (rank, i, end[right[i]]))
        if (before := left[i]) >= 0 and (rank := ranks.get(piece[before : end[i]])) is not None:
            heapq.heappush(queue, (rank, before, end[i]))
    ids, i = [], 0
    while i >= 0:
        ids.append(ranks[piece[start[i] : end[i]]])
        i = right[i]
    return ids


class Encoder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remember: int = 500_000) -> None:
        self.ranks, self.remember = ranks, remember
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        known = self.known
        for piece in self.pieces(text or ""):
            got = known.get(piece)
            if got is None:
                got = merge(piece.encode(), self.ranks)
                if len(piece) <= 32 and len(known) < self.remember:
                    known[piece] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "strings"):
            self.strings = {rank: token for token, rank in self.ranks.items()}
        return b"".join(map(self.strings.__getitem__, ids)).decode()


def encode_column(df: DataFrame, text: str, keys: list[str], path: str, ids: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """``keys`` and the list of ids of each row's text."""
    if len({*keys, ids}) < len(keys) + 1:
        raise ValueError("the names of keys and ids must differ")
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value, pattern)
        for batch in batches:
            made = pa.array(map(encoder.encode, batch.column(len(keys)).to_pylist()), pa.list_(pa.int32()), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], made], names=[*keys, ids])

    return df.select(*keys, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str, keys: list[str], path: str, text: str = "text") -> DataFrame:
    """``keys`` and the text of each row's ids; null ids give null."""
    if len({*keys, text}) < len(keys) + 1:
        raise ValueError("the names of keys and text must differ")
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        for batch in batches:
            made = pa.array([None if x is None else encoder.decode(x) for x in batch.column(len(keys)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], made], names=[*keys, text])

    return df.select(*keys, F.col(ids).alias("_ids")).mapInArrow(run, schema)
