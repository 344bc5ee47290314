"""Passages of held-out test items within training documents.

Texts are compared as words: longest runs of letters and digits after compatibility decomposition, removal
of combining marks and invisible format characters, and case folding. Documents are read in shards; each
shard has a suffix array over its words, in which every suffix of every item is bisected. Its two neighbours
there give its longest verbatim match; the documents that share ``least`` words with it are an interval of the
array, so that text repeated many times costs no more than other text.

The array is a full one: prefix doubling sorts the suffixes of the shard and of the items together, however
long what they share; the ranks of each doubling are kept, from which the common words of any two suffixes
follow in as many steps. Words that no item holds cannot lie in a match, so only runs of ``least`` or more
words of the items' vocabulary enter it; all other places are decided without sorting.

Items are a stated query set: their bytes are counted first, and those of up to ``block_bytes`` make a block,
which is broadcast; a task searches its shard for one block after the other, so that the documents are read
once whatever the number of items. Nothing is shuffled but what is found.

Defined results: null, empty and short texts (under ``least`` words) match nothing on either side; texts of
any length are compared whole; repeated documents and items all come out; a passage that occurs several
times in a document is one pair in :func:`leaks` and several places in :func:`matches` (each pair of places that
can be extended neither to the left nor to the right); columns besides id and text are ignored; empty tables give
empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import broadcast_if_small

ASCII_WORD = re.compile("[a-z0-9]+")
WORD = regex.compile(r"[\p{L}\p{N}]+")
UNSEEN = regex.compile(r"[\p{M}\p{Cf}]+")
SHARD = 2_000_000  # words of a shard, about


def words(text: str | None) -> list[str]:
    """The words of a text in comparable form."""
    if not text:
        return []
    if text.isascii():
        return ASCII_WORD.findall(text.lower())
    return WORD.findall(UNSEEN.sub("", unicodedata.normalize("NFKD", text)).casefold())


class Runs(NamedTuple):
    """The runs of known words of a text, each followed by 0, with the place of each word in the text (-1: none)."""

    codes: np.ndarray
    source: np.ndarray


def runs(codes: np.ndarray, least: int) -> Runs:
    """Runs of ``least`` or more codes over 0."""
    edges = np.flatnonzero(np.diff(np.r_[False, codes > 0, False]))
    start, end = edges[::2], edges[1::2]
    start, size = start[end - start >= least], (end - start)[end - start >= least]
    at = np.cumsum(size + 1) - size - 1
    source = np.full(int(size.sum()) + len(size), -1, np.int64)
    inner = np.ones(len(source), bool)
    inner[at + size] = False
    source[inner] = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    return Runs(np.where(inner, codes[source], 0), source)


class Suffixes:
    """All suffixes of a text of runs in order: prefix doubling, of which the ranks of each step are kept."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        stops = np.flatnonzero(codes == 0)
        self.left = (stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)).astype(np.int32)  # words up to the end of the run
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)  # 0 stays 0: it is there, and the least
        self.ranks, width, longest = [rank.astype(np.int32)], 1, int(self.left.max(initial=0))
        while width < longest:
            next_ = np.zeros(n, np.int64)
            far = np.flatnonzero(self.left > width)
            next_[far] = rank[far + width]
            rank = np.unique(rank * (n + 1) + next_, return_inverse=True)[1].astype(np.int64)
            self.ranks.append(rank.astype(np.int32))
            width *= 2
        self.rank = self.ranks[-1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of words that the suffixes at two places begin with alike."""
        done = np.zeros(len(a), np.int64)
        for step in reversed(range(len(self.ranks))):
            width, ranks = 1 << step, self.ranks[step]
            x, y = a + done, b + done
            done[(ranks[x] == ranks[y]) & (self.left[x] >= width) & (self.left[y] >= width)] += width
        return done


class Items:
    """The items of a block, ready for search."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int) -> None:
        self.least = least
        kept = [(i, w) for i, w in items if len(w) >= least]
        self.ids = np.array([i for i, _ in kept], np.int64)
        self.code = {w: i + 1 for i, w in enumerate(sorted({x for _, w in kept for x in w}))}
        self.codes = np.array([c for _, w in kept for c in (*map(self.code.__getitem__, w), 0)], np.int64)
        sizes = np.array([len(w) + 1 for _, w in kept], np.int64)
        self.item = np.repeat(np.arange(len(kept)), sizes)
        self.word = np.arange(len(self.codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Search:
    """The suffix array of a shard (codes that end with 0), and where the items' suffixes lie in it."""

    def __init__(self, items: Items, shard: np.ndarray) -> None:
        self.items, least = items, items.least
        found = runs(shard, least)
        n = len(items.codes)
        self.codes, self.source = np.r_[items.codes, found.codes], np.r_[np.full(n, -1), found.source]
        self.group_of = np.zeros(0, np.int64)
        self.queries = self.groups = self.array = self.longest = np.zeros(0, np.int64)
        if not n or not len(found.codes):
            return
        self.suffixes = s = Suffixes(self.codes)
        able = np.flatnonzero(s.left >= least)
        queries, places = able[able < n], able[able >= n]
        self.array = array = places[np.argsort(s.rank[places], kind="stable")]
        # entries that share the first words are one group
        self.group_of = np.r_[0, np.cumsum(s.common(array[:-1], array[1:]) < least)]
        at = np.searchsorted(s.rank[array], s.rank[queries])  # bisection: between at - 1 and at
        above, below = np.maximum(at - 1, 0), np.minimum(at, len(array) - 1)
        one, two = s.common(queries, array[above]), s.common(queries, array[below])
        hit = np.maximum(one, two) >= least
        self.queries, self.longest = queries[hit], np.maximum(one, two)[hit]
        self.groups = self.group_of[np.where(one > two, above, below)[hit]]

    def pairs(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``doc`` (which numbers the documents of the shard by word) and items, each pair once."""
        width = int(doc.max(initial=0)) + 1
        held = np.unique(self.group_of * width + doc[self.source[self.array]]) if len(self.array) else self.group_of
        asked = np.unique(self.groups * (len(self.items.ids) + 1) + self.items.item[self.queries])
        group, item = np.divmod(asked, len(self.items.ids) + 1)
        low, high = np.searchsorted(held, group * width), np.searchsorted(held, (group + 1) * width)
        return _ranges(low, high, held) % width, np.repeat(item, high - low)

    def matches(self, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matches that no word extends: places in the shard, places among the items' codes, words; in parts."""
        if not len(self.queries):
            return
        size = int(self.codes.max()) + 1
        before = np.r_[0, self.codes[:-1]]
        key = self.group_of * size + before[self.array]
        order = np.argsort(key, kind="stable")
        key, array = key[order], self.array[order]  # within a group by the word before
        own = before[self.queries]
        low, high = np.searchsorted(key, self.groups * size), np.searchsorted(key, (self.groups + 1) * size)
        same_low, same_high = (np.searchsorted(key, self.groups * size + own, side) for side in ("left", "right"))
        same_low, same_high = np.where(own > 0, same_low, high), np.where(own > 0, same_high, high)
        counts = same_low - low + high - same_high
        parts = np.cumsum(counts) // most
        for part in np.unique(parts):
            of = np.flatnonzero((parts == part) & (counts > 0))
            one, two = same_low[of] - low[of], high[of] - same_high[of]
            at = np.r_[_ranges(low[of], same_low[of], array), _ranges(same_high[of], high[of], array)]
            query = np.r_[np.repeat(self.queries[of], one), np.repeat(self.queries[of], two)]
            yield self.source[at], query, self.suffixes.common(query, at)


def _ranges(low: np.ndarray, high: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``of[low:high]`` of each pair of bounds, one after the other."""
    size = high - low
    return of[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _searched(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int, block_bytes: int, places: bool) -> DataFrame:
    """One row per match (``places``) or per document of a shard and item."""
    spark = docs.sparkSession
    usable = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    size = usable.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks, shipped = int(size // block_bytes) + 1, []
    for b in range(blocks):
        block = usable.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()  # of bounded size
        shipped.append(spark.sparkContext.broadcast([(r["id"], words(r["text"])) for r in block]))
    names = ["doc_id", "item_id", "doc_word", "item_word", "n_words"][: 5 if places else 2]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Items(shipped[0].value, least) if len(shipped) == 1 else None
        vocabulary: defaultdict[str, int] = defaultdict(count().__next__)
        ids: list[int] = []
        parts: list[np.ndarray] = []
        n = 0

        def shard() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(p) + 1 for p in parts], np.int64)
            firsts = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(parts)), sizes)
            known_ids = np.array(ids, np.int64)
            for b in shipped:
                known = only or Items(b.value, least)
                if not only:
                    vars(b).pop("_value", None)  # one block in memory at a time
                code = np.array([*map(known.code.get, vocabulary, repeat(0)), 0], np.int64)
                found = Search(known, code[np.concatenate([x for p in parts for x in (p, [-1])])])
                if not places:
                    d, item = found.pairs(doc)
                    yield pa.RecordBatch.from_arrays([pa.array(known_ids[d], pa.int64()), pa.array(known.ids[item], pa.int64())], names=names)
                    continue
                for at, query, length in found.matches():
                    d = doc[at]
                    made = [known_ids[d], known.ids[known.item[query]], at - firsts[d], known.word[query], length]
                    yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in made], names=names)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(t)
                if len(found) < least:
                    continue
                ids.append(i)
                parts.append(np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)))
                n += len(found)
                if n >= SHARD:
                    yield from shard()
                    vocabulary.clear()
                    vocabulary.default_factory = count().__next__
                    ids, parts, n = [], [], 0
        if parts:
            yield from shard()

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).mapInArrow(search, ", ".join(f"{c} bigint" for c in names))


def matches(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 12, block_bytes: int = 32 << 20) -> DataFrame:
    """Longest verbatim matches: doc_id, item_id, doc_word, item_word (places counted from 0), n_words."""
    return _searched(docs, doc_id, text, items, item_id, item_text, least, block_bytes, True)


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 12, block_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id) of each document and item with a common passage of ``least`` words or more."""
    return _searched(docs, doc_id, text, items, item_id, item_text, least, block_bytes, False).distinct()


def without_leaks(docs: DataFrame, doc_id: str, found: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """The documents that hold no passage; a document of null id is kept."""
    leaked = broadcast_if_small(found.select(F.col("doc_id").alias("_leaked")).distinct(), max_broadcast)
    return docs.join(leaked, F.col(doc_id) == F.col("_leaked"), "left_anti")
