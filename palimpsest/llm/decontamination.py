"""Benchmark decontamination by greedy string tiling.

Texts become words (lower case, letters and digits). The k-word windows of the benchmark are the
seeds; a document's windows are hashed with a rolling (Karp-Rabin) hash and joined to them, in array
operations. Maximal common matches are found by their ends alone: a seed begins one where the words
before it differ, and ends one where the words after it differ; on each diagonal the beginnings and
ends alternate. Of an endlessly repeated word this leaves one match a position, not one a pair of
positions. The longest match that no tile overlaps is marked again and again (running Karp-Rabin:
what is left of a match after marking competes anew), until none of ``min_match`` words is left. An
item's coverage is the share of its words under tiles, in any order, so reordered passages are caught.

The benchmark is split into blocks of at most ``BLOCK_WORDS`` words; a block is broadcast (bounded by
that number), its seeds are built once a worker, and each block takes one pass over the documents, so
a benchmark of any size is used whole.

Defined results: null or empty documents and items match nothing; an item with fewer words than
min_match must occur as a whole, and one under ``MIN_WORDS`` words is reported (as short) but never
makes ``clean`` drop a document; repeated items and documents give a row each; rows with null ids
keep them; long and repetitive texts are read whole.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_WORDS = 1_000_000
#: Shorter items (a name, a number) are in too many clean documents to condemn them.
MIN_WORDS = 5
_TABLE_BITS = 22
_WORD = re.compile(r"[^\W_]+")

Item = tuple[int | None, str]
Hit = tuple[int | None, int, int, int]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def tiles(p: np.ndarray, q: np.ndarray, n: np.ndarray, n_item: int, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, document position, length) from maximal matches of the same form.

    Longest first, ties to the smaller item and document position. It ends when no stretch of the
    item that is still free could hold a tile.
    """
    order = np.lexsort((q, p, -n))
    p, q, n = p[order], q[order], n[order]
    free, taken, out, heap, at = np.ones(n_item, bool), set(), [], [], 0
    while at < len(n) or heap:
        if heap and (at == len(n) or heap[0] < (-n[at], p[at], q[at])):
            m, a, b = heapq.heappop(heap)
            m = -m
        else:
            m, a, b = int(n[at]), int(p[at]), int(q[at])
            at += 1
        open_ = free[a : a + m].tolist()
        if taken:
            open_ = [x and b + j not in taken for j, x in enumerate(open_)]
        if all(open_):
            out.append((a, b, m))
            free[a : a + m] = False
            taken.update(range(b, b + m))
            edge = np.flatnonzero(np.diff(np.r_[0, free, 0].astype(np.int8)))
            if not len(edge) or (edge[1::2] - edge[::2]).max() < min_match:
                break
            if len(n) - at > 256:  # matches with too little left
                before = np.r_[0, np.cumsum(free)]
                alive = before[p[at:] + n[at:]] - before[p[at:]] >= min_match
                p, q, n, at = p[at:][alive], q[at:][alive], n[at:][alive], 0
            continue
        j = 0
        while j < m:
            if not open_[j]:
                j += 1
                continue
            start = j
            while j < m and open_[j]:
                j += 1
            if j - start >= min_match:
                heapq.heappush(heap, (start - j, a + start, b + start))
    return out


class _Windows:
    """The windows of k words of a block's items, in groups of equal ones, sorted by the word before and by the word after."""

    def __init__(self, k: int, words: list[np.ndarray], items: list[int]):
        self.k = k
        self.item = np.concatenate([np.full(len(w) - k + 1, i, np.int64) for w, i in zip(words, items, strict=True)])
        self.at = np.concatenate([np.arange(len(w) - k + 1) for w in words])
        before = np.concatenate([np.r_[-1, w[: len(w) - k]] for w in words])
        after = np.concatenate([np.r_[w[k:], -1] for w in words])
        hashes = np.concatenate([Seeds.windows(w, k) for w in words])
        self.hashes, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        whole = np.concatenate([np.lib.stride_tricks.sliding_window_view(w, k) for w in words])
        self.sample = whole[first]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True
        self.sides = []
        for word in (before, after):
            key = (group.astype(np.int64) << 32) + word + 2
            order = np.argsort(key, kind="stable")
            self.sides.append((key[order], order))

    def ends(self, side: int, group: np.ndarray, q: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, place there, q) of the windows of each group whose neighbour on a side isn't word."""
        key, order = self.sides[side]
        base = group.astype(np.int64) << 32
        cuts = [np.searchsorted(key, base), np.searchsorted(key, base + word + 2), np.searchsorted(key, base + word + 2, "right"), np.searchsorted(key, base + (1 << 32))]
        low, size = np.concatenate([cuts[0], cuts[2]]), np.concatenate([cuts[1] - cuts[0], cuts[3] - cuts[2]])
        total = int(size.sum())
        places = order[np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)]
        return self.item[places], self.at[places], np.repeat(np.concatenate([q, q]), size)

    def runs(self, doc: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """(item, item position, document position, length) of the maximal matches, by item."""
        k, h = self.k, Seeds.windows(doc, self.k)
        q = np.flatnonzero(self.table[h >> np.uint64(64 - _TABLE_BITS)])
        if not len(q):
            return None
        group = np.searchsorted(self.hashes, h[q]).clip(max=len(self.hashes) - 1)
        same = self.hashes[group] == h[q]
        q, group = q[same], group[same]
        if not len(q):
            return None
        same = (np.lib.stride_tricks.sliding_window_view(doc, k)[q] == self.sample[group]).all(1)
        q, group = q[same], group[same]
        padded = np.r_[-2, doc, -2]  # no word, and not what stands before or after an item
        found = []
        for side, word in ((0, padded[q]), (1, padded[q + k + 1])):
            i, p, at = self.ends(side, group, q, word)
            order = np.lexsort((at, at - p, i))
            found.append((i[order], p[order], at[order]))
        (i, p, start), (_, _, end) = found
        return i, p, start, end - start + k


class Seeds:
    """A block of items: their words, and their windows of min_match words (of an item's length where that is smaller)."""

    def __init__(self, items: list[Item], min_match: int = MIN_MATCH, coverage: float = COVERAGE):
        self.min_match, self.coverage, self.ids, self.words = min_match, coverage, [], []
        self.vocab: dict[str, int] = {}
        for item_id, text in items:
            if w := words_of(text):
                self.ids.append(item_id)
                self.words.append(np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int64))
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            by_size.setdefault(min(min_match, len(w)), []).append(i)
        self.kinds = [_Windows(k, [self.words[i] for i in x], x) for k, x in by_size.items()]

    @staticmethod
    def windows(w: np.ndarray, k: int) -> np.ndarray:
        """Rolling hash of each k-word window; the high bits are well mixed."""
        if len(w) < k:
            return np.empty(0, np.uint64)
        mult = np.random.default_rng(77).integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1) if k != MIN_MATCH else _MULT
        w = w.astype(np.uint64) + np.uint64(7)
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h += w[j : len(w) - k + 1 + j] * mult[j]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    def hits(self, text: str | None, least: int = 0) -> list[Hit]:
        """(item_id, tiles, covered words, item's words) of every item of at least so many words that a text covers enough."""
        got = words_of(text)
        if not got or not self.ids:
            return []
        get = self.vocab.get
        doc = np.array([get(w, 0) for w in got], np.int64)
        out = []
        for kind in self.kinds:
            if (runs := kind.runs(doc)) is None:
                continue
            cuts = np.flatnonzero(np.diff(runs[0])) + 1
            for i, p, q, n in zip(*(np.split(x, cuts) for x in runs), strict=True):
                i, size = int(i[0]), len(self.words[int(i[0])])
                if size < least:
                    continue
                touched = np.bincount(p, minlength=size + 1) - np.bincount(p + n, minlength=size + 1)
                if (np.cumsum(touched)[:size] > 0).sum() < self.coverage * size:  # no tiling can cover more than the matches do
                    continue
                found = tiles(p, q, n, size, kind.k)
                covered = sum(t[2] for t in found)
                if covered >= self.coverage * size:
                    out.append((i, (self.ids[i], len(found), covered, size)))
        return [hit for _, hit in sorted(out, key=lambda x: x[0])]


_MULT = np.random.default_rng(77).integers(1, 2**63, MIN_MATCH, dtype=np.uint64) | np.uint64(1)
#: A worker's seeds by block; a few blocks may take turns in one worker.
_BUILT: OrderedDict[str, Seeds] = OrderedDict()


class Block:
    """A broadcast block of the benchmark. Each worker builds its seeds once."""

    def __init__(self, spark, items: list[Item], min_match: int, coverage: float):
        self.shared, self.key, self.min_match, self.coverage = spark.sparkContext.broadcast(items), uuid.uuid4().hex, min_match, coverage

    def seeds(self) -> Seeds:
        if self.key not in _BUILT:
            while len(_BUILT) >= 4:
                _BUILT.popitem(last=False)
            _BUILT[self.key] = Seeds(self.shared.value, self.min_match, self.coverage)
        _BUILT.move_to_end(self.key)
        return _BUILT[self.key]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[Item]]:
    """The benchmark's items in blocks of about block_words words, one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # a word and its separator take two characters at least
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // (2 * block_words)))
    for b in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, n_tiles, covered, n_words, coverage, short of every document and item it covers enough."""
    schema = "doc_id long, item_id long, n_tiles int, covered int, n_words int"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    out = None
    for items in blocks(benchmark, block_words):
        block = Block(docs.sparkSession, items, min_match, coverage)

        def find(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            seeds = block.seeds()
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in seeds.hits(t.as_py())]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "n_tiles", "covered", "n_words"])

        part = texts(docs).mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("coverage", F.round(F.col("covered") / F.col("n_words"), 6)).withColumn("short", F.col("n_words") < MIN_WORDS)


def _uncovered(block: Block, least: int):
    """A column function: whether a text covers no item of a block, of so many words at least, enough."""

    @F.pandas_udf("boolean")
    def fine(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seeds = block.seeds()
        for part in parts:
            yield pd.Series([not seeds.hits(t, least) for t in part.tolist()], dtype=bool)

    return fine


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, that cover no item of min_words words or more enough. No shuffle."""
    for items in blocks(benchmark, block_words):
        block = Block(docs.sparkSession, items, min_match, coverage)
        docs = docs.where(_uncovered(block, min_words)(docs["text"].cast("string")))
    return docs
