"""Benchmark passages in documents, by SimHash of item-sized windows.

Every run of as many words as a benchmark item has is a window. Its fingerprint is the 64-bit SimHash of
its five-word shingles, each weighted by how often it occurs. The fingerprints of the items stand in a
multi-index: five blocks of 12 or 13 bits, each listed under all values within 3 bits, so that every
item within 19 bits of a window's fingerprint is found in some block. The items found are verified by exact
weighted-shingle similarity: sum of the smaller counts over sum of the larger ones, 0.8 or more.

A window that reaches 0.8 shares at least 1.6 m / 1.8 of its m shingles with the item, so windows with
fewer shingles that occur in any item of their size are passed over before fingerprints are made; this loses nothing.
Items of other sizes do not count: else a passage of 59 words would give all its windows of 15 to 58 words too.

Defined results: null and empty texts contain nothing; items of fewer than five words are not searched
for, as they occur by chance; documents shorter than an item are one window. Repeated documents and
items are all reported. Other columns are ignored. The benchmark is handled in blocks of at most
ITEMS items and ITEM_BYTES bytes, which bounds what is broadcast (9.6 KB of index an item of 15 to 59 words); leaks() reads the documents
once for each block, remove_leaking() once in all, and neither shuffles them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WordHashes, keep_rows, shingles, slices

WORDS = re.compile(r"\w+")
SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 19, 5
ITEMS, ITEM_BYTES = 4096, 16_000_000
#: Words whose hashes a search keeps.
HELD = 400_000
_BITS = np.arange(64, dtype=np.uint64)
#: First bit and width of each block.
_PLACES = [(64 * b // BLOCKS, 64 * (b + 1) // BLOCKS - 64 * b // BLOCKS) for b in range(BLOCKS)]
#: By width: values of a block that lie within RADIUS // BLOCKS bits of 0.
_NEAR = {w: np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(w), r)], np.uint16) for _, w in _PLACES}


def fingerprint(seq: np.ndarray) -> int:
    """SimHash of shingle hashes; a shingle counts as often as it occurs."""
    votes = ((seq[:, None] >> _BITS) & np.uint64(1)).sum(axis=0)
    return int(np.packbits(2 * votes > len(seq), bitorder="little").view(np.uint64)[0])


class Index:
    """Items' fingerprints in a multi-index, and their shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes = WordHashes()
        self.items = [(i, len(w), shingles(hashes.array(w), SHINGLE)) for i, text in items if len(w := WORDS.findall((text or "").lower())) >= SHINGLE]
        self.counts = [Counter(s.tolist()) for _, _, s in self.items]
        self.sizes = sorted({n for _, n, _ in self.items})
        joined = np.concatenate([np.empty(0, np.uint64), *(s for _, _, s in self.items)])
        self.known = np.unique(joined)
        # The sizes (by number) of the items in which known[j] occurs: held[starts[j] : starts[j + 1]].
        size = np.searchsorted(self.sizes, np.array([n for _, n, _ in self.items], np.int64)).astype(np.int64)
        pairs = np.unique(np.searchsorted(self.known, joined) * len(self.sizes) + np.repeat(size, np.array([len(s) for _, _, s in self.items], np.int64)))
        self.starts = np.searchsorted(pairs, np.arange(len(self.known) + 1) * len(self.sizes)).astype(np.int32)
        self.held = (pairs % max(1, len(self.sizes))).astype(np.int32)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.prints = np.array([fingerprint(s) for _, _, s in self.items], np.uint64)
        self.blocks = []
        for first, width in _PLACES:
            keys = ((self.prints >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.uint16)
            keys = (keys[:, None] ^ _NEAR[width][None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            self.blocks.append((np.searchsorted(keys[order], np.arange((1 << width) + 1)), (order // len(_NEAR[width])).astype(np.int32)))

    def near(self, mark: int) -> list[int]:
        """Numbers of the items whose fingerprints are within RADIUS bits of mark."""
        found = [listed[bounds[k] : bounds[k + 1]] for (first, width), (bounds, listed) in zip(_PLACES, self.blocks, strict=True) for k in [mark >> first & (1 << width) - 1]]
        at = np.unique(np.concatenate(found))
        return at[np.bitwise_count(self.prints[at] ^ np.uint64(mark)) <= RADIUS].tolist()

    def hits(self, seq: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each size whose items have shingles in seq: the size, and the places in seq of such shingles."""
        at = np.flatnonzero(self.sieve[(seq & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(at):
            return
        p = np.minimum(np.searchsorted(self.known, seq[at]), len(self.known) - 1)
        same = self.known[p] == seq[at]
        at, (met, back) = at[same], np.unique(p[same], return_inverse=True)
        of = [self.held[lo:hi] for lo, hi in zip(self.starts[met].tolist(), self.starts[met + 1].tolist(), strict=True)]
        if not of:
            return
        which, of = np.repeat(np.arange(len(met)), [len(x) for x in of]), np.concatenate(of)
        order = np.argsort(of, kind="stable")
        ends = np.flatnonzero(np.diff(of[order], append=-1)) + 1
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            here = np.zeros(len(met), bool)
            here[which[order[lo:hi]]] = True
            yield self.sizes[of[order[lo]]], at[here[back]]


def overlap(a: Counter, b: Counter) -> float:
    """Sum of the smaller counts over sum of the larger ones."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (a.total() + b.total() - both) if a or b else 0.0


def search(words: list[str], index: Index, hashes: WordHashes) -> dict[int, tuple[float, int, int]]:
    """For each item (by number) that a text contains: similarity, first word and end of its best window."""
    seq = shingles(hashes.array(words), SHINGLE)
    best: dict[int, tuple[float, int, int]] = {}
    for size, at in index.hits(seq):
        m = min(size, len(words)) - SHINGLE + 1
        need = SIMILARITY * (m + size - SHINGLE + 1) / (1 + SIMILARITY)
        if m < 1 or min(m, len(at)) < need - 1e-9:
            continue
        sums = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(seq)))])
        for p in np.flatnonzero(sums[m:] - sums[:-m] >= need - 1e-9).tolist():
            window = seq[p : p + m]
            counts = None
            for k in index.near(fingerprint(window)):
                if index.items[k][1] != size:
                    continue
                counts = counts or Counter(window.tolist())
                value = overlap(counts, index.counts[k])
                if value >= SIMILARITY - 1e-12 and (k not in best or value > best[k][0]):
                    best[k] = (value, p, p + m + SHINGLE - 1)
    return best


def scan(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = shared.value, WordHashes(HELD)
        for batch in batches:
            texts = batch.column("text")
            ids = batch.column("doc_id")
            for lo, hi in slices(texts):
                rows = []
                for i, text in enumerate(texts.slice(lo, hi - lo).to_pylist(), lo):
                    words = WORDS.findall((text or "").lower())
                    if len(words) >= SHINGLE:
                        rows += [(i, index.items[k][0], *v) for k, v in search(words, index, hashes).items()]
                part = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(part[0], pa.int64())), *(pa.array(x, t) for x, t in zip(part[1:], kinds, strict=True))],
                    ["doc_id", "item_id", "similarity", "first_word", "end_word"],
                )

    return run


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    part, size = [], 0
    for row in benchmark.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        if part and (len(part) >= ITEMS or size + len(row.text) > ITEM_BYTES):
            yield part
            part, size = [], 0
        part.append((row.item_id, row.text))
        size += len(row.text)
    if part:
        yield part


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, end_word: the best window of each item in each document that contains it."""
    schema = "doc_id bigint, item_id bigint, similarity double, first_word bigint, end_word bigint"
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for part in blocks(benchmark):
        found = rows.mapInArrow(scan(spark.sparkContext.broadcast(Index(part))), schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def remove_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no benchmark item was found, by their text alone; all columns stay."""

    def judge(shared):
        def make():
            index, hashes = shared.value, WordHashes()

            def clean(text: str) -> bool:
                words = WORDS.findall(text.lower())
                return len(words) < SHINGLE or not search(words, index, hashes)

            return clean

        return make

    for part in blocks(benchmark):
        docs = keep_rows(docs, judge(docs.sparkSession.sparkContext.broadcast(Index(part))))
    return docs
