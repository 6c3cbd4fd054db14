"""Packing of tokenised documents into sequences by bounded-space online best fit.

A document is its byte-level BPE ids and then id 0; what is longer than a sequence is cut, with the odd
piece first. Pieces arrive in the order of doc_id and go, one by one, into the open bin with the least free
space that still takes them. The open bins stand in a bitset keyed by free space, so the search is one
shift and one isolation of the lowest bit. At most OPEN bins are open; of more, the fullest closes first.

The ids come from tiktoken over the vocabulary's rank file; they equal those of the tokenizers library
and its JSON file with add_special_tokens=False, in under half the time (tests compare the two).

Pieces are packed by about one task for each PACK_BYTES of input, dealt out by doc_id and sorted, so a
task that is run again packs alike. Defined results: null and empty texts are one piece of length 1;
a null doc_id is an id like others; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import slices

LENGTH, OPEN, PACK_BYTES = 2048, 2048, 256 << 20
END = "<|endoftext|>"
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def encoder(path: str | None = None):
    """Function from a text to its ids. path: the vocabulary's rank file; the public one by default."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("docloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})
    return lambda text: coder.encode(text, allowed_special={END}) if END in text else coder.encode_ordinary(text)


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: all of full length but the first."""
    first = n - (math.ceil(n / length) - 1) * length
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def pieces(length: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                rows = []
                for doc, text in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), 0], "<u4")
                    rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), length))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Packer:
    """Open bins of one task. put() gives the bin and the place in it of a piece."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most, self.bits, self.open, self.made = length, most, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n << n
        if fits:
            free = (fits & -fits).bit_length() - 1
            k = self._take(free)
        else:
            free, k = self.length, self.made
            self.made += 1
        left = free - n
        if left:
            self.bins[left].append(k)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return k, self.length - free

    def _take(self, free: int) -> int:
        k = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return k


def packed(length: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, packer = TaskContext.get().partitionId(), Packer(length, most)
        for batch in batches:
            at = [packer.put(n) for n in batch.column("length").to_pylist()]
            ids = pa.array([(task << 40) + k for k, _ in at], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array([o for _, o in at], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, length: int = LENGTH, most: int = OPEN, path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # Spark takes a size that it cannot know for the largest number
    tasks = max(1, math.ceil(size / PACK_BYTES)) if known else docs.sparkSession.sparkContext.defaultParallelism
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces(length, path), PIECES)
    found = found.repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "start", "length", "ids_crc32")
    return found.mapInArrow(packed(length, most), f"{PIECES}, sequence_id bigint, offset bigint")
