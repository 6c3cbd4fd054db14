"""Language-model scores from a log-frequency Bloom filter.

Word-pair counts over all training texts are quantised to powers of two; a pair of level q stands in the filter q times,
once for each level up to its own, and its count is found by probing level after level until one is missing. The
filter is made of parts, one for each group of pairs (the top bits of a pair's hash), with FILL bits for each level of the
pairs in it: nothing is left out, and the filter and its number of parts grow with the corpus.

A pair's probability is (c(v, w) + K p(w)) / (c(v) + K), with p(w) = (c(w) + 1) / (N + V + 1) from exact counts of words;
before a text's first word stands its start, which is counted once for each training text.

Texts are cut into slices. A slice sends each group the distinct words and pairs that it has there, with their numbers in
training texts, in one shuffle; the group adds the numbers up, makes its part of the filter, and sends each slice the counts
of its words back. While the whole filter has no more than BITS bits, it is broadcast and the scorers probe it; a larger
filter stays in its parts, and the groups send back the levels that they probe. Both give the same scores.

Defined results: null and empty texts have one token, the end; rows repeat as they come; a null doc_id is a
training row with remainder 0. With no training tokens all counts are 0. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WordHashes, crc_mod, mix, slices, write_shared

#: Bits of a filter that is broadcast: 32 MB.
BITS = 1 << 28
PROBES, FILL, LEVELS, K = 5, 10, 62, 1000.0
#: Bytes of text for each group, and the least number of groups.
GROUP_BYTES, GROUPS = 8 << 20, 16
#: Bytes of a text that are split into words at once.
PIECE = 4 << 20
#: The end of a text and its start stand beside the hashes of words.
END, START = np.uint64(0x27D4EB2F165667C5), np.uint64(0x5851F42D4C957F2D)
WORD, PAIR, TEXT = 0, 1, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ZSTD = pa.Codec("zstd")
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def plain(text: str | None) -> bytes:
    """A text's bytes in lower case (A-Z only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces, which bounds the memory for very long ones."""
    at = 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        yield raw[at:end].split()
        at = end


def hashed(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each with its end, and how many each text has."""
    out, n = [np.empty(0, np.uint64)], []
    for raw in texts:
        parts = [hashes.array(w) for w in words(raw)]
        out += [*parts, np.array([END])]
        n.append(sum(map(len, parts)) + 1)
    return np.concatenate(out), np.array(n, np.int64)


def befores(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each token: START at the start of a text."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[np.cumsum(n) - n] = START
    return out


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """56-bit hashes of pairs, in the upper bits: fewer of them meet than the filter errs."""
    with np.errstate(over="ignore"):
        return mix(before * _STEP + word) & np.uint64(0xFFFFFFFFFFFFFF00)


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """The group of a key: its top bits; groups is a power of two."""
    bits = groups.bit_length() - 1
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def positions(keys: np.ndarray, level: int, size) -> np.ndarray:
    """PROBES places in the key's part of the filter, a row for each; size: bits of the part, or of each key's part."""
    with np.errstate(over="ignore"):
        x = mix(keys + np.uint64(level) * _STEP)
    low, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    size = np.asarray(size, np.uint64)
    return np.stack([(((low + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * size >> np.uint64(32)).astype(np.int64) for i in range(PROBES)])


def part(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of a part that holds all these pairs."""
    level = np.minimum(np.floor(np.log2(counts)).astype(int) + 1, LEVELS)
    bits = np.zeros(max(64, -(-int(level.sum()) * FILL // 8) * 8), bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        bits[positions(keys[level >= j], j, len(bits))] = True
    return np.packbits(bits)


def levels(keys: np.ndarray, bits: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Levels of keys whose parts start at, and have, so many bits, by probes of level after level."""
    level = np.zeros(len(keys), np.int64)
    left = np.flatnonzero(size > 0)
    for j in range(1, LEVELS + 1):
        at = positions(keys[left], j, size[left]) + start[left]
        left = left[((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)]
        if not len(left):
            break
        level[left] = j
    return level


def count_of(level: np.ndarray) -> np.ndarray:
    """The count that stands for a level."""
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, 2.0**level / np.sqrt(2)))


def squeeze(raw: bytes) -> bytes:
    """Bytes, compressed if there are enough of them, after their number."""
    return len(raw).to_bytes(4, "little") + (_ZSTD.compress(raw, asbytes=True) if len(raw) > 256 else raw)


def loosen(held: bytes) -> bytes:
    n = int.from_bytes(held[:4], "little")
    return _ZSTD.decompress(held[4:], n, asbytes=True) if n > 256 else held[4:]


def narrow(x: np.ndarray) -> bytes:
    """Counts as bytes: all of the least size that holds them, after that size."""
    size = next(s for s in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * s)
    return bytes([size]) + squeeze(x.astype(f"<u{size}").tobytes())


def widened(held: bytes) -> np.ndarray:
    return np.frombuffer(loosen(held[1:]), f"<u{held[0]}").astype(np.int64)


def steps(keys: np.ndarray) -> bytes:
    """Ascending keys as bytes: their differences, first all lowest bytes, then all next ones."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unstepped(held: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(loosen(held), np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


SLICED = "slice bigint, doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, bytes bigint, texts binary"


def slice_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, held_out and text as slices, each a row with its texts in one compressed value."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 33
    names = [x.split()[0] for x in SLICED.split(", ")]
    for batch in batches:
        for lo, hi in slices(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            raw = [plain(t) for t in part.column("text").to_pylist()]
            joined = b"".join(raw)
            ends = pa.array([0, hi - lo], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (part.column("doc_id"), part.column("held_out"), pa.array(map(len, raw), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *lists, pa.array([len(joined)], pa.int64()), pa.array([_ZSTD.compress(joined, asbytes=True)], pa.binary())], names)
            at += 1


def texts_of(row: dict) -> list[bytes]:
    """The texts of a slice."""
    joined, out, at = _ZSTD.decompress(row["texts"], row["bytes"], asbytes=True) if row["bytes"] else b"", [], 0
    for n in row["sizes"]:
        out.append(joined[at : at + n])
        at += n
    return out


ASKED = "kind int, grp bigint, slice bigint, keys binary, times binary"


def ask(groups: int):
    """For each slice, kind and group: the distinct words or pairs, in order, and how often training texts have them."""
    names = [x.split()[0] for x in ASKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                h, n = hashed(texts_of(row), hashes)
                train = np.repeat(~np.array(row["held"], bool), n)
                for kind, keys in ((WORD, h), (PAIR, pair_keys(befores(h, n), h))):
                    keys, at = np.unique(keys, return_inverse=True)
                    times = np.bincount(at[train], minlength=len(keys))
                    group = group_of(keys, groups)
                    ends = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(keys))
                    bounds = list(zip(ends.tolist(), ends[1:].tolist(), strict=False))
                    many = len(bounds)
                    columns = [pa.array([kind] * many, pa.int32()), pa.array(group[ends[:-1]]), pa.array([row["slice"]] * many, pa.int64())]
                    columns += [pa.array([steps(keys[a:b]) for a, b in bounds], pa.binary()), pa.array([narrow(times[a:b]) for a, b in bounds], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


ANSWERED = "kind int, grp bigint, slice bigint, found binary, total bigint, types bigint, bits binary"


def answer(table: pa.Table) -> pa.Table:
    """Of one kind and group: each slice's counts of words or levels of pairs, and a row without a slice: training tokens, types, and the part of the filter."""
    kind, group = table.column("kind")[0].as_py(), table.column("grp")[0].as_py()
    each = [unstepped(x) for x in table.column("keys").to_pylist()]
    keys, at = np.unique(np.concatenate(each), return_inverse=True)
    times = np.concatenate([widened(x) for x in table.column("times").to_pylist()])
    count = np.bincount(at, weights=times, minlength=len(keys)).astype(np.int64)
    known, bits = count > 0, None
    found = count
    if kind == PAIR:
        bits = part(keys[known], count[known])
        found = levels(keys, bits, np.zeros(len(keys), np.int64), np.full(len(keys), 8 * len(bits)))
    ends = np.cumsum([0, *map(len, each)]).tolist()
    out = [narrow(found[at[a:b]]) for a, b in zip(ends, ends[1:], strict=False)]
    n = len(out)
    columns = [pa.array([kind] * (n + 1), pa.int32()), pa.array([group] * (n + 1), pa.int64()), pa.array([*table.column("slice").to_pylist(), None], pa.int64()), pa.array([*out, None], pa.binary())]
    sums = [pa.array([None] * n + [int(x.sum())], pa.int64()) for x in (count, known)]
    return pa.table(columns + sums + [pa.array([None] * n + [None if bits is None else bits.tobytes()], pa.binary())], [x.split()[0] for x in ANSWERED.split(", ")])


class Model:
    """Training tokens, types and, where it is broadcast, the filter: its parts one after the other."""

    def __init__(self, total: int, types: int, groups: int, parts: Iterable[tuple[int, bytes]] | None = None, k: float = K):
        self.total, self.types, self.groups, self.k, self.bits = total, types, groups, k, None
        if parts is not None:
            self.start, self.size, held, at = np.zeros(groups, np.int64), np.zeros(groups, np.int64), [], 0
            for group, bits in parts:
                self.start[group], self.size[group] = at, 8 * len(bits)
                at += 8 * len(bits)
                held.append(bits)
            self.bits = np.frombuffer(b"".join(held), np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of pairs, by probes of the filter."""
        group = group_of(keys, self.groups)
        return levels(keys, self.bits, self.start[group], self.size[group])

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts of pairs, from the filter."""
        return count_of(self.levels(keys))

    def lone(self, count: np.ndarray) -> np.ndarray:
        """Logarithm of p(w)."""
        return np.log10((count + 1) / (self.total + self.types + 1.0))

    def pair_scores(self, pair: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of words from the counts of the pair, of the word before and of the word."""
        p = (count + 1.0) / (self.total + self.types + 1.0)
        return np.log10((np.minimum(pair, before) + self.k * p) / (before + self.k))


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"


def scorer(shared):
    """Scores of the texts of slices, each of which comes after its answers."""
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes = shared.value, WordHashes()
        found: dict[int, list[np.ndarray]] = {WORD: [], PAIR: []}
        for batch in batches:
            for kind, value, i in zip(batch.column("kind").to_pylist(), batch.column("found").to_pylist(), range(len(batch)), strict=True):
                if kind != TEXT:
                    found[kind].append(widened(value))
                    continue
                row = batch.slice(i, 1).to_pylist()[0]
                h, n = hashed(texts_of(row), hashes)
                _, at = np.unique(h, return_inverse=True)
                count = np.concatenate(found[WORD])[at]
                before = befores(h, n)
                first = before == START
                # a training text has one end, so that the starts are as many as the ends
                c_before = np.where(first, count[np.cumsum(n)[0] - 1], np.concatenate([[0], count[:-1]]))
                keys, at = np.unique(pair_keys(before, h), return_inverse=True)
                level = np.concatenate(found[PAIR]) if model.bits is None else model.levels(keys)
                score = model.pair_scores(count_of(level)[at], c_before.astype(float), count)
                doc = np.repeat(np.arange(len(n)), n)
                total = lambda x: np.bincount(doc, weights=x, minlength=len(n))  # noqa: B023, E731
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(n), pa.array(total(count > 0).astype(np.int64)), pa.array(total(model.lone(count))), pa.array(total(score))]
                yield pa.RecordBatch.from_arrays(columns, names)
                found = {WORD: [], PAIR: []}

    return run


def learn(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of rows of doc_id, held_out and text: the table of slices, that of the answers, and the number of groups."""
    sliced = write_shared(rows.select("doc_id", "held_out", "text").mapInArrow(slice_up, SLICED), "slices", "none")
    size = sliced.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    groups = max(GROUPS, 1 << (int(size) // GROUP_BYTES).bit_length())
    asked = sliced.mapInArrow(ask(groups), ASKED)
    return sliced, write_shared(asked.groupBy("kind", "grp").applyInArrow(answer, ANSWERED), "answers", "zstd"), groups


def model_of(answers: DataFrame, groups: int, k: float = K) -> Model:
    """The model, with its filter where that has no more than BITS bits."""
    sums = answers.where("slice is null").groupBy("kind").agg(F.sum("total").alias("total"), F.sum("types").alias("types"), F.sum(8 * F.octet_length("bits")).alias("bits"))
    by = {r.kind: r for r in sums.collect()}
    total, types, bits = (by[WORD].total, by[WORD].types, by[PAIR].bits) if by else (0, 0, 0)
    parts = answers.where(f"slice is null and kind = {PAIR}").select("grp", "bits")
    return Model(total, types, groups, ((r.grp, r.bits) for r in parts.collect()) if bits <= BITS else None, k)


def train(texts: DataFrame, k: float = K) -> Model:
    """The model of a table with the column text; its filter is there if it has no more than BITS bits."""
    _, answers, groups = learn(texts.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text"))
    return model_of(answers, groups, k)


def scores(docs: DataFrame, folds: int = 7, held: int = 2, k: float = K) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row, learning from rows not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"))
    sliced, answers, groups = learn(rows)
    model = model_of(answers, groups, k)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    needed = answers.where("slice is not null" if model.bits is None else f"slice is not null and kind = {WORD}").select("kind", "grp", "slice", "found")
    both = needed.unionByName(sliced.withColumn("kind", F.lit(TEXT)), allowMissingColumns=True)
    both = both.repartition("slice").sortWithinPartitions("slice", "kind", "grp")
    total = F.lit(model.total).cast("long").alias("train_tokens")
    return both.mapInArrow(scorer(shared), SCORED).select("doc_id", "held_out", "n_tokens", "n_known", total, F.col("base").alias("base_score"), "score")
