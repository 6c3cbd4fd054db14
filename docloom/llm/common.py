"""Helpers that the corpus operators share: shared storage, hashing, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.shared import new_path, write_shared  # noqa: F401  the operators take them from here

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Texts handled at once inside a Python task: this many characters or one text, whichever is more.
SLICE_CHARS = 4_000_000
#: Bytes of an Arrow batch on its way to a Python worker: this many or one row, whichever is more.
BATCH_BYTES = 4_000_000


def text_key(col) -> F.Column:
    """16 bytes that stand for a text; null counts as the empty text."""
    return F.unhex(F.md5(F.encode(F.coalesce(col, F.lit("")), "UTF-8")))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(col, n: int) -> F.Column:
    """crc32 of a value's decimal text, modulo n; a null value gives 0."""
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n)), F.lit(0).cast("long"))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met last; the table is emptied when it is full."""

    def __init__(self, most: int = 150_000):
        import xxhash

        super().__init__()
        self.most, self.of = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.of(word)
        return h

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; of all words together where there are fewer than k (none: none)."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out + np.uint64(k))


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows that hold SLICE_CHARS bytes or one row."""
    if not len(column):
        return
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > SLICE_CHARS:
            yield begin, i
            begin, total = i, 0
        total += int(n)
    yield begin, len(column)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold at most BATCH_BYTES; a smaller setting of the caller stays.

    Spark's own limit of 64 MB lets 10,000 texts into a batch, which executor and worker each hold more than once. Plans read the
    setting when they run, so it has to outlive the function that makes a lazy table."""
    key, unit = "spark.sql.execution.arrow.maxBytesPerBatch", spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    now = unit.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def keep_rows(docs: DataFrame, judge: Callable[[], Callable[[str], bool]]) -> DataFrame:
    """The rows whose text (null: empty) is good to the function that judge() makes in each task; all columns stay, whatever their names."""
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = judge()
        for batch in batches:
            texts, keep = batch.column(at), []
            for lo, hi in slices(texts):
                keep += [good(t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


#: A sieve's size is fixed: 4 MB. Beyond a few million keys it lets more and more rows through, none is lost.
SIEVE_PARTS, SIEVE_BITS = 64, 1 << 19


def _sieve_at(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part (the top six bits) and places in it of hashed keys."""
    x = keys.view(np.uint64)
    y = mix(x)
    return (x >> np.uint64(58)).astype(np.int64), np.stack([y & np.uint64(SIEVE_BITS - 1), (y >> np.uint64(19)) & np.uint64(SIEVE_BITS - 1)]).astype(np.int64)


def _sieve_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        part, at = _sieve_at(batch.column("key").to_numpy())
        for p in np.unique(part).tolist():
            held.setdefault(p, np.zeros(SIEVE_BITS, bool))[at[:, part == p].ravel()] = True
    for p, bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])


def sift(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows by a Bloom filter of keys (one bigint column): those that may have a match, and those that have none.

    The rows without a match then need no shuffle for a join with keys.
    """
    only = keys.where(F.col(keys.columns[0]).isNotNull()).select(F.xxhash64(keys.columns[0]).alias("key")).distinct()
    bits = np.zeros((SIEVE_PARTS, SIEVE_BITS // 8), np.uint8)
    dealt = only.repartition(SIEVE_PARTS, F.shiftrightunsigned("key", 58))  # a part comes from one task: the sieve is all that is collected
    for r in dealt.mapInArrow(_sieve_parts, "part int, bits binary").collect():
        bits[r.part] |= np.frombuffer(r.bits, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(k: pd.Series) -> pd.Series:
        part, at = _sieve_at(k.to_numpy(np.int64, na_value=0))
        found = shared.value[part, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
        return pd.Series(found.all(axis=0).astype(bool))

    some = maybe(F.xxhash64(F.coalesce(F.col(key), F.lit(0).cast("long"))))
    return rows.where(some), rows.where(~some)
