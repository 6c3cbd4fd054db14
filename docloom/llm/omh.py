"""Near-duplicate classes by Order MinHash.

Each text is a sequence of five-word shingles over its lower-cased words. A sketch takes the two shingles
whose occurrence-labelled hashes are smallest and keeps them in text order, so that its collisions follow
edit similarity rather than set overlap. Two sketches make a band, sixteen bands a document.

Texts that share a band are candidates. A candidate is verified by banded alignment of its shingle
sequence: with c shingles in the longest common subsequence, c / (n + m - c) has to reach 0.8. That
leaves at most (n + m) / 9 insertions and deletions, which is the width of the band, so the band loses nothing.

Classes are the components of the verified links between different texts. Within a bucket the members are
first aligned with its smallest and its largest member. After the components of those links are known, the
buckets with more than one component are gone through again: the members outside the bucket's largest component ask
all members of other components, and where the count of common labelled shingles allows 0.8 they are aligned, until they
are linked. Askers and asked are cut into blocks of BLOCK shingles and MEMBERS texts, and each pair of blocks is a
task of its own; no pairs of texts are shuffled and nothing is capped.

Defined results: equal texts are always one class; null counts as the empty text; texts without words
form classes only with their exact copies, and rows that have no text at all stay alone (class_id is their
own doc_id). Rows with a null doc_id get the class of their text; its class_id is the smallest doc_id
that is not null. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WordHashes, mix, shingles, sift, slices, text_key, unused, write_shared
from docloom.llm.components import components

WORDS = re.compile(r"\w+")
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 2
#: Shingles from which the sketches of a text are made one by one, which bounds their memory.
LONG = 10_000
#: Shingles and texts of a block of a bucket.
BLOCK, MEMBERS = 200_000, 400
#: A shingle in so many pairs of members is counted by a product of matrices, any other pair by pair, PAIRS at once.
COMMON, PAIRS = 1024, 250_000
#: Places of a shingle in a text from which they are held as one number.
MANY = 64

_seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD = _seeds[::2], _seeds[1::2] | np.uint64(1)


def sequence(text: str, hashes: WordHashes) -> np.ndarray:
    """Hashes of a text's five-word shingles, in order."""
    return shingles(hashes.array(WORDS.findall(text.lower())), SHINGLE)


def labelled(seq: np.ndarray) -> np.ndarray:
    """Each k-mer's hash with the number of its occurrence."""
    order = np.argsort(seq, kind="stable")
    s = seq[order]
    new = np.empty(len(s), bool)
    new[:1], new[1:] = True, s[1:] != s[:-1]
    if new.all():
        return seq
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(seq + nth * np.uint64(0xD6E8FEB86659FD93))


def bands(seq: np.ndarray) -> np.ndarray:
    """The band keys of a sequence of at least one shingle."""
    lab = labelled(seq)
    codes = np.empty(BANDS * ROWS, np.uint64)
    step = len(_XOR) if len(lab) < LONG else 1
    with np.errstate(over="ignore"):
        for k in range(0, len(_XOR), step):
            v = (lab[None, :] ^ _XOR[k : k + step, None]) * _ODD[k : k + step, None]
            rows = np.arange(len(v))
            i = v.argmin(axis=1)
            v[rows, i] = np.uint64(0xFFFFFFFFFFFFFFFF)
            j = v.argmin(axis=1) if len(lab) > 1 else i
            codes[k : k + step] = mix(lab[np.minimum(i, j)] * np.uint64(3) + mix(lab[np.maximum(i, j)]))
        pair = codes.reshape(BANDS, ROWS)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + pair[:, r])
    return keys


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in slices(texts):
            n, keys = [], []
            for text in texts.slice(lo, hi - lo).to_pylist():
                seq = sequence(text or "", hashes)
                n.append(len(seq))
                keys.append(bands(seq).view(np.int64) if len(seq) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("tid").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["tid", "n", "keys"]
            )


def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in slices(texts):
            seqs = [sequence(t or "", hashes).astype(np.uint32).tobytes() for t in texts.slice(lo, hi - lo).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tid").slice(lo, hi - lo), pa.array(seqs, pa.binary())], ["tid", "seq"])


def run_of(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many elements of a from i and of b from j on are equal."""
    total, step = 0, 32
    while (n := min(step, len(a) - i - total, len(b) - j - total)) > 0:
        apart = a[i + total : i + total + n] != b[j + total : j + total + n]
        k = int(apart.argmax())
        if apart[k]:
            return total + k
        total += n
        step = min(8 * step, 1 << 18)
    return total


def common_few(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Length of the longest common subsequence if most insertions and deletions do, else None: furthest places by diagonal."""
    n, m = len(a), len(b)
    reach = {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or k != d and reach[k - 1] < reach[k + 1] else reach[k - 1] + 1
            if i <= n and 0 <= i - k <= m:
                i += run_of(a, b, i, i - k)
            if i >= n and i - k >= m:
                return (n + m - d) // 2
            reach[k] = i
    return None


def common_banded(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """Length of the longest common subsequence of a and b among alignments that stay within width of the diagonal.

    Few edits are found by diagonals. For more, the row of the alignment table is one integer, a bit for each place of b, so
    that a step costs a few operations on machine words.
    """
    m = min(len(a), len(b))
    if not m:
        return 0
    apart = np.flatnonzero(a[:m] != b[:m])
    if not len(apart):
        return m
    head = int(apart[0])
    a, b = a[head:], b[head:]
    m = min(len(a), len(b))
    apart = np.flatnonzero(a[::-1][:m] != b[::-1][:m])
    tail = int(apart[0]) if len(apart) else m
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    few = common_few(a, b, min(width, max(8, int(0.017 * (len(a) * len(b)) ** 0.5))))  # costs no more than the table would
    if few is not None:
        return head + tail + few
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        where.setdefault(x, []).append(j)
    masks: dict[int, int] = {}  # of shingles with many places
    full = (1 << len(b)) - 1
    row, window = full, (1 << (2 * width + 1)) - 1
    for i, x in enumerate(a.tolist()):
        places, hit = where.get(x, ()), 0
        if len(places) > MANY:
            if x not in masks:
                bits = np.zeros(len(b), bool)
                bits[places] = True
                masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            hit = masks[x] & (window << (i - width) if i >= width else window >> (width - i))
        else:
            for j in places:
                if abs(j - i) <= width:
                    hit |= 1 << j
        if hit:
            u = row & hit
            row = (row + u | row - u) & full
    return head + tail + len(b) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """c / (n + m - c) of two shingle sequences if it reaches least, else some lower value."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = least * (n + m) / (1 + least)
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    shared = int(np.minimum(ca[i], cb[j]).sum())
    if shared < need - 1e-9:
        return shared / (n + m - shared)
    c = common_banded(a, b, int((n + m) - 2 * need + 1e-9) + 1)
    return c / (n + m - c)


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [
            similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= SIMILARITY
            for x, y in zip(batch.column("seq_a").to_pylist(), batch.column("seq_b").to_pylist(), strict=True)
        ]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles each of x has in common with each of y."""
    nx, ny = len(x), len(y)
    ids, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    cut = sum(map(len, x))
    owner = np.concatenate([np.repeat(np.arange(nx), [len(v) for v in x]), np.repeat(np.arange(ny), [len(v) for v in y])]).astype(np.int32)
    bx, by = np.bincount(at[:cut], minlength=len(ids)), np.bincount(at[cut:], minlength=len(ids))
    out = np.zeros(nx * ny, np.int32)
    light = (bx > 0) & (by > 0) & (bx * by <= COMMON)
    order = np.argsort(at[cut:], kind="stable")
    members, first = owner[cut:][order], np.cumsum(by) - by
    asks = np.flatnonzero(light[at[:cut]])
    many = by[at[asks]]
    ends = np.cumsum(many)
    lo = 0
    while lo < len(asks):  # so many pairs at once
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        n, e = many[lo:hi], asks[lo:hi]
        step = np.arange(int(n.sum()), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
        pair = np.repeat(owner[e] * np.int32(ny), n) + members[np.repeat(first[at[e]].astype(np.int32), n) + step]
        ids_, times = np.unique(pair, return_counts=True)
        out[ids_] += times.astype(np.int32)
        lo = hi
    out = out.reshape(nx, ny)
    heavy = np.flatnonzero((bx > 0) & (by > 0) & ~light)
    place = np.full(len(ids), -1)
    for k in range(0, len(heavy), 1024):
        place[:] = -1
        place[heavy[k : k + 1024]] = np.arange(len(heavy[k : k + 1024]))
        p = np.zeros((nx, 1024), np.float32)
        q = np.zeros((ny, 1024), np.float32)
        for table, part in ((p, slice(None, cut)), (q, slice(cut, None))):
            here = np.flatnonzero(place[at[part]] >= 0)
            table[owner[part][here], place[at[part]][here]] = 1
        out += (p @ q.T).astype(np.int32)
    return out


def cross_links(table: pa.Table) -> pa.Table:
    """Links between the askers and the asked of one bucket, or of a pair of its blocks, that are in different components."""
    asks = np.array(table.column("asks").to_pylist(), bool)
    tids, comps, seqs = (np.array(table.column(c).to_pylist(), object) for c in ("tid", "comp", "seq"))
    order = np.argsort(tids, kind="stable")
    x, y = order[asks[order]], order[~asks[order]]
    out = []
    if len(x) and len(y):
        seqs = [np.frombuffer(v, np.uint32) for v in seqs]
        lab = [labelled(v.astype(np.uint64)) for v in seqs]
        n = np.array([len(v) for v in seqs])
        need = SIMILARITY * (n[x][:, None] + n[y][None, :]) / (1 + SIMILARITY)
        group = {c: c for c in comps}

        def top(c):
            while group[c] != c:
                group[c] = group[group[c]]
                c = group[c]
            return c

        for i, j in zip(*np.nonzero(common_counts([lab[i] for i in x], [lab[j] for j in y]) >= need - 1e-3), strict=True):
            p, q = top(comps[x[i]]), top(comps[y[j]])
            if p != q and similarity(seqs[x[i]], seqs[y[j]]) >= SIMILARITY:
                group[max(p, q)] = min(p, q)
                out.append((tids[x[i]], tids[y[j]]))
    return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})


def linked(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of texts that alignment confirms. Only the joins deal out sequences; skewed sides are split by AQE."""
    both = pairs.join(seqs.select(F.col("tid").alias("b"), F.col("seq").alias("seq_b")), "b").join(
        seqs.select(F.col("tid").alias("a"), F.col("seq").alias("seq_a")), "a"
    )
    return both.select("a", "b", "seq_a", "seq_b").mapInArrow(verify, "a binary, b binary")


def classes(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, tid (key of the text), comp (smallest tid of its class)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", text_key(F.col("text")))
    each = write_shared(rows.select("tid", "text").mapInArrow(sketch, "tid binary, n bigint, keys array<bigint>"), "omh-sketches", waves=4)
    texts = each.groupBy("tid").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    buckets = write_shared(bucketed(texts.where("n > 0").select("tid", "n", F.explode("keys").alias("key"))), "omh-buckets", waves=1)
    first = buckets.where("tid <> low").select(F.col("low").alias("a"), F.col("tid").alias("b"))
    first = first.union(buckets.where("tid <> low and tid <> high").select(F.col("tid").alias("a"), F.col("high").alias("b")))
    first = first.distinct()
    wanted = buckets.select("tid").distinct()
    short = F.xxhash64("tid")
    near, _ = sift(rows.select("tid", "text", short.alias("short")), "short", wanted.select(short))
    seqs = near.select("tid", "text").dropDuplicates(["tid"]).join(wanted, "tid", "left_semi")  # copies meet in their task first
    seqs = write_shared(seqs.mapInArrow(sequences, "tid binary, seq binary"), "omh-sequences", waves=4)
    links = write_shared(linked(first, seqs), "omh-links", waves=4)
    comps = components(links)
    apart = buckets.join(comps, "tid", "left").select("key", "tid", "n", F.coalesce("comp", "tid").alias("comp"))
    parts = apart.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    main = F.max(F.struct("k", "n", "comp"))
    blocks = lambda k, n: F.greatest(F.ceil(n / BLOCK), F.ceil(k / MEMBERS), F.lit(1).cast("long"))
    mixed = parts.groupBy("key").agg(main.alias("main"), F.sum("k").alias("k"), F.sum("n").alias("n")).where("main.k < k")
    mixed = mixed.select("key", F.col("main.comp").alias("main"), blocks(F.col("k"), F.col("n")).alias("ys"), blocks(F.col("k") - F.col("main.k"), F.col("n") - F.col("main.n")).alias("xs"))
    apart = apart.join(write_shared(mixed, "omh-mixed", waves=1), "key")
    block = lambda n: F.pmod(F.xxhash64("tid"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = apart.select("key", block("ys").alias("y"), each("xs").alias("x"), F.lit(False).alias("asks"), "tid", "comp")
    askers = apart.where("comp <> main").select("key", each("ys").alias("y"), block("xs").alias("x"), F.lit(True).alias("asks"), "tid", "comp")
    dealt = asked.unionByName(askers).join(seqs, "tid")
    more = write_shared(dealt.groupBy("key", "x", "y").applyInArrow(cross_links, "a binary, b binary"), "omh-links", waves=4)
    if not more.isEmpty():
        comps = components(links.union(more))
    named = rows.select("doc_id", "tid").join(comps, "tid", "left")
    return named.select("doc_id", "tid", F.coalesce("comp", "tid").alias("comp"))


def bucketed(bands: DataFrame) -> DataFrame:
    """Members of the buckets that hold two texts or more, with the bucket's smallest and largest member."""
    ends = bands.groupBy("key").agg(F.min("tid").alias("low"), F.max("tid").alias("high")).where("low < high")
    return bands.join(write_shared(ends, "omh-ends", waves=1), "key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_rows (rows in the class), kept (this row's id is class_id)."""
    found = write_shared(classes(docs), "omh-classes", waves=1)
    empty = text_key(F.lit(""))
    found = found.withColumn("blank", F.col("tid") == empty)
    each = found.where("not blank").groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_rows"))
    each = write_shared(each, "omh-sizes", waves=1)  # so that the join can split a class with many rows
    out = found.where("not blank").join(each, "comp").select("doc_id", "class_id", "class_rows")
    alone = found.where("blank").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_rows"))
    return out.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each class the row with the smallest (doc_id, text key), once; null ids come last.

    Rows without text are in no class and all stay. Only rows that may go are shuffled."""
    found = classes(docs).where(F.col("tid") != text_key(F.lit(""))).groupBy("comp", "doc_id", "tid").agg(F.count(F.lit(1)).alias("copies"))
    found = write_shared(found.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")), "omh-found", waves=1)
    least = write_shared(found.groupBy("comp").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1"), "omh-least", waves=1)
    gone = found.join(least, "comp", "left").select("doc_id", "tid", "copies", F.coalesce(F.col("place") != F.col("least"), F.lit(False)).alias("goes"))
    touched = write_shared(gone.where("goes or copies > 1").select(F.col("doc_id").cast("long").alias("id"), "tid", "goes"), "omh-touched", waves=1)
    tid, key = unused(docs, "tid"), unused(docs, "key")
    rows = docs.withColumn(tid, text_key(F.col("text"))).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), tid))
    some, rest = sift(rows, key, touched.select(F.xxhash64("id", "tid")))
    d, t = some.alias("d"), touched.alias("t")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("t.id")) & (F.col(f"d.{tid}") == F.col("t.tid"))
    whole = [F.col(f"d.`{c}`") for c in docs.columns]
    kept = rest.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(d.join(t, same, "left_anti").select(*whole))
    twice = t.where("not goes")
    if not twice.isEmpty():  # repeated rows share id and text: one of them stays
        one = d.join(twice, same, "left_semi").select(*whole, F.col(f"d.{tid}")).dropDuplicates(["doc_id", tid])
        kept = kept.unionByName(one.select(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept
