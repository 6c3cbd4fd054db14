"""Removal of repeated passages by content-defined chunks of lines.

From every line runs a chunk to its fortieth word, to the end of that line, and to every line runs the shortest chunk
of forty words or more; so boundaries move with the text and not with its place in the document. Any passage of
whole lines with forty words or more is the union of such chunks inside it, however its words are dealt over lines, so
that each of its copies has the same chunks. A chunk's hash comes from a rolling hash over the hashes of lines, in one
step for a chunk of any length. A chunk that occurs at two or more places of the corpus is
repeated: its occurrence with the smallest (doc_id, line) stays and the others go, line by line, once the
bytes of the lines have been compared with those that stay.

Defined results: null and empty texts come back as they are; a document of which nothing but white space
is left comes back with the empty text. Rows that share doc_id and text count as one row and get one result;
a null doc_id is an id like others and comes first. Further columns are passed through; one that bears the name of a result
makes the caller choose another name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import mix, sift, slices, unused, write_shared

MIN_WORDS = 40
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def line_hashes(lines: list[str]) -> np.ndarray:
    import xxhash

    of = xxhash.xxh3_64_intdigest
    return np.fromiter((of(x) for x in lines), np.uint64, len(lines))


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base, modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def chunks(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first line and last line of every chunk of a document's lines."""
    n = len(lines)
    h = line_hashes(lines)
    words = np.concatenate([[0], np.cumsum([len(x.split()) for x in lines])])
    line = np.arange(n)
    last = np.searchsorted(words, words[:-1] + MIN_WORDS) - 1  # the line with the fortieth word from here
    first = np.searchsorted(words, words[1:] - MIN_WORDS, "right") - 1  # the last line from which there are forty words to here
    s, e = np.concatenate([line[last < n], first[first >= 0]]), np.concatenate([last[last < n], line[first >= 0]])
    se = np.unique(s * np.int64(n) + e)
    s, e = se // n, se % n
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(_BASE, n), dtype=np.uint64)])
        value = (sums[e + 1] - sums[s]) * powers(_INVERSE, n)[s]
        return mix(value + (e - s).astype(np.uint64)), s, e


def emit_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in slices(texts):
            found = [chunks(t.split("\n")) for t in texts.slice(lo, hi - lo).to_pylist()]
            n = np.array([len(x[0]) for x in found])
            take = pa.array(np.repeat(np.arange(lo, hi), n))
            cat = [np.concatenate([x[i] for x in found]) if len(found) else np.empty(0) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cat[0].view(np.int64)), batch.column("doc_id").take(take), batch.column("tid").take(take), pa.array(cat[1].astype(np.int32)), pa.array(cat[2].astype(np.int32))],
                ["h", "doc_id", "tid", "s", "e"],
            )


def max_key(ascending: dict[int, object]) -> int:
    """The last key of a dict with ascending keys; -1 if it is empty."""
    return next(reversed(ascending), -1)


def emit_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that may go, with the place that keeps their like, and lines that stay, from texts with what is asked of them."""
    for batch in batches:
        rows = []
        for doc, tid, text, gone, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tid", "text", "gone", "asked")), strict=True):
            lines = text.split("\n")
            like: dict[int, tuple] = {}
            for r in sorted(gone or (), key=lambda r: (r["s"], r["e"])):  # a line's like is that in the first chunk with it
                for i in range(max(r["s"], max_key(like) + 1), r["e"] + 1):
                    like[i] = (r["keep"]["doc_id"], r["keep"]["tid"], r["keep"]["s"] + i - r["s"])
            rows += [(doc, tid, i, lines[i].encode(), True, *to) for i, to in like.items()]
            stay: dict[int, None] = {}
            for r in sorted(asked or (), key=lambda r: (r["s"], r["e"])):
                stay.update(dict.fromkeys(range(max(r["s"], max_key(stay) + 1), r["e"] + 1)))
            rows += [(doc, tid, i, lines[i].encode(), False, None, None, None) for i in stay]
        for k in range(0, max(len(rows), 1), 5000):
            part = list(zip(*rows[k : k + 5000], strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, kinds, strict=True)], ["doc_id", "tid", "line", "bytes", "gone", "k_doc", "k_tid", "k_line"])


def same(x: str, y: str) -> F.Column:
    return F.expr(f"{x}.doc_id <=> {y}.doc_id and {x}.tid = {y}.tid")


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, tid (hash of the text), lines (numbers of the lines that go, from 0), for documents that lose any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and text <> ''")
    rows = rows.withColumn("tid", F.xxhash64("text"))
    each = write_shared(rows.select("doc_id", "tid", "text").mapInArrow(emit_chunks, "h bigint, doc_id bigint, tid bigint, s int, e int"), "chunks", waves=4)
    place = F.struct("doc_id", "tid", "s")
    kept = each.groupBy("h").agg(F.min(place).alias("keep"), F.max(place).alias("other")).where("not keep <=> other").select("h", "keep")
    found = write_shared(each.join(kept, "h").select("doc_id", "tid", "s", "e", "keep"), "repeated", waves=1)
    first = F.expr("keep.doc_id <=> doc_id and keep.tid = tid and keep.s = s")
    gone = found.where(~first).groupBy("doc_id", "tid").agg(F.collect_set(F.struct("s", "e", "keep")).alias("gone"))
    stay = found.where(first).groupBy("doc_id", "tid").agg(F.collect_set(F.struct("s", "e")).alias("asked"))
    g, a = gone.alias("g"), stay.alias("a")
    asked = g.join(a, same("g", "a"), "full_outer").select(F.coalesce("g.doc_id", "a.doc_id").alias("doc_id"), F.coalesce("g.tid", "a.tid").alias("tid"), "gone", "asked")
    asked = write_shared(asked, "asked", waves=1)
    near, _ = sift(rows, "tid", asked.select("tid"))
    texts = near.dropDuplicates(["doc_id", "tid"]) if has_repeats(rows.select("doc_id", "tid")) else near
    d, w = texts.alias("d"), asked.alias("w")
    lines = d.join(w, same("d", "w")).select("d.doc_id", "d.tid", "d.text", "w.gone", "w.asked")
    lines = write_shared(
        lines.mapInArrow(emit_lines, "doc_id bigint, tid bigint, line int, bytes binary, gone boolean, k_doc bigint, k_tid bigint, k_line int"), "lines", waves=4
    )
    x, y = lines.where("gone").alias("x"), lines.where("not gone").alias("y")
    equal = x.join(y, F.expr("x.k_doc <=> y.doc_id and x.k_tid = y.tid and x.k_line = y.line and x.bytes = y.bytes")).select("x.doc_id", "x.tid", "x.line")
    return equal.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def has_repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("doc_id", "tid").count().where("count > 1").isEmpty()


def clean(docs: DataFrame, text: str = "clean", count: str = "removed_lines") -> DataFrame:
    """All rows of docs with two columns more: the text without repeated passages, and how many lines went."""
    if {text.lower(), count.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {text} or {count}; choose other names")
    gone = write_shared(removed_lines(docs), "removed", waves=1)
    tid = unused(docs, "tid")
    some, rest = sift(docs.withColumn(tid, F.xxhash64("text")), tid, gone.select("tid"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    d = some.select(F.struct(*own).alias("row"), F.col(tid).alias("tid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).alias("d")
    g = gone.alias("g")
    both = d.join(g, same("d", "g"), "left")
    # the lines that stay, joined again; filter() passes the number of each line
    kept = F.expr("array_join(filter(split(d.text, '\\n', -1), (x, i) -> not array_contains(g.lines, i)), '\\n')")
    left = F.when(F.col("g.lines").isNull(), F.col("d.text")).otherwise(kept)
    left = F.when(F.col("g.lines").isNotNull() & ~left.rlike(r"\S"), F.lit("")).otherwise(left)
    changed = both.select("d.row.*", left.alias(text), F.coalesce(F.size("g.lines"), F.lit(0)).alias(count))
    return changed.union(rest.select(*own, F.col("text").alias(text), F.lit(0).alias(count)))
