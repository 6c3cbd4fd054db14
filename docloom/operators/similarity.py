"""Similarity of word sets and vectors, clusters and representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.shared import write_shared as shared_table


#: Vectors of a block and of a tile of the comparison of all pairs.
BLOCK, TILE = 20_000, 2000
#: Slots in which the hashes of words are counted, and parts in which they come to the driver.
SLOTS, PARTS = 1 << 24, 256


def word_sets(docs: DataFrame, longer_than: int = 3) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > longer_than))
    return docs.where("text is not null").select("doc_id", words.alias("words")).withColumn("n", F.size("words")).where("n > 0")


def keyed_sets(docs: DataFrame) -> DataFrame:
    """doc_id, key of the word set (equal sets, equal keys), its size n and the 32-bit hashes of its words."""
    sets = word_sets(docs).select("doc_id", "n", F.sort_array("words").alias("words"))
    hashes = F.transform("words", lambda w: F.hash(w))
    return shared_table(sets.select("doc_id", F.unhex(F.sha2(F.array_join("words", "\n"), 256)).alias("key"), "n", hashes.alias("tokens")))


def rarity(sets: DataFrame) -> bytes:
    """A class for each slot of hashes, by the logarithm of how often its hashes occur: SLOTS bytes, however many words there are."""
    slot = F.col("t").bitwiseAND(F.lit(SLOTS - 1))
    counts = sets.select(F.explode("tokens").alias("t")).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    size = SLOTS // PARTS

    def block(table):
        import numpy as np
        import pyarrow as pa

        out = np.zeros(size, np.uint8)
        out[table.column("slot").to_numpy() % size] = np.minimum(255, np.floor(8 * np.log2(table.column("n").to_numpy())))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "classes": pa.array([out.tobytes()], pa.binary())})

    made = counts.withColumn("part", F.floor(F.col("slot") / size).cast("int")).groupBy("part").applyInArrow(block, "part int, classes binary")
    found = {r["part"]: bytes(r["classes"]) for r in made.collect()}
    return b"".join(found.get(k, bytes(size)) for k in range(PARTS))


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """doc_id, key, n, the rarest tokens of each set with their places from 1, and its bits lo and hi.

    Of a set of n words those that another must share one of are n - ceil(least * n) + 1. Tokens whose slot occurs once are no other set's
    and stay out. Each word flips one of 128 bits, so two sets differ in at least as many words as in bits."""
    classes = rarity(sets)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rare = np.frombuffer(classes, np.uint8)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = batch.column("n").to_numpy()[at:]
                k = max(1, int(np.searchsorted(np.cumsum(n), 1 << 19)))
                part = batch.slice(at, k)
                at += k
                n = n[:k].astype(np.int64)
                tokens = part.column("tokens").flatten().to_numpy()
                doc, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                bit = doc * 128 + (tokens.view(np.uint32) >> 25)
                odd = np.packbits((np.bincount(bit, minlength=len(n) * 128) & 1).astype(np.uint8).reshape(len(n), 128), axis=1).view(np.int64)
                kind = rare[tokens.view(np.uint32) & (SLOTS - 1)]
                order = np.lexsort((tokens, kind, doc))
                tokens, kind = tokens[order], kind[order]
                place = np.arange(len(tokens)) - start[doc] + 1
                keep = (place <= (n - np.ceil(least * n - 1e-9) + 1)[doc]) & (kind > 0)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(n)))]).astype(np.int32)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(ends), pa.array(v[keep].astype(np.int32)))
                yield pa.record_batch([*(part.column(c) for c in ("doc_id", "key", "n")), lists(tokens), lists(place), pa.array(odd[:, 0].copy()), pa.array(odd[:, 1].copy())], ["doc_id", "key", "n", "tokens", "places", "lo", "hi"])

    return sets.mapInArrow(run, f"doc_id {sets.schema['doc_id'].dataType.simpleString()}, key binary, n int, tokens array<int>, places array<int>, lo bigint, hi bigint")


def near_sets(docs: DataFrame, sets: DataFrame, firsts: DataFrame, least: float) -> DataFrame:
    """a < b and similarity of documents with different word sets, the first of each set, exactly.

    Prefix filter over hashes: two sets of |x| <= |y| that are similar enough share a word of the n - ceil(2 least / (1 + least) n) + 1
    rarest of x and the n - ceil(least * n) + 1 rarest of y. What meets there is held against the sizes, the places of the first common
    word and the bits; equal hashes of different words only add candidates. Words are compared only of pairs that pass, once by hash
    and then as they are, so that no text goes to the pairs that are not near."""
    part = least / (1 + least)
    rows = prefixes(sets, least).join(firsts, ["doc_id", "key"], "left_semi").select("doc_id", "n", "lo", "hi", F.arrays_zip("tokens", "places").alias("t"))
    rows = rows.select("doc_id", "n", "lo", "hi", F.inline("t").alias("w", "i"))
    short = rows.where(F.col("i") <= F.col("n") - F.ceil(F.lit(2 * part) * F.col("n") - 1e-9) + 1)
    need = f"ceil({part} * (x.n + y.n) - 1e-9)"
    meets = f"""x.w = y.w and (x.n < y.n or (x.n = y.n and x.doc_id < y.doc_id)) and x.n >= {least} * y.n - 1e-9 and 1 + least(x.n - x.i, y.n - y.i) >= {need}
     and bit_count(x.lo ^ y.lo) + bit_count(x.hi ^ y.hi) <= x.n + y.n - 2 * {need}"""
    maybe = short.alias("x").join(rows.alias("y"), F.expr(meets)).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    hashed = sets.join(firsts, ["doc_id", "key"], "left_semi").select("doc_id", "n", "tokens")
    near = shared_table(alike(shared_table(maybe), hashed, "tokens", least).select("a", "b"))  # hashes have at least the words' similarity
    ends = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return alike(near, word_sets(docs.join(ends, "doc_id", "left_semi")), "words", least)


def alike(pairs: DataFrame, sets: DataFrame, col: str, least: float) -> DataFrame:
    """Pairs (a, b) whose sets (doc_id, n and an array) have a Jaccard similarity of least or more."""
    of = lambda end: sets.select(F.col("doc_id").alias(end), F.col(col).alias(f"s_{end}"), F.col("n").alias(f"n_{end}"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", (common / (F.col("n_a") + F.col("n_b") - common)).alias("similarity")).where(F.col("similarity") >= least)


def first_sets(sets: DataFrame) -> DataFrame:
    """The first document of each set."""
    return shared_table(sets.groupBy("key").agg(F.min("doc_id").alias("doc_id")))


def jaccard_pairs(docs: DataFrame, least: float = 0.85) -> DataFrame:
    """All pairs a < b of documents whose word sets have a Jaccard similarity of least or more, exactly.

    Equal sets are one: pairs are sought between distinct sets and copies are paired with the set's first document."""
    sets = keyed_sets(docs)
    firsts = first_sets(sets)
    copies = sets.select("doc_id", "key").join(firsts.withColumnRenamed("doc_id", "first"), "key").where("doc_id <> first")
    return near_sets(docs, sets, firsts, least).union(copies.select(F.col("first").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if one has no length."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays; null where their lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def normalized(a: Column) -> Column:
    """A vector of length 1 in the same direction; a vector without length stays as it is."""
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), x.cast("double")))


def checked_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; an error where their lengths differ."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimensions"))).otherwise(cosine(a, b))


def statistics(found: DataFrame) -> DataFrame:
    """Of a table with the column cluster: total, unique_rows (clusters), singletons, removed, reduction (0 for no rows)."""
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    total, n = F.coalesce(F.sum("k"), F.lit(0)), F.count(F.lit(1))
    return sizes.agg(total.alias("total"), n.alias("unique_rows"), F.count_if(F.col("k") == 1).alias("singletons"), (total - n).alias("removed"), F.coalesce(F.try_divide(total - n, total), F.lit(0.0)).alias("reduction"))


def cosine_pairs(vectors: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs a < b of vectors with a cosine of least or more and how they are related.

    Exact, in blocks of BLOCK vectors, each pair of which is a task; in a task tiles of TILE vectors are multiplied in single precision
    and what comes near the threshold is computed again in double. Time grows with the square of the vectors, memory does not.
    """
    blocks = max(1, -(-vectors.count() // BLOCK))
    rows = vectors.select("vec_id", "embedding").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("vec_id", "embedding", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(table):
        import numpy as np
        import pyarrow as pa

        ids, own = table.column("vec_id").to_numpy(), table.column("own").to_numpy()
        v = np.array(table.column("embedding").to_pylist(), dtype=np.float64)
        length = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
        near = v.astype(np.float32)
        cross = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        out = []
        for p in range(0, len(v), TILE):
            for q in range(p, len(v), TILE):
                i, j = np.nonzero(near[p : p + TILE] @ near[q : q + TILE].T >= least - 1e-4)
                i, j = i + p, j + q
                keep = (i < j) & (own[i] != own[j] if cross else True)
                i, j = i[keep], j[keep]
                sims = np.einsum("ij,ij->i", v[i], v[j])
                good = sims >= least
                a, b = ids[i[good]], ids[j[good]]
                out.append((np.minimum(a, b), np.maximum(a, b), sims[good]))
        a, b, sims = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(sims, pa.float64())})

    out = dealt.groupBy("lo", "hi").applyInArrow(compare, "a bigint, b bigint, similarity double")
    kind = F.when(F.col("similarity") >= 0.95, "DUPLICATE").when(F.col("similarity") >= 0.85, "SIMILAR").otherwise("RELATED")
    return out.withColumn("relationship", kind)


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for each end of links (a, b), by labels that pass to neighbours and halve their paths.

    Every round gives a node the smallest label among its own and its neighbours', then replaces labels
    by the labels of those labels, so that long chains take few rounds. All of it are joins and
    aggregations; each round is written to the shared folder and only a flag reaches the driver.
    A self-link or a repeated link changes nothing; no links give an empty table.
    """
    each = links.where("a <> b").select("a", "b")
    both = shared_table(each.union(each.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", waves=1)
    labels = shared_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels", waves=1)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        best = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        best = shared_table(best.join(up, "component", "left").select("node", "was", F.least("component", F.coalesce("above", "component")).alias("component")), "labels", waves=1)
        done = best.where("was <> component").isEmpty()
        labels = best.select("node", "component")
        if done:
            return labels


def clusters(vectors: DataFrame, least: float = 0.85) -> DataFrame:
    """vec_id and cluster (smallest vec_id); a vector without similar ones is its own cluster."""
    found = components(cosine_pairs(vectors, least))
    return vectors.select("vec_id").join(found.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left").select("vec_id", F.coalesce("component", "vec_id").alias("cluster"))


def pooled(vectors: DataFrame, key: str, how: str = "mean") -> DataFrame:
    """Element-wise mean or maximum of the vectors of each key, a row for each dimension."""
    each = vectors.select(key, F.posexplode("embedding").alias("dim", "x"))
    fold = F.avg if how == "mean" else F.max
    return each.groupBy(key, "dim").agg(fold(F.col("x").cast("double")).alias("value"))


def leaders(docs: DataFrame, least: float = 0.85) -> DataFrame:
    """Greedy leader deduplication in the order of doc_id: doc_id and leader_id (its own if it leads).

    A document follows the smallest leader it is similar to. Over the sparse similar pairs: in each round, undecided
    documents without an undecided smaller neighbour are settled; it takes as many rounds as the longest such chain.
    """
    sets = keyed_sets(docs)
    one = first_sets(sets)
    pairs = shared_table(near_sets(docs, sets, one, least).select("a", "b"))
    state = shared_table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.lit(None).cast("bigint").alias("leader")), waves=1)
    while not state.where("leader is null").isEmpty():
        named = pairs.join(state.select(F.col("node").alias("a"), F.col("leader").alias("la")), "a").groupBy(F.col("b").alias("node")).agg(
            F.min(F.when(F.col("la") == F.col("a"), F.col("a"))).alias("first_leader"), F.min(F.when(F.col("la").isNull(), F.col("a"))).alias("open")
        )
        # a leader below all open neighbours settles a node; so does having no open neighbour
        settled = F.when(F.col("first_leader").isNotNull() & (F.col("open").isNull() | (F.col("first_leader") < F.col("open"))), F.col("first_leader")).when(F.col("open").isNull(), F.coalesce("first_leader", "node"))
        state = shared_table(state.join(named, "node", "left").select("node", F.coalesce("leader", settled).alias("leader")), waves=1)
    words = sets.select("doc_id", "key")
    known = one.withColumnRenamed("doc_id", "first").join(state.withColumnRenamed("node", "first"), "first", "left").select("key", F.coalesce("leader", "first").alias("leader_id"))
    out = words.join(known, "key").select("doc_id", "leader_id")
    return out.union(docs.where("text is not null").join(words, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("leader_id")))
