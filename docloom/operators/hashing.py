"""Fingerprints of texts: content hash, SimHash, class and dates, and duplicates by them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import fixed, text


def content_hash(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.sha2(F.encode(text.normalised(F.col("text")), "UTF-8"), 256).alias("content_hash"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, content_hash, rank among equal ones and the first doc_id; the join splits a skewed hash, no window holds it."""
    hashed = content_hash(docs)
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(first, "content_hash").select("doc_id", "content_hash", "first_id", "copies", (F.col("doc_id") != F.col("first_id")).alias("is_duplicate"))


def document_type(docs: DataFrame, name: str | None = None) -> DataFrame:
    """Class of each text by its name and its first 500 characters."""
    head = F.substring("text", 1, 500)
    head = F.concat(F.coalesce(F.col(name), F.lit("")), F.lit(" "), head) if name else head
    return docs.where("text is not null").select("doc_id", text.first_class(F.lower(head), fixed.DOCUMENT_TYPES, "unknown").alias("document_type"))


def dates(docs: DataFrame) -> DataFrame:
    found = F.array_distinct(F.concat(*[text.matches(F.col("text"), p) for p in fixed.DATES]))
    return docs.where("text is not null").select("doc_id", found.alias("dates"))


@F.pandas_udf(T.LongType())
def simhash32(texts: pd.Series) -> pd.Series:
    """Votes of the words' 31-based hashes for each of 32 bits; the 64-bit print is these bits twice."""
    known: dict[str, int] = {}
    bits = np.arange(32)

    def word_hash(word: str) -> int:
        h = 0
        units = word.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = (h * 31 + units[i] + (units[i + 1] << 8)) & 0xFFFFFFFF
        known[word] = h
        return h

    def one(t: str) -> int:
        h = np.array([known[w] if w in known else word_hash(w) for w in t.split(" ") if len(w) > 2], np.int64)
        votes = ((h[:, None] >> bits) & 1).sum(axis=0)
        return int(((2 * votes > len(h)).astype(np.int64) << bits).sum())

    return texts.map(one)


def simhash(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", simhash32(text.normalised(F.col("text"))).alias("simhash"))


def near_prints(docs: DataFrame) -> DataFrame:
    """Documents whose fingerprints are equal or one bit of 32 apart (similarity 0.95 or more).

    Equal fingerprints meet once: distinct prints are paired over the 32 one-bit masks by an equi-join. relation near: the smallest
    documents of two prints and how many documents share them; member: the smallest document of a print and each that has it.
    """
    each = simhash(docs)
    prints = each.groupBy("simhash").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("docs"))
    masks = prints.select("first", "simhash", "docs", F.explode(F.expr("transform(sequence(0, 31), i -> simhash ^ shiftleft(1L, i))")).alias("near"))
    other = prints.select(F.col("simhash").alias("near"), F.col("first").alias("other_id"), F.col("docs").alias("other_docs"))
    pairs = masks.join(other, "near").where("simhash < near").select(
        F.least("first", "other_id").alias("a"), F.greatest("first", "other_id").alias("b"), (F.col("docs") + F.col("other_docs")).alias("docs"), F.lit("near").alias("relation")
    )
    return pairs.union(each.join(prints, "simhash").select(F.col("first"), F.col("doc_id"), "docs", F.lit("member")))


def fingerprints(docs: DataFrame, name: str | None = None) -> DataFrame:
    """Content hash, SimHash, number of words, dates and class of each text."""
    t = F.col("text")
    head = F.substring("text", 1, 500)
    head = F.concat(F.coalesce(F.col(name), F.lit("")), F.lit(" "), head) if name else head
    norm = text.normalised(t)
    return docs.where("text is not null").select(
        "doc_id", F.sha2(F.encode(norm, "UTF-8"), 256).alias("content_hash"), simhash32(norm).alias("simhash"), F.size(F.split(t, r"\s+")).alias("word_count"),
        F.array_distinct(F.concat(*[text.matches(t, p) for p in fixed.DATES])).alias("dates"), text.first_class(F.lower(head), fixed.DOCUMENT_TYPES, "unknown").alias("document_type"),
    )


def compare(pairs: DataFrame) -> DataFrame:
    """Difference class of rows with the columns hash, simhash, type and date of two documents (suffixes _a and _b)."""
    sim = 1 - 2 * F.expr("bit_count(simhash_a ^ simhash_b)") / 64
    near = (sim >= 0.7) & (F.col("type_a") == F.col("type_b")) & (F.abs(F.datediff("date_a", "date_b")) <= 3)
    kind = F.when(F.col("hash_a") == F.col("hash_b"), "exact").when(sim >= 0.95, "near-duplicate").when(near, "same-event").otherwise("unique")
    return pairs.withColumn("similarity", F.when(F.col("hash_a") == F.col("hash_b"), 1.0).otherwise(sim)).withColumn("difference", kind)


def number_documents(docs: DataFrame, date: str = "date", newest_first: bool = False) -> DataFrame:
    """document_number in the order of date, then doc_id, without a single-partition window.

    Dates are counted, the counts are summed up over the days (few rows), and documents are numbered inside their day.
    """
    day = F.col(date).desc() if newest_first else F.col(date).asc()
    days = docs.groupBy(date).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select(date, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(date).orderBy("doc_id")
    numbered = docs.withColumn("__nth", F.row_number().over(inside)).join(starts, date)
    return numbered.withColumn("document_number", (F.col("__start") + F.col("__nth")).cast("long")).drop("__nth", "__start")
