"""Quality of texts and of optically recognised words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed, text


def gate(docs: DataFrame, least: float = 0.4, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, score, whether it reaches least (letters, spaces, word length and number of words), and the columns to keep."""
    n = F.greatest(F.length("text"), F.lit(1))
    letters = F.regexp_count("text", F.lit("[a-zA-Z]"))
    spaces = F.regexp_count("text", F.lit(r"\s"))
    counted = docs.where("text is not null").select(
        "doc_id", (letters / n).alias("alpha"), (spaces / n).alias("space"), text.word_count(F.col("text")).alias("n_words"), (F.length("text") - spaces).alias("solid"), *keep
    )
    long = F.when(F.col("n_words") > 0, F.col("solid") / F.col("n_words")).otherwise(0.0)
    part = lambda test, points: F.when(test, F.lit(points)).otherwise(0.0)
    score = part(F.col("alpha") > 0.5, 0.3) + part((F.col("space") > 0.1) & (F.col("space") < 0.3), 0.2)
    score = score + part((long > 3) & (long < 15), 0.3) + part(F.col("n_words") > 10, 0.2)
    return counted.select("doc_id", "n_words", score.alias("score"), *keep).withColumn("passed", F.col("score") >= least)


def is_garbage(word: Column) -> Column:
    """Whether a token is noise: empty, one sign, or a run of signs."""
    w = text.trimmed(word)
    out = (F.length(w) == 0) | ((F.length(w) == 1) & ~w.rlike("[a-zA-Z0-9]"))
    for p in fixed.GARBAGE_TOKENS:
        out = out | w.rlike(p)
    return out


def word_quality(words: DataFrame, min_alpha: float = 0.5, max_garbage: float = 0.15, min_confidence: float = 60.0, high: float = 0.7, low: float = 0.4) -> DataFrame:
    """Per doc_id of recognised words (doc_id, word_idx, text, confidence): metrics, score, level and flags."""
    joined = F.coalesce("text", F.lit(""))
    chars = lambda p: F.sum(F.regexp_count(joined, F.lit(p)))
    m = words.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.median("confidence").alias("median_confidence"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("min_confidence"),
        chars("[a-zA-Z]").alias("letters"), F.sum(F.length(joined)).alias("chars"), F.avg(is_garbage(joined).cast("double")).alias("garbage_ratio"),
        F.max(F.contains(joined, F.lit("[OCR_RECOVERED"))).alias("marked"),
    )
    m = m.withColumn("alpha_ratio", F.coalesce(F.try_divide("letters", "chars"), F.lit(0.0)))
    score = 0.5 * F.col("median_confidence") / 100 + 0.25 * F.least(F.col("alpha_ratio") / min_alpha, F.lit(1.0)) - 0.25 * F.least(F.col("garbage_ratio") / max_garbage, F.lit(1.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score - F.when(F.col("n_words") < 10, 0.1).otherwise(0.0)))
    level = F.when(F.col("score") >= high, "HIGH").when(F.col("score") >= low, "MEDIUM").otherwise("LOW")
    m = m.withColumn("score", score).withColumn("level", level)
    flags = F.array_compact(F.array(
        F.when(F.col("median_confidence") < min_confidence, F.lit("LOW_CONFIDENCE")), F.when(F.col("garbage_ratio") > max_garbage, F.lit("HIGH_GARBAGE_DENSITY")), F.when(F.col("alpha_ratio") < min_alpha, F.lit("LOW_ALPHA_RATIO")),
        F.when(F.col("n_words") < 10, F.lit("SPARSE_TEXT")), F.when(F.col("marked"), F.lit("OCR_RECOVERY_MARKER")), F.when(F.col("level") != "HIGH", F.lit("NEEDS_MANUAL_REVIEW")),
    ))
    return m.withColumn("flags", flags).drop("letters", "chars", "marked")


def is_high(level: Column) -> Column:
    return level == "HIGH"


def needs_review(score: Column, level: Column, flags: Column) -> Column:
    """Whether a page is to be looked at: it is flagged, of low quality, or scores below a half."""
    return F.array_contains(flags, "NEEDS_MANUAL_REVIEW") | (level == "LOW") | (score < 0.5)


def low_regions(words: DataFrame, below: float = 50.0, gap: float = 50.0, drop: float = 20.0, most: int = 10) -> DataFrame:
    """Neighbouring words of low confidence as regions: gaps and islands over each document's words; the first `most` of each."""
    w = Window.partitionBy("doc_id").orderBy("word_idx")
    low = words.where(F.col("confidence") < below).select("doc_id", "word_idx", "text", "confidence", "bbox.*")
    apart = (F.abs(F.col("x") - (F.lag("x").over(w) + F.lag("width").over(w))) >= gap) | (F.abs(F.col("y") - F.lag("y").over(w)) >= drop)
    low = low.withColumn("region", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(w))
    return low.groupBy("doc_id", "region").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"),
        F.avg("confidence").alias("confidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda s: s["text"]), " ").alias("text"),
    ).where(F.col("region") < most)


def clean_stutter(docs: DataFrame) -> DataFrame:
    """doc_id and clean: right-trimmed lines without short repeats of the line above, at most one empty line in a row."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    keep = F.filter(F.col("lines"), lambda x, i: ~((i > 0) & (F.length(x) > 0) & (F.length(x) < 50) & (x == F.get(F.col("lines"), i - 1))))
    out = docs.where("text is not null").select("doc_id", lines.alias("lines")).select("doc_id", F.array_join(keep, "\n").alias("t"))
    return out.select("doc_id", text.trimmed(F.regexp_replace("t", r"\n{3,}", "\n\n")).alias("clean"))
