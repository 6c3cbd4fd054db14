"""Operators over streams: scoring without state, and exact deduplication under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import pii, quality


def scored(stream: DataFrame) -> DataFrame:
    """The quality gate over a stream of documents."""
    return quality.gate(stream)


def checked(stream: DataFrame) -> DataFrame:
    """doc_id and what is left of personal data in a stream of texts."""
    return stream.select("doc_id", pii.left_over(F.col("text")).alias("left_over"))


def distinct(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first of equal texts within the delay of a stream with event times."""
    keyed = stream.withColumn("content_hash", F.sha2(text.normalised(F.col("text")), 256))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])
