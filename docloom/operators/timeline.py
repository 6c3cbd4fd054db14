"""Events with dates from notes: extraction, deduplication, order, size limit, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Kind, confidence and pattern of events, in order; the date is group 1.
EVENTS = [
    ("visit", "medium", r"(?i)(?:visit|appointment|consultation).*?(\d{1,2}/\d{1,2}/\d{4})"),
    ("lab_result", "high", r"(?i)(?:lab|test)\s+results?.*?(\d{1,2}/\d{1,2}/\d{4})"),
    ("medication_change", "high", r"(?i)(?:started|stopped|prescribed).*?(\d{1,2}/\d{1,2}/\d{4})"),
]


def raw_events(notes: DataFrame) -> DataFrame:
    """doc_id, idx (place in the note's list), type, confidence, raw date; dates are not checked."""
    def of(kind: str, confidence: str, pattern: str):
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        return F.transform(found, lambda d: F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), d.alias("raw")))

    each = [of(*e) for e in EVENTS]
    return notes.where("text is not null").select("doc_id", F.posexplode(F.concat(*each)).alias("idx", "e")).select("doc_id", "idx", "e.*").withColumn("date", F.try_to_timestamp("raw", F.lit("M/d/yyyy")).cast("date"))


def events(notes: DataFrame) -> DataFrame:
    """Events with valid dates from 1900 to 2100, and whether month and day could be swapped."""
    found = raw_events(notes).where("year(date) between 1900 and 2100")
    return found.select("doc_id", "idx", "type", "confidence", "date", ((F.month("date") <= 12) & (F.dayofmonth("date") <= 12) & (F.month("date") != F.dayofmonth("date"))).alias("ambiguous"))


def date_errors(notes: DataFrame) -> DataFrame:
    """Dates that are none, as an error table."""
    bad = raw_events(notes).where("date is null or year(date) not between 1900 and 2100")
    return bad.select("doc_id", F.lit("ParseError").alias("tag"), F.concat(F.lit("not a date: "), F.col("raw")).alias("message"), F.lit(True).alias("recoverable"))


def deduplicate(found: DataFrame, aggressive: bool = True) -> DataFrame:
    """The first event of each date and type; without aggressive, of each document too. First by doc_id and place, by an aggregate."""
    keys = ["date", "type"] if aggressive else ["date", "type", "doc_id"]
    first = F.min(F.struct("doc_id", "idx", "confidence"))
    kept = found.groupBy(*keys).agg(first.alias("f"), F.count(F.lit(1)).alias("merged"))
    return kept.select("date", "type", "f.doc_id", "f.idx", "f.confidence", "merged")


def most(n: int, kb: float) -> int:
    """How many of n events fit into kb, at 0.1 each; never fewer than ten if there are ten."""
    while n > 10 and n * 0.1 > kb:
        n = max(10, min(n - 1, int(kb / 0.1) + 1))
    return n


def compress(found: DataFrame, kb: float) -> DataFrame:
    """The events that fit into kb, the most trusted and latest first: a top-k, not a full sort."""
    weight = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    return found.orderBy(weight.desc(), F.desc("date"), "doc_id", "idx").limit(most(1 << 60, kb))  # of fewer events all fit


def summary(found: DataFrame) -> DataFrame:
    """Per type: events, first and last date."""
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def previous(panels: DataFrame, key: str, *order: str) -> DataFrame:
    """Each row with the last value before it of the same key and test, skipping nulls, and the change in per cent."""
    w = Window.partitionBy(key, "test").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = panels.withColumn("previous", F.last("value", True).over(w))
    return rows.withColumn("change_pct", F.try_divide(F.col("value") - F.col("previous"), F.col("previous")) * 100)
