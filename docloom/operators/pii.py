"""Personal data: mentions, counts, audit and checks. Masking is in scrub.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed, text


def mentions(docs: DataFrame, kind: str, pattern: str | None = None) -> DataFrame:
    """doc_id, position (from 0) and value of each match of a kind of personal data."""
    found = text.matches(F.col("text"), pattern or fixed.PII[kind])
    return docs.where("text is not null").select("doc_id", F.posexplode(found).alias("position", "value"))


def values(docs: DataFrame, pattern: str, group: int) -> DataFrame:
    """doc_id, position and value of a group of each match of a pattern."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(text.java(pattern)), F.lit(group))).alias("position", "value"))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the number of matches of each kind, for documents with any, a row for each kind."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), text.count(F.col("text"), p).alias("n")) for k, p in fixed.PII.items() if k not in ("ADDRESS", "CITY_STATE")])
    return docs.where("text is not null").select("doc_id", F.explode(each).alias("m")).select("doc_id", "m.kind", F.col("m.n").cast("long").alias("n")).where("n > 0")


def audit(docs: DataFrame) -> DataFrame:
    """Totals of matches and documents by kind."""
    return counts(docs).groupBy("kind").agg(F.sum("n").alias("detections"), F.count(F.lit(1)).alias("documents"))


def left_over(col: Column, kinds: tuple[str, ...] = ("phone", "ssn", "email", "zip")) -> Column:
    """Names of the signs of personal data that a text still has."""
    return F.array_compact(F.array(*[F.when(text.rlike(col, fixed.LEFT_OVER[k]), F.lit(k)) for k in kinds]))


def might_contain(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", (F.size(left_over(F.col("text"))) > 0).alias("might_contain_pii"))


def assert_scrubbed(col: Column, strict: bool = False) -> Column:
    """What is left of phone, SSN and e-mail; with strict a text that has any raises an error."""
    found = left_over(col, ("phone", "ssn", "email"))
    return F.when(F.size(found) > 0, F.raise_error(F.concat(F.lit("text is not scrubbed: "), F.array_join(found, ", ")))).otherwise(found) if strict else found


def placeholders(col: Column) -> Column:
    return text.matches(col, fixed.PLACEHOLDER)


def placeholder_counts(docs: DataFrame) -> DataFrame:
    """doc_id, kind and number of placeholders in scrubbed texts."""
    each = docs.where("text is not null").select("doc_id", F.explode(placeholders(F.col("text"))).alias("p"))
    return each.groupBy("doc_id", F.regexp_extract("p", r"\[([A-Z_]+)_\d+\]", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
