"""Repeated lines and runs of lines: frequencies, stripping and reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text


def line_frequencies(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """Trimmed lines of least_chars or more and the number of documents that have them."""
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), text.trimmed), lambda x: F.length(x) >= least_chars))
    return docs.where("text is not null").select(F.explode(lines).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("documents"))


def template_lines(docs: DataFrame, share: float = 0.5, least: int = 2) -> DataFrame:
    """Lines in at least max(least, floor(share * documents)) documents."""
    total = docs.where("text is not null").agg(F.count(F.lit(1)).alias("n"))
    found = line_frequencies(docs).join(F.broadcast(total))
    return found.where(F.col("documents") >= F.greatest(F.lit(least), F.floor(F.col("n") * share))).drop("n")


def strip_lines(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, text without template lines, and how many characters went.

    Lines are joined with the templates by value; the lines that stay are put in order again per document.
    """
    lines = docs.where("text is not null").select("doc_id", F.length("text").alias("n"), F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    stay = lines.join(templates.select(F.col("line")), text.trimmed(F.col("raw")) == F.col("line"), "left_anti")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "raw"))), lambda s: s["raw"]), "\n")
    kept = stay.groupBy("doc_id").agg(joined.alias("text"))
    all_docs = docs.where("text is not null").select("doc_id", F.length("text").alias("n"))
    out = all_docs.join(kept, "doc_id", "left").select("doc_id", "n", F.coalesce("text", F.lit("")).alias("text"))
    return out.select("doc_id", "text", (F.col("n") - F.length("text")).alias("chars_removed"))


def ngrams(docs: DataFrame, low: int = 2, high: int = 5, least: int = 3) -> DataFrame:
    """Runs of low..high normalised lines in at least `least` documents: key, size, documents, average first line, example."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.lower(F.regexp_replace(text.trimmed(x), r"\s+", " ")))
    rows = docs.where("text is not null").select("doc_id", lines.alias("lines"))

    def runs(k: int):
        starts = F.when(F.size("lines") >= k, F.sequence(F.lit(0), F.size("lines") - k)).otherwise(F.array().cast("array<int>"))

        def one(i):
            content = F.array_join(F.slice(F.col("lines"), i + 1, k), "\n")
            return F.struct(F.lit(k).alias("size"), i.alias("at"), F.when(F.length(F.regexp_replace(content, r"\s+", "")) >= 10, F.sha2(content, 256)).alias("key"))

        return F.transform(starts, one)

    each = F.filter(F.concat(*[runs(k) for k in range(low, high + 1)]), lambda g: g["key"].isNotNull())  # hashed before they are dealt out
    first = rows.select("doc_id", F.inline(each)).groupBy("key", "size", "doc_id").agg(F.min("at").alias("at"))
    return first.groupBy("key", "size").agg(F.count(F.lit(1)).alias("documents"), F.avg("at").alias("avg_line"), F.min("doc_id").alias("first_doc")).where(F.col("documents") >= least)
