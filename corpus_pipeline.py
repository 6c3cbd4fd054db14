"""From documents to packed sequences: toxicity, line dedup, near-dedup, decontamination, packing.

Defined results of all stages: a null text counts as empty and is neither toxic nor a copy nor a leak, so it stays; a null
doc_id is an id like others; rows that repeat are one class for the near-dedup stage, which keeps one of them; an empty table
gives an empty one with the same columns; columns beside doc_id, text and n_chars are passed on as they are, whatever their
names. A text of any length is judged whole.

Each stage sets the session's limit of an Arrow batch to 4 MB (common.small_batches), unless it is smaller, and leaves it so: results do
not depend on it, the memory of executors and workers does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, linechunks, omh, packing, toxicity
from docloom.llm.common import small_batches, unused, write_shared


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go; texts without words have the score of no evidence."""
    small_batches(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; documents of which nothing is left go, those empty before stay. n_chars, where
    there is one, follows the text of documents that changed."""
    small_batches(spark)
    text, count = unused(docs, "clean"), unused(docs, "removed_lines")
    found = linechunks.clean(docs, text, count)
    found = found.where((F.col(count) == 0) | (F.col(text) != ""))
    out = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(count) > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest doc_id; ties go by the text's key, null ids come last."""
    small_batches(spark)
    return omh.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; an empty benchmark drops none."""
    small_batches(spark)
    return decontaminate.remove_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences; an empty text is one piece of length 1."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_leaks), ("packing", pack)]
#: SQL expresses none of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of all documents; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
