"""The compression pipeline: quality gate, template lines, leader deduplication, counts, narratives, totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed, text
from docloom.operators import clinical, quality, similarity, templates


@dataclass(frozen=True)
class Config:
    """Stages that run, and their parameters."""

    ocr: bool = True
    template: bool = True
    dedup: bool = True
    extract: bool = True
    narrative: bool = True
    min_quality: float = 0.4
    warn_quality: float = 0.6
    template_share: float = 0.5
    similarity: float = 0.85
    verbosity: str = "STANDARD"

    def stages(self) -> list[str]:
        """Names of the stages that run, in order."""
        return [s for s, on in zip(fixed.STAGE_NAMES, (self.ocr, self.template, self.dedup, self.extract, self.narrative), strict=True) if on]


COUNTS = ("diagnoses", "medications", "labs", "abnormal_labs")


def run(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """A row for each document: quality, passed, duplicate_of, characters before, kept and at the end, counts and narrative.

    final_chars are those of the kept text; where nothing of a document that passed and is no copy is left, its own text counts. Columns
    of stages that do not run are null. Texts are joined once: with what is left of them after the leaders are known."""
    base = docs.where("text is not null").select("doc_id", "text")
    rows = quality.gate(base, cfg.min_quality, ("text",)).drop("n_words") if cfg.ocr else base.select("doc_id", F.lit(None).cast("double").alias("score"), "text", F.lit(True).alias("passed"))
    live = rows.where("passed").select("doc_id", "text")
    if cfg.template:
        live = similarity.shared_table(templates.strip_lines(live, templates.template_lines(live, cfg.template_share)).select("doc_id", "text"))
    leaders = similarity.shared_table(similarity.leaders(live, cfg.similarity)) if cfg.dedup else live.select("doc_id", F.col("doc_id").alias("leader_id"))
    facts = clinical.lite_columns() if cfg.extract else {c: F.lit(None).cast("int") for c in COUNTS}
    told = clinical.lite_told(cfg.verbosity) if cfg.narrative else F.lit(None).cast("string")
    kept = live.select("doc_id", F.length("text").alias("kept_chars"), *[c.alias(name) for name, c in facts.items()], told.alias("narrative"))
    kept = kept.join(leaders, "doc_id").withColumn("duplicate_of", F.when(F.col("leader_id") != F.col("doc_id"), F.col("leader_id"))).drop("leader_id")
    lead = F.col("duplicate_of").isNull()
    kept = kept.select("doc_id", "duplicate_of", *[F.when(lead, F.col(c)).alias(c) for c in ("kept_chars", *COUNTS, "narrative")])
    out = rows.select("doc_id", F.length("text").alias("original_chars"), F.col("score").alias("quality"), "passed").join(kept, "doc_id", "left")
    own = F.when(F.col("passed") & F.col("duplicate_of").isNull(), F.col("original_chars")).otherwise(0)
    return out.withColumn("final_chars", F.coalesce(F.nullif("kept_chars", F.lit(0)), own))


def totals(result: DataFrame) -> DataFrame:
    """One row: documents, those with and without text at the end, passed, duplicates, characters, counts, and the compression ratio.

    The end is the narratives, if there are any, else the kept texts."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = result.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("final_chars") > 0).alias("successful"), F.count_if(F.col("final_chars") == 0).alias("failed"), F.count_if("passed").alias("passed"),
        F.count("duplicate_of").alias("duplicates"), total("original_chars").alias("original_chars"), total("kept_chars").alias("output_chars"), total(F.length("narrative")).alias("narrative_chars"),
        *[total(c).alias(c) for c in COUNTS],
    )
    end = F.when(F.col("narrative_chars") > 0, F.col("narrative_chars")).otherwise(F.col("output_chars"))
    return out.withColumn("ratio", F.when(F.col("original_chars") > 0, 1 - end / F.col("original_chars")).otherwise(0.0))


def shown(ratio):
    """A ratio as it is shown, in per cent."""
    return F.concat(text.fixed_decimals(ratio * 100, 1), F.lit("%"))


def single(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Each document for itself, without templates and copies, which need others: quality, characters at the end, count, narrative and warnings."""
    base = docs.where("text is not null").select("doc_id", "text")
    rows = quality.gate(base, cfg.min_quality, ("text",)) if cfg.ocr else base.select("doc_id", F.lit(None).cast("double").alias("score"), "text", F.lit(True).alias("passed"))
    facts = clinical.lite_columns()
    good = F.col("passed")
    percent = F.concat(F.format_string("%.0f", F.col("score") * 100), F.lit("%"))
    warnings = F.array_compact(F.array(
        F.when(~good, F.concat(F.lit("OCR quality too low: "), percent)), F.when((F.col("score") < cfg.warn_quality) & (F.col("score") >= cfg.min_quality), F.concat(F.lit("Low OCR quality: "), percent)),
    ))
    count = facts["diagnoses"] + facts["medications"] + facts["labs"] if cfg.extract else F.lit(None).cast("double")
    told = clinical.lite_told(cfg.verbosity) if cfg.narrative else F.lit(None).cast("string")
    return rows.select(
        "doc_id", F.length("text").alias("original_chars"), F.when(good, F.length("text")).otherwise(0).alias("final_chars"), F.col("score").alias("quality"), "passed", F.when(good, count).alias("extractions"),
        F.when(good, told).alias("narrative"), warnings.alias("warnings"),
    )


def stage(name: str, docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One stage alone over documents, as one row: stage, documents in, out and left out."""
    if name not in fixed.STAGE_NAMES:
        raise ValueError(f"no stage {name}")
    base = docs.where("text is not null").select("doc_id", "text")
    kept = F.lit(True)
    if name == "OCR_QUALITY":
        base, kept = quality.gate(base, cfg.min_quality), F.col("passed")
    elif name == "SEMANTIC_DEDUP":
        base, kept = similarity.leaders(base, cfg.similarity), F.col("leader_id") == F.col("doc_id")
    n = F.count(F.lit(1))
    return base.agg(n.alias("documents_in"), F.count_if(kept).alias("documents_out")).select(F.lit(name).alias("stage"), F.lit(fixed.STAGE_NAMES[name]).alias("title"), "documents_in", "documents_out", (F.col("documents_in") - F.col("documents_out")).alias("left_out"))


def estimate(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row: a rough ratio by the stages that run, 0.8 at most, and the characters it would leave."""
    ratio = min(0.05 * cfg.ocr + 0.20 * cfg.template + 0.15 * cfg.dedup + 0.30 * cfg.narrative, 0.80)
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n"))
    return chars.select(F.lit(ratio).alias("ratio"), F.floor(F.col("n") * (1 - ratio) + 0.5).cast("long").alias("output_chars"))
