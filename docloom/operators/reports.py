"""Records of clinical reports that hold only what was looked for: class, date, imaging, vital signs, pathology.

All of it is column expressions, so a record costs one scan and no shuffle. Extracted text is masked. Null texts have no record;
texts without a value have null in its column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed, text


def found(pattern: str, group: int = 1, column: str = "text") -> Column:
    """Group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(column, text.java(pattern), group), F.lit(""))


def masked(col: Column) -> Column:
    """Extracted text without contacts, numbers, dates and names of people; of the first kinds only the first place is masked."""
    for k, (pattern, by) in enumerate(fixed.RECORD_MASKS):
        pattern = text.java(pattern)
        col = F.regexp_replace(col, "(?s)^(.*?)" + pattern, f"$1{by}") if k < fixed.MASKED_ONCE else F.regexp_replace(col, pattern, by)
    return col


def class_column() -> Column:
    lab = text.rlike(F.col("text"), fixed.REPORT_LAB) & text.rlike(F.col("text"), f"(?i)(?:{'|'.join(fixed.REPORT_TESTS)})")
    return F.when(lab, "lab_report").otherwise(text.first_class(F.col("text"), fixed.REPORT_CLASSES, "unknown"))


def classes(reports: DataFrame) -> DataFrame:
    """doc_id, report_class."""
    return reports.where("text is not null").select("doc_id", class_column().alias("report_class"))


def date_column(named: bool) -> Column:
    no_birth = "".join(rf"(?<!{label}\b[\s\S]{{0,{far}}})" for label, far in fixed.BIRTH)
    tries = [found(fixed.RECORD_DATES[0], 0, "filename")] if named else []
    return F.coalesce(*tries, *[found(f"(?i)(?={p}){no_birth}{p}", 0) for p in fixed.RECORD_DATES])  # looks back only where there is a date


def dates(reports: DataFrame) -> DataFrame:
    """doc_id, report_date as written: the file name's (column filename, if there is one) or the text's first that is no date of birth."""
    return reports.where("text is not null").select("doc_id", date_column("filename" in reports.columns).alias("report_date"))


def _imaging() -> list[Column]:
    modality = F.lit("other")
    for name, pattern in reversed(fixed.REPORT_MODALITIES):
        modality = F.when(text.rlike(F.col("text"), text.java(pattern)), name).otherwise(modality)
    each = F.concat(*[F.regexp_extract_all("text", F.lit(text.java(p)), F.lit(1)) for p in fixed.FINDINGS])
    each = F.transform(each, lambda x: masked(text.trimmed(x)))
    each = F.filter(each, lambda x: (F.length(x) > 10) & ~x.rlike(text.java(fixed.RECORD_NAME)))
    impression = masked(text.trimmed(found(fixed.IMPRESSION + fixed.SECTION_TEXT)))
    return [modality.alias("modality"), F.coalesce(*map(found, fixed.BODY_PARTS), F.lit("unspecified")).alias("body_part"), F.slice(each, 1, 10).alias("findings"), impression.alias("impression")]


def imaging(reports: DataFrame) -> DataFrame:
    """doc_id, modality, body_part, findings (ten at most, as the record has it), impression of reports with a finding or an impression."""
    out = reports.where("text is not null").select("doc_id", *_imaging())
    return out.where(F.col("impression").isNotNull() | (F.size("findings") > 0))


def imaging_record() -> Column:
    """The imaging of a text as a struct; null if there is none."""
    modality, part, findings, impression = _imaging()
    return F.when((F.size(findings) > 0) | impression.isNotNull(), F.struct(modality, part, findings, impression))


def vitals_record() -> Column:
    """The vital signs of a text as a struct; null if there are none."""
    at = {name: (pattern, group) for name, pattern, group in fixed.REPORT_VITALS}
    value = {name: found(*at[name]).cast("double") for name in at}
    value["pain"] = F.when(value["pain"] <= 10, value["pain"])
    unit = lambda name, mark, yes, no: F.when(value[name].isNotNull(), F.when(F.lower(found(at[name][0], 2)).contains(mark), yes).otherwise(no))
    fields = [v.alias(k) for k, v in value.items()] + [unit("temperature", "c", "C", "F").alias("temperature_unit"), unit("weight", "k", "kg", "lb").alias("weight_unit")]
    return F.when(F.coalesce(*value.values()).isNotNull(), F.struct(*fields))


def pathology_record() -> Column:
    """The pathology of a text as a struct; null if there is no diagnosis."""
    fields = _pathology()
    return F.when(fields[1].isNotNull(), F.struct(*fields))


def vital_signs(reports: DataFrame) -> DataFrame:
    """doc_id and a column for each sign, of reports with any; pain beyond 10 is null, temperatures are F and weights lb unless marked."""
    at = {name: (pattern, group) for name, pattern, group in fixed.REPORT_VITALS}
    out = reports.where("text is not null").select("doc_id", "text", *[found(*at[name]).cast("double").alias(name) for name in at])
    out = out.where(F.coalesce(*at).isNotNull())
    unit = lambda name, mark, yes, no: F.when(F.col(name).isNotNull(), F.when(F.lower(found(at[name][0], 2)).contains(mark), yes).otherwise(no))
    out = out.withColumns({"pain": F.when(F.col("pain") <= 10, F.col("pain")), "temperature_unit": unit("temperature", "c", "C", "F"), "weight_unit": unit("weight", "k", "kg", "lb")})
    return out.drop("text")


def _pathology() -> list[Column]:
    value = {name: text.trimmed(found(p)) for name, p in fixed.PATHOLOGY.items()}
    margins = F.element_at(F.create_map(*[F.lit(x) for kv in fixed.MARGINS.items() for x in kv]), F.lower(value["margins"]))
    return [
        F.coalesce(masked(value["specimen_type"]), F.lit("unspecified")).alias("specimen_type"), masked(text.trimmed(found(fixed.PATHOLOGY_DIAGNOSIS + fixed.SECTION_TEXT))).alias("diagnosis"),
        value["grade"].alias("grade"), value["stage"].alias("stage"), margins.alias("margins"),
    ]


def pathology(reports: DataFrame) -> DataFrame:
    """doc_id, specimen_type, diagnosis, grade, stage, margins (negative, positive, close) of reports with a diagnosis."""
    return reports.where("text is not null").select("doc_id", *_pathology()).where("diagnosis is not null")
