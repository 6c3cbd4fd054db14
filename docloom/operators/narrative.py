"""Narratives of extracted facts: a section for each kind of fact, by verbosity, and the whole.

Facts come as arrays in one row for each document (gathered()), so that a narrative is a column expression. A kind
without facts has no section.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed, text

VERBOSITIES = ("MINIMAL", "BRIEF", "STANDARD", "DETAILED")
KINDS = ("DIAGNOSES", "MEDICATIONS", "LABS", "VITALS", "IMAGING", "TRENDS")


@dataclass(frozen=True)
class Config:
    """Verbosity, the kinds told, how they are written, and the most characters of a section and of the whole."""

    verbosity: str = "STANDARD"
    kinds: tuple[str, ...] = KINDS
    bullets: bool = True
    abbreviations: bool = True
    units: bool = True
    highlight: bool = True
    most: int = 5000
    most_section: int = 1000

    @property
    def lead(self) -> str:
        return "• " if self.bullets else "- "


def title(kind: str, verbosity: str) -> str:
    return fixed.SECTION_TITLES[kind][VERBOSITIES.index(verbosity)]


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(items: Column, fn) -> Column:
    return F.array_join(F.transform(items, fn), "\n")


def _both(*parts: Column) -> Column:
    """Lines that are not null, with line ends between."""
    return F.concat_ws("\n", *parts)


def diagnoses(items: Column, cfg: Config = Config()) -> Column:
    """Items: diagnosis, kind, icd10."""
    first = F.get(F.filter(items, lambda d: d["kind"] == "PRIMARY"), F.lit(0))
    rest = F.filter(items, lambda d: d["kind"] != "PRIMARY")
    code = lambda d: F.coalesce(_text(" (", d["icd10"], ")"), F.lit(""))
    if cfg.verbosity == "MINIMAL":
        every = F.array_join(F.transform(items, lambda d: d["diagnosis"]), ", ")
        return F.concat(F.left(every, F.lit(100)), F.when(F.length(every) > 100, "...").otherwise(""))
    others = _text("Secondary: ", F.size(rest), " additional diagnoses") if cfg.verbosity == "BRIEF" else _lines(rest, lambda d: F.concat(F.lit(cfg.lead), d["diagnosis"], code(d)))
    return _both(F.when(first.isNotNull(), F.concat(F.lit("Primary: "), first["diagnosis"], code(first))), F.when(F.size(rest) > 0, others))


def medications(items: Column, cfg: Config = Config()) -> Column:
    """Items: name, dose, route, frequency, status."""
    active = F.filter(items, lambda m: F.coalesce(m["status"], F.lit("")) != "DISCONTINUED")
    if cfg.verbosity == "MINIMAL":
        return _text(F.size(active), " active medications")
    known = lambda c: F.when((c != "") & (c != "UNKNOWN"), c)
    each = F.transform(active, lambda m: F.concat(F.lit(cfg.lead), F.concat_ws(" ", m["name"], F.nullif(m["dose"], F.lit("")), *([known(m["route"])] if cfg.abbreviations else []), known(m["frequency"]))))
    if cfg.verbosity == "BRIEF":
        return F.when(F.size(each) > 5, _text(F.array_join(F.slice(each, 1, 5), "\n"), "\n... and ", F.size(each) - 5, " more")).otherwise(F.array_join(each, "\n"))
    return F.array_join(each, "\n")


def is_abnormal(status: Column) -> Column:
    return ~status.isin("NORMAL", "UNKNOWN")


def labs(items: Column, cfg: Config = Config()) -> Column:
    """Items: test, value, unit, status."""
    bad, good = F.filter(items, lambda x: is_abnormal(x["status"])), F.filter(items, lambda x: ~is_abnormal(x["status"]))
    if cfg.verbosity == "MINIMAL":
        return F.when(F.size(bad) == 0, "Labs WNL").otherwise(_text(F.size(bad), " abnormal lab(s)"))
    written = lambda x: F.concat(F.lit(cfg.lead), x["test"], F.lit(": "), text.number(x["value"]), *([F.lit(" "), x["unit"]] if cfg.units else []))
    mark = lambda s: F.when(F.lit(cfg.highlight) & s.contains("CRITICAL"), " ⚠️").when(s.contains("HIGH"), " (H)").when(s.contains("LOW"), " (L)").otherwise("")
    parts = [F.when(F.size(bad) > 0, _lines(bad, lambda x: F.concat(written(x), mark(x["status"]))))]
    if cfg.verbosity == "DETAILED":
        parts.append(F.when(F.size(good) > 0, _lines(good, written)))
    elif cfg.verbosity == "STANDARD":
        parts.append(F.when(F.size(good) > 0, _text(F.size(good), " other labs within normal limits")))
    return _both(*parts)


def vitals(items: Column, cfg: Config = Config()) -> Column:
    """Items: sign, value."""
    of = lambda sign: text.number(F.get(F.filter(items, lambda v: v["sign"] == sign), F.lit(0))["value"])
    degrees = "°F" if cfg.units else ""
    short = [
        _text("BP ", of("BP_SYSTOLIC"), "/", of("BP_DIASTOLIC")), _text("HR ", of("HEART_RATE")), _text("RR ", of("RESPIRATORY_RATE")), _text("T ", of("TEMPERATURE"), degrees), _text("SpO2 ", of("SPO2"), "%"),
    ]
    long = [
        _text("Blood Pressure ", of("BP_SYSTOLIC"), "/", of("BP_DIASTOLIC"), " mmHg"), _text("Heart Rate ", of("HEART_RATE"), " bpm"), _text("Respiratory Rate ", of("RESPIRATORY_RATE"), "/min"),
        _text("Temperature ", of("TEMPERATURE"), degrees), _text("Oxygen Saturation ", of("SPO2"), "%"),
    ]
    parts = F.array_compact(F.array(*(short if cfg.abbreviations else long)))
    return F.array_join(F.slice(parts, 1, 3) if cfg.verbosity == "MINIMAL" else parts, ", ")


def imaging(items: Column, cfg: Config = Config()) -> Column:
    """Items: modality, body_part, finding, impression, abnormal."""
    n = F.size(F.filter(items, lambda f: f["abnormal"]))
    if cfg.verbosity == "MINIMAL":
        return F.when(n == 0, _text(F.size(items), " imaging study(ies), unremarkable")).otherwise(_text(n, " abnormal imaging finding(s)"))
    said = lambda f: F.when(f["abnormal"], "Abnormal").otherwise("Normal") if cfg.verbosity == "BRIEF" else F.coalesce(F.nullif(f["impression"], F.lit("")), f["finding"])
    return _lines(items, lambda f: F.concat(F.lit(cfg.lead), f["modality"], F.lit(" "), f["body_part"], F.lit(": "), said(f), F.when(F.lit(cfg.highlight) & f["abnormal"], " ⚠️").otherwise("")))


def trends(items: Column, cfg: Config = Config()) -> Column:
    """Items: test, trend."""
    moving = F.filter(items, lambda t: ~t["trend"].isin("STABLE", "INSUFFICIENT_DATA"))
    none = F.lit("") if cfg.verbosity == "MINIMAL" else F.lit("No significant lab trends")
    way = lambda t: F.when(t["trend"] == "INCREASING", "↑ increasing").when(t["trend"] == "DECREASING", "↓ decreasing").otherwise("fluctuating")
    told = _text(F.size(moving), " trending lab value(s)") if cfg.verbosity == "MINIMAL" else _lines(moving, lambda t: F.concat(F.lit(cfg.lead), t["test"], F.lit(": "), way(t)))
    return F.when(F.size(moving) == 0, none).otherwise(told)


WRITERS = {"DIAGNOSES": diagnoses, "MEDICATIONS": medications, "LABS": labs, "VITALS": vitals, "IMAGING": imaging, "TRENDS": trends}


def section(kind: str, items: Column, cfg: Config = Config()) -> Column:
    """A section as a struct: kind, title, content (cut), chars (uncut), items, abnormal. Other kinds are empty."""
    if kind not in WRITERS:
        return F.struct(F.lit(kind).alias("kind"), F.lit("").alias("title"), F.lit("").alias("content"), F.lit(0).alias("chars"), F.lit(0).alias("items"), F.lit(False).alias("abnormal"))
    content = WRITERS[kind](items, cfg)
    bad = F.lit(False)
    if kind == "LABS":
        bad = F.exists(items, lambda x: is_abnormal(x["status"]))
    elif kind == "VITALS":
        bad = F.exists(items, lambda v: F.coalesce(v["status"].isin("ABNORMAL", "CRITICAL"), F.lit(False)))
    elif kind == "IMAGING":
        bad = F.exists(items, lambda f: f["abnormal"])
    elif kind == "TRENDS":
        bad = F.exists(items, lambda t: t["trend"].isin("INCREASING", "DECREASING"))
    return F.struct(F.lit(kind).alias("kind"), F.lit(title(kind, cfg.verbosity)).alias("title"), text.truncated(content, cfg.most_section).alias("content"), F.length(content).alias("chars"), F.size(items).alias("items"), bad.alias("abnormal"))


def gathered(notes: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """doc_id, input_chars and an array of facts for each kind, in the order of the note."""
    order = {"diagnoses": ("line_no",), "medications": ("line_no", "nth"), "labs": ("line_no", "test"), "vitals": ("nth",), "imaging": ("nth",), "trends": ("test",)}
    out = notes.where("text is not null").select("doc_id", F.length("text").alias("input_chars"))
    for kind, by in order.items():
        if kind in facts:
            rest = [c for c in facts[kind].columns if c != "doc_id" and c not in by]
            each = facts[kind].groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*by, *rest))).alias(kind))
            out = out.join(each, "doc_id", "left")
    return out


def generate(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, sections, narrative, characters before and after, ratio and counts, of rows as gathered() makes them."""
    kinds = [k for k in KINDS if k in cfg.kinds and k.lower() in rows.columns]
    sections = F.array_compact(F.array(*[F.when(F.size(k.lower()) > 0, section(k, F.col(k.lower()), cfg)) for k in kinds]))
    rows = rows.withColumn("sections", sections)
    told = F.filter("sections", lambda s: F.length(s["content"]) > 0)
    whole = F.array_join(F.transform(told, lambda s: F.when(s["title"] != "", F.concat(s["title"], F.lit(":\n"), s["content"])).otherwise(s["content"])), "\n\n")
    n = lambda k: F.greatest(F.coalesce(F.size(k), F.lit(0)), F.lit(0)) if k in rows.columns else F.lit(0)
    bad = F.greatest(F.coalesce(F.size(F.filter("labs", lambda x: is_abnormal(x["status"]))), F.lit(0)), F.lit(0)) if "labs" in rows.columns else F.lit(0)
    out = rows.withColumn("whole", whole)
    return out.select(
        "doc_id", "sections", text.truncated(F.col("whole"), cfg.most).alias("narrative"), "input_chars", F.length("whole").alias("output_chars"),
        F.when(F.col("input_chars") > 0, 1 - F.length("whole") / F.col("input_chars")).otherwise(0.0).alias("ratio"), n("diagnoses").alias("n_diagnoses"), n("medications").alias("n_medications"),
        n("labs").alias("n_labs"), bad.alias("n_abnormal"), n("imaging").alias("n_imaging"),
    )
