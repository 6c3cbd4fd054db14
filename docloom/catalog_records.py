"""Registered queries over clinical charts: records, first and second extractors, narratives, and the SQL that gives the same rows.

A chart is a text made of the keys of orders, several shapes for each of its lines; one expression gives it in Spark and in
DuckDB alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.catalog import case, query, r6, table
from docloom.functions import fixed, shared
from docloom.functions.text import sql_literal as lit
from docloom.operators import extraction, labs, narrative, whitelist

AS_OF = "2025-06-01"
# The alternatives of each line, one of which a chart has by its key; numbers in braces are the key modulo the first, plus the second.
CHART = [
    ["Patient Name: John Smith", "Progress note of the visit", "CT scan of the chest 3/{28:1}/2024", "Discharge summary", "Lab panel of 2024-{12:1}-0{9:1}", "Pathology: biopsy"],
    ["Assessment:", "Primary Dx: Pneumonia J18.{10:0}", "Discharge Diagnosis: Asthma", "no change", "Diagnosis: C34.{10:0} - Lung cancer, left", "PLAN OF CARE:"],
    ["{9:1}. Chronic kidney disease N18.{6:0}", "2) Hypertension", "ok", "diagnosed with severe heart failure", "Stage III lung cancer", "NOTES AND PLAN:", "recurrent skin carcinoma of the arm"],
    ["Lisinopril {40:5} mg PO daily", "Metformin {900:100} mg PO BID", "continue atorvastatin at bedtime", "Amoxicillin {500:1} mg oral TID and warfarin 5 mg", "took Foobar 10 mg", "lorazepam 1 mg PRN"],
    ["WBC: {20:1}.5 K/uL", "Potassium {6:1}.2 mEq/L and Sodium {30:120} mmol/L", "Troponin <0.0{9:1} ng/mL", "Hemoglobin {14:6}.1 g/dL", "Glucose {300:40} mg/dL H", "HCT 3{10:0} % and PLT {400:90} K/uL", "HbA1c: {9:3}.1 %"],
    ["BP: 1{90:10}/8{10:0} HR 7{10:0}", "Temp: 3{10:0}.5 C", "SpO2 9{10:0}% Pain: {12:0}/10", "Weight: 8{10:0} kg", "Temperature 9{10:0}.8 RR {20:8}", "nothing to add", "MRI brain, US of liver used", "IMPRESSION: {30:1} mm nodule"],
    ["BUN {40:2} mg/dL, Creatinine {4:0}.9 mg/dL", "ALT {90:5} U/L", "TSH {9:0}.3 mIU/L", "", "metformin 500 mg PO BID", "call 555-010-{9000:1000} or a{9:0}@b.org"],
]


def _line(alternatives: list[str], salt: int) -> str:
    n = len(alternatives)
    one = lambda t: "concat(" + ", ".join([f"cast((k * {salt} + {salt}) % {p.split(':')[0]} + {p.split(':')[1]} as string)" if i % 2 else lit(p) for i, p in enumerate(re.split(r"\{([^}]*)\}", t))]) + ")"
    return f"case (k // {salt}) % {n} " + " ".join(f"when {i} then {one(t)}" for i, t in enumerate(alternatives[:-1])) + f" else {one(alternatives[-1])} end"


CHART_TEXT = "concat_ws(chr(10), " + ", ".join(_line(alternatives, 2 * i + 1) for i, alternatives in enumerate(CHART)) + ")"
CHART_SQL = f"(select k doc_id, {CHART_TEXT} as text from (select o_orderkey k from orders))"


def charts(spark, sf_dir) -> DataFrame:
    """A chart for each order."""
    keys = shared.dealt_out(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k")), "k")
    return keys.select(F.col("k").alias("doc_id"), F.expr(CHART_TEXT.replace("//", "div").replace("chr(10)", "'\\n'")).alias("text"))


NOTES = f"n as materialized {CHART_SQL}"
NUM = "case when {0} = floor({0}) then {0}::bigint::varchar else {0}::varchar end"


def first(pattern: str, group: int = 1, col: str = "text") -> str:
    return f"nullif(regexp_extract({col}, {lit(pattern)}, {group}), '')"


# records


def _record_labs() -> str:
    out = []
    for i, test in enumerate(fixed.RECORD_LABS):
        p = whitelist.lab_pattern(test)
        low, high, unit = fixed.RECORD_RANGES.get(test, (None, None, ""))
        x = f"try_cast(regexp_extract(text, {lit(p)}, 1) as double)"
        status = "'Normal'" if low is None else f"case when {x} < {low * 0.5} or {x} > {high * 2} then 'Critical' when {x} < {low} then 'Low' when {x} > {high} then 'High' else 'Normal' end"
        ref = "null::varchar" if low is None else lit(labs.shown(low, high))
        out.append(f"select doc_id, {i} i, {lit(test)} test, regexp_extract(text, {lit(p)}, 1) as value, coalesce({first(p, 2)}, {lit(unit)}) unit, {ref} reference, {status} status, {x} x from n where regexp_matches(text, {lit(p)})")
    return "wl as materialized (" + " union all ".join(out) + ")"


RECORD_LABS_SQL = _record_labs()


@query(f"with {NOTES}, {RECORD_LABS_SQL} select doc_id, test, value, unit, reference, status from wl where x is not null")
def record_labs(spark, sf_dir):
    return whitelist.records(charts(spark, sf_dir), AS_OF).select("doc_id", F.explode_outer("labs").alias("l")).where("l is not null").select("doc_id", "l.test", "l.value", "l.unit", "l.reference", "l.status")


def _zipped(pattern: str, groups: int) -> str:
    each = ", ".join(f"coalesce(unnest(regexp_extract_all(text, {lit(pattern)}, {g})), '') g{g}" for g in range(1, groups + 1))
    return f"select doc_id, generate_subscripts(regexp_extract_all(text, {lit(pattern)}), 1) i, {each} from n"


KNOWN = "lower(g1) in (" + ", ".join(lit(d.lower()) for d in fixed.DRUGS) + ")"
ROUTE = "case lower(g4) " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in fixed.RECORD_ROUTES.items()) + " end"
RECORD_MEDS_SQL = f"""wm0 as ({_zipped(fixed.RECORD_DRUG, 5)}),
wm as materialized (select doc_id, i, g1 as name, g2 dose, g3 unit, {ROUTE} route, nullif(g5, '') frequency from wm0 where {KNOWN} or not regexp_matches(g1, '^[A-Z][a-z]+$')
 qualify row_number() over (partition by doc_id, lower(g1 || '-' || g2 || '-' || g3) order by i) = 1)"""


@query(f"with {NOTES}, {RECORD_MEDS_SQL} select doc_id, name, dose, unit, route, frequency from wm")
def record_medications(spark, sf_dir):
    found = whitelist.records(charts(spark, sf_dir), AS_OF).select("doc_id", F.explode_outer("medications").alias("m")).where("m is not null")
    return found.select("doc_id", "m.name", "m.dose", "m.unit", "m.route", "m.frequency")


def masked_sql(col: str) -> str:
    for k, (p, by) in enumerate(fixed.RECORD_MASKS):
        col = f"regexp_replace({col}, {lit(p)}, {lit(by)}{'' if k < fixed.MASKED_ONCE else ', ' + lit('g')})"
    return col


def _record_diagnoses() -> str:
    out = []
    for k, p in enumerate(fixed.RECORD_DIAGNOSES):
        g = 2 if k in (0, 2) else 1
        out.append(f"select doc_id, {k} p, generate_subscripts(regexp_extract_all(text, {lit(p)}), 1) i, unnest(regexp_extract_all(text, {lit(p)}, {g})) c, unnest(regexp_extract_all(text, {lit(p)}, 1)) code from n")
    drugs = "(" + ", ".join(map(lit, fixed.NOT_NAMES)) + ")"
    sure = "case " + " ".join(f"when contains(lower(c), {lit(w)}) then {lit(s)}" for w, s in fixed.SEVERITIES) + " else 'unspecified' end"
    return rf"""wd0 as ({' union all '.join(out)}), wd1 as (select doc_id, p, i, regexp_replace(trim(c), '[,;.]$', '') c, case when regexp_matches(code, '^[A-Z]\d{{2}}') then code end icd10 from wd0),
wd as materialized (select doc_id, p, i, c, {masked_sql('c')} "condition", icd10, {sure} severity from wd1
 where len(list_filter(regexp_extract_all(c, '\b([A-Z][a-z]{{2,}})\s+[A-Z][a-z]{{2,}}\b', 1), lambda w: w not in {drugs})) = 0 qualify row_number() over (partition by doc_id, lower(c) order by p, i) = 1)"""


RECORD_DX_SQL = _record_diagnoses()


@query(f'with {NOTES}, {RECORD_DX_SQL} select doc_id, "condition", icd10, severity from wd')
def record_diagnoses(spark, sf_dir):
    return whitelist.records(charts(spark, sf_dir), AS_OF).select("doc_id", F.explode_outer("diagnoses").alias("d")).where("d is not null").select("doc_id", "d.condition", "d.icd10", "d.severity")


HASH = "list_reduce(list_prepend(0::bigint, list_transform(string_split(text, ''), lambda c: ord(c)::bigint)), lambda h, c: (h * 31 + c) & 4294967295)"
IMG = f"""(len(list_filter(list_concat(regexp_extract_all(text, {lit(fixed.FINDINGS[1])}, 1), regexp_extract_all(text, {lit(fixed.FINDINGS[2])}, 1), regexp_extract_all(text, '(?i)(?:Findings?|Impression|Conclusion)[:\\s]*([^\\n]+)', 1)), lambda f: length(trim(f)) > 10)) > 0)"""
VIT = "coalesce(" + ", ".join(first(p, g) + "::double" for name, p, g in fixed.REPORT_VITALS if name != "pain") + f", case when {first(fixed.REPORT_VITALS[-1][1])}::double <= 10 then 1.0 end) is not null"
PATH = f"regexp_matches(text, {lit(fixed.PATHOLOGY_DIAGNOSIS + r'[:' + chr(92) + r's]*[^' + chr(92) + r'n]+')})"
DAY = "coalesce(" + ", ".join(first(f"(?i){p}", 0) for p in fixed.RECORD_DATES) + ")"
CLASS = f"case when regexp_matches(text, {lit(fixed.REPORT_LAB)}) and regexp_matches(text, {lit('(?i)' + '|'.join(fixed.REPORT_TESTS))}) then 'lab_report' else {case(fixed.REPORT_CLASSES, 'text', 'unknown')} end"
RECORD_SQL = f"""{RECORD_LABS_SQL}, {RECORD_MEDS_SQL}, {RECORD_DX_SQL},
wr as materialized (select n.doc_id, {HASH} h, {CLASS} document_type, {DAY} document_date, coalesce(l.k, 0) n_labs, coalesce(l.bad, 0) warnings, coalesce(m.k, 0) n_medications, coalesce(d.k, 0) n_diagnoses,
 {IMG}::int + ({VIT})::int + ({PATH})::int other from n left join (select doc_id, count(x) k, count(*) - count(x) bad from wl group by doc_id) l using (doc_id) left join (select doc_id, count(*) k from wm group by doc_id) m using (doc_id)
 left join (select doc_id, count(*) k from wd group by doc_id) d using (doc_id))"""


@query(f"""with {NOTES}, {RECORD_SQL} select doc_id, lpad(lower(to_hex(case when h >= 2147483648 then 4294967296 - h else h end)), 8, '0') hash, document_type, document_date,
 case when n_labs + n_medications + n_diagnoses + other > 0 then 70 + least(30, 3 * (n_labs + n_medications + n_diagnoses + other)) else 30 end::int confidence, n_labs::int n_labs, n_medications::int n_medications, n_diagnoses::int n_diagnoses, warnings::int warnings from wr""")
def record_summary(spark, sf_dir):
    size = lambda c: F.size(c).alias(c if c == "warnings" else f"n_{c}")
    return whitelist.records(charts(spark, sf_dir), AS_OF).select("doc_id", "hash", "document_type", "document_date", "confidence", size("labs"), size("medications"), size("diagnoses"), size("warnings"))


@query(f"with {NOTES}, {RECORD_SQL} select count(*) documents, count(*) successful, 0::bigint failed, sum(n_labs)::bigint labs, sum(n_diagnoses)::bigint diagnoses, sum(n_medications)::bigint medications from wr")
def record_statistics(spark, sf_dir):
    docs = charts(spark, sf_dir)
    return whitelist.statistics(docs, whitelist.records(docs, AS_OF))


@query(f"""with {NOTES}, {RECORD_DX_SQL}, o as (select doc_id, row_number() over (order by coalesce({DAY}, '9999'), doc_id) place from n)
select lower("condition") as key, place, "condition", severity from wd join o using (doc_id) qualify row_number() over (partition by lower("condition") order by place, p, i) = 1""")
def record_active_diagnoses(spark, sf_dir):
    found = whitelist.active(whitelist.ordered(whitelist.records(charts(spark, sf_dir), AS_OF)), "diagnoses", "condition")
    return found.select("key", "place", "condition", "severity")


LEAK = "case " + " ".join(f"when regexp_matches(text, {lit(p)}) then {lit(n)}" for n, p in fixed.RECORD_LEAKS if n != "potentialName") + " end"


@query(f"with {NOTES} select doc_id, {LEAK} leak from n where not regexp_matches(text, {lit(fixed.SCRUB_NAME)})")
def record_leaks(spark, sf_dir):
    return charts(spark, sf_dir).where(~F.col("text").rlike(fixed.SCRUB_NAME)).select("doc_id", whitelist.leak(F.col("text")).alias("leak"))


# the first extractor


def _first_labs() -> str:
    out = []
    for k, (test, (p, low, high)) in enumerate(fixed.FIRST_LABS.items()):
        status = "'Normal'"
        if low is not None:
            below, above = fixed.FIRST_CRITICAL.get(test, (None, None))
            bad = " or ".join([f"x < {below}"] * (below is not None) + [f"x > {above}"] * (above is not None))
            status = "case " + (f"when {bad} then 'Critical' " if bad else "") + f"when x < {low} then 'Low' when x > {high} then 'High' else 'Normal' end"
        ref = "null::varchar" if low is None else lit(labs.shown(low, high))
        out.append(
            f"select doc_id, {k} t, i, {lit(test)} test, v as value, regexp_extract(place, {lit(fixed.FIRST_UNIT)}, 2) unit, {ref} reference, {status} status, x from (select *, v::double x from (select doc_id,"
            f" generate_subscripts(regexp_extract_all(text, {lit(p)}), 1) i, unnest(regexp_extract_all(text, {lit(p)}, 0)) place, unnest(regexp_extract_all(text, {lit(p)}, 1)) v from n))"
        )
    return "fl0 as (" + " union all ".join(out) + "), fl as materialized (select *, (row_number() over (partition by doc_id order by t, i) - 1)::int idx from fl0)"


FIRST_SQL = _first_labs()


@query(f"with {NOTES}, {FIRST_SQL} select doc_id, idx, test, value, unit, reference, status from fl")
def labs_first(spark, sf_dir):
    return labs.labs(charts(spark, sf_dir))


FIRST_PANEL = "case " + " ".join(f"when bool_or(test in ({', '.join(map(lit, tests))})) then {lit(name)}" for name, tests in fixed.FIRST_PANELS) + " else 'Lab Results' end"
SIGN = "case status " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in fixed.STATUS_SIGNS.items()) + " end"


@query(f"""with {NOTES}, {FIRST_SQL} select doc_id, {FIRST_PANEL} panel, '### 🧪 ' || {FIRST_PANEL} || chr(10) || '**Date**: ' || doc_id || chr(10) || chr(10) || '| Test | Value | Reference Range | Status |' || chr(10)
 || '|------|-------|----------------|--------|' || chr(10) || string_agg('| ' || test || ' | ' || value || ' ' || unit || ' | ' || coalesce(reference, 'N/A') || ' | ' || {SIGN} || ' ' || status || ' |', chr(10) order by idx) || chr(10) markdown
from fl group by doc_id""")
def lab_tables(spark, sf_dir):
    docs = charts(spark, sf_dir)
    return labs.tables(labs.labs(docs), docs.select("doc_id", F.col("doc_id").cast("string").alias("date")))


@query(f"""with {NOTES}, {FIRST_SQL}, o as (select doc_id, row_number() over (order by doc_id) place from (select distinct doc_id from fl)), b as (select o.place + 1 place, test, first(x order by idx) previous from fl join o using (doc_id) group by all)
select doc_id, idx, test, previous, x as value, round((x - previous) / nullif(previous, 0) * 100, 6) change_pct from fl join o using (doc_id) join b using (place, test)""")
def lab_changes(spark, sf_dir):
    from docloom.operators.master import numbered

    found = labs.labs(charts(spark, sf_dir))
    order = numbered(found.select("doc_id").distinct(), "doc_id", "place")
    return labs.changes(found, order).select("doc_id", "idx", "test", "previous", "value", r6("change_pct"))


# the second extractor

LINES = "ls as (select doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int line_no, unnest(string_split(text, chr(10))) line from n)"


def parsed(classes: list[tuple[str, str]], col: str) -> str:
    return f"case when coalesce({col}, '') = '' then 'UNKNOWN' else {case(classes, f'lower({col})', 'UNKNOWN')} end"


ORDER = lambda g: f"regexp_extract(line, {lit(fixed.ORDER)}, {g})"
PART = lambda p, g: f"regexp_extract(line, {lit(p)}, {g})"
MEDS_SQL = f"""{LINES}, o as (select *, {', '.join(f'{ORDER(g)} o{g}' for g in range(1, 6))} from ls),
a as (select doc_id, line_no, 0 nth, trim(o1) as name, {NUM.format('o2::double')} || ' ' || o3 dose, o2::double dose_value, o3 dose_unit, {parsed(fixed.ROUTES, 'o4')} route, {parsed(fixed.FREQUENCIES, 'o5')} frequency, 0.7 confidence from o where o1 <> ''),
b0 as (select *, list_filter(regexp_extract_all(line, {lit(fixed.DRUG)}, 1), lambda w: length(w) >= 4) ws from o where o1 = ''),
b as (select doc_id, line_no, generate_subscripts(ws, 1) - 1 nth, unnest(ws) as name, nullif({PART(fixed.DOSE, 0)}, '') dose, try_cast({PART(fixed.DOSE, 1)} as double) dose_value, nullif({PART(fixed.DOSE, 2)}, '') dose_unit,
 {parsed(fixed.ROUTES, PART(fixed.ROUTE, 1))} route, {parsed(fixed.FREQUENCIES, PART(fixed.FREQUENCY, 1))} frequency, 0.5 confidence from b0),
meds as materialized (select * from (select * from a union all select * from b) qualify row_number() over (partition by doc_id, lower(name) order by line_no, nth) = 1)"""


@query(f"with {NOTES}, {MEDS_SQL} select doc_id, line_no, name, dose, dose_value, dose_unit, route, frequency, case when frequency = 'PRN' and confidence = 0.7 then 'PRN' else 'ACTIVE' end status, confidence::double confidence from meds")
def medications(spark, sf_dir):
    return extraction.medications(charts(spark, sf_dir)).drop("nth")


_OWN = "case " + " ".join(f"when regexp_matches(line, {lit(p)}) then {lit(k)}" for k, p in fixed.DIAGNOSIS_KINDS) + " end"
_AFTER = "case own " + " ".join(f"when {lit(k)} then regexp_replace(line, {lit('(?i)^.*?' + p.removeprefix('(?i)'))}, '')" for k, p in fixed.DIAGNOSIS_KINDS) + " end"
DX_SQL = rf"""{LINES}, t as (select doc_id, line_no, trim(line) line from ls where trim(line) <> ''), u as (select *, {_OWN} own, regexp_matches(line, {lit(fixed.DIAGNOSIS_HEADER)}) header from t),
v as (select *, case when own is not null or header then 1 when regexp_matches(line, {lit(fixed.DIAGNOSIS_END)}) then 0 end mark from u),
w as (select *, last_value(mark ignore nulls) over p inside, coalesce(last_value(own ignore nulls) over p, 'UNKNOWN') kind from v window p as (partition by doc_id order by line_no)),
x as (select *, case when own is not null then trim({_AFTER}) when mark is null then trim(regexp_replace(line, '^[\d\.\)\-]+\s*', '')) end said from w where inside = 1),
dx as materialized (select doc_id, line_no, kind, coalesce(nullif(trim(regexp_replace(said, {lit(fixed.ICD10)}, '')), ''), said) diagnosis, nullif(regexp_extract(said, {lit(fixed.ICD10)}, 1), '') icd10, own from x where length(said) >= 3)"""


@query(f"with {NOTES}, {DX_SQL} select doc_id, line_no, diagnosis, icd10, kind, (case when icd10 is not null then 0.9 when own is not null then 0.8 else 0.7 end)::double confidence from dx")
def diagnoses(spark, sf_dir):
    return extraction.diagnoses(charts(spark, sf_dir)).drop("status")


def _vitals() -> str:
    out = []
    for k, (sign, p, group, unit, low, high, sure) in enumerate(fixed.VITAL_SIGNS):
        value = f"{first(p, group)}::double"
        shown = "null::varchar" if unit is None else lit(unit)
        x = value
        if sign == "TEMPERATURE":
            shown, x = f"case when contains({PART2(p)}, 'C') then '°C' else '°F' end", f"case when contains(upper({PART2(p)}), 'C') then {value} * 9 / 5 + 32 else {value} end"
        elif unit is None:
            shown = f"coalesce({first(p, 2)}, 'kg')"
        bad = " or ".join([f"({x}) < {low}"] * (low is not None) + [f"({x}) > {high}"] * (high is not None))
        status = f"case when {bad} then 'ABNORMAL' else 'NORMAL' end" if bad else "null::varchar"
        out.append(f"select doc_id, {k} k, {lit(sign)} sign, {value} as value, {shown} unit, {status} status, {sure}::double confidence from n where {first(p, group)} is not null")
    return "vs as materialized (" + " union all ".join(out) + ")"


PART2 = lambda p: f"coalesce(regexp_extract(text, {lit(p)}, 2), '')"
VITALS_SQL = _vitals()


@query(f"with {NOTES}, {VITALS_SQL} select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int nth, sign, value, unit, status, confidence from vs")
def vitals(spark, sf_dir):
    return extraction.vitals(charts(spark, sf_dir))


_WHAT = fixed.IMAGING.removeprefix("(?i)" + chr(92) + "b")
IMAGING_SQL = rf"""mo as (select doc_id, text, unnest(range(1, length(text) + 1)) i from n),
mp as (select doc_id, text, i, regexp_extract(text[i:], {lit('(?i)^' + _WHAT)}, 0) hit from mo where regexp_matches(text[i:i + 12], {lit('(?i)^' + _WHAT)}) and (i = 1 or not regexp_matches(text[i - 1:i - 1], '[A-Za-z0-9_]'))),
mq as (select *, text[greatest(1, i - 50):i + 99] near, strpos(text[i:], 'IMPRESSION') p, {case(fixed.MODALITIES, 'hit', 'UNKNOWN')} modality from mp),
mr as (select *, coalesce(nullif(regexp_extract(near, {lit(fixed.IMAGED)}, 1), ''), 'unspecified') body_part, case when p between 1 and 500 then trim(string_split(text[i + p + 10:], chr(10) || chr(10))[1][:case when contains(text[i + p - 1:], chr(10) || chr(10)) then 100000 else 189 end], ' ' || chr(10)) else '' end said from mq)"""


@query(f"""with {NOTES}, {IMAGING_SQL} select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int nth, modality, body_part, case when p between 1 and 500 then said else modality || ' ' || body_part || ' performed' end finding, nullif(said, '') impression,
 regexp_matches(near, {lit(fixed.ABNORMAL)}) abnormal, (case when said <> '' then 0.8 else 0.5 end)::double confidence from mr""")
def imaging(spark, sf_dir):
    return extraction.imaging(charts(spark, sf_dir))


@query(f"""with {NOTES}, {MEDS_SQL.replace(LINES, LINES, 1)}, {DX_SQL.replace(LINES + ', ', '')}, {VITALS_SQL}, f as (select doc_id, 'm' k, confidence < 0.7 low from meds union all select doc_id, 'd', false from dx union all select doc_id, 'v', false from vs),
c as (select doc_id, count(*) filter (where k = 'm') medications, count(*) filter (where k = 'd') diagnoses, count(*) filter (where k = 'v') vitals, count(*) facts, count(*) filter (where low) low_confidence from f group by doc_id)
select doc_id, coalesce(medications, 0) medications, coalesce(diagnoses, 0) diagnoses, coalesce(vitals, 0) vitals, coalesce(facts, 0) facts, coalesce(low_confidence, 0) low_confidence from n left join c using (doc_id)""")
def extraction_summary(spark, sf_dir):
    docs = charts(spark, sf_dir)
    found = extraction.extract_all(docs, extraction.Config(labs=False, imaging=False))
    return extraction.summary(docs, found).drop("low_percent")


# narratives


def facts(spark, sf_dir) -> dict[str, DataFrame]:
    """Facts of an order made of its line items."""
    line_no = F.struct("l_linenumber", "l_partkey")  # a number of both would run over where there are many parts
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), line_no.alias("line_no"), "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_partkey")
    status = F.when(F.col("l_returnflag") == "R", "CRITICAL_HIGH").when(F.col("l_returnflag") == "A", "LOW").otherwise("NORMAL")
    return {
        "labs": li.select("doc_id", "line_no", F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("test"), F.col("l_quantity").alias("value"), F.lit("u").alias("unit"), status.alias("status")),
        "medications": li.select("doc_id", "line_no", F.lit(0).alias("nth"), "l_quantity", F.concat(F.lit("drug"), (F.col("l_partkey") % 7).cast("string")).alias("name"), F.lit("5 mg").alias("dose"), F.lit("PO").alias("route"), F.when(F.col("l_partkey") % 2 == 0, "BID").otherwise("UNKNOWN").alias("frequency"), F.lit("ACTIVE").alias("status")),
        "diagnoses": li.select("doc_id", "line_no", "l_quantity", F.concat(F.lit("finding "), (F.col("l_partkey") % 11).cast("string")).alias("diagnosis"), F.when(F.col("l_linestatus") == "F", "PRIMARY").otherwise("UNKNOWN").alias("kind"), F.when(F.col("l_partkey") % 3 == 0, "A01").alias("icd10")),
    }


def told(spark, sf_dir, verbosity: str) -> DataFrame:
    found = facts(spark, sf_dir)
    notes = found["labs"].select("doc_id").distinct().withColumn("text", F.lit("x" * 1000))
    out = narrative.generate(narrative.gathered(notes, found), narrative.Config(verbosity=verbosity))
    return out.select("doc_id", "narrative", "output_chars", r6("ratio"), "n_labs", "n_abnormal", "n_medications", "n_diagnoses")


def _told(verbosity: str) -> str:
    brief = verbosity == "BRIEF"
    title = lambda k: lit(narrative.title(k, verbosity) + ":" + chr(10))
    med = "'• drug' || l_partkey % 7 || ' 5 mg PO' || case when l_partkey % 2 = 0 then ' BID' else '' end"
    meds = f"string_agg({med}, chr(10) order by l_linenumber, l_partkey, l_quantity)"
    if brief:
        meds = f"array_to_string(list({med} order by l_linenumber, l_partkey, l_quantity)[1:5], chr(10)) || case when count(*) > 5 then chr(10) || '... and ' || (count(*) - 5) || ' more' else '' end"
    code = "case when l_partkey % 3 = 0 then ' (A01)' else '' end"
    rest = "'Secondary: ' || count(*) filter (where l_linestatus <> 'F') || ' additional diagnoses'" if brief else "string_agg('• finding ' || l_partkey % 11 || CODE, chr(10) order by l_linenumber, l_partkey, l_quantity) filter (where l_linestatus <> 'F')"
    rest = f"case when count(*) filter (where l_linestatus <> 'F') > 0 then {rest.replace('CODE', code)} end"
    # the first primary diagnosis is told, further ones are neither primary nor secondary
    dx = f"concat_ws(chr(10), 'Primary: ' || (list('finding ' || l_partkey % 11 || {code} order by l_linenumber, l_partkey, l_quantity) filter (where l_linestatus = 'F'))[1], {rest})"
    flag = "case l_returnflag when 'R' then ' ⚠️' else ' (L)' end"
    value = "'• T' || l_linenumber || ': ' || l_quantity::bigint || ' u'"
    good = "" if brief else ", case when count(*) filter (where l_returnflag = 'N') > 0 then count(*) filter (where l_returnflag = 'N') || ' other labs within normal limits' end"
    labs_ = f"concat_ws(chr(10), string_agg({value} || {flag}, chr(10) order by l_linenumber, l_partkey, l_quantity) filter (where l_returnflag <> 'N'){good})"
    cut = lambda c, n: f"case when length({c}) <= {n} then {c} else left({c}, {n - 3}) || '...' end"
    return f"""with a as (select l_orderkey doc_id, {dx} d, {meds} m, {labs_} l, count(*) k, count(*) filter (where l_returnflag <> 'N') bad from lineitem group by l_orderkey),
w as (select *, concat_ws(chr(10) || chr(10), {title('DIAGNOSES')} || {cut('d', 1000)}, {title('MEDICATIONS')} || {cut('m', 1000)}, case when l <> '' then {title('LABS')} || {cut('l', 1000)} end) t from a)
select doc_id, {cut('t', 5000)} narrative, length(t)::int output_chars, round(1 - length(t) / 1000.0::double, 6) ratio, k::int n_labs, bad::int n_abnormal, k::int n_medications, k::int n_diagnoses from w"""


@query(_told("STANDARD"))
def narratives(spark, sf_dir):
    return told(spark, sf_dir, "STANDARD")


@query(_told("BRIEF"))
def narratives_brief(spark, sf_dir):
    return told(spark, sf_dir, "BRIEF")
